"""Held-out passages inside a corpus.

Method: a distributed positional inverted index. The terms are short phrases of
the held-out texts: as many letters as ``LETTERS`` says, from the beginning of a
word on. Blocks of corpus texts store their postings by term (term, text,
place); document frequencies of the whole corpus tell which terms are rare. For
each window of a held-out text its rarest terms are looked up, the lists are
set off by the terms' own places and intersected; texts that meet enough of
them are held against all terms of the window, then against places, and the few
that are left are aligned word by word.

Nothing is lost on the way: an edit of one word takes only the terms over that
word, so how many of a window's terms at least survive the edits that a passage
may have is known for each window, and no step asks for more.

Positions count letters and digits only. So broken lines, split words, markup
and punctuation don't move a term against its neighbours.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import at_most, cut, spread

PASSAGE_WORDS = 28
CHANGED = 0.1
#: Letters of a term. Texts of very short words get shorter terms, of as many letters as never fail.
LETTERS = 8
#: Rare terms of a window that a text must meet, where so many are sure to survive.
AGREEING = 3
#: Runs whose places in both texts drift apart by more letters aren't of one passage.
BAND = 64
#: Held-out letters that are looked up together, at most: larger sets go over the corpus in so many turns.
ITEM_LETTERS = 4_000_000
#: Words of a stretch of a held-out text that is handled at once; stretches overlap by twice a passage.
STRETCH = 512
BLOCK_LETTERS = 1_000_000
#: Texts are searched in parts of at least twice so many letters.
LEAST_STEP = 1024
#: Candidate texts that are broadcast to the corpus for the alignment, at most; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
_GRAM = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TAG = re.compile(r"</?[A-Za-z][\w:-]*(?:\s[^<>]*)?/?>|<!--.*?-->", re.S)
_ALNUM = re.compile(r"[^\W_]+")
_NONE = np.iinfo(np.int32).max


class Reading(NamedTuple):
    """A text as its letters and digits, with the words they come from."""

    letters: str
    words: list[str]
    starts: list[int]


class Grams(NamedTuple):
    """Hashes of all runs of ``_GRAM`` letters of a text, and their sorted order where the text is searched for."""

    hashes: np.ndarray
    sorted: np.ndarray
    places: np.ndarray


def _rolled(letters: str, n: int) -> np.ndarray:
    """Hash of the ``n`` letters from each place on."""
    codes = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    m = max(0, len(codes) - n + 1)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = h * _BASE + codes[k : k + m]
    return h


def grams(letters: str, searched: bool = False) -> Grams:
    h = _rolled(letters, _GRAM)
    if not searched:
        return Grams(h, h, h)
    order = np.argsort(h, kind="stable")
    return Grams(h, h[order], order)


def _runs(item: Grams, part: np.ndarray) -> list[tuple[int, int, int]]:
    """Longest common runs of letters: place in the item, place in the part of a document, length."""
    if not len(item.sorted):
        return []
    low = np.searchsorted(item.sorted, part)
    j = np.flatnonzero(item.sorted[np.minimum(low, len(item.sorted) - 1)] == part)
    if not len(j):
        return []
    low = low[j]
    n = np.searchsorted(item.sorted, part[j], "right") - low
    first = np.repeat(np.cumsum(n) - n, n)
    i = item.places[np.repeat(low, n) + np.arange(int(n.sum())) - first]
    j = np.repeat(j, n)
    order = np.lexsort((j, j - i))
    i, j = i[order], j[order]
    new = np.flatnonzero(np.concatenate([[True], (j[1:] != j[:-1] + 1) | (i[1:] != i[:-1] + 1)]))
    lengths = np.diff(np.concatenate([new, [len(j)]])) + _GRAM - 1
    return list(zip(i[new].tolist(), j[new].tolist(), lengths.tolist()))


def _plain(text: str) -> str:
    """A text without markup, case and compatibility forms."""
    if "<" in text:
        text = _TAG.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()


def letters_of(text: str) -> str:
    return "".join(_ALNUM.findall(_plain(text)))


def read(text: str) -> Reading:
    """Letters and digits of a text, and its words, cut at white space."""
    text = _plain(text)
    words, starts, at = [], [], 0
    for raw in text.split():
        w = raw if raw.isalnum() else "".join(filter(str.isalnum, raw))
        if w:
            words.append(w)
            starts.append(at)
            at += len(w)
    return Reading("".join(words), words, starts)


def edit_windows(least: int, most: float) -> list[tuple[int, int]]:
    """The shortest numbers of words that allow each number of edits, up to twice ``least``.

    A longer passage has a half that is a passage itself, so each passage holds
    one of less than ``2 * least`` words, and begins with one of these windows and at most its edits.
    """
    out: list[tuple[int, int]] = []
    for words in range(least, 2 * least):
        edits = int(words * most + 1e-9)
        if not out or edits > out[-1][1]:
            out.append((words, edits))
    return out


def _most_of(values: np.ndarray, width: int, n: int) -> np.ndarray:
    """Sum of the ``n`` greatest values of each window."""
    windows = np.lib.stride_tricks.sliding_window_view(values, width)
    return np.sort(np.partition(windows, width - n, axis=1)[:, width - n :], axis=1).sum(1) if n else np.zeros(len(windows), values.dtype)


def _wanted(starts: np.ndarray, least: int, most: float) -> list[tuple[int, np.ndarray]]:
    """Per window of words: the letters that stand in runs of ``_GRAM`` or more, at least, in a passage that begins with it."""
    sizes = np.diff(starts)
    out = []
    for words, edits in edit_windows(least, most):
        if len(sizes) >= words:
            out.append((words, starts[words:] - starts[:-words] - _most_of(sizes, words, edits) - (_GRAM - 1) * (edits + 1)))
    return out


def _covers(runs: list[tuple[int, int, int]], starts: np.ndarray, wanted: list[tuple[int, np.ndarray]]) -> bool:
    """Whether the runs cover some window of the item as far as a passage must."""
    edge = np.zeros(int(starts[-1]) + 1, np.int32)
    r = np.array(runs)
    np.add.at(edge, r[:, 0], 1)
    np.add.at(edge, r[:, 0] + r[:, 2], -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])[starts]
    return any(bool(np.any(covered[words:] - covered[:-words] >= need)) for words, need in wanted)


class Held(NamedTuple):
    """A stretch of a held-out text with what the comparison needs of it."""

    text: Reading
    grams: Grams
    starts: np.ndarray
    wanted: list[tuple[int, np.ndarray]]


def hold(text: Reading, least: int = PASSAGE_WORDS, most: float = CHANGED) -> Held:
    starts = np.array([*text.starts, len(text.letters)])
    return Held(text, grams(text.letters, True), starts, _wanted(starts, least, most))


def holds_passage(held: Held, doc: Reading, lo: int, hi: int, least: int = PASSAGE_WORDS, most: float = CHANGED, doc_grams: Grams | None = None) -> bool:
    """Whether the letters from ``lo`` to ``hi`` of a document hold ``least`` consecutive words of the item, with a share of ``most`` changed, dropped or added."""
    if len(held.text.words) < least:
        return False
    begin, end = max(0, lo), min(len(doc.letters), hi)
    hashes = (doc_grams or grams(doc.letters)).hashes[begin : max(begin, end - _GRAM + 1)]
    runs = _runs(held.grams, hashes)
    return bool(runs) and _covers(runs, held.starts, held.wanted) and _joined(held.text, doc.letters[begin:end], doc.starts, begin, runs, least, most)


def _joined(item: Reading, part: str, doc_starts: list[int], begin: int, runs: list[tuple[int, int, int]], least: int, most: float) -> bool:
    """Whether runs that follow each other make a passage.

    For each run and number of edits the first word of the longest way there is kept; all runs
    before it within ``BAND`` letters of gap and drift are tried. So no way is left out.
    """
    edits = int(4 * least * most) + 1
    starts = [*item.starts, len(item.letters)]
    doc_starts = doc_starts[max(0, bisect_right(doc_starts, begin) - 1) : bisect_left(doc_starts, begin + len(part))]
    runs = sorted(runs)
    reach: list[list[int]] = []
    near: dict[int, list[tuple[int, int]]] = {}
    for y, (i, j, k) in enumerate(runs):
        first, after = bisect_left(starts, i), bisect_right(starts, i + k) - 1
        own = [first] + [first - _edge(item, part, doc_starts, begin, i, j, first, -1)] * (edits - 1)
        drift = j - i
        for band in range(drift // BAND - 1, drift // BAND + 2):
            held = near.get(band)
            if not held:
                continue
            if any(end + BAND < i for end, _ in held):
                held = near[band] = [x for x in held if x[0] + BAND >= i]
            for end, x in held:
                a, b, m = runs[x]
                if end > i + 3 or b + m > j + 3 or abs(drift - b + a) > BAND or a >= i or b >= j or all(p >= q for p, q in zip(reach[x], own)):
                    continue
                c = _gap_edits(item, starts, part, doc_starts, begin, runs[x], runs[y])
                for e in range(c, edits):
                    if reach[x][e - c] < own[e]:
                        own[e] = reach[x][e - c]
        reach.append(own)
        near.setdefault(drift // BAND, []).append((i + k, y))
        more = None
        for e in range(edits):
            if after - own[e] >= least and e <= most * (after - own[e]) + 1e-9:
                return True
            if e + 1 < edits and after - own[e] >= least - 2 * _GRAM:
                more = _edge(item, part, doc_starts, begin, i + k, j + k, after, 1) if more is None else more
                if (n := after + more - own[e]) >= least and e + 1 <= most * n + 1e-9:
                    return True
    return False


def _edge(item: Reading, part: str, doc_starts: list[int], begin: int, i: int, j: int, word: int, way: int) -> int:
    """Words that a way gains by one edit beyond its first or last run; those after the edit are too short for a run.

    ``word``: the first whole word of the run or the one after its last; ``i, j``: the run's end in question.
    """
    edge = (item.starts[word] if word < len(item.starts) else len(item.letters)) - i + j  # where that word begins in the document
    best = 0
    for skipped, added in ((1, 1), (1, 0), (0, 1)):  # a word changed, dropped, or added
        w, at = word, edge
        if added:
            k = bisect_left(doc_starts, at + begin) - 1 if way < 0 else bisect_right(doc_starts, at + begin)
            if not 0 <= k <= len(doc_starts) - (way < 0):
                continue
            at = (doc_starts[k] if k < len(doc_starts) else begin + len(part)) - begin
        w += way * skipped
        gained = 0
        while (0 < w) if way < 0 else (w < len(item.words)):
            own = item.words[w - 1 if way < 0 else w]
            if not (part.endswith(own, 0, max(0, at)) if way < 0 else part.startswith(own, at)):
                break
            at += way * len(own)
            w += way
            gained += 1
        if gained:
            best = max(best, gained + skipped)
    return best


def _gap_edits(item: Reading, starts: list[int], part: str, doc_starts: list[int], begin: int, one: tuple[int, int, int], two: tuple[int, int, int]) -> int:
    """Words of the item changed or dropped between two runs, or words put in, if those are more."""
    (a, b, m), (i, j, _) = one, two
    first, after = bisect_right(starts, a + m) - 1, bisect_left(starts, i)
    if first >= after or (after - first == 1 and i <= a + m):  # no word, or one that both runs make whole
        lacking, low, high = range(0), b + m, j
    else:
        lacking = range(first, after)
        low = b + m - (a + m - starts[first])
        high = j + max(0, starts[after] - i)
    gap = part[max(0, low) : max(low, high)]
    at = same = 0
    for w in lacking:
        p = gap.find(item.words[w], at)
        if p >= 0:
            at, same = p + len(item.words[w]), same + 1
    put_in = bisect_left(doc_starts, high + begin) - bisect_left(doc_starts, low + begin) - same
    return max(len(lacking) - same, put_in)


class Terms(NamedTuple):
    """The terms of some held-out texts: those of all stretches one after another.

    ``hashes`` are the terms, sorted; ``lengths`` the numbers of letters in use. Place by place:
    ``term`` (its number in ``hashes``), ``at`` (letters before it in its stretch) and ``word``
    (words before it, over all stretches, which are kept apart). ``first`` has the bounds of each stretch's places.
    For each of ``edit_windows`` and each place: ``inside``, the terms within the window that begins
    there, and ``need``, how many of them survive, or ``_NONE`` where no window begins. No passage has more letters than ``step``.
    """

    hashes: np.ndarray
    lengths: list[int]
    term: np.ndarray
    at: np.ndarray
    word: np.ndarray
    first: np.ndarray
    inside: np.ndarray
    need: np.ndarray
    step: int


def _survivors(starts: np.ndarray, n: int, windows: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per window and word: terms of ``n`` letters inside, how many of them the edits take at most, and how many survive."""
    words = len(starts) - 1
    ends = np.searchsorted(starts, starts[:-1] + n)  # a term takes the words before this one
    # An edit at a word takes the terms that begin at it or before and reach it.
    begun = np.searchsorted(ends, np.arange(words), "right")
    taken = np.arange(words) - begun + 1
    inside, lost, need = np.zeros((len(windows), words), np.int32), np.zeros((len(windows), words), np.int32), np.full((len(windows), words), _NONE, np.int32)
    for c, (width, edits) in enumerate(windows):
        if words >= width:
            m = words - width + 1
            inside[c, :m] = np.searchsorted(ends, np.arange(m) + width, "right") - np.arange(m)
            lost[c, :m] = _most_of(taken, width, edits)
            need[c, :m] = inside[c, :m] - lost[c, :m]
    return inside, lost, need


def make_terms(stretches: Sequence[Reading], least: int, most: float, letters: int = LETTERS) -> Terms:
    """Terms of the stretches; where some window might lose nearly all of its terms, shorter ones are taken."""
    windows = edit_windows(least, most)
    sure = max(1, min(words // (edits + 1) for words, edits in windows))
    hashes, at, word, inside, need, sizes, used = [], [], [], [], [], [], []
    before, step = 0, LEAST_STEP
    for r in stretches:
        starts = np.array([*r.starts, len(r.letters)], np.int64)
        longest = int((starts[2 * least :] - starts[: -2 * least]).max(initial=0)) if len(starts) > 2 * least else len(r.letters)
        step = max(step, longest + BAND * windows[-1][1])
        n = letters
        i, _, k = _survivors(starts, n, windows)
        if k.min(initial=_NONE) < AGREEING:
            n = min(letters, sure)
            i, _, k = _survivors(starts, n, windows)
        ok = starts[:-1] + n <= starts[-1]
        m = int(ok.sum())
        # Terms of different lengths are kept apart by their hashes.
        hashes.append(_rolled(r.letters, n)[starts[:-1][ok]] ^ np.uint64(n))
        at.append(starts[:-1][ok])
        word.append(np.arange(m) + before)
        inside.append(i[:, :m])
        need.append(k[:, :m])
        sizes.append(m)
        used.append(n)
        before += len(r.words) + 4 * least
    wide = lambda x: np.concatenate(x, axis=1) if x else np.zeros((len(windows), 0), np.int32)
    flat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    all_hashes, term = np.unique(flat(hashes, np.uint64), return_inverse=True)
    return Terms(all_hashes, sorted(set(used)), term.astype(np.int32), flat(at, np.int32), flat(word, np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), wide(inside), wide(need), step)


def rarest(t: Terms, frequency: np.ndarray, least: int, most: float) -> np.ndarray:
    """Marks the places whose terms are among the rarest of some window: so many that ``AGREEING`` survive, or all that do."""
    chosen = np.zeros(len(t.term), bool)
    for a, b in zip(t.first[:-1], t.first[1:]):
        own = frequency[t.term[a:b]]
        rank = np.argsort(np.argsort(own, kind="stable"), kind="stable").astype(np.int32)
        for c, (width, _) in enumerate(edit_windows(least, most)):
            s = np.flatnonzero(t.need[c, a:b] != _NONE)
            if not len(s):
                continue
            inside, need = t.inside[c, a + s], t.need[c, a + s]
            take = inside - need + np.minimum(need, AGREEING)
            padded = np.concatenate([rank, np.full(width, _NONE, np.int32)])
            ranks = np.lib.stride_tricks.sliding_window_view(padded, width)[s].copy()
            ranks[np.arange(width)[None, :] >= inside[:, None]] = _NONE
            limit = np.sort(ranks, axis=1)[np.arange(len(s)), np.maximum(take - 1, 0)]
            row, col = np.nonzero(ranks <= limit[:, None])
            chosen[a + s[row] + col] = True
    return chosen


def _blocks(texts: Sequence[str]) -> Iterator[tuple[int, list[str]]]:
    block: list[str] = []
    size = begin = 0
    for n, t in enumerate(texts):
        block.append(letters_of(t))
        size += len(block[-1])
        if size > BLOCK_LETTERS:
            yield begin, block
            block, size, begin = [], 0, n + 1
    if block:
        yield begin, block


def postings(letters: Sequence[str], t: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The inverted index of some texts: term, text and place of each occurrence, by term, then text, then place."""
    joined = "".join(letters)
    sizes = np.array([len(x) for x in letters], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    seen = np.zeros(1 << 20, bool)
    seen[t.hashes >> np.uint64(44)] = True
    for n in t.lengths:
        h = _rolled(joined, n) ^ np.uint64(n)
        p = np.flatnonzero(seen[h >> np.uint64(44)])
        k = np.searchsorted(t.hashes, h[p])
        ok = t.hashes[np.minimum(k, len(t.hashes) - 1)] == h[p]
        p, k = p[ok], k[ok]
        text = np.searchsorted(begin, p, "right") - 1
        ok = p + n <= begin[text + 1]
        parts.append((k[ok], p[ok]))
    term, place = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
    order = np.lexsort((place, term))
    term, place = term[order], place[order]
    text = np.searchsorted(begin, place, "right") - 1
    return term.astype(np.int32), text.astype(np.int32), (place - begin[text]).astype(np.int32)


def _spans(low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of ``n`` from ``low`` on: the number of the range of each member, and the member."""
    which = np.repeat(np.arange(len(n)), n)
    return which, low[which] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _parts(step: int, term: np.ndarray, text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each text's first part, and the postings by part: by term, then part."""
    n = int(text.max(initial=-1)) + 1
    last = np.zeros(n, np.int64)
    np.maximum.at(last, text, place)
    many = np.maximum(last // step, 1)  # parts of each text; the last begins a step before the end, or sooner
    base = np.concatenate([[0], np.cumsum(many)])
    own = np.minimum(place // step, many[text] - 1) + base[text]
    two = (place >= step) & (place // step < many[text])
    term, part = np.concatenate([term, term[two]]), np.concatenate([own, own[two] - 1])
    order = np.lexsort((part, term))
    return base, term[order], part[order]


class Query(NamedTuple):
    """The terms, the places of each rare term, and what the steps ask for."""

    terms: Terms
    rare_first: np.ndarray
    rare_places: np.ndarray
    stretch: np.ndarray
    agreeing: np.ndarray
    widest: int


def make_query(t: Terms, frequency: np.ndarray, least: int, most: float) -> Query:
    chosen = np.flatnonzero(rarest(t, frequency, least, most))
    order = np.argsort(t.term[chosen], kind="stable")
    places = chosen[order]
    first = np.searchsorted(t.term[places], np.arange(len(t.hashes) + 1))
    stretch = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))
    need = np.array([t.need[:, a:b].min(initial=_NONE) for a, b in zip(t.first[:-1], t.first[1:])], np.int64)
    return Query(t, first, places, stretch, np.minimum(np.maximum(need, 1), AGREEING), edit_windows(least, most)[-1][0])


def _first_candidates(q: Query, term: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts and stretches such that enough of the stretch's rare terms, close together, stand in the text."""
    own, start = np.unique(term, return_index=True)
    end = np.append(start[1:], len(term))
    which, hit = _spans(start, end - start)
    own_rep = own[which]
    n = q.rare_first[own_rep + 1] - q.rare_first[own_rep]
    which, at = _spans(q.rare_first[own_rep], n)
    place = q.rare_places[at]
    key = np.unique(text[hit[which]].astype(np.int64) << 40 | q.terms.word[place])
    # Words tell the stretch as well: those of different ones are kept apart.
    if not len(key):
        return key, key
    stretch = q.stretch[np.searchsorted(q.terms.word, key & ((1 << 40) - 1))]
    far = np.arange(len(key)) + q.agreeing[stretch] - 1
    ok = far < len(key)
    far = np.minimum(far, len(key) - 1)
    ok &= key[far] - key < q.widest
    pairs = np.unique((key[ok] >> 40) << 32 | stretch[ok])
    return pairs >> 32, pairs & 0xFFFFFFFF


def find_candidates(q: Query, term: np.ndarray, text: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Text, stretch, and bounds of a part of the text, of all parts that may hold a passage of the stretch.

    Texts are looked at in parts of ``2 * step`` letters that overlap by half, so each passage lies in one.
    """
    t = q.terms
    base, term, text = _parts(t.step, term, text, place)
    texts, stretches = _first_candidates(q, term, text)
    order = np.argsort(text, kind="stable")
    term, text = term[order], text[order]
    bounds = np.searchsorted(text, np.arange(int(text.max(initial=-1)) + 2))
    together = max(1, 64_000_000 // max(1, len(t.hashes)))
    out: list[tuple[int, int, int, int]] = []
    for low in range(0, int(texts.max(initial=-1)) + 1, together):
        a, b = np.searchsorted(texts, [low, low + together])
        if a == b:
            continue
        high = min(low + together, len(bounds) - 1)
        present = np.zeros((high - low, len(t.hashes)), bool)
        rows = slice(bounds[low], bounds[high])
        present[text[rows] - low, term[rows]] = True
        for c in range(a, b, 20_000):  # pairs whose places are laid out at once
            tx, st = texts[c : min(b, c + 20_000)], stretches[c : min(b, c + 20_000)]
            n = t.first[st + 1] - t.first[st]
            which, at = _spans(t.first[st], n)
            met = np.concatenate([[0], np.cumsum(present[tx[which] - low, t.term[at]])])
            here = np.arange(len(at))
            good = np.zeros(len(at), bool)
            for inside, need in zip(t.inside, t.need):
                i, k = inside[at], need[at]
                good |= (k != _NONE) & (met[np.minimum(here + i, len(at))] - met[here] >= k)
            for pair in np.unique(which[good]).tolist():
                x, s = int(tx[pair]), int(st[pair])
                k = int(np.searchsorted(base, x, "right")) - 1
                out.append((k, s, (x - int(base[k])) * t.step, (x - int(base[k]) + 2) * t.step))
    return out


def cut_items(items: DataFrame, least: int) -> DataFrame:
    """``item, part, letters, words, starts``: overlapping stretches of the held-out texts, in one of which each passage of less than ``2 * least`` words lies."""
    kind = items.schema["item"].dataType.simpleString()
    length = max(STRETCH, 4 * least)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, part, words = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                own = read(text).words
                for k, a in enumerate(range(0, max(1, len(own) - 2 * least), length - 2 * least)):
                    if len(own[a : a + length]) >= least:
                        at.append(row)
                        part.append(k)
                        words.append(own[a : a + length])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(part, pa.int32()), pa.array(words, pa.list_(pa.string()))], names=["item", "part", "words"])

    return items.mapInArrow(split, f"item {kind}, part int, words array<string>")


def find_leaks(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str = "text", item_text: str = "text", least: int = PASSAGE_WORDS, most: float = CHANGED, letters: int = LETTERS, item_letters: int = ITEM_LETTERS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Pairs ``doc_key, item_key`` such that the document holds a passage of the item.

    A passage has at least ``least`` consecutive words of the item, of which a
    share of ``most`` may be changed, dropped or added. Null and empty texts
    hold nothing; items shorter than ``least`` words are in nothing. Rows of
    the same key are one document: the pair comes once if any of them holds
    the passage. Texts are read whole; other columns are left out. Held-out sets of more than
    ``item_letters`` letters go over the corpus in several turns, each with a part of them.
    """
    docs = docs.select(F.col(doc_key).alias("doc"), F.col(text).alias("doc_text")).where(F.length("doc_text") > 0)
    items = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("item_text")).where(F.length("item_text") > 0)
    parts = cut(cut_items(items, least))
    size = parts.agg(F.sum(F.length(F.array_join("words", "")))).first()[0] or 0
    turns = -(-size // item_letters) or 1
    found = [_one_turn(docs, parts.where(F.pmod(F.xxhash64("item", "part"), F.lit(turns)) == n), doc_key, item_key, least, most, letters, broadcast_rows) for n in range(turns)]
    return reduce(DataFrame.unionByName, found).distinct()


def _one_turn(docs: DataFrame, parts: DataFrame, doc_key: str, item_key: str, least: int, most: float, letters: int, broadcast_rows: int) -> DataFrame:
    spark = docs.sparkSession
    doc_type, item_type = docs.schema["doc"].dataType, parts.schema["item"].dataType
    rows = parts.collect()
    stretches = []
    for r in rows:
        sizes = [len(w) for w in r["words"]]
        stretches.append(Reading("".join(r["words"]), list(r["words"]), [0, *np.cumsum(sizes)[:-1].tolist()]))
    terms = make_terms(stretches, least, most, letters)
    out_schema = f"`{doc_key}` {doc_type.simpleString()}, `{item_key}` {item_type.simpleString()}"
    if not len(terms.hashes):
        return spark.createDataFrame([], out_schema)
    looked_up = spark.sparkContext.broadcast(terms)
    key_kind = to_arrow_type(doc_type)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = looked_up.value
        for batch in batches:
            for begin, block in _blocks(batch.column(1).to_pylist()):
                term, doc, place = postings(block, t)
                kept, doc = np.unique(doc, return_inverse=True)
                keys = batch.column(0).take(pa.array(begin + kept, pa.int64()))
                cells = [pa.array([x], pa.list_(k)) for x, k in ((keys.to_pylist(), key_kind), (term, pa.int32()), (doc.astype(np.int32), pa.int32()), (place, pa.int32()))]
                yield pa.RecordBatch.from_arrays(cells, names=["docs", "term", "doc", "place"])

    stored = cut(spread(docs).mapInArrow(index, f"docs array<{doc_type.simpleString()}>, term array<int>, doc array<int>, place array<int>"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(looked_up.value.hashes), np.int64)
        for batch in batches:
            for row in range(len(batch)):
                term, doc = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in (1, 2))
                n += np.bincount(np.unique(term.astype(np.int64) << 32 | doc) >> 32, minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.int64()), "n": pa.array(n[some], pa.int64())})

    frequency = np.zeros(len(terms.hashes), np.int64)
    for r in stored.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # terms of at most ``item_letters`` letters
        frequency[r["term"]] = r["n"]
    query = spark.sparkContext.broadcast(make_query(terms, frequency, least, most))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                cells = [batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in (1, 2, 3)]
                found = find_candidates(query.value, *cells)
                own = sorted({x for x, *_ in found})
                number = {x: n for n, x in enumerate(own)}
                lists: list[list[dict]] = [[] for _ in own]
                for x, s, lo, hi in found:
                    lists[number[x]].append({"part": s, "lo": lo, "hi": hi})
                keys = batch.column(0)[row].values.take(pa.array(own, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(lists, pa.list_(pa.struct([("part", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64())])))], names=["doc", "found"])

    listed = cut(stored.mapInArrow(search, f"doc {doc_type.simpleString()}, found array<struct<part:int,lo:long,hi:long>>"))
    few = F.broadcast(listed) if at_most(listed, broadcast_rows) else listed
    shared = spark.sparkContext.broadcast([(r["item"], x) for r, x in zip(rows, stretches)])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Held] = {}
        for batch in batches:
            at, found = [], []
            for row, (fs, dt) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                doc = read(dt)
                doc_grams = grams(doc.letters)
                done: set = set()
                for f in fs:
                    item, own = shared.value[f["part"]]
                    if item in done:
                        continue
                    if f["part"] not in held:
                        if len(held) > 20_000:
                            held.clear()
                        held[f["part"]] = hold(own, least, most)
                    if holds_passage(held[f["part"]], doc, f["lo"], f["hi"], least, most, doc_grams):
                        done.add(item)
                        at.append(row)
                        found.append(item)
            keys = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(found, to_arrow_type(item_type))], names=[doc_key, item_key])

    return docs.join(few, "doc").select("doc", "found", "doc_text").mapInArrow(check, out_schema)
