"""Cutting oversized texts into pieces at natural boundaries.

Method: content-defined chunking. A rolling hash over the last words sets
landmarks; a cut goes to the natural boundary nearest to the first landmark
between the smallest and the largest size. As landmarks depend on a few words
only, an edit changes the pieces around it and leaves those further on alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from ..session import spread
from .tokens import BYTE_BPE, TOKENIZER_DIR, BlockEncoder, split_words, vocabulary

MAX_TOKENS = 2048
MIN_TOKENS = 512
OVERLAP = 64
LANDMARK_EVERY = 256
_WINDOW = 6
_ROLL = np.uint64(0x9E3779B97F4A7C15)
# Characters that end a sentence, and those that may follow them within it.
_STOPS = frozenset(".!?。！？…")
_CLOSERS = frozenset("\"')]}»”’」』）")
#: An indivisible run of letters longer than this many characters is cut between characters.
_RUN = 256


class Piece(NamedTuple):
    no: int
    start: int
    end: int
    tokens: int
    overlap: int


def _strength(before: str, after: str) -> int:
    """How natural a cut between two words of a text is: 3 paragraph, 2 line or sentence, 1 word, 0 none."""
    if before.isspace() and "\n" in before:
        return 3 if before.count("\n") > 1 else 2
    ends = before.rstrip("".join(_CLOSERS))
    if after[:1].isspace() or (ends and ends[-1] in "。！？"):
        return 2 if ends and ends[-1] in _STOPS else 1
    return 1 if before.isspace() else 0


def _landmarks(units: list[str], every: int) -> np.ndarray:
    h = np.array([xxhash.xxh64_intdigest(u.encode("utf-8", "surrogatepass")) for u in units], np.uint64)
    rolled = np.zeros(len(h), np.uint64)
    for _ in range(_WINDOW):
        rolled = rolled * _ROLL + h
        h = np.concatenate([[np.uint64(0)], h[:-1]])
    return (rolled >> np.uint64(20)) % np.uint64(every) == 0


def cut_text(text: str, coder: BlockEncoder, most: int = MAX_TOKENS, least: int = MIN_TOKENS, overlap: int = OVERLAP, every: int = LANDMARK_EVERY) -> list[Piece]:
    """Pieces of one text: each of at most ``most`` tokens, with up to ``overlap`` tokens of the piece before.

    Words are never divided, unless one alone is too long for a piece. The
    overlap is the largest number of whole words within ``overlap`` tokens
    (none where the last word before the cut is longer). A text within the limit, an empty one
    included, is one piece. Without the overlaps the pieces give the text.
    """
    units = []
    for w in split_words(text):
        units += [w] if len(w) <= _RUN else [w[i : i + _RUN] for i in range(0, len(w), _RUN)]
    divided = any(len(u) == _RUN for u in units)
    of = coder.lookup([units])
    sizes = np.array([len(of[u]) for u in units], np.int64)
    whole = int(sizes.sum())
    if divided:
        words = split_words(text)
        of_words = coder.lookup([words])
        whole = sum(len(of_words[w]) for w in words)
    if whole <= most:
        return [Piece(0, 0, len(text), whole, 0)]
    ends = np.cumsum(sizes)
    chars = np.concatenate([[0], np.cumsum([len(u) for u in units])])
    strength = np.array([_strength(a, b) for a, b in zip(units, units[1:])] + [4], np.int8)
    marks = np.flatnonzero(_landmarks(units, every))
    total, n = int(ends[-1]), len(units)
    pieces: list[Piece] = []
    start = 0  # first unit of the piece without its overlap
    while start < n:
        done = int(ends[start - 1]) if start else 0
        first = start
        while pieces and first > start - 4096 and first > 0 and done - (int(ends[first - 2]) if first > 1 else 0) <= overlap:
            first -= 1
        base = int(ends[first - 1]) if first else 0
        if total - base <= most:
            stop = n
        else:
            lo = int(np.searchsorted(ends, done + least))  # a cut after unit i has i in lo..hi
            hi = int(np.searchsorted(ends, base + most, "right")) - 1
            lo, hi = min(lo, hi), max(hi, start)
            lo = max(lo, start)
            stop = _choose(strength, marks, lo, hi) + 1
        piece = Piece(len(pieces), int(chars[first]), int(chars[stop]), int(ends[stop - 1]) - base, int(chars[start] - chars[first]))
        if divided or units[stop - 1].isspace():  # white space at an end is cut into words differently
            stop, piece = _recount(text, coder, units, chars, most, first, start, stop, len(pieces))
        pieces.append(piece)
        start = stop
    return pieces


def _choose(strength: np.ndarray, marks: np.ndarray, lo: int, hi: int) -> int:
    window = strength[lo : hi + 1]
    natural = np.flatnonzero(window >= min(2, int(window.max()))) + lo
    k = int(np.searchsorted(marks, lo))
    if k < len(marks) and marks[k] <= hi:
        return int(natural[np.argmin(np.abs(natural - marks[k]))])
    return int(natural[-1])


def _recount(text: str, coder: BlockEncoder, units: list[str], chars: np.ndarray, most: int, first: int, start: int, stop: int, no: int) -> tuple[int, Piece]:
    """Parts of a divided word may join to other tokens: the piece is counted as it stands, and shortened till it fits."""
    while True:
        words = split_words(text[chars[first] : chars[stop]])
        of = coder.lookup([words])
        size = sum(len(of[w]) for w in words)
        if size <= most or stop <= start + 1:
            if size > most:
                first = start  # without its overlap one unit always fits
                words = split_words(text[chars[first] : chars[stop]])
                size = sum(map(len, coder.vocab.replay(words)))
            return stop, Piece(no, int(chars[first]), int(chars[stop]), size, int(chars[start] - chars[first]))
        stop -= 1


def cut_corpus(
    df: DataFrame, key: str, text: str = "text", most: int = MAX_TOKENS, least: int = MIN_TOKENS, overlap: int = OVERLAP, every: int = LANDMARK_EVERY, folder: str = TOKENIZER_DIR, name: str = BYTE_BPE
) -> DataFrame:
    """Pieces of every text: ``key, piece_no, n_pieces, start_pos, end_pos, overlap_chars, n_tokens, piece``.

    Positions count code points. A null text has no piece, an empty one has one empty
    piece. Rows are cut one by one, so equal rows give equal pieces; other columns are left out.
    """
    if not 0 <= overlap < least <= most - overlap or most < 4 * _RUN:
        raise ValueError("sizes must satisfy 0 <= overlap < least <= most - overlap, and most be 1024 or more")
    kind = df.schema[key].dataType.simpleString()
    vocab = df.sparkSession.sparkContext.broadcast(vocabulary(folder, name))  # of fixed size

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = BlockEncoder(vocab.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            rows: list[tuple] = []
            at: list[int] = []
            for i, t in enumerate(texts):
                if t is None:
                    continue
                # A token has one byte at least, so a text of so few bytes is within the limit; it is counted all the same.
                pieces = cut_text(t, coder, most, least, overlap, every)
                rows += [(p.no, len(pieces), p.start, p.end, p.overlap, p.tokens, t[p.start : p.end]) for p in pieces]
                at += [i] * len(pieces)
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=[key, "piece_no", "n_pieces", "start_pos", "end_pos", "overlap_chars", "n_tokens", "piece"])

    schema = f"`{key}` {kind}, piece_no int, n_pieces int, start_pos int, end_pos int, overlap_chars int, n_tokens int, piece string"
    return spread(df.select(key, text)).mapInArrow(cut, schema)
