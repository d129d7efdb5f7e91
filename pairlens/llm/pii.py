"""Personal information in free text, found and replaced by typed placeholders.

Method: weak supervision. Labelers by shape (regular expressions), by gazetteer
(names the corpus itself gives after titles and labels) and by context vote on
candidate spans; expectation-maximisation estimates how reliable each labeler
is, and the resulting probabilities train a logistic regression over hashed
span features, which decides every candidate.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Container, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import at_most, cut, spread
from .truncated import fit_lists, in_share, probabilities

TYPES = ("email", "phone", "identity", "address", "name")
#: Candidates the classifier is fitted on, and words broadcast of the corpus's names and of its vocabulary, at most; further words are joined to their texts.
TRAIN_SPANS = 30_000
LEXICON_WORDS = 200_000
BITS = 18
THRESHOLD = 0.5

_L = r"[^\W\d_]"
_CAP = r"[A-ZÀ-ÖØ-ÞŁŚŽČ]"
_EMAIL = re.compile(r"(?<![\w.+-])[\w.+%-]+ ?(?:@|[\[(] ?at ?[\])]) ?[\w-]+(?:\.[\w-]+| ?[\[(] ?dot ?[\])] ?[\w-]+)+", re.I)
_AT = re.compile(r"[\[(] ?at ?[\])]", re.I)
_DIGIT = re.compile(r"\d")  # no address or number is without
# How telephone and identity numbers are written.
_PHONES = (
    r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){1,4}",
    r"\(\d{2,5}\)[ .-]?\d{3,4}[ .-]?\d{3,5}",
    r"00\d{1,3} \d{2,4} \d{5,8}",
    r"0\d{2,4}[ /-]\d{3,4}(?: \d{2}){1,2}",
    r"0\d{2,4}/\d{5,8}",
    r"\d{3}\.\d{3}\.\d{4}",
)
_IDENTITIES = (r"[A-Z]{2} \d{2} \d{2} \d{2} [A-Z]", r"[A-Z]{1,3}\d{5,9}(?:-\d{2})?", r"[A-Z]{1,2}/\d{5,8}", r"\d{3}-\d{2}-\d{4}", r"\d{6}-\d{4}", r"\d{4}-\d{4}")
_EITHER = (r"\d{3}[ -]\d{3}[ -]\d{4}", r"\d{3}-\d{4}", r"\d{7,11}", r"\d{1,4}(?:[-./ ]\d{2,6}){1,4}")
_NUMBER = re.compile(r"(?<![\w+/.-])(?:" + "|".join(f"(?P<p{i}>{p})" for i, p in enumerate(_PHONES)) + "|" + "|".join(f"(?P<i{i}>{p})" for i, p in enumerate(_IDENTITIES)) + "|" + "|".join(f"(?P<e{i}>{p})" for i, p in enumerate(_EITHER)) + r")(?![\w]|[-/]\d)", re.I)
# Words of streets.
_STREET = "street|st|road|rd|lane|ln|drive|dr|avenue|ave|boulevard|blvd|court|ct|close|way|place|pl|terrace|crescent|square|row|walk|gardens|grove|hill|mews|parade"
_PLACE = rf"(?-i:{_CAP}[a-zß-öø-ÿ]+(?: {_CAP}[a-zß-öø-ÿ]+)?)"
_TOWN = rf"(?:, (?:\d{{4,5}} )?{_PLACE})?"
_ADDRESSES = (
    rf"(?:(?:flat|apt|apartment|unit|suite)\.? \d{{1,4}}{_L}?, )?\d{{1,4}}{_L}? (?:{_L}+[ -]){{1,3}}?(?:{_STREET})\b\.?(?: (?:apt|flat|unit)\.? \d{{1,4}}{_L}?\b)?",
    rf"{_L}+(?:stra(?:ß|ss)e|str\.|gasse|weg|platz|allee|ufer|ring|damm|markt|hof)\.? \d{{1,4}}{_L}?\b(?:, \d{{5}} {_PLACE})?",
    rf"(?-i:Am|Im|An der|Auf dem|Zum|Zur) {_L}+ \d{{1,4}}{_L}?\b(?:, \d{{5}} {_PLACE})?",
    rf"(?:\d{{1,4}},? )?(?:calle|avenida|av\.|plaza|paseo|camino|rua|travessa|praça|rue|avenue|boulevard|allée|chemin|impasse|via|viale|corso)(?: (?:de la|de los|de las|del|de|da|do|dos|das|des|du|la|le|les|los))? {_L}+(?: {_L}+)??,? \d{{1,4}}\b",
    rf"\d{{1,4}},? (?:bis )?(?:rue|avenue|boulevard|allée|chemin|impasse|place)(?: (?:de la|de|des|du|la|le|les))? {_L}+",
)
_ADDRESS = re.compile(r"(?<!\w)(?:" + "|".join(f"(?:{a})" for a in _ADDRESSES) + r")", re.I)
_TOWN_AFTER = re.compile(_TOWN)
_WORD = re.compile(rf"{_L}+(?:['’](?!s\b){_L}+)?")
_PART = rf"{_CAP}{_L}*(?:['’](?!s\b){_CAP}?{_L}+)?(?:-{_CAP}{_L}+)*"
_CAPITALS = re.compile(rf"(?<!\w)(?:{_CAP}\.(?= ?{_CAP})|{_PART})(?:(?:, | | (?:van|von|de|del|da|di) )(?:{_CAP}\.(?= ?{_CAP})|{_PART}))*")
_TOKEN = re.compile(rf"{_CAP}\.|{_PART}")
_LOWER = re.compile(rf"(?<!\w)(?=({_L}+) ({_L}+(?:-{_L}+)?))")
#: Names written small, where something announces them.
_TOLD = re.compile(rf"(?:\bpt |\bw/ |(?<= )/ )([a-zß-öø-ÿ]{{3,}}) ([a-zß-öø-ÿ]{{3,}}(?:-{_L}+)?)(?= w/|,|\n|$| [A-Z]|\.)")
# Words that stand before or after what they announce.
TITLES = frozenset("patient pt name dr mr mrs ms miss prof professor doctor nurse sister daughter son husband wife mother father brother partner kin carer radiographer radiologist resident consultant registrar colleague phoned told under by from with spouse uncle aunt neighbour".split())
STRONG = frozenset("kin patient name dr mr mrs ms miss prof nurse daughter son husband wife mother father brother".split())
PHONE_CUES = frozenset("tel telephone phone phoned call ring mobile cell fax bleep pager callback back reached contact office on at or".split())
IDENTITY_CUES = frozenset("id mrn record no number passport national insurance security wristband read hosp nhs ssn patient-id identity licence nr social".split())
OTHER_CUES = frozenset("protocol index product serial study dated date detector dose exposure accession series version bed bay measured of model lot batch software".split())
NOT_STREETS = frozenset("mm cm ml kg mg hours days weeks months years ago after before for and or by with is was the view views film patient left right rib nodule".split())
ADDRESS_CUES = frozenset("at of to from address in lives moved visit near".split())
THINGS = frozenset("lines line catheter sign signs tube tubes stent criteria score classification syndrome disease view views technique method position projection node nodes nodule fracture clip clips device filter valve index law test scale grade type point points body bodies cells cell ring pump drain procedure shunt prosthesis plate nail pattern angle space".split())
AFTER_NAME = ("was examined", "gave the", "has known", "'s office", "’s office", " reports", ", id ", ", seen", " seen for", ", now", " now corrected", " of ", " on ", " at ", " w/", ", bleep", ", record", ", mrn", " and ", " has ", " was ", ", dob")
#: Capital words that begin lines and labels and are no part of a name.
LABELS = TITLES | IDENTITY_CUES | OTHER_CUES | frozenset("findings impression history comparison technique the a an her his their next address moved fell lives home brought collect copy earlier second ward line discussed insurance findings exam examination report ct mri pa ap us".split())


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    votes: str
    features: list[int]


class Lexicon(NamedTuple):
    """What the corpus says about words: those seen as names, and those seen as ordinary words."""

    names: Container[str]
    ordinary: Container[str]


class _Either(NamedTuple):
    """The broadcast words and those joined to one text."""

    shared: frozenset[str]
    own: frozenset[str]

    def __contains__(self, word: str) -> bool:
        return word in self.shared or word in self.own


EMPTY = Lexicon(frozenset(), frozenset())


def _words_before(text: str, at: int, n: int = 3) -> list[str]:
    return [w.strip("-").lower() for w in re.findall(r"[\w-]*\w", text[max(0, at - 40) : at])[-n:]]


def _words_after(text: str, at: int, n: int = 2) -> list[str]:
    return [w.lower() for w in re.findall(r"[\w/-]+", text[at : at + 40])[:n]]


def _shape(s: str) -> str:
    return re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", re.sub(r"[A-Z]", "A", s)))[:24]


def _hash(names: list[str]) -> list[int]:
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in names]


def _features(kind: str, text: str, start: int, end: int, before: list[str], after: list[str], extra: list[str]) -> list[int]:
    b, a = (["<"] * 3 + before)[-3:], (after + [">", ">"])[:2]
    near = text[max(0, start - 2) : start] or "<"
    own = [f"b1={b[2]}", f"b2={b[1]} {b[2]}", f"b3={b[0]}", f"a1={a[0]}", f"a2={a[0]} {a[1]}", f"l={near}", f"r={text[end:end + 2]}", "bias", *extra]
    return _hash([f"{kind}|{x}" for x in own])


def sentence_start(text: str, at: int) -> bool:
    """Whether a capital at this place may be due to the place alone."""
    left = text[max(0, at - 8) : at].rstrip(" \t")
    if not left or left[-1] in "\n\r:!?":
        return True
    if left[-1] != ".":
        return False
    word = re.search(rf"({_L}+)\.$", left)
    return not (word and len(word[1]) <= 4 and word[1].lower() in TITLES or word and len(word[1]) == 1)


def _cue(words: list[str], cues: frozenset[str]) -> bool:
    return any(w in cues or w.rstrip("-") in cues for w in words)


def _namelike(token: str, lex: Lexicon) -> bool:
    low = token.lower()
    if low in lex.names:
        return True
    return all(p not in lex.ordinary and p not in LABELS for p in low.split("-"))


def candidates(text: str, lex: Lexicon) -> list[Span]:
    """Spans that may be personal information, each with the labelers' votes (1, 0 or - per labeler)."""
    spans: list[Span] = []
    taken: list[tuple[int, int]] = []
    free = lambda s, e: all(e <= a or s >= b for a, b in taken)
    digits_in = _DIGIT.search(text) is not None
    for m in _EMAIL.finditer(text) if "@" in text or _AT.search(text) else ():
        b, a = _words_before(text, m.start()), _words_after(text, m.end())
        tail = m[0].lower().split(".")[-1]
        votes = f"1{'1' if '@' in m[0] or 'at' in m[0].lower() else '-'}{'1' if _cue(b, frozenset({'contact', 'to', 'cc', 'e-mail', 'email', 'mail'})) else '-'}-"
        spans.append(Span("email", m.start(), m.end(), votes, _features("email", text, m.start(), m.end(), b, a, [f"tail={tail[-8:]}", f"at={'@' in m[0]}"])))
        taken.append((m.start(), m.end()))
    for m in _ADDRESS.finditer(text) if digits_in else ():
        if not free(m.start(), m.end()):
            continue
        b, a = _words_before(text, m.start()), _words_after(text, m.end())
        words = [w.lower() for w in _WORD.findall(m[0])]
        plain = [w for w in words if w in NOT_STREETS]
        town = _TOWN_AFTER.match(text, m.end())
        end = town.end() if town else m.end()
        votes = f"{'1' if m[0][:1].isdigit() or m[0][-1:].isdigit() else '-'}{'0' if plain else '1'}{'1' if _cue(b[-1:], ADDRESS_CUES) or b[-2:] == ['on', 'file'] else '0' if _cue(b[-1:], OTHER_CUES) else '-'}{'1' if town and town[0] else '-'}"
        spans.append(Span("address", m.start(), end, votes, _features("address", text, m.start(), end, b, a, [f"w={w}" for w in words] + [f"plain={len(plain)}", f"s={_shape(m[0])}"])))
        taken.append((m.start(), end))
    for m in _NUMBER.finditer(text) if digits_in else ():
        if not free(m.start(), m.end()):
            continue
        if m.start() and text[m.start() - 1] in "," and text[m.start() - 2 : m.start() - 1].isdigit():
            continue
        b, a = _words_before(text, m.start()), _words_after(text, m.end())
        taken.append((m.start(), m.end()))
        group = m.lastgroup or "e0"
        digits = sum(c.isdigit() for c in m[0])
        left = [w for w in b if not w.isdigit()][-2:]
        cue = "p" if _cue(left[-1:], PHONE_CUES) else "i" if _cue(left[-1:], IDENTITY_CUES) else "o" if _cue(left, OTHER_CUES) else "i" if _cue(left, IDENTITY_CUES) else "p" if _cue(left, PHONE_CUES) else "-"
        if cue == "p" and left and left[-1] in ("at", "on", "of") and _cue(left, IDENTITY_CUES):
            cue = "i"
        extra = [f"g={group}", f"d={digits}", f"s={_shape(m[0])}", f"cue={cue}", f"g={group}&cue={cue}", f"b={left[-1] if left else ''}&g={group}"]
        for kind, own in (("phone", "p"), ("identity", "i")):
            shape = "1" if group[0] == own else "-" if group[0] == "e" else "0"
            context = "-" if cue == "-" else "1" if cue == own else "0"
            size = "0" if digits < (7 if own == "p" else 6) or digits > 15 else "-"
            after = "1" if own == "p" and a[:1] in (["ask"], ["once"]) else "1" if own == "i" and a[:1] in (["shown"], ["checked"], ["when"], ["on"]) else "-"
            spans.append(Span(kind, m.start(), m.end(), shape + size + context + after, _features(kind, text, m.start(), m.end(), b, a, extra)))
    seen: set[int] = set()
    for m in _CAPITALS.finditer(text):
        run: list[re.Match] = []
        for t in [*_TOKEN.finditer(text, m.start(), m.end()), None]:
            good = t is not None and free(t.start(), t.end()) and (len(t[0]) == 2 and t[0][1] == "." or _namelike(t[0], lex))
            if t is not None and not good and free(t.start(), t.end()) and t[0].lower() not in LABELS:
                # An ordinary word may be a surname: after a title, or beside a name.
                titled = _cue(_words_before(text, t.start(), 1), STRONG) and not sentence_start(text, t.start())
                good = titled or bool(run) and text[run[-1].end() : t.start()] in (" ", ", ") and not sentence_start(text, t.start()) and (run[-1][0].lower() in lex.names or len(run[-1][0]) == 2)
            if good and (not run or text[run[-1].end() : t.start()] in (" ", ", ", " van ", " von ", " de ", " del ", " da ", " di ")) and sum(text[x.end() : y.start()] == ", " for x, y in zip([*run, t], [*run, t][1:])) <= 1:
                run.append(t)
                continue
            if run:
                spans += _name(text, run[0].start(), run[-1].end(), lex)
                seen.add(run[0].start())
            run = [t] if good else []
    for m in _LOWER.finditer(text):
        s, first = m.start(), m[1]
        told = text[max(0, s - 3) : s] in ("pt ", "w/ ") or text[max(0, s - 2) : s] == "/ "
        named = first.lower() in lex.names
        if not (told or named) or first[0].isupper() or s in seen or not free(s, e := m.end(2)):
            continue
        known = named and m[2].lower().split("-")[0] in lex.names
        if known or told and (m[1] in lex.names or m[1] not in lex.ordinary and m[2].split("-")[0] not in lex.ordinary):
            spans += _name(text, s, e, lex, told)
    return spans


def _name(text: str, start: int, end: int, lex: Lexicon, told: bool = False) -> list[Span]:
    b, a = _words_before(text, start), _words_after(text, end)
    own = text[start:end]
    tokens = [t for t in re.findall(rf"{_L}+", own)]
    known = sum(t.lower() in lex.names for t in tokens)
    plain = sum(t.lower() in lex.ordinary for t in tokens)
    right = text[end : end + 16].lower()
    gazetteer = "1" if known == len([t for t in tokens if len(t) > 1]) and known else "0" if plain and not known else "-"
    title = told or b[-1:] and b[-1] in TITLES or b[-2:] == ["ask", "for"] or b[-1:] == ["and"] and (text[: max(0, start - 5)].split() or ["-"])[-1][:1].isupper()
    ends = any(right.startswith(x) or right.startswith(" " + x) for x in AFTER_NAME)
    thing = a[:1] and a[0] in THINGS
    shape = "1" if len(tokens) > 1 and "," in own or re.match(rf"{_CAP}\. ", own) or len(tokens) > 1 and known else "-"
    votes = gazetteer + ("1" if title else "0" if b[-1:] and b[-1] in OTHER_CUES else "-") + ("0" if thing else "1" if ends else "-") + shape
    form = "".join("I" if len(t) == 1 else "U" if t.isupper() else "C" if t[0].isupper() else "l" for t in tokens)
    extra = [f"f={form}", f"n={len(tokens)}", f"known={known}/{len(tokens)}", f"plain={plain}", f"thing={bool(thing)}", f"title={bool(title)}", f"ends={ends}", f"g={gazetteer}&t={bool(title)}&x={bool(thing)}", *[f"suffix={t[-3:].lower()}" for t in tokens]]
    return [Span("name", start, end, votes, _features("name", text, start, end, b, a, extra))]


def estimate(votes: dict[tuple[str, str], float], rounds: int = 30) -> dict[tuple[str, str], float]:
    """Probability that a candidate is a case, by kind and votes: expectation-maximisation over the labelers' reliabilities.

    A labeler's vote of 1, 0 or none is taken as drawn, apart from the others,
    from its own distribution for cases and for others. Pseudo-counts of a tenth of the
    candidates hold to it that a vote speaks for what it says, whichever share of them are cases.
    """
    out: dict[tuple[str, str], float] = {}
    for kind in {k for k, _ in votes}:
        own = {v: n for (k, v), n in votes.items() if k == kind}
        # The first guess: more votes for than against.
        p = {v: min(0.95, max(0.05, 0.5 + 0.25 * (v.count("1") - 1.5 * v.count("0")))) for v in own}
        for _ in range(rounds):
            total = sum(own.values())
            prior = (sum(n * p[v] for v, n in own.items()) + 1) / (total + 2)
            table = []
            for j in range(len(next(iter(own)))):
                held = 1.0 + 0.1 * total
                yes, no = Counter({"1": 0.55 * held, "0": 0.02 * held, "-": 0.43 * held}), Counter({"1": 0.05 * held, "0": 0.5 * held, "-": 0.45 * held})
                for v, n in own.items():
                    yes[v[j]] += n * p[v]
                    no[v[j]] += n * (1 - p[v])
                sy, sn = sum(yes.values()), sum(no.values())
                table.append({c: np.log(yes[c] / sy) - np.log(no[c] / sn) for c in "10-"})
            for v in own:
                z = np.log(prior / (1 - prior)) + sum(table[j][c] for j, c in enumerate(v))
                p[v] = float(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        out |= {(kind, v): x for v, x in p.items()}
    return out


def looked_up(text: str) -> set[str]:
    """All words that ``candidates`` may look for in the lexicon: runs of letters, alone and two by two around an apostrophe."""
    runs = list(re.finditer(rf"{_L}+", text))
    pairs = (text[a.start() : b.end()] for a, b in zip(runs, runs[1:]) if text[a.end() : b.start()] in ("'", "’"))
    return {w.lower() for w in (*(m[0] for m in runs), *pairs)}


def learn_lexicon(df: DataFrame, text: str, limit: int = LEXICON_WORDS) -> tuple[Lexicon, DataFrame | None]:
    """Names after strong titles, and words that are ordinary as they mostly come in lower case.

    The ``limit`` most frequent ones of each, and ``word, named`` of all, if there are more.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, list[int]] = {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                t = _EMAIL.sub(" ", t)  # small letters in an address say nothing about a word
                for m in _WORD.finditer(t):
                    own = n.setdefault(m[0].lower(), [0, 0, 0])
                    if m[0][0].islower():
                        own[0] += 1
                    elif not sentence_start(t, m.start()):
                        own[1] += 1
                for m in _TOLD.finditer(t):
                    for w in (m[1].lower(), *m[2].lower().split("-")):
                        own = n.setdefault(w, [0, 0, 0])
                        own[0] -= 1
                        own[2] += 1
                for m in re.finditer(rf"\b(?:Patient name:|Dr\.?|Mrs?\.?|Ms\.?|Prof\.?|ask for|requested by|filed under|[Nn]urse|[Dd]aughter|[Ss]on|[Hh]usband|[Ww]ife|Patient) ((?:{_CAP}\. )?{_PART}(?:(?:,? )(?:{_CAP}\. )?{_PART})?)", t):
                    for w in re.findall(rf"{_L}{{2,}}", m[1]):
                        if w.lower() not in LABELS:
                            n.setdefault(w.lower(), [0, 0, 0])[2] += 1
        rows = list(n.items())
        yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in rows], pa.string()), **{c: pa.array([v[i] for _, v in rows], pa.int64()) for i, c in enumerate(("lower", "upper", "titled"))}})

    sums = [F.sum(c).alias(c) for c in ("lower", "upper", "titled")]
    counted = cut(df.where(F.col(text).isNotNull()).select(text).mapInArrow(count, "word string, lower long, upper long, titled long").groupBy("word").agg(*sums))
    named = F.expr("titled >= 1 and lower <= titled")
    words = counted.withColumn("named", named).where("named or lower >= 2 and lower > 2 * upper")
    names, ordinary = words.where("named"), words.where("not named")
    whole = at_most(names, limit) and at_most(ordinary, limit)
    head = [frozenset(r["word"] for r in x.orderBy(F.desc(c), "word").limit(limit).collect()) for x, c in ((names, "titled"), (ordinary, "lower"))]
    return Lexicon(*head), None if whole else words.select("word", "named")


def _with_own_words(rows: DataFrame, lex: Broadcast, words: DataFrame) -> DataFrame:
    """Adds ``_own``: the words of each text that are in ``words`` but not in the broadcast lexicon."""
    rows = cut(rows.withColumn("_id", F.monotonically_increasing_id()))

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, w) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in looked_up(t) if w not in lex.value.names and w not in lex.value.ordinary]
            yield pa.RecordBatch.from_pydict({"_id": pa.array([i for i, _ in found], pa.int64()), "word": pa.array([w for _, w in found], pa.string())})

    met = rows.select("_id", "_text").mapInArrow(further, "_id long, word string").join(words, "word")
    own = met.groupBy("_id").agg(F.collect_list(F.struct("word", "named")).alias("_own"))
    return rows.join(own, "_id", "left").drop("_id")


def _lexicon_of(lex: Lexicon, own: list[dict] | None) -> Lexicon:
    if not own:
        return lex
    return Lexicon(*[_Either(shared, frozenset(w["word"] for w in own if w["named"] == named)) for shared, named in ((lex.names, True), (lex.ordinary, False))])


def find_personal(df: DataFrame, keys: list[str], text: str, train_spans: int = TRAIN_SPANS, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """Occurrences of personal information: ``keys, pii_type, start_pos, end_pos, p``.

    Positions count code points from 0. Where spans overlap the more probable
    one is kept, then the longer. Null and empty texts hold none; equal rows give equal
    occurrences. Texts are read whole. The classifier is fitted on at most
    ``train_spans`` candidates spread over all rows by a hash; labeler counts cover all of them.
    ``lexicon_words`` bounds what is broadcast, not what is known.
    """
    spark = df.sparkSession
    rows = spread(df.select(*keys, F.col(text).alias("_text")).where(F.length("_text") > 0))
    head, words = learn_lexicon(rows, "_text", lexicon_words)
    lex = spark.sparkContext.broadcast(head)
    n = len(keys)
    texts = rows.withColumn("_own", F.lit(None).cast("array<struct<word:string,named:boolean>>")) if words is None else _with_own_words(rows, lex, words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, (t, own) in enumerate(zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist())):
                for s in candidates(t, _lexicon_of(lex.value, own)):
                    at.append(i)
                    found.append(s)
            left = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(n)]
            own = [pa.array([s.kind for s in found], pa.string()), pa.array([s.start for s in found], pa.int32()), pa.array([s.end for s in found], pa.int32()), pa.array([s.votes for s in found], pa.string()), pa.array([s.features for s in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*left, *own], names=[*keys, "pii_type", "start_pos", "end_pos", "votes", "features"])

    key_ddl = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    spans = cut(texts.mapInArrow(scan, f"{key_ddl}, pii_type string, start_pos int, end_pos int, votes string, features array<int>"))
    counted = {(r["pii_type"], r["votes"]): float(r["n"]) for r in spans.groupBy("pii_type", "votes").agg(F.count("*").alias("n")).collect()}  # at most 5 * 3**4 rows
    belief = estimate(counted)
    share = 0.98 * train_spans / max(1.0, sum(counted.values()))
    chosen = spans.where(in_share(share, *keys, "start_pos")).select(F.xxhash64(*keys, "start_pos", "pii_type").alias("h"), "pii_type", "votes", "features").limit(train_spans).collect()
    if counted and not chosen:
        raise RuntimeError("no span was sampled for fitting")
    sample = sorted(chosen, key=lambda r: r["h"])
    weights = spark.sparkContext.broadcast(fit_lists([r["features"] for r in sample], [belief[(r["pii_type"], r["votes"])] for r in sample]).astype(np.float32))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(n + 4)
            first = own.offsets.to_numpy()
            p = probabilities(weights.value, own.values.to_numpy()[first[0] : first[-1]], first - first[0])
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n + 4)], pa.array(p)], names=[*keys, "pii_type", "start_pos", "end_pos", "votes", "p"])

    scored = spans.mapInArrow(score, f"{key_ddl}, pii_type string, start_pos int, end_pos int, votes string, p double").where(F.col("p") >= THRESHOLD)
    # Only numbers get two candidates, phone and identity, for one and the same span.
    best = scored.groupBy(*keys, "start_pos").agg(F.max_by(F.struct("pii_type", "end_pos", "votes", "p"), F.struct("p", "end_pos", "pii_type")).alias("b"))
    return best.select(*keys, "b.pii_type", "start_pos", "b.end_pos", "b.votes", "b.p")


def mask(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with every span replaced by its type in brackets; all else stays as it is."""
    if text is None:
        return None
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
    return "".join([*out, text[at:]])


def mask_personal(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, text`` with all personal information replaced; rows without any, nulls included, stay as they are.

    Rows with equal keys are taken for redeliveries of one text.
    """
    found = find_personal(df, keys, text).groupBy(*keys).agg(F.collect_set(F.struct("start_pos", "end_pos", "pii_type")).alias("_spans"))
    n = len(keys)
    joined = df.select(*keys, text).join(found, keys, "left")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [mask(t, [(s["start_pos"], s["end_pos"], s["pii_type"]) for s in spans or ()]) for t, spans in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n)], pa.array(texts, pa.string())], names=[*keys, text])

    return joined.mapInArrow(replace, df.select(*keys, text).schema)
