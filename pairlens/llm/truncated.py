"""Texts that stop before their end.

Method: intact values are cut at random places to make positives; a logistic
regression over hashed features of closing characters, punctuation, the last
sentence and the length against the source's limit is fitted on a bounded
sample of them, and scores every record of the table.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread

#: Rows the classifier is fitted on, at most, and its number of weights.
TRAIN_ROWS = 20_000
BITS = 18
SEED = 7
#: Share of cut texts among those it is fitted on: about one in five, so that a score of one half is sure enough.
CUTS_PER_ROW = 0.5
THRESHOLD = 0.5
# Characters that end a sentence, and those that may stand after them.
STOPS = ".!?。！？…"
CLOSERS = "\"')]}»”’`"
_SENTENCE = re.compile(r"(?<=[.!?。！？])[\s\"')\]]+|\n+")
_WORD = re.compile(r"\w+(?:[-'’]\w+)*")


def object_state(text: str) -> tuple[str, int]:
    """State of the first ``{...}`` of a text at its end (none, open, string, closed) and the place after it."""
    at = text.find("{")
    if at < 0:
        return "none", 0
    depth, inside, i, n = 0, False, at, len(text)
    while i < n:
        c = text[i]
        if inside:
            if c == "\\":
                i += 1
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return "closed", i + 1
        i += 1
    return ("string" if inside else "open"), n


def _class(c: str) -> str:
    if c.isdigit():
        return "9"
    if c.isalpha():
        return "A" if c.isupper() else "a"
    return "_" if c.isspace() else c


def features(text: str, limit: int, structured: bool) -> list[int]:
    """Hashed features of a text's end; ``limit`` is the length at which its source cuts."""
    names = ["bias"]
    state, after = object_state(text) if structured else ("none", 0)
    rest = text[after:] if state == "closed" else text
    if structured:
        names += [f"state={state}", f"fence={text.count('```') % 2}:{text.lstrip().startswith('```')}"]
        # An object that isn't JSON may end well all the same, as by its last bracket.
        shown = text.rstrip()
        names.append(f"state={state}:{shown[-1:]}:{'{' in shown}")
        if state != "closed":
            names.append(f"brace={state}:{text.rfind('}') > text.rfind(chr(34) + ':')}")
            names.append(f"bracket={state}:{shown[-1:] == '}'}:{re.sub('[0-9]+', '9', shown[-40:].split(',')[-1])[:40]}")
    if state == "closed":
        tail = re.sub("[0-9]+", "9", rest.strip().lower())
        names += [f"after={tail[-60:]}", f"after?={bool(tail)}"]
        if tail:
            names += [f"after1={tail[-1:]}", f"after4={tail[-4:]}"]
    else:
        last = rest[-3:]
        names += [f"c1={state}:{_class(rest[-1:] or ' ')}", f"c2={state}:{''.join(map(_class, last[-2:]))}", f"c3={state}:{''.join(map(_class, last))}", f"stop={state}:{rest.rstrip().rstrip(CLOSERS)[-1:] in STOPS and bool(rest.strip())}"]
        if state in ("none",):
            body = rest.rstrip().rstrip(CLOSERS)
            stopped = body[-1:] in STOPS and bool(body)
            sentence = _SENTENCE.split(body.rstrip(STOPS).rstrip())[-1][-400:]
            words = [re.sub("[0-9]+", "9", w) for w in _WORD.findall(sentence.lower())]
            w = ["<"] * 4 + words
            kind = "..." if body.endswith(("...", "…")) else "." if stopped else ("_" if rest[-1:].isspace() else "x")
            start = " ".join(w[4:6])
            names.append(f"kind={kind}")
            for k in (1, 2, 3, 4):
                names.append(f"w{k}={kind}:{' '.join(w[-k:])}")
            names += [f"s1={kind}:{start}|{w[-1]}", f"s2={kind}:{start}|{' '.join(w[-2:])}", f"s0={kind}:{' '.join(w[4:5])}|{' '.join(w[-3:])}", f"n={kind}:{min(len(words), 12)}", f"comma={kind}:{start}|{sentence.count(',')}|{w[-1]}"]
    names.append(f"limit={'at' if len(text) == limit else 'near' if len(text) > 0.98 * limit else 'far'}")
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in names]


def looks_intact(text: str, limit: int, structured: bool) -> bool:
    """A first guess, only to choose texts that are worth cutting."""
    if len(text) >= limit:
        return False
    if structured:
        state, after = object_state(text)
        if state == "closed":
            rest = text[after:].strip()
            return not rest or rest[-1] in STOPS + CLOSERS
        if state != "none":
            return False
    body = text.rstrip().rstrip(CLOSERS)
    return body[-1:] in STOPS and bool(body)


def _inside_sentence(text: str, at: int) -> bool:
    body = text[:at].rstrip()
    return bool(body) and body[-1] not in STOPS and text[at:].strip(STOPS + CLOSERS + " \n\r\t") != ""


def _malform(text: str, rng: random.Random) -> str:
    """An object text that is broken somewhere, but not at its end."""
    kind = rng.randrange(5)
    if kind == 0:
        return text.replace('"', "'")
    if kind == 1 and text.rstrip().endswith("}"):
        return text.rstrip()[:-1] + ",}"
    marks = [i for i, c in enumerate(text[: int(len(text) * 0.9)]) if c in ('":,' if kind < 4 else "{")]
    if not marks:
        return text
    i = rng.choice(marks)
    return text[:i] + text[i + 1 :] if kind != 3 else text[:i] + '"' + text[i:]


def examples(rows: Sequence[tuple[str, int]], structured: bool, seed: int = SEED) -> tuple[list[list[int]], list[int]]:
    """Features and labels: intact texts, the same without their final stop, and texts cut inside.

    Chance is drawn for each text by itself, so the same texts give the same examples in any order.
    """
    xs: list[list[int]] = []
    ys: list[int] = []
    for text, limit in rows:
        rng = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")) ^ seed)
        if not looks_intact(text, limit, structured):
            continue
        xs.append(features(text, limit, structured))
        ys.append(0)
        state = object_state(text)[0] if structured else "none"
        if state == "closed" and rng.random() < 0.5:
            broken = _malform(text, rng)
            xs.append(features(broken, limit, structured))
            ys.append(0)
            if rng.random() < 0.5:
                at = rng.randrange(1, max(2, int(len(broken) * 0.95)))
                xs.append(features(broken[:at], limit, structured))
                ys.append(1)
        if state == "none":
            bare = text.rstrip().rstrip(STOPS)
            xs.append(features(bare, limit, structured))
            ys.append(0)
            # Every earlier sentence is an end as well.
            ends = [m.start() for m in _SENTENCE.finditer(text) if m.start() > 1]
            for e in rng.sample(ends, min(2, len(ends))):
                for whole in (text[:e], text[:e].rstrip(STOPS)):
                    xs.append(features(whole, limit, structured))
                    ys.append(0)
        cuts = 3 if state == "none" else 1
        for _ in range(cuts):
            if rng.random() > (0.9 if state == "none" else CUTS_PER_ROW):
                continue
            at = rng.randrange(1, len(text)) if len(text) > 1 else 0
            after = object_state(text)[1] if state == "closed" else 0
            if state == "closed" and after < len(text) and rng.random() < 0.3:
                at = rng.randrange(after, len(text))
                rest = text[at:].strip()
                if not text[after:at].strip() or len(rest) == 0:
                    continue
            elif state == "closed" and at >= after:
                continue
            elif state == "none":
                if rng.random() < 0.3:  # at the end of a word
                    at = max(text.rfind(" ", 0, at), 1)
                if not _inside_sentence(text, at):
                    continue
            part = text[:at] + (rng.choice(("...", " ...", "…")) if rng.random() < 0.1 else "")
            xs.append(features(part, len(part) if rng.random() < 0.5 else limit, structured))
            ys.append(1)
    return xs, ys


def fit(flat: np.ndarray, first: np.ndarray, ys: np.ndarray, epochs: int = 8, rate: float = 0.3, ridge: float = 1e-6, seed: int = SEED, batch: int = 32) -> np.ndarray:
    """Weights of a logistic regression, by adaptive gradient steps over small batches.

    ``flat`` has the features of all examples, ``first`` the bounds of each; every example has a feature.
    """
    w, g = np.zeros(1 << BITS), np.full(1 << BITS, 1e-2)
    order = np.arange(len(ys))
    rng = np.random.default_rng(seed)
    sizes = np.diff(first)
    for _ in range(epochs):
        rng.shuffle(order)
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            n = sizes[own]
            ends = np.cumsum(n)
            x = flat[np.repeat(first[own] - ends + n, n) + np.arange(int(ends[-1]))]
            p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[x], ends - n), -30, 30)))
            d = np.repeat(p - ys[own], n) + ridge * w[x]
            np.add.at(g, x, d * d)
            np.subtract.at(w, x, rate * d / np.sqrt(g[x]))
    return w


def fit_lists(xs: Sequence[Sequence[int]], ys: Sequence[float], **options: float) -> np.ndarray:
    """``fit`` for lists of features."""
    first = np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int64)
    return fit(np.fromiter((i for x in xs for i in x), np.int64, int(first[-1])), first, np.asarray(ys, float), **options)


def probabilities(w: np.ndarray, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    if len(first) < 2:
        return np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[flat], first[:-1]).astype(np.float64), -30, 30)))


def in_share(share: float, *keys: str) -> Column:
    """Whether the hash of the keys lies in the lowest ``share`` of all 64-bit values, however small that is."""
    if share >= 1:
        return F.lit(True)
    return F.xxhash64(*keys) < F.lit(int(share * 2.0**64) - 2**63)


def score_truncation(df: DataFrame, key: str, text: str, source: str, structured: bool, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``key, source, n_chars, p_cut, truncated`` of every row whose text is neither null nor blank.

    ``structured``: the texts hold a JSON object with text around it. A null
    source is a source of its own. Equal rows get equal scores; other columns
    are left out. Where no text looks intact there is nothing to learn from, and nothing is called truncated.
    Texts are read whole. At most ``train_rows`` rows, spread over the whole table by
    a hash of the key, are used for fitting; limits come from all rows.
    """
    base = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source"))).where(F.col("text").isNotNull() & (F.trim("text") != ""))
    by_length = base.groupBy("source", F.length("text").alias("chars")).agg(F.count("*").alias("n"))
    longest = F.max_by("n", "chars")
    # A greatest length that a single text or two have is no limit.
    limits = cut(by_length.groupBy("source").agg((F.max("chars") + F.when(longest >= 3, 0).otherwise(1 << 30)).alias("most"), F.sum("n").alias("n")))
    with_limit = base.join(limits, base["source"].eqNullSafe(limits["source"])).drop(limits["source"])
    total = limits.agg(F.sum("n")).first()[0] or 0
    sample = with_limit.where(in_share(0.98 * train_rows / max(1, total), "key")).select(F.xxhash64("key", "text").alias("h"), "text", "most").limit(train_rows)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, xs, ys = [], [], []
            for h, t, m in zip(*(batch.column(c).to_pylist() for c in range(3))):
                x, y = examples([(t, m)], structured)
                hs += [h] * (len(x) or 1)
                xs += x or [[]]  # a text that isn't intact counts as seen
                ys += y or [0]
            yield pa.RecordBatch.from_pydict({"h": pa.array(hs, pa.int64()), "x": pa.array(xs, pa.list_(pa.int32())), "y": pa.array(ys, pa.int8())})

    cores = df.sparkSession.sparkContext.defaultParallelism
    known = sample.repartition(cores).mapInArrow(learn, "h long, x array<int>, y byte").toArrow().combine_chunks()  # at most ``train_rows`` texts
    if total and not len(known):
        raise RuntimeError("no row was sampled for fitting")
    known = known.filter(pc.greater(pc.list_value_length(known["x"]), 0)).combine_chunks()
    ys = known["y"].to_numpy().astype(float)
    if not ys.any():
        return base.select(F.col("key").alias(key), F.col("source").alias("source"), F.length("text").alias("n_chars"), F.lit(0.0).alias("p_cut"), F.lit(False).alias("truncated"))
    order = np.argsort(known["h"].to_numpy(), kind="stable")
    sizes = pc.list_value_length(known["x"]).to_numpy().astype(np.int64)
    flat = pc.list_flatten(known["x"]).to_numpy().astype(np.int64)
    first = np.cumsum(sizes) - sizes
    n = sizes[order]
    ends = np.cumsum(n)
    flat = flat[np.repeat(first[order] - ends + n, n) + np.arange(int(ends[-1]))]
    weights = df.sparkSession.sparkContext.broadcast(fit(flat, np.concatenate([[0], ends]), ys[order]).astype(np.float32))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            xs = [features(t, m, structured) for t, m in zip(texts, batch.column(3).to_pylist())]
            ends = np.cumsum([0, *map(len, xs)])
            p = probabilities(weights.value, np.fromiter((i for x in xs for i in x), np.int64, int(ends[-1])), ends)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(t) for t in texts], pa.int32()), pa.array(p), pa.array(p >= THRESHOLD)], names=[key, "source", "n_chars", "p_cut", "truncated"])

    kinds = [base.schema[c].dataType.simpleString() for c in ("key", "source")]
    return with_limit.select("key", "source", "text", "most").mapInArrow(score, f"`{key}` {kinds[0]}, source {kinds[1]}, n_chars int, p_cut double, truncated boolean")


def truncation_report(scored: DataFrame) -> DataFrame:
    """Per source: ``source, n_texts, n_truncated, share``."""
    n = F.count("*")
    cut = F.count_if("truncated")
    return scored.groupBy("source").agg(n.alias("n_texts"), cut.alias("n_truncated"), F.round(cut / n, 4).alias("share"))
