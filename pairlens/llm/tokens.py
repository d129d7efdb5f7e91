"""Encoding of a corpus with a public byte-level BPE vocabulary.

Method: corpus-level merge replay. The distinct words of many texts are laid
out as one chain of symbols with an inverted index from symbol pair to
positions; merges are taken in rank order over the whole chain, and each
touches only the neighbours of the places where it applies. The work is in
proportion to the symbols of the distinct words (times the log of the number
of pairs), also for words of very many letters.

The corpus's most frequent words are replayed once, together, and their ids
are broadcast: at most ``HEAD_WORDS`` words of at most ``HEAD_BYTES`` bytes. Each block
of texts replays its remaining distinct words in the same way, so that no
text is ever shuffled.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread

#: Where the vocabulary files lie; a parameter of every function here.
TOKENIZER_DIR = os.environ.get("PAIRLENS_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's published pattern for cutting texts into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
HEAD_WORDS = 100_000
HEAD_BYTES = 64
_SHIFT = 32


class Vocabulary:
    """Ids of tokens; the id of a token is the rank of the merge that makes it."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = {i: t for t, i in self.ids.items()}
        self.first = [self.ids[bytes([b])] for b in range(256)]
        self._pairs: dict[int, int] = {}

    def merged(self, pair: int) -> int:
        """Id of the token made from a packed pair of ids, or -1."""
        t = self._pairs.get(pair)
        if t is None:
            joined = self.bytes[pair >> _SHIFT] + self.bytes[pair & 0xFFFFFFFF]
            t = self._pairs[pair] = self.ids.get(joined, -1)
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
        return t

    def replay(self, words: Sequence[str]) -> list[list[int]]:
        """Ids of each of the words, by replaying all merges over all of them."""
        symbol: list[int] = []
        starts: list[int] = []
        first = self.first
        for w in words:
            starts.append(len(symbol))
            symbol.extend([first[b] for b in w.encode("utf-8", "surrogatepass")])
            symbol.append(-1)  # no pair goes over the end of a word
        n = len(symbol)
        right = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        where: dict[int, list[int]] = {}
        for i in range(n - 1):
            a, b = symbol[i], symbol[i + 1]
            if a >= 0 and b >= 0:
                where.setdefault(a << _SHIFT | b, []).append(i)
        merged = self.merged
        queue = [(t, p) for p in where if (t := merged(p)) >= 0]
        heapq.heapify(queue)
        while queue:
            token, pair = heapq.heappop(queue)
            a, b = pair >> _SHIFT, pair & 0xFFFFFFFF
            places = where.pop(pair, ())
            if a == b:
                places = sorted(set(places))  # of overlapping places the leftmost goes first
            for i in places:
                if symbol[i] != a:
                    continue
                j = right[i]
                if j >= n or symbol[j] != b:
                    continue
                symbol[i], symbol[j] = token, -2
                k = right[j]
                right[i] = k
                if k < n:
                    left[k] = i
                    if symbol[k] >= 0:
                        p = token << _SHIFT | symbol[k]
                        if p in where:
                            where[p].append(i)
                        else:
                            where[p] = [i]
                            if (t := merged(p)) >= 0:
                                heapq.heappush(queue, (t, p))
                h = left[i]
                if h >= 0 and symbol[h] >= 0:
                    p = symbol[h] << _SHIFT | token
                    if p in where:
                        where[p].append(h)
                    else:
                        where[p] = [h]
                        if (t := merged(p)) >= 0:
                            heapq.heappush(queue, (t, p))
        out = []
        for s in starts:
            ids = []
            while symbol[s] >= 0:
                ids.append(symbol[s])
                s = right[s]
            out.append(ids)
        return out


_VOCABULARIES: dict[str, Vocabulary] = {}
_SPLIT = regex.compile(WORDS)


def vocabulary(folder: str = TOKENIZER_DIR, name: str = BYTE_BPE) -> Vocabulary:
    """The vocabulary, read once per worker."""
    path = os.path.join(folder, name)
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def split_words(text: str) -> list[str]:
    return _SPLIT.findall(text)


class BlockEncoder:
    """Encodes blocks of texts; remembers words of recent blocks, up to a bound."""

    def __init__(self, vocab: Vocabulary, head: dict[str, Sequence[int]] | None = None, remember: int = 200_000):
        self.vocab, self.head, self.remember = vocab, head or {}, remember
        self.recent: dict[str, Sequence[int]] = {}

    def lookup(self, texts: Sequence[Sequence[str]]) -> dict[str, Sequence[int]]:
        """Ids of all words of a block of cut texts."""
        words = set().union(*texts) if texts else set()
        head, recent = self.head, self.recent
        new = [w for w in words if w not in head and w not in recent]
        if len(recent) + len(new) > self.remember:
            recent.clear()
            new = [w for w in words if w not in head]
        recent.update(zip(new, self.vocab.replay(new)))
        return {w: head[w] if w in head else recent[w] for w in words}


def _blocks(texts: Sequence[str | None], chars: int = 2_000_000) -> Iterator[list[str]]:
    """The texts in order, in blocks of about so many characters."""
    block: list[str] = []
    size = 0
    for t in texts:
        block.append(t or "")
        size += len(block[-1])
        if size > chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def frequent_words(df: DataFrame, text: str, limit: int = HEAD_WORDS) -> DataFrame:
    """The ``limit`` most frequent words of a corpus that stand in it twice or more: ``word, n``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64())})

        for batch in batches:
            for t in batch.column(0).to_pylist():
                for w in split_words(t or ""):
                    n[w] = n.get(w, 0) + 1
                if len(n) > 500_000:
                    yield out()
                    n.clear()
        yield out()

    counted = spread(df.select(text)).mapInArrow(count, "word string, n long").where(F.octet_length("word") <= HEAD_BYTES)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(limit)


def encode_corpus(df: DataFrame, text: str = "text", ids: str = "ids", folder: str = TOKENIZER_DIR, name: str = BYTE_BPE, head_words: int = HEAD_WORDS) -> DataFrame:
    """Adds ``ids``, the token ids of each text without special tokens.

    A null or empty text gets an empty list. Nothing is a special token: their
    strings are ordinary text. Equal rows stay, other columns pass through; a
    column already named ``ids`` is replaced. Very long texts are encoded whole.
    """
    spark = df.sparkSession
    rows = frequent_words(df, text, head_words).collect() if head_words else []
    vocab = vocabulary(folder, name)
    words = [r["word"] for r in rows]
    # The vocabulary goes to the workers, of fixed size; its file is needed on the driver only.
    shared = spark.sparkContext.broadcast((vocab, dict(zip(words, (np.array(x, np.int32) for x in vocab.replay(words))))))
    kept = [c for c in df.columns if c != ids]
    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    index = kept.index(text)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = BlockEncoder(*shared.value)
        for batch in batches:
            at = 0
            for block in _blocks(batch.column(index).to_pylist()):
                offsets, flat = _joined([split_words(t) for t in block], coder)
                own = batch.slice(at, len(block))
                at += len(block)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[*kept, ids])

    return spread(df.select(*kept)).mapInArrow(encode, schema)


def _joined(texts: list[list[str]], coder: BlockEncoder) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and ids of texts given as words; ids of a word are laid out once and taken from there."""
    of = coder.lookup(texts)
    number = {w: i for i, w in enumerate(of)}
    sizes = np.fromiter((len(x) for x in of.values()), np.int64, len(of))
    ids = np.concatenate([np.asarray(x, np.int32) for x in of.values()]) if of else np.zeros(0, np.int32)
    words = np.fromiter((number[w] for ws in texts for w in ws), np.int64)
    n = sizes[words]
    ends = np.cumsum(n)
    first = (np.cumsum(sizes) - sizes)[words]
    flat = ids[np.repeat(first - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]
    bounds = np.concatenate([[0], np.cumsum([len(ws) for ws in texts])]).astype(np.int64)
    return np.concatenate([[0], ends])[bounds].astype(np.int32), flat
