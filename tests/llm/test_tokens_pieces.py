import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pairlens.llm import pieces, tokens

VOCAB = tokens.vocabulary()
ENC = tiktoken.Encoding("own", pat_str=tokens.WORDS, mergeable_ranks=VOCAB.ids, special_tokens={})
CODER = tokens.BlockEncoder(VOCAB)


def ids(text):
    words = tokens.split_words(text)
    of = CODER.lookup([words])
    return [i for w in words for i in of[w]]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=80))
def test_ids_equal_the_library(text):
    assert ids(text) == ENC.encode_ordinary(text)


@pytest.mark.parametrize("text", ["", " ", "a" * 20_000, "\n" * 500 + "x", "東京都" * 2000, "<|endoftext|> it's we'LL", "aaaaaaab" * 50, "\x1c \x85　​"])
def test_ids_of_odd_texts(text):
    assert ids(text) == ENC.encode_ordinary(text)


def test_corpus(spark):
    rows = [(1, "the cat sat on the mat", "k"), (2, None, "k"), (3, "", "k"), (4, "the cat sat on the mat", "k"), (5, "xyzzyplugh", None)]
    d = spark.createDataFrame(rows, "doc_id int, text string, ids string")
    for head in (0, 3, tokens.HEAD_WORDS):
        got = {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(d, head_words=head).collect()}
        assert got == {i: ENC.encode_ordinary(t or "") for i, t, _ in rows}
    assert tokens.encode_corpus(d.limit(0)).collect() == []


def sentence(rng):
    return " ".join(rng.choice(["lung", "heart", "nodule", "left", "right", "effusion", "stable", "seen"]) for _ in range(rng.randrange(4, 14))).capitalize() + "."


def check(text, most=2048):
    ps = pieces.cut_text(text, CODER)
    assert "".join(text[p.start + p.overlap : p.end] for p in ps) == text
    assert [p.start for p in ps[1:]] == [q.end - p.overlap for p, q in zip(ps[1:], ps)]
    for p in ps:
        assert p.tokens == len(ENC.encode_ordinary(text[p.start : p.end])) <= most
    assert (len(ps) > 1) == (len(ENC.encode_ordinary(text)) > most)
    return ps


def test_pieces_of_long_texts():
    rng = random.Random(1)
    text = "\n\n".join(" ".join(sentence(rng) for _ in range(20)) for _ in range(60))
    ps = check(text)
    assert len(ps) > 3 and all(text[p.end - 1] in ".\n" for p in ps)
    assert all(0 < len(ENC.encode_ordinary(text[p.start : p.start + p.overlap])) <= pieces.OVERLAP for p in ps[1:])
    edited = text[:300] + " one more word" + text[300:]
    own = {text[p.start + p.overlap : p.end] for p in ps}
    other = {edited[p.start + p.overlap : p.end] for p in check(edited)}
    assert len(own & other) >= len(own) - 2


@pytest.mark.parametrize("text", ["", "short", "a" * 30_000, "ab " * 4000, " " * 9000, "肺" * 6000, "x\n" * 5000, "\t\tq" * 3000])
def test_pieces_of_odd_texts(text):
    check(text)


def test_cut_corpus(spark):
    long = "word " * 3000
    d = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, long, 7), (3, long, 7), (4, "a b", 7)], "doc_id int, text string, piece int")
    got = pieces.cut_corpus(d, "doc_id").collect()
    assert {r["doc_id"] for r in got} == {2, 3, 4} and [r["piece"] for r in got if r["doc_id"] == 2] == [""]
    assert len({(r["piece_no"], r["start_pos"]) for r in got if r["doc_id"] == 3}) * 2 == len([r for r in got if r["doc_id"] == 3])
    with pytest.raises(ValueError):
        pieces.cut_corpus(d, "doc_id", overlap=600)
