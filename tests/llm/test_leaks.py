import random

import pytest

from pairlens.llm import leaks

RNG = random.Random(11)
VOCAB = ["".join(RNG.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(RNG.randrange(2, 9))) for _ in range(400)]
COMMON = VOCAB[:40]


def text(rng, n):
    return [rng.choice(VOCAB if rng.random() < 0.6 else COMMON) for _ in range(n)]


def holds(item, doc):
    i, d = leaks.read(item), leaks.read(doc)
    return leaks.holds_passage(leaks.hold(i), d, 0, len(d.letters))


def hide(rng, words):
    """The same words with other case, punctuation, markup and broken lines."""
    out = []
    for w in words:
        w = w.upper() if rng.random() < 0.3 else w
        w = f"<b>{w}</b>" if rng.random() < 0.2 else w
        out.append(w + rng.choice(["", "", ",", ".", " -"]))
    s = rng.choice([" ", "  ", "\n"]).join(out)
    return "\n".join(s[k : k + 60] for k in range(0, len(s), 60)) if "<" not in s and rng.random() < 0.5 else s


def edited(rng, words, edits):
    """So many words changed, dropped or added, none of them at the ends."""
    out = [[w] for w in words]
    for k in rng.sample(range(1, len(words) - 1), edits):
        out[k] = rng.choice([[], ["qq" * rng.randrange(1, 5)], [words[k], "zz" * rng.randrange(1, 5)]])
    return [w for x in out for w in x]


@pytest.mark.parametrize("seed", range(25))
def test_passages_and_shorter_quotes(seed):
    rng = random.Random(seed)
    item = text(rng, 120)
    around = lambda: [w + w[::-1] + "0" for w in text(rng, 60)]  # noqa: E731 - no word of the item, so no chance match prolongs a quote
    a = rng.randrange(0, 80)
    assert holds(" ".join(item), " ".join([*around(), hide(rng, item[a : a + 28]), *around()]))
    assert not holds(" ".join(item), " ".join([*around(), hide(rng, item[a : a + 26]), *around()]))
    changed = item[a : a + 40]
    for k in (8, 19, 31):
        changed[k] = "qqqqq"
    assert holds(" ".join(item), " ".join([*around(), *changed, *around()]))
    less = item[a : a + 40]
    del less[22], less[9]
    assert holds(" ".join(item), " ".join([*around(), *less, *around()]))
    more = [*item[a : a + 14], "zzz", *item[a + 14 : a + 30], "yyy", *item[a + 30 : a + 40]]
    assert holds(" ".join(item), " ".join([*around(), *more, *around()]))
    broken = list(item[a : a + 36])
    for k in range(0, 36, 5):
        broken[k] = "qqqqqq"
    assert not holds(" ".join(item), " ".join([*around(), *broken, *around()]))
    assert not holds(" ".join(item), " ".join(text(rng, 200)))


@pytest.mark.parametrize("copies", [2, 41, 150])
def test_many_copies_of_a_changed_passage(copies):
    rng = random.Random(3)
    item = text(rng, 60)
    passage = item[10:40]
    passage[15] = "qqqqq"
    assert holds(" ".join(item), " ".join([*passage, "0"] * copies))


@pytest.mark.parametrize("seed", range(40))
def test_edits_anywhere_between_the_ends(seed):
    """As many edits as a passage may have, next to its ends as well; one more, and it is none."""
    rng = random.Random(seed)
    item = [w + str(k) for k, w in enumerate(text(rng, 100))]
    n = rng.choice([28, 29, 30, 35, 40, 52, 75])
    a = rng.randrange(0, 100 - n + 1)
    around = [w + "q" for w in text(rng, 40)]
    assert holds(" ".join(item), " ".join([*around, *edited(rng, item[a : a + n], n // 10), *around]))
    few = [k for k in range(3, 27, 6)]
    spoilt = ["qq" if k in few else w for k, w in enumerate(item[a : a + 28])]
    assert not holds(" ".join(item), " ".join([*around, *spoilt, *around]))


@pytest.mark.parametrize(("item_letters", "rows"), [(leaks.ITEM_LETTERS, leaks.BROADCAST_ROWS), (2000, 0)])
def test_find_leaks(spark, item_letters, rows):
    rng = random.Random(5)
    items = [(i, " ".join(text(rng, 90))) for i in range(12)] + [(50, "too short"), (51, None), (52, "")]
    docs, want = [], set()
    for d in range(80):
        words = text(rng, rng.choice([20, 200, 900]))
        if d % 3 == 0:
            i = rng.randrange(12)
            a = rng.randrange(0, 50)
            cut = rng.choice([12, 24, 30, 38])
            passage = hide(rng, items[i][1].split()[a : a + cut])
            words.insert(len(words) // 2, passage)
            if cut >= 28:
                want.add((d, i))
        docs.append((d, " ".join(words), "clash"))
    docs += [(d, t, c) for d, t, c in docs[:6]] + [(900, None, "x"), (901, "", "x"), (902, " ", "x")]
    dd = spark.createDataFrame(docs, "doc_id int, text string, item string")
    ii = spark.createDataFrame(items, "item_id int, text string")
    assert {tuple(r) for r in leaks.find_leaks(dd, ii, "doc_id", "item_id", item_letters=item_letters, broadcast_rows=rows).collect()} == want
    assert leaks.find_leaks(dd.limit(0), ii, "doc_id", "item_id").collect() == []
    assert leaks.find_leaks(dd, ii.limit(0), "doc_id", "item_id").collect() == []


@pytest.mark.parametrize("short", [False, True])
@pytest.mark.parametrize("seed", range(4))
def test_no_passage_is_lost_before_the_alignment(seed, short):
    """All that the alignment finds in all pairs is among the candidates, for texts of very short words as well."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") if short else rng.choice(VOCAB)
    items = [leaks.read(" ".join(word() for _ in range(rng.choice([30, 90, 140])))) for _ in range(8)]
    docs = []
    for _ in range(60):
        own = rng.choice(items).words
        n = rng.randrange(28, min(60, len(own)) + 1)
        a = rng.randrange(0, len(own) - n + 1)
        docs.append(leaks.letters_of(" ".join([*(word() for _ in range(rng.choice([0, 40, 300]))), *edited(rng, own[a : a + n], n // 10), *(word() for _ in range(30))])))
    t = leaks.make_terms(items, 28, 0.1)
    term, text, place = leaks.postings(docs, t)
    frequency = leaks.np.bincount(leaks.np.unique(term.astype("int64") << 32 | text) >> 32, minlength=len(t.hashes))
    found = {(x, s) for x, s, _, _ in leaks.find_candidates(leaks.make_query(t, frequency, 28, 0.1), term, text, place)}
    for x, d in enumerate(docs):
        for s, item in enumerate(items):
            assert (x, s) in found or not leaks.holds_passage(leaks.hold(item), leaks.Reading(d, [d], [0]), 0, len(d)), (x, s)
    assert len(found) >= 60


@pytest.mark.parametrize("n", [0, 100, 400])
@pytest.mark.parametrize("words", [2, 6])
def test_fragments_around_a_changed_passage(spark, n, words):
    """A passage with three words changed, among many fragments of the same item."""
    rng = random.Random(n + words)
    item = text(rng, 150)
    passage = item[60:94]
    for k in (9, 17, 26):
        passage[k] = "qqqqqq"
    fragments = [[*item[(a := rng.randrange(0, 140)) : a + words], "0"] for _ in range(n)]
    body = [w for f in fragments[: n // 2] for w in f] + passage + [w for f in fragments[n // 2 :] for w in f]
    docs = spark.createDataFrame([(1, " ".join(body))], "doc_id int, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id int, text string")
    assert [tuple(r) for r in leaks.find_leaks(docs, items, "doc_id", "item_id").collect()] == [(1, 7)]


def test_a_book_is_handled_in_stretches(spark):
    rng = random.Random(8)
    book = text(rng, 5000)
    docs = spark.createDataFrame([(k, " ".join(book[a : a + 28])) for k, a in enumerate(range(0, 4900, 97))], "doc_id int, text string")
    items = spark.createDataFrame([(7, " ".join(book))], "item_id int, text string")
    assert len(leaks.find_leaks(docs, items, "doc_id", "item_id").collect()) == docs.count()
