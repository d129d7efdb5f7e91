import random
import re

import pytest

from pairlens.llm import pii, truncated

FIRST = ["Jas", "Kes", "Oru", "Wen", "Tal", "Bry"]
LAST = ["mere", "holt", "stad", "quist", "gard", "beck"]


def corpus(n=240, seed=3):
    """Texts with planted spans: ``(text, [(type, start)])``."""
    rng = random.Random(seed)
    name = lambda: f"{rng.choice(FIRST)}{rng.choice(['vel', 'rana', 'lodo'])} {rng.choice(['Fal', 'Hol', 'Ost'])}{rng.choice(LAST)}"
    frames = [
        ("Patient name: {}, record {}.", [("name", name), ("identity", lambda: f"000-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}")]),
        ("Discussed with Dr. {} on {}.", [("name", lambda: name().split()[1]), ("phone", lambda: f"({rng.randrange(200, 999)}) 555-0{rng.randrange(100, 199)}")]),
        ("Moved to {}, phone {}.", [("address", lambda: f"{rng.randrange(1, 200)} Nettle {rng.choice(['Drive', 'Street', 'Lane'])}"), ("phone", lambda: f"+999 22 555 {rng.randrange(1000, 9999)}")]),
        ("Copy of this text to {}.", [("email", lambda: f"{name().split()[0].lower()}{rng.choice(['@', ' (at) '])}clinic.example.org")]),
    ]
    plain = ["The trachea is midline.", "Heart size is normal.", "A 12 mm nodule lies in the left lung.", "Study of 12-03-2024 was reviewed.", "Reported under protocol 4-112-2024.", "A Brannick catheter is in place.", "MRN withheld."]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randrange(1, 5)):
            if rng.random() < 0.5:
                text += rng.choice(plain) + " "
                continue
            frame, makers = rng.choice(frames)
            parts = frame.split("{}")
            for part, (kind, make) in zip(parts, makers):
                text += part
                spans.append((kind, len(text)))
                text += make()
            text += parts[-1] + " "
        out.append((text.strip(), spans))
    return out


def test_planted_spans_are_found(spark):
    rows = corpus()
    data = [(i, t, "x") for i, (t, _) in enumerate(rows)] + [(9001, None, "x"), (9002, "", "x"), (9003, " ", "x")]
    d = spark.createDataFrame(data, "id int, text string, pii_type string")
    got = {(r["id"], r["pii_type"], r["start_pos"]) for r in pii.find_personal(d, ["id"], "text").collect()}
    want = {(i, k, s) for i, (_, spans) in enumerate(rows) for k, s in spans}
    assert len(got & want) / len(want) > 0.97 and len(got & want) / len(got) > 0.97
    masked = {r["id"]: r["text"] for r in pii.mask_personal(d, ["id"], "text").collect()}
    assert len(masked) == len(data) and masked[9001] is None and masked[9002] == "" and masked[9003] == " "
    i = next(i for i, (_, s) in enumerate(rows) if not s)
    assert masked[i] == rows[i][0]


def test_words_beyond_the_broadcast_count_too(spark):
    texts = [t for t, _ in corpus(120)] + ["Report given to nurse Sean O'Brien-Hale.", "seen by sean hale today", "jasvel falmere and orurana osthbeck came, wenlodo holgard too"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "id int, text string")
    # The fit, and so p, depends on the order of rows; the votes on the lexicon.
    found = lambda **x: sorted(tuple(r)[:-1] for r in pii.find_personal(d, ["id"], "text", **x).collect())
    want = found()
    assert want and found(lexicon_words=3) == want


class Asked:
    def __init__(self, answer):
        self.answer, self.words = answer, set()

    def __contains__(self, word):
        self.words.add(word)
        return self.answer


@pytest.mark.parametrize("names", [True, False])
@pytest.mark.parametrize("ordinary", [True, False])
def test_all_words_asked_for_are_looked_up(names, ordinary):
    odd = ["Dr. O'Brien-Hale, J. McDonald's and D’Arcy van Berg_x 3Tesla", "pt anna-maria o'neil w/ élan vital, Straße Größe-Weiß", "It's Smith's A'B'C'D e.g. ann lee-jones."]
    for t in [*odd, *(t for t, _ in corpus(60))]:
        lex = pii.Lexicon(Asked(names), Asked(ordinary))
        pii.candidates(t, lex)
        words = {w for w in lex.names.words | lex.ordinary.words if w == w.lower() and re.fullmatch(r"[^\W\d_]+(?:['’][^\W\d_]+)?", w)}
        assert words and words <= pii.looked_up(t) or not words


def test_empty_table(spark):
    d = spark.createDataFrame([], "id int, text string")
    assert pii.find_personal(d, ["id"], "text").collect() == [] and pii.mask_personal(d, ["id"], "text").collect() == []


def test_mask_keeps_the_rest():
    assert pii.mask("Call 555 now, Ann.", [(5, 8, "phone"), (14, 17, "name")]) == "Call [PHONE] now, [NAME]."
    assert pii.mask(None, []) is None and pii.mask("", []) == ""


def test_reliabilities_follow_the_votes():
    p = pii.estimate({("name", "11-"): 50.0, ("name", "00-"): 30.0, ("name", "1--"): 10.0, ("name", "0--"): 8.0})
    assert p[("name", "11-")] > 0.9 > 0.5 > p[("name", "0--")] > p[("name", "00-")]


SENTENCES = ["The trachea is midline with no {}.", "There is mild {} in the left upper zone.", "Apart from trace {}, the lungs are clear.", "No displaced fracture of the {} is seen.", "The left lower lobe shows moderate {}, unchanged since the earlier film."]
WORDS = ["fluid", "opacity", "scarring", "haze", "lucency", "volume loss"]


def text(rng):
    return " ".join(rng.choice(SENTENCES).format(rng.choice(WORDS)) for _ in range(rng.randrange(2, 7)))


def test_held_out_cuts(spark):
    rng = random.Random(6)
    rows, want = [], set()
    for i in range(700):
        t = text(rng)
        if i % 10 == 0:
            at = rng.randrange(5, len(t) - 12)
            while t[:at].rstrip()[-1:] == "." or t[at : at + 1] == ".":
                at -= 1
            t = t[:at]
            want.add(i)
        elif i % 10 == 1:
            t = t.rstrip(".")
        rows.append((i, t, rng.choice(["a", None]), 0.5))
    rows += [(9000, None, "a", 1.0), (9001, "", "a", 1.0), (9002, "  ", "a", 1.0)]
    d = spark.createDataFrame(rows, "id int, text string, source string, p_cut double")
    scored = truncated.score_truncation(d, "id", "text", "source", False)
    got = {r["id"] for r in scored.where("truncated").collect()}
    assert len(got & want) / len(want) > 0.93 and len(got & want) / max(1, len(got)) > 0.93
    report = {r["source"]: r for r in truncated.truncation_report(scored).collect()}
    assert set(report) == {"a", None} and sum(r["n_texts"] for r in report.values()) == 700
    assert truncated.score_truncation(d.limit(0), "id", "text", "source", True).collect() == []


def test_object_states():
    assert [truncated.object_state(t)[0] for t in ("no", '{"a": 1', '{"a": "x', '{"a": "}"} end', "")] == ["none", "open", "string", "closed", "none"]


def test_samples_of_a_hundred_thousand_million_rows_are_not_empty(spark):
    """A share far below a millionth still takes its part of the hashes, and no share takes more than its own."""
    share = 0.98 * truncated.TRAIN_ROWS / 1e11
    text = truncated.in_share(share, "id")._jc.toString()
    limit = int(share * 2.0**64) - 2**63
    assert str(limit) in text and limit > -(2**63)
    d = spark.range(200_000)
    assert 80 < d.where(truncated.in_share(1e-3, "id")).count() < 400
    assert d.where(truncated.in_share(1.5, "id")).count() == 200_000


def test_an_empty_sample_raises(spark, monkeypatch):
    monkeypatch.setattr(truncated, "in_share", lambda *a: truncated.F.lit(False))
    d = spark.createDataFrame([(1, "A whole sentence.", "s")], "id int, t string, source string")
    with pytest.raises(RuntimeError):
        truncated.score_truncation(d, "id", "t", "source", False)
