import random

import pytest
from hypothesis import given, settings, strategies as st

from sumire.llm import repetition as rp


def brute(text, k=20):
    s = [c for c in text if not (c.isspace() or c.isdecimal())]
    seen, covered = set(), [False] * len(s)
    for i in range(len(s) - k + 1):
        w = tuple(s[i : i + k])
        if w in seen:
            covered[i : i + k] = [True] * k
        seen.add(w)
    return len(s), sum(covered)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("ab1 \n", max_size=120), max_size=6), st.integers(1, 25))
def test_counts_equal_brute_force(texts, k):
    kept, repeated = rp.repeated_counts(texts, k)
    assert [(int(a), int(b)) for a, b in zip(kept, repeated)] == [brute(t, k) for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abc1 \n", max_size=160), max_size=6))
def test_the_screen_never_falls_below_the_share(texts):
    kept, repeated = rp.repeated_counts(texts)
    again, screened = rp.screened_counts(texts)
    assert (kept == again).all() and (screened >= repeated).all() and (screened <= kept).all()


def test_texts_do_not_meet():
    part = "".join(random.Random(1).choices("abcdefghij", k=60))
    kept, repeated = rp.repeated_counts([part, part, part + "12 \n" + part, "𠮟" * 50])
    assert repeated.tolist() == [0, 0, 60, brute("𠮟" * 50)[1]]


def test_bounds():
    assert rp.upper_bound(0, 0, 0.05) == 1.0 and rp.upper_bound(5, 5, 0.05) == 1.0
    assert rp.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-6)
    assert rp.upper_bound(1, 10, 0.05) == pytest.approx(0.394163, abs=1e-4)


def test_calibration_limits_false_rejection(spark):
    rng = random.Random(3)
    rows = [("a", rng.random() * 0.2, True) for _ in range(3000)] + [("a", 0.5 + rng.random() / 2, False) for _ in range(300)] + [("b", 0.9, True), ("b", 0.95, False)]
    df = spark.createDataFrame(rows, "stratum string, score double, good boolean")
    found = dict(rp.calibrate(df, [0.1, 0.2, 0.3, 0.6], alpha=0.01, delta=0.05))
    assert found == {"a": 0.2}


def test_holdout_is_bounded(spark):
    df = spark.range(20000).selectExpr("id", "if(id % 3 = 0, 'hot', 'cold') as stratum")
    got = {r.stratum: r["count"] for r in rp.holdout(df, 50).groupBy("stratum").count().collect()}
    assert got == {"hot": 50, "cold": 50}


def test_operator(spark):
    phrase = "この文は何度も繰り返されている文章なのである、"
    filler = "".join(random.Random(4).choices("春夏秋冬山川草木花鳥風月東西南北", k=400))
    rows = [(1, phrase * 10, "ja"), (2, filler, "ja"), (3, None, "ja"), (4, "", None), (5, "12 34 " * 50, "en"), (6, filler + phrase * 3, None), (7, phrase * 10, None), (8, "a" * 300_000, "en"), (9, phrase, "ja")]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, id string, share double")
    shares = {r.id: r.share for r in rp.repetition_shares(df).collect()}
    assert len(shares) == 9 and shares[3] == shares[4] == shares[5] == 0.0
    for i, t, _ in rows:
        if t and len(t) < 1000:
            n, r = brute(t)
            assert shares[i] == pytest.approx(r / n if n else 0.0)
    assert sorted(r.id for r in rp.repeated_documents(df).collect()) == sorted(i for i, s in shares.items() if s >= 0.3) == [1, 7, 8]


def test_the_cutoff_decides(spark):
    rng = random.Random(5)
    phrase = "この文は何度も繰り返されている文章なのである、"
    letters = [chr(c) for c in range(0x4E00, 0x5E00)]
    good = [(i, "".join(rng.choices(letters, k=60)), "ja") for i in range(2400)]
    bad = [(5000 + i, "".join(rng.choices(letters, k=30)) + phrase * 8, "ja") for i in range(40)]
    few = [(9000, "".join(rng.choices(letters, k=60)) + phrase * 9, "fr"), (9001, "".join(rng.choices(letters, k=60)), "fr")]
    df = spark.createDataFrame(good + bad + few, "doc_id long, text string, lang string")
    rows = {r.id: r for r in rp.repeated_documents(df, per_stratum=1500, alpha=0.02).collect()}
    assert sorted(rows) == [*range(5000, 5040), 9000]
    # Japanese is certified from the first cutoff on and needs no exact share, two French texts certify nothing.
    assert all(rows[i].cutoff == rp.cutoff_grid(0.3)[0] for i in range(5000, 5040))
    assert rows[9000].cutoff == 2.0 and rows[9000].share >= 0.3
    risk = {r.stratum: r for r in rp.rejection_risk(df, per_stratum=1500, alpha=0.02).collect()}
    assert risk["ja"].cutoff == rp.cutoff_grid(0.3)[0] and risk["ja"].false_rejections == 0 and risk["ja"].bound < 0.02


def test_a_certified_score_needs_no_exact_share(spark, monkeypatch):
    """A text whose score is above the cutoff is rejected by it, whatever its exact share."""
    phrase, letters = "この文は何度も繰り返されている文章なのである、", [chr(c) for c in range(0x4E00, 0x5E00)]
    rng = random.Random(6)
    odd = "".join("甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申" + letters[i] for i in range(40))
    rows = [(i, "".join(rng.choices(letters, k=60)), "ja") for i in range(2400)] + [(5000, phrase * 8, "ja"), (5001, odd, "ja")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    exact = {r.id: r.share for r in rp.repetition_shares(df.where("doc_id >= 5000")).collect()}
    assert exact[5001] < 0.3 < 0.6 < rp.screened(df.where("doc_id = 5001"), 0.3, 10).first().score
    found = {r.id: r for r in rp.repeated_documents(df, per_stratum=1500, alpha=0.02).collect()}
    assert set(found) == {5000, 5001} and found[5001].share < 0.3
    assert {r.id for r in rp.repeated_documents(df, per_stratum=100, alpha=0.02).collect()} == {5000}


def test_a_higher_cutoff_where_good_texts_score_high(spark):
    rows = [("a", 0.45, True)] * 30 + [("a", 0.1, True)] * 3000 + [("a", 0.9, False)] * 50
    df = spark.createDataFrame(rows, "stratum string, score double, good boolean")
    assert rp.calibrate(df, rp.cutoff_grid(0.3), alpha=0.005) == {"a": pytest.approx(0.475)}


def test_empty(spark):
    assert rp.repeated_documents(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
