import random

import numpy as np
import pytest

from sumire.llm import overlap as ov


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, alphabet, n):
    out = list(text)
    for _ in range(n):
        i = rng.randint(0, len(out))
        kind = rng.random()
        if kind < 0.35 and out:
            out.pop(min(i, len(out) - 1))
        elif kind < 0.7:
            out.insert(i, rng.choice(alphabet))
        elif out:
            out[min(i, len(out) - 1)] = rng.choice(alphabet)
    return "".join(out)


def test_banded_distances():
    rng = random.Random(1)
    left = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    right = [edited(rng, t, "abc", rng.randint(0, 7)) for t in left]
    limits = np.array([15 * max(len(a), len(b)) // 100 for a, b in zip(left, right)])
    for a, b, k, got in zip(left, right, limits, ov.distances(left, right, limits.copy())):
        true = distance(a, b)
        assert got == true if true <= k else got > k


@pytest.mark.parametrize("length,edits,percent", [(8000, 1270, 15), (8000, 400, 15), (12000, 1900, 15)])
def test_distances_of_long_texts(length, edits, percent):
    rng = random.Random(length + edits)
    a = "".join(rng.choice("abcdefghij") for _ in range(length))
    b = edited(rng, a, "abcdefghij", edits)
    # A plain table, one row at a time.
    x, y = np.array(list(map(ord, a))), np.array(list(map(ord, b)))
    row = np.arange(len(y) + 1)
    for i, c in enumerate(x, 1):
        new = np.minimum(np.concatenate(([i], row[:-1] + (y != c))), np.concatenate(([i], row[1:] + 1)))
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    true = int(row[-1])
    for limit in (true - 1, true, true + 30):
        got = int(ov.distances([a, "abc"], [b, "abd"], np.array([limit, 1]))[0])
        assert got == true if true <= limit else got == limit + 1


def test_too_great_a_percentage_is_an_error(spark):
    df = spark.createDataFrame([(1, "a", True, True)], "cls long, norm string, evaluation boolean, training boolean")
    with pytest.raises(ValueError):
        ov.class_pairs(df, 50)


@pytest.mark.parametrize("percent", [30, 40, 45])
def test_great_percentages_lose_no_pair(percent):
    rng = random.Random(percent)
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 25))) for _ in range(60)]
    other = [edited(rng, rng.choice(base), "abcdefgh", rng.randint(0, 9)) for _ in range(200)]
    want = {(i, j) for i, a in enumerate(base) for j, b in enumerate(other) if 0 < distance(a, b) <= percent * max(len(a), len(b)) // 100}
    block = ov.Block(np.arange(len(base)), base, np.zeros(0, np.uint64), np.zeros(0, np.float32), percent)
    met = {(int(e), int(t)) for es, ts in block.met(ov.Packed(other)) for e, t in zip(es, ts)}
    assert want <= met and len(want) > 60


def test_long_texts_are_met(spark):
    rng = random.Random(11)
    a = "".join(rng.choice("abcdefghij") for _ in range(6000))
    near, far = edited(rng, a, "abcdefghij", 500), edited(rng, a, "abcdefghij", 2500)
    moved = "x" * 400 + a[:-200]
    rows = [(1, a, True, False), (2, near, False, True), (3, far, False, True), (4, moved, False, True), (5, a[:40], True, False), (6, a[:38], False, True)]
    df = spark.createDataFrame(rows, "cls long, norm string, evaluation boolean, training boolean")
    assert {tuple(r) for r in ov.class_pairs(df, 15).collect()} == {(1, 2), (1, 4), (5, 6)}


def test_links_and_report_agree_with_the_pairs(spark):
    rng = random.Random(12)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(30)) for _ in range(12)]
    splits = spark.createDataFrame([("t", "train", "a", at(1)), ("v", "validation", "c", at(2)), ("x", "test", "d", at(1))], SPLITS)
    rows = [(i, rng.choice("ttvx"), edited(rng, rng.choice(base), "abcdefgh", rng.randint(0, 2)), "", "") for i in range(200)]
    train = spark.createDataFrame(rows, TRAIN)
    pairs = ov.cross_split_pairs(train, splits).collect()
    want = {}
    for r in pairs:
        want[r.split, r.source] = want.get((r.split, r.source), 0) + 1
    assert {(r.split, r.source): r.pairs for r in ov.overlap_report(train, splits).collect()} == want
    links = ov.overlap_links(train, splits).collect()
    cls = {r.row_id: r.cls for r in links}
    assert len(links) == 200
    partners = {}
    for r in pairs:
        partners.setdefault(r.row_a, set()).add(cls[r.row_b])
        partners.setdefault(r.row_b, set()).add(cls[r.row_a])
    assert {r.row_id: r.links for r in links if r.links} == {i: len(x) for i, x in partners.items()}


@pytest.mark.parametrize("percent", [5, 15])
def test_segments_are_disjoint_and_enough(percent):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdef") for _ in range(n)) for n in range(1, 101)]
    doc, start, length = ov.cut(texts, np.zeros(0, np.uint64), np.zeros(0, np.float32), percent)
    for i, t in enumerate(texts):
        k = ov.bound(ov.longest_partner(len(t), percent), percent)
        own = sorted((int(s), int(n)) for d, s, n in zip(doc, start, length) if d == i)
        assert len(own) == (k + 1 if k else 0)
        assert all(n in ov.LENGTHS and s >= 0 and s + n <= len(t) for s, n in own)
        assert all(a + n <= b for (a, n), (b, _) in zip(own, own[1:]))


def test_block_finds_every_near_text():
    rng = random.Random(3)
    alphabet = "abcdefgh"
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(4, 60))) for _ in range(60)]
    other = [edited(rng, rng.choice(base), alphabet, rng.randint(0, 9)) for _ in range(300)]
    want = {(i, j) for i, a in enumerate(base) for j, b in enumerate(other) if distance(a, b) <= 15 * max(len(a), len(b)) // 100 and a != b}
    block = ov.Block(np.arange(len(base)), base, np.zeros(0, np.uint64), np.zeros(0, np.float32), 15)
    met = {(int(e), int(t)) for limit in (4_000_000, 3) for es, ts in block.met(ov.Packed(other), limit) for e, t in zip(es, ts)}
    assert want <= met


SPLITS = "article_id string, split string, source string, assigned_at timestamp_ntz"
TRAIN = "row_id long, article_id string, text string, split string, norm string"


def at(day):
    import datetime

    return datetime.datetime(2025, 1, day)


def test_operator(spark):
    splits = spark.createDataFrame([("t", "train", "a", at(1)), ("v", "train", "b", at(1)), ("v", "validation", "c", at(2)), ("x", "test", None, at(1)), ("n", None, "d", at(1)), (None, "test", "e", at(1))], SPLITS)
    text = "Near Klotis the old register of Brameris was published."
    rows = [
        (1, "t", text), (2, "v", text.upper().replace(" ", "  ")), (3, "x", text.replace("old", "new")), (4, "v", "Something else entirely, and long enough to differ."), (5, "n", text), (6, None, text), (7, "gone", text),
        (8, "t", text), (9, "t", None), (10, "v", None), (11, "t", ""), (12, "v", ""), (13, "x", "ＮＥＡＲ" + text[4:]), (14, "t", "x" * 20000), (15, "v", "x" * 19000 + "y" * 1000),
    ]
    train = spark.createDataFrame([(*r, "clash", "clash") for r in rows], TRAIN)
    got = sorted((r.row_a, r.row_b, r.split, r.source) for r in ov.cross_split_pairs(train, splits).collect())
    want = []
    for e, split, source in ((2, "validation", "c"), (3, "test", None), (13, "test", None)):
        want += [(min(e, t), max(e, t), split, source) for t in (1, 8)]
    want += [(11, 12, "validation", "c"), (14, 15, "validation", "c")]
    assert got == sorted(want, key=lambda r: (r[0], r[1]))
    report = {(r.split, r.source): r.pairs for r in ov.overlap_report(train, splits).collect()}
    assert report == {("validation", "c"): 4, ("test", None): 4}


def test_empty(spark):
    assert ov.cross_split_pairs(spark.createDataFrame([], TRAIN), spark.createDataFrame([], SPLITS)).count() == 0


def test_blocks_agree_with_one(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(40)]
    classes = [(i, t, True, False) for i, t in enumerate(base)] + [(100 + i, edited(rng, t, "abcdefgh", 3), False, True) for i, t in enumerate(base)]
    df = spark.createDataFrame(classes, "cls long, norm string, evaluation boolean, training boolean")
    a = {tuple(r) for r in ov.class_pairs(df, 15).collect()}
    b = {tuple(r) for r in ov.class_pairs(df, 15, block=210).collect()}
    assert a == b and len(a) >= 35
