import random

import pytest

from sumire.llm import components as co, splits as sp
from sumire.session import Workspace


def brute(pairs, names):
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in names}


GRAPHS = {
    "random": [(f"n{random.Random(1).randrange(200) + i % 60:03}", f"n{(i * 7919) % 211:03}") for i in range(150)],
    "chain": [(f"n{i:03}", f"n{i + 1:03}") for i in range(120)],
    "star": [("hub", f"n{i:03}") for i in range(150)],
    "cycle": [(f"n{i:03}", f"n{(i + 1) % 50:03}") for i in range(50)],
    "dirty": [("a", "b"), ("b", "a"), ("a", "b"), ("c", "c"), (None, "d"), ("e", None), (None, None), ("b", "z")],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_group_keys(spark, name):
    pairs = GRAPHS[name]
    names = {n for p in pairs for n in p if n is not None}
    df = spark.createDataFrame([(*p, "x") for p in pairs], "image_a string, image_b string, low string")
    got = {r.image: r.group_key for r in co.group_keys(df).collect()}
    assert got == brute(pairs, names)


@pytest.mark.parametrize("name", GRAPHS)
def test_hash_to_min(spark, name):
    pairs = GRAPHS[name]
    names = {n for p in pairs for n in p if n is not None}
    work = Workspace(spark)
    terms, edges = co.numbered(spark.createDataFrame(pairs, "a string, b string"), work)
    assert [r.term for r in terms.orderBy("term_id").collect()] == sorted(names)
    assert {r.node: r.component for r in co.named(terms, co.hash_to_min(edges, work)).collect()} == brute(pairs, names)


def test_empty(spark):
    assert co.group_keys(spark.createDataFrame([], "image_a string, image_b string")).count() == 0
    assert co.hash_to_min(spark.createDataFrame([], "a long, b long"), Workspace(spark)).count() == 0


LABELS = "label_id long, source_pdf string, split_group string, split string, component string, node string, doc int"


def labels(spark, rows):
    return spark.createDataFrame([(i, *r, "clash", "clash", 0) for i, r in enumerate(rows)], LABELS)


ROWS = [
    ("in\\a.pdf", "g1", "train"), ("x/b.pdf", "g1", None), ("b.pdf", "g2", None), (None, "g2", "test"),  # one group through g1, b and g2, broken by a row without document
    ("c.pdf", None, "train"), ("c.pdf", None, "train"), ("d.pdf", "g3", "val"), (None, None, "train"), (None, None, "test"), ("e.pdf", None, None), ("", "g4", "train"), ("dir/", "g4", "val"),
]


def test_broken_ties(spark):
    assert sorted(r.source_pdf for r in sp.broken_ties(labels(spark, ROWS)).collect()) == ["a.pdf", "b.pdf"]


def test_assigned_splits_keep_groups_whole(spark):
    targets = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1), (None, 0.5), ("zero", 0.0)], "split string, target_share double")
    rows = ROWS + [(f"p{i}.pdf", f"h{i // 3}", None) for i in range(3000)]
    got = sp.assign_splits(labels(spark, rows), targets).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.component, set()).add(r.new_split)
        assert r.new_split in ("train", "val", "test")
    assert all(len(s) == 1 for s in by.values())
    groups = [next(iter(by[c])) for c in by]
    assert abs(groups.count("train") / len(groups) - 0.8) < 0.05
    shares = [r.new_split for r in got]
    assert abs(shares.count("train") / len(shares) - 0.8) < 0.005 and abs(shares.count("val") / len(shares) - 0.1) < 0.005
    assert len({r.component for r in got if r.label_id in (7, 8)}) == 2
    again = {r.label_id: r.new_split for r in sp.assign_splits(labels(spark, rows), targets).collect()}
    assert again == {r.label_id: r.new_split for r in got}


def test_shares_reached(spark):
    targets = spark.createDataFrame([("train", 8.0), ("val", 1.0), ("test", 1.0)], "split string, target_share double")
    rows = [("big.pdf", None, None)] * 500 + [(f"p{i}.pdf", None, None) for i in range(500)]
    got = {r.split: r for r in sp.split_shares(sp.assign_splits(labels(spark, rows), targets), targets).collect()}
    assert sum(r.records for r in got.values()) == 1000 and sum(r.components for r in got.values()) == 501
    # The document of half of all pages is where there is room for it.
    assert got["train"].largest == 0.5 and all(abs(r.share - r.target_share) < 0.01 for r in got.values())
    assert got["train"].target_share == pytest.approx(0.8) and max(r.largest for r in got.values()) == 0.5
    assert sum(r.share for r in got.values()) == pytest.approx(1.0)


def test_no_labels_and_no_targets(spark):
    none = spark.createDataFrame([], "split string, target_share double")
    empty = spark.createDataFrame([], LABELS)
    assert sp.broken_ties(empty).count() == 0
    assert sp.assign_splits(empty, none).count() == 0
    assert {r.new_split for r in sp.assign_splits(labels(spark, ROWS), none).collect()} == {None}
