import random

import pytest
from hypothesis import given, settings, strategies as st

from sumire.llm import mixing as mx, packing as pk, subset as sb, tokens as tk

DOCS = "doc_id long, text string, source string, tokens long, id string, container string"


def documents(spark, n=300):
    rng = random.Random(6)
    rows = [(i, "word " * rng.randint(1, 400), rng.choice(["a", "a", "b", "c"]) if i % 50 else None, -1, "x", "y") for i in range(n)]
    rows += [(n, None, "a", -1, "x", "y"), (n + 1, "", "b", -1, "x", "y"), (n + 2, "word " * 9000, "c", -1, "x", "y"), (n + 3, "word " * 10, "unlisted", -1, "x", "y")]
    return spark.createDataFrame(rows, DOCS)


def test_token_counts_of_all_tokenizers(spark):
    df = spark.createDataFrame([(1, "the old register", "a"), (2, "<|endoftext|> 記録", "a"), (3, None, "a"), (4, "", None)], "doc_id long, text string, source string")
    counts = {}
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model", "word_bpe_49k.json"):
        counts[name] = {r.id: r.tokens for r in tk.token_counts(df, name=name).collect()}
        assert counts[name][3] == counts[name][4] == 0 and counts[name][1] >= 3
    assert counts["byte_bpe_50k.tiktoken"] == counts["byte_bpe_50k.json"]
    assert counts["byte_bpe_50k.json"][2] > 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 100), st.sampled_from("abc")), max_size=80), st.integers(1, 8))
def test_pack_places_every_item_once(items, window):
    sizes, sources = [n for n, _ in items], [s for _, s in items]
    boxes, left = pk.pack(sizes, sources, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 7.0}, 100, window)
    assert sorted(i for box in boxes for i in box) == list(range(len(items)))
    assert all(0 < sum(sizes[i] for i in box) <= 100 for box in boxes)
    if sizes:
        assert len(boxes) <= max(1, 2 * -(-sum(sizes) // 100))


def test_windows_keep_the_mixture():
    rng = random.Random(8)
    sizes = [rng.randint(1, 60) for _ in range(6000)]
    sources = sorted(rng.choices("abc", [6, 3, 1], k=6000))
    whole = sum(sizes)
    shares = {s: sum(n for n, t in zip(sizes, sources) if t == s) / whole for s in "abc"}
    boxes, _ = pk.pack(sizes, sources, shares, {}, 1000, 20)
    for at in range(0, len(boxes) - 40, 20):
        part = [i for box in boxes[at : at + 20] for i in box]
        total = sum(sizes[i] for i in part)
        for s in "abc":
            assert abs(sum(sizes[i] for i in part if sources[i] == s) / total - shares[s]) < 0.12


@pytest.mark.parametrize("size,per_box", [(100, 2), (130, 1), (150, 1), (180, 1), (200, 1), (240, 1), (64, 4)])
def test_equal_items_are_settled_where_they_are(size, per_box):
    n = 5000
    sources = ["abc"[i % 3] for i in range(n)]
    closed, open_, windows, _ = pk.pack_windows([size] * n, sources, dict.fromkeys("abc", 1 / 3), {}, 256)
    assert sorted(i for _, box in closed + open_ for i in box) == list(range(n))
    assert sum(len(box) for _, box in open_) < 4 * pk.WINDOW * per_box
    assert len(closed) + len(open_) == -(-n // per_box)


def test_groups_pass_on_a_bounded_number_of_items(spark, monkeypatch):
    # Every group keeps all but KEEP items, so a group of the next level has MERGE x KEEP at most, whatever the input.
    monkeypatch.setattr(pk, "ITEMS", 100)
    rows = [(i, "word " * n, "ab"[i % 2]) for i, n in enumerate([40] * 1500 + [70] * 1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    caps = spark.createDataFrame([(1, 100)], "capacity_id int, capacity_tokens int")
    packed = pk.pack_documents(df, caps).collect()
    seen = {r.doc_id for r in packed}
    assert len(seen) == 3000 == len(packed)
    level = [int(r.container.split("-")[1]) for r in packed]
    assert sum(x > 0 for x in level) < 30 * pk.KEEP
    used = {}
    for r in packed:
        used[r.container] = used.get(r.container, 0) + r.tokens
    assert max(used.values()) <= 100


def test_targets_and_mixture_report(spark):
    df = documents(spark, 3000)
    caps = spark.createDataFrame([(1, 2048)], "capacity_id int, capacity_tokens int")
    report = pk.fill_report(pk.pack_documents(df, caps), caps, df).first()
    assert report.fill > 0.97 and report.windows >= 3 and report.mixture_error < 0.1
    sources = {r.doc_id: r.source for r in df.collect()}
    targets = spark.createDataFrame([("a", 0.2), ("b", 0.8), ("b", None), (None, None)], "source string, target_share double")
    rows = [r for r in pk.pack_documents(df, caps, targets).collect() if r.win and r.win.endswith("-0")]
    b = sum(r.tokens for r in rows if sources[r.doc_id] == "b")
    a = sum(r.tokens for r in rows if sources[r.doc_id] == "a")
    assert 2.5 < b / a < 6


def test_packed_documents(spark, monkeypatch):
    monkeypatch.setattr(pk, "ITEMS", 40)
    df = documents(spark)
    caps = spark.createDataFrame([(1, 256), (2, 1024), (2, 1024), (3, None), (4, 0)], "capacity_id int, capacity_tokens int")
    sizes = {r.id: r.tokens for r in tk.token_counts(df).collect()}
    rows = pk.pack_documents(df, caps).collect()
    for cap_id, cap in ((1, 256), (2, 1024)):
        own = [r for r in rows if r.capacity_id == cap_id]
        used, per = {}, {}
        for r in own:
            per.setdefault(r.doc_id, []).append(r)
            if r.container is not None:
                used[r.container] = used.get(r.container, 0) + r.tokens
        assert set(per) == set(sizes)
        assert all(n <= cap for n in used.values())
        for doc, parts in per.items():
            parts.sort(key=lambda r: r.start_token)
            assert sum(r.tokens for r in parts) == sizes[doc]
            assert len(parts) == 1 or sizes[doc] > cap
            assert all(a.start_token + a.tokens == b.start_token for a, b in zip(parts, parts[1:]))
            assert (parts[0].container is None) == (sizes[doc] == 0)
        assert sum(used.values()) / (len(used) * cap) > 0.93
    assert {r.capacity_id for r in rows} == {1, 2}
    report = {r.capacity_id: r.fill for r in pk.fill_report(pk.pack_documents(df, caps), caps).collect()}
    assert all(f > 0.93 for f in report.values())


def test_pack_nothing(spark):
    caps = spark.createDataFrame([(1, 256)], "capacity_id int, capacity_tokens int")
    assert pk.pack_documents(spark.createDataFrame([], DOCS), caps).count() == 0


TARGETS = "source string, target_share double, max_repeats int"


def test_mixture(spark):
    df = documents(spark, 2000)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 8), ("c", 0.1, 2), ("empty", 0.05, 3), (None, 0.3, 1), ("a", None, 1)], TARGETS)
    chosen, report = mx.mix(df, targets)
    sizes = {r.id: (r.source, r.tokens) for r in tk.token_counts(df).collect()}
    rows = chosen.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    most = {"a": 1, "b": 8, "c": 2}
    for r in rows:
        assert r.source in most and 1 <= r.copies <= most[r.source] and sizes[r.doc_id] == (r.source, r.tokens)
    got = {r.source: r for r in report.collect()}
    total = sum(r.tokens * r.copies for r in rows)
    for s, share in (("a", 0.5), ("b", 0.4), ("c", 0.1)):
        mine = sum(r.tokens * r.copies for r in rows if r.source == s)
        assert got[s].mixed_tokens == mine and got[s].actual_share == pytest.approx(mine / total)
        assert mine <= got[s].budget_tokens and got[s].budget_tokens - mine <= 1500
        assert abs(mine / total - share) < 0.02
    assert got["empty"].mixed_tokens == 0 and got["empty"].actual_share == 0.0
    assert set(got) == {"a", "b", "c", "empty"}


def test_mixture_of_a_given_total_and_of_nothing(spark):
    df = documents(spark)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS)
    report = {r.source: r for r in mx.mix(df, targets, total=4000)[1].collect()}
    assert all(r.budget_tokens == 2000 and 0 < r.mixed_tokens <= 2000 for r in report.values())
    chosen, none = mx.mix(spark.createDataFrame([], DOCS), targets)
    assert chosen.count() == 0 and {r.actual_share for r in none.collect()} == {None}


@pytest.mark.parametrize(
    "sources,total,want",
    [
        ({"a": (0.5, 100), "b": (0.5, 1000)}, 600, {"a": 100, "b": 500}),
        ({"a": (0.5, 100), "b": (0.3, 150), "c": (0.2, 1000)}, 600, {"a": 100, "b": 150, "c": 350}),
        ({"a": (0.5, 100), "b": (0.5, 100)}, 600, {"a": 100, "b": 100}),
        ({"a": (0.2, 0), "b": (0.5, 900), "c": (0.5, 900)}, 600, {"a": 0, "b": 300, "c": 300}),
        ({}, 5, {}),
    ],
)
def test_what_a_capped_source_lacks_is_shared_out(sources, total, want):
    assert mx.shared_out(sources, total) == want


TRAIN = "row_id long, text string, anchor string, article_id string, cluster int, family string"


def rows_of(n_family, n_other):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    fixed = " ".join(word() for _ in range(6))
    rows = [(i, f"{fixed} {i}", "e", "big") for i in range(n_family)]
    rows += [(n_family + i, " ".join(word() for _ in range(6)), rng.choice("xyz"), f"a{i // 4}") for i in range(n_other)]
    return [(*r, 0, "clash") for r in rows]


def test_subset_is_varied_and_full(spark):
    df = spark.createDataFrame(rows_of(1000, 1000) + [(5000, None, "e", "a1", 0, ""), (5001, "", None, None, 0, "")], TRAIN)
    got = sb.varied_subset(df, 200, k=16).collect()
    assert len(got) == 200 == len({r.row_id for r in got})
    assert sum(r.article_id == "big" for r in got) < 50
    assert len({r.article_id for r in got}) > 90
    assert 5000 not in {r.row_id for r in got}
    again = {r.row_id for r in sb.varied_subset(df, 200, k=16).collect()}
    assert again == {r.row_id for r in got}


def test_subset_of_few_and_of_none(spark):
    df = spark.createDataFrame(rows_of(3, 4), TRAIN)
    assert sb.varied_subset(df, 50, k=4).count() == 7
    assert sb.varied_subset(df.limit(0), 5).count() == 0
    same = spark.createDataFrame([(i, "same text", "e", "a", 0, "") for i in range(30)], TRAIN)
    assert sb.varied_subset(same, 10).count() == 10


def test_the_subset_covers_more_than_a_random_one(spark):
    df = spark.createDataFrame(rows_of(3000, 1000), TRAIN)
    report = {r.kind: r for r in sb.subset_report(df, sb.varied_subset(df, 200, k=16)).collect()}
    for kind in ("article_id", "beginning"):
        assert report[kind].chosen_values > 1.5 * report[kind].random_values
        assert report[kind].largest_share < 0.5 * report[kind].random_largest_share


def test_quotas_end_by_counts(spark):
    rng = random.Random(10)
    rows = [(i, rng.randrange(3), rng.randint(1, 4), rng.choice([rng.random() * 3, 0.5])) for i in range(900)]
    df = spark.createDataFrame(rows, "row_id long, cluster int, turn int, score double")
    quota = {0: 7, 1: 150, 2: 10_000}
    own = sb.F.element_at(sb.F.create_map(*[sb.F.lit(x) for kv in quota.items() for x in kv]), sb.F.col("cluster"))
    got = {r.row_id for r in sb.up_to(df, own).collect()}
    want = set()
    for c, n in quota.items():
        want |= {r[0] for r in sorted((r for r in rows if r[1] == c), key=lambda r: (r[2], r[3], r[0]))[:n]}
    assert got == want


@pytest.mark.parametrize("counts,size", [({0: 100, 1: 4, 2: 1}, 30), ({0: 5, 1: 5}, 100), ({0: 1000}, 7), ({}, 5), ({i: 1 for i in range(50)}, 20)])
def test_quotas_add_up(counts, size):
    got = sb.quotas(counts, size)
    assert sum(got.values()) == min(size, sum(counts.values())) and all(got[c] <= counts[c] for c in counts)
