"""Verification, data-set and layout helpers against fixtures and brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sumire import session
from sumire.functions import characters, geometry, text as tx
from sumire.operators import corpus, integrity, layout, scoring, selection
from sumire.plans import catalogue
from sumire.sources import readers, writers
from sumire.streaming import logs


def test_recipe_data_sets_are_checked(spark, tmp_path):
    (tmp_path / "samples.jsonl").write_text('{"id": 1}\n{"id": 2}\n')

    def manifest(**values):
        (tmp_path / "manifest.json").write_text(json.dumps({"schema_version": 3, "status": "complete", "count": 2} | values))

    manifest()
    assert sorted(r.id for r in readers.recipes(spark, str(tmp_path), "id long", (2, 3)).collect()) == [1, 2]
    for bad in ({"count": 3}, {"status": "running"}, {"schema_version": 9}):
        manifest(**bad)
        with pytest.raises(ValueError):
            readers.recipes(spark, str(tmp_path), "id long", (2, 3))


def test_index_is_bound_to_its_inputs(spark, tmp_path):
    path = str(tmp_path / "index")
    writers.write_indexed(spark.range(3), path, "abc")
    assert readers.indexed(spark, path, "abc").count() == 3
    with pytest.raises(ValueError):
        readers.indexed(spark, path, "abd")


def test_json_document_is_whole_or_absent(spark, tmp_path):
    path = tmp_path / "out.json"
    writers.write_json_document(spark, '{"a": "é"}', str(path))
    assert json.loads(path.read_text()) == {"a": "é"}
    with pytest.raises(FileExistsError):
        writers.write_json_document(spark, "{}", str(path))
    with pytest.raises(ValueError):
        writers.write_json_document(spark, "{", str(path), overwrite=True)
    writers.write_json_document(spark, "[1]", str(path), overwrite=True)
    assert json.loads(path.read_text()) == [1] and not list(tmp_path.glob("*.tmp"))


def test_html_report_escapes(spark):
    page = writers.html_table(spark.createDataFrame([("<b>", None)], "a string, b int"), 10, "x & y")
    assert "<td>&lt;b&gt;</td><td></td>" in page and "x &amp; y" in page


def test_lookup_of_unknown_articles_fails(spark):
    articles = spark.createDataFrame([(1, "a"), (2, "b")], "k long, t string")
    keys = spark.createDataFrame([(1,), (1,)], "k long")
    assert [r.t for r in readers.looked_up(keys, articles, "k").collect()] == ["a", "a"]
    with pytest.raises(Exception, match="unknown article"):
        readers.looked_up(spark.createDataFrame([(3,)], "k long"), articles, "k").collect()


def test_argument_checks(spark):
    integrity.in_range(0, 1, share=0.5)
    for bad in (1.5, True, "x"):
        with pytest.raises(ValueError):
            integrity.in_range(0, 1, share=bad)
    integrity.require_empty(spark.range(0), "rows")
    with pytest.raises(ValueError, match="rows"):
        integrity.require_empty(spark.range(2), "rows")
    assert integrity.suite_sets(["ja/train"], ["en/suite"]) == ["ja/train", "en/suite"]
    for bad in (["ja/test"], ["ja/train"]):
        with pytest.raises(ValueError):
            integrity.suite_sets(["ja/train"], bad)


def test_errors_become_rows(spark):
    df = spark.createDataFrame([(1, "4"), (2, "x"), (3, None)], "k long, v string")
    got = {r.k: (r.status, r.result) for r in integrity.guarded(df, "k", ["v"], lambda v: str(int(v) * 2)).collect()}
    assert got == {1: ("complete", "8"), 2: ("error", None), 3: ("error", None)}


def test_completion(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", None)], "name string, value int")
    b = spark.createDataFrame([("x", 1), ("y", 3), ("w", 1), ("z", None)], "name string, value int")
    assert {r.name: r.problem for r in integrity.completion_problems(a, b, "name", "value").collect()} == {"y": "different", "w": "unexpected"}
    assert {r.name: r.problem for r in integrity.completion_problems(a, b.limit(0), "name", "value").collect()} == {"x": "missing", "y": "missing", "z": "missing"}


def test_running_counters(spark, tmp_path):
    path = str(tmp_path / "log")
    for batch, kinds in enumerate(("aab", "b", "a")):
        writers.append_batch(spark.createDataFrame([(k,) for k in kinds], "kind string"), path, batch)
    got = {(r.batch, r.kind): (r.n, r.so_far) for r in logs.running_counters(spark, path, 2, "kind").collect()}
    assert got == {(0, "a"): (2, 2), (0, "b"): (1, 1), (1, "b"): (1, 2), (2, "a"): (1, 3)}


@pytest.mark.parametrize("mode", layout.TILINGS)
def test_tilings(mode):
    for seed in range(20):
        cells = layout.tiling(4, 5, mode, seed)
        covered = [(r + i, c + j) for r, c, a, b in cells for i in range(a) for j in range(b)]
        assert len(covered) == 20 == len(set(covered))
        assert {r for r, _, a, _ in cells for r in (r, r + a)} == set(range(5))
        assert cells == layout.tiling(4, 5, mode, seed)
    with pytest.raises(ValueError):
        layout.tiling(1, 1, "mixed", 0)


@pytest.mark.parametrize(("rows", "columns", "mode", "seed"), [(3, 3, "block_merge", 3490504), (3, 3, "block_merge", 4729184), (2, 60, "column_merge", 0), (60, 2, "row_merge", 0), (2, 60, "mixed", 1), (60, 2, "mixed", 1), (3, 90, "block_merge", 2)])
def test_tiling_where_no_draw_is_good(rows, columns, mode, seed):
    cells = layout.tiling(rows, columns, mode, seed)
    covered = [(r + i, c + j) for r, c, a, b in cells for i in range(a) for j in range(b)]
    assert len(covered) == rows * columns == len(set(covered)) and cells == layout.tiling(rows, columns, mode, seed)
    assert {x for r, _, a, _ in cells for x in (r, r + a)} == set(range(rows + 1)) and {x for _, c, _, b in cells for x in (c, c + b)} == set(range(columns + 1))
    assert {(a, b) for _, _, a, b in cells} <= {(1, 1), *layout.TILINGS[mode]}
    tall, wide = any(a > 1 for _, _, a, _ in cells), any(b > 1 for _, _, _, b in cells)
    assert (tall, wide) == {"column_merge": (False, True), "row_merge": (True, False)}.get(mode, (True, True))
    assert mode != "block_merge" or any(a > 1 < b for _, _, a, b in cells)


@pytest.mark.parametrize(("rows", "columns", "mode"), [(2, 2, "mixed"), (1, 9, "column_merge"), (9, 1, "row_merge"), (2, 9, "block_merge"), (9, 2, "block_merge")])
def test_grid_that_has_no_tiling(rows, columns, mode):
    with pytest.raises(ValueError):
        layout.tiling(rows, columns, mode, 0)


def test_tiling_check_of_orders_where_no_draw_is_good(spark, tmp_path):
    spark.createDataFrame([(3490504, 351843), (4729184, 471798), (4, 4), (0, 1)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    assert sorted(map(tuple, catalogue.QUERIES["grid_tiling_check"](spark, str(tmp_path)).collect())) == [("block_merge", 3, 30, 0), ("plain", 1, 12, 0)]


def test_near_boxes_against_brute_force(spark):
    rng = random.Random(1)
    boxes = []
    for i in range(300):
        x, y = rng.randint(-200, 600), rng.randint(-200, 600)
        boxes.append((rng.choice(["p", "q", None]), i, float(x), float(y), float(x + rng.randint(0, 200)), float(y + rng.randint(0, 90))))
    df = spark.createDataFrame(boxes, "page string, id long, x0 double, y0 double, x1 double, y1 double")
    want = {(a[1], b[1]) for a in boxes for b in boxes if a[0] is not None and a[0] == b[0] and a[1] < b[1] and a[2] < b[4] and b[2] < a[4] and a[3] < b[5] + 5 and b[3] - 5 < a[5]}
    found = [(r.a, r.b) for r in layout.near_boxes(df, "page", "id", 5.0).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_runs_of_a_class(spark):
    texts = ["日本 abc 12 です", " 12abc日", "12 3", "", "日1 本", "a1日b", "abc\ndef", "x" * 50_000 + "日" * 50_000]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "id int, t string")
    rows = {}
    for r in layout.class_runs(df, "id", "t", tx.WESTERN).orderBy("id", "run").collect():
        rows.setdefault(r.id, []).append((r.western, r.text))
    assert rows[0] == [(False, "日本 "), (True, "abc 12 "), (False, "です")] and rows[1] == [(True, " 12abc"), (False, "日")] and rows[2] == [(False, "12 3")]
    assert 3 not in rows and 8 not in rows and rows[4] == [(False, "日1 本")] and rows[5] == [(True, "a1"), (False, "日"), (True, "b")] and rows[6] == [(True, "abc\ndef")]
    assert len(rows[7]) == 2


def test_wrapping_budget(spark):
    records = spark.createDataFrame([("r", i, n) for i, n in enumerate([3, 4, 5, 1], 1)] + [("s", 1, 2)], "ring string, i long, n long")
    starts = spark.createDataFrame([("r", 3), ("s", 1)], "ring string, start long")
    got = sorted((r.ring, r.turn, r.i, r.enough) for r in selection.wrapping_budget(records, starts, "ring", "i", "n", 8).collect())
    assert got == [("r", 0, 3, True), ("r", 1, 4, True), ("r", 2, 1, True), ("s", 0, 1, False)]


def test_fragments_are_the_distinct_windows(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab𠮟") for _ in range(rng.randint(0, 40)))) for i in range(80)] + [(90, None), (91, "ab" * 3000)]
    got = {}
    for r in corpus.fragments(spark.createDataFrame(rows, "k long, text string"), "k").collect():
        got.setdefault(r.id, []).append(r.gram)
    for i, t in rows:
        want = sorted({t[k : k + 16] for k in range(max(1, len(t) - 15))}) if t is not None else []
        assert sorted(got.get(i, [])) == want


def test_both_forms(spark):
    df = spark.createDataFrame([(1, "Ａb"), (2, "ab")], "k long, text string")
    assert sorted((r.k, r.text) for r in corpus.both_forms(df, {"Ａ": "A"}).collect()) == [(1, "Ab"), (1, "Ａb"), (2, "ab")]


def test_best_results_fall_back(spark):
    best = spark.createDataFrame([("a", 2, 5, 0.1), ("b", 1, 1, 0.3)], "run string, epoch int, step int, value double")
    log = spark.createDataFrame([("a", 2, 5, "validation", 0.1), ("a", 2, 5, "train", 9.0), ("a", 3, 6, "validation", 0.2), ("b", 1, 1, "length", 0.4)], "run string, epoch int, step int, kind string, value double")
    got = sorted((r.run, r.kind, r.value) for r in scoring.best_results(best, log, "run", ["validation", "length"]).collect())
    assert got == [("a", "validation", 0.1), ("b", "length", 0.4), ("b", "validation", 0.3)]


def test_filter_reasons(run):
    reasons = lambda *v: run(lambda a, b, c, d: tx.filter_reasons(a, b, c, d, 10), *v)
    assert reasons(2, 0, 0, 10) == [] and reasons(2, 0, 3, 9) == ["unreadable_character_codes", "too_few_characters"]
    assert reasons(0, 0, 3, 1) == ["no_fonts"] and reasons(2, 1, 3, 1) == ["font_without_to_unicode"]


def test_labels_of_time(run):
    assert run(tx.duration_label, 3661.2) == "01:01:02" and run(tx.duration_label, -5.0) == "00:00:00" and run(tx.duration_label, 400000.0) == "111:06:40"


def test_normal_forms(spark):
    df = spark.createDataFrame([("が",), (None,), ("ﬁ",)], "t string")
    assert [r.n for r in df.select(characters.normalised("t", F.lit("NFC")).alias("n")).collect()] == ["が", None, "ﬁ"]
    assert [r.n for r in df.select(characters.normalised("t", F.lit("NFKC")).alias("n")).collect()] == ["が", None, "fi"]


def test_boundary_classes(run):
    kind = lambda *v: run(geometry.boundary_class, *v)
    assert [kind(1.0, 0.0, 0.0), kind(1.0, 1.0, 0.6), kind(1.0, 1.0, 0.0), kind(1.0, 1.0, 0.3), kind(0.4, 1.0, 1.0)] == ["solid", "dash_ink", "dash_gap", None, None]


def test_json_update(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"c": 2, "d": 3}}',), ("{",), (None,)], "t string")
    got = [r.u for r in df.select(tx.json_updated(F.col("t"), "a int, b struct<c:int,d:int>", a=F.lit(9), b__c=F.lit(8)).alias("u")).collect()]
    assert json.loads(got[0]) == {"a": 9, "b": {"c": 8, "d": 3}} and got[2] is None


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_exact_sums(spark):
    import math

    rng = random.Random(3)
    rows = [("ab"[i % 2], rng.choice([1e16, -1e16, 1.0, 1e-9, 3.3]) * rng.random()) for i in range(2000)] + [("a", None), ("a", float("inf")), ("c", None)]
    got = {r.k: r.total for r in scoring.exact_sums(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    for k in "ab":
        assert got[k] == math.fsum(v for x, v in rows if x == k and v is not None and math.isfinite(v))
    assert got["c"] == 0.0


def test_boxes_below_one_half_match_greedily(spark):
    rng = random.Random(4)

    def boxes(n):
        out = []
        for i in range(n):
            x, y = rng.randint(0, 60), rng.randint(0, 60)
            out.append(("p", i, float(x), float(y), float(x + rng.randint(5, 40)), float(y + rng.randint(5, 40))))
        return out

    def iou(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        i = max(0, w) * max(0, h)
        return i / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - i)

    t, f = boxes(25), boxes(25)
    schema = "page string, id long, x0 double, y0 double, x1 double, y1 double"
    got = {(r.t, r.f) for r in layout.matched_boxes(spark.createDataFrame(t, schema), spark.createDataFrame(f, schema), "page", 0.2).collect()}
    want, used = set(), (set(), set())
    for s, i, j in sorted((-iou(a, b), a[1], b[1]) for a in t for b in f):
        if -s >= 0.2 and i not in used[0] and j not in used[1]:
            want.add((i, j))
            used[0].add(i)
            used[1].add(j)
    assert got == want and len(got) > 5


def test_strict_selections_raise_when_short(spark):
    rows = [(i, f"a{i}", "en", f"row {i} of its own {'abcdefghijklmnop'[i]} éé") for i in range(4)]
    pool = spark.createDataFrame(rows, "id long, article_id string, language string, text string")
    assert selection.strict_pick(pool, "é", 2, "s").count() == 2
    with pytest.raises(ValueError, match="too few"):
        selection.strict_pick(pool, "é", 9, "s")
    assert selection.disjoint_excerpts(pool, "s", 3, strict=True).count() == 3
    with pytest.raises(ValueError, match="only 4 of 5"):
        selection.disjoint_excerpts(pool, "s", 5, strict=True)
