import random

from pyspark.sql import functions as F

from sumire.operators import corpus, groups, integrity, layout, selection as op
from sumire.session import Workspace


def test_greedy_disjoint_equals_one_by_one(spark):
    random.seed(5)
    claims = {i: {random.randrange(60) for _ in range(random.randint(1, 4))} for i in range(120)}
    ranks = {i: random.random() for i in claims}
    free, wanted = set(range(60)), []
    for i in sorted(claims, key=ranks.get):
        if claims[i] <= free:
            wanted.append(i)
            free -= claims[i]
    df = spark.createDataFrame([(i, ranks[i], c) for i in claims for c in claims[i]], "id long, rank double, claim long")
    assert sorted(r.id for r in op.greedy_disjoint(df, Workspace(spark)).collect()) == sorted(wanted)


def test_greedy_disjoint_of_nothing(spark):
    assert op.greedy_disjoint(spark.createDataFrame([], "id long, rank double, claim long"), Workspace(spark)).count() == 0


def test_disjoint_excerpts(spark):
    pool = spark.createDataFrame([(1, "a", "x" * 20), (2, "b", "y" * 5 + "x" * 16), (3, "a", "unrelated text that is long"), (4, None, "short"), (5, None, "short")], "id long, article_id string, text string")
    got = op.disjoint_excerpts(pool, "s").collect()
    assert len({r.article_id for r in got if r.article_id}) == len([r for r in got if r.article_id])
    assert not {1, 2} <= {r.id for r in got} and sum(r.text == "short" for r in got) == 1


def test_rare_first_reaches_goals_or_runs_out(spark):
    texts = ["abcdefghijklmnopqrs1", "tuv2tuv2tuv2tuv2tuv2", "zzzzyyyyxxxxwwwwvvvv", "qqqqqqqqqqqqqqqqqqqq", "abababababababababab"]
    df = spark.createDataFrame([(i, f"art{i}", 0, 20, t) for i, t in enumerate(texts)], "id long, article_id string, start int, end int, text string")
    got = op.rare_first_selection(df, 1).collect()
    have = set("".join(r.text for r in got))
    assert have == set("".join(texts))
    assert all(r.anchor in r.text for r in got)
    grams = [{r.text[i : i + 16] for i in range(5)} for r in got]
    assert all(not a & b for i, a in enumerate(grams) for b in grams[:i])


def test_rare_first_keeps_spans_apart(spark):
    df = spark.createDataFrame([(1, "a", 0, 20, "A" * 20), (2, "a", 10, 30, "B" * 20)], "id long, article_id string, start int, end int, text string")
    assert op.rare_first_selection(df, 1).count() >= 1


def test_balanced_pick_reports_shortages(spark):
    pool = spark.createDataFrame([(i, f"a{i}", "en", f"text {i} with “quotes” and number {i * 7919} inside") for i in range(6)], "id long, article_id string, language string, text string")
    chosen, report = op.balanced_pick(pool, "“x☃", 3, "s")
    got = {r.character: (r.chosen, r.shortage) for r in report.collect()}
    assert got["☃"] == (0, 3) and got["“"][0] + got["“"][1] == 3
    assert chosen.select("article_id").distinct().count() == chosen.select("article_id", "character").distinct().groupBy("article_id").count().count()


def test_balanced_pick_looks_beyond_families_of_similar_rows(spark):
    same = [(i, f"a{i}", "en", f"{i:03} the family shares “this” long fragment {i:03}") for i in range(120)]
    free = [(200 + i, f"b{i}", "en", f"{chr(65 + i) * 16}“{chr(97 + i) * 16}") for i in range(6)]
    pool = spark.createDataFrame(same + free, "id long, article_id string, language string, text string")
    chosen, report = op.balanced_pick(pool, "“☃", 4, "s")
    assert {r.character: (r.chosen, r.shortage) for r in report.collect()} == {"“": (4, 0), "☃": (0, 4)}
    chosen, report = op.balanced_pick(pool, "“☃", 9, "s")
    assert {r.character: (r.chosen, r.shortage) for r in report.collect()} == {"“": (7, 2), "☃": (0, 9)}
    texts = [r.text for r in chosen.collect()]
    grams = [{t[i : i + 16] for i in range(len(t) - 15)} for t in texts]
    assert all(not a & b for i, a in enumerate(grams) for b in grams[:i])


def test_deficit_lines_hold_their_targets(spark):
    lacking = spark.createDataFrame([("A", 3), ("B", 1), ("C", 0), ("D", 2)], "character string, shortfall int")
    rows = op.deficit_lines(lacking, "xyz", 2, 10, "s").collect()
    count = {c: 0 for c in "ABCD"}
    for r in rows:
        assert len(r.text) == 10 and len(r.embedded_targets) <= 2
        for e in r.embedded_targets:
            assert r.text[e.position] == e.character and r.text.count(e.character) == 1
            count[e.character] += 1
        assert set(r.text) - {e.character for e in r.embedded_targets} <= set("xyz")
    assert count == {"A": 3, "B": 1, "C": 0, "D": 2}


def test_deficit_substitutions_use_a_donor_once(spark):
    classes = spark.createDataFrame([("A", "Lu"), ("B", "Lu"), ("x", "Ll"), ("y", "Ll")], "character string, class string")
    lacking = spark.createDataFrame([("A", 2), ("y", 1)], "character string, shortfall int")
    donors = spark.createDataFrame([(1, "Bx"), (2, "xB"), (3, "BB"), (4, "xx"), (5, "??")], "id long, text string")
    rows = op.deficit_substitutions(lacking, donors, classes, "s").collect()
    assert len({r.donor_id for r in rows}) == len(rows)
    for r in rows:
        assert r.base_text[r.position] == r["from"] and r.text == r.base_text[: r.position] + r["to"] + r.base_text[r.position + 1 :]


def test_deficit_substitutions_leave_no_place_that_a_donor_fits(spark):
    kinds = {**dict.fromkeys("ABC", "Lu"), **dict.fromkeys("xyz", "Ll"), **dict.fromkeys("12", "Nd"), "\ue000": "Co"}
    classes = spark.createDataFrame(list(kinds.items()), "character string, class string")
    random.seed(3)
    cases = [([("A", 1)], ["A", "A", "B"]), ([("A", 1), ("B", 1)], ["A", "B"]), ([("1", 2)], ["x1", "x2", "AB1", "\ue001"]), ([("y", 2), ("A", 1)], ["Bx", "Cx", "z"]), ([("A", 1), ("B", 2)], ["A"])]
    cases += [([(c, random.randint(0, 3)) for c in "ABxy1"], ["".join(random.choice("ABCxyz12? ") for _ in range(random.randint(1, 3))) for _ in range(9)])]
    for need, texts in cases:
        lacking, donors = spark.createDataFrame(need, "character string, shortfall int"), spark.createDataFrame(list(enumerate(texts)), "id long, text string")
        rows = op.deficit_substitutions(lacking, donors, classes, "s").collect()
        assert len({r.donor_id for r in rows}) == len(rows)
        for r in rows:
            assert r["from"] != r["to"] and kinds[r["from"]] == kinds[r["to"]] and r.base_text == texts[r.donor_id]
            assert r.base_text[r.position] == r["from"] and r.text == r.base_text[: r.position] + r["to"] + r.base_text[r.position + 1 :]
        for c, n in need:
            unfilled = n - sum(r["to"] == c for r in rows)
            fit = [t for i, t in enumerate(texts) if i not in {r.donor_id for r in rows} and any(kinds.get(x) == kinds[c] and x != c for x in t)]
            assert unfilled >= 0 and not (unfilled and fit), (need, texts, c, fit)


def test_deficit_substitution_takes_later_lines(spark, tmp_path):
    from sumire.plans import selection as plans

    spark.createDataFrame([("ab",), ("ab",), ("Q",)], "text string").write.parquet(f"{tmp_path}/train.parquet")
    spark.createDataFrame([(1, "??\n\nab Q ab"), (2, "?\nQ\nXaQ"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert plans.deficit_substitution(spark, tmp_path).count() == 0
    spark.createDataFrame([("ab",), ("ab",), ("Q",), ("aX",), ("X",)], "text string").write.mode("overwrite").parquet(f"{tmp_path}/train.parquet")
    assert [(r.donor_id, r.position, r["from"], r.to, r.text) for r in plans.deficit_substitution(spark, tmp_path).collect()] == [("2:2", 0, "X", "Q", "QaQ")]


def test_third_pages(spark):
    pages = [("a", i, 0) for i in range(1, 13)] + [("a", 13, 1589)] + [("b", i, 9) for i in range(1, 14)] + [("c", 1, 0)]
    df = spark.createDataFrame(pages, "d string, p int, n int")
    got = {}
    for r in op.third_pages(df, "d", "p", F.col("n")).collect():
        got.setdefault(r.d, []).append(r.p)
    assert {k: sorted(v) for k, v in got.items()} == {"a": [13], "b": [5, 9]}


def test_round_robin_strata(spark):
    df = spark.createDataFrame([(m, t, i) for i in range(3) for m in "abcde" for t in (True, False)], "mode string, thin boolean, i int")
    got = op.round_robin(df, ["mode", "thin"], F.col("i"), 20).collect()
    assert len(got) == 20 and all(sum((r.mode, r.thin) == s for r in got) == 2 for s in {(r.mode, r.thin) for r in got})


def test_paragraph_excerpt(spark):
    long = "あ" * 70 + "。" + "い" * 100
    df = spark.createDataFrame([("short\n" + "う" * 50 + "\n" + long,), ("え" * 500,), ("",)], "t string")
    got = [r.p for r in df.select(op.paragraph_excerpt(F.col("t"), 150).alias("p")).collect()]
    assert got == [["う" * 50, "あ" * 70 + "。"], ["え" * 150], []]


def test_weighted_choice_shares(spark):
    df = spark.range(20000).select(op.weighted_choice(F.col("id"), "s", {"a": 3.0, "b": 1.0}).alias("c")).groupBy("c").count()
    got = {r.c: r["count"] for r in df.collect()}
    assert set(got) == {"a", "b"} and abs(got["a"] / 20000 - 0.75) < 0.02


def test_groups_and_split(spark):
    nodes = spark.createDataFrame([(f"d{i:02}",) for i in range(20)], "node string")
    pairs = spark.createDataFrame([("d00", "d05"), ("d05", "x"), ("x", "d09"), ("d10", "d11"), (None, "d12")], "a string, b string")
    got = {r.node: r.group for r in groups.linked_groups(nodes, pairs).collect()}
    assert got["d09"] == got["x"] == "d00" and got["d11"] == "d10" and got["d12"] == "d12"
    sizes = spark.createDataFrame([(f"g{i}", 1) for i in range(40)], "group string, pages long")
    split = {}
    for r in groups.grouped_split(sizes, "s").collect():
        split[r.split] = split.get(r.split, 0) + r.pages
    assert split == {"val": 4, "test": 4, "train": 32}


def test_long_chain_of_links(spark):
    pairs = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(100)], "a string, b string")
    got = groups.linked_groups(pairs.select(F.col("a").alias("node")), pairs).select("group").distinct().collect()
    assert [r.group for r in got] == ["n000"]


def test_span_pairs_equal_brute_force(spark):
    random.seed(8)
    spans = [(random.choice("ab"), i, s, s + random.randint(0, 600)) for i, s in enumerate(random.sample(range(3000), 60))]
    want = {(g, i, j) for g, i, a, b in spans for h, j, c, d in spans if g == h and i < j and a < b and c < d and a < d and c < b}
    df = spark.createDataFrame(spans, "g string, k int, start int, end int")
    assert {tuple(r) for r in layout.span_pairs(df, "g", "k").collect()} == want


def test_stacked_characters(spark):
    def line(i, text, y, x=10.0, size=10.0, font="F"):
        return ("p", i, 0, text, 0, font, "horizontal", x, y, size, x, y, x + size, y + size)

    rows = [line(1, "縦", 0.0), line(2, "書", 10.0), line(3, "き", 20.0), line(4, "長い行", 30.0), line(5, "二", 40.0), line(6, "字", 50.0), line(7, "横", 50.0, x=40.0), line(8, None, 60.0)]
    df = spark.createDataFrame(rows, "page string, line long, source_block int, text string, wmode int, font string, orientation string, x double, y double, size double, x0 double, y0 double, x1 double, y1 double")
    got = [(r.text, r.lines, r.orientation) for r in layout.stacked_characters(df).orderBy("line").collect()]
    assert got == [("縦書き", 3, "vertical"), ("長い行", 1, "horizontal"), ("二", 1, "horizontal"), ("字", 1, "horizontal"), ("横", 1, "horizontal"), ("", 1, "horizontal")]


def test_grid_and_segments(spark):
    df = spark.createDataFrame([("t", 0, 0, 1, 2), ("t", 1, 0, 1, 1), ("t", 1, 1, 1, 1), ("t", 1, 1, 1, 1)], "table string, row int, column int, rowspan int, colspan int")
    assert [tuple(r) for r in layout.grid_coverage(df, "table").collect()] == [("t", 1, 1, 2)]
    segments = {(r.axis, r.line, r.at) for r in layout.boundary_segments(df, "table").collect()}
    assert ("v", 1, 0) not in segments and ("v", 1, 1) in segments and ("h", 1, 1) in segments


def test_ordinals_and_digest(spark):
    df = spark.createDataFrame([(i * 3, f"t{i}", "g") for i in range(50)], "k long, t string, g string").repartition(7)
    got = corpus.with_ordinal(df, "k").orderBy("k").collect()
    assert [r.ordinal for r in got] == list(range(50))
    a = integrity.content_digest(df, "k", "t", ["g"]).first().digest
    assert a == integrity.content_digest(df.repartition(2), "k", "t", ["g"]).first().digest
    assert a != integrity.content_digest(df.withColumn("t", F.upper("t")), "k", "t", ["g"]).first().digest


def test_fragments_and_windows(spark):
    df = spark.createDataFrame([(1, "abc"), (2, ""), (3, None), (4, "x" * 40)], "id long, text string")
    got = {}
    for r in corpus.fragments(df, "id").collect():
        got.setdefault(r.id, []).append(r.gram)
    assert got == {1: ["abc"], 2: [""], 4: ["x" * 16]}
    for kind, extra in (("tokens", None), ("hits", "“"), ("barriers", ("q", "abcdefghijklmnop "))):
        text = "the “first” words of it\nqa abc def ghi jkl mno pab cde fgh\nand more words here for the test"
        src = spark.createDataFrame([(1, text), (2, None)], "id long, text string")
        rows = corpus.excerpt_windows(src, "id", kind, extra=extra).collect()
        assert rows and all(text[r.start : r.end] == r.text and 20 <= len(r.text) <= 25 for r in rows)


def test_character_counts_of_empty(spark):
    assert corpus.character_counts(spark.createDataFrame([(None,), ("",)], "text string")).count() == 0


def test_integrity(spark):
    df = spark.createDataFrame([(1, "a"), (1, None)], "k long, v string")
    assert {r.check: r.violations for r in integrity.violations(df, {"v": F.col("v") == "a"}).collect()} == {"v": 1}
    assert integrity.manifest_differences({"a": "1", "b": "2"}, {"a": "1", "b": "3", "c": "4"}) == ["b", "c"]
    assert integrity.run_identity({"a": "1", "b": "2"}) == integrity.run_identity({"b": "2", "a": "1"})


def test_records_prefixes_and_arguments(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", None)], "k string, n int")
    b = spark.createDataFrame([("x", 1), ("y", 3)], "k string, n int")
    assert {tuple(r) for r in integrity.checked_records(a, b, "k", "n").collect()} == {("y", "different"), ("z", "missing")}
    assert {tuple(r) for r in integrity.prefix_mismatches(a, b, "k", ["n"]).collect()} == {("y", "different"), ("z", "unplanned")}
    assert integrity.checked_exclusions(["b.pdf", "a.pdf"]) == ["a.pdf", "b.pdf"]
    for bad in (["a.pdf", "a.pdf"], ["x/a.pdf"], ["a.txt"]):
        try:
            integrity.checked_exclusions(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
    integrity.positive(goal=1)
    for bad in (0, -1, 1.5, True):
        try:
            integrity.positive(goal=bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_selector_sequences(spark):
    docs = spark.createDataFrame([(1, "葛\U000e0101と葛\U000e0101、辻\U000e0100"), (2, "葛\U000e0101a\U000e0101葛"), (3, None)], "doc_id long, text string")
    registry = spark.createDataFrame([("葛\U000e0101",)], "sequence string")
    found = corpus.selector_counts(docs, registry)
    assert {tuple(r) for r in found.collect()} == {("葛\U000e0101", 3, 2, True), ("辻\U000e0100", 1, 1, False)}
    counts = {r.character: r.standalone_occurrences for r in corpus.standalone_counts(corpus.character_counts(docs), found).collect()}
    assert counts["葛"] == 1 and counts["辻"] == 0 and counts["a"] == 1
