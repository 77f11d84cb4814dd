import datetime
from collections import Counter

from pyspark.sql import functions as F

from sumire.llm import terms as tm


def test_counts_against_brute_force(spark):
    texts = ["a b a", "b c", "", "a" + " d" * 500, "ſ s S", "a"]
    df = spark.createDataFrame([(t.split(),) for t in texts] + [(None,), ([],), (["a", None],)], "words array<string>")
    got = {r.term: (r.occurrences, r.records) for r in tm.term_counts(tm.array_terms(df, "words")).collect()}
    occ, rec = Counter(), Counter()
    for t in texts + ["a"]:
        occ.update(t.split())
        rec.update(set(t.split()))
    assert got == {w: (occ[w], rec[w]) for w in occ}


def test_many_blocks_and_a_hot_term(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("term"), F.lit(1).alias("occurrences"), F.lit(1).alias("records"))
    got = tm.term_counts(df)
    assert got.count() == 20001 and got.where("term = 'hot'").first().records == 10000 and got.agg(F.sum("records")).first()[0] == 30000


def test_a_partition_of_more_rows_than_are_combined_at_once(spark):
    n = 2 * tm.COMBINE + 100_000
    few = spark.range(0, n, 1, 1).select(F.concat(F.lit("t"), F.col("id") % 1000).alias("term"), F.lit(1).alias("occurrences"), F.lit(1).alias("records"))
    got = tm.term_counts(few).collect()
    assert len(got) == 1000 and {(r.occurrences, r.records) for r in got} == {(n // 1000, n // 1000)}
    turns = F.when(F.col("id") < tm.COMBINE, F.col("id") % 10).when(F.col("id") < 2 * tm.COMBINE, F.col("id")).otherwise(3)
    got = {r.term: r.occurrences for r in tm.term_counts(spark.range(0, n, 1, 1).select(turns.cast("string").alias("term"), F.lit(1).alias("occurrences"), F.lit(1).alias("records"))).collect()}
    assert len(got) == tm.COMBINE + 10 and got["3"] == tm.COMBINE // 10 + 100_000 and got["4"] == tm.COMBINE // 10 and got[str(tm.COMBINE)] == 1


def test_dictionary_is_consecutive_and_ordered(spark):
    from sumire.session import Workspace

    df = spark.createDataFrame([(w,) for w in "zebra ape cat ape dog".split()], "term string")
    got = [(r.term, r.term_id) for r in tm.dictionary(df, Workspace(spark)).orderBy("term_id").collect()]
    assert got == [("ape", 0), ("cat", 1), ("dog", 2), ("zebra", 3)]


COVERAGE = "coverage_id long, shard string, character string, sample_count long, corpus_occurrences long, counted_at timestamp_ntz, term string"


def test_marks(spark):
    day = lambda d: datetime.datetime(2025, 1, d)
    train = spark.createDataFrame([(i, "e" if i < 10 else f"x{i // 3}" if i < 16 else None, "clash") for i in range(40)], "row_id long, anchor string, term string")
    rows = [
        (1, "s1", "a", 2, 5, day(2), ""), (2, "s1", "a", 90, 5, day(1), ""), (3, "s2", "a", 1, None, day(1), ""), (4, "s1", "b", 1, 1, day(1), ""), (5, "s1", "b", None, 1, day(2), ""),
        (6, "s1", "c", 2, 2, day(1), ""), (7, "s1", "c", 2, 2, day(1), ""), (8, "s1", None, 7, 7, day(1), ""), (9, None, "d", 1, 1, None, ""),
    ]
    got = {(r.field_name, r.term): (r.records, r.mark) for r in tm.anchor_and_character_terms(train, spark.createDataFrame(rows, COVERAGE)).collect()}
    assert got[("anchor", "e")] == (10, "common") and got[("anchor", "x3")][1] == "rare"
    assert got[("character", "a")] == (3, "common") and got[("character", "b")] == (0, "rare") and got[("character", "c")] == (2, "rare") and got[("character", "d")] == (1, "rare")
    assert not any(t is None for _, t in got)


def test_empty(spark):
    train = spark.createDataFrame([], "row_id long, anchor string")
    coverage = spark.createDataFrame([], COVERAGE)
    assert tm.anchor_and_character_terms(train, coverage).count() == 0
