"""Checks that return violations, set comparison, content digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import digest


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, violations): how many rows break each rule, all rules in one pass; a null outcome counts as broken."""
    sums = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"c{i}") for i, ok in enumerate(checks.values())])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"c{i}").alias("violations")) for i, name in enumerate(checks)])).alias("x")).select("x.*")


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def set_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): added and removed keys."""
    a, b = before.select(key).distinct(), after.select(key).distinct()
    return b.join(a, key, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, key, "left_anti").withColumn("change", F.lit("removed")))


def held_by_all(df: DataFrame, owner: str, item: str) -> DataFrame:
    """(item): items that every owner has."""
    pairs = df.select(owner, item).distinct()
    n = pairs.agg(F.count_distinct(owner).alias("owners"))
    return pairs.groupBy(item).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(n), F.col("n") == F.col("owners")).select(item)


def mixture(parts: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Union of parts with `source-<i>-` before each key, and the part's name."""
    tagged = [df.withColumn(key, F.concat(F.lit(f"source-{i}-"), F.col(key).cast("string"))).withColumn("part", F.lit(name)) for i, (name, df) in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def equal_counts(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """(equal): whether all parts have the same number of rows."""
    sizes = reduce(lambda a, b: a.unionByName(b), [df.agg(F.count(F.lit(1)).alias("n")) for _, df in parts])
    return sizes.agg((F.min("n") == F.max("n")).alias("equal"))


def content_digest(df: DataFrame, order: str, text: str, group: list[str]) -> DataFrame:
    """(group, rows, digest): a digest of each group's texts that depends on their order and on nothing else.

    Rows are digested with their position key, and the digests are combined by blocks of 4096 in order and then over
    the blocks, so no group is ever one string in one task.
    """
    rows = df.select(*group, F.col(order).alias("o"), digest(F.coalesce(F.col(text), F.lit("\x00"))).alias("h"))
    blocks = rows.groupBy(*group, F.floor(F.col("o") / 4096).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("o", "h"))).alias("x"))
    blocks = blocks.select(*group, "block", "n", F.sha2(F.array_join(F.transform("x", lambda e: e["h"]), ""), 256).alias("h"))
    return blocks.groupBy(*group).agg(F.sum("n").alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "h"))), lambda e: e["h"]), ""), 256).alias("digest"))


def run_identity(settings: dict[str, str]) -> str:
    """Digest of a run's settings, inputs and versions, whatever their order."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def manifest_differences(expected: dict[str, str], actual: dict[str, str]) -> list[str]:
    """Names whose digests differ or are missing on a side."""
    return sorted(k for k in expected.keys() | actual.keys() if expected.get(k) != actual.get(k))


def uncovered_grid(rows: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, problem): combinations of the two parameter lists that rows lack, and combinations in rows outside them."""
    wanted = left.select(a).distinct().crossJoin(right.select(b).distinct())
    there = rows.select(a, b).distinct()
    return wanted.join(there, [a, b], "left_anti").withColumn("problem", F.lit("missing")).unionByName(there.join(wanted, [a, b], "left_anti").withColumn("problem", F.lit("unexpected")))


def prefix_mismatches(written: DataFrame, planned: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """(order, problem): rows already written that the plan lacks or states otherwise; what a resumed run must not have."""
    w = written.select(order, F.struct(*columns).alias("w"))
    p = planned.select(order, F.struct(*columns).alias("p"))
    rows = w.join(p, order, "left")
    problem = F.when(F.col("p").isNull(), "unplanned").when(~F.col("w").eqNullSafe(F.col("p")), "different")
    return rows.select(order, problem.alias("problem")).where("problem is not null")


def checked_records(listed: DataFrame, records: DataFrame, key: str, value: str) -> DataFrame:
    """(key, problem): listed keys without record, and records whose value differs from the list's."""
    a, b = listed.select(key, F.col(value).alias("a")), records.select(key, F.col(value).alias("b"), F.lit(True).alias("there"))
    problem = F.when(F.col("there").isNull(), "missing").when(~F.col("a").eqNullSafe(F.col("b")), "different")
    return a.join(b, key, "left").select(key, problem.alias("problem")).where("problem is not null")


def checked_exclusions(names: list[str]) -> list[str]:
    """Sorted names of an exclusion list: unique base names that end in .pdf; anything else is a ValueError."""
    if len(set(names)) != len(names) or any(not n.endswith(".pdf") or "/" in n or "\\" in n for n in names):
        raise ValueError("exclusions are unique .pdf base names")
    return sorted(names)


def positive(**counts: int) -> None:
    """Reject counts that are not positive integers, by name."""
    for name, n in counts.items():
        if isinstance(n, bool) or not isinstance(n, int) or n < 1:
            raise ValueError(f"{name} must be a positive integer")


def in_range(low: float, high: float, **values: float) -> None:
    """Reject numbers outside [low, high], by name."""
    for name, v in values.items():
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not low <= v <= high:
            raise ValueError(f"{name} must lie between {low} and {high}")


def completion_problems(expected: DataFrame, actual: DataFrame, name: str, value: str) -> DataFrame:
    """(name, problem): settings or outputs (name, value) of a finished run against the expected ones: missing, different
    or unexpected; no rows mean that the run is complete and was configured alike."""
    a, b = expected.select(name, F.col(value).alias("a"), F.lit(True).alias("ea")), actual.select(name, F.col(value).alias("b"), F.lit(True).alias("eb"))
    problem = F.when(F.col("eb").isNull(), "missing").when(F.col("ea").isNull(), "unexpected").when(~F.col("a").eqNullSafe(F.col("b")), "different")
    return a.join(b, name, "full_outer").select(name, problem.alias("problem")).where("problem is not null")


def require_empty(df: DataFrame, message: str) -> None:
    """Raise if there is any row: the form in which a check stops a job. One row is fetched."""
    if found := df.take(1):
        raise ValueError(f"{message}: {found[0].asDict()}")


def guarded(df: DataFrame, key: str, columns: list[str], work, value: str = "string") -> DataFrame:
    """(key, status, error, result): work(*columns) of each row; an exception becomes a row with its text instead of
    ending the job. `value` is the result's type."""
    import pandas as pd

    kind = dict(df.dtypes)[key]

    def run(batches):
        for pdf in batches:
            rows = []
            for k, *args in pdf[[key, *columns]].itertuples(index=False, name=None):
                try:
                    rows.append((k, "complete", None, work(*args)))
                except Exception as e:  # noqa: BLE001
                    rows.append((k, "error", str(e), None))
            yield pd.DataFrame(rows, columns=[key, "status", "error", "result"])

    return df.select(key, *[c for c in columns if c != key]).mapInPandas(run, f"{key} {kind}, status string, error string, result {value}")


def held_out_pages(pages: DataFrame, excluded: DataFrame, uncertain: DataFrame) -> DataFrame:
    """pages without the excluded (document, page), plus `held`: whether the image is among the uncertain ones, which are
    kept apart instead of being used. A page with a null document or number is never excluded."""
    left = pages.join(excluded.select("document", "page").distinct(), ["document", "page"], "left_anti")
    return left.join(uncertain.select("image").distinct().withColumn("u_", F.lit(True)), "image", "left").withColumn("held", F.coalesce("u_", F.lit(False))).drop("u_")


def copied_files(source: DataFrame, copied: DataFrame) -> DataFrame:
    """(name, problem): files (name, sha256) of a data set against their copies: missing, different, unexpected."""
    return completion_problems(source, copied, "name", "sha256")


def suite_sets(base: list[str], suites: list[str], forbidden: str = "test") -> list[str]:
    """The sets of an evaluation suite in order; a repeated set or one of the forbidden split is a ValueError."""
    sets = [*base, *suites]
    if len(set(sets)) != len(sets) or any(forbidden in s.split("/") for s in sets):
        raise ValueError(f"suite sets are unique and none is of {forbidden}")
    return sets


def sample_violations(train: DataFrame, coverage: DataFrame, article_splits: DataFrame, valid_splits: DataFrame, longest: int) -> DataFrame:
    """(check, violations): the whole verification of a sample set, every check counted over all rows.

    Rows: unique ids and texts, digest, length within 1 to `longest` and as stated, span as long as the text, one line,
    anchor in the text, article of the training split, characters within the covered vocabulary, no overlap with
    another row of the article, no fragment that another row holds. Tables: valid coverage counts against a recount,
    articles listed once. A null where a value is needed counts as a violation.
    """
    from . import corpus, layout
    from ..functions import text as tx

    text = F.col("text")
    ids = train.groupBy("row_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(F.lit("unique_id").alias("check"), "violations")
    copies = train.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(F.lit("unique_text").alias("check"), "violations")
    one = violations(train, {
        "digest": F.col("sample_id").eqNullSafe(digest(text)),
        "length": (F.col("length") == F.length(text)) & F.length(text).between(1, longest),
        "span": F.col("end_offset") - F.col("start_offset") == F.length(text),
        "single_line": ~text.rlike(r"[\r\n\x{85}\x{2028}\x{2029}]"),
        "anchor": F.contains(text, F.col("anchor")),
    })

    def counted(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")

    split = train.join(valid_splits.select("article_id", "split"), "article_id", "left").where(~F.col("split").eqNullSafe("train"))
    chars = train.select("row_id", "shard", F.explode(F.array_distinct(tx.characters(text))).alias("character"))
    foreign = chars.join(coverage.where("character is not null").select("character").distinct(), "character", "left_anti").select("row_id").distinct()
    pairs = layout.span_pairs(train.where("article_id is not null"), "article_id", "row_id", "start_offset", "end_offset")
    overlap = pairs.select(F.explode(F.array("a", "b")).alias("row_id")).distinct()
    grams = corpus.fragment_keys(train, "row_id").distinct()
    shared = grams.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    fragment = grams.join(shared, ["h1", "h2"], "left_semi").select("id").distinct()
    last = coverage.where("character is not null").groupBy("shard", "character").agg(F.max(F.struct("counted_at", "coverage_id", "sample_count")).alias("x")).select("shard", "character", F.col("x.sample_count").alias("stated"))
    recount = chars.groupBy("shard", "character").agg(F.count_distinct("row_id").alias("n")).join(last, ["shard", "character"], "full_outer").where(~F.col("n").eqNullSafe(F.col("stated")))
    listed = repeated(article_splits.where("article_id is not null"), ["article_id"])
    parts = [ids, copies, one, counted("split", split), counted("vocabulary", foreign), counted("overlap", overlap), counted("fragment", fragment), counted("coverage", recount), counted("article_repeated", listed)]
    return reduce(lambda a, b: a.unionByName(b), parts)
