"""Mixing sources to target weights by hash thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import Workspace
from .tokens import token_counts

#: Buckets of each of the two levels of the hash.
BUCKETS = 4096


def targets_of(mix_targets: DataFrame) -> DataFrame:
    """One row per source: shares of repeated sources add up, the least max_repeats holds; null, zero and negative shares go."""
    rows = mix_targets.where("source is not null and target_share > 0")
    return rows.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))


def shared_out(sources: dict[str, tuple[float, int]], total: int) -> dict[str, int]:
    """What each source (share, limit) gives of the total: in proportion to its share, never above its limit, what the
    limited ones lack being shared out among the rest in the same way."""
    given = dict.fromkeys(sources, 0)
    open_ = {s for s, (share, limit) in sources.items() if share > 0 and limit > 0}
    left = total
    while open_:
        whole = sum(sources[s][0] for s in open_)
        full = {s for s in open_ if left * sources[s][0] / whole >= sources[s][1]}
        for s in full or open_:
            given[s] = sources[s][1] if full else int(left * sources[s][0] / whole)
        if not full:
            break
        left -= sum(given[s] for s in full)
        open_ -= full
    return given


def budgets(sizes: DataFrame, mix_targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available, budget): tokens each source is to give.

    Without a total, the greatest is taken that every source that has any documents can meet at its share within
    max_repeats. A source without documents gets budget 0; the others keep their shares of the total that is left
    out of account for it (it is a share of what all sources with documents give).

    With a total, a source that cannot give its share within max_repeats gives all it can, and what it lacks is shared
    out among the others by their targets, until the total or every source's limit is reached.
    """
    own = targets_of(mix_targets).join(sizes.groupBy("source").agg(F.sum("tokens").alias("available")), "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    everyone = own.where("available > 0").agg(F.min(F.col("available") * F.col("max_repeats") / F.col("target_share")).alias("meets"))
    if total is not None:
        # One row per target source, a parameter table; the shares are settled on the driver.
        rows = own.orderBy("source").collect()
        given = shared_out({r.source: (r.target_share, r.available * r.max_repeats) for r in rows}, total)
        settled = mix_targets.sparkSession.createDataFrame([(s, n) for s, n in given.items()], "source string, budget long")
        return own.join(F.broadcast(settled), "source").select("source", "target_share", "max_repeats", "available", "budget")
    limit = F.col("meets")
    return own.crossJoin(F.broadcast(everyone)).select("source", "target_share", "max_repeats", "available", F.when(F.col("available") > 0, F.least(F.floor(F.col("target_share") * limit), F.col("available") * F.col("max_repeats"))).otherwise(F.lit(0)).cast("long").alias("budget"))


def thresholds(sizes: DataFrame, budget: DataFrame) -> DataFrame:
    """(source, copies, bucket, fine): documents below the threshold are taken copies + 1 times, the others copies times.

    Tokens are summed by source and hash bucket; the running sum over at most BUCKETS rows per source finds the
    bucket in which the budget ends; only documents of that one bucket are summed again by a second hash.
    """
    need = budget.where("available > 0").select("source", (F.col("budget") / F.col("available")).cast("long").alias("copies"), (F.col("budget") % F.col("available")).alias("rest"))

    def running(rows, level):
        sums = rows.groupBy("source", level).agg(F.sum("tokens").alias("n"))
        return sums.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy(level)))

    coarse = running(sizes, "bucket").join(need, "source")
    edge = coarse.groupBy("source", "copies", "rest").agg(F.min(F.when(F.col("upto") > F.col("rest"), F.col("bucket"))).alias("bucket"), F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))).alias("before"))
    edge = edge.select("source", "copies", F.coalesce("bucket", F.lit(BUCKETS)).alias("bucket"), (F.col("rest") - F.coalesce("before", F.lit(0))).alias("rest"))
    inside = sizes.join(F.broadcast(edge.select("source", "bucket")), ["source", "bucket"], "left_semi")
    finer = running(inside, "fine").join(edge.select("source", "rest"), "source").where(F.col("upto") <= F.col("rest")).groupBy("source").agg((F.max("fine") + 1).alias("fine"))
    return edge.join(finer, "source", "left").select("source", "copies", "bucket", F.coalesce("fine", F.lit(0)).alias("fine"))


def mix(documents: DataFrame, mix_targets: DataFrame, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen, report).

    chosen (doc_id, source, tokens, copies): every document of a source with a target that is used at least once.
    report (source, target_share, max_repeats, available_tokens, budget_tokens, documents, mixed_tokens, actual_share):
    one row per target, with the shares reached. Documents without source, of other sources or of 0 tokens are not
    used. A source is met to within the tokens of one fine bucket. The same input gives the same choice.
    """
    work = Workspace(documents.sparkSession)
    sizes = work.write(token_counts(documents), "tokens")
    budget = work.write(budgets(sizes, mix_targets, total), "budgets")
    order = F.xxhash64(F.lit("mix"), "id")
    hashed = sizes.where("source is not null and tokens > 0").withColumn("bucket", F.pmod(order, F.lit(BUCKETS)).cast("int")).withColumn("fine", F.pmod(F.shiftrightunsigned(order, 20), F.lit(BUCKETS)).cast("int"))
    found = work.write(thresholds(hashed, budget), "thresholds")
    below = (F.col("d.bucket") < F.col("t.bucket")) | ((F.col("d.bucket") == F.col("t.bucket")) & (F.col("d.fine") < F.col("t.fine")))
    # One row per target source: a parameter table.
    joined = hashed.alias("d").join(F.broadcast(found.alias("t")), F.col("d.source") == F.col("t.source"))
    chosen = joined.select(F.col("d.id").alias("doc_id"), F.col("d.source").alias("source"), "tokens", (F.col("copies") + below.cast("int")).alias("copies")).where("copies > 0")
    used = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    report = budget.join(used, "source", "left").select("source", "target_share", "max_repeats", F.col("available").alias("available_tokens"), F.col("budget").alias("budget_tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"))
    whole = report.agg(F.sum("mixed_tokens").alias("whole"))
    return chosen, report.crossJoin(F.broadcast(whole)).withColumn("actual_share", F.when(F.col("whole") > 0, F.col("mixed_tokens") / F.col("whole"))).drop("whole")
