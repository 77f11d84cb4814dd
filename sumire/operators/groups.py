"""Groups of linked documents and splits that keep them whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.hashing import shuffle_key
from ..session import Workspace


def linked_groups(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, group): the least node each node is linked to, directly or through others.

    nodes (node), pairs (a, b) in either order. Each round every node takes the least label among its own and its
    neighbours' and then its label's label, so distances halve; it stops when no label changes.
    """
    work = Workspace(nodes.sparkSession)
    links = work.write(pairs.where("a is not null and b is not null and a <> b").select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("w")), F.struct(F.col("b").alias("u"), F.col("a").alias("w")))).alias("x")).select("x.u", "x.w").distinct(), "links")
    every = nodes.select("node").where("node is not null").unionByName(links.select(F.col("u").alias("node"))).distinct()
    labels = work.write(every.select("node", F.col("node").alias("label")), "labels")
    while True:
        offered = links.join(labels.select(F.col("node").alias("w"), "label"), "w").select(F.col("u").alias("node"), "label")
        least = labels.unionByName(offered).groupBy("node").agg(F.min("label").alias("label"))
        jump = least.join(labels.select(F.col("node").alias("label"), F.col("label").alias("further")), "label").select("node", F.least("label", "further").alias("label"))
        new = work.write(jump.join(labels.select("node", F.col("label").alias("old")), "node"), "next")
        changed = new.where("label <> old").limit(1).count()
        labels = work.write(new.select("node", "label"), "labels")
        if not changed:
            return labels.select("node", F.col("label").alias("group"))


def running_before(df: DataFrame, order: str, value: str) -> DataFrame:
    """df plus before: the sum of value over all rows earlier in the order, a column of evenly spread hex digits.

    Rows fall into 4096 buckets by their first three digits; a running sum over the buckets' totals and one inside
    each bucket replace a sort of everything in one task.
    """
    rows = df.withColumn("bucket_", F.substring(order, 1, 3))
    upto = rows.groupBy("bucket_").agg(F.sum(value).alias("n_")).withColumn("base_", F.coalesce(F.sum("n_").over(Window.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n_")
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("bucket_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("inside_", inside).join(F.broadcast(upto), "bucket_").withColumn("before", F.col("base_") + F.col("inside_")).drop("bucket_", "base_", "inside_")


def grouped_split(groups: DataFrame, seed: str, share: float = 0.1) -> DataFrame:
    """(group, pages, split): groups in hash order fill val, then test, to a share of all pages, the rest is train.

    groups (group, pages). A group goes to val while val has less than its target, to test likewise after it.
    """
    rows = running_before(groups.withColumn("order_", shuffle_key(F.col("group"), seed)), "order_", "pages")
    target = F.greatest(F.lit(1), F.bround(F.col("all_") * share, 0))
    rows = rows.crossJoin(F.broadcast(groups.agg(F.sum("pages").alias("all_")))).withColumn("val", F.col("before") < target)
    used = rows.where("val").agg(F.coalesce(F.sum("pages"), F.lit(0)).alias("used"))
    return rows.crossJoin(F.broadcast(used)).select("group", "pages", F.when(F.col("val"), "val").when(F.col("before") - F.col("used") < target, "test").otherwise("train").alias("split"))


def crossing(df: DataFrame, key: str, split: str) -> DataFrame:
    """(key, splits): keys that occur in more than one split."""
    return df.where(F.col(key).isNotNull() & F.col(split).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)
