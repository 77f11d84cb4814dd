"""A varied subset: mini-batch k-means, square-root quotas per cluster, sampling within quotas."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import Workspace, spread

#: Dimensions for character pairs of the text and for the anchor.
TEXT_DIMS, ANCHOR_DIMS = 224, 32
DIMS = TEXT_DIMS + ANCHOR_DIMS
#: Mini-batches of one epoch: together all rows.
BATCHES = 4
#: Bits of the signature that marks families of similar texts.
FAMILY_BITS = 20
#: Buckets of scores in which the last turn's rows are counted; only those of one bucket are ranked.
SCORES = 4096
#: Slots that one cluster has on average, and bounds of the number of clusters.
SLOTS, LEAST_K, MOST_K = 32, 64, 4096
_MULT = np.uint64(0x9E3779B97F4A7C15)


def features(texts: list[str], anchors: list[str | None]) -> np.ndarray:
    """Unit vectors: square roots of hashed counts of character pairs, digits alike, and the hashed anchor."""
    n = len(texts)
    codes = np.frombuffer("".join(f"\n{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    codes[(codes >= 0x30) & (codes <= 0x39)] = 0x30
    doc = np.repeat(np.arange(n), [len(t) + 2 for t in texts])
    with np.errstate(over="ignore"):
        h = (codes[:-1].astype(np.uint64) << np.uint64(21) | codes[1:]) * _MULT
    inside = doc[:-1] == doc[1:]
    slot = (h >> np.uint64(40)).astype(np.int64) % TEXT_DIMS
    x = np.zeros((n, DIMS), np.float32)
    x[:, :TEXT_DIMS] = np.sqrt(np.bincount((doc[:-1] * TEXT_DIMS + slot)[inside], minlength=n * TEXT_DIMS).reshape(n, TEXT_DIMS))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)
    for i, a in enumerate(anchors):
        if a:
            x[i, TEXT_DIMS + sum(map(ord, a)) * 2654435761 % (1 << 32) * ANCHOR_DIMS // (1 << 32)] = 0.3
    return x


def _planes() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((TEXT_DIMS, FAMILY_BITS)).astype(np.float32)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)


def _sums(shared):
    """A partition's sum of vectors and number of rows per nearest centre."""

    def run(batches):
        centres = shared.value
        total, n = np.zeros_like(centres, np.float64), np.zeros(len(centres), np.int64)
        for batch in batches:
            x = features(batch.column("text").to_pylist(), batch.column("anchor").to_pylist())
            if len(x):
                own = _nearest(x, centres)
                np.add.at(total, own, x)
                n += np.bincount(own, minlength=len(centres))
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(n[met]), pa.array(list(total[met]), pa.list_(pa.float64()))], names=["cluster", "n", "vector"])

    return run


def _labels(shared):
    def run(batches):
        centres, planes = shared.value
        for batch in batches:
            x = features(batch.column("text").to_pylist(), batch.column("anchor").to_pylist())
            own = _nearest(x, centres) if len(x) else np.zeros(0, np.int64)
            bits = (x[:, :TEXT_DIMS] - x[:, :TEXT_DIMS].mean(axis=1, keepdims=True)) @ planes > 0
            family = bits @ (1 << np.arange(FAMILY_BITS))
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("article_id"), pa.array(own.astype(np.int32)), pa.array(family.astype(np.int64))], names=["row_id", "article_id", "cluster", "family"])

    return run


def fit_centres(rows: DataFrame, k: int, sample: int = 4096) -> np.ndarray:
    """Centres by mini-batch k-means over all rows (row_id, text, anchor, batch), one pass over BATCHES batches of which
    each is a folder of its own, so a batch reads no row of another.

    It starts from k far-apart vectors of a bounded sample (`sample` rows of least hash). Each batch is summed by
    cluster in the executors; k x DIMS sums come to the driver, and each centre moves by its share of all rows seen.
    """
    spark = rows.sparkSession
    first = rows.select(F.xxhash64(F.lit("start"), "row_id").alias("h"), "row_id", "text", "anchor").orderBy("h", "row_id").limit(sample).toArrow()
    x = features(first.column("text").to_pylist(), first.column("anchor").to_pylist())
    if not len(x):
        return np.zeros((1, DIMS), np.float32)
    chosen, gap = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(k, len(x)) and gap.max() > 1e-9:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(1))
    centres, seen = x[chosen].astype(np.float64), np.ones(len(chosen))
    for b in range(BATCHES):
        batch = rows.where(F.col("batch") == b).select("text", "anchor")
        sums = batch.mapInArrow(_sums(spark.sparkContext.broadcast(centres.astype(np.float32))), "cluster int, n long, vector array<double>")
        flat = sums.select("cluster", "n", F.posexplode("vector").alias("dim", "v")).groupBy("cluster", "dim").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toArrow()
        total, n = np.zeros_like(centres), np.zeros(len(centres))
        total[flat.column("cluster").to_numpy(), flat.column("dim").to_numpy()] = flat.column("v").to_numpy()
        n[flat.column("cluster").to_numpy()] = flat.column("n").to_numpy()
        seen += n
        centres += (total - n[:, None] * centres) / seen[:, None]
    return centres.astype(np.float32)


def quotas(counts: dict[int, int], size: int) -> dict[int, int]:
    """Slots per cluster in proportion to the square root of its rows, none above its rows; unused slots go on to the others."""
    slots = dict.fromkeys(counts, 0)
    left = min(size, sum(counts.values()))
    while left > 0:
        open_ = [c for c in sorted(counts) if slots[c] < counts[c]]
        whole = sum(math.sqrt(counts[c]) for c in open_)
        given = 0
        for c in open_:
            more = min(counts[c] - slots[c], int(left * math.sqrt(counts[c]) / whole))
            slots[c] += more
            given += more
        if not given:
            for c in sorted(open_, key=lambda c: (-counts[c], c))[:left]:
                slots[c] += 1
                given += 1
        left -= given
    return slots


def up_to(rows: DataFrame, own: Column) -> DataFrame:
    """Rows (cluster, turn, score, row_id) of each cluster that come first by turn, score and row_id, as many as `own` says.

    Turns are counted to find the one in which the quota ends, that turn's rows are counted in buckets of the score, and
    only the rows of the bucket in which it ends are ranked. A cluster of any size and quota is never sorted as one.
    """
    quota = rows.groupBy("cluster", "turn").agg(F.count(F.lit(1)).alias("n")).withColumn("own", own)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("cluster").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = quota.withColumn("before", before).where(F.col("before") < F.col("own")).groupBy("cluster").agg(F.max(F.struct("turn", "before", "own")).alias("x"))
    ends = ends.select("cluster", F.col("x.turn").alias("last"), (F.col("x.own") - F.col("x.before")).alias("rest"))
    met = rows.join(F.broadcast(ends), "cluster")
    whole = met.where(F.col("turn") < F.col("last"))
    # An increasing function of the score with values below SCORES.
    final = met.where(F.col("turn") == F.col("last")).withColumn("bucket", F.floor(F.col("score") / (1 + F.col("score")) * SCORES).cast("int"))
    counts = final.groupBy("cluster", "bucket", "rest").agg(F.count(F.lit(1)).alias("n"))
    upto = F.coalesce(F.sum("n").over(Window.partitionBy("cluster").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = counts.withColumn("upto", upto).where(F.col("upto") < F.col("rest")).groupBy("cluster").agg(F.max(F.struct("bucket", "upto")).alias("x")).select("cluster", F.col("x.bucket").alias("edge"), F.col("x.upto").alias("upto"))
    near = final.join(F.broadcast(edge), "cluster")
    ranked = near.where(F.col("bucket") == F.col("edge")).withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy("score", "row_id"))).where(F.col("k") <= F.col("rest") - F.col("upto"))
    return whole.select(rows.columns).unionByName(near.where(F.col("bucket") < F.col("edge")).select(rows.columns)).unionByName(ranked.select(rows.columns))


def varied_subset(train: DataFrame, size: int, k: int | None = None) -> DataFrame:
    """(row_id, article_id, cluster, family, turn): `size` rows (all, if there are fewer) with text.

    Each cluster has a square-root quota. Within it families of similar texts (equal signatures) take turns, so a
    family of a third of all rows gets its second row only when every other family of its cluster has its first; rows
    of large articles come later, by the square root of the article's rows over the mean. Ties go by hash and row_id.
    Null texts are never chosen; null articles count as one article each row.

    There are as many clusters as give each SLOTS rows on average, unless `k` says otherwise. A score threshold cuts
    large families before they are ranked; quotas end by counts (up_to), not by sorting clusters. The texts are read once
    from the input and written once by batch; after that each is read twice.
    """
    work = Workspace(train.sparkSession)
    k = k or max(LEAST_K, min(MOST_K, size // SLOTS))
    rows = train.where("text is not null").select(F.col("row_id").cast("long").alias("row_id"), F.col("article_id").cast("string").alias("article_id"), "text", F.col("anchor").cast("string").alias("anchor"))
    rows = work.write(spread(rows).withColumn("batch", F.pmod(F.xxhash64(F.lit("batch"), "row_id"), F.lit(BATCHES)).cast("int")), "rows", by=["batch"])
    centres = fit_centres(rows, k)
    labelled = work.write(rows.mapInArrow(_labels(train.sparkSession.sparkContext.broadcast((centres, _planes()))), "row_id long, article_id string, cluster int, family long"), "labels")
    counts = {r.cluster: r["count"] for r in labelled.groupBy("cluster").count().collect()}
    slots = quotas(counts, size)
    most = max(slots.values(), default=0)
    articles = labelled.where("article_id is not null").groupBy("article_id").agg(F.count(F.lit(1)).alias("n"))
    mean = articles.agg(F.avg("n").alias("mean"))
    weights = articles.crossJoin(F.broadcast(mean)).select("article_id", F.least(F.lit(1.0), F.sqrt(F.col("mean") / F.col("n"))).alias("w"))
    u = (F.pmod(F.xxhash64(F.lit("pick"), "row_id"), F.lit(1 << 40)) + 1) / float(1 << 40)
    scored = labelled.join(weights, "article_id", "left").withColumn("w", F.coalesce("w", F.lit(1.0))).withColumn("score", u / F.col("w"))
    # Of a large family only the rows below a score are ranked: about four times as many as could be chosen.
    families = scored.groupBy("cluster", "family").agg(F.count(F.lit(1)).alias("n_"), F.sum("w").alias("mass_"))
    near = scored.join(families, ["cluster", "family"]).where((F.col("n_") <= 4 * most + 20) | (F.col("score") * F.col("mass_") < 4 * most + 20))
    turns = near.withColumn("turn", F.row_number().over(Window.partitionBy("cluster", "family").orderBy("score", "row_id"))).where(F.col("turn") <= most)
    own = F.element_at(F.create_map(*[x for c, n in slots.items() for x in (F.lit(c), F.lit(n))]), F.col("cluster")) if slots else F.lit(0)
    return up_to(turns.select("row_id", "article_id", "cluster", "family", "turn", "score"), own).select("row_id", "article_id", "cluster", "family", "turn")


def subset_report(train: DataFrame, subset: DataFrame) -> DataFrame:
    """(kind, all_values, chosen_values, largest_share, random_values, random_largest_share): how many articles, anchors
    and first eight characters of texts there are and are covered, and the largest share of the subset that one of them
    holds; beside both what a random subset of the same size has."""
    work = Workspace(train.sparkSession)
    rows = train.where("text is not null").select("row_id", "article_id", "anchor", F.substring("text", 1, 8).alias("beginning"))
    chosen = work.write(subset.select("row_id"), "chosen")
    n = chosen.count()
    order = F.xxhash64(F.lit("random"), "row_id")
    drawn = rows.orderBy(order, "row_id").limit(n)
    out = None
    for kind in ("article_id", "anchor", "beginning"):
        part = rows.agg(F.lit(kind).alias("kind"), F.count_distinct(kind).alias("all_values"))
        for prefix, picked in (("", rows.join(chosen, "row_id")), ("random_", drawn)):
            per = picked.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
            share = (F.max(F.when(F.col(kind).isNotNull(), F.col("n"))) / F.sum("n")).alias(f"{prefix}largest_share")
            part = part.crossJoin(per.agg(F.count(kind).alias(f"{prefix or 'chosen_'}values"), share))
        out = part if out is None else out.unionByName(part)
    return out
