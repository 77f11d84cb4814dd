"""Splits that keep tied records together: components by hash-to-min, then weighted rendezvous hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import Workspace
from .components import hash_to_min, named, numbered


def document_name(path: Column) -> Column:
    """The part after the last slash or backslash; null and empty names are null."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.when(path.isNull() | (name == ""), F.lit(None)).otherwise(name)


def tied_records(labels: DataFrame) -> DataFrame:
    """(label_id, split_group, split, doc, node, component) of every row of labels.

    Documents and split groups are tied by each row that names both. A row that names one belongs to that one's
    component; a row that names neither is a component of its own (`r:` and its label_id). A component goes by the least
    name in it, documents (`d:`) before groups (`g:`).
    """
    doc = document_name(F.col("source_pdf"))
    rows = labels.select("label_id", "split_group", "split", doc.alias("doc")).withColumn("d", F.concat(F.lit("d:"), "doc")).withColumn("g", F.concat(F.lit("g:"), "split_group"))
    work = Workspace(labels.sparkSession)
    names, edges = numbered(rows.select(F.coalesce("d", "g").alias("a"), F.coalesce("g", "d").alias("b")).distinct(), work)
    found = named(names, hash_to_min(work.write(edges, "ties"), work))
    rows = rows.withColumn("node", F.coalesce("d", "g", F.concat(F.lit("r:"), F.col("label_id").cast("string")))).drop("d", "g")
    return rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def target_weights(targets: DataFrame) -> dict[str, float]:
    """Share of each split, all together 1, from (split, target_share), a parameter table of a few rows. Null, negative and
    zero shares are left out; repeated splits add up."""
    rows = targets.where("split is not null and target_share > 0").groupBy("split").agg(F.sum("target_share").alias("w")).orderBy("split").collect()
    whole = sum(r.w for r in rows)
    return {r.split: r.w / whole for r in rows}


def rendezvous(key: Column, weights: dict[str, float], seed: str = "split") -> Column:
    """The split that wins the weighted rendezvous for a key.

    Each split scores -weight / ln(u) with u in (0, 1) from the digest of seed, split and key, so a key moves only when
    its own split's weight falls or another's rises. Without weights there is no winner.
    """
    if not weights:
        return F.lit(None).cast("string")
    scored = []
    for split, w in sorted(weights.items()):
        u = (F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.lit(split), key), 256), 1, 13), 16, 10).cast("double") + 1) / float((1 << 52) + 1)
        scored.append(F.struct((F.lit(-float(w)) / F.ln(u)).alias("score"), F.lit(split).alias("split")))
    return (F.greatest(*scored) if len(scored) > 1 else scored[0])["split"]


#: Components with more than this share of all records are placed one by one; there are fewer than 1 / LARGE of them.
LARGE = 0.01


def placed(sizes: DataFrame, shares: dict[str, float]) -> tuple[dict[str, str], dict[str, float]]:
    """(split of each large component, share of all records that each split has room left for).

    The largest comes first and goes where most room is left, ties by name; a hash could put a component of a third of
    all records into a split of a tenth.
    """
    whole = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    room, where = dict(shares), {}
    for r in sizes.where(F.col("n") > LARGE * whole).orderBy(F.desc("n"), "component").collect():
        where[r.component] = max(sorted(room), key=room.get)
        room[where[r.component]] -= r.n / whole
    left = {s: p for s, p in room.items() if p > 0}
    return where, {s: p / sum(left.values()) for s, p in left.items()}


def calibrated(sizes: DataFrame, shares: dict[str, float], tolerance: float = 0.002, rounds: int = 25) -> dict[str, float]:
    """Rendezvous weights under which the splits' shares of records, not of components, come nearest to `shares`.

    sizes (component, n). A split that got too much loses weight, one that got too little gains; the best weights met are
    kept. Each round is one sum over the components; the driver sees a sum per split.
    """
    best, least, weights = dict(shares), None, dict(shares)
    for _ in range(rounds):
        got = dict(sizes.groupBy(rendezvous(F.col("component"), weights).alias("split")).agg(F.sum("n").alias("n")).collect())
        whole = sum(got.values())
        if not whole:
            return best
        error = max(abs(got.get(s, 0) / whole - p) for s, p in shares.items())
        if least is None or error < least:
            best, least = dict(weights), error
        if error <= tolerance:
            break
        weights = {s: w * min(4.0, max(0.25, (shares[s] / max(got.get(s, 0) / whole, 1e-9)) ** 0.7)) for s, w in weights.items()}
        top = sum(weights.values())
        weights = {s: w / top for s, w in weights.items()}
    return best


def assign_splits(labels: DataFrame, targets: DataFrame, by_records: bool = True) -> DataFrame:
    """(label_id, document, split_group, component, old_split, new_split) for every row of labels.

    With by_records, large components are placed where there is room for them and the rendezvous weights of all others are
    calibrated so that the records of the splits meet the target shares as nearly as whole components allow; otherwise
    the targets are the weights, and components meet them.
    """
    rows = tied_records(labels)
    weights = target_weights(targets)
    winner = rendezvous(F.col("component"), weights)
    if by_records and weights:
        work = Workspace(labels.sparkSession)
        rows = work.write(rows, "tied")
        sizes = work.write(rows.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "sizes")
        where, room = placed(sizes, weights)
        winner = rendezvous(F.col("component"), calibrated(sizes.where(~F.col("component").isin(list(where))), room or weights))
        if where:
            winner = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for cs in where.items() for x in cs]), F.col("component")), winner)
    return rows.select("label_id", F.col("doc").alias("document"), "split_group", "component", F.col("split").alias("old_split"), winner.alias("new_split"))


def broken_ties(labels: DataFrame) -> DataFrame:
    """(source_pdf): documents of components that already carry more than one split."""
    rows = tied_records(labels)
    broken = rows.where("split is not null").groupBy("component").agg((F.min("split") != F.max("split")).alias("broken")).where("broken").select("component")
    return rows.where("doc is not null").select(F.col("doc").alias("source_pdf"), "component").distinct().join(broken, "component", "left_semi").select("source_pdf").distinct()


def split_shares(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """(split, target_share, records, components, share, largest): the shares of records that the splits reached beside
    those asked for (which add up to 1 here), and the share that each split's largest component has of all records: what
    one component holds cannot be divided, so a split can miss its target by as much."""
    wanted = targets.where("split is not null and target_share > 0").groupBy("split").agg(F.sum("target_share").alias("w"))
    wanted = wanted.crossJoin(F.broadcast(wanted.agg(F.sum("w").alias("all_")))).select("split", (F.col("w") / F.col("all_")).alias("target_share"))
    parts = assigned.groupBy(F.col("new_split").alias("split"), "component").agg(F.count(F.lit(1)).alias("n"))
    got = parts.groupBy("split").agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("components"), F.max("n").alias("most"))
    whole = got.agg(F.sum("records").alias("whole"))
    return wanted.join(got, "split", "left").crossJoin(F.broadcast(whole)).select("split", "target_share", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("components", F.lit(0)).alias("components"), (F.coalesce("records", F.lit(0)) / F.col("whole")).alias("share"), (F.coalesce("most", F.lit(0)) / F.col("whole")).alias("largest"))
