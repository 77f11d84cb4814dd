"""Connected components over pair tables: hash-to-min and random contraction.

Names become integers once; all rounds work on rows of two longs, so every aggregate is a hash aggregate. Both work on
rows only (no cluster is ever held in one array or task), write every round to the shared folder and look at nothing
but counts on the driver. Joins meet hot keys (a component of a third of all nodes has one minimum) on one side only,
the other side being unique by key, so adaptive execution can split them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import Workspace
from .terms import dictionary


def _order(turn: int, node: Column) -> Column:
    """A fresh random order of longs. For a fixed turn it maps longs one to one, so the image stands for the node and the
    least image is the first node."""
    return F.xxhash64(F.lit(turn), node)


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def numbered(pairs: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(names, edges): names (term, term_id) of all non-null names of pairs (a, b), numbered in their order, and the pairs
    with both sides filled as numbers."""
    pairs = pairs.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))
    every = pairs.select(F.explode(F.array("a", "b")).alias("term")).where("term is not null")
    names = work.write(dictionary(every, work), "names")
    number = lambda c: names.select(F.col("term").alias(c), F.col("term_id").alias(f"{c}_"))
    edges = pairs.where("a is not null and b is not null").join(number("a"), "a").join(number("b"), "b").select(F.col("a_").alias("a"), F.col("b_").alias("b"))
    return names, edges


def hash_to_min(edges: DataFrame, work: Workspace) -> DataFrame:
    """Rows (node, component) for edges (a, b) of longs; the component is its least node.

    Nodes go by their images in one random order. Each node v keeps a set of rows (v, u). A round finds the least u of
    each v, sends the whole set to that least node and the least node to every u, and removes repeats. It is stable
    when every node but the least one of a component holds that least one alone. Self-links give single nodes;
    repeated and reversed rows change nothing, no rows give no rows.
    """
    placed = edges.select(_order(0, F.col("a")).alias("a"), _order(0, F.col("b")).alias("b"))
    both = _both_ways(placed)
    state = work.write(both.unionByName(both.select("a", F.col("a").alias("b"))).select(F.col("a").alias("v"), F.col("b").alias("u")).distinct(), "clusters")
    seen = None
    while True:
        least = state.groupBy("v").agg(F.min("u").alias("m"))
        sent = state.join(least, "v")
        moved = sent.select(F.col("m").alias("v"), "u").unionByName(sent.select(F.col("u").alias("v"), F.col("m").alias("u")))
        state = work.write(moved.distinct(), "clusters")
        now = state.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("v", "u")).alias("s")).first()
        if now == seen:
            break
        seen = now
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("v", _order(0, F.col("node")))
    rooted = work.write(nodes.join(state.groupBy("v").agg(F.min("u").alias("root")), "v").select("node", "root"), "rooted")
    return rooted.join(rooted.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")


def contract(edges: DataFrame, work: Workspace) -> DataFrame:
    """Rows (node, component) for edges (a, b) of longs by randomised contraction; the component is its least node.

    In each round every vertex goes by its image in a fresh random order and hooks to the least one of itself and its
    neighbours; edges are relabelled by these hooks, loops and repeats go, and the hooks are kept. When no edge is left
    the hooks are followed backwards, round by round. The graph shrinks by a constant factor a round in expectation
    whatever its shape, so chains of any length need logarithmically many rounds.

    Nodes that occur in no pair of two different nodes are absent.
    """
    def placed(df: DataFrame, turn: int) -> DataFrame:
        a, b = _order(turn, F.col("a")), _order(turn, F.col("b"))
        return df.where("a <> b").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()

    live = work.write(placed(edges, 0), "edges")
    hooks: list[DataFrame] = []
    while not live.isEmpty():
        turn = len(hooks)
        ends = _both_ways(live)
        hook = work.write(ends.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("r")).select("u", F.least("u", "r").alias("r")), f"hooks{turn}")
        hooks.append(hook)
        end = lambda c: hook.select(F.col("u").alias(c), F.col("r").alias(f"{c}_"))  # noqa: B023,E731
        live = work.write(placed(live.join(end("a"), "a").join(end("b"), "b").select(F.col("a_").alias("a"), F.col("b_").alias("b")), turn + 1), "edges")
    nodes = edges.where("a <> b").select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if not hooks:
        return nodes.select("node", F.col("node").alias("component"))
    # A root is known by its image and the turn of that image.
    roots = hooks[-1].withColumn("t", F.lit(len(hooks) - 1))
    for turn in range(len(hooks) - 2, -1, -1):
        # A root of this round may hook on in the next one, under its image there.
        later = roots.select(F.col("u").alias("next"), F.col("r").alias("last"), "t")
        roots = work.write(hooks[turn].withColumn("next", _order(turn + 1, F.col("r"))).join(later, "next", "left").select("u", F.coalesce("last", "next").alias("r"), F.coalesce("t", F.lit(turn + 1)).alias("t")), "roots")
        work.drop(f"hooks{turn}")
    rooted = work.write(nodes.withColumn("u", _order(0, F.col("node"))).join(roots, "u").select("node", F.col("r").alias("root"), "t"), "rooted")
    return rooted.join(rooted.groupBy("root", "t").agg(F.min("node").alias("component")), ["root", "t"]).select("node", "component")


def named(names: DataFrame, found: DataFrame) -> DataFrame:
    """(node, component) as names, of every name; those in no row of found are components of their own."""
    own = names.join(found.withColumnRenamed("node", "term_id"), "term_id", "left").select(F.col("term").alias("node"), F.coalesce("component", "term_id").alias("c"))
    return own.join(names.select(F.col("term_id").alias("c"), F.col("term").alias("component")), "c").select("node", "component")


def group_keys(pairs: DataFrame, left: str = "image_a", right: str = "image_b") -> DataFrame:
    """Rows (image, group_key): every name on either side with the least name of all it is linked to.

    Names linked to nothing, or only to themselves, are their own group. A null side links nothing.
    """
    work = Workspace(pairs.sparkSession)
    names, edges = numbered(pairs.select(F.col(left).alias("a"), F.col(right).alias("b")), work)
    # Names are numbered in their order, so the least number is the least name.
    return named(names, contract(work.write(edges, "pairs"), work)).select(F.col("node").alias("image"), F.col("component").alias("group_key"))
