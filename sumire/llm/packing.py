"""Filling containers of fixed capacity: mixture-controlled packing by deficit round-robin.

Items are spread over groups of bounded size. In each group one queue per source feeds windows of containers: at each
window every source's deficit grows by its share of the window's tokens and it gives items while the deficit pays for
them, so every window has the target mixture. A window's items go best-fit, largest first, into containers; those that
nothing left in the group can fill further are closed with the window's number, and the items of the others go on to
the next window. What is open at a group's end, a bounded number of items, is passed on with the deficits to a group of
the next level, so no task ever holds more than a group.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import Workspace
from .tokens import token_counts

#: Items of a group of the first level, groups merged at the next, items that a group passes on at most (so groups of
#: all levels are bounded alike), containers of a window.
ITEMS = 20_000
MERGE = 16
KEEP = ITEMS // MERGE
WINDOW = 64

_SCHEMA = "capacity_id int, capacity long, grp long, win string, container string, id long, piece long, source string, share double, start long, tokens long, deficit double"


def best_fit(items: list[int], sizes: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """(space left, items) of containers, items taken largest first and put where the least space still holds them."""
    space: list[tuple[int, int]] = []
    inside: list[list[int]] = []
    for i in sorted(items, key=lambda i: (-sizes[i], i)):
        at = bisect_left(space, (sizes[i], -1))
        if at < len(space):
            left, box = space.pop(at)
        else:
            left, box = capacity, len(inside)
            inside.append([])
        inside[box].append(i)
        insort(space, (left - sizes[i], box))
    return [(left, inside[box]) for left, box in space]


class Queue:
    """Items of one source in order, and the size of the smallest still waiting."""

    def __init__(self, items: list[int], sizes: list[int]):
        self.items, self.at = items, 0
        self.least = list(accumulate((sizes[i] for i in reversed(items)), min))[::-1]

    def __bool__(self) -> bool:
        return self.at < len(self.items)

    def smallest(self) -> int:
        return self.least[self.at]


def pack_windows(sizes: list[int], sources: list[str], shares: dict[str, float], deficits: dict[str, float], capacity: int, window: int = WINDOW) -> tuple[list[tuple[int, list[int]]], list[tuple[int, list[int]]], int, dict[str, float]]:
    """(closed, open, windows, deficits): closed containers as (window, item numbers), containers still open at the end
    as (space, item numbers), and the deficits left. Every item is in one container, none exceeds the capacity.

    Deficits given are those carried from other groups; those returned are to be carried on. At most four windows of
    containers stay open from one window to the next; beyond that the fullest are closed.
    """
    queues: dict[str, Queue] = {}
    by_source: dict[str, list[int]] = {}
    for i, s in enumerate(sources):
        by_source.setdefault(s, []).append(i)
    order = sorted(by_source)
    queues = {s: Queue(by_source[s], sizes) for s in order}
    deficits = {s: deficits.get(s, 0.0) for s in order}
    closed: list[tuple[int, list[int]]] = []
    open_: list[tuple[int, list[int]]] = []
    turn = 0
    while any(queues.values()):
        whole = sum(shares.get(s, 0.0) for s in order if queues[s]) or 1.0
        pool = [i for _, box in open_ for i in box]
        for s in order:
            q = queues[s]
            if not q:
                continue
            deficits[s] += shares.get(s, 0.0) / whole * capacity * window or float(capacity)
            while q and deficits[s] >= sizes[q.items[q.at]]:
                deficits[s] -= sizes[q.items[q.at]]
                pool.append(q.items[q.at])
                q.at += 1
        waiting = min((q.smallest() for q in queues.values() if q), default=capacity + 1)
        open_ = []
        for left, box in best_fit(pool, sizes, capacity):
            # At the end, when nothing waits, all stay open: items of one may still fit into another group's.
            if left < waiting <= capacity:
                closed.append((turn, box))
            else:
                open_.append((left, box))
        extra = len(open_) - 4 * window
        if extra > 0:
            open_.sort(key=lambda x: x[0])
            closed += [(turn, box) for _, box in open_[:extra]]
            open_ = open_[extra:]
        turn += 1
    return closed, open_, turn, deficits


def pack(sizes: list[int], sources: list[str], shares: dict[str, float], deficits: dict[str, float], capacity: int, window: int = WINDOW) -> tuple[list[list[int]], dict[str, float]]:
    """(containers as lists of item numbers, window by window, deficits left): pack_windows where nothing follows."""
    closed, open_, _, left = pack_windows(sizes, sources, shares, deficits, capacity, window)
    return [box for _, box in closed] + [box for _, box in open_], left


def _group(level: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        carried = pdf[pdf.id.isna()]
        items = pdf[pdf.id.notna()].sort_values(["id", "piece"], ignore_index=True)
        capacity, capacity_id, grp = int(pdf.capacity.iloc[0]), int(pdf.capacity_id.iloc[0]), int(pdf.grp.iloc[0])
        sizes = items.tokens.astype("int64").tolist()
        names = items.source.fillna("").tolist()
        deficits = carried.groupby(carried.source.fillna("")).deficit.sum().to_dict()
        closed, open_, turns, left = pack_windows(sizes, names, dict(zip(names, items.share.tolist())), deficits, capacity)
        # The emptiest containers are passed on, as many as the next level has room for; the rest stay as they are.
        passed = 0
        for space, box in sorted(open_, key=lambda x: (-x[0], x[1])):
            if last or passed + len(box) > KEEP:
                closed.append((turns, box))
            else:
                passed += len(box)
        window: list[str | None] = [None] * len(sizes)
        label: list[str | None] = [None] * len(sizes)
        for n, (turn, box) in enumerate(closed):
            for i in box:
                window[i], label[i] = f"{capacity_id}-{level}-{grp}-{turn}", f"{capacity_id}-{level}-{grp}-{turn}-{n}"
        kept = list(left.items()) if passed else []
        more = [None] * len(kept)
        columns = {"win": window + more, "container": label + more, "source": items.source.tolist() + [s for s, _ in kept], "share": items.share.tolist() + more, "deficit": [None] * len(sizes) + [d for _, d in kept]}
        out = pd.DataFrame({"capacity_id": capacity_id, "capacity": capacity, "grp": grp, **columns}, index=range(len(sizes) + len(kept)))
        for c in ("id", "piece", "start", "tokens"):
            out[c] = pd.array(items[c].astype("int64").tolist() + more, dtype="Int64")
        return out[[c.split()[0] for c in _SCHEMA.split(", ")]]

    return run


def pack_documents(documents: DataFrame, capacities: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(capacity_id, win, container, doc_id, piece, start_token, tokens) of every document, for every capacity.

    A document over the capacity is cut into full containers of its own and a rest that is packed like a document;
    no other is cut. Null and empty texts (0 tokens) need no container: one row, container null, per capacity. A null
    source is a source of its own. `capacities` (capacity_id, capacity_tokens) is a parameter table; null and
    non-positive capacities are ignored. `win` is the window a container was filled in, null for the containers of cut
    documents and where there is none.

    Windows are held to `targets` (source, target_share), a parameter table; without it to the collection's own token
    shares, the one mixture that every window can have when every document is to be placed. A source without a target
    gives one container's worth a window; one that runs out leaves its share to the others.
    """
    work = Workspace(documents.sparkSession)
    sizes = work.write(token_counts(documents), "tokens")
    caps = capacities.where("capacity_tokens > 0").select(F.col("capacity_id").cast("int").alias("capacity_id"), F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    every = sizes.crossJoin(F.broadcast(caps))
    full = every.where("tokens > capacity").select("capacity_id", "capacity", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("tokens") / F.col("capacity")) - 1)).alias("piece"))
    none = F.lit(None).cast("string")
    full = full.select("capacity_id", none.alias("win"), F.concat_ws("-", "capacity_id", F.lit("d"), "id", "piece").alias("container"), F.col("id").alias("doc_id"), "piece", (F.col("piece") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("tokens"))
    empty = every.where("tokens = 0").select("capacity_id", none.alias("win"), none.alias("container"), F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start_token"), "tokens")
    cut = F.when(F.col("tokens") > F.col("capacity"), F.floor(F.col("tokens") / F.col("capacity"))).otherwise(F.lit(0)).cast("long")
    rest = every.where("tokens > 0").select("capacity_id", "capacity", "id", cut.alias("piece"), "source", (cut * F.col("capacity")).alias("start"), (F.col("tokens") - cut * F.col("capacity")).alias("tokens")).where("tokens > 0")
    totals = rest.groupBy("capacity_id").agg(F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("all_tokens"), F.ceil(F.count(F.lit(1)) / ITEMS).alias("groups"))
    shares = own_shares(rest, totals, targets)
    groups = {r.capacity_id: r.groups for r in totals.select("capacity_id", "groups").collect()}
    keyed = rest.withColumn("s", F.coalesce("source", F.lit(""))).join(shares, ["capacity_id", "s"]).join(F.broadcast(totals.select("capacity_id", "groups")), "capacity_id")
    todo = keyed.select("capacity_id", "capacity", F.pmod(F.xxhash64(F.lit("pack"), "id", "piece"), "groups").alias("grp"), none.alias("win"), none.alias("container"), "id", "piece", "source", "share", "start", "tokens", F.lit(None).cast("double").alias("deficit"))
    done, level, most = [], 0, max(groups.values(), default=0)
    while most:
        packed = work.write(todo.groupBy("capacity_id", "grp").applyInPandas(_group(level, most == 1), _SCHEMA), f"level{level}")
        done.append(packed.where("container is not null").select("capacity_id", "win", "container", F.col("id").alias("doc_id"), "piece", F.col("start").alias("start_token"), "tokens"))
        if most == 1:
            break
        todo = packed.where("container is null").withColumn("grp", F.floor(F.col("grp") / MERGE).cast("long"))
        level, most = level + 1, -(-most // MERGE)
    out = full.unionByName(empty)
    for d in done:
        out = out.unionByName(d)
    return out


def own_shares(rest: DataFrame, totals: DataFrame, targets: DataFrame | None) -> DataFrame:
    """(capacity_id, s, share): the share of a window's tokens that each source is to have."""
    shares = rest.groupBy("capacity_id", "source").agg(F.sum("tokens").alias("own")).join(F.broadcast(totals), "capacity_id").select("capacity_id", F.coalesce("source", F.lit("")).alias("s"), (F.col("own") / F.col("all_tokens")).alias("share"))
    if targets is None:
        return shares
    wanted = targets.where("target_share > 0").groupBy(F.coalesce("source", F.lit("")).alias("s")).agg(F.sum("target_share").alias("wanted"))
    return shares.join(wanted, "s", "left").select("capacity_id", "s", F.coalesce("wanted", F.lit(0.0)).alias("share"))


def fill_report(packed: DataFrame, capacities: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(capacity_id, capacity_tokens, containers, tokens, fill): how full each capacity's containers are on the whole.

    With documents, also windows and mixture_error: the mean over windows, weighted by tokens, of the share of a window's
    tokens that would have to change source for the window to have the mixture of all windows together.
    """
    used = packed.where("container is not null").groupBy("capacity_id").agg(F.count_distinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    out = used.join(F.broadcast(capacities.select("capacity_id", "capacity_tokens").distinct()), "capacity_id").select("capacity_id", F.col("capacity_tokens").cast("long").alias("capacity_tokens"), "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))
    if documents is None:
        return out
    source = documents.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("s"))
    cells = packed.where("win is not null").join(source, "doc_id").groupBy("capacity_id", "win", "s").agg(F.sum("tokens").alias("n"))
    shares = cells.groupBy("capacity_id", "s").agg(F.sum("n").alias("own"))
    shares = shares.join(F.broadcast(shares.groupBy("capacity_id").agg(F.sum("own").alias("all_"))), "capacity_id").select("capacity_id", "s", (F.col("own") / F.col("all_")).alias("p"))
    sizes = cells.groupBy("capacity_id", "win").agg(F.sum("n").alias("size"))
    # Sources absent from a window miss all they should have: 2 x error = sum of |n - p size| + size (1 - sum of p met).
    met = cells.join(sizes, ["capacity_id", "win"]).join(shares, ["capacity_id", "s"])
    wins = met.groupBy("capacity_id", "win", "size").agg(((F.sum(F.abs(F.col("n") - F.col("p") * F.col("size"))) + F.col("size") * (1 - F.sum("p"))) / 2).alias("moved"))
    errors = wins.groupBy("capacity_id").agg(F.count(F.lit(1)).alias("windows"), (F.sum("moved") / F.sum("size")).alias("mixture_error"))
    return out.join(errors, "capacity_id", "left")
