"""Layout tables: line fragments, stacked characters, boxes, spans."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .corpus import with_ordinal


def islands(df: DataFrame, partition: list[str], order: list[str], joins_previous: Column) -> DataFrame:
    """df plus island: consecutive rows that join the row before them share a number within the partition.

    `joins_previous` may use lag columns over the same window; null counts as no.
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    flagged = df.withColumn("break_", (~F.coalesce(joins_previous, F.lit(False))).cast("int"))
    return flagged.withColumn("island", F.sum("break_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("break_")


def vertical_fragments(lines: DataFrame) -> DataFrame:
    """(page, source_block, island, text, lines, x0, y0, x1, y1): vertical fragments of one column joined.

    lines: (page, source_block, line, text, wmode, first_size, first_x, first_y, last_size, last_x, last_y, x0..y1),
    where first and last are the line's first and last characters. A line joins the one before if both are vertical,
    sizes are within a quarter, the column shifts by at most a fifth and the gap is at most 1.6 of the smaller size.
    """
    w = Window.partitionBy("page", "source_block").orderBy("line")
    prev = {c: F.lag(c).over(w) for c in ("wmode", "last_size", "last_x", "last_y")}
    size = F.least(prev["last_size"], F.col("first_size"))
    gap = F.col("first_y") - prev["last_y"]
    near = (F.col("wmode") == 1) & (prev["wmode"] == 1) & (size > 0) & (F.greatest(prev["last_size"], F.col("first_size")) <= size * 1.25) & (F.abs(F.col("first_x") - prev["last_x"]) <= size * 0.2) & (gap > 0) & (gap <= size * 1.6)
    rows = islands(lines, ["page", "source_block"], ["line"], near)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "")
    return rows.groupBy("page", "source_block", "island").agg(text.alias("text"), F.count(F.lit(1)).alias("lines"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


_STACKED = "page string, line long, text string, lines long, x0 double, y0 double, x1 double, y1 double, orientation string"


def _stacks(batches):
    """Lines come sorted by page and line; only the open run is held."""
    run, out = [], []

    def close():
        for part in [run] if len(run) >= 3 else [[r] for r in run]:
            first = part[0]
            out.append((first.page, first.line, "".join(r.text or "" for r in part), len(part), min(r.x0 for r in part), min(r.y0 for r in part), max(r.x1 for r in part), max(r.y1 for r in part), "vertical" if len(part) > 1 else first.orientation))
        run.clear()

    def fits(r) -> bool:
        last, head, size = run[-1], run[0], min(run[-1].size, r.size)
        alike = last.page == r.page and last.source_block == r.source_block and last.font == r.font
        return alike and size > 0 and max(last.size, r.size) <= 1.2 * size and abs(head.x - r.x) <= 0.15 * size and 0.5 * size <= r.y - last.y <= 1.4 * size

    def flush():
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in _STACKED.split(", ")])
        out.clear()
        return frame

    for pdf in batches:
        for r in pdf.itertuples(index=False):
            single = r.wmode == 0 and r.text is not None and len(r.text) == 1
            if run and not (single and fits(r)):
                close()
            run.append(r)
            if not single:
                close()
        yield flush()
    close()
    yield flush()


def stacked_characters(lines: DataFrame) -> DataFrame:
    """Runs of at least three single characters under each other become one vertical line; others stay.

    lines: (page, line, source_block, text, wmode, font, orientation, x, y, size, x0..y1). A character is compared with
    the one before and, across, with the head of its run, which no window function can do; pages are sorted into the
    partitions and streamed.
    """
    return lines.repartition("page").sortWithinPartitions("page", "line").mapInPandas(_stacks, _STACKED)


def visual_lines(chars: DataFrame) -> DataFrame:
    """chars (node, offset, text, x0, y0, x1, y1) plus island: a new line where the centre moves across by more than 0.45
    of the height, or the gap along is over 3 or under -1.5 heights. White space belongs to the line it is in."""
    w = Window.partitionBy("node").orderBy("offset")
    solid = F.trim("text") != ""
    last = F.last(F.when(solid, F.struct("x0", "y0", "x1", "y1")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = chars.withColumn("p", last)
    h = F.col("p.y1") - F.col("p.y0")
    apart = (F.abs((F.col("y0") + F.col("y1")) / 2 - (F.col("p.y0") + F.col("p.y1")) / 2) > h * 0.45) | (F.col("x0") - F.col("p.x1") > h * 3) | (F.col("x0") - F.col("p.x1") < -h * 1.5)
    return islands(rows, ["node"], ["offset"], ~(solid & F.coalesce(apart, F.lit(False))) & F.lag("offset").over(w).isNotNull()).drop("p")


def span_pairs(spans: DataFrame, group: str, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """(group, a, b): pairs of overlapping spans of one group, a < b.

    Overlapping spans meet in the bucket where the later one starts, so a group that holds a third of all spans is
    cut into buckets of its width; each pair is found once.
    """
    width = 256
    a = spans.select(group, F.col(key).alias("a"), F.col(start).alias("a0"), F.col(end).alias("a1")).where("a0 < a1")
    b = spans.select(group, F.col(key).alias("b"), F.col(start).alias("b0"), F.col(end).alias("b1")).where("b0 < b1")
    left = a.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("a0") / width), F.floor((F.col("a1") - 1) / width))))
    right = b.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("b0") / width), F.floor((F.col("b1") - 1) / width))))
    met = F.floor(F.greatest("a0", "b0") / width) == F.col("bucket")
    return left.join(right, [group, "bucket"]).where(met & (F.col("a") < F.col("b")) & (F.col("a0") < F.col("b1")) & (F.col("b0") < F.col("a1"))).select(group, "a", "b")


def adjacency_violations(spans: DataFrame, group: str, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Spans that begin before the one before them, in order of start, has ended."""
    w = Window.partitionBy(group).orderBy(start, key)
    return spans.withColumn("previous_end", F.lag(end).over(w)).where(F.col(start) < F.col("previous_end"))


def matched_boxes(truth: DataFrame, found: DataFrame, page: str, least: float = 0.5) -> DataFrame:
    """(page, t, f, iou): one-to-one matches of boxes (id, x0..y1) on a page with IoU of at least `least`, best first.

    A pair is kept when it is the best of both its boxes; pairs of boxes that are settled go, and again. Over one half a
    box can match one other at most, so there nothing is left after the first round; from one half down the rounds go on
    (selection.greedy_disjoint).
    """
    from ..functions.geometry import intersection_over_union
    from ..session import Workspace
    from .selection import greedy_disjoint

    t = truth.select(page, F.col("id").alias("t"), *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")])
    f = found.select(page, F.col("id").alias("f"), *[F.col(c).alias(f"f_{c}") for c in ("x0", "y0", "x1", "y1")])
    iou = intersection_over_union([F.col(f"t_{c}") for c in ("x0", "y0", "x1", "y1")], [F.col(f"f_{c}") for c in ("x0", "y0", "x1", "y1")])
    pairs = t.join(f, page).where((F.col("t_x0") < F.col("f_x1")) & (F.col("f_x0") < F.col("t_x1")) & (F.col("t_y0") < F.col("f_y1")) & (F.col("f_y0") < F.col("t_y1"))).select(page, "t", "f", iou.alias("iou")).where(F.col("iou") >= least)
    if least <= 0.5:
        work = Workspace(truth.sparkSession)
        pairs = work.write(pairs, "pairs")
        ident = F.concat_ws("/", page, "t", "f")
        claims = pairs.select(ident.alias("id"), F.struct((-F.col("iou")).alias("i"), "t", "f").alias("rank"), F.explode(F.array(F.concat_ws("/", F.lit("t"), page, "t"), F.concat_ws("/", F.lit("f"), page, "f"))).alias("claim"))
        return pairs.withColumn("id", ident).join(greedy_disjoint(claims, work), "id", "left_semi").select(page, "t", "f", "iou")
    best = lambda c: F.row_number().over(Window.partitionBy(page, c).orderBy(F.desc("iou"), "t", "f"))
    return pairs.withColumn("a", best("t")).withColumn("b", best("f")).where("a = 1 and b = 1").select(page, "t", "f", "iou")


def unique_near(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """left rows (id, x, y, size) with the value of the rows of right (value, x, y, size) within the tolerance in x, y
    and size; null unless exactly one distinct value is near.

    The band in x is an equi-join on cells of the tolerance's width and their neighbours.
    """
    cell = lambda c: F.floor(F.col(c) / tolerance)
    l = left.withColumn("cell", F.explode(F.array(cell("x") - 1, cell("x"), cell("x") + 1)))
    r = right.select(*keys, F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("size").alias("rsize"), "value", F.floor(F.col("x") / tolerance).alias("cell"))
    near = l.join(r, [*keys, "cell"]).where((F.abs(F.col("x") - F.col("rx")) < tolerance) & (F.abs(F.col("y") - F.col("ry")) < tolerance) & (F.abs(F.col("size") - F.col("rsize")) < tolerance))
    one = near.groupBy("id").agg(F.count_distinct("value").alias("n"), F.min("value").alias("v")).select("id", F.when(F.col("n") == 1, F.col("v")).alias("value"))
    return left.join(one, "id", "left")


def mutual_columns(prefixes: DataFrame, columns: DataFrame) -> DataFrame:
    """(page, prefix, column): rotated single glyphs and the one column below each, where neither has another candidate.

    prefixes (page, id, size, x0, y0, x1, y1), at least twice as high as wide; columns (page, id, size, first_x0,
    first_y0, first_x1), the box of their first glyph.
    """
    p = prefixes.where("y1 - y0 >= 2 * (x1 - x0)").select("page", F.col("id").alias("prefix"), F.col("size").alias("ps"), "x0", "x1", "y1")
    c = columns.select("page", F.col("id").alias("column"), F.col("size").alias("cs"), "first_x0", "first_y0", "first_x1")
    size, gap = F.least("ps", "cs"), F.col("first_y0") - F.col("y1")
    near = (size > 0) & (F.greatest("ps", "cs") <= 1.25 * size) & (F.abs((F.col("x0") + F.col("x1") - F.col("first_x0") - F.col("first_x1")) / 2) <= 0.25 * size) & (gap >= 0) & (gap <= 0.6 * size)
    pairs = p.join(c, "page").where(near)
    # A prefix with several columns proposes none, so only proposals count against a column.
    proposed = pairs.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("page", "prefix"))).where("n = 1")
    return proposed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("page", "column"))).where("n = 1").select("page", "prefix", "column")


def grid_coverage(cells: DataFrame, table: str) -> DataFrame:
    """(table, row, column, n): grid positions of cells (row, column, rowspan, colspan) covered other than once."""
    rows = cells.withColumn("r", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("rowspan") - 1))).withColumn("c", F.explode(F.sequence(F.col("column"), F.col("column") + F.col("colspan") - 1)))
    return rows.groupBy(table, F.col("r").alias("row"), F.col("c").alias("column")).agg(F.count(F.lit(1)).alias("n")).where("n <> 1")


def boundary_segments(cells: DataFrame, table: str) -> DataFrame:
    """(table, axis, line, at): distinct unit segments of the cells' borders; those inside a merged cell are absent."""
    r0, r1, c0, c1 = F.col("row"), F.col("row") + F.col("rowspan"), F.col("column"), F.col("column") + F.col("colspan")
    across = lambda line: F.transform(F.sequence(c0, c1 - 1), lambda i: F.struct(F.lit("h").alias("axis"), line.alias("line"), i.alias("at")))
    down = lambda line: F.transform(F.sequence(r0, r1 - 1), lambda i: F.struct(F.lit("v").alias("axis"), line.alias("line"), i.alias("at")))
    return cells.select(table, F.explode(F.concat(across(r0), across(r1), down(c0), down(c1))).alias("s")).select(table, "s.*").distinct()


def dash_segments(start: Column, end: Column, on: float, off: float, phase: float) -> Column:
    """array<struct<a, b>>: the inked pieces of a line from start to end under a dash pattern."""
    period = on + off
    first = F.floor((start - phase) / period).cast("int")
    last = F.floor((end - phase) / period).cast("int")
    piece = F.transform(F.sequence(first, last), lambda k: F.struct(F.greatest(start, phase + k * period).alias("a"), F.least(end, phase + k * period + on).alias("b")))
    return F.filter(piece, lambda x: x["a"] < x["b"])


def class_runs(df: DataFrame, key: str, text: str, own_class: str) -> DataFrame:
    """(key, run, western, text): runs of one class of characters (own_class, a pattern [...] of characters); white
    space and digits join the run before them, at the beginning the one after them. A text of nothing else is one run
    that is not of the class. Each row is cut where it lies.

    A run of the class begins with one of its characters and goes on over them and neutral ones; what lies between two
    such runs is the other kind.
    """
    letters = own_class[1:-1]
    pieces = F.regexp_extract_all(F.col(text), F.lit(rf"(?:^[\s0-9]*)?[{letters}][{letters}\s0-9]*|[^{letters}]+"), F.lit(0))
    flagged = F.transform(pieces, lambda p: F.struct(p.rlike(own_class).alias("western"), p.alias("text")))
    return df.select(key, F.posexplode(flagged).alias("run", "x")).select(key, (F.col("run") + 1).cast("long").alias("run"), "x.western", "x.text")


def batch_windows(df: DataFrame, order: str, size: Column, batch: int, window: int) -> DataFrame:
    """df plus batch: rows in order are taken in windows of `window` batches, sorted by size inside each, then cut."""
    rows = with_ordinal(df, order).withColumn("win", F.floor(F.col("ordinal") / (batch * window)))
    k = F.row_number().over(Window.partitionBy("win").orderBy(size, order)) - 1
    return rows.withColumn("batch", F.col("win") * window + F.floor(k / batch)).drop("ordinal", "win")


def near_boxes(boxes: DataFrame, page: str, key: str, reach: float = 0.0, cell: float = 64.0) -> DataFrame:
    """(page, a, b): pairs a < b of boxes (key, x0..y1) of a page that overlap across and, with `reach` more, along.

    Boxes meet in the cell of the page where the later edges of both begin, so a page of any number of boxes is cut
    into cells, and each pair is found once.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    cut = boxes.select(page, key, "x0", "y0", "x1", "y1", (F.col("y0") - reach).alias("low"), (F.col("y1") + reach).alias("high")).where("x0 <= x1 and y0 <= y1")
    placed = cut.withColumn("cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("cy", F.explode(F.sequence(at("low"), at("high"))))
    l, r = placed.alias("l"), placed.alias("r")
    same = (F.col(f"l.{page}") == F.col(f"r.{page}")) & (F.col("l.cx") == F.col("r.cx")) & (F.col("l.cy") == F.col("r.cy"))
    home = (F.floor(F.greatest("l.x0", "r.x0") / cell) == F.col("l.cx")) & (F.floor(F.greatest("l.low", "r.low") / cell) == F.col("l.cy"))
    near = (F.col("l.x0") < F.col("r.x1")) & (F.col("r.x0") < F.col("l.x1")) & (F.col("l.y0") < F.col("r.high")) & (F.col("r.low") < F.col("l.y1"))
    return l.join(r, same).where((F.col(f"l.{key}") < F.col(f"r.{key}")) & home & near).select(F.col(f"l.{page}").alias(page), F.col(f"l.{key}").alias("a"), F.col(f"r.{key}").alias("b"))


def hidden_tracks(cells: DataFrame, table: str, rows: str, columns: str) -> DataFrame:
    """(table, axis, track): inner and outer grid lines (0 to rows, 0 to columns) that no cell begins or ends at; a table
    whose grid can be seen has none."""
    size = cells.groupBy(table).agg(F.max(rows).alias("r"), F.max(columns).alias("c"))
    wanted = size.select(table, F.explode(F.concat(F.transform(F.sequence(F.lit(0), F.col("r")), lambda i: F.struct(F.lit("row").alias("axis"), i.alias("track"))), F.transform(F.sequence(F.lit(0), F.col("c")), lambda i: F.struct(F.lit("column").alias("axis"), i.alias("track"))))).alias("t")).select(table, "t.*")
    edge = lambda axis, at: F.struct(F.lit(axis).alias("axis"), at.alias("track"))
    seen = cells.select(table, F.explode(F.array(edge("row", F.col("row")), edge("row", F.col("row") + F.col("rowspan")), edge("column", F.col("column")), edge("column", F.col("column") + F.col("colspan")))).alias("t")).select(table, "t.*").distinct()
    return wanted.join(seen, [table, "axis", "track"], "left_anti")


# Kinds of random tilings, and the spans (down, across) that each allows.
TILINGS = {"plain": (), "column_merge": ((1, 2), (1, 3)), "row_merge": ((2, 1), (3, 1)), "mixed": ((1, 2), (1, 3), (2, 1), (3, 1)), "block_merge": ((1, 2), (1, 3), (2, 1), (3, 1), (2, 2), (2, 3), (3, 2), (3, 3))}


def tiling(rows: int, columns: int, mode: str, seed: int, tries: int = 100) -> list[tuple[int, int, int, int]]:
    """(row, column, rowspan, colspan) of cells that cover the grid once, with every grid line at some cell's edge and the
    merges the mode stands for. Merged blocks are thrown at free places first, single cells fill the rest; a draw that
    hides a grid line or has no such merge is thrown away. Where none of `tries` is good, the tiling is built instead
    (`_built`); a grid that has no such tiling is a ValueError."""
    rng = np.random.default_rng(seed)
    cells = range(rows * columns)
    # Bit r * columns + c is cell (r, c); of each span, the bits it covers from cell (0, 0).
    spans = [(down, across, sum(((1 << across) - 1) << i * columns for i in range(down))) for down, across in TILINGS[mode]]
    for _ in range(tries):
        free = (1 << len(cells)) - 1
        blocks: list[tuple[int, int, int, int]] = []
        for at in rng.permutation(len(cells)).tolist() if spans else ():
            r, c = divmod(at, columns)
            down, across, bits = spans[rng.integers(len(spans))]
            if rng.random() < 0.35 and r + down <= rows and c + across <= columns and not bits << at & ~free:
                free ^= bits << at
                blocks.append((r, c, down, across))
        high, wide = [b for b in blocks if b[2] > 1], [b for b in blocks if b[3] > 1]
        if not {"plain": True, "column_merge": wide, "row_merge": high, "mixed": high and wide, "block_merge": [b for b in high if b[3] > 1]}[mode]:
            continue
        blocks += [(*divmod(at, columns), 1, 1) for at in cells if free >> at & 1]
        seen = {r for b in blocks for r in (b[0], b[0] + b[2])}, {c for b in blocks for c in (b[1], b[1] + b[3])}
        if len(seen[0]) == rows + 1 and len(seen[1]) == columns + 1:
            return sorted(blocks)
    return _built(rows, columns, mode, rng)


def _built(rows: int, columns: int, mode: str, rng: np.random.Generator) -> list[tuple[int, int, int, int]]:
    """A tiling as `tiling` draws them, without redraws: the merges that the mode needs come first, each at a random place,
    then others are thrown; no block is set that would hide a grid line. A grid without any such tiling is a ValueError.

    A wide and a tall merge both fit into any grid that has room for them if the first lies along the side of three or
    more; all other modes need one merge, of the least size.
    """
    owner = -1 - np.arange(rows * columns).reshape(rows, columns)
    blocks: list[tuple[int, int, int, int]] = []

    def put(at: int, down: int, across: int) -> bool:
        r, c = divmod(at, columns)
        place = owner[r : r + down, c : c + across]
        if place.shape != (down, across) or (place >= 0).any():
            return False
        before = place.copy()
        place[:] = len(blocks)
        over, beside = owner[r : r + down], owner[:, c : c + across]
        shown = (over[1:] != over[:-1]).any(axis=1).all() and (beside[:, 1:] != beside[:, :-1]).any(axis=0).all()
        if shown:
            blocks.append((r, c, down, across))
        else:
            place[:] = before
        return bool(shown)

    both = ((1, 2), (2, 1)) if columns > 2 else ((2, 1), (1, 2))
    for down, across in {"plain": (), "column_merge": ((1, 2),), "row_merge": ((2, 1),), "mixed": both, "block_merge": ((2, 2),)}[mode]:
        if not any(put(int(at), down, across) for at in rng.permutation(rows * columns)):
            raise ValueError("no tiling shows every grid line")
    for at in rng.permutation(rows * columns) if TILINGS[mode] else ():
        if rng.random() < 0.35:
            put(int(at), *TILINGS[mode][rng.integers(len(TILINGS[mode]))])
    return sorted(blocks + [(int(r), int(c), 1, 1) for r, c in zip(*np.nonzero(owner < 0))])


def random_tilings(tables: DataFrame, table: str) -> DataFrame:
    """(table, row, column, rowspan, colspan) of tables (table, rows, columns, mode, seed): a seeded tiling of each."""
    kind = dict(tables.dtypes)[table]

    def run(batches):
        for pdf in batches:
            out = [(t, *cell) for t, r, c, mode, seed in pdf[[table, "rows", "columns", "mode", "seed"]].itertuples(index=False, name=None) for cell in tiling(int(r), int(c), mode, int(seed))]
            yield pd.DataFrame(out, columns=[table, "row", "column", "rowspan", "colspan"])

    return tables.select(table, "rows", "columns", "mode", "seed").mapInPandas(run, f"{table} {kind}, row int, column int, rowspan int, colspan int")
