"""Layout queries over page_lines, labels and spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as geo, text as tx
from ..operators import groups, layout as op
from ..session import table
from .registry import query

SEED = "20260921"
_BOX = "bbox[1] AS x0, bbox[2] AS y0, bbox[3] AS x1, bbox[4] AS y1"


def _lines(spark, d):
    box = [F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    return table(spark, d, "page_lines").select("line_id", "image", "source_pdf", "page", "source_block", "text", "orientation", "wmode", "font_name", *box)


_FRAGMENTS = f"""WITH l AS (SELECT image AS page, source_block, line_id AS line, coalesce(text, '') AS text, wmode, y1 - y0 AS size, x0, y0, x1, y1 FROM (SELECT *, {_BOX} FROM page_lines) WHERE image IS NOT NULL),
 p AS (SELECT *, lag(size) OVER w AS ps, lag(wmode) OVER w AS pw, lag(x0) OVER w AS px, lag(y0) OVER w AS py FROM l WINDOW w AS (PARTITION BY page, source_block ORDER BY line)),
 i AS (SELECT *, sum(CASE WHEN wmode = 1 AND pw = 1 AND least(ps, size) > 0 AND greatest(ps, size) <= least(ps, size) * 1.25 AND abs(x0 - px) <= least(ps, size) * 0.2 AND y0 - py > 0 AND y0 - py <= least(ps, size) * 1.6 THEN 0 ELSE 1 END) OVER (PARTITION BY page, source_block ORDER BY line) AS island FROM p)
 SELECT page, source_block, island::BIGINT AS island, string_agg(text, '' ORDER BY line) AS text, count(*)::BIGINT AS lines, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM i GROUP BY 1, 2, 3"""


@query(_FRAGMENTS)
def line_fragment_islands(spark, d):
    size = F.col("y1") - F.col("y0")
    rows = _lines(spark, d).where("image is not null").select(F.col("image").alias("page"), "source_block", F.col("line_id").alias("line"), F.coalesce("text", F.lit("")).alias("text"), "wmode", size.alias("first_size"), F.col("x0").alias("first_x"), F.col("y0").alias("first_y"), size.alias("last_size"), F.col("x0").alias("last_x"), F.col("y0").alias("last_y"), "x0", "y0", "x1", "y1")
    return op.vertical_fragments(rows)


@query()
def stacked_runs(spark, d):
    rows = _lines(spark, d).where("image is not null").select(F.col("image").alias("page"), F.col("line_id").alias("line"), "source_block", "text", "wmode", F.col("font_name").alias("font"), "orientation", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("y1") - F.col("y0")).alias("size"), "x0", "y0", "x1", "y1")
    return op.stacked_characters(rows)


@query("""WITH l AS (SELECT image AS page, line_id * 100000 AS first, text, length(text) AS n FROM page_lines WHERE image IS NOT NULL AND text <> ''),
 c AS (SELECT page, first, unnest(string_split(text, '')) AS text, generate_subscripts(string_split(text, ''), 1) - 1 AS k FROM l WHERE n < 3)
 SELECT page, first AS line, text, n::BIGINT AS lines FROM l WHERE n >= 3 UNION ALL SELECT page, first + k, text, 1 FROM c""")
def stacked_lines(spark, d):
    """The characters of every line under each other, each line at an x of its own: they must become that line again."""
    chars = _lines(spark, d).where("image is not null and text <> ''").select("image", "line_id", "source_block", "font_name", F.posexplode(tx.characters(F.col("text"))).alias("k", "text"))
    x, y = F.col("line_id") * 10.0, F.col("k") * 10.0
    rows = chars.select(F.col("image").alias("page"), (F.col("line_id") * 100_000 + F.col("k")).alias("line"), "source_block", "text", F.lit(0).alias("wmode"), F.col("font_name").alias("font"), F.lit("horizontal").alias("orientation"), x.alias("x"), y.alias("y"), F.lit(10.0).alias("size"), x.alias("x0"), y.alias("y0"), (x + 10).alias("x1"), (y + 10).alias("y1"))
    return op.stacked_characters(rows).select("page", "line", "text", "lines")


@query(f"""WITH c AS (SELECT image AS node, line_id AS "offset", text, {_BOX} FROM page_lines WHERE image IS NOT NULL AND text IS NOT NULL),
 p AS (SELECT *, lag("offset") OVER w AS po, last_value(CASE WHEN trim(text) <> '' THEN x1 END IGNORE NULLS) OVER b AS px1, last_value(CASE WHEN trim(text) <> '' THEN y0 END IGNORE NULLS) OVER b AS py0, last_value(CASE WHEN trim(text) <> '' THEN y1 END IGNORE NULLS) OVER b AS py1 FROM c WINDOW w AS (PARTITION BY node ORDER BY "offset"), b AS (PARTITION BY node ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 f AS (SELECT *, CASE WHEN po IS NULL OR (trim(text) <> '' AND coalesce(abs((y0 + y1) / 2 - (py0 + py1) / 2) > (py1 - py0) * 0.45 OR x0 - px1 > (py1 - py0) * 3 OR x0 - px1 < -(py1 - py0) * 1.5, false)) THEN 1 ELSE 0 END AS brk FROM p)
 SELECT node, "offset", (sum(brk) OVER (PARTITION BY node ORDER BY "offset"))::BIGINT AS island FROM f""")
def visual_lines(spark, d):
    rows = _lines(spark, d).where("image is not null and text is not null").select(F.col("image").alias("node"), F.col("line_id").alias("offset"), "text", "x0", "y0", "x1", "y1")
    return op.visual_lines(rows).select("node", "offset", "island")


@query(f"SELECT line_id, greatest(0.0, least(x0, 400.0)) AS x0, greatest(0.0, least(y0, 600.0)) AS y0, greatest(0.0, least(x1, 400.0)) AS x1, greatest(0.0, least(y1, 600.0)) AS y1, 0 <= x0 AND x0 < x1 AND x1 <= 400 AND 0 <= y0 AND y0 < y1 AND y1 <= 600 AS sane FROM (SELECT line_id, {_BOX} FROM page_lines)")
def box_clip(spark, d):
    w, h = F.lit(400.0), F.lit(600.0)
    c = F.col
    sane = geo.sane_box(c("x0"), c("y0"), c("x1"), c("y1"), w, h)
    return _lines(spark, d).select("line_id", geo.clip(c("x0"), w).alias("x0"), geo.clip(c("y0"), h).alias("y0"), geo.clip(c("x1"), w).alias("x1"), geo.clip(c("y1"), h).alias("y1"), sane.alias("sane"))


@query(f"WITH b AS (SELECT image, line_id, {_BOX} FROM page_lines) SELECT a.image, a.line_id AS a, b.line_id AS b FROM b a JOIN b ON a.image = b.image AND a.line_id < b.line_id WHERE a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 + 5 AND b.y0 - 5 < a.y1")
def box_overlap(spark, d):
    return op.near_boxes(_lines(spark, d), "image", "line_id", 5.0)


@query(f"""WITH t AS (SELECT image, line_id AS id, {_BOX} FROM page_lines WHERE image IS NOT NULL), f AS (SELECT image, id, x0 + 4 AS x0, y0 + 3 AS y0, x1 + 4 AS x1, y1 + 3 AS y1 FROM t),
 o AS (SELECT t.image, t.id AS t, f.id AS f, greatest(0, least(t.x1, f.x1) - greatest(t.x0, f.x0)) * greatest(0, least(t.y1, f.y1) - greatest(t.y0, f.y0)) AS i, (t.x1 - t.x0) * (t.y1 - t.y0) + (f.x1 - f.x0) * (f.y1 - f.y0) AS s FROM t JOIN f ON t.image = f.image),
 p AS (SELECT image, t, f, i / nullif(s - i, 0) AS iou FROM o WHERE i > 0), k AS (SELECT * FROM p WHERE iou >= 0.5),
 r AS (SELECT *, row_number() OVER (PARTITION BY image, t ORDER BY iou DESC, t, f) AS a, row_number() OVER (PARTITION BY image, f ORDER BY iou DESC, t, f) AS b FROM k)
 SELECT image, t, f, round(iou, 9) AS iou FROM r WHERE a = 1 AND b = 1""")
def iou_match(spark, d):
    t = _lines(spark, d).where("image is not null").select("image", F.col("line_id").alias("id"), "x0", "y0", "x1", "y1")
    f = t.select("image", "id", (F.col("x0") + 4).alias("x0"), (F.col("y0") + 3).alias("y0"), (F.col("x1") + 4).alias("x1"), (F.col("y1") + 3).alias("y1"))
    return op.matched_boxes(t, f, "image").withColumn("iou", F.round("iou", 9))


@query(f"WITH g AS (SELECT line_id AS id, source_pdf, font_name, {_BOX} FROM page_lines WHERE source_pdf IS NOT NULL AND font_name IS NOT NULL), n AS (SELECT a.id, count(DISTINCT b.x1) AS n, min(b.x1) AS v FROM g a JOIN g b ON a.source_pdf = b.source_pdf AND a.font_name = b.font_name WHERE abs(a.x0 - b.x0) < 2 AND abs(a.y0 - b.y0) < 2 AND abs((a.y1 - a.y0) - (b.y1 - b.y0)) < 2 GROUP BY 1) SELECT g.id, CASE WHEN n = 1 THEN v END AS value FROM g LEFT JOIN n ON g.id = n.id")
def glyph_tolerance(spark, d):
    g = _lines(spark, d).where("source_pdf is not null and font_name is not null").select(F.col("line_id").alias("id"), "source_pdf", "font_name", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("y1") - F.col("y0")).alias("size"), F.col("x1").alias("value"))
    return op.unique_near(g.drop("value"), g.drop("id"), ["source_pdf", "font_name"], 2.0).select("id", "value")


@query("""WITH b AS (SELECT l_orderkey AS page, l_linenumber AS id, 10.0 AS size, l_quantity AS x0, l_quantity + 5 AS x1, l_tax * 200 AS y0, l_tax * 200 + 10 AS y1, l_quantity + 1 AS f0, l_quantity + 6 AS f1, l_discount * 200 AS fy FROM lineitem),
 p AS (SELECT a.page, a.id AS prefix, b.id AS "column", count(*) OVER (PARTITION BY a.page, a.id) AS n FROM b a JOIN b ON a.page = b.page WHERE a.y1 - a.y0 >= 2 * (a.x1 - a.x0) AND abs((a.x0 + a.x1 - b.f0 - b.f1) / 2) <= 2.5 AND b.fy - a.y1 >= 0 AND b.fy - a.y1 <= 6),
 q AS (SELECT *, count(*) OVER (PARTITION BY page, "column") AS m FROM p WHERE n = 1) SELECT page, prefix, "column" FROM q WHERE m = 1""")
def mutual_columns(spark, d):
    q, t, c = F.col("l_quantity"), F.col("l_tax") * 200, F.col("l_discount") * 200
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("id"), F.lit(10.0).alias("size"), q.alias("x0"), (q + 5).alias("x1"), t.alias("y0"), (t + 10).alias("y1"), (q + 1).alias("first_x0"), (q + 6).alias("first_x1"), c.alias("first_y0"))
    return op.mutual_columns(rows, rows)


@query("SELECT a.article_id, a.row_id AS a, b.row_id AS b FROM train a JOIN train b ON a.article_id = b.article_id AND a.row_id < b.row_id WHERE a.start_offset < b.end_offset AND b.start_offset < a.end_offset AND a.start_offset < a.end_offset AND b.start_offset < b.end_offset")
def span_overlap_pairs(spark, d):
    return op.span_pairs(table(spark, d, "train").where("article_id is not null"), "article_id", "row_id", "start_offset", "end_offset")


@query("SELECT row_id, previous_end FROM (SELECT *, lag(end_offset) OVER (PARTITION BY article_id ORDER BY start_offset, row_id) AS previous_end FROM train WHERE article_id IS NOT NULL) WHERE start_offset < previous_end")
def interval_adjacency_violations(spark, d):
    return op.adjacency_violations(table(spark, d, "train").where("article_id is not null"), "article_id", "row_id", "start_offset", "end_offset").select("row_id", "previous_end")


@query(f"SELECT image, count(*)::BIGINT AS lines, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, to_json([[floor(min(x0))::INTEGER, floor(min(y0))::INTEGER], [floor(max(x1))::INTEGER, floor(min(y0))::INTEGER], [floor(max(x1))::INTEGER, floor(max(y1))::INTEGER], [floor(min(x0))::INTEGER, floor(max(y1))::INTEGER]])::VARCHAR AS polygon FROM (SELECT image, {_BOX} FROM page_lines) GROUP BY 1")
def bounding_union(spark, d):
    rows = _lines(spark, d).groupBy("image").agg(F.count(F.lit(1)).alias("lines"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return rows.withColumn("polygon", F.to_json(geo.polygon(*[F.floor(c).cast("int") for c in ("x0", "y0", "x1", "y1")])))


_NAME = r"nullif(regexp_extract(source_pdf, '([^/\\]*)$', 1), '')"


@query(f"SELECT split, count(*)::BIGINT AS pages, count(DISTINCT {_NAME})::BIGINT AS documents, count(DISTINCT split_group)::BIGINT AS groups, sum(line_count)::BIGINT AS boxes FROM labels GROUP BY 1")
def split_summary(spark, d):
    name = F.nullif(tx.basename(F.col("source_pdf")), F.lit(""))
    return table(spark, d, "labels").groupBy("split").agg(F.count(F.lit(1)).alias("pages"), F.count_distinct(name).alias("documents"), F.count_distinct("split_group").alias("groups"), F.sum("line_count").alias("boxes"))


@query("SELECT kind, value, count(*)::BIGINT AS lines FROM (SELECT unnest(['orientation', 'font_name', 'wmode']) AS kind, unnest([orientation, font_name, wmode::VARCHAR]) AS value FROM page_lines) GROUP BY 1, 2")
def distribution_report(spark, d):
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in ("orientation", "font_name", "wmode")]))
    return table(spark, d, "page_lines").select(each.alias("x")).groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("lines"))


@query("SELECT split_group, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM labels WHERE split_group IS NOT NULL AND split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_integrity(spark, d):
    """Split groups that lie in several splits (no single document does in this data)."""
    return groups.crossing(table(spark, d, "labels"), "split_group", "split").select("split_group", F.array_join("splits", ",").alias("splits"))


@query(r"SELECT label_id, regexp_extract(image, '^(.+)_page-(\d+)_page\.png$', 1) || '.pdf' AS document, regexp_extract(image, '^(.+)_page-(\d+)_page\.png$', 2)::INTEGER AS page FROM labels WHERE regexp_matches(image, '^(.+)_page-(\d+)_page\.png$')")
def image_page_rule(spark, d):
    return table(spark, d, "labels").select("label_id", tx.page_source(F.col("image")).alias("s")).where("s is not null").select("label_id", "s.document", "s.page")


@query(f"SELECT label_id FROM labels WHERE {_NAME} IS NULL OR {_NAME} NOT IN (SELECT {_NAME} FROM labels WHERE split = 'test' AND {_NAME} IS NOT NULL)")
def evaluation_exclusion(spark, d):
    rows = table(spark, d, "labels").withColumn("document", F.nullif(tx.basename(F.col("source_pdf")), F.lit("")))
    return rows.join(rows.where("split = 'test' and document is not null").select("document").distinct(), "document", "left_anti").select("label_id")


_GROUPS = f"""WITH RECURSIVE img AS (SELECT image, min({_NAME}) AS doc FROM labels WHERE {_NAME} IS NOT NULL GROUP BY 1), nodes AS (SELECT DISTINCT doc AS n FROM img),
 e AS (SELECT a.doc AS a, b.doc AS b FROM similarity_candidates s JOIN img a ON s.image_a = a.image JOIN img b ON s.image_b = b.image WHERE a.doc <> b.doc),
 both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(n, m) AS (SELECT n, n FROM nodes UNION SELECT reach.n, both_ways.b FROM reach JOIN both_ways ON reach.m = both_ways.a),
 g AS (SELECT n AS node, min(m) AS "group" FROM reach GROUP BY 1)"""


def _document_groups(spark, d):
    rows = table(spark, d, "labels").select("image", F.nullif(tx.basename(F.col("source_pdf")), F.lit("")).alias("doc")).where("doc is not null")
    img = rows.groupBy("image").agg(F.min("doc").alias("doc"))
    pairs = table(spark, d, "similarity_candidates").join(img.select(F.col("image").alias("image_a"), F.col("doc").alias("a")), "image_a").join(img.select(F.col("image").alias("image_b"), F.col("doc").alias("b")), "image_b").select("a", "b")
    return groups.linked_groups(img.select(F.col("doc").alias("node")), pairs), img


@query(f"{_GROUPS} SELECT * FROM g")
def document_groups(spark, d):
    return _document_groups(spark, d)[0]


@query(f"""{_GROUPS}, p AS (SELECT "group", count(*) AS pages FROM img JOIN g ON img.doc = g.node GROUP BY 1),
 o AS (SELECT *, coalesce(sum(pages) OVER (ORDER BY sha256('{SEED}:' || "group") ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(pages) OVER () AS total FROM p),
 t AS (SELECT *, greatest(1, round_even(total * 0.1, 0)) AS target FROM o), u AS (SELECT coalesce(sum(pages) FILTER (WHERE before < target), 0) AS used FROM t)
 SELECT "group", pages::BIGINT AS pages, CASE WHEN before < target THEN 'val' WHEN before - used < target THEN 'test' ELSE 'train' END AS split FROM t, u""")
def grouped_split(spark, d):
    found, img = _document_groups(spark, d)
    pages = img.join(found.withColumnRenamed("node", "doc"), "doc").groupBy("group").agg(F.count(F.lit(1)).alias("pages"))
    return groups.grouped_split(pages, SEED)


@query(f"SELECT line_id, len(list_filter(range(floor((x0 - 3) / 10)::INTEGER, floor((x1 - 3) / 10)::INTEGER + 1), lambda k: greatest(x0, 3 + k * 10.0) < least(x1, 3 + k * 10.0 + 6)))::INTEGER AS dashes FROM (SELECT line_id, {_BOX} FROM page_lines) WHERE x0 < x1")
def dash_phases(spark, d):
    rows = _lines(spark, d).where("x0 < x1")
    return rows.select("line_id", F.size(op.dash_segments(F.col("x0"), F.col("x1"), 6.0, 4.0, 3.0)).alias("dashes"))


@query("SELECT image, CASE WHEN greatest(img_width, img_height) <= 1024 THEN img_width ELSE greatest(1, round_even(img_width * 1024 / greatest(img_width, img_height), 0)::INTEGER) END AS width, CASE WHEN greatest(img_width, img_height) <= 1024 THEN img_height ELSE greatest(1, round_even(img_height * 1024 / greatest(img_width, img_height), 0)::INTEGER) END AS height FROM labels WHERE img_width IS NOT NULL GROUP BY ALL")
def capped_sizes(spark, d):
    longest = F.greatest("img_width", "img_height")
    return table(spark, d, "labels").where("img_width is not null").select("image", geo.capped_side(F.col("img_width"), longest, 1024).alias("width"), geo.capped_side(F.col("img_height"), longest, 1024).alias("height")).distinct()


_W = tx.WESTERN[1:-1]


@query(rf"WITH p AS (SELECT row_id, regexp_extract_all(text, '(^[\s0-9]*)?[{_W}][{_W}\s0-9]*|[^{_W}]+') AS p FROM train) SELECT row_id, generate_subscripts(p, 1)::BIGINT AS run, regexp_matches(unnest(p), '[{_W}]') AS western, unnest(p) AS text FROM p")
def western_runs(spark, d):
    return op.class_runs(table(spark, d, "train").select("row_id", "text"), "row_id", "text", tx.WESTERN)


@query("SELECT doc_id, (win * 32 + floor((row_number() OVER (PARTITION BY win ORDER BY n, doc_id) - 1) / 8))::BIGINT AS batch FROM (SELECT doc_id, coalesce(length(text), 0) AS n, floor((row_number() OVER (ORDER BY doc_id) - 1) / 256) AS win FROM documents)")
def batch_windows(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    return op.batch_windows(rows, "doc_id", F.col("n"), 8, 32).select("doc_id", "batch")
