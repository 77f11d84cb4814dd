"""Verification batteries, layout grids, logs and the smaller helpers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import geometry as geo, hashing, text as tx
from ..operators import corpus, integrity, layout, scoring, selection
from ..session import table
from ..streaming import logs
from .corpus import SEED, VOCABULARY, _VALID, _VOC, _sha, _valid_splits
from .registry import query
from .scoring import _WIDE, _alias_sql

_TRAIN_GRAMS = "unnest(CASE WHEN length(f) < 16 THEN [f] ELSE list_transform(range(1, length(f) - 14), lambda i: substr(f, i, 16)) END) AS gram"


@query(f"""WITH {_VALID}, n AS (SELECT row_id, article_id, text, {_alias_sql()} AS other FROM train WHERE text IS NOT NULL),
 t AS (SELECT row_id, split, unnest([text, other]) AS f FROM n JOIN valid USING (article_id)), g AS (SELECT row_id, split, {_TRAIN_GRAMS} FROM t)
 SELECT DISTINCT row_id AS id FROM g WHERE split = 'train' AND gram IN (SELECT gram FROM g WHERE split IN ('validation', 'test'))""")
def alias_aware_contamination(spark, d):
    rows = table(spark, d, "train").where("text is not null").select("row_id", "article_id", "text").join(_valid_splits(spark, d), "article_id")
    both = corpus.both_forms(rows, _WIDE)
    return corpus.sharing_rows(both.where("split = 'train'"), "row_id", both.where("split in ('validation', 'test')"))


@query(f"""WITH {_VALID}, t AS (SELECT row_id, extraction, text AS f, split FROM train JOIN valid USING (article_id) WHERE text IS NOT NULL), g AS (SELECT row_id, extraction, split, {_TRAIN_GRAMS} FROM t),
 bad AS (SELECT DISTINCT row_id FROM g WHERE split = 'train' AND gram IN (SELECT gram FROM g WHERE split IN ('validation', 'test')))
 SELECT extraction AS part, count(*)::BIGINT AS "rows", count(bad.row_id)::BIGINT AS leaking FROM t LEFT JOIN bad USING (row_id) WHERE split = 'train' GROUP BY 1""")
def fragment_leakage(spark, d):
    """Of each part of the training mix, the rows that share a fragment with the evaluation rows; a mix may go on if there
    are none (integrity.require_empty)."""
    rows = table(spark, d, "train").where("text is not null").select("row_id", "extraction", "article_id", "text").join(_valid_splits(spark, d), "article_id")
    mix = rows.where("split = 'train'")
    bad = corpus.sharing_rows(mix, "row_id", rows.where("split in ('validation', 'test')")).select(F.col("id").alias("row_id"), F.lit(1).alias("bad"))
    return mix.join(bad, "row_id", "left").groupBy(F.col("extraction").alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.count("bad").alias("leaking"))


_FONTS = "f AS (SELECT DISTINCT font_name AS font, unnest(string_split(text, '')) AS character FROM page_lines WHERE font_name IS NOT NULL AND text <> '')"


def _fonts(spark, d):
    """What each font is seen to draw stands for its character map."""
    rows = table(spark, d, "page_lines").where("font_name is not null and text <> ''")
    return rows.select(F.col("font_name").alias("font"), F.explode(F.array_distinct(tx.characters(F.col("text")))).alias("character"))


@query(f"WITH {_VOC}, {_FONTS}, n AS (SELECT font, count(voc.character)::BIGINT AS covered FROM f LEFT JOIN voc USING (character) GROUP BY 1) SELECT font, {len(VOCABULARY)}::BIGINT AS total, covered, {len(VOCABULARY)} - covered AS missing FROM n")
def font_coverage(spark, d):
    return corpus.font_coverage(_fonts(spark, d), spark.createDataFrame([(c,) for c in VOCABULARY], "character string"))


@query(f"WITH {_FONTS}, r AS (SELECT unnest(string_split('0123456789,.%', '')) AS character) SELECT g.font, r.character FROM (SELECT DISTINCT font FROM f) g CROSS JOIN r ANTI JOIN f ON f.font = g.font AND f.character = r.character")
def font_missing_characters(spark, d):
    return corpus.missing_characters(_fonts(spark, d), spark.createDataFrame([(c,) for c in "0123456789,.%"], "character string"))


@query("SELECT representative, count(DISTINCT m)::BIGINT AS elements FROM (SELECT representative, unnest(members) AS m FROM character_aliases_quotes_homoglyphs) GROUP BY 1")
def unique_array_values(spark, d):
    return corpus.distinct_elements(table(spark, d, "character_aliases_quotes_homoglyphs"), "members", ["representative"])


@query("WITH c AS (SELECT row_id, unnest(string_split(text, '')) AS character FROM train WHERE text <> ''), n AS (SELECT character FROM c GROUP BY 1 HAVING count(DISTINCT row_id) <= 5) SELECT DISTINCT character, row_id AS id FROM c JOIN n USING (character)")
def rare_character_index(spark, d):
    return corpus.inverted_index(table(spark, d, "train"), "row_id", 5)


@query(f"WITH {_VOC}, o AS (SELECT DISTINCT unnest(string_split(reference, '')) AS character FROM real_references WHERE reference <> '') SELECT coalesce(voc.character, o.character) AS character, voc.character IS NOT NULL AS required, o.character IS NOT NULL AS observed FROM voc FULL JOIN o ON voc.character = o.character")
def required_characters(spark, d):
    seen = table(spark, d, "real_references").select(F.explode(tx.characters(F.col("reference"))).alias("character"))
    return corpus.required_observed(spark.createDataFrame([(c,) for c in VOCABULARY], "character string"), seen)


_LATEST = "(SELECT shard, character, sample_count FROM (SELECT *, row_number() OVER (PARTITION BY shard, character ORDER BY counted_at DESC NULLS LAST, coverage_id DESC) AS k FROM coverage WHERE character IS NOT NULL) WHERE k = 1)"


@query(f"""WITH {_VALID}, t AS (SELECT *, count(*) OVER (PARTITION BY row_id) AS n, count(*) OVER (PARTITION BY sample_id) AS copies FROM train),
 seen AS (SELECT DISTINCT character FROM coverage WHERE character IS NOT NULL), c AS (SELECT row_id, shard, unnest(string_split(text, '')) AS character FROM train WHERE text <> ''),
 g AS (SELECT DISTINCT row_id, article_id, unnest(CASE WHEN length(text) < 16 THEN [text] ELSE list_transform(range(1, length(text) - 14), lambda i: substr(text, i, 16)) END) AS gram FROM train WHERE text IS NOT NULL),
 n AS (SELECT shard, character, count(DISTINCT row_id) AS sample_count FROM c GROUP BY 1, 2)
 SELECT 'unique_id' AS "check", count(*) FILTER (WHERE n > 1)::BIGINT AS violations FROM t
 UNION ALL SELECT 'unique_text', count(*) FILTER (WHERE copies > 1) FROM t
 UNION ALL SELECT 'digest', count(*) FILTER (WHERE sample_id IS DISTINCT FROM sha256(text)) FROM t
 UNION ALL SELECT 'length', count(*) FILTER (WHERE NOT coalesce("length" = length(text) AND length(text) BETWEEN 1 AND 99, false)) FROM t
 UNION ALL SELECT 'span', count(*) FILTER (WHERE NOT coalesce(end_offset - start_offset = length(text), false)) FROM t
 UNION ALL SELECT 'single_line', count(*) FILTER (WHERE NOT coalesce(NOT regexp_matches(text, '[\\r\\n\\x{{85}}\\x{{2028}}\\x{{2029}}]'), false)) FROM t
 UNION ALL SELECT 'anchor', count(*) FILTER (WHERE NOT coalesce(contains(text, anchor), false)) FROM t
 UNION ALL SELECT 'split', count(*) FROM t LEFT JOIN valid USING (article_id) WHERE split IS DISTINCT FROM 'train'
 UNION ALL SELECT 'vocabulary', count(DISTINCT row_id) FROM c ANTI JOIN seen USING (character)
 UNION ALL SELECT 'overlap', count(DISTINCT a.row_id) FROM train a JOIN train b ON a.article_id = b.article_id AND a.row_id <> b.row_id WHERE a.start_offset < b.end_offset AND b.start_offset < a.end_offset AND a.start_offset < a.end_offset AND b.start_offset < b.end_offset
 UNION ALL SELECT 'fragment', count(DISTINCT row_id) FROM g WHERE gram IN (SELECT gram FROM g GROUP BY 1 HAVING count(*) > 1)
 UNION ALL SELECT 'coverage', count(*) FROM n FULL JOIN {_LATEST} v ON n.shard = v.shard AND n.character = v.character WHERE n.sample_count IS DISTINCT FROM v.sample_count
 UNION ALL SELECT 'article_repeated', count(*) FROM (SELECT article_id FROM article_splits WHERE article_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)""")
def sample_verification(spark, d):
    return integrity.sample_violations(table(spark, d, "train"), table(spark, d, "coverage"), table(spark, d, "article_splits"), _valid_splits(spark, d), 99)


@query(f"WITH s AS (SELECT shard AS name, count(*) AS value FROM {_LATEST} GROUP BY 1), a AS (SELECT shard AS name, count(DISTINCT c) AS value FROM (SELECT shard, unnest(string_split(text, '')) AS c FROM train WHERE row_id % 7 <> 0 AND text <> '') GROUP BY 1) SELECT coalesce(s.name, a.name) AS name, CASE WHEN a.name IS NULL THEN 'missing' WHEN s.name IS NULL THEN 'unexpected' ELSE 'different' END AS problem FROM s FULL JOIN a ON s.name = a.name WHERE s.value IS DISTINCT FROM a.value")
def completion_check(spark, d):
    """A run whose output lacks a seventh of its rows (the fault that is looked for), against the counts it should have."""
    last = table(spark, d, "coverage").where("character is not null").select("shard", "character").distinct()
    stated = last.groupBy(F.col("shard").alias("name")).agg(F.count(F.lit(1)).alias("value"))
    kept = table(spark, d, "train").where("row_id % 7 <> 0").select("shard", F.explode(F.array_distinct(tx.characters(F.col("text")))).alias("c"))
    return integrity.completion_problems(stated, kept.groupBy(F.col("shard").alias("name")).agg(F.count_distinct("c").alias("value")), "name", "value")


@query(f"""WITH l AS (SELECT user_id AS run, date_diff('day', DATE '2024-01-01', ts::DATE) AS epoch, hour(ts) AS step, CASE WHEN event_type = 'view' THEN 'validation' ELSE event_type END AS kind, value FROM events),
 b AS (SELECT run, epoch, step, value FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY value, epoch, step) AS k FROM l) WHERE k = 1),
 f AS (SELECT l.* FROM l JOIN b ON l.run = b.run AND l.epoch = b.epoch AND l.step = b.step WHERE kind IN ('validation', 'click', 'error'))
 SELECT run, epoch::INTEGER AS epoch, step::INTEGER AS step, kind, value FROM f UNION ALL SELECT run, epoch::INTEGER, step::INTEGER, 'validation', value FROM b WHERE run NOT IN (SELECT run FROM f WHERE kind = 'validation')""")
def best_metrics(spark, d):
    kind = F.when(F.col("event_type") == "view", "validation").otherwise(F.col("event_type"))
    log = table(spark, d, "events").select(F.col("user_id").alias("run"), F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("epoch"), F.hour("ts").alias("step"), kind.alias("kind"), "value")
    best = log.groupBy("run").agg(F.min(F.struct("value", "epoch", "step")).alias("x")).select("run", "x.epoch", "x.step", "x.value")
    return scoring.best_results(best, log, "run", ["validation", "click", "error"])


@query(f"""WITH {_FONTS}, s AS (SELECT f.font, f.character, (unicode(f.character) * length(f.font)) % 3 AS signature FROM f),
 p AS (SELECT DISTINCT a.c AS a, b.c AS b FROM (SELECT representative AS r, unnest(members) AS c FROM character_aliases_quotes_homoglyphs) a JOIN (SELECT representative AS r, unnest(members) AS c FROM character_aliases_quotes_homoglyphs) b ON a.r = b.r AND unicode(a.c) < unicode(b.c)),
 n AS (SELECT p.a, p.b, count(x.font) AS supported, count(*) FILTER (WHERE x.signature = y.signature) AS identical FROM p JOIN s x ON x.character = p.a JOIN s y ON y.character = p.b AND y.font = x.font GROUP BY 1, 2)
 SELECT p.a, p.b, coalesce(supported, 0)::BIGINT AS supported, coalesce(identical, 0)::BIGINT AS identical, CASE WHEN p.a = '0' THEN '別クラス維持（方針）' WHEN coalesce(supported, 0) = 0 THEN '判定不能（共通の対応書体なし）' WHEN identical = supported THEN '統合候補（比較できた全書体で一致）' WHEN identical > 0 THEN '統合検討（書体によって一致・不一致）' ELSE '要目視確認（完全一致なし）' END AS decision FROM p LEFT JOIN n USING (a, b)""")
def alias_audit(spark, d):
    m = table(spark, d, "character_aliases_quotes_homoglyphs").select(F.col("representative").alias("r"), F.explode("members").alias("c"))
    pairs = m.select("r", F.col("c").alias("a")).join(m.select("r", F.col("c").alias("b")), "r").where(F.ascii("a") < F.ascii("b")).select("a", "b").distinct().withColumn("separate", F.col("a") == "0")
    # A number made of both stands for the drawn glyph.
    glyphs = _fonts(spark, d).withColumn("signature", (F.ascii("character") * F.length("font")) % 3)
    return scoring.audited_pairs(pairs, glyphs)


@query("SELECT font, length_group FROM (SELECT j.font_name || '+' || w.font_name AS font FROM (SELECT DISTINCT font_name FROM page_lines WHERE font_name LIKE '%Mincho%') j CROSS JOIN (SELECT DISTINCT font_name FROM page_lines WHERE font_name LIKE '%Serif%') w) CROSS JOIN (VALUES ('short5'), ('normal'), ('long80')) l(length_group)")
def condition_grid(spark, d):
    fonts = table(spark, d, "page_lines").where("font_name is not null").select(F.col("font_name").alias("font")).distinct()
    fonts = fonts.withColumn("japanese", F.contains("font", F.lit("Mincho"))).withColumn("western", F.contains("font", F.lit("Serif")))
    return scoring.condition_grid(fonts, spark.createDataFrame([(5, 5), (20, 25), (80, 80)], "low int, high int"))


@query("""WITH r AS (SELECT image, line_id, coalesce(length(text), 0) AS size, row_number() OVER (PARTITION BY image ORDER BY line_id) AS i, count(*) OVER (PARTITION BY image) AS n, sum(coalesce(length(text), 0)) OVER (PARTITION BY image) AS whole FROM page_lines WHERE image IS NOT NULL),
 s AS (SELECT image, line_id AS start, i AS i0 FROM r WHERE i IN (2, 3)), x AS (SELECT r.image, start, line_id, (i - i0 + n) % n AS turn, size, whole FROM r JOIN s ON r.image = s.image),
 y AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY image, start ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x)
 SELECT image, start, line_id, turn::INTEGER AS turn, whole >= 120 AS enough FROM y WHERE before < 120""")
def wrapping_budget(spark, d):
    rows = table(spark, d, "page_lines").where("image is not null").select("image", "line_id", F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    i = F.row_number().over(Window.partitionBy("image").orderBy("line_id"))
    starts = rows.withColumn("i", i).where("i in (2, 3)").select("image", F.col("line_id").alias("start"))
    return selection.wrapping_budget(rows, starts, "image", "line_id", "size", 120)


_CELLS = "cells AS (SELECT l_orderkey AS \"table\", l_linenumber AS r, (l_suppkey % 5)::INTEGER AS c, 1 + l_partkey % 2 AS h, 1 + l_suppkey % 3 AS w FROM lineitem)"


def _cells(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("table"), F.col("l_linenumber").alias("row"), (F.col("l_suppkey") % 5).cast("int").alias("column"), (1 + F.col("l_partkey") % 2).cast("int").alias("rowspan"), (1 + F.col("l_suppkey") % 3).cast("int").alias("colspan"))


@query(f"""WITH {_CELLS}, h AS (SELECT "table", 'h' AS axis, unnest([r, r + h]) AS line, c, w FROM cells), v AS (SELECT "table", 'v' AS axis, unnest([c, c + w]) AS line, r, h FROM cells)
 SELECT "table", axis, line::INTEGER AS line, unnest(range(c, c + w))::INTEGER AS "at" FROM h UNION SELECT "table", axis, line::INTEGER, unnest(range(r, r + h))::INTEGER FROM v""")
def boundary_segments(spark, d):
    return layout.boundary_segments(_cells(spark, d), "table")


@query(f"WITH {_CELLS}, g AS (SELECT \"table\", unnest(range(r, r + h)) AS r, c, w FROM cells), x AS (SELECT \"table\", r, unnest(range(c, c + w)) AS c FROM g) SELECT \"table\", r::INTEGER AS \"row\", c::INTEGER AS \"column\", count(*)::BIGINT AS n FROM x GROUP BY 1, 2, 3 HAVING count(*) <> 1")
def grid_coverage(spark, d):
    return layout.grid_coverage(_cells(spark, d), "table")


@query(f"""WITH {_CELLS}, s AS (SELECT "table", 8 AS r, 7 AS c FROM cells GROUP BY 1), w AS (SELECT "table", 'row' AS axis, unnest(range(0, r + 1)) AS track FROM s UNION ALL SELECT "table", 'column', unnest(range(0, c + 1)) FROM s),
 e AS (SELECT "table", 'row' AS axis, unnest([r, r + h]) AS track FROM cells UNION SELECT "table", 'column', unnest([c, c + w]) FROM cells)
 SELECT "table", axis, track::INTEGER AS track FROM w ANTI JOIN e USING ("table", axis, track)""")
def hidden_grid_tracks(spark, d):
    return layout.hidden_tracks(_cells(spark, d).withColumn("rows", F.lit(8)).withColumn("columns", F.lit(7)), "table", "rows", "columns")


def _tables(spark, d):
    modes = F.array(*[F.lit(m) for m in layout.TILINGS])
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("table"), (3 + F.col("o_orderkey") % 4).cast("int").alias("rows"), (3 + F.col("o_custkey") % 3).cast("int").alias("columns"), F.element_at(modes, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("mode"), F.col("o_orderkey").alias("seed"))


@query()
def grid_tilings(spark, d):
    return layout.random_tilings(_tables(spark, d), "table")


@query("SELECT CASE o_orderkey % 5 WHEN 0 THEN 'plain' WHEN 1 THEN 'column_merge' WHEN 2 THEN 'row_merge' WHEN 3 THEN 'mixed' ELSE 'block_merge' END AS mode, count(*)::BIGINT AS tables, sum((3 + o_orderkey % 4) * (3 + o_custkey % 3))::BIGINT AS covered, 0::BIGINT AS wrong FROM orders GROUP BY 1")
def grid_tiling_check(spark, d):
    """Every tiling covers its grid once, shows every line, and has the merges of its mode."""
    from ..session import Workspace

    made = _tables(spark, d)
    cells = Workspace(spark).write(grid_tilings(spark, d), "tilings")
    tall, wide = F.col("rowspan") > 1, F.col("colspan") > 1
    sums = cells.groupBy("table").agg(F.sum(F.col("rowspan") * F.col("colspan")).cast("long").alias("covered"), F.max(tall).alias("tall"), F.max(wide).alias("wide"), F.max(tall & wide).alias("block"))
    hidden = layout.hidden_tracks(cells.join(made.select("table", "rows", "columns"), "table"), "table", "rows", "columns").select("table").unionByName(layout.grid_coverage(cells, "table").select("table")).distinct().withColumn("bad", F.lit(1))
    m, t, w, b = F.col("mode"), F.col("tall"), F.col("wide"), F.col("block")
    good = F.when(m == "plain", ~t & ~w).when(m == "column_merge", w & ~t).when(m == "row_merge", t & ~w).when(m == "mixed", t & w & ~b).otherwise(b)
    return made.join(sums, "table").join(hidden, "table", "left").groupBy("mode").agg(F.count(F.lit(1)).alias("tables"), F.sum("covered").alias("covered"), F.count_if(F.col("bad").isNotNull() | ~good).alias("wrong"))


@query("SELECT l_returnflag AS channel, class, count(*)::BIGINT AS pixels FROM (SELECT l_returnflag, CASE WHEN l_discount * 10 < 0.5 THEN NULL WHEN l_quantity / 50 < 0.5 THEN 'solid' WHEN l_tax * 12.5 >= 0.5 THEN 'dash_ink' WHEN l_tax * 12.5 <= 0.01 THEN 'dash_gap' END AS class FROM lineitem) GROUP BY 1, 2")
def boundary_pixel_classes(spark, d):
    kind = geo.boundary_class(F.col("l_discount") * 10, F.col("l_quantity") / 50, F.col("l_tax") * 12.5)
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("channel"), kind.alias("class")).agg(F.count(F.lit(1)).alias("pixels"))


def _checked_size(text, stated) -> str:
    """The work of document_worker: what stands for reading a page; it fails on what it does not expect."""
    if text is None:
        raise ValueError("no text")
    if len(text) != stated:
        raise ValueError("size changed")
    return str(len(text))


@query("SELECT doc_id, CASE WHEN length(text) = n_chars THEN 'complete' ELSE 'error' END AS status, CASE WHEN text IS NULL THEN 'no text' WHEN length(text) IS DISTINCT FROM n_chars THEN 'size changed' END AS error, CASE WHEN length(text) = n_chars THEN length(text)::VARCHAR END AS result FROM documents")
def document_worker(spark, d):
    return integrity.guarded(table(spark, d, "documents"), "doc_id", ["text", "n_chars"], _checked_size)


@query("""WITH x AS (SELECT DISTINCT source_pdf AS document, page FROM labels WHERE line_count IS NULL), u AS (SELECT DISTINCT unnest([image_a, image_b]) AS image FROM similarity_candidates WHERE score IS NULL)
 SELECT label_id, u.image IS NOT NULL AS held FROM labels l LEFT JOIN u ON l.image = u.image WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.document = l.source_pdf AND x.page = l.page)""")
def page_holdout(spark, d):
    pages = table(spark, d, "labels").withColumnRenamed("source_pdf", "document")
    uncertain = table(spark, d, "similarity_candidates").where("score is null").select(F.explode(F.array("image_a", "image_b")).alias("image")).where("image is not null")
    return integrity.held_out_pages(pages, pages.where("line_count is null"), uncertain).select("label_id", "held")


@query(f"WITH {_VALID}, s AS (SELECT DISTINCT split, sample_id FROM train JOIN valid USING (article_id) WHERE split IS NOT NULL) SELECT a.split AS a, b.split AS b, count(*)::BIGINT AS shared FROM s a JOIN s b ON a.sample_id = b.sample_id AND a.split < b.split GROUP BY 1, 2")
def seed_disjointness(spark, d):
    """Identifiers that two sets share; sets are disjoint where there is no row."""
    rows = table(spark, d, "train").select("sample_id", "article_id").join(_valid_splits(spark, d).where("split is not null"), "article_id").select("split", "sample_id").distinct()
    a, b = rows.select(F.col("split").alias("a"), "sample_id"), rows.select(F.col("split").alias("b"), "sample_id")
    return a.join(b, "sample_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


@query("SELECT DISTINCT image FROM labels WHERE image IN (SELECT image_a FROM similarity_candidates WHERE image_a IS NOT NULL)")
def manifest_membership(spark, d):
    known = table(spark, d, "similarity_candidates").select(F.col("image_a").alias("image")).where("image is not null").distinct()
    return table(spark, d, "labels").join(known, "image", "left_semi").select("image").distinct()


@query(r"SELECT row_id, regexp_full_match(text, '[ 0-9A-Za-zªµºÀ-ÖØ-öø-ÿ²³¹,.;:!?''\"()“”‘’–—-]*') AS allowed, len(list_filter(list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> ''), lambda w: length(regexp_replace(w, '^[.,;:!?\"()]+|[.,;:!?\"()]+$', '', 'g')) <= 1 AND w NOT IN ('a', 'A', 'I'))) = 0 AS no_stray, NOT regexp_matches(text, '^[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]$|^\p{M}') AS clean FROM train WHERE text IS NOT NULL")
def excerpt_guards(spark, d):
    t = F.col("text")
    return table(spark, d, "train").where("text is not null").select("row_id", tx.english_characters_only(t).alias("allowed"), tx.no_stray_letters(t).alias("no_stray"), tx.clean_edges(t).alias("clean"))


@query("SELECT row_id, replace(replace(text, 'の', 'の'), '学', '学' || chr(917760)) = text AS unchanged, length(text)::INTEGER AS stripped, length(text)::INTEGER AS tokens FROM train WHERE text IS NOT NULL AND text NOT LIKE '%' || chr(10) || '%'")
def selector_tokens(spark, d):
    """A selector after every 学: taken off again the text is as before, and with it the text has as many tokens."""
    marked = F.replace("text", F.lit("学"), F.lit("学\U000e0100"))
    rows = table(spark, d, "train").where(F.col("text").isNotNull() & ~F.contains("text", F.lit("\n")))
    return rows.select("row_id", (marked == F.col("text")).alias("unchanged"), F.length(tx.strip_selectors(marked)).alias("stripped"), F.size(tx.selector_tokens(marked)).alias("tokens"))


@query("WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '[\\r\\n\\x{85}\\x{2028}\\x{2029}]')) AS line, generate_subscripts(string_split_regex(text, '[\\r\\n\\x{85}\\x{2028}\\x{2029}]'), 1) AS i FROM documents WHERE text <> ''), p AS (SELECT doc_id, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l) SELECT doc_id, count(*)::BIGINT AS lines, sum(start)::BIGINT AS starts, sum(length(line))::BIGINT AS characters FROM p WHERE line <> '' GROUP BY 1")
def line_offsets(spark, d):
    rows = table(spark, d, "documents").where("text <> ''").select("doc_id", F.explode(tx.lines(F.col("text"))).alias("l"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("l.start").cast("long")).alias("starts"), F.sum(F.length("l.text").cast("long")).alias("characters"))


@query("SELECT row_id, regexp_replace(regexp_replace(regexp_replace(text, '[^ -~]', ' ', 'g'), ' +', ' ', 'g'), '^[ 　]+|[ 　]+$', '', 'g') AS replaced FROM train WHERE lang IN ('en', 'fr', 'de')")
def unsupported_replaced(spark, d):
    ascii_ = "".join(chr(o) for o in range(0x21, 0x7F))
    return table(spark, d, "train").where("lang in ('en', 'fr', 'de')").select("row_id", tx.replace_unsupported(F.col("text"), ascii_).alias("replaced"))


@query("SELECT row_id, '字' || substr(text, 2, length(text) - 2) || '字' AS replaced FROM train WHERE length(text) >= 2")
def replacements_applied(spark, d):
    t, n = F.col("text"), F.length("text")
    edit = lambda at: F.struct(at.cast("int").alias("position"), F.substr(t, at + 1, F.lit(1)).alias("from"), F.lit("字").alias("to"))
    return table(spark, d, "train").where(n >= 2).select("row_id", tx.apply_replacements(t, F.array(edit(F.lit(0)), edit(n - 1))).alias("replaced"))


@query("SELECT DISTINCT character, 'U+' || lpad(printf('%X', unicode(character)), greatest(4, length(printf('%X', unicode(character))))::INTEGER, '0') AS label FROM (SELECT unnest(string_split(text, '')) AS character FROM documents WHERE text <> '')")
def codepoint_labels(spark, d):
    return corpus.character_counts(table(spark, d, "documents")).select("character", tx.codepoint_label(F.col("character")).alias("label"))


@query("SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS remaining, strftime(date_trunc('second', ts) + to_seconds(floor(value * 900)::BIGINT), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS finish FROM (SELECT *, ceil(value * 900)::BIGINT AS s FROM events) WHERE value >= 0")
def remaining_labels(spark, d):
    left = F.col("value") * 900
    return table(spark, d, "events").where("value >= 0").select("event_id", tx.duration_label(left).alias("remaining"), tx.finish_time(F.col("ts"), left).alias("finish"))


@query("SELECT event_id, json_object('k', user_id, 'seen', true)::VARCHAR AS props FROM events WHERE props IS NOT NULL")
def json_updates(spark, d):
    return table(spark, d, "events").where("props is not null").select("event_id", tx.json_updated(F.col("props"), "k long, seen boolean", k=F.col("user_id"), seen=F.lit(True)).alias("props"))


@query("SELECT l_orderkey AS \"order\", l_linenumber AS line, round((l_quantity * 3 + l_tax * 400) / 5, 6) AS along, round((l_tax * 300 - l_quantity * 4) / 5, 6) AS across, round(degrees(atan2(l_tax * 100 + 1, l_quantity)), 6) AS diagonal, l_linenumber + 7 AS shifted FROM lineitem")
def rotated_points(spark, d):
    q, t = F.col("l_quantity"), F.col("l_tax") * 100
    along, across = geo.rotated_bounds(q, t, F.lit(3.0), F.lit(4.0))
    shifted = F.map_keys(geo.shift_keys(F.create_map(F.col("l_linenumber").cast("string"), F.lit(1)), 7))[0].cast("int")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"), F.round(along, 6).alias("along"), F.round(across, 6).alias("across"), F.round(geo.diagonal_degrees(q, t + 1), 6).alias("diagonal"), shifted.alias("shifted"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def windowed_event_totals(spark, d):
    """The totals of streaming.logs over the whole log at once; the tests run the same over a stream."""
    return logs.windowed_totals(table(spark, d, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 6))


@query("SELECT l.name, CASE WHEN r.name IS NULL THEN 'missing' ELSE 'different' END AS problem FROM (SELECT image AS name, max(img_hash) AS h FROM labels WHERE img_hash IS NOT NULL GROUP BY 1) l LEFT JOIN (SELECT image AS name, min(img_hash) AS h FROM labels WHERE page % 11 <> 0 AND img_hash IS NOT NULL GROUP BY 1) r ON l.name = r.name WHERE r.name IS NULL OR l.h <> r.h")
def copied_label_check(spark, d):
    """A copy of a data set that lacks some of its pages (the fault that is looked for), by digest."""
    rows = table(spark, d, "labels").where("img_hash is not null")
    source = rows.groupBy(F.col("image").alias("name")).agg(F.max("img_hash").alias("sha256"))
    return integrity.copied_files(source, rows.where("page % 11 <> 0").groupBy(F.col("image").alias("name")).agg(F.min("img_hash").alias("sha256")))


@query(f"WITH k AS (SELECT doc_id, title, row_number() OVER (PARTITION BY source ORDER BY {_sha(SEED, 'doc_id')}, doc_id) AS i FROM documents WHERE source IS NOT NULL) SELECT doc_id, title, n_chars FROM k JOIN documents USING (doc_id, title) WHERE i <= 5 AND title IS NOT NULL")
def article_lookup(spark, d):
    """Articles of chosen keys, as from a store by point lookup."""
    from ..sources import readers

    docs = table(spark, d, "documents")
    i = F.row_number().over(Window.partitionBy("source").orderBy(hashing.shuffle_key(F.col("doc_id"), SEED), "doc_id"))
    keys = docs.where("source is not null").withColumn("i", i).where("i <= 5 and title is not null").select("doc_id")
    return readers.looked_up(keys, docs.select("doc_id", "title", "n_chars"), "doc_id")


@query("SELECT b || '/' || s AS name FROM (VALUES (1, 'ja'), (2, 'en')) x(i, b) CROSS JOIN (VALUES ('train'), ('validation')) y(s) UNION ALL SELECT DISTINCT lang || '/suite' FROM documents WHERE lang IN ('fr', 'de')")
def suite_paths(spark, d):
    suites = [f"{r.lang}/suite" for r in table(spark, d, "documents").where("lang in ('fr', 'de')").select("lang").distinct().orderBy("lang").collect()]
    base = [f"{b}/{s}" for b in ("ja", "en") for s in ("train", "validation")]
    return spark.createDataFrame([(s,) for s in integrity.suite_sets(base, suites)], "name string")
