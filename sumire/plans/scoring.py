"""Recognition, detection and region scores over the driver's tables.

Predictions are made from the texts by fixed corruptions, so both engines score the same pairs.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text as tx
from ..operators import integrity, scoring as op
from ..session import spread, table
from .registry import query

# Misreadings that make predictions of references.
_MISREAD = (("tt", "t"), ("ou", "on"), (", ", ","), ("ー", "一"), ("、", ""), ("を", "お"), ("っ", "つ"), ("日", "目"), ("」", "』"), ("・", "・ "), ("é", "e"), ("ü", "u"), ("ß", "B"))


def _corrupted_sql() -> str:
    out = "text"
    for a, b in _MISREAD:
        out = f"replace({out}, '{a}', '{b}')"
    return out


# DuckDB's levenshtein counts bytes: the characters of each pair are renamed to one-byte ones, of which there are enough.
_BYTES = "array_to_string(list_transform(range(1, 128), lambda i: chr(i::INTEGER)), '')"
_RENAMED = f"translate({{0}}, alphabet, substr({_BYTES}, 1, length(alphabet)))"
_PAIRS = f"""raw AS (SELECT row_id, extraction, shard, length(text) AS n, text AS reference, {_corrupted_sql()} AS prediction, replace(text, 'e', 'c') AS base FROM train WHERE text IS NOT NULL),
 named AS (SELECT *, array_to_string(list_distinct(string_split(reference || prediction || base, '')), '') AS alphabet FROM raw),
 pairs AS (SELECT row_id, extraction, shard, n, reference, prediction, levenshtein({_RENAMED.format('reference')}, {_RENAMED.format('prediction')}) AS errors, levenshtein({_RENAMED.format('reference')}, {_RENAMED.format('base')}) AS base_errors FROM named)"""


def pairs(spark, d):
    """Every excerpt as reference beside its corrupted copy."""
    rows = spread(table(spark, d, "train")).where("text is not null")
    prediction = F.col("text")
    for a, b in _MISREAD:
        prediction = F.replace(prediction, F.lit(a), F.lit(b))
    return rows.select("row_id", "extraction", "shard", F.length("text").alias("n"), F.col("text").alias("reference"), prediction.alias("prediction"))


_SUMS = "count(*)::BIGINT AS samples, sum((reference = prediction)::INTEGER)::BIGINT AS exact_matches, sum(errors)::BIGINT AS character_errors, sum(length(reference))::BIGINT AS reference_characters"


@query(f"WITH {_PAIRS}, s AS (SELECT extraction, {_SUMS} FROM pairs GROUP BY 1) SELECT *, exact_matches / samples AS exact_accuracy, character_errors / reference_characters AS cer FROM s")
def cer_micro_by_group(spark, d):
    return op.with_rates(op.totals(pairs(spark, d), ["extraction"]))


@query(f"WITH {_PAIRS}, s AS (SELECT extraction, shard, {_SUMS} FROM pairs GROUP BY 1, 2) SELECT extraction, count(*)::BIGINT AS conditions, round(avg(character_errors / reference_characters), 9) AS macro_cer, round(avg(exact_matches / samples), 9) AS macro_accuracy FROM s GROUP BY 1")
def accuracy_macro(spark, d):
    conditions = op.with_rates(op.totals(pairs(spark, d), ["extraction", "shard"]))
    return conditions.groupBy("extraction").agg(F.count(F.lit(1)).alias("conditions"), F.round(F.avg("cer"), 9).alias("macro_cer"), F.round(F.avg("exact_accuracy"), 9).alias("macro_accuracy"))


@query(f"WITH {_PAIRS} SELECT extraction, shard, sum(errors)::BIGINT AS errors, sum(n)::BIGINT AS characters, sum(errors) / sum(n) AS cer FROM pairs GROUP BY GROUPING SETS ((extraction), (shard), ())")
def grid_summary_sets(spark, d):
    rows = pairs(spark, d).withColumn("errors", F.levenshtein("reference", "prediction").cast("long")).withColumn("n", F.col("n").cast("long"))
    sets = rows.groupingSets([["extraction"], ["shard"], []], "extraction", "shard").agg(F.sum("errors").alias("errors"), F.sum("n").alias("characters"))
    return sets.withColumn("cer", F.col("errors") / F.col("characters"))


@query(f"WITH {_PAIRS}, c AS (SELECT extraction, row_id, errors / nullif(n, 0) AS cer FROM pairs) SELECT extraction, row_id, cer, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY extraction ORDER BY cer DESC NULLS LAST, row_id) AS rank FROM c) WHERE rank <= 10")
def worst_topk(spark, d):
    rows = pairs(spark, d).select("extraction", "row_id", (F.levenshtein("reference", "prediction") / F.nullif(F.col("n"), F.lit(0))).alias("cer"))
    return op.worst(rows, "extraction", 10, "row_id")


@query(f"WITH {_PAIRS} SELECT row_id, base_errors::INTEGER AS baseline_errors, errors::INTEGER AS candidate_errors, (errors - base_errors)::INTEGER AS error_delta FROM pairs")
def baseline_delta(spark, d):
    rows = pairs(spark, d)
    base = rows.select("row_id", F.levenshtein("reference", F.replace("reference", F.lit("e"), F.lit("c"))).alias("errors"))
    return op.deltas(base, rows.select("row_id", F.levenshtein("reference", "prediction").alias("errors")), "row_id")


@query("""WITH r AS (SELECT image, count(*) AS rn, min(reference) AS reference, bool_and(coalesce(reference_verified, false)) AS ok FROM real_references GROUP BY 1),
 p AS (SELECT image, count(*) AS pn, min(replace(reference, 'e', 'c')) AS prediction FROM real_references WHERE notes IS NOT NULL GROUP BY 1)
 SELECT image, reference, prediction, CASE WHEN rn IS NULL OR pn IS NULL THEN 'missing' WHEN rn > 1 OR pn > 1 THEN 'duplicate' WHEN NOT ok THEN 'unverified' END AS problem FROM r FULL JOIN p USING (image)""")
def reference_prediction_join(spark, d):
    refs = table(spark, d, "real_references")
    return op.checked_pairs(refs, refs.where("notes is not null").select("image", F.replace("reference", F.lit("e"), F.lit("c")).alias("prediction")))


@query("WITH g AS (SELECT source, lang FROM (SELECT DISTINCT source FROM mix_targets) CROSS JOIN (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)), a AS (SELECT DISTINCT source, lang FROM documents) SELECT g.source, g.lang, 'missing' AS problem FROM g LEFT JOIN a ON g.source = a.source AND g.lang = a.lang WHERE a.source IS NULL UNION ALL SELECT a.source, a.lang, 'unexpected' FROM a LEFT JOIN g ON g.source = a.source AND g.lang = a.lang WHERE g.source IS NULL")
def grid_completeness(spark, d):
    docs = table(spark, d, "documents")
    return integrity.uncovered_grid(docs, table(spark, d, "mix_targets"), docs.where("lang is not null"), "source", "lang")


def _weighted(spark, d):
    """Pairs with quotation marks around "the" and in place of the Japanese ones: curly in the references, straight in the
    predictions."""
    rows = pairs(spark, d)
    for column, (a, b), marks in (("reference", "“”", "「」"), ("prediction", '""', "「』")):
        rows = rows.withColumn(column, F.translate(F.replace(column, F.lit("the "), F.lit(f"{a}the{b} ")), marks, a + b))
    return rows


@query()
def weighted_cer(spark, d):
    rows = _weighted(spark, d).withColumn("cost", op.weighted_distance(F.col("reference"), F.col("prediction")))
    return rows.groupBy("extraction").agg((F.sum("cost") / F.sum(F.length("reference"))).alias("weighted_cer"), F.sum("cost").alias("cost"))


@query()
def edit_confusions(spark, d):
    return op.confusions(pairs(spark, d))


@query(f"WITH {_PAIRS} SELECT sum(errors)::BIGINT AS edits FROM pairs")
def edit_totals(spark, d):
    """All edits of all alignments; each alignment has as many as the distance of its texts."""
    return edit_confusions(spark, d).agg(F.sum("count").alias("edits"))


@query()
def space_errors(spark, d):
    rows = op.confusions(pairs(spark, d)).where("reference = ' ' or prediction = ' '")
    return rows.groupBy("kind").agg(F.sum("count").alias("errors"))


@query()
def sequence_deletion_rates(spark, d):
    return op.sequence_rates(pairs(spark, d))


@query(r"WITH w AS (SELECT unnest(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_''-]+'), lambda w: regexp_full_match(w, '[A-Za-z]+([''-][A-Za-z]+)*'))) AS word FROM train), p AS (SELECT unnest(" + "[" + ", ".join(f"'{p}'" for p in tx.SEQUENCE_PATTERNS) + "]" + r") AS pattern) SELECT pattern, sum(len(list_filter(range(1, length(word) + 1), lambda i: substr(word, i, length(pattern)) = pattern)))::BIGINT AS occurrences FROM w CROSS JOIN p GROUP BY 1")
def sequence_occurrences(spark, d):
    return op.sequence_rates(pairs(spark, d)).select("pattern", "occurrences")


@query()
def punctuation_space_score(spark, d):
    # Parentheses, which train does not hold, take the place of the Japanese quotation marks.
    rows = pairs(spark, d).withColumn("reference", F.translate("reference", "「」", "（）"))
    prediction = F.replace("reference", F.lit(". "), F.lit(".  "))
    for a, b in (("（", " （"), ("）", "） "), ("、", "、 ")):
        prediction = F.replace(prediction, F.lit(a), F.lit(b))
    rows = rows.withColumn("prediction", prediction)
    scored = op.evaluation_texts(rows, {})
    return op.with_rates(op.totals(scored, ["extraction"]))


_WIDE = {chr(o + 0xFEE0): chr(o) for o in range(0x21, 0x7F)} | {"　": " "}


def _alias_sql() -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    out = f"translate(text, {quote(''.join(_WIDE))}, {quote(''.join(_WIDE.values()))})"
    for marks, mark in (("゛゙", "゙"), ("゜゚", "゚")):
        for m in marks:
            for base, whole in tx.compositions(mark):
                out = f"replace({out}, {quote(base + m)}, {quote(whole)})"
    return f"regexp_replace({out}, ' +', ' ', 'g')"


@query(f"SELECT row_id, normalised FROM (SELECT row_id, text, {_alias_sql()} AS normalised FROM train) WHERE normalised <> text")
def alias_normalize(spark, d):
    rows = table(spark, d, "train").select("row_id", "text", tx.alias_normalise(F.col("text"), _WIDE).alias("normalised"))
    return rows.where("normalised <> text").drop("text")


_BOXES = "b AS (SELECT l_returnflag AS model, l_linestatus AS threshold, l_orderkey AS page, least(l_quantity, floor(l_extendedprice / 2500))::BIGINT AS matches, l_quantity::BIGINT AS ground_truth, floor(l_extendedprice / 2000)::BIGINT AS predictions FROM lineitem)"
_F1 = "coalesce(sum(matches) / nullif(sum(ground_truth), 0), 0)::DOUBLE AS recall, coalesce(sum(matches) / nullif(sum(predictions), 0), 0)::DOUBLE AS precision, coalesce(2 * sum(matches) / nullif(sum(ground_truth) + sum(predictions), 0), 0)::DOUBLE AS f1"
_BOX_SUMS = "count(*)::BIGINT AS pages, sum(matches)::BIGINT AS matches, sum(ground_truth)::BIGINT AS ground_truth, sum(predictions)::BIGINT AS predictions"


def _counts(spark, d):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("threshold"), F.col("l_orderkey").alias("page"), F.least(q, F.floor(p / 2500)).cast("long").alias("matches"), q.cast("long").alias("ground_truth"), F.floor(p / 2000).cast("long").alias("predictions"))


@query(f"WITH {_BOXES} SELECT model, threshold, {_BOX_SUMS}, {_F1} FROM b GROUP BY 1, 2")
def detection_micro_f1(spark, d):
    return op.detection_scores(_counts(spark, d), ["model", "threshold"])


@query(f"WITH {_BOXES} SELECT page, {_BOX_SUMS}, {_F1} FROM b GROUP BY 1")
def per_page_scores(spark, d):
    return op.detection_scores(_counts(spark, d), ["page"])


@query("SELECT l_returnflag AS channel, l_shipmode_ AS region, count(*) FILTER (WHERE inside)::BIGINT AS pixels, round(avg(probability) FILTER (WHERE inside), 9) AS mean_probability, round(avg((probability >= 0.5)::INTEGER) FILTER (WHERE inside), 9) AS fraction_at_05 FROM (SELECT l_returnflag, l_linenumber AS l_shipmode_, l_discount * 10 AS probability, l_quantity >= 25 AND l_linenumber < 7 AS inside FROM lineitem) GROUP BY 1, 2")
def region_metrics(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("channel"), F.col("l_linenumber").alias("region"), (F.col("l_discount") * 10).alias("probability"), ((F.col("l_quantity") >= 25) & (F.col("l_linenumber") < 7)).alias("inside"))
    out = op.region_metrics(rows, ["channel", "region"])
    return out.select("channel", "region", "pixels", *[F.round(c, 9).alias(c) for c in ("mean_probability", "fraction_at_05")])


@query("SELECT l_returnflag AS channel, sum(l_quantity) AS pixels, round(sum(v * CASE WHEN v IS NOT NULL THEN l_quantity END) / nullif(sum(l_quantity), 0), 9) AS mean_probability FROM (SELECT *, CASE WHEN l_tax > 0 THEN l_discount END AS v FROM lineitem) GROUP BY 1")
def weighted_region_merge(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("channel"), F.col("l_quantity").alias("pixels"), F.when(F.col("l_tax") > 0, F.col("l_discount")).alias("mean_probability"))
    return op.weighted_merge(rows, ["channel"], "mean_probability").withColumn("mean_probability", F.round("mean_probability", 9))


@query("""WITH x AS (SELECT l_suppkey AS sample, l_returnflag AS channel, l_discount * 10 AS p, l_tax * 12.5 AS t, (l_linestatus = 'F')::INTEGER::DOUBLE AS v FROM lineitem),
 y AS (SELECT *, (p >= 0.5)::INTEGER AS pb, (t >= 0.5)::INTEGER AS tb FROM x),
 z AS (SELECT sample, channel, sum(abs(p - t) * v) / greatest(1, sum(v)) AS mae, (2 * sum(p * t * v) + 1e-6) / (sum((p + t) * v) + 1e-6) AS soft_dice, (sum(pb * tb * v) + 1e-6) / (sum(pb * v) + 1e-6) AS precision_at_05, (sum(pb * tb * v) + 1e-6) / (sum(tb * v) + 1e-6) AS recall_at_05, (2 * sum(pb * tb * v) + 1e-6) / (sum((pb + tb) * v) + 1e-6) AS f1_at_05 FROM y GROUP BY 1, 2)
 SELECT channel, round(avg(mae), 9) AS mae, round(avg(soft_dice), 9) AS soft_dice, round(avg(precision_at_05), 9) AS precision_at_05, round(avg(recall_at_05), 9) AS recall_at_05, round(avg(f1_at_05), 9) AS f1_at_05 FROM z GROUP BY 1""")
def boundary_scores(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_returnflag").alias("channel"), (F.col("l_discount") * 10).alias("probability"), (F.col("l_tax") * 12.5).alias("target"), (F.col("l_linestatus") == "F").alias("valid"))
    out = op.boundary_scores(rows, "sample", "channel")
    return out.select("channel", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


@query("SELECT l_suppkey AS sample, round(avg(abs(l_discount * 10 - l_tax * 12.5)), 9) AS mae, coalesce(2.0 * count(*) FILTER (WHERE l_discount >= 0.05 AND l_tax >= 0.04) / nullif(count(*) FILTER (WHERE l_discount >= 0.05) + count(*) FILTER (WHERE l_tax >= 0.04), 0), 1)::DOUBLE AS f1 FROM lineitem GROUP BY 1")
def simple_mae_f1(spark, d):
    p, t = F.col("l_discount") >= 0.05, F.col("l_tax") >= 0.04
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample")).agg(F.round(F.avg(F.abs(F.col("l_discount") * 10 - F.col("l_tax") * 12.5)), 9).alias("mae"), op.simple_f1(F.count_if(p & t), F.count_if(p), F.count_if(t)).alias("f1"))


@query("SELECT event_type, round(sum(value * user_id) / sum(user_id), 9) AS mean_value, count(*)::BIGINT AS batches FROM events WHERE user_id > 0 GROUP BY 1")
def epoch_weighted_mean(spark, d):
    return table(spark, d, "events").where("user_id > 0").groupBy("event_type").agg(F.round(F.sum(F.col("value") * F.col("user_id")) / F.sum("user_id"), 9).alias("mean_value"), F.count(F.lit(1)).alias("batches"))


@query("SELECT l_returnflag, l_linenumber, round(sum((l_extendedprice * 100)::DECIMAL(38, 0))::DOUBLE / 100, 2) AS total FROM lineitem GROUP BY 1, 2")
def exact_loss_sums(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linenumber", "l_extendedprice")
    return op.exact_sums(rows, ["l_returnflag", "l_linenumber"], "l_extendedprice").withColumn("total", F.round("total", 2))


@query("""WITH b AS (SELECT user_id, event_id, value, min(value) OVER (PARTITION BY user_id ORDER BY event_id) AS best_value FROM events),
 f AS (SELECT *, max(CASE WHEN value = best_value AND (prior IS NULL OR value < prior) THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS best_epoch FROM (SELECT *, lag(best_value) OVER (PARTITION BY user_id ORDER BY event_id) AS prior FROM b))
 SELECT user_id, event_id, value, best_value, best_epoch, event_id - best_epoch >= 500 AS stop FROM f""")
def best_and_patience(spark, d):
    return op.epochs_since_best(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", 500)


@query("SELECT event_id, user_id, sum(ms) OVER w ::BIGINT AS elapsed_ms, count(*) OVER w AS done, sum(ms) OVER w / count(*) OVER w * (count(*) OVER (PARTITION BY user_id) - count(*) OVER w) AS remaining_ms FROM (SELECT *, round(value * 1000)::BIGINT AS ms FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def elapsed_and_remaining(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, d, "events").withColumn("ms", F.round(F.col("value") * 1000).cast("long"))
    done, elapsed = F.count(F.lit(1)).over(w), F.sum("ms").over(w)
    return rows.select("event_id", "user_id", elapsed.alias("elapsed_ms"), done.alias("done"), (elapsed / done * (F.count(F.lit(1)).over(Window.partitionBy("user_id")) - done)).alias("remaining_ms"))


@query("SELECT row_id, array_to_string(list_filter(list_filter(p, lambda x, i: i = 1 OR x <> p[i - 1]), lambda x: x <> 0), ' ') AS collapsed FROM (SELECT row_id, list_transform(string_split(text, ''), lambda c: unicode(c) % 3) AS p FROM train)")
def ctc_collapse(spark, d):
    path = F.transform(tx.characters(F.col("text")), lambda c: F.ascii(c) % 3)
    return table(spark, d, "train").select("row_id", F.array_join(F.transform(op.ctc_collapse(path), lambda x: x.cast("string")), " ").alias("collapsed"))


@query("SELECT row_id, len(list_filter(range(2, length(text) + 1), lambda i: substr(text, i, 1) = substr(text, i - 1, 1)))::INTEGER AS repeats FROM train")
def adjacent_repeats(spark, d):
    return table(spark, d, "train").select("row_id", op.adjacent_repeats(F.col("text")).alias("repeats"))


@query("""WITH h AS (SELECT l_suppkey AS image, l_quantity::BIGINT AS level, count(*) AS n FROM lineitem GROUP BY 1, 2),
 c AS (SELECT *, sum(n) OVER w AS below, sum(n * level) OVER w AS mass, sum(n) OVER (PARTITION BY image) AS total, sum(n * level) OVER (PARTITION BY image) AS total_mass FROM h WINDOW w AS (PARTITION BY image ORDER BY level)),
 b AS (SELECT image, level, CASE WHEN total > below THEN (mass * (total - below) - (total_mass - mass) * below)::DOUBLE * (mass * (total - below) - (total_mass - mass) * below) / (below::DOUBLE * (total - below)) END AS between_ FROM c)
 SELECT image, level FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY between_ DESC NULLS LAST, level) AS k FROM b) WHERE k = 1""")
def otsu_levels(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("image"), F.col("l_quantity").cast("long").alias("level"), F.lit(1).alias("n"))
    return op.otsu_levels(rows, "image", "level", "n")
