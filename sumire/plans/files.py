"""Sources and sinks over the driver's tables: what is written to the shared folder is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.hashing import shuffle_key
from ..operators import corpus, integrity
from ..session import Workspace, shared_folder, table
from ..sources import readers, writers
from ..streaming import logs
from .corpus import SEED, _sha
from .registry import query


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/work-{uuid.uuid4().hex}"


@query("SELECT label_id, image, source_pdf, page, split FROM labels")
def json_lines_round_trip(spark, d):
    path = _folder(spark)
    writers.write_json_lines(table(spark, d, "labels").select("label_id", "image", "source_pdf", "page", "split"), path)
    return readers.json_lines(spark, path, "label_id long, image string, source_pdf string, page int, split string")


@query(r"SELECT text AS value, count(*)::BIGINT AS n FROM train WHERE text <> '' AND NOT regexp_matches(text, '[\r\n\x{85}\x{2028}\x{2029}]') GROUP BY 1")
def text_lines_round_trip(spark, d):
    path = _folder(spark)
    rows = table(spark, d, "train").where((F.col("text") != "") & ~F.col("text").rlike(r"[\r\n\x{85}\x{2028}\x{2029}]"))
    writers.write_lines(rows, "text", "row_id", path)
    return readers.text_lines(spark, path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT article_id, split, source FROM article_splits WHERE article_id IS NOT NULL")
def csv_round_trip(spark, d):
    path = _folder(spark)
    writers.write_csv(table(spark, d, "article_splits").where("article_id is not null").select("article_id", "split", "source"), path)
    return spark.read.option("header", True).schema("article_id string, split string, source string").csv(path)


@query("SELECT image, max(page)::INTEGER AS page, max(line_count)::INTEGER AS lines FROM labels GROUP BY 1")
def label_map_round_trip(spark, d):
    """Label maps of some thousand images each, one JSON object per map."""
    path = _folder(spark)
    rows = table(spark, d, "labels").groupBy("image").agg(F.max("page").alias("page"), F.max("line_count").alias("lines"))
    maps = rows.groupBy(F.pmod(F.xxhash64("image"), F.lit(64)).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("image", F.struct("page", "lines"))))).alias("value"))
    maps.repartition(64, "part").select("value").write.option("lineSep", "\n").text(path)
    whole = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,struct<page:int,lines:int>>")).alias("image", "v"))
    return whole.select("image", "v.*")


@query("SELECT representative, m AS member FROM (SELECT representative, unnest(members) AS m FROM character_aliases_quotes_homoglyphs) GROUP BY 1, 2")
def json_document_round_trip(spark, d):
    """The alias table as one JSON document, written whole or not at all."""
    path = f"{_folder(spark)}/aliases.json"
    rows = table(spark, d, "character_aliases_quotes_homoglyphs").select("representative", F.explode("members").alias("member")).distinct()
    text = rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct("representative", "member")))).alias("j")).first()["j"]
    writers.write_json_document(spark, text, path)
    return readers.json_document(spark, path).select("representative", "member")


@query("SELECT l_linenumber * 256 + unnest(range(0, 20)) AS code_point, 'Line ' || l_linenumber AS property FROM (SELECT DISTINCT l_linenumber FROM lineitem)")
def unicode_property_file(spark, d):
    path = _folder(spark)
    n = table(spark, d, "lineitem").select("l_linenumber").distinct()
    low = F.col("l_linenumber") * 256
    n.select(F.concat(F.hex(low), F.lit(".."), F.hex(low + 19), F.lit(" ; Line "), F.col("l_linenumber"), F.lit(" # comment")).alias("value")).write.text(path)
    return readers.unicode_properties(spark, path)


@query("SELECT DISTINCT character AS sequence, 'U' || unicode(character) AS note FROM (SELECT unnest(string_split(reference, '')) AS character FROM real_references WHERE reference <> '')")
def code_sequence_file(spark, d):
    path = _folder(spark)
    chars = corpus.character_counts(table(spark, d, "real_references"), "reference").select("character")
    chars.select(F.concat(F.hex(F.ascii("character")), F.lit(" ; U"), F.ascii("character"), F.lit(" # x")).alias("value")).write.text(path)
    return readers.code_sequences(spark, path).select("sequence", F.col("fields")[0].alias("note"))


@query("SELECT font_name AS document, font_name AS description, bool_or(coalesce(to_unicode, false)) AS to_unicode, count(*)::INTEGER AS object_id FROM page_lines WHERE font_name IS NOT NULL GROUP BY 1")
def font_listing(spark, d):
    """A listing of each font in the form of the command that prints them, parsed again."""
    fonts = table(spark, d, "page_lines").where("font_name is not null").groupBy("font_name").agg(F.max(F.coalesce("to_unicode", F.lit(False))).alias("mapped"), F.count(F.lit(1)).alias("n"))
    row = F.concat_ws(" ", "font_name", F.lit("yes no"), F.when(F.col("mapped"), "yes").otherwise("no"), F.col("n").cast("string"), F.lit("0"))
    listing = fonts.select(F.col("font_name").alias("document"), F.concat(F.lit("name emb sub uni object ID\n-------------\n"), row).alias("value"))
    return readers.font_table(listing).select("document", "description", "to_unicode", "object_id")


@query("SELECT image, line_id, k::INTEGER AS place FROM (SELECT image, line_id, row_number() OVER (PARTITION BY image ORDER BY source_block, line_id) AS k FROM page_lines WHERE length(text) BETWEEN 5 AND 40 AND bbox[3] - bbox[1] >= 3 * (bbox[4] - bbox[2])) WHERE k <= 4")
def leading_lines(spark, d):
    from pyspark.sql import Window

    box = [F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    rows = readers.leading_lines(table(spark, d, "page_lines").select("image", "line_id", "source_block", "text", *box), "image", ["source_block", "line_id"], 5, 40, 3.0)
    return rows.select("image", "line_id", F.row_number().over(Window.partitionBy("image").orderBy("source_block", "line_id")).alias("place"))


@query("SELECT lower(event_type) || '-' || user_id AS id, 'n ' || count(*) AS text FROM events GROUP BY event_type, user_id")
def prompt_file(spark, d):
    path = _folder(spark)
    counts = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    counts.select(F.concat(F.lower("event_type"), F.lit("-"), "user_id", F.lit("\tn "), "n").alias("value")).write.text(path)
    return readers.prompts(spark, path)


@query("SELECT event_type, (user_id % 3)::INTEGER AS batch, count(*)::BIGINT AS n, sum(count(*)) OVER (PARTITION BY event_type ORDER BY user_id % 3)::BIGINT AS so_far FROM events GROUP BY event_type, user_id % 3")
def append_log_counters(spark, d):
    """Three numbered batches in a log, one of them written twice as after a failure, and the running counters over it."""
    path = _folder(spark)
    events = table(spark, d, "events")
    for batch in (0, 1, 1, 2):
        writers.append_batch(events.where(F.col("user_id") % 3 == batch).select("event_id", "event_type"), path, batch)
    return logs.running_counters(spark, path, 2, "event_type").select("event_type", "batch", "n", "so_far")


@query("SELECT split || '-' || label_id AS image, page FROM (SELECT 'a' AS split, label_id, page FROM labels WHERE split = 'train' UNION ALL SELECT 'b', label_id, page FROM labels WHERE split = 'test')")
def merged_label_sets(spark, d):
    labels = table(spark, d, "labels").withColumn("image", F.col("label_id").cast("string"))
    return writers.merged_labels([(p, labels.where(F.col("split") == s).select("image", "page")) for p, s in (("a", "train"), ("b", "test"))])


@query("SELECT count(*)::BIGINT AS files, true AS same FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)")
def file_digests(spark, d):
    """Files of each language written twice: the digests of their contents, gathered whatever the files are called, agree."""
    path = _folder(spark)
    docs = table(spark, d, "documents").where("lang is not null")
    titles = docs.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("title", F.lit("")))), "\n").alias("value"))
    for copy in ("a", "b"):
        titles.repartition("lang").write.partitionBy("lang").text(f"{path}/{copy}")
    digests = lambda c: readers.files(spark, f"{path}/{c}", "*.txt").select(F.regexp_extract("path", "lang=([^/]*)", 1).alias("name"), "sha256")
    a = Workspace(spark).write(digests("a"), "a")
    wrong = integrity.copied_files(a, digests("b")).agg(F.count(F.lit(1)).alias("wrong"))
    return a.agg(F.count_distinct("name").alias("files")).crossJoin(wrong).select("files", (F.col("wrong") == 0).alias("same"))


@query(f"""WITH o AS (SELECT text, row_number() OVER (ORDER BY {_sha(SEED, 'row_id')}, row_id) - 1 AS o FROM train), h AS (SELECT o, sha256(coalesce(text, chr(0))) AS h FROM o), b AS (SELECT floor(o / 4096) AS block, count(*) AS n, sha256(string_agg(h, '' ORDER BY o, h)) AS h FROM h GROUP BY 1)
 SELECT sum(n)::BIGINT AS "rows", sha256(string_agg(h, '' ORDER BY block)) AS digest FROM b""")
def rebuild_digest(spark, d):
    """The digest that a shuffled data set has when it is built again from its inputs and seed."""
    rows = table(spark, d, "train").select(F.concat_ws("/", shuffle_key(F.col("row_id"), SEED), F.lpad(F.col("row_id").cast("string"), 20, "0")).alias("place"), "text")
    return integrity.content_digest(corpus.with_ordinal(rows, "place"), "ordinal", "text", [])


@query("SELECT row_id, array_to_string(list_filter(string_split(text, ''), lambda c, i: list_position(string_split(text, ''), c) = i), '') AS characters FROM train WHERE text <> ''")
def ordered_dedupe(spark, d):
    return table(spark, d, "train").where("text <> ''").select("row_id", F.array_join(F.array_distinct(tx.characters(F.col("text"))), "").alias("characters"))
