"""Readers: Parquet, JSON lines, plain lines, single JSON documents, Unicode data files, font tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet file or folder; only the named columns are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def head_of_each_file(spark: SparkSession, path: str, order: str, n: int) -> DataFrame:
    """The first n rows, in order, of each file of a folder, with the file's name."""
    df = spark.read.parquet(path).withColumn("shard", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return df.withColumn("rank_", F.row_number().over(Window.partitionBy("shard").orderBy(order))).where(F.col("rank_") <= n).drop("rank_")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a given schema; a malformed line stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): one row per line; only the final line feed of a line is dropped."""
    return spark.read.option("lineSep", "\n").text(path)


def json_document(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold one JSON value each."""
    return spark.read.option("multiLine", True).json(path)


def label_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(image, value...): the entries of one JSON object {image: value}, `value` being the values' struct type."""
    raw = spark.read.text(path, wholetext=True)
    entries = raw.select(F.explode(F.from_json("value", f"map<string,{value}>", {"mode": "FAILFAST"})).alias("image", "v"))
    return entries.select("image", "v.*")


def unicode_properties(spark: SparkSession, path: str) -> DataFrame:
    """(code_point, property) of a `low[..high] ; property # comment` file, ranges expanded."""
    body = F.trim(F.regexp_replace("value", "#.*$", ""))
    rows = text_lines(spark, path).select(body.alias("b")).where("b <> ''").select(F.split("b", r"\s*;\s*").alias("f"))
    span = F.split(F.col("f")[0], r"\.\.")
    low, high = F.conv(span[0], 16, 10).cast("int"), F.conv(F.element_at(span, -1), 16, 10).cast("int")
    return rows.select(F.explode(F.sequence(low, high)).alias("code_point"), F.col("f")[1].alias("property"))


def code_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(sequence, fields): files of `;`-separated fields whose first is a list of hex code points; # starts a comment."""
    body = F.trim(F.regexp_replace("value", "#.*$", ""))
    rows = text_lines(spark, path).select(body.alias("b")).where("b <> ''").select(F.split("b", r"\s*;\s*").alias("fields"))
    # With a byte order mark before it, U+FEFF itself is read as a character.
    chars = F.transform(F.split(F.col("fields")[0], r"\s+"), lambda h: F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(h, 8, "0"))), "UTF-32"))
    return rows.select(F.array_join(chars, "").alias("sequence"), F.slice("fields", 2, 100).alias("fields"))


def files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, length, modificationTime, sha256, content) of files below a folder whose names match the pattern."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return found.withColumn("sha256", F.sha2("content", 256))


def verified(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, problem): files that are missing, of another size or of another digest than expected (name, size, sha256)."""
    have = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("sha256").alias("actual"))
    rows = expected.join(have, "name", "left")
    problem = F.when(F.col("length").isNull(), "missing").when(F.col("length") != F.col("size"), "size").when(F.col("actual") != F.col("sha256"), "digest")
    return rows.select("name", problem.alias("problem")).where("problem is not null")


# Fixed value: right-hand columns of a font listing: embedded, subset, character map, object and generation.
FONT_ROW = r"^(.*?)\s+(yes|no)\s+(yes|no)\s+(yes|no)\s+(\d+)\s+(\d+)\s*$"


def font_table(listing: DataFrame, document: str = "document", text: str = "value") -> DataFrame:
    """(document, description, embedded, subset, to_unicode, object_id, generation) of font listings, one text each.

    Rows below the dashed line are fonts; a listing without that line, or a row of another form, is an error.
    """
    rows = listing.select(document, F.split(text, r"\r?\n").alias("rows"))
    head = F.array_position(F.transform("rows", lambda r: F.startswith(r, F.lit("---"))), True)
    body = F.when(head > 0, F.filter(F.slice("rows", head.cast("int") + 1, F.size("rows") + 1), lambda r: F.trim(r) != "")).otherwise(F.raise_error(F.lit("font listing without header")).cast("array<string>"))
    one = rows.select(document, F.explode(body).alias("r"))
    ok = F.when(F.col("r").rlike(FONT_ROW), F.col("r")).otherwise(F.raise_error(F.concat(F.lit("unknown font row: "), "r")).cast("string"))
    part = lambda i: F.regexp_extract(ok, FONT_ROW, i)
    return one.select(document, F.trim(part(1)).alias("description"), *[(part(i) == "yes").alias(n) for i, n in ((2, "embedded"), (3, "subset"), (4, "to_unicode"))], part(5).cast("int").alias("object_id"), part(6).cast("int").alias("generation"))


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of `id<tab>text` lines; ids are lower-case words with digits and hyphens and must be unique."""
    rows = text_lines(spark, path).where("trim(value) <> ''").select(F.split("value", "\t", 2).alias("f"))
    good = F.when((F.size("f") == 2) & F.col("f")[0].rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), F.col("f")[0]).otherwise(F.raise_error(F.lit("bad prompt id")).cast("string"))
    df = rows.select(good.alias("id"), F.col("f")[1].alias("text"))
    return df.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("id"))).select(F.when(F.col("n") == 1, F.col("id")).otherwise(F.raise_error(F.lit("repeated prompt id")).cast("string")).alias("id"), "text")


def leading_lines(lines: DataFrame, document: str, order: list[str], low: int, high: int, aspect: float, n: int = 4) -> DataFrame:
    """The first n lines of each document whose text has low to high characters and whose box is at least `aspect` wide
    for its height."""
    fit = F.length("text").between(low, high) & (F.col("x1") - F.col("x0") >= aspect * (F.col("y1") - F.col("y0")))
    return lines.where(fit).withColumn("rank_", F.row_number().over(Window.partitionBy(document).orderBy(*order))).where(F.col("rank_") <= n).drop("rank_")


def recipes(spark: SparkSession, folder: str, schema: str, versions: tuple[int, ...]) -> DataFrame:
    """The samples of a finished recipe data set: samples.jsonl beside a manifest.json whose schema version is known, whose
    status is complete and whose count is that of the samples; anything else is a ValueError."""
    manifest = spark.read.schema("schema_version int, status string, count long").option("multiLine", True).json(f"{folder}/manifest.json").first()
    if manifest is None or manifest.schema_version not in versions or manifest.status != "complete":
        raise ValueError("not a completed data set of a known schema version")
    rows = json_lines(spark, f"{folder}/samples.jsonl", schema)
    if rows.count() != manifest["count"]:
        raise ValueError("the number of samples differs from the manifest")
    return rows


def indexed(spark: SparkSession, path: str, identity: str) -> DataFrame:
    """A table written by writers.write_indexed, if it was made from the same inputs; otherwise a ValueError."""
    found = spark.read.text(f"{path}/_identity").first()
    if found is None or found["value"] != identity:
        raise ValueError("the index was made from other inputs")
    return spark.read.parquet(f"{path}/data")


def looked_up(keys: DataFrame, articles: DataFrame, key: str) -> DataFrame:
    """keys with the columns of their articles: a point lookup for many keys at once; a key that the store lacks is an
    error, repeated keys are all answered."""
    rows = keys.join(articles.withColumn("there_", F.lit(True)), key, "left")
    ok = F.when(F.col("there_"), F.col(key)).otherwise(F.raise_error(F.lit("unknown article")).cast(dict(keys.dtypes)[key]))
    return rows.withColumn(key, ok).drop("there_")
