"""Writers that never leave half a result: an output is complete or absent, and is never overwritten unasked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Line separators of Unicode that JSON need not escape and line readers may split at.
_SEPARATORS = {"\x85": "\\u0085", "\u2028": "\\u2028", "\u2029": "\\u2029"}


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines without raw U+0085, U+2028 and U+2029. An existing output is an error."""
    value = F.to_json(F.struct(*df.columns))
    for raw, escaped in _SEPARATORS.items():
        value = F.replace(value, F.lit(raw), F.lit(escaped))
    df.select(value.alias("value")).write.mode("errorifexists").text(path)


def write_lines(df: DataFrame, text: str, order: str, path: str) -> None:
    """One text per line in order; a null or empty text, or one that holds a line separator, is an error.

    Rows are range-partitioned by the order, so part files in name order are the whole in order.
    """
    bad = F.col(text).isNull() | (F.col(text) == "") | F.col(text).rlike(r"[\r\n\x{85}\x{2028}\x{2029}]")
    value = F.when(bad, F.raise_error(F.lit("not a single line")).cast("string")).otherwise(F.col(text))
    df.repartitionByRange(order).sortWithinPartitions(order).select(value.alias("value")).write.mode("errorifexists").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def markdown_table(df: DataFrame, limit: int) -> str:
    """A report table of at most `limit` rows."""
    rows = df.limit(limit).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def append_batch(df: DataFrame, path: str, batch: int) -> None:
    """Add a numbered batch to a log; writing the same batch again replaces it, so a retry adds nothing twice."""
    df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def committed(spark: SparkSession, path: str, last: int) -> DataFrame:
    """The log up to the last committed batch; later batches, left by a run that broke off, are not read."""
    return spark.read.parquet(path).where(F.col("batch") <= last)


def merged_labels(parts: list[tuple[str, DataFrame]], name: str = "image") -> DataFrame:
    """Union of label tables, each name with its part's prefix; a name that then occurs twice is an error."""
    from functools import reduce

    from pyspark.sql import Window

    rows = reduce(lambda a, b: a.unionByName(b), [df.withColumn(name, F.concat(F.lit(prefix + "-"), name)) for prefix, df in parts])
    n = F.count(F.lit(1)).over(Window.partitionBy(name))
    return rows.withColumn(name, F.when(n == 1, F.col(name)).otherwise(F.raise_error(F.lit("repeated name")).cast("string")))


def write_json_document(spark: SparkSession, text: str, path: str, overwrite: bool = False) -> None:
    """One JSON text as one file: written under another name beside it and renamed, so that readers see all of it or none.
    An existing file is an error unless it is to be replaced."""
    import json
    import uuid

    json.loads(text)
    jvm = spark.sparkContext._jvm
    target, temporary = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target) and not overwrite:
        raise FileExistsError(path)
    out = fs.create(temporary, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if overwrite:
        fs.delete(target, False)
    if not fs.rename(temporary, target):
        fs.delete(temporary, False)
        raise FileExistsError(path)


def write_indexed(df: DataFrame, path: str, identity: str) -> None:
    """A table with the identity of the inputs it was made from; the identity is written last, so a table without one is
    unfinished."""
    df.write.mode("errorifexists").parquet(f"{path}/data")
    df.sparkSession.createDataFrame([(identity,)], "value string").coalesce(1).write.text(f"{path}/_identity")


def html_table(df: DataFrame, limit: int, title: str = "") -> str:
    """A report page with a table of at most `limit` rows; all values are escaped."""
    from html import escape

    cell = lambda tag, v: f"<{tag}>{'' if v is None else escape(str(v))}</{tag}>"
    body = "".join("<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in df.limit(limit).collect())
    return f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><table><tr>{''.join(cell('th', c) for c in df.columns)}</tr>{body}</table>"
