import json

import pytest
from pyspark.sql import functions as F

from sumire.sources import readers, writers
from sumire.streaming import logs


def test_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, f"行 {i}") for i in range(20)], "pos int, text string").repartition(5)
    writers.write_lines(df, "text", "pos", f"{tmp_path}/out")
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == "".join(f"行 {i}\n" for i in range(20))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        writers.write_lines(df, "text", "pos", f"{tmp_path}/out")


@pytest.mark.parametrize("bad", [None, "", "a\nb", "a b"])
def test_lines_reject(spark, tmp_path, bad):
    with pytest.raises(Exception, match="single line"):
        writers.write_lines(spark.createDataFrame([(1, bad)], "pos int, text string"), "text", "pos", f"{tmp_path}/out")


def test_json_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a b\x85c", 1), (None, 2)], "t string, n int")
    writers.write_json_lines(df, f"{tmp_path}/out")
    raw = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert " " not in raw and "\x85" not in raw
    assert sorted(tuple(r) for r in readers.json_lines(spark, f"{tmp_path}/out", "t string, n int").where("n = 1").collect()) == [("a b\x85c", 1)]


def test_malformed_json_stops(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"n": 1}\n{"n": oops\n')
    with pytest.raises(Exception):
        readers.json_lines(spark, f"{tmp_path}/x.json", "n int").collect()


def test_plain_lines_keep_carriage_returns(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"a\r\nb \n")
    assert [r.value for r in readers.text_lines(spark, f"{tmp_path}/x.txt").collect()] == ["a\r", "b "]


def test_label_map(spark, tmp_path):
    (tmp_path / "labels.json").write_text(json.dumps({"a.png": {"img_hash": "h", "img_dimensions": [3, 4]}, "b.png": {"img_hash": "k", "img_dimensions": [5, 6]}}, indent=1))
    rows = readers.label_map(spark, f"{tmp_path}/labels.json", "struct<img_hash:string,img_dimensions:array<int>>").orderBy("image").collect()
    assert [(r.image, r.img_hash, r.img_dimensions) for r in rows] == [("a.png", "h", [3, 4]), ("b.png", "k", [5, 6])]
    assert readers.json_document(spark, f"{tmp_path}/labels.json").count() == 1


def test_unicode_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# head\n0041..0043 ; Latin # letters\n3042 ; Hiragana\n\n")
    got = {(r.code_point, r.property) for r in readers.unicode_properties(spark, f"{tmp_path}/p.txt").collect()}
    assert got == {(0x41, "Latin"), (0x42, "Latin"), (0x43, "Latin"), (0x3042, "Hiragana")}
    (tmp_path / "s.txt").write_text("845B E0101; Collection; CID+1 # c\n20B9F ; X ; y\n")
    got = {(r.sequence, tuple(r.fields)) for r in readers.code_sequences(spark, f"{tmp_path}/s.txt").collect()}
    assert got == {("葛\U000e0101", ("Collection", "CID+1")), ("𠮟", ("X", "y"))}


LISTING = """name                    type         encoding    emb sub uni object ID
----------------------- ------------ ----------- --- --- --- ---------
ABCDEF+Ryumin Light     CID Type 0C  Identity-H  yes yes no       9  0
Gothic                  TrueType     WinAnsi     no  no  yes     12  3
"""


def test_font_table(spark):
    df = spark.createDataFrame([("d", LISTING)], "document string, value string")
    rows = readers.font_table(df).orderBy("object_id").collect()
    assert [(r.embedded, r.subset, r.to_unicode, r.object_id, r.generation) for r in rows] == [(True, True, False, 9, 0), (False, False, True, 12, 3)]
    for bad in ("no header", LISTING + "what is this\n"):
        with pytest.raises(Exception, match="font"):
            readers.font_table(spark.createDataFrame([("d", bad)], "document string, value string")).collect()


def test_prompts(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("a-1\tfirst\nb\tsecond\n")
    assert {r.id for r in readers.prompts(spark, f"{tmp_path}/p.tsv").collect()} == {"a-1", "b"}
    for bad in ("A\tx\n", "a\tx\na\ty\n", "a\n"):
        (tmp_path / "q.tsv").write_text(bad)
        with pytest.raises(Exception, match="prompt id"):
            readers.prompts(spark, f"{tmp_path}/q.tsv").collect()


def test_files_and_digests(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.bin").write_bytes(b"abc")
    found = readers.files(spark, str(tmp_path), "*.bin")
    digest = found.first().sha256
    expected = spark.createDataFrame([("a.bin", 3, digest), ("b.bin", 1, "x")], "name string, size long, sha256 string")
    assert [tuple(r) for r in readers.verified(found, expected).collect()] == [("b.bin", "missing")]


def test_heads_of_files_and_pruning(spark, tmp_path):
    spark.range(10).withColumn("x", F.lit(1)).repartition(2).write.parquet(f"{tmp_path}/t")
    got = readers.head_of_each_file(spark, f"{tmp_path}/t", "id", 2)
    assert got.count() == 4 and got.select("shard").distinct().count() == 2
    plan = readers.parquet(spark, f"{tmp_path}/t", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan


def test_leading_lines(spark):
    df = spark.createDataFrame([("d", i, "x" * (10 + i), 0.0, 0.0, 100.0, 10.0) for i in range(6)] + [("d", 9, "x" * 10, 0.0, 0.0, 10.0, 10.0)], "doc string, i int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [r.i for r in readers.leading_lines(df, "doc", ["i"], 11, 30, 3.0).collect()] == [1, 2, 3, 4]


def test_append_log_ignores_what_was_not_committed(spark, tmp_path):
    path = f"{tmp_path}/log"
    for batch in (0, 1, 1, 2):
        writers.append_batch(spark.range(2), path, batch)
    assert writers.committed(spark, path, 1).count() == 4


def test_merged_labels(spark):
    a = spark.createDataFrame([("x.png",)], "image string")
    assert {r.image for r in writers.merged_labels([("one", a), ("two", a)]).collect()} == {"one-x.png", "two-x.png"}
    with pytest.raises(Exception, match="repeated"):
        writers.merged_labels([("one", a), ("one", a)]).collect()


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", None)], "x string, y int")
    assert writers.markdown_table(df, 5).splitlines() == ["| x | y |", "| --- | --- |", "| a\\|b |  |"]
    writers.write_csv(df, f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").columns == ["x", "y"]


def test_stream_appends_each_batch_once(spark, tmp_path):
    spark.range(6).selectExpr("id", "timestamp_seconds(id * 86400) as ts", "'k' as kind", "cast(id as double) as v").repartition(3).write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    for _ in range(2):
        logs.log_to(logs.event_stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/log").count() == 6
    totals = logs.windowed_totals(logs.event_stream(spark, f"{tmp_path}/in", schema, 10), "ts", "kind", "v", late="1 day")
    q = totals.writeStream.format("memory").queryName("totals").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(total) as s, max(n) as n from totals").first().n == 1


def test_workers_elsewhere_find_the_package(tmp_path):
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from sumire.operators import corpus
from sumire.session import ship
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
ship(s); ship(s)
print("rows", corpus.character_counts(s.createDataFrame([("ab",)], "text string")).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "rows 2" in done.stdout, done.stderr[-800:]
