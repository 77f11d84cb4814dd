import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sumire.functions import characters, geometry, hashing, text as tx


@pytest.mark.parametrize("key", ["0", "17", "記事", "a:b"])
def test_hash_splits_follow_the_digest(run, key):
    whole = hashlib.sha256(f"s:{key}".encode()).hexdigest()
    assert run(lambda c: hashing.bucket(c, "s", 16, 100), key) == int(whole[:16], 16) % 100
    assert run(lambda c: hashing.wide_bucket(c, "s", 10), key) == int(whole, 16) % 10
    b = int(whole[:16], 16) % 100
    assert run(lambda c: hashing.article_split(c, "s"), key) == ("train" if b < 90 else "validation" if b < 95 else "test")


def test_hash_of_null_is_null(spark):
    row = spark.range(1).select(F.lit(None).cast("string").alias("k")).select(hashing.bucket(F.col("k"), "s", 8, 5).alias("a"), hashing.wide_bucket(F.col("k"), "s", 10).alias("b"), hashing.article_split(F.col("k"), "s").alias("c")).first()
    assert tuple(row) == (None, None, None)


@pytest.mark.parametrize("text,pattern,n", [("fff office", "ff", 3), ("fff office", "ffi", 1), ("", "ff", 0), ("a.a", ".", 1)])
def test_overlapping_occurrences(run, text, pattern, n):
    assert run(lambda c: tx.occurrences(c, pattern), text) == n


GOOD = "The old register of the town was copied in spring by two clerks and sent to the archive for safe keeping."


@pytest.mark.parametrize(
    "line,ok",
    [
        (GOOD, True),
        (GOOD.replace("archive", "https://archive"), False),
        (GOOD.replace("archive", "{archive|x}"), False),
        ("A B C D E F G H " + GOOD, False),
        (GOOD[:60], False),
        (GOOD.replace("the", "das").replace("of", "von").replace("in ", "am ").replace("was", "war").replace("to", "zu").replace("for", "zum").replace("by", "von").replace("and", "und").replace("The", "Das"), False),
        ("", False),
    ],
)
def test_english_prose(run, line, ok):
    assert run(tx.english_prose, line) is ok


@pytest.mark.parametrize(
    "text,title,ok",
    [
        ("この町の記録について説明しています。", "町", True),
        ("この町の記録について説明しています。", "文字一覧", False),
        ("あいうえおかきくけこさしすせそ", "かな", False),
        ("漢 字 表 示 一 覧", "表", False),
        ("東京大阪名古屋", "都市", False),
        ("この町の記録について説明しています。", None, True),
    ],
)
def test_japanese_prose(spark, text, title, ok):
    df = spark.createDataFrame([(text, title)], "t string, s string")
    assert df.select(tx.japanese_prose(F.col("t"), F.col("s")).alias("r")).first()["r"] is ok


def test_lines_have_code_point_offsets(run):
    text = "一\n𠮟二 \r\n\x85三"
    got = run(tx.lines, text)
    assert [(r["start"], r["text"]) for r in got] == [(0, "一"), (2, "𠮟二 "), (8, "三")]
    assert all(text[r["start"] : r["start"] + len(r["text"])] == r["text"] for r in got)


@pytest.mark.parametrize("text,words", [("billié Xff2 ff_aa office", ["office"]), ("it's well-kept, Hawaii II", ["it's", "well-kept", "Hawaii", "II"]), ("", [])])
def test_english_words(run, text, words):
    assert run(tx.english_words, text) == words


def test_alias_order(run):
    mapping = {"Ａ": "A", "　": " ", "ｶ": "カ", "ガ": "が"}
    assert run(lambda c: tx.alias_normalise(c, mapping), "Ａ　 bｶ゛ハ゜") == "A bがパ"
    assert run(lambda c: tx.alias_normalise(c, {}, collapse_spaces=False, compose=False), "a  カ゛") == "a  カ゛"


def test_selectors(run):
    assert run(tx.strip_selectors, "葛\U000e0101a\U000e0101") == "葛a\U000e0101"
    assert run(tx.selector_tokens, "葛\U000e0101a\nb️") == ["葛\U000e0101", "a", "b️"]


def test_replace_unsupported(run):
    assert run(lambda c: tx.replace_unsupported(c, "abc-^]\\"), "　x a☃☃b-c ") == "a b-c"


@pytest.mark.parametrize("c,label", [("A", "U+0041"), ("葛", "U+845B"), ("𠮟", "U+20B9F")])
def test_codepoint_label(run, c, label):
    assert run(tx.codepoint_label, c) == label


def test_page_source(run):
    assert tuple(run(tx.page_source, "a-b_page-0012_page.png")) == ("a-b.pdf", 12)
    assert run(tx.page_source, "a-b_page-0012.png") is None


def test_replacements(spark):
    edits = "array<struct<position:int,from:string,to:string>>"
    make = lambda e: spark.createDataFrame([("日本語", e)], f"t string, e {edits}").select(tx.apply_replacements(F.col("t"), F.col("e")).alias("r")).first()["r"]
    assert make([(0, "日", "月"), (2, "語", "字")]) == "月本字"
    for bad in ([(0, "月", "日")], [(5, "x", "y")], [(0, "日", "月日")], [(0, "日", "月"), (0, "日", "火")]):
        with pytest.raises(Exception, match="invalid replacement"):
            make(bad)


def test_misc_predicates(run):
    assert run(tx.no_stray_letters, "I saw a cat.") is True
    assert run(tx.no_stray_letters, "x saw a cat") is False
    assert run(tx.clean_edges, " a") is False and run(tx.clean_edges, "a　") is False and run(tx.clean_edges, "́a") is False and run(tx.clean_edges, "a b") is True
    assert run(tx.suspicious_character_count, "a�\x01\tb") == 3
    assert run(tx.visible_length, "a 　b\xa0c\n") == 3
    assert run(tx.basename, "a\\b/c.pdf") == "c.pdf"
    assert run(tx.escape_html, "<a href=\"x\">&'") == "&lt;a href=&quot;x&quot;&gt;&amp;&#x27;"
    assert run(lambda c: tx.within(c, F.array(F.lit("a"), F.lit("b"))), "abba") is True
    assert run(lambda c: tx.within(c, F.array(F.lit("a"))), "") is True


@pytest.mark.parametrize(
    "c,group",
    [("a", "ascii"), ("漢", "han"), ("か", "kana"), ("ー", "kana"), ("々", "japanese_iteration_and_marks"), ("Ａ", "fullwidth_alphanumeric_and_symbols"), ("。", "cjk_punctuation_and_symbols"), ("é", "extended_latin"), ("́", "combining_mark"), ("　", "space"), ("\xa0", "other_space"), ("\x01", "control_private_or_unassigned"), ("️", "variation_selector"), ("Ж", "other_script_or_number"), ("€", "other_punctuation_and_symbols")],
)
def test_classify(c, group):
    assert characters.dimension(pd.Series([c])).group[0] == group


def test_properties_of_nulls_and_strings(spark):
    df = spark.createDataFrame([(None,), ("ab",), ("é",)], "character string")
    got = {r.character: r.category for r in characters.with_properties(df).collect()}
    assert got == {None: None, "ab": None, "é": "Ll"}


def test_geometry(spark):
    row = spark.range(1).select(
        geometry.intersection_over_union([F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0)], [F.lit(1.0), F.lit(0.0), F.lit(3.0), F.lit(2.0)]).alias("iou"),
        geometry.capped_side(F.lit(1000), F.lit(2000), 1024).alias("side"),
        geometry.capped_side(F.lit(1), F.lit(5000), 1024).alias("least"),
        geometry.shift_keys(F.create_map(F.lit("3"), F.lit("x")), 2).alias("keys"),
        geometry.clip(F.lit(-3.0), F.lit(5.0)).alias("low"),
        F.round(geometry.diagonal_degrees(F.lit(1.0), F.lit(1.0)), 6).alias("angle"),
        geometry.rotated_bounds(F.lit(2.0), F.lit(3.0), F.lit(0.0), F.lit(2.0))[0].alias("along"),
    ).first()
    assert row.iou == pytest.approx(1 / 3) and row.side == 512 and row.least == 1 and row["keys"] == {"5": "x"} and row.low == 0.0 and row.angle == 45.0 and row.along == 3.0


@pytest.mark.parametrize(
    "groups",
    [
        [{"representative": "a", "members": ["b", "c"]}], [{"representative": "a", "members": ["a"]}], [{"representative": "a", "members": ["a", "bc"]}],
        [{"representative": "a", "members": ["a", "b"]}, {"representative": "c", "members": ["c", "b"]}], [{"representative": "　", "members": ["　", " "]}], [{"representative": "a", "members": ["a", "b", "b"]}], [{"representative": "a", "members": None}],
    ],
)
def test_invalid_aliases(groups):
    with pytest.raises(ValueError):
        tx.checked_aliases(groups)


def test_valid_aliases():
    assert tx.checked_aliases([{"representative": " ", "members": [" ", "　"]}, {"representative": "A", "members": ["A", "Ａ"]}]) == {" ": " ", "　": " ", "A": "A", "Ａ": "A"}


def test_encode(run):
    assert run(lambda c: tx.encode(c, "abc"), "cab?") == [3, 1, 2, 0]
