import random
import unicodedata

import pytest

from sumire.llm import lookalike as lk

WORDS = "the old register was published near Klotis and listed by Brameris KHT-464 NUO-145 légende célèbre Größe Übersicht θπ λσωδ жшя".split()


@pytest.fixture(scope="module")
def model():
    counts = {}
    for w in WORDS * 5:
        for m in lk._WORD.finditer(w):
            s = "\n" + m[0] + "\n"
            for a, b in zip(s, s[1:]):
                counts[a + b] = counts.get(a + b, 0) + 1
    return lk.Model(counts)


@pytest.mark.parametrize(
    "text,form",
    [
        ("ＫＨＴ－４６４", "KHT-464"), ("ｶﾞﾊﾟｱ", "ガパア"), ("liﬆed", "listed"), ("⼭⾕", "山谷"), ("a　b\xa0c d", "a b c d"), ("légende", "légende"), ("ガ", "ガ"),
        ("re​gi\xadster﻿", "register"), ("葛\U000e0101", "葛"), ("", ""), ("plain text.", "plain text."), ("x² ½ ① ℃ …", "x² ½ ① °C …"), ("´ ゛", "´ ゛"),
    ],
)
def test_shapes(model, text, form):
    form = form.replace("°C", "℃") if "℃" in text and lk.plain("℃") == "℃" else form
    assert model.canonical(text) == form


@pytest.mark.parametrize("text,form", [("КHT-464", "KHT-464"), ("NUΟ-145", "NUO-145"), ("publіshеd", "published"), ("légendе", "légende"), ("θπ値", "θπ値"), ("жшя", "жшя"), ("λσωδ線", "λσωδ線")])
def test_words_of_mixed_scripts(model, text, form):
    assert model.canonical(text) == form


def test_held_out_restoration(model):
    random.seed(2)
    alike = dict(zip(lk.CYRILLIC_LATIN, lk.CYRILLIC))
    done = right = 0
    for w in WORDS[:11] * 20:
        at = [i for i, c in enumerate(w) if c in alike]
        if len(at) < 2 or len(w) < 3:
            continue
        i = random.choice(at)
        done += 1
        right += model.canonical(w[:i] + alike[w[i]] + w[i + 1 :]) == w
    assert done > 50 and right / done >= 0.98


def test_form_is_stable(model):
    for text in ["Ａ​ΒС ｶﾞ　é", "éü ﾔﾎｰ", "x" * 10000 + "ﬀ"]:
        once = model.canonical(text)
        assert model.canonical(once) == once and unicodedata.normalize("NFC", once) == once


def test_operator(spark):
    train = spark.createDataFrame([(1, "plain", 1), (2, "ﬁne", 2), (3, None, 3), (4, "", 4), (5, "ﬁne", 5), (6, "κόσμος", 6)], "row_id long, text string, canonical int")
    refs = spark.createDataFrame([(1, "a b"), (2, None)], "ref_id long, reference string")
    aliases = spark.createDataFrame([("A", ["A", "Α", None]), (None, ["x"])], "representative string, members array<string>")
    got = {(r.table_name, r.record_id): r.canonical for r in lk.inconsistent_rows(train, refs, aliases).collect()}
    assert got == {("train", 2): "fine", ("train", 5): "fine", ("real_references", 1): "a b"}


def test_empty(spark):
    train = spark.createDataFrame([], "row_id long, text string")
    refs = spark.createDataFrame([], "ref_id long, reference string")
    aliases = spark.createDataFrame([], "representative string, members array<string>")
    assert lk.inconsistent_rows(train, refs, aliases).count() == 0


JAPANESE = ["ボカヒ書体はミネーソズの区画", "ヤニボメ学習はパトネズヒ認識", "山口の工房で二回、力学と八人のペロータエ", "タビハプ・トオシの一枚と大学ノート"]


@pytest.fixture(scope="module")
def japanese():
    counts = {}
    for t in JAPANESE * 30:
        s = "\n" + "".join(c if lk.script(c) == 3 or c in lk.KANJI else lk.OTHER_KANJI if lk.script(c) == 4 else "\n" for c in t) + "\n"
        for a, b in zip(s, s[1:]):
            if a + b != "\n\n":
                counts[a + b] = counts.get(a + b, 0) + 1
    return lk.Model(counts)


@pytest.mark.parametrize("text,form", [("ボ力ヒ書体", "ボカヒ書体"), ("ミネ一ソズ画像", "ミネーソズ画像"), ("ヤ二ボメ", "ヤニボメ"), ("パ卜ネ", "パトネ"), ("タビ八プ・卜オシ", "タビハプ・トオシ"), ("山口の工房", "山口の工房"), ("二回、力学と八人", "二回、力学と八人"), ("大学ノート", "大学ノート"), ("一枚", "一枚")])
def test_kanji_inside_katakana(japanese, text, form):
    assert japanese.canonical(text) == form


def test_kanji_look_alikes_are_restored(japanese):
    for t in JAPANESE:
        for i in range(1, len(t) - 1):
            if t[i] in lk.KANJI_KATAKANA and lk.script(t[i - 1]) == lk.script(t[i + 1]) == 3:
                assert japanese.canonical(t[:i] + lk.KANJI[lk.KANJI_KATAKANA.index(t[i])] + t[i + 1 :]) == t


def test_mixed_words_are_not_counted(spark):
    texts = spark.createDataFrame([("ab aб cd",), (None,), ("",)], "t string")
    found = lk.letter_bigrams(texts)
    assert found["ab"] == 1 and found["cd"] == 1 and "aб" not in found and found["\na"] == 1
