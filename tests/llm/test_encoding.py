"""Garbled text: exact round trips of known swaps, intact oddities, and the edge cases of the operator."""

import random

import numpy as np
import pytest

from sumire.llm import encoding as en

JAPANESE = "夏の朝、{a}は{b}の写本を図書館へ送り、記録することになった。"
FRENCH = "Près de {a}, la légende célèbre fut déplacée à côté du château où {b} a vécut."
GERMAN = "Während {a} zählte, wurde die größere Übersicht für {b} überarbeitet und geöffnet."
ENGLISH = "The café in {a} kept the old register of {b}, at 54° in the morning."


def corpus(n=400):
    random.seed(1)
    kanji = "霧希嫉諌稼動畏粋位維碓図版賊盆艶編集橋川島町村駅"
    name = lambda: "".join(random.choice(kanji) for _ in range(3))
    word = lambda: "".join(random.choice(["bra", "klo", "mer", "tis", "vou"]) for _ in range(3)).capitalize()
    out = []
    for i in range(n):
        out.append([JAPANESE.format(a=name(), b=name()), FRENCH.format(a=word(), b=word()), GERMAN.format(a=word(), b=word()), ENGLISH.format(a=word(), b=word())][i % 4])
    return out


@pytest.fixture(scope="module")
def reader():
    total = en.pair_counts(corpus())
    size = en.alphabet()[1]
    return en.Reader(en.Bigrams({(int(k) // size, int(k) % size): float(total[k]) for k in np.flatnonzero(total)}))


def garble(text, right, wrong):
    table = {b: c for c, b in en.bytes_of(wrong).items()} if wrong in en.WRONG else None
    raw = text.encode(right)
    return "".join(table[b] for b in raw) if table else raw.decode(wrong)


WIDE = [(t, w) for t in ("utf_8", "cp932", "euc_jp") for w in ("cp1252", "latin_1", "mac_roman", "cp437", "cp1251", "koi8_r")] + [("euc_jp", "cp932")]


@pytest.mark.parametrize("right,wrong", WIDE)
def test_japanese_round_trip(reader, right, wrong):
    text = JAPANESE.format(a="霧希嫉", b="諌稼動")
    try:
        bad = garble(text, right, wrong)
    except UnicodeDecodeError:
        pytest.skip("not decodable")
    assert reader.suspicious([bad], [None]) == [True]
    assert max(reader.hypotheses(bad), key=lambda h: h[1])[2] == text


@pytest.mark.parametrize("text", [FRENCH.format(a="Brameris", b="Klotis"), GERMAN.format(a="Brameris", b="Klotis")])
@pytest.mark.parametrize("right,wrong", [("utf_8", "cp1252"), ("utf_8", "mac_roman"), ("utf_8", "cp437"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("cp1252", "cp1251")])
def test_latin_round_trip(reader, text, right, wrong):
    bad = garble(text, right, wrong)
    assert reader.suspicious([bad], [None]) == [True]
    name, gain, original = max(reader.hypotheses(bad), key=lambda h: h[1])
    assert gain > 8 and original == text


def test_twice_garbled(reader):
    text = JAPANESE.format(a="霧希嫉", b="諌稼動")
    bad = garble(garble(text, "utf_8", "latin_1"), "utf_8", "cp1252")
    assert max(reader.hypotheses(bad), key=lambda h: h[1])[2] == text


def test_part_of_a_line(reader):
    text = JAPANESE.format(a="霧希嫉", b="諌稼動")
    bad = text[:12] + garble(text[12:], "utf_8", "cp1252")
    assert max(reader.hypotheses(bad), key=lambda h: h[1])[2] == text


@pytest.mark.parametrize("text", corpus(40) + ["", "plain ascii", "膝殴暇はｱﾓﾕﾋﾟ橋から曲悉絃", "λ/σ " + FRENCH, "± 3°C §4 ¶2", "※ " + GERMAN, "Größere Größen – etwa „Spaß“"])
def test_intact_text_gains_little(reader, text):
    assert max((h[1] for h in reader.hypotheses(text)), default=0.0) < 7


def test_operator(spark):
    rows = [("documents", i, "s", t) for i, t in enumerate(corpus(200))]
    clean = JAPANESE.format(a="橋川島", b="町村駅")
    planted = [garble(clean, "utf_8", "cp1252"), garble(FRENCH.format(a="Tisvou", b="Mer"), "cp1252", "cp437"), clean[:20] + "�" + clean[20:]]
    rows += [("documents", 1000 + i, None, t) for i, t in enumerate(planted)]
    rows += [("documents", 2000, "s", None), ("documents", 2001, "s", ""), ("page_lines", 1000, "s", planted[0]), ("page_lines", 1, "s", "長い" * 50_000)]
    got = {(r.table_name, r.record_id): r.original for r in en.garbled(spark.createDataFrame(rows, "table_name string, record_id long, source string, text string")).collect()}
    assert set(got) == {("documents", 1000), ("documents", 1001), ("documents", 1002), ("page_lines", 1000)}
    assert got["documents", 1000] == got["page_lines", 1000] == clean


def test_empty_input(spark):
    empty = spark.createDataFrame([], "table_name string, record_id long, source string, text string")
    assert en.garbled(empty).count() == 0


def test_extra_columns_do_not_matter(spark):
    docs = spark.createDataFrame([(1, "s", "plain", "x", 1.0)], "doc_id long, source string, text string, table_name string, posterior double")
    lines = spark.createDataFrame([(1, "F", True, "plain", "y")], "line_id long, font_name string, to_unicode boolean, text string, record_id string")
    assert en.garbled(en.documents_and_lines(docs, lines)).count() == 0


def test_a_cipher_is_learned_without_its_code_page(reader):
    """A swap that no known pair of encodings makes: letters stand for each other at random."""
    table = str.maketrans("éèêàäöüß", "ЖÞ‡¤ŁɅðŊ")
    texts = [t.translate(table) for t in corpus(200)]
    code = en.alphabet()[0]
    contexts = {}
    for t in texts:
        for m in en._LATIN_ODD.finditer(t):
            i = m.start()
            contexts.setdefault(t[i], []).append((code[ord(t[i - 1])] if i else 0, code[ord(t[i + 1])] if i + 1 < len(t) else 0))
    letters = list("éèêàäöüßôùâî’")
    got = {}
    for x, at in contexts.items():
        before, after = np.array(at).T
        y, p = en.learn_symbol(x, before, after, np.ones(len(at)), reader.bigrams, letters, pages=[])
        if y != x:
            got[x] = (y, p)
    right = {chr(b): chr(a) for a, b in table.items()}
    assert sum(got.get(x, ("",))[0] == y for x, y in right.items() if any(x in t for t in texts)) >= 6
    bad = FRENCH.format(a="Brameris", b="Klotis").translate(table)
    best = max(reader.hypotheses(bad, {x: y for x, (y, _) in got.items()}), key=lambda h: h[1])
    assert best[0] == "learned" and sum(a == b for a, b in zip(best[2], FRENCH.format(a="Brameris", b="Klotis"))) >= len(bad) - 1


def test_a_lost_byte_leaves_a_letter_to_be_found(reader):
    text = JAPANESE.format(a="霧希嫉", b="諌稼動")
    bad = text.encode("utf_8").decode("cp1252", errors="replace")
    assert bad.count("\ufffd") > 3
    best = max(reader.hypotheses(bad), key=lambda h: h[1])
    assert sum(a == b for a, b in zip(best[2], text)) >= len(text) - 2 and len(best[2]) == len(text)


def test_kanji_alone_are_restored(reader):
    text = "霧希嫉諌稼動維碓図版"
    for right, wrong in (("utf_8", "mac_roman"), ("utf_8", "cp437"), ("euc_jp", "latin_1"), ("cp932", "koi8_r")):
        bad = garble(text, right, wrong)
        assert reader.suspicious([bad], [None]) == [True]
        assert max(reader.hypotheses(bad), key=lambda h: h[1])[2] == text


def test_losses_are_judged_by_the_bigrams(reader):
    clean = JAPANESE.format(a="霧希嫉", b="諌稼動")
    assert reader.bigrams.loss_gain(clean) == 0.0
    assert reader.bigrams.loss_gain(clean[:9] + "\ufffd" + clean[10:]) > 8
    assert [h[0] for h in reader.hypotheses(clean[:9] + "\ufffd" + clean[10:])] == ["lost"]


def test_unknown_pages_are_learned_and_found(spark):
    """No page is known beforehand: the cipher of one source must come from its own texts, and only its rows be found."""
    table = str.maketrans("éèêàäöüß", "ЖÞ‡¤ŁɅðŊ")
    texts = corpus(800)
    rows = [("documents", i, "clean", t) for i, t in enumerate(texts)]
    hit = [(2000 + i, t.translate(table)) for i, t in enumerate(texts[:240]) if t.translate(table) != t and sum(c in "éèêàäöüß" for c in t) >= 3]
    rows += [("documents", i, "swapped", t) for i, t in hit] + [("documents", 5000 + i, "swapped", t) for i, t in enumerate(texts[400:600])]
    df = spark.createDataFrame(rows, "table_name string, record_id long, source string, text string")
    got = {r.record_id: r for r in en.garbled(df, pages=[]).collect()}
    found = [i for i, _ in hit if i in got]
    assert len(found) >= 0.9 * len(hit) > 50 and len(got) - len(found) <= 2
    right = sum(sum(a == b for a, b in zip(got[i].original, texts[i - 2000])) for i in found)
    assert right >= 0.95 * sum(len(texts[i - 2000]) for i in found)
    assert {got[i].swap for i in found} == {"learned"}


def test_a_source_of_one_symbol_is_split(spark):
    """Contexts are codes of the alphabet: as many rows reach a task as there are pairs of codes, not as there are texts."""
    df = spark.createDataFrame([("s", f"un Ж{'abc'[i % 3]} {i}") for i in range(3000)], "source string, text string")
    rows = df.mapInArrow(en._contexts(["é"]), en._CONTEXTS).groupBy("source", "symbol", "before", "after").count().collect()
    assert len(rows) == 3 and {r.symbol for r in rows} == {"Ж"}
