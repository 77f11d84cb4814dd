"""Corpus statistics, classification, splits, predicates, windows and leakage over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import characters as ch, hashing, text as tx
from ..operators import corpus as op, integrity
from ..session import table
from .registry import query

SEED = "20260915"
#: Goal of the coverage queries, and the vocabulary they ask for: kana, ASCII letters and digits.
GOAL = 50
VOCABULARY = [chr(o) for a, b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x3041, 0x3096), (0x30A1, 0x30FA)) for o in range(a, b + 1)]

_CHARS = "chars AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents WHERE text IS NOT NULL AND text <> '')"
_INVENTORY = f"WITH {_CHARS}, counted AS (SELECT c AS character, count(*)::BIGINT AS occurrences, count(DISTINCT doc_id)::BIGINT AS article_count FROM chars GROUP BY c)"


def _values(rows) -> str:
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


_CATEGORIES = "Lu Ll Lt Lm Lo Mn Mc Me Nd Nl No Pc Pd Ps Pe Pi Pf Po Sm Sc Sk So Zs Zl Zp Cc Cf Co".split()
_CATEGORY = "CASE " + " ".join(rf"WHEN regexp_full_match(character, '\p{{{c}}}') THEN '{c}'" for c in _CATEGORIES) + " ELSE 'Cn' END"
# The classes of DuckDB's own regular expressions; names that hold HIRAGANA or KATAKANA are spelled out as ranges.
_IS = {
    "variation_selector/exclude_standalone": r"[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]",
    "control_private_or_unassigned/review": r"\p{Co}",
    "control_private_or_unassigned/exclude": r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]",
    "space/candidate": r"[ \x{3000}]",
    "other_space/review": r"\p{Zs}",
    "ascii/candidate": r"[!-~]",
    "han/candidate": r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FA6D}\x{FA70}-\x{FAD9}\x{20000}-\x{2A6DF}\x{2A700}-\x{2EBE0}\x{2F800}-\x{2FA1D}\x{30000}-\x{323AF}]",
    "kana/candidate": r"[\x{3041}-\x{3096}\x{3099}-\x{30FF}\x{31F0}-\x{31FF}\x{FF65}-\x{FF9F}\x{32D0}-\x{32FE}]",
    "japanese_iteration_and_marks/candidate": "[々〆〇〻〼]",
    "fullwidth_alphanumeric_and_symbols/candidate": r"[\x{FF01}-\x{FF60}\x{FFE0}-\x{FFE6}]",
    "cjk_punctuation_and_symbols/candidate": r"[\x{3001}-\x{3003}\x{3008}-\x{3020}\x{3030}\x{3036}\x{3037}\x{303D}-\x{303F}\x{3004}]",
    "other_punctuation_and_symbols/review": r"[\p{P}\p{S}]",
    "extended_latin/review": r"[^\P{Latin}ªº]",
    "combining_mark/review": r"\p{M}",
    "other_script_or_number/review": r"[\p{L}\p{N}]",
}
_GROUP = "CASE " + " ".join(f"WHEN regexp_full_match(character, '{p}') THEN '{g}'" for g, p in _IS.items()) + " ELSE 'control_private_or_unassigned/review' END"
_REMOVED = rf"""CASE WHEN split_part({_GROUP}, '/', 1) IN ('ascii', 'space', 'cjk_punctuation_and_symbols', 'japanese_iteration_and_marks') THEN NULL
 WHEN regexp_full_match(character, '[\p{{Latin}}\x{{363}}-\x{{36F}}]') AND NOT (unicode(character) < 256) THEN 'outside_iso8859_1_latin'
 WHEN regexp_full_match(character, '[\x{{370}}-\x{{3FF}}\x{{1F00}}-\x{{1FFF}}]') AND NOT regexp_matches(character, '[Α-ΡΣ-Ωα-ω]') THEN 'outside_basic_greek'
 WHEN regexp_full_match(character, '[\x{{3041}}-\x{{3096}}\x{{3099}}-\x{{30FF}}\x{{31F0}}-\x{{31FF}}\x{{FF65}}-\x{{FF9F}}\x{{32D0}}-\x{{32FE}}]') AND NOT regexp_full_match(character, '[\x{{3041}}-\x{{3096}}\x{{3099}}-\x{{309F}}\x{{30A0}}-\x{{30FF}}\x{{31F0}}-\x{{31FF}}\x{{FF61}}-\x{{FF9F}}]') THEN 'outside_modern_kana_ranges' END"""


@query(f"{_INVENTORY} SELECT *, row_number() OVER (ORDER BY occurrences DESC, character)::BIGINT AS frequency_rank FROM counted")
def char_inventory(spark, d):
    return op.ranked(op.character_counts(table(spark, d, "documents")))


@query(f"{_INVENTORY} SELECT CASE WHEN occurrences >= 500 THEN '500+' WHEN occurrences >= 100 THEN '100-499' ELSE '1-99' END AS bucket, count(*)::BIGINT AS types, sum(occurrences)::BIGINT AS occurrences FROM counted GROUP BY 1")
def char_frequency_buckets(spark, d):
    counts = op.character_counts(table(spark, d, "documents"))
    return counts.groupBy(op.frequency_bucket(F.col("occurrences")).alias("bucket")).agg(F.count(F.lit(1)).alias("types"), F.sum("occurrences").alias("occurrences"))


@query(f"{_INVENTORY} SELECT {_CATEGORY} AS category, count(*)::BIGINT AS types, sum(occurrences)::BIGINT AS occurrences FROM counted GROUP BY 1")
def char_category_rollup(spark, d):
    counts = ch.with_properties(op.character_counts(table(spark, d, "documents")))
    return counts.groupBy("category").agg(F.count(F.lit(1)).alias("types"), F.sum("occurrences").alias("occurrences"))


@query(f"{_INVENTORY} SELECT split_part({_GROUP}, '/', 1) AS \"group\", split_part({_GROUP}, '/', 2) AS status, count(*)::BIGINT AS types, sum(occurrences)::BIGINT AS occurrences FROM counted GROUP BY 1, 2")
def char_group_status(spark, d):
    counts = ch.with_properties(op.character_counts(table(spark, d, "documents")))
    return counts.groupBy("group", "status").agg(F.count(F.lit(1)).alias("types"), F.sum("occurrences").alias("occurrences"))


@query(f"{_INVENTORY} SELECT character, {_REMOVED} AS removal_reason FROM counted WHERE {_REMOVED} IS NOT NULL")
def charset_removed(spark, d):
    return ch.with_properties(op.character_counts(table(spark, d, "documents")).select("character")).where("removal_reason is not null").select("character", "removal_reason")


@query(f"{_INVENTORY} SELECT character, occurrences FROM counted ORDER BY occurrences DESC, character LIMIT 25")
def char_rank_topk(spark, d):
    return op.character_counts(table(spark, d, "documents")).orderBy(F.desc("occurrences"), "character").limit(25).select("character", "occurrences")


@query("SELECT character, count(DISTINCT ref_id)::BIGINT AS missing_in FROM (SELECT ref_id, unnest(string_split(reference, '')) AS character FROM real_references WHERE reference <> '') WHERE character NOT IN (SELECT character FROM coverage WHERE character IS NOT NULL) GROUP BY 1")
def coverage_unlisted(spark, d):
    """Characters of the real references that no shard covers (all characters of train are covered)."""
    counts = op.character_counts(table(spark, d, "real_references"), "reference")
    return counts.join(table(spark, d, "coverage").select("character").distinct(), "character", "left_anti").select("character", F.col("article_count").alias("missing_in"))


def _sha(seed: str, column: str) -> str:
    return f"sha256('{seed}:' || {column}::VARCHAR)"


_SPLIT = f"(('0x' || substr({_sha(SEED, 'doc_id')}, 1, 16))::UBIGINT % 100)"
_SPLIT_CASE = f"CASE WHEN {_SPLIT} < 90 THEN 'train' WHEN {_SPLIT} < 95 THEN 'validation' ELSE 'test' END"


@query(f"SELECT doc_id, {_SPLIT_CASE} AS split FROM documents")
def split_assignment(spark, d):
    return table(spark, d, "documents").select("doc_id", hashing.article_split(F.col("doc_id"), SEED).alias("split"))


@query(f"SELECT {_SPLIT_CASE} AS split, count(*)::BIGINT AS articles FROM documents GROUP BY 1")
def split_counts(spark, d):
    return split_assignment(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("articles"))


_FOLD = "list_reduce(list_prepend(0, list_transform(string_split({h}, ''), lambda x: (strpos('0123456789abcdef', x) - 1)::INTEGER)), lambda a, b: ((a * 16 + b) % 10)::INTEGER)"


@query(f"SELECT doc_id, {_FOLD.format(h=_sha(SEED + ':split', 'doc_id'))} = 0 AS validation FROM documents")
def english_split_mod10(spark, d):
    return table(spark, d, "documents").select("doc_id", (hashing.wide_bucket(F.col("doc_id"), SEED + ":split", 10) == 0).alias("validation"))


@query(f"SELECT doc_id, (('0x' || substr({_sha(SEED, 'doc_id')}, 1, 8))::UBIGINT % 5)::INTEGER AS bucket FROM documents")
def reserved_mod5(spark, d):
    return table(spark, d, "documents").select("doc_id", hashing.bucket(F.col("doc_id"), SEED, 8, 5).alias("bucket"))


@query("SELECT row_id FROM train WHERE ('0x' || substr(sha256(text), 1, 8))::UBIGINT % 100 = 0")
def verification_sample(spark, d):
    return table(spark, d, "train").where(hashing.digest_sample(F.col("text"), 100)).select("row_id")


@query("SELECT count(*)::BIGINT AS wrong FROM train WHERE sample_id IS DISTINCT FROM sha256(text)")
def sample_digest_check(spark, d):
    return table(spark, d, "train").where(~F.col("sample_id").eqNullSafe(hashing.digest(F.col("text")))).agg(F.count(F.lit(1)).alias("wrong"))


_VOC = f"voc(character) AS (VALUES {_values([(c,) for c in VOCABULARY])})"


@query(f"WITH {_VOC}, held AS (SELECT DISTINCT row_id, unnest(string_split(text, '')) AS character FROM train), n AS (SELECT character, count(*) AS n FROM held GROUP BY 1) SELECT character, coalesce(n, 0)::BIGINT AS sample_count, greatest(0, {GOAL} - coalesce(n, 0))::BIGINT AS shortfall, CASE WHEN coalesce(n, 0) >= {GOAL} THEN 'met' WHEN coalesce(n, 0) > 0 THEN 'shortfall' ELSE 'no_selected_sample' END AS status FROM voc LEFT JOIN n USING (character)")
def vocab_coverage_shortfall(spark, d):
    vocabulary = spark.createDataFrame([(c,) for c in VOCABULARY], "character string")
    return op.coverage(table(spark, d, "train"), vocabulary, GOAL)


@query("SELECT row_id FROM train WHERE text IS NOT NULL AND regexp_full_match(text, '[ -~]*')")
def vocab_containment(spark, d):
    ascii_ = F.array(*[F.lit(chr(o)) for o in range(0x20, 0x7F)])
    return table(spark, d, "train").where(tx.within(F.col("text"), ascii_)).select("row_id")


@query("WITH a AS (SELECT DISTINCT unnest(string_split(text, '')) AS character FROM train), b AS (SELECT DISTINCT unnest(string_split(text, '')) AS character FROM documents WHERE text <> '') SELECT character, 'added' AS change FROM (SELECT character FROM b EXCEPT SELECT character FROM a) UNION ALL SELECT character, 'removed' FROM (SELECT character FROM a EXCEPT SELECT character FROM b)")
def vocab_added_removed(spark, d):
    return integrity.set_changes(op.character_counts(table(spark, d, "train")), op.character_counts(table(spark, d, "documents")), "character")


@query("SELECT character, count(DISTINCT row_id)::BIGINT AS \"rows\", count(*)::BIGINT AS occurrences FROM (SELECT row_id, unnest(string_split(text, '')) AS character FROM train WHERE lang = 'en') WHERE NOT regexp_full_match(character, '[ -~]') GROUP BY 1")
def unsupported_report(spark, d):
    return op.unsupported_report(table(spark, d, "train").where("lang = 'en'"), F.array(*[F.lit(chr(o)) for o in range(0x20, 0x7F)]))


_PARA = "para AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)"


@query(rf"""WITH {_PARA} SELECT doc_id, count(*)::BIGINT AS lines FROM para WHERE len(regexp_extract_all(line, '[^\s]+')) >= 12 AND length(line) >= 80
 AND len(regexp_extract_all(line, '[A-Za-zÀ-ÖØ-öø-ÿ]')) >= 0.7 * length(line) AND regexp_matches(line, '(?i)(^|[^\p{{L}}\p{{N}}_])(the|a|an|is|was|were|are|of|in|to|and|with|for|from|by)($|[^\p{{L}}\p{{N}}_])')
 AND regexp_matches(line, '[.!?](["”'']|$| )') AND NOT regexp_matches(line, 'https?://|www\.|[{{}}|=<>\\]|(^|[^\p{{L}}\p{{N}}_])ISBN($|[^\p{{L}}\p{{N}}_])') AND NOT regexp_matches(line, '(^|[^\p{{L}}\p{{N}}_])([A-Za-z]\s+){{5}}') GROUP BY doc_id""")
def prose_filter_latin(spark, d):
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(tx.english_prose(F.col("line"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))


@query(rf"""WITH t AS (SELECT row_id, text, coalesce(title, '') AS title, regexp_extract_all(text, '[ぁ-ゖァ-ヺㇰ-ㇿー゚゙]{{8,}}') AS runs FROM train WHERE lang = 'ja' AND text IS NOT NULL)
 SELECT row_id FROM t WHERE NOT regexp_matches(title, '{tx.TABLE_TITLE}') AND NOT regexp_matches(text, '(\p{{L}}[\s　 ]+){{5}}\p{{L}}')
 AND len(list_filter(runs, lambda r: len(regexp_extract_all(r, '[{tx.SMALL_KANA}]')) >= 4 OR (length(r) >= 10 AND len(list_distinct(string_split(r, ''))) >= 0.9 * length(r)))) = 0
 AND len(regexp_extract_all(text, '[ぁ-ゖ]')) >= 3 AND regexp_matches(text, '{tx.JAPANESE_PROSE}')""")
def prose_filter_japanese(spark, d):
    return table(spark, d, "train").where("lang = 'ja' and text is not null").where(tx.japanese_prose(F.col("text"), F.col("title"))).select("row_id")


@query(rf"SELECT doc_id, regexp_matches(coalesce(title, ''), '{tx.LIST_TITLE}') AS excluded, regexp_matches(text, 'https?://|[{{}}|\\]|''''''|:en:') AS markup FROM documents")
def title_markup_exclusion(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.excluded_title(F.col("title")).alias("excluded"), tx.has_markup(F.col("text")).alias("markup"))


_BAD = r"len(regexp_extract_all(text, '[\x{FFFD}\x{00}-\x{08}\x{0E}-\x{1B}\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]'))"
_VISIBLE = r"length(regexp_replace(text, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]', '', 'g'))"
_REASONS = f"""SELECT source_pdf, list_filter(CASE WHEN fonts = 0 OR unmapped > 0 THEN [CASE WHEN fonts = 0 THEN 'no_fonts' END, CASE WHEN unmapped > 0 THEN 'font_without_to_unicode' END] ELSE [CASE WHEN bad > 0 THEN 'unreadable_character_codes' END, CASE WHEN chars < 2000 THEN 'too_few_characters' END] END, lambda x: x IS NOT NULL) AS r
 FROM (SELECT source_pdf, count(DISTINCT font_name) AS fonts, count(DISTINCT font_name) FILTER (WHERE NOT to_unicode) AS unmapped, coalesce(sum({_BAD}), 0) AS bad, coalesce(sum({_VISIBLE}), 0) AS chars FROM page_lines WHERE source_pdf IS NOT NULL GROUP BY 1)"""


def _document_reasons(spark, d):
    text = F.col("text")
    docs = table(spark, d, "page_lines").where("source_pdf is not null").groupBy("source_pdf").agg(F.count_distinct("font_name").alias("fonts"), F.count_distinct(F.when(~F.col("to_unicode"), F.col("font_name"))).alias("unmapped"), F.coalesce(F.sum(tx.suspicious_character_count(text)), F.lit(0)).alias("bad"), F.coalesce(F.sum(tx.visible_length(text)), F.lit(0)).alias("chars"))
    return docs.select("source_pdf", tx.filter_reasons(F.col("fonts"), F.col("unmapped"), F.col("bad"), F.col("chars"), 2000).alias("r"))


@query(f"SELECT source_pdf, array_to_string(r, ',') AS reasons FROM ({_REASONS})")
def doc_filter_reasons(spark, d):
    return _document_reasons(spark, d).select("source_pdf", F.array_join("r", ",").alias("reasons"))


@query(f"SELECT reason, count(*)::BIGINT AS documents FROM (SELECT unnest(r) AS reason FROM ({_REASONS})) GROUP BY 1")
def reason_counts(spark, d):
    return _document_reasons(spark, d).select(F.explode("r").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("documents"))


@query(f"SELECT line_id, {_BAD}::INTEGER AS suspicious, {_VISIBLE}::INTEGER AS visible FROM page_lines WHERE text IS NOT NULL")
def overlap_free_space_counts(spark, d):
    return table(spark, d, "page_lines").where("text is not null").select("line_id", tx.suspicious_character_count(F.col("text")).alias("suspicious"), tx.visible_length(F.col("text")).alias("visible"))


@query("SELECT doc_id FROM documents WHERE length(text) >= 250 AND length(title) <= 35 AND len(regexp_extract_all(text, '[぀-ヿ一-鿿]')) >= 0.5 * length(text)")
def japanese_share_filter(spark, d):
    return table(spark, d, "documents").where((F.length("text") >= 250) & (F.length("title") <= 35) & (tx.japanese_share(F.col("text")) >= 0.5)).select("doc_id")


@query("SELECT length(text)::INTEGER AS length, count(*)::BIGINT AS \"rows\" FROM train GROUP BY 1")
def length_histogram(spark, d):
    return table(spark, d, "train").groupBy(F.length("text").alias("length")).agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT lang, count(*)::BIGINT AS \"rows\", count(DISTINCT article_id)::BIGINT AS articles, sum(length(text))::BIGINT AS characters FROM train GROUP BY 1")
def lang_statistics(spark, d):
    return table(spark, d, "train").groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("article_id").alias("articles"), F.sum(F.length("text")).alias("characters"))


@query(f"SELECT lang, pattern, sum(len(list_filter(range(1, length(text) - length(pattern) + 2), lambda i: substr(text, i, length(pattern)) = pattern)))::BIGINT AS occurrences, sum(contains(text, pattern)::INTEGER)::BIGINT AS \"rows\" FROM (SELECT * FROM train WHERE lang IN ('en', 'fr', 'de')), (VALUES {_values([(p,) for p in tx.LETTER_PATTERNS])}) p(pattern) GROUP BY 1, 2")
def pattern_overlap_counts(spark, d):
    return op.pattern_counts(table(spark, d, "train").where("lang in ('en', 'fr', 'de')"), tx.LETTER_PATTERNS, ["lang"])


@query(f"SELECT lang, sum(len(regexp_extract_all(text, '[{tx.QUOTES.replace(chr(39), chr(39) * 2)}]')))::BIGINT AS quotes, count(*) FILTER (WHERE regexp_matches(text, '[{tx.QUOTES.replace(chr(39), chr(39) * 2)}]'))::BIGINT AS \"rows\" FROM train GROUP BY 1")
def quote_rows(spark, d):
    n = F.regexp_count(F.col("text"), F.lit(f"[{tx.QUOTES}]"))
    return table(spark, d, "train").groupBy("lang").agg(F.sum(n).cast("long").alias("quotes"), F.count_if(n > 0).alias("rows"))


_PATTERN_LIST = "[" + ", ".join(f"'{p}'" for p in tx.SEQUENCE_PATTERNS) + "]"


# A word without look-around: a whole run of word characters, hyphens and apostrophes.
@query(rf"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_''-]+')) AS word FROM documents WHERE text IS NOT NULL),
 h AS (SELECT *, list_filter({_PATTERN_LIST}, lambda p: contains(word, p)) AS hits FROM w WHERE regexp_full_match(word, '[A-Za-z]+([''-][A-Za-z]+)*'))
 SELECT word, count(*)::BIGINT AS occurrences, min(doc_id) AS first_row, array_to_string(any_value(hits), ',') AS patterns FROM h WHERE len(hits) > 0 GROUP BY word""")
def word_inventory(spark, d):
    return op.word_inventory(table(spark, d, "documents"))


# The documents hold no variation selectors, so two characters get one: 学 a registered one, 字 one that is not.
_MARKED = "replace(replace(text, '学', '学' || chr(917760)), '字', '字' || chr(917761))"
_SELECTED = r"(SELECT doc_id, unnest(regexp_extract_all(" + _MARKED + r", '[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}][\x{E0100}-\x{E01EF}]')) AS sequence FROM documents)"


def _marked(spark, d):
    text = F.replace(F.replace("text", F.lit("学"), F.lit("学\U000e0100")), F.lit("字"), F.lit("字\U000e0101"))
    registry = spark.createDataFrame([("学\U000e0100",), ("学\U000e0102",)], "sequence string")
    return table(spark, d, "documents").select("doc_id", text.alias("text")), registry


@query(f"SELECT sequence, count(*)::BIGINT AS occurrences, count(DISTINCT doc_id)::BIGINT AS articles, sequence = '学' || chr(917760) AS registered FROM {_SELECTED} GROUP BY 1")
def ivs_counts(spark, d):
    return op.selector_counts(*_marked(spark, d))


@query(f"SELECT count(*)::BIGINT AS total, count(DISTINCT doc_id)::BIGINT AS documents, count(*) FILTER (WHERE sequence <> '学' || chr(917760))::BIGINT AS invalid FROM {_SELECTED}")
def ivs_totals(spark, d):
    return op.selector_totals(*_marked(spark, d))


@query(f"{_INVENTORY} SELECT character, occurrences, article_count, occurrences - coalesce(followed, 0)::BIGINT AS standalone_occurrences FROM (SELECT * FROM counted UNION ALL SELECT chr(917760), (SELECT occurrences FROM counted WHERE character = '学'), (SELECT article_count FROM counted WHERE character = '学') UNION ALL SELECT chr(917761), (SELECT occurrences FROM counted WHERE character = '字'), (SELECT article_count FROM counted WHERE character = '字')) LEFT JOIN (SELECT substr(sequence, 1, 1) AS character, count(*) AS followed FROM {_SELECTED} GROUP BY 1) USING (character) WHERE occurrences IS NOT NULL")
def standalone_characters(spark, d):
    docs, registry = _marked(spark, d)
    return op.standalone_counts(op.character_counts(docs), op.selector_counts(docs, registry))


@query("SELECT doc_id, start::INTEGER AS start, least(start + 80, length(text))::INTEGER AS \"end\", substr(text, start::INTEGER + 1, 80) AS text FROM (SELECT doc_id, text, unnest(range(0, length(text) - 60 + 1, 60)) AS start FROM documents WHERE length(text) >= 60)")
def fixed_window_excerpts(spark, d):
    return op.fixed_windows(table(spark, d, "documents"), "doc_id", "text", 60, 80)


@query(f"SELECT article_id, row_id, text FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY {_sha(SEED, 'row_id')}, row_id) AS k FROM train WHERE article_id IS NOT NULL) WHERE k = 1")
def one_excerpt_per_doc(spark, d):
    rows = table(spark, d, "train").where("article_id is not null").select("article_id", "row_id", "text")
    return op.first_per_key(rows, "article_id", [hashing.shuffle_key(F.col("row_id"), SEED), F.col("row_id")])


@query("SELECT count(*)::BIGINT AS windows, count(*) FILTER (WHERE substr(d.text, w.start::INTEGER + 1, 80) <> w.text)::BIGINT AS wrong FROM documents d JOIN (SELECT doc_id, substr(text, start::INTEGER + 1, 80) AS text, start FROM (SELECT doc_id, text, unnest(range(0, length(text) - 60 + 1, 60)) AS start FROM documents WHERE length(text) >= 60)) w USING (doc_id)")
def excerpt_provenance_check(spark, d):
    docs = table(spark, d, "documents")
    w = op.fixed_windows(docs, "doc_id", "text", 60, 80).select("doc_id", "start", "end", F.col("text").alias("excerpt"))
    wrong = F.substr(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")) != F.col("excerpt")
    return docs.select("doc_id", "text").join(w, "doc_id").agg(F.count(F.lit(1)).alias("windows"), F.count_if(wrong).alias("wrong"))


@query("SELECT row_id, \"length\" AS stated, length(text)::INTEGER AS actual, (end_offset - start_offset)::INTEGER AS span FROM train WHERE \"length\" IS DISTINCT FROM length(text)")
def stated_length_check(spark, d):
    return table(spark, d, "train").where(~F.col("length").eqNullSafe(F.length("text"))).select("row_id", F.col("length").alias("stated"), F.length("text").alias("actual"), (F.col("end_offset") - F.col("start_offset")).alias("span"))


_BLANK = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _lines_of(lang: str) -> str:
    return rf"""l AS (SELECT doc_id, unnest(string_split_regex(text, '[\r\n\x{{85}}\x{{2028}}\x{{2029}}]')) AS line, generate_subscripts(string_split_regex(text, '[\r\n\x{{85}}\x{{2028}}\x{{2029}}]'), 1) AS i FROM documents WHERE text <> '' AND lang = '{lang}'),
 p AS (SELECT doc_id, line, length(line) AS n, string_split(line, '') AS c, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM l WHERE line IS NOT NULL)"""


@query(rf"""WITH {_lines_of('en')}, s AS (SELECT *, list_transform(c, lambda x: regexp_matches(x, '{_BLANK}')) AS blank FROM p WHERE line <> ''),
 t AS (SELECT *, list_filter(range(1, n + 1), lambda i: NOT blank[i] AND (i = 1 OR blank[i - 1])) AS starts, list_filter(range(1, n + 1), lambda i: NOT blank[i] AND (i = n OR blank[i + 1])) AS ends FROM s),
 w AS (SELECT doc_id, base, line, unnest(starts) AS a, ends FROM t), x AS (SELECT doc_id, base, line, a, unnest(list_filter(ends, lambda e: e - a + 1 BETWEEN 20 AND 25)) AS e FROM w)
 SELECT DISTINCT doc_id AS id, (base + a - 1)::INTEGER AS start, (base + e)::INTEGER AS "end", substr(line, a::INTEGER, (e - a + 1)::INTEGER) AS text FROM x""")
def token_window_excerpts(spark, d):
    return op.excerpt_windows(table(spark, d, "documents").where("lang = 'en'"), "doc_id", "tokens")


@query(rf"""WITH {_lines_of('ja')}, h AS (SELECT doc_id, line, n, base, c, unnest(list_filter(range(0, n), lambda i: contains('「」『』', c[i + 1]))) AS i FROM p WHERE line <> ''),
 s AS (SELECT doc_id, line, n, base, c[i + 1] AS hit, greatest(0, least(i - shift, n - 25)) AS a FROM h CROSS JOIN (VALUES (12), (18), (6), (0)) v(shift)), w AS (SELECT *, least(a + 25, n) AS b, substr(line, (a + 1)::INTEGER, (least(a + 25, n) - a)::INTEGER) AS text FROM s)
 SELECT DISTINCT doc_id AS id, (base + a)::INTEGER AS start, (base + b)::INTEGER AS "end", text FROM w WHERE b - a >= 20 AND contains(text, hit) AND NOT regexp_matches(text, '^{_BLANK}|{_BLANK}$')""")
def hit_centred_excerpts(spark, d):
    return op.excerpt_windows(table(spark, d, "documents").where("lang = 'ja'"), "doc_id", "hits", extra="「」『』")


@query()
def barrier_window_excerpts(spark, d):
    kana = "".join(chr(o) for o in range(0x3041, 0x30FF))
    return op.excerpt_windows(table(spark, d, "documents").where("lang = 'ja'"), "doc_id", "barriers", 8, 12, ("ー", kana))


_VALID = "valid AS (SELECT article_id, split, source FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY assigned_at DESC, split DESC NULLS LAST, source DESC NULLS LAST) AS k FROM article_splits WHERE article_id IS NOT NULL) WHERE k = 1)"


def _valid_splits(spark, d):
    last = table(spark, d, "article_splits").where("article_id is not null").groupBy("article_id").agg(F.max(F.struct("assigned_at", "split", "source")).alias("x"))
    return last.select("article_id", "x.split", "x.source")


@query(f"WITH {_VALID}, t AS (SELECT row_id, text, split FROM train JOIN valid USING (article_id) WHERE text IS NOT NULL), g AS (SELECT row_id, split, unnest(CASE WHEN length(text) < 16 THEN [text] ELSE list_transform(range(1, length(text) - 14), lambda i: substr(text, i, 16)) END) AS gram FROM t) SELECT DISTINCT row_id AS id FROM g WHERE split = 'train' AND gram IN (SELECT gram FROM g WHERE split IN ('validation', 'test'))")
def fragment_contamination(spark, d):
    rows = table(spark, d, "train").select("row_id", "article_id", "text").join(_valid_splits(spark, d), "article_id")
    return op.sharing_rows(rows.where("split = 'train'"), "row_id", rows.where("split in ('validation', 'test')"))


@query(f"WITH {_VALID}, t AS (SELECT row_id, text, split FROM train JOIN valid USING (article_id) WHERE text IS NOT NULL), g AS (SELECT row_id, split, unnest(CASE WHEN length(text) < 16 THEN [text] ELSE list_transform(range(1, length(text) - 14), lambda i: substr(text, i, 16)) END) AS gram FROM t) SELECT row_id, text FROM t WHERE split = 'train' AND row_id NOT IN (SELECT row_id FROM g WHERE split = 'train' AND gram IN (SELECT gram FROM g WHERE split IN ('validation', 'test')))")
def decontaminated_rows(spark, d):
    rows = table(spark, d, "train").where("text is not null").select("row_id", "article_id", "text").join(_valid_splits(spark, d), "article_id").where("split = 'train'")
    return rows.select("row_id", "text").join(fragment_contamination(spark, d).withColumnRenamed("id", "row_id"), "row_id", "left_anti")


@query(f"WITH {_VALID} SELECT row_id FROM train WHERE article_id NOT IN (SELECT article_id FROM valid WHERE split IN ('validation', 'test'))")
def heldout_articles(spark, d):
    held = _valid_splits(spark, d).where("split in ('validation', 'test')").select("article_id")
    return table(spark, d, "train").where("article_id is not null").join(held, "article_id", "left_anti").select("row_id")


@query(f"WITH {_VALID} SELECT split, count(*)::BIGINT AS leaked FROM train t JOIN valid USING (article_id) WHERE split IN ('validation', 'test') AND sample_id IN (SELECT sample_id FROM train JOIN valid USING (article_id) WHERE split = 'train') GROUP BY 1")
def leakage_assertion(spark, d):
    rows = table(spark, d, "train").select("sample_id", "article_id").join(_valid_splits(spark, d), "article_id")
    ids = rows.where("split = 'train'").select("sample_id").distinct()
    return rows.where("split in ('validation', 'test')").join(ids, "sample_id", "left_semi").groupBy("split").agg(F.count(F.lit(1)).alias("leaked"))


@query("SELECT sample_id, count(*)::BIGINT AS n FROM train GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, d):
    return integrity.repeated(table(spark, d, "train"), ["sample_id"])


@query("SELECT a.c AS character, b.c AS alike FROM (SELECT representative AS r, unnest(members) AS c FROM character_aliases_quotes_homoglyphs) a JOIN (SELECT representative AS r, unnest(members) AS c FROM character_aliases_quotes_homoglyphs) b ON a.r = b.r AND unicode(a.c) < unicode(b.c) GROUP BY 1, 2")
def confusable_pairs(spark, d):
    m = table(spark, d, "character_aliases_quotes_homoglyphs").select(F.col("representative").alias("r"), F.explode("members").alias("c"))
    a, b = m.select("r", F.col("c").alias("character")), m.select("r", F.col("c").alias("alike"))
    return a.join(b, "r").where(F.ascii("character") < F.ascii("alike")).select("character", "alike").distinct()
