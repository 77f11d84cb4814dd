"""Selection, sampling, mixing and verification queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import characters as ch, hashing, text as tx
from ..operators import corpus, integrity, layout, selection as op
from ..session import Workspace, table
from .corpus import SEED, _BLANK, _sha
from .registry import query

HIRAGANA = "".join(chr(o) for o in range(0x3041, 0x3094))


@query("SELECT shard, row_id FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY row_id) AS k FROM train) WHERE k <= 3")
def first_rows_per_shard(spark, d):
    w = Window.partitionBy("shard").orderBy("row_id")
    return table(spark, d, "train").select("shard", "row_id", F.row_number().over(w).alias("k")).where("k <= 3").drop("k")


@query(f"SELECT doc_id FROM documents ORDER BY {_sha(SEED, 'doc_id')}, doc_id LIMIT 100")
def hash_shuffle_head(spark, d):
    return op.hash_sample(table(spark, d, "documents").select("doc_id"), "doc_id", SEED, 100)


@query(f"SELECT epoch, doc_id, row_number() OVER (PARTITION BY epoch, source ORDER BY sha256('{SEED}/' || epoch || ':' || doc_id), doc_id)::INTEGER AS position FROM documents, (VALUES (1), (2)) e(epoch) WHERE source IS NOT NULL")
def epoch_orders(spark, d):
    docs = table(spark, d, "documents").where("source is not null").select("doc_id", "source", F.explode(F.array(F.lit(1), F.lit(2))).alias("epoch"))
    key = F.sha2(F.concat(F.lit(SEED + "/"), "epoch", F.lit(":"), "doc_id"), 256)
    return docs.select("epoch", "doc_id", F.row_number().over(Window.partitionBy("epoch", "source").orderBy(key, "doc_id")).alias("position"))


@query(f"SELECT lang, source, doc_id, turn::INTEGER AS turn FROM (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY {_sha(SEED, 'doc_id')}, doc_id) AS turn FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL) ORDER BY turn, lang, source LIMIT 200")
def stratified_round_robin(spark, d):
    docs = table(spark, d, "documents").where("lang is not null and source is not null").select("lang", "source", "doc_id")
    return op.round_robin(docs, ["lang", "source"], F.struct(hashing.shuffle_key(F.col("doc_id"), SEED), "doc_id"), 200)


@query(f"SELECT doc_id, ['top', 'bottom', 'left'][((row_number() OVER (PARTITION BY source ORDER BY {_sha(SEED, 'doc_id')}, doc_id) - 1) % 3)::INTEGER + 1] AS position FROM documents")
def balanced_assignment(spark, d):
    order = F.struct(hashing.shuffle_key(F.col("doc_id"), SEED), F.col("doc_id"))
    return table(spark, d, "documents").select("doc_id", op.balanced_values(None, [F.col("source")], order, ["top", "bottom", "left"]).alias("position"))


@query("""WITH p AS (SELECT source_pdf, page, max(line_count) AS n FROM labels WHERE source_pdf IS NOT NULL GROUP BY 1, 2), e AS (SELECT *, row_number() OVER (PARTITION BY source_pdf ORDER BY page) AS i, count(*) OVER (PARTITION BY source_pdf) AS m FROM p WHERE n > 0)
 SELECT source_pdf, page FROM e WHERE i = (m + 2) // 3 OR i = (2 * m + 2) // 3""")
def quantile_pick(spark, d):
    pages = table(spark, d, "labels").where("source_pdf is not null").groupBy("source_pdf", "page").agg(F.max("line_count").alias("n"))
    return op.third_pages(pages, "source_pdf", "page", F.col("n")).select("source_pdf", "page")


@query("SELECT image, line_id, before::BIGINT AS before FROM (SELECT image, line_id, coalesce(sum(length(text)) OVER (PARTITION BY image ORDER BY line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM page_lines) WHERE before < 200")
def running_budget_prefix(spark, d):
    rows = table(spark, d, "page_lines").select("image", "line_id", F.length("text").alias("size"))
    return op.within_budget(rows, "image", "line_id", "size", 200).select("image", "line_id", "before")


@query("""WITH r AS (SELECT image, line_id, bbox[4] <= 700 AS fits, source_block = 0 AS heading, row_number() OVER (PARTITION BY image ORDER BY line_id) AS i, count(*) OVER (PARTITION BY image) AS n FROM page_lines WHERE image IS NOT NULL),
 f AS (SELECT *, coalesce(min(CASE WHEN NOT fits THEN i END) OVER (PARTITION BY image) - 1, n) AS capacity FROM r), k AS (SELECT * FROM f WHERE capacity > 0 AND i <= greatest(1, floor(capacity * 0.75)))
 SELECT image, line_id FROM (SELECT *, max(CASE WHEN NOT heading THEN i END) OVER (PARTITION BY image) AS last FROM k) WHERE i <= last""")
def overflow_prefix(spark, d):
    rows = table(spark, d, "page_lines").where("image is not null").select("image", "line_id", (F.get("bbox", F.lit(3)) <= 700).alias("fits"), (F.col("source_block") == 0).alias("heading"))
    return op.before_overflow(rows, "image", "line_id", "fits", "heading", 0.75).select("image", "line_id")


@query(rf"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r\x{{0B}}\x{{0C}}\x{{1C}}-\x{{1E}}\x{{85}}\x{{2028}}\x{{2029}}]'), lambda p: regexp_replace(p, '^{_BLANK}+|{_BLANK}+$', '', 'g')), lambda p: length(p) >= 40) AS ps FROM documents WHERE text IS NOT NULL),
 r(doc_id, ps, k, room, out) AS (SELECT doc_id, ps, 0, 400, ''::VARCHAR FROM p UNION ALL
  SELECT doc_id, ps, k + 1, (room - length(cut))::INTEGER, CASE WHEN k = 0 THEN cut ELSE out || chr(10) || cut END FROM (SELECT *, CASE WHEN length(ps[k + 1]) <= room THEN ps[k + 1] WHEN stop >= 61 THEN substr(head, 1, stop) ELSE head END AS cut
   FROM (SELECT *, substr(ps[k + 1], 1, room) AS head, CASE WHEN contains(substr(ps[k + 1], 1, room), '。') THEN length(substr(ps[k + 1], 1, room)) - strpos(reverse(substr(ps[k + 1], 1, room)), '。') + 1 ELSE 0 END AS stop FROM r WHERE k < len(ps) AND room >= 80)))
 SELECT doc_id, arg_max(out, k) AS paragraphs FROM r GROUP BY 1""")
def paragraph_excerpts(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(op.paragraph_excerpt(F.col("text"), 400), "\n").alias("paragraphs"))


@query("WITH s AS (SELECT user_id, floor((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) / 6)::BIGINT AS segment, round(value * 100)::BIGINT AS cents FROM events) SELECT user_id, segment, count(*)::BIGINT AS items, sum(cents)::BIGINT AS cents FROM s GROUP BY ROLLUP (user_id, segment)")
def segmented_subtotals(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, d, "events").select("user_id", F.floor((F.row_number().over(w) - 1) / 6).alias("segment"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    return rows.rollup("user_id", "segment").agg(F.count(F.lit(1)).alias("items"), F.sum("cents").alias("cents"))


@query(f"SELECT doc_id, CASE WHEN u < 6 THEN 'plain' WHEN u < 9 THEN 'ruled' ELSE 'dashed' END AS style FROM (SELECT doc_id, ('0x' || substr({_sha(SEED, 'doc_id')}, 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0 * 10 AS u FROM documents)")
def weighted_choices(spark, d):
    return table(spark, d, "documents").select("doc_id", op.weighted_choice(F.col("doc_id"), SEED, {"plain": 6.0, "ruled": 3.0, "dashed": 1.0}).alias("style"))


@query("SELECT part, 'source-' || (CASE part WHEN 'ja' THEN 0 ELSE 1 END) || '-' || doc_id AS doc_id, length(text)::INTEGER AS n FROM (SELECT lang AS part, doc_id, text FROM documents WHERE lang IN ('ja', 'en'))")
def mixture_union(spark, d):
    docs = table(spark, d, "documents")
    parts = [(lang, docs.where(F.col("lang") == lang).select("doc_id", F.length("text").alias("n"))) for lang in ("ja", "en")]
    return integrity.mixture(parts, "doc_id")


@query("SELECT count(*) FILTER (WHERE lang = 'ja') = count(*) FILTER (WHERE lang = 'en') AS equal FROM documents")
def mixture_counts_equal(spark, d):
    docs = table(spark, d, "documents")
    return integrity.equal_counts([(lang, docs.where(F.col("lang") == lang)) for lang in ("ja", "en")])


@query("WITH p AS (SELECT DISTINCT lang, unnest(string_split(text, '')) AS character FROM train WHERE lang IS NOT NULL) SELECT character FROM p GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT lang) FROM p)")
def characters_of_all_languages(spark, d):
    rows = table(spark, d, "train").where("lang is not null").select("lang", F.explode(F.array_distinct(tx.characters(F.col("text")))).alias("character"))
    return integrity.held_by_all(rows, "lang", "character")


@query("SELECT count(*)::BIGINT AS \"rows\", count(DISTINCT doc_id)::BIGINT AS ids, count(DISTINCT text)::BIGINT AS texts FROM documents")
def distinct_texts(spark, d):
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids"), F.count_distinct("text").alias("texts"))


@query("""WITH h AS (SELECT lang, doc_id AS o, sha256(coalesce(text, chr(0))) AS h FROM documents), b AS (SELECT lang, floor(o / 4096) AS block, count(*) AS n, sha256(string_agg(h, '' ORDER BY o, h)) AS h FROM h GROUP BY 1, 2)
 SELECT lang, sum(n)::BIGINT AS "rows", sha256(string_agg(h, '' ORDER BY block)) AS digest FROM b GROUP BY 1""")
def dataset_digest(spark, d):
    return integrity.content_digest(table(spark, d, "documents"), "doc_id", "text", ["lang"])


def _checks():
    return {
        "unique_id": F.col("n") == 1,
        "digest": F.col("sample_id") == F.sha2("text", 256),
        "length": F.col("length") == F.length("text"),
        "span": F.col("end_offset") - F.col("start_offset") == F.length("text"),
        "single_line": ~F.col("text").rlike(r"[\r\n]"),
        "anchor_inside": F.contains(F.col("text"), F.col("anchor")),
        "has_article": F.col("article_id").isNotNull(),
    }


@query(r"""WITH t AS (SELECT *, count(*) OVER (PARTITION BY row_id) AS n FROM train),
 c AS (SELECT [n = 1, sample_id = sha256(text), "length" = length(text), end_offset - start_offset = length(text), NOT regexp_matches(text, '[\r\n]'), contains(text, anchor), article_id IS NOT NULL] AS ok FROM t)
 SELECT "check", count(*) FILTER (WHERE NOT coalesce(ok[i], false))::BIGINT AS violations FROM c, (VALUES (1, 'unique_id'), (2, 'digest'), (3, 'length'), (4, 'span'), (5, 'single_line'), (6, 'anchor_inside'), (7, 'has_article')) k(i, "check") GROUP BY 1""")
def verifier_violations(spark, d):
    train = table(spark, d, "train")
    counted = train.join(train.groupBy("row_id").agg(F.count(F.lit(1)).alias("n")), "row_id")
    return integrity.violations(counted, _checks())


def _candidates(spark, d):
    return table(spark, d, "train").where("text is not null").select(F.col("row_id").alias("id"), F.coalesce("article_id", F.concat(F.lit("row:"), "row_id")).alias("article_id"), F.col("start_offset").alias("start"), F.col("end_offset").alias("end"), "text")


@query()
def disjoint_excerpts(spark, d):
    return op.disjoint_excerpts(_candidates(spark, d).select("id", "article_id", "text"), SEED).select("id", "article_id")


@query()
def rare_first_selection(spark, d):
    return op.rare_first_selection(_candidates(spark, d), 3)


@query()
def balanced_pick(spark, d):
    pool = table(spark, d, "train").select(F.col("row_id").alias("id"), "article_id", F.coalesce("lang", F.lit("")).alias("language"), "text").where("article_id is not null and text is not null")
    return op.balanced_pick(pool, "“”‘’「」°éß", 20, SEED)[1]


_HITS = "[" + ", ".join(f"'{p}'" for p in tx.SEQUENCE_PATTERNS) + "]"


@query(rf"""WITH w AS (SELECT row_id AS id, article_id, {_sha(SEED, 'row_id')} AS rank, list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_''-]+'), lambda w: regexp_full_match(w, '[A-Za-z]+([''-][A-Za-z]+)*')) AS words FROM train WHERE lang = 'en' AND article_id IS NOT NULL),
 h AS (SELECT id, article_id, rank, unnest(list_filter({_HITS}, lambda p: len(list_filter(words, lambda w: contains(w, p))) > 0)) AS pattern FROM w), one AS (SELECT *, row_number() OVER (PARTITION BY pattern, article_id ORDER BY rank, id) AS a FROM h),
 k AS (SELECT pattern, id, article_id, row_number() OVER (PARTITION BY pattern ORDER BY rank, id)::INTEGER AS k FROM one WHERE a = 1) SELECT * FROM k WHERE k <= 50""")
def goal_collection(spark, d):
    rows = table(spark, d, "train").where("lang = 'en' and article_id is not null")
    hits = rows.select(F.col("row_id").alias("id"), "article_id", F.explode(tx.patterns_in(tx.english_words(F.col("text")))).alias("pattern"), hashing.shuffle_key(F.col("row_id"), SEED).alias("rank"))
    return op.first_per_pattern(hits, 50)


@query()
def deficit_fill(spark, d):
    vocabulary = spark.createDataFrame([(c,) for c in HIRAGANA + "ヰヱヵヶ"], "character string")
    lacking = corpus.coverage(table(spark, d, "train"), vocabulary, 50)
    return op.deficit_lines(lacking, "あいうえおかきくけこさしすせそたちつてとなにぬねの", 5, 22, SEED)


def _substitutions(spark, d):
    counts = corpus.character_counts(table(spark, d, "train"))
    lacking = ch.with_properties(counts.where("article_count < 2")).select("character", (2 - F.col("article_count")).alias("shortfall"), "class")
    classes = ch.with_properties(counts.select("character")).select("character", "class")
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).where("text <> ''")
    donors = lines.select(F.concat_ws(":", "doc_id", "line").alias("id"), "text")
    return op.deficit_substitutions(lacking.select("character", "shortfall"), donors, classes, SEED)


@query()
def deficit_substitution(spark, d):
    return _substitutions(spark, d).select("donor_id", "position", "from", "to", "text")


_NAME = r"nullif(regexp_extract(source_pdf, '([^/\\]*)$', 1), '')"


@query(f"""WITH a AS (SELECT {_NAME} AS document, max(page)::INTEGER AS pages FROM labels WHERE {_NAME} IS NOT NULL GROUP BY 1), b AS (SELECT {_NAME} AS document, max(page)::INTEGER AS pages FROM page_lines WHERE {_NAME} IS NOT NULL GROUP BY 1)
 SELECT a.document, CASE WHEN b.document IS NULL THEN 'missing' ELSE 'different' END AS problem FROM a LEFT JOIN b ON a.document = b.document WHERE b.document IS NULL OR a.pages IS DISTINCT FROM b.pages""")
def record_consistency(spark, d):
    def pages(name):
        document = F.nullif(tx.basename(F.col("source_pdf")), F.lit(""))
        return table(spark, d, name).select(document.alias("document"), "page").where("document is not null").groupBy("document").agg(F.max("page").alias("pages"))

    return integrity.checked_records(pages("labels"), pages("page_lines"), "document", "pages")


@query("SELECT lower(trim(text)) AS text FROM train INTERSECT SELECT lower(trim(reference)) FROM real_references")
def normalized_intersection(spark, d):
    a = table(spark, d, "train").select(F.lower(F.trim("text")).alias("text"))
    return a.intersect(table(spark, d, "real_references").select(F.lower(F.trim("reference")).alias("text")))


@query("SELECT DISTINCT image FROM labels WHERE img_hash NOT IN (SELECT image_sha256 FROM real_references WHERE image_sha256 IS NOT NULL) AND img_hash IS NOT NULL")
def hash_membership(spark, d):
    known = table(spark, d, "real_references").select(F.col("image_sha256").alias("img_hash")).where("img_hash is not null").distinct()
    return table(spark, d, "labels").where("img_hash is not null").join(known, "img_hash", "left_anti").select("image").distinct()


@query("SELECT source_pdf, array_to_string(list_sort(list(DISTINCT font_name)), ',') AS fonts FROM page_lines WHERE source_pdf IS NOT NULL AND font_name IS NOT NULL GROUP BY 1")
def fonts_of_documents(spark, d):
    rows = table(spark, d, "page_lines").where("source_pdf is not null and font_name is not null")
    return rows.groupBy("source_pdf").agg(F.array_join(F.array_sort(F.collect_set("font_name")), ",").alias("fonts"))


@query("SELECT row_id, len(ids)::INTEGER AS length, list_sum(ids)::BIGINT AS total, len(list_filter(ids, lambda x: x = 0))::INTEGER AS blanks FROM (SELECT row_id, list_transform(string_split(text, ''), lambda c: strpos('abcdefghijklmnopqrstuvwxyz .,', c)) AS ids FROM train WHERE lang = 'en')")
def encoded_texts(spark, d):
    rows = table(spark, d, "train").where("lang = 'en'").select("row_id", tx.encode(F.col("text"), "abcdefghijklmnopqrstuvwxyz .,").alias("ids"))
    return rows.select("row_id", F.size("ids").alias("length"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size(F.filter("ids", lambda x: x == 0)).alias("blanks"))


@query("SELECT w.row_id, 'different' AS problem FROM train w JOIN train p USING (row_id) WHERE w.text IS DISTINCT FROM p.text OR w.\"length\" IS DISTINCT FROM length(p.text)")
def resume_prefix_check(spark, d):
    train = table(spark, d, "train")
    return integrity.prefix_mismatches(train.select("row_id", "text", "length"), train.select("row_id", "text", F.length("text").alias("length")), "row_id", ["text", "length"])


@query("SELECT * FROM (VALUES ('article', 0::BIGINT), ('fragment', 0), ('left_out', 0)) x(\"check\", violations)")
def disjoint_excerpts_check(spark, d):
    """The disjoint rows against their own rules: one row per article, no shared fragment, and every row left out meets one
    that was taken."""
    pool = _candidates(spark, d).select("id", "article_id", "text")
    taken = Workspace(spark).write(op.disjoint_excerpts(pool, SEED).select("id", "article_id", "text"), "taken")
    grams = corpus.fragment_keys(taken, "id").distinct()
    rest = pool.join(taken.select("id"), "id", "left_anti").join(taken.select("article_id").distinct(), "article_id", "left_anti")
    blocked = corpus.fragment_keys(rest, "id").join(grams.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("id").distinct()
    return _counted({"article": integrity.repeated(taken, ["article_id"]), "fragment": integrity.repeated(grams, ["h1", "h2"]), "left_out": rest.join(blocked, "id", "left_anti")})


@query(f"""WITH v AS (SELECT DISTINCT unnest(string_split('{HIRAGANA}ヰヱヵヶ', '')) AS character), n AS (SELECT character, count(DISTINCT row_id) AS n FROM (SELECT row_id, unnest(string_split(text, '')) AS character FROM train WHERE text <> '') GROUP BY 1)
 SELECT character, (50 - coalesce(n, 0))::BIGINT AS places, 22::INTEGER AS length, 0::BIGINT AS wrong FROM v LEFT JOIN n USING (character) WHERE coalesce(n, 0) < 50""")
def deficit_fill_check(spark, d):
    """Of each lacking character how many places the lines give it, the length of its lines, and places that hold something
    else or lie in a line that has the character twice."""
    lines = deficit_fill(spark, d)
    e = lines.select("text", F.explode("embedded_targets").alias("e")).select("text", "e.*")
    wrong = (F.substr("text", F.col("position") + 1, F.lit(1)) != F.col("character")) | (F.length(F.replace("text", F.col("character"))) != F.length("text") - 1)
    return e.groupBy("character").agg(F.count(F.lit(1)).alias("places"), F.max(F.length("text")).alias("length"), F.count_if(wrong).alias("wrong"))


@query("SELECT * FROM (VALUES ('character', 0::BIGINT), ('article', 0), ('fragment', 0), ('avoidable_shortage', 0)) x(\"check\", violations)")
def balanced_pick_check(spark, d):
    """The pick against its own rules: rows hold their character, one row per language and article, no shared fragment, and
    no usable row is left for a character that is reported short."""
    pool = table(spark, d, "train").select(F.col("row_id").alias("id"), "article_id", F.coalesce("lang", F.lit("")).alias("language"), "text").where("article_id is not null and text is not null")
    chosen, report = op.balanced_pick(pool, "“”‘’「」°éß", 20, SEED)
    work = Workspace(spark)
    chosen, report = work.write(chosen, "chosen"), work.write(report, "report")
    rows = chosen.select("id", "article_id", "language", "text").distinct()
    grams = corpus.fragment_keys(rows, "id").distinct()
    taken = grams.select("h1", "h2").distinct()
    short = report.where("shortage > 0").select("character")
    usable = pool.select("*", F.explode(F.array_distinct(tx.characters(F.col("text")))).alias("character")).join(F.broadcast(short), "character").select("id", "article_id", "language", "text").distinct()
    usable = usable.join(rows.select("language", "article_id").distinct(), ["language", "article_id"], "left_anti")
    blocked = corpus.fragment_keys(usable, "id").join(taken, ["h1", "h2"], "left_semi").select("id").distinct()
    return _counted({
        "character": chosen.where(~F.contains("text", F.col("character"))),
        "article": integrity.repeated(rows, ["language", "article_id"]),
        "fragment": integrity.repeated(grams, ["h1", "h2"]),
        "avoidable_shortage": usable.join(blocked, "id", "left_anti"),
    })


@query("SELECT * FROM (VALUES ('overlap', 0::BIGINT), ('fragment', 0), ('avoidable_shortage', 0)) x(\"check\", violations)")
def rare_first_check(spark, d):
    """The selection against its own rules: no two rows overlap in their article or share a fragment, and no free row is left
    that holds a character below the goal."""
    pool = _candidates(spark, d)
    taken = Workspace(spark).write(op.rare_first_selection(pool, 3), "taken")
    rows = pool.join(taken.select("id"), "id", "left_semi")
    grams = corpus.fragment_keys(rows, "id").distinct()
    pairs = layout.span_pairs(rows, "article_id", "id")
    chars = lambda df: df.select("id", F.explode(F.array_distinct(tx.characters(F.col("text")))).alias("character"))
    counts = chars(rows).groupBy("character").agg(F.count(F.lit(1)).alias("n"))
    rest = pool.join(taken.select("id"), "id", "left_anti")
    lacking = chars(rest).join(counts, "character", "left").where("n is null or n < 3").select("id").distinct()
    free = rest.join(lacking, "id", "left_semi")
    blocked = corpus.fragment_keys(free, "id").join(grams.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("id").unionByName(op.overlapping(free, rows)).distinct()
    return _counted({"overlap": pairs, "fragment": integrity.repeated(grams, ["h1", "h2"]), "avoidable_shortage": free.join(blocked, "id", "left_anti")})


@query("SELECT * FROM (VALUES ('donor_reused', 0::BIGINT), ('not_one_change', 0), ('other_class', 0), ('too_many', 0)) x(\"check\", violations)")
def deficit_substitution_check(spark, d):
    """The substitutions against their own rules: each donor once, exactly one character changed, to one of the same class,
    and never more of a character than it lacks."""
    made = Workspace(spark).write(_substitutions(spark, d), "made")
    counts = corpus.character_counts(table(spark, d, "train"))
    kinds = ch.with_properties(counts.select("character")).select("character", "class")
    rebuilt = F.concat(F.substr("base_text", F.lit(1), F.col("position")), F.col("to"), F.substr("base_text", F.col("position") + 2))
    classes = made.join(kinds.select(F.col("character").alias("from"), F.col("class").alias("a")), "from", "left").join(kinds.select(F.col("character").alias("to"), F.col("class").alias("b")), "to", "left")
    given = made.groupBy(F.col("to").alias("character")).agg(F.count(F.lit(1)).alias("n")).join(counts, "character", "left")
    return _counted({
        "donor_reused": integrity.repeated(made, ["donor_id"]),
        "not_one_change": made.where((F.col("from") == F.col("to")) | (rebuilt != F.col("text")) | (F.substr("base_text", F.col("position") + 1, F.lit(1)) != F.col("from"))),
        "other_class": classes.where(~F.col("a").eqNullSafe(F.col("b"))),
        "too_many": given.where(~F.coalesce(F.col("n") <= 2 - F.col("article_count"), F.lit(False))),
    })


def _counted(parts):
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = one if out is None else out.unionByName(one)
    return out
