"""Queries of the package and, where SQL can state them, their SQL."""

from __future__ import annotations

from ..session import table
from . import components, encoding, lookalike, mixing, overlap, packing, repetition, splits, subset, terms


def p1_restored(spark, d):
    return encoding.garbled(encoding.documents_and_lines(table(spark, d, "documents"), table(spark, d, "page_lines")))


def p1_found(spark, d):
    return p1_restored(spark, d).select("table_name", "record_id")


def p2_found(spark, d):
    return splits.broken_ties(table(spark, d, "labels"))


def p2_splits(spark, d):
    return splits.assign_splits(table(spark, d, "labels"), table(spark, d, "split_targets"))


def p2_rendezvous(spark, d):
    return splits.assign_splits(table(spark, d, "labels"), table(spark, d, "split_targets"), by_records=False)


def p2_shares(spark, d):
    return splits.split_shares(p2_splits(spark, d), table(spark, d, "split_targets"))


def _overlap_tables(spark, d):
    return table(spark, d, "train"), table(spark, d, "article_splits"), table(spark, d, "character_aliases_quotes_homoglyphs")


def p3_found(spark, d):
    return overlap.cross_split_pairs(*_overlap_tables(spark, d)).select("row_a", "row_b")


def p3_report(spark, d):
    return overlap.overlap_report(*_overlap_tables(spark, d))


def p3_links(spark, d):
    return overlap.overlap_links(*_overlap_tables(spark, d))


def p4_found(spark, d):
    return components.group_keys(table(spark, d, "similarity_candidates"))


def p5_frequencies(spark, d):
    return terms.anchor_and_character_terms(table(spark, d, "train"), table(spark, d, "coverage"))


def p5_found(spark, d):
    return p5_frequencies(spark, d).where("mark is not null").select("field_name", "term", "mark")


def p6_subset(spark, d):
    return subset.varied_subset(table(spark, d, "train"), 2000)


def p6_report(spark, d):
    return subset.subset_report(table(spark, d, "train"), p6_subset(spark, d))


def p7_rewritten(spark, d):
    return lookalike.inconsistent_rows(table(spark, d, "train"), table(spark, d, "real_references"), table(spark, d, "character_aliases_quotes_homoglyphs"))


def p7_found(spark, d):
    return p7_rewritten(spark, d).select("table_name", "record_id")


def p8_packed(spark, d):
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "pack_capacities"))


def p8_report(spark, d):
    return packing.fill_report(p8_packed(spark, d), table(spark, d, "pack_capacities"), table(spark, d, "documents"))


def p9_mixed(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_report(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_repetition(spark, d):
    return repetition.repetition_shares(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def p10_found(spark, d):
    return repetition.repeated_documents(table(spark, d, "documents")).select(repetition.F.col("id").alias("doc_id"))


def p10_risk(spark, d):
    return repetition.rejection_risk(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_restored, p2_found, p2_splits, p2_rendezvous, p2_shares, p3_found, p3_report, p3_links, p4_found, p5_found, p5_frequencies, p6_subset, p6_report, p7_found, p7_rewritten, p8_packed, p8_report, p9_mixed, p9_report, p10_found, p10_repetition, p10_risk)}

_TIES = r"""
WITH RECURSIVE rows0 AS (SELECT label_id, nullif(regexp_extract(source_pdf, '([^/\\]*)$', 1), '') AS doc, split_group AS g, split FROM labels),
r AS (SELECT *, coalesce('d:' || doc, 'g:' || g) AS node FROM rows0),
e AS (SELECT DISTINCT 'd:' || doc AS a, 'g:' || g AS b FROM r WHERE doc IS NOT NULL AND g IS NOT NULL),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(n, m) AS (SELECT DISTINCT node, node FROM r WHERE node IS NOT NULL UNION SELECT reach.n, both_ways.b FROM reach JOIN both_ways ON reach.m = both_ways.a),
comp AS (SELECT n, min(m) AS c FROM reach GROUP BY n),
broken AS (SELECT c FROM r JOIN comp ON n = node WHERE split IS NOT NULL GROUP BY c HAVING count(DISTINCT split) > 1)
SELECT DISTINCT doc AS source_pdf FROM r JOIN comp ON n = node JOIN broken USING (c) WHERE doc IS NOT NULL
"""
_SPLITS = _TIES.split("broken AS")[0] + """c AS (SELECT label_id, doc, g, split, coalesce(comp.c, r.node, 'r:' || label_id) AS component FROM r LEFT JOIN comp ON n = node),
t AS (SELECT split, sum(target_share) AS w FROM split_targets WHERE split IS NOT NULL AND target_share > 0 GROUP BY 1),
s AS (SELECT component, arg_max(split, -w / ln((('0x' || substr(sha256('split:' || split || ':' || component), 1, 13))::UBIGINT::DOUBLE + 1) / 4503599627370497)) AS new_split FROM (SELECT DISTINCT component FROM c) CROSS JOIN t GROUP BY 1)
SELECT label_id, doc AS document, g AS split_group, component, split AS old_split, new_split FROM c JOIN s USING (component)
"""
_KEYS = """
WITH RECURSIVE names AS (SELECT image_a AS n FROM similarity_candidates WHERE image_a IS NOT NULL UNION SELECT image_b FROM similarity_candidates WHERE image_b IS NOT NULL),
e AS (SELECT image_a AS a, image_b AS b FROM similarity_candidates WHERE image_a <> image_b UNION SELECT image_b, image_a FROM similarity_candidates WHERE image_a <> image_b),
reach(n, m) AS (SELECT n, n FROM names UNION SELECT reach.n, e.b FROM reach JOIN e ON reach.m = e.a)
SELECT n AS image, min(m) AS group_key FROM reach GROUP BY n
"""
_FREQUENCIES = """
SELECT 'anchor' AS field_name, anchor AS term, count(*)::BIGINT AS occurrences, count(*)::BIGINT AS records, CASE WHEN count(*) < 3 THEN 'rare' WHEN count(*) > 0.005 * (SELECT count(anchor) FROM train) THEN 'common' END AS mark
FROM train WHERE anchor IS NOT NULL GROUP BY anchor
UNION ALL
SELECT 'character', character, sum(coalesce(corpus_occurrences, 0))::BIGINT, sum(coalesce(sample_count, 0))::BIGINT, CASE WHEN sum(coalesce(sample_count, 0)) < 3 THEN 'rare' WHEN sum(coalesce(sample_count, 0)) > 0.05 * (SELECT count(*) FROM train) THEN 'common' END
FROM (SELECT *, row_number() OVER (PARTITION BY shard, character ORDER BY counted_at DESC NULLS LAST, coverage_id DESC) AS k FROM coverage WHERE character IS NOT NULL) WHERE k = 1 GROUP BY character
"""
_TERMS = f"SELECT field_name, term, mark FROM ({_FREQUENCIES}) WHERE mark IS NOT NULL"
_REPEATED = r"""
WITH kept AS (SELECT doc_id, string_split(regexp_replace(text, '[\s\x{000B}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\p{Nd}]', '', 'g'), '') AS chars FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, unnest(chars) AS c, unnest(range(1, len(chars) + 1)) AS pos FROM kept),
windows AS (SELECT doc_id, pos, c || lead(c, 1) OVER w || lead(c, 2) OVER w || lead(c, 3) OVER w || lead(c, 4) OVER w || lead(c, 5) OVER w || lead(c, 6) OVER w || lead(c, 7) OVER w || lead(c, 8) OVER w || lead(c, 9) OVER w || lead(c, 10) OVER w || lead(c, 11) OVER w || lead(c, 12) OVER w || lead(c, 13) OVER w || lead(c, 14) OVER w || lead(c, 15) OVER w || lead(c, 16) OVER w || lead(c, 17) OVER w || lead(c, 18) OVER w || lead(c, 19) OVER w AS g FROM c WHERE c <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
again AS (SELECT doc_id, pos, (g IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, g ORDER BY pos) > 1)::INTEGER AS r FROM windows),
covered AS (SELECT doc_id, max(r) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS r FROM again)
"""
_SHARES = _REPEATED + r""", n AS (SELECT doc_id, count(*)::BIGINT AS kept, sum(r)::BIGINT AS repeated FROM covered GROUP BY doc_id)
SELECT d.doc_id, coalesce(lang, 'none') AS stratum, coalesce(kept, 0)::BIGINT AS kept, coalesce(repeated, 0)::BIGINT AS repeated, CASE WHEN kept > 0 THEN repeated / kept ELSE 0.0::DOUBLE END AS share FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id
"""
_FOUND_REPEATED = _REPEATED + "SELECT doc_id FROM covered GROUP BY doc_id HAVING sum(r) >= 0.30 * count(*)"
_INCONSISTENT = r"""
SELECT table_name, record_id FROM (SELECT 'train' AS table_name, row_id AS record_id, text FROM train UNION ALL SELECT 'real_references', ref_id, reference FROM real_references)
WHERE text <> nfc_normalize(text) OR regexp_matches(text, '[\x{FF01}-\x{FF60}\x{FFE0}-\x{FFE6}\x{FF61}-\x{FF9F}\x{FB00}-\x{FB06}\x{2E80}-\x{2FD5}\x{F900}-\x{FAFF}\x{00A0}\x{1680}\x{2000}-\x{200F}\x{202F}\x{205F}\x{3000}\x{00AD}\x{034F}\x{061C}\x{180B}-\x{180E}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}]') OR regexp_matches(text, '[A-Za-z\x{00C0}-\x{024F}][\x{0370}-\x{03FF}\x{0400}-\x{052F}]|[\x{0370}-\x{03FF}\x{0400}-\x{052F}][A-Za-z\x{00C0}-\x{024F}]')
 OR regexp_matches(text, '[ァ-ヺー][一二力口工夕卜八丿厶]+([^一-鿿ぁ-ゖ]|$)|(^|[^一-鿿ぁ-ゖ])[一二力口工夕卜八丿厶]+[ァ-ヺー]|[\x{0370}-\x{03FF}][\x{0400}-\x{052F}]|[\x{0400}-\x{052F}][\x{0370}-\x{03FF}]')
"""
SQL = {"p2_found": _TIES, "p2_rendezvous": _SPLITS, "p4_found": _KEYS, "p5_found": _TERMS, "p5_frequencies": _FREQUENCIES, "p7_found": _INCONSISTENT, "p10_found": _FOUND_REPEATED, "p10_repetition": _SHARES}
