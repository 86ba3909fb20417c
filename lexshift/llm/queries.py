"""The queries of the training-data problems, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshift.llm import canon, langid, leaks, pack, pairs, sample, split, terms
from lexshift.tables import one_per_key, table
from lexshift.workdir import cut

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of the rows that the operator cuts, from their pieces, which are written."""
    return cut(p1_pieces(spark, folder)).where("n_pieces > 1").select("id").distinct()


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    rows = one_per_key(table(spark, folder, "coha_tokens").select("id", "tokens", "text"), "id")
    return split.split_oversized(rows)


def p1_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    """Every row put together again from its pieces."""
    return split.rejoined(p1_pieces(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return terms.corpus_terms(table(spark, folder, "coha_tokens")).where("mark IS NOT NULL").select("term", "mark")


def p2_term_counts(spark: SparkSession, folder: str) -> DataFrame:
    return terms.corpus_terms(table(spark, folder, "coha_tokens"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.found(table(spark, folder, "substitutes"))


def p3_pairs(spark: SparkSession, folder: str) -> DataFrame:
    mentions = one_per_key(table(spark, folder, "substitutes").select("term", "line_id", "token_index", "top_terms"), "term", "line_id", "token_index")
    made = pairs.item_pairs(mentions, "top_terms", 1, 0)
    return made.withColumn("lift", F.round("lift", 9)).withColumn("pmi", F.round("pmi", 9))


FIELDS = (("coha_tokens", "text"), ("matching", "lemmas"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [canon.same_looking_pairs(table(spark, folder, tab), "id", field).select(F.lit(tab).alias("tab"), "id_a", "id_b") for tab, field in FIELDS]
    return parts[0].union(parts[1])


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    parts = [canon.same_looking(table(spark, folder, tab), "id", field).select(F.lit(tab).alias("tab"), "*") for tab, field in FIELDS]
    return parts[0].union(parts[1])


def p5_sample_mentions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "substitutes").select("term", "line_id", "token_index", "top_terms")
    return sample.uniform_sample(rows, ["term", "line_id", "token_index"])


def p5_sample_token_lists(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "coha_tokens").select("id", "tokens").where("tokens IS NOT NULL")
    return sample.uniform_sample(rows, ["id"])


def p6_pack(spark: SparkSession, folder: str) -> DataFrame:
    return pack.packed_documents(table(spark, folder, "documents"))


def p6_faults(spark: SparkSession, folder: str) -> DataFrame:
    return pack.faults(p6_pack(spark, folder))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def _languages(spark: SparkSession, folder: str) -> langid.Model:
    return langid.fit(table(spark, folder, "lang_samples"), documents=table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return langid.wrong_labels(table(spark, folder, "documents"), _languages(spark, folder))


def p8_segments(spark: SparkSession, folder: str) -> DataFrame:
    return langid.segments(table(spark, folder, "documents"), _languages(spark, folder))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p1_rejoined, p2_found, p2_term_counts, p3_found, p3_pairs, p4_found, p4_classes, p5_sample_mentions, p5_sample_token_lists, p6_pack, p6_faults, p7_found, p8_found, p8_segments)}


_COUNTS = """
WITH r AS (SELECT id, any_value(tokens) AS tokens FROM coha_tokens WHERE tokens IS NOT NULL GROUP BY id),
x AS (SELECT id, replace(unnest(tokens), '##', '') AS term FROM r),
c AS (SELECT term, count(*)::BIGINT AS occurrences, count(DISTINCT id)::BIGINT AS records FROM x WHERE term IS NOT NULL GROUP BY term),
m AS (SELECT *, CASE WHEN occurrences < 20 OR records < 5 THEN 'rare' WHEN records * 100 > 30 * (SELECT count(*) FROM r) THEN 'common' END AS mark FROM c)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_faults": "SELECT count(DISTINCT doc_id)::BIGINT AS documents, 0::BIGINT AS overfull, 0::BIGINT AS untiled, 0::BIGINT AS cut_needlessly, false AS wasteful FROM documents",
        "p1_found": """
SELECT DISTINCT id FROM coha_tokens
WHERE CASE WHEN tokens IS NOT NULL THEN coalesce(list_sum(list_transform(tokens, lambda t: 1 + coalesce(length(t) - length(replace(t, '##', '')), 0) // 2)), 0) > 256 ELSE length(text) > 1200 END""",
        "p1_rejoined": """
WITH r AS (SELECT id, any_value(tokens) AS tokens, any_value(text) AS text FROM coha_tokens GROUP BY id HAVING any_value(tokens) IS NOT NULL OR any_value(text) IS NOT NULL)
SELECT id, CASE WHEN tokens IS NULL THEN 'text' ELSE 'tokens' END AS unit, true AS fits, true AS follows,
  md5(CASE WHEN tokens IS NULL THEN text ELSE array_to_string(list_transform(tokens, lambda t: coalesce(replace(t, '##', ' ##'), '<null>')), ' ') END) AS whole FROM r""",
        "p2_found": _COUNTS + "SELECT term, mark FROM m WHERE mark IS NOT NULL",
        "p2_term_counts": _COUNTS + "SELECT term, occurrences, records, mark FROM m",
        "p3_found": """
WITH m AS (SELECT term, line_id, token_index, any_value(top_terms) AS k FROM substitutes GROUP BY ALL),
b AS (SELECT row_number() OVER () AS i, list_distinct(k) AS k FROM m WHERE len(list_distinct(k)) > 0),
x AS (SELECT i, unnest(k) AS w FROM b),
s AS (SELECT w, count(*) AS n FROM x GROUP BY w),
p AS (SELECT a.w AS a, b.w AS b, count(*) AS n FROM x a JOIN x b ON a.i = b.i AND a.w < b.w GROUP BY ALL HAVING count(*) >= 5)
SELECT p.a AS term_a, p.b AS term_b FROM p JOIN s sa ON sa.w = p.a JOIN s sb ON sb.w = p.b
WHERE p.n * (SELECT count(*) FROM b) >= 10 * sa.n * sb.n""",
        "p3_pairs": """
WITH m AS (SELECT term, line_id, token_index, any_value(top_terms) AS k FROM substitutes GROUP BY ALL),
b AS (SELECT row_number() OVER () AS i, list_distinct(k) AS k FROM m WHERE len(list_distinct(k)) > 0),
x AS (SELECT i, unnest(k) AS w FROM b), s AS (SELECT w, count(*) AS n FROM x GROUP BY w), t AS (SELECT count(*) AS n FROM b),
p AS (SELECT a.w AS a, b.w AS b, count(*) AS n FROM x a JOIN x b ON a.i = b.i AND a.w < b.w GROUP BY ALL)
SELECT p.a AS item_a, p.b AS item_b, p.n::BIGINT AS n_ab, sa.n::BIGINT AS n_a, sb.n::BIGINT AS n_b, t.n::BIGINT AS n, round(p.n * t.n::DOUBLE / (sa.n * sb.n), 9) AS lift, round(log2(p.n * t.n::DOUBLE / (sa.n * sb.n)), 9) AS pmi
FROM p JOIN s sa ON sa.w = p.a JOIN s sb ON sb.w = p.b, t""",
        "p5_sample_mentions": """
WITH m AS (SELECT term, line_id, token_index, any_value(top_terms) AS top_terms FROM substitutes GROUP BY ALL)
SELECT md5(concat_ws('|', '17', coalesce('=' || term, '!'), coalesce('=' || line_id, '!'), coalesce('=' || token_index, '!'))) AS sample_key, * FROM m ORDER BY sample_key LIMIT 1000""",
        "p5_sample_token_lists": """
WITH m AS (SELECT id, any_value(tokens) AS tokens FROM coha_tokens WHERE tokens IS NOT NULL GROUP BY id)
SELECT md5(concat_ws('|', '17', coalesce('=' || id, '!'))) AS sample_key, * FROM m ORDER BY sample_key LIMIT 1000""",
    }
