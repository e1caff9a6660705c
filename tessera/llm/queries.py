"""The queries on training data: name -> (spark, folder of the tables) -> DataFrame, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import docpairs, mixing, neardup, neighbours, parsing, secrets, spans, splitting, tokens
from tessera.session import table

PATTERN_FIELDS = ("before_code", "after_code", "migration_type")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    member, pairs = neardup.near_duplicates(table(spark, d, "migration_patterns"), "pattern_id", PATTERN_FIELDS)
    return neardup.all_pairs(member, pairs).toDF("pattern_a", "pattern_b")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    patterns = table(spark, d, "migration_patterns")
    member, pairs = neardup.near_duplicates(patterns, "pattern_id", PATTERN_FIELDS)
    return neardup.groups(member, pairs, patterns.select(F.col("pattern_id").alias("id"))).withColumnRenamed("id", "pattern_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.found(table(spark, d, "doc_chunks"), table(spark, d, "code_chunks"))


def p2_doc_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.doc_pieces(table(spark, d, "doc_chunks"))


def p2_joined(spark: SparkSession, d: str) -> DataFrame:
    """The contents put together again from their pieces, as a digest of all that is not blank."""
    return splitting.joined(table(spark, d, "doc_chunks"), table(spark, d, "code_chunks")).select("tab", "rec_id", F.md5("solid").alias("digest"), "within")


def p2_code_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.code_pieces(table(spark, d, "code_chunks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.pairs(neighbours.nearest(table(spark, d, "migration_patterns"), "pattern_id", "embedded_signature")).toDF("pattern_a", "pattern_b")


def p3_nearest(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(table(spark, d, "migration_patterns"), "pattern_id", "embedded_signature").withColumnRenamed("id", "pattern_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return parsing.found(table(spark, d, "code_chunks"), table(spark, d, "migration_patterns"), table(spark, d, "frameworks"))


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return parsing.rates(parsing.files(table(spark, d, "code_chunks")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "code_chunks")
    return docpairs.found(chunks, parsing.files(chunks))


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "code_chunks")
    return docpairs.pairs(chunks, parsing.files(chunks))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.found(table(spark, d, "code_chunks"))


def p6_places(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "code_chunks")
    return secrets.places(chunks).withColumnRenamed("id", "chunk_id")


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.redacted(table(spark, d, "code_chunks").select("chunk_id", "file_path", "content"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p7_text(spark: SparkSession, d: str) -> DataFrame:
    """Encoded and decoded again."""
    return tokens.decode_corpus(tokens.encode_corpus(table(spark, d, "documents")))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents")).select("doc_id", F.col("start").cast("bigint").alias("start_char"), F.col("length").cast("bigint").alias("len_chars"))


def p9_coverage(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return spans.coverage(documents, spans.shared_spans(documents))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_joined, p2_doc_pieces, p2_code_pieces, p3_found, p3_nearest, p4_found, p4_rates, p5_found, p5_pairs, p6_found, p6_places, p6_redacted, p7_ids, p7_text, p8_mix, p8_shares, p9_found, p9_coverage)}

SQL: dict[str, str] = {
    "p2_found": r"""
        SELECT 'doc_chunks' AS tab, doc_chunk_id AS rec_id,
               CASE WHEN list_max(list_transform(string_split_regex(content, '[ \t\r\n]'), lambda x: length(x))) > 1000 THEN 'forced' ELSE 'natural' END AS cut
        FROM doc_chunks WHERE length(content) > 1000
        UNION ALL
        SELECT 'code_chunks', chunk_id,
               CASE WHEN list_max(list_transform(string_split(content, chr(10)), lambda x: length(regexp_replace(x, '[ \t\r]', '', 'g')))) > 1200 THEN 'forced' ELSE 'natural' END
        FROM code_chunks WHERE length(regexp_replace(content, '[ \t\r\n]', '', 'g')) > 1200""",
    "p7_text": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
SQL["p1_found"] = r"""
    WITH w AS (SELECT pattern_id AS id, list_distinct(list_transform(regexp_extract_all(concat_ws(chr(10), before_code, after_code, migration_type), '[A-Za-z0-9_]+'), lambda x: lower(x))) AS words FROM migration_patterns),
         t AS (SELECT id, len(words) AS n, unnest(words) AS word FROM w),
         c AS (SELECT a.id AS pattern_a, b.id AS pattern_b, a.n + b.n AS both_n, count(*) AS common FROM t a JOIN t b ON a.word = b.word AND a.id < b.id GROUP BY ALL)
    SELECT pattern_a, pattern_b FROM c WHERE common >= 0.8 * (both_n - common)"""

SQL["p1_groups"] = r"""
    WITH RECURSIVE w AS (SELECT pattern_id AS id, list_sort(list_distinct(list_transform(regexp_extract_all(concat_ws(chr(10), before_code, after_code, migration_type), '[A-Za-z0-9_]+'), lambda x: lower(x)))) AS words FROM migration_patterns),
         m AS (SELECT id, words, CASE WHEN len(words) = 0 THEN id ELSE min(id) OVER (PARTITION BY words) END AS class_id FROM w),
         t AS (SELECT id, len(words) AS n, unnest(words) AS word FROM m WHERE id = class_id),
         l AS (SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.word = b.word AND a.id <> b.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))),
         r AS (SELECT DISTINCT class_id AS node, class_id AS other FROM m UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.other),
         g AS (SELECT node, min(other) AS group_id FROM r GROUP BY node), k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
    SELECT m.id AS pattern_id, m.class_id, g.group_id, coalesce(k.n, 0) AS n_links FROM m JOIN g ON g.node = m.class_id LEFT JOIN k ON k.a = m.class_id"""
SQL["p2_joined"] = r"""
    SELECT 'doc_chunks' AS tab, doc_chunk_id AS rec_id, md5(regexp_replace(coalesce(content, ''), '[ \t\r\n]', '', 'g')) AS digest, true AS within FROM doc_chunks
    UNION ALL SELECT 'code_chunks', chunk_id, md5(regexp_replace(coalesce(content, ''), '[ \t\r\n]', '', 'g')), true FROM code_chunks"""
_SPANS = """d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 200), p AS (SELECT doc_id, i - 1 AS s, md5(text[i:i + 199]) AS h FROM (SELECT doc_id, text, unnest(range(1, n - 198)) AS i FROM d)),
    c AS (SELECT h FROM p GROUP BY h HAVING min(doc_id) <> max(doc_id)), o AS (SELECT DISTINCT doc_id, s FROM p SEMI JOIN c USING (h)),
    f AS (SELECT *, CASE WHEN s - lag(s) OVER w <= 200 THEN 0 ELSE 1 END AS fresh FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY s)), k AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM f),
    spans AS (SELECT doc_id, min(s) AS start_char, max(s) + 200 - min(s) AS len_chars FROM k GROUP BY doc_id, island)"""
SQL["p9_found"] = f"WITH {_SPANS} SELECT doc_id, start_char, len_chars FROM spans"
SQL["p9_coverage"] = f"""WITH {_SPANS}, g AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(len_chars) AS BIGINT) AS shared_chars FROM spans GROUP BY doc_id)
    SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(n_spans, 0) AS n_spans, coalesce(shared_chars, 0) AS shared_chars,
        CASE WHEN length(text) > 0 THEN round(coalesce(shared_chars, 0) / length(text), 6) ELSE 0.0 END AS share FROM documents LEFT JOIN g USING (doc_id)"""
