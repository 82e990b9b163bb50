"""Registered queries of the corpus operators, and DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.llm import decontaminate, hmm, html_text, jaccard, langid, packing, prefix_forest, quality, unigram, warc
from tracklens.llm.common import batch_rows, fold, table

#: Rows of an Arrow batch of whole texts.
TEXT_ROWS = 500


def op1_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch_rows(spark, TEXT_ROWS)
    docs = table(spark, sf_dir, "documents")
    return hmm.score(docs, fold(docs.doc_id, 7) == 2)


def op2_cnn_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch_rows(spark, TEXT_ROWS)
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, fold(docs.doc_id, 5) == 0)


def op3_lsa_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch_rows(spark, TEXT_ROWS)
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_rtree_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op6_qda_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch_rows(spark, TEXT_ROWS)
    docs = table(spark, sf_dir, "documents")
    return quality.assess(docs, table(spark, sf_dir, "labels"), fold(docs.doc_id, 5) == 0)


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_and_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch_rows(spark, TEXT_ROWS)
    return unigram.token_counts(table(spark, sf_dir, "documents"))


def op8_template_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch_rows(spark, TEXT_ROWS)
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_kk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch_rows(spark, TEXT_ROWS)
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch_rows(spark, 10_000)
    vectors = table(spark, sf_dir, "embeddings")
    return prefix_forest.search(vectors, F.col("vec_id") % 20 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hmm_lm, op2_cnn_langid, op3_lsa_decontamination, op4_warc_index, op5_rtree_jaccard, op6_qda_quality, op7_unigram_counts, op8_template_html, op9_kk_packing, op10_prefix_forest)}


_BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(sha1(payload), CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '')"""

OP4_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < newest THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < newest THEN newest END AS refers_to FROM m"""


OP5_SQL = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, CAST(greatest(len(ws) - 4, 1) AS BIGINT) + 1)) AS j FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[j:j + 4], ' ') AS shingle FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.least, w.doc_id)) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_index": OP4_SQL, "op5_rtree_jaccard": OP5_SQL}
