"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.llm import bpe, html, licenses, media, packing, simhash, substring, topk, toxicity, warc

#: The vocabulary file whose ids the queries return.
VOCABULARY = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    done = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), path), path)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(_table(spark, sf_dir, "pages"), least_bytes=0, payloads=False).drop("url")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("spans")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There is no table of images: pictures are drawn from all rows of ``embeddings``, with known edited copies among them."""
    return media.copies(media.media_table(_table(spark, sf_dir, "embeddings")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), width=4096, end=1)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantize(_table(spark, sf_dir, "embeddings"), scale=256)
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.deduplicate(_table(spark, sf_dir, "documents"), length=20)
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_bpe": op2_bpe,
        "op3_warc": op3_warc,
        "op4_licenses": op4_licenses,
        "op5_media": op5_media,
        "op6_toxicity": op6_toxicity,
        "op7_html": op7_html,
        "op8_packing": op8_packing,
        "op9_topk": op9_topk,
        "op10_substring": op10_substring,
    }


_OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(((CAST('0x' || substr(x, 5 * (i // 4) + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""

_OP4 = """
WITH t AS (SELECT * FROM (VALUES {templates}) AS v(gram, template, label, base, grams, place)),
d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 2], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d) AS u),
v AS (SELECT doc_id, template, label, base, grams, pos - place AS diagonal, count(*) AS votes, min(pos) AS lo, max(pos) AS hi FROM g JOIN t ON g.gram = t.gram GROUP BY ALL),
n AS (SELECT *, CASE WHEN base OR NOT coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= 2, FALSE) THEN 1 ELSE 0 END AS new FROM v),
c AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS cluster FROM n),
s AS (SELECT doc_id, template, label, base, grams, cluster, sum(votes) AS votes, min(lo) AS start FROM c GROUP BY ALL),
r AS (SELECT *, least(1.0, votes / CAST(grams AS DOUBLE)) AS share, CASE WHEN base THEN votes = grams ELSE votes / CAST(grams AS DOUBLE) >= 0.8 END AS good FROM s),
a AS (SELECT doc_id, count(CASE WHEN good AND base THEN 1 END) AS n_base, min(CASE WHEN good AND base THEN start END) AS first_word, max(CASE WHEN good AND base THEN start END) AS last_word,
    array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE good AND base))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE good))), ',') AS labels, max(CASE WHEN good THEN share END) AS score FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM d LEFT JOIN a ON d.doc_id = a.doc_id"""

_OP9 = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS "rank", vec_id, score FROM r WHERE k <= 5"""

_OP10 = """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w[i] AS word, i, CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i:i + 19], ' ') END AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) AS u),
f AS (SELECT *, CASE WHEN g IS NOT NULL AND row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 THEN 1 ELSE 0 END AS again FROM p),
c AS (SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id"""


def oracle_sql() -> dict[str, str]:
    grams = ", ".join(f"('{g}', {t}, '{label}', {base}, {n}, {at})" for g, t, label, base, n, at in licenses.gram_rows() if g)
    return {"op3_warc": _OP3, "op4_licenses": _OP4.format(templates=grams), "op9_topk": _OP9, "op10_substring": _OP10}
