"""Registered queries of the training-data operators, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_forest, bpe, chat_format, decontaminate, language_id, secret_scan, simhash, substring_dedup, suffix_dedup, token_output
from .common import shared_path

#: The vocabulary that the queries use; operators take any path.
VOCABULARY = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _span_text(name: str = "spans"):
    return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_repeated", "n_removed", "n_spans", _span_text())


def op2_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return ann_forest.nearest(rows, rows.where("vec_id % 20 = 0"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_strings(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", _span_text())


def op4_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat_format.perspectives(_table(spark, sf_dir, "conversations"), span=64)
    return found.withColumn("mask", chat_format.mask_text(F.col("mask")))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenized(_table(spark, sf_dir, "documents"), vocabulary_path())


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "shards")
    return token_output.materialised(_table(spark, sf_dir, "documents"), out, vocabulary_path(), end=50256)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", found.start_word.cast("bigint").alias("start_word"), found.n_words.cast("bigint").alias("n_words"), "similarity")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_hash_prefix_forest,
        op3_suffix_dedup,
        op4_chat_perspectives,
        op5_bpe,
        op6_training_order,
        op7_simhash_near_dedup,
        op8_decontamination,
        op9_language_id,
        op10_secret_scan,
        pipeline,
    )
}

#: Every window of an item's size that holds a shingle of it, compared by occurrences; no fingerprints.
DECONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT DISTINCT item_id, bw, len(bw) AS n, least(5, len(bw)) AS k FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS bw FROM benchmark WHERE item_id IS NOT NULL) WHERE len(bw) > 0),
ks AS (SELECT DISTINCT k FROM b),
ds AS (SELECT DISTINCT doc_id, w, k, unnest(range(greatest(0, len(w) - k + 1))) AS pos FROM d, ks),
dt AS (SELECT doc_id, w, k, pos, array_to_string(w[pos + 1 : pos + k], ' ') AS s FROM ds),
bs AS (SELECT item_id, bw, n, k, array_to_string(bw[j + 1 : j + k], ' ') AS s FROM (SELECT *, unnest(range(n - k + 1)) AS j FROM b)),
bc AS (SELECT item_id, bw, n, k, s, count(*) AS c FROM bs GROUP BY ALL),
hit AS (SELECT doc_id, w, item_id, bw, n, k, pos, s, c FROM dt JOIN bc USING (k, s)),
st AS (SELECT DISTINCT doc_id, w, item_id, bw, n, k, unnest(range(greatest(0, pos + k - n), least(pos, greatest(0, len(w) - n)) + 1)) AS st FROM hit),
a AS (SELECT st.doc_id, st.w, st.item_id, st.bw, st.n, st.k, st.st, hit.s, hit.c, count(*) AS x FROM st JOIN hit ON st.doc_id = hit.doc_id AND st.w = hit.w AND st.item_id = hit.item_id AND st.bw = hit.bw AND hit.pos BETWEEN st.st AND st.st + st.n - st.k GROUP BY ALL),
r AS (SELECT doc_id, item_id, n, st, sum(least(x, c))::DOUBLE AS lo, ((least(n, len(w)) - k + 1) + (n - k + 1))::DOUBLE AS t FROM a GROUP BY doc_id, w, item_id, bw, n, k, st),
q AS (SELECT doc_id, item_id, n, st, lo / (t - lo) AS similarity FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, st) AS rn FROM q WHERE similarity >= 0.8)
SELECT doc_id, item_id, st::BIGINT AS start_word, n::BIGINT AS n_words, similarity FROM k WHERE rn = 1
"""

PERSPECTIVE_SQL = r"""
WITH own AS (SELECT conv_id, floor(turn / 64)::BIGINT AS part, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
sp AS (SELECT DISTINCT conv_id AS c, role AS speaker FROM own WHERE role <> 'system'),
seg AS (SELECT conv_id, speaker, part, turn, role, text, '<|im_start|>' || CASE WHEN role = 'system' THEN role WHEN role = speaker THEN 'assistant' ELSE 'user name=' || role END || chr(10) AS head, text || '<|im_end|>' AS body, role = speaker AS own FROM own JOIN sp ON conv_id IS NOT DISTINCT FROM c),
pos AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker, part ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM seg)
SELECT conv_id, speaker, part, count(*) AS n_messages, string_agg(head || body || chr(10), '' ORDER BY turn, role, text) AS rendered,
coalesce(string_agg((o + length(head))::VARCHAR || ':' || (o + length(head) + length(body))::VARCHAR, ',' ORDER BY turn, role, text) FILTER (own), '') AS mask
FROM pos GROUP BY conv_id, speaker, part
"""

ORACLE: dict[str, str] = {"op4_chat_perspectives": PERSPECTIVE_SQL, "op8_decontamination": DECONTAMINATION_SQL}
