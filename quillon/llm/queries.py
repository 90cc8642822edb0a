"""The thin queries over the tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, hilbert_ann, langid, minhash, mixing, packing, pii, substring_dedup, toxicity, warc_fixity
from ._common import crc_fold, materialise, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = exact_dedup.annotate(*exact_dedup.halves(docs))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_fold("doc_id", 3) == 1
    out = langid.predict(docs, langid.fit(docs, ~held))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of an archive of `pages` with its digest and, against a replica with known damage, its status."""
    records = materialise(warc_fixity.lay_out(table(spark, sf_dir, "pages")))
    found = warc_fixity.audit(records, warc_fixity.damage(records))
    extra = found.where(F.col("status") == "extra").select("file", (F.col("offset") - 1).alias("offset"), F.lit(True).alias("twice"))
    odd = found.where(F.col("status") != "extra")
    out = records.join(odd, ["file", "offset"], "left").join(extra, ["file", "offset"], "left")
    status = F.coalesce("status", F.when(F.col("twice"), "extra copy"), F.lit("intact"))
    return out.select(F.col("record_id").alias("page_id"), "file", "offset", "length", "sha256", status.alias("status"))


def op5_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), width=20, with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("intervals").alias("n_intervals"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_fold("doc_id", 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held)
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", "abuse", "misspelled", "quoted")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.annotate(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_minhash, op3_langid, op4_warc_fixity, op5_hilbert_ann, op6_substring_dedup, op7_toxicity, op8_pii, op9_packing, op10_mixing)}


OP1 = r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""

OP4 = r"""
WITH r AS (
  SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
         || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec
  FROM pages
), s AS (
  SELECT page_id, CAST(strlen(rec) AS BIGINT) AS length, sha256(rec) AS sha256 FROM r
), f AS (
  SELECT *, CAST(('0x' || substr(sha256(coalesce(CAST(page_id AS VARCHAR), '-') || '|' || sha256), 1, 8)) AS BIGINT) % CAST(greatest(1, ceil((SELECT count(*) FROM s) / 512.0)) AS BIGINT) AS file FROM s
)
SELECT page_id, file, CAST(sum(length) OVER (PARTITION BY file ORDER BY page_id NULLS FIRST, sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length AS BIGINT) AS "offset",
       length, sha256, CASE substr(sha256, 1, 2) WHEN '07' THEN 'missing' WHEN '2a' THEN 'corrupt' WHEN 'c3' THEN 'extra copy' ELSE 'intact' END AS status
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1, "op4_warc_fixity": OP4, "op10_mixing": mixing.ORACLE}
