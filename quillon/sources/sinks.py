"""What a run leaves behind: reports, the call log, score tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import verify

from . import readers


def reports(results: DataFrame, summary: DataFrame) -> DataFrame:
    """doc_id, summary, segments: a report for each document, its scored segments in order. What a row holds is bounded by its document."""
    own = ["seq", "location", F.col("text").alias("source"), F.col("translated_text").alias("translation"), *[c for c in (*verify.WEIGHTS, "confidence", "verdict", "issues") if c in results.columns]]
    rows = results.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*own))).alias("segments"))
    told = summary.select("doc_id", F.struct(*[c for c in summary.columns if c != "doc_id"]).alias("summary"))
    return told.join(rows, "doc_id").select("doc_id", "summary", "segments")


def save_reports(found: DataFrame, path: str) -> None:
    """Reports as JSON, one a line."""
    found.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_log(calls: DataFrame, path: str, location: Column | None = None) -> None:
    """Calls added to the log: timestamp, location, attempt (the corrective call of a repair by name), model, prompt, response, error, tokens."""
    place = location if location is not None else F.lit(None).cast("string")
    attempt = F.when(F.col("attempt") > 4, "repair").otherwise(F.col("attempt").cast("string"))
    rows = calls.select(F.current_timestamp().alias("timestamp"), place.alias("location"), attempt.alias("attempt"), "model", "prompt", F.col("reply").alias("response"), "error", "input_tokens", "output_tokens")
    rows.write.mode("append").parquet(path)


def save_scores(scores: DataFrame, root: str, run: str) -> str:
    """The score cache as a new version of its table: it replaces the old one as a whole."""
    return readers.swap_table(scores.drop("text", "translated_text").dropDuplicates(["digest"]), root, run)


def inside(root: str, path: str) -> bool:
    """Whether a path, its links and dots resolved, is the root or lies below it. For the driver's own files only."""
    top, own = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    return os.path.commonpath([top, own]) == top
