"""Routing: which way each segment goes, first condition that holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import qa
from quillon.functions import text as T


def match_type(text: Column, letters: Column, tm_target: Column, gl_target: Column, page: Column) -> Column:
    """skipped, rule, passthrough, exact, glossary, or null where a model must decide (fuzzy or llm)."""
    return (
        F.when(text.startswith(T.OCR_STUB), "skipped")
        .when(page.isNotNull(), "rule")
        .when(~letters.rlike("[A-Za-z]"), "passthrough")
        .when(tm_target.isNotNull(), "exact")
        .when(gl_target.isNotNull(), "glossary")
        .when(F.regexp_replace(text, r"(?U)^\s+|\s+$", "").rlike(r"^[A-Z]\.?$"), "passthrough")
    )


def route(segments: DataFrame, target_language: str = "ru", protected: tuple[str, ...] = ()) -> DataFrame:
    """segments (text, tm_target, gl_target) with masked, toks, match_type and the target of all routes but the model's."""
    m = segments.withColumn("_m", T.mask(F.col("text"), protected))
    m = m.withColumn("masked", F.col("_m.masked")).withColumn("toks", F.col("_m.toks")).drop("_m")
    page = T.page_rule(F.col("text")) if target_language == "ru" else F.lit(None).cast("string")
    m = m.withColumn("match_type", match_type(F.col("text"), T.blank_tokens(F.col("masked")), F.col("tm_target"), F.col("gl_target"), page))
    target = (
        F.when(F.col("match_type") == "skipped", "").when(F.col("match_type") == "rule", page).when(F.col("match_type") == "passthrough", F.col("text"))
        .when(F.col("match_type") == "exact", F.col("tm_target")).when(F.col("match_type") == "glossary", F.col("gl_target"))
    )
    return m.withColumn("translated_text", target)


def route_issues(routed: DataFrame) -> Column:
    """What routing itself finds wrong: a page that could not be read was not translated."""
    return qa.when(routed["match_type"] == "skipped", "ocr_not_available", qa.CRITICAL, F.concat(F.lit("scanned page was not translated: "), routed["text"]))


def model_type(has_examples: Column) -> Column:
    return F.when(has_examples, "fuzzy").otherwise("llm")


def supported_file(path: Column) -> Column:
    return path.rlike(r"(?i)\.(?:pdf|docx)$")


# Names of the target languages.
LANGUAGES = {"ru": "Russian", "kk": "Kazakh", "en": "English", "de": "German", "fr": "French", "es": "Spanish"}


def language_name(code: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[code], code)
