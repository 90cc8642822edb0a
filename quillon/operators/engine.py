"""The model port and the passes around it.

A provider is a function from a pandas frame of prompts to one of replies; it runs inside mapInPandas. Every pass is written out
before the next one reads it: a plan that Spark evaluates twice must not call a model twice."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import qa
from quillon.functions import text as T

from .provider import FATAL

ATTEMPTS, FALLBACK_AT = 4, 4
Provider = Callable[[pd.DataFrame], pd.DataFrame]


class Stopped(RuntimeError):
    """A provider's error that no further call can cure. What was accepted before it is in `done`, all calls in `log`."""

    def __init__(self, message: str, done: DataFrame | None, log: DataFrame):
        super().__init__(message)
        self.done, self.log = done, log


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. On one machine without it a temporary one will do; on a cluster its absence is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def store(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again."""
    spark: SparkSession = df.sparkSession
    root = shared_dir(spark)
    path = f"{root.rstrip('/')}/quillon/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def language_line(language: Column) -> Column:
    return F.concat(F.lit("Translate into "), language, F.lit(". Keep every [[Pn]] token."))


def build_prompt(language: Column, masked: Column, terms: Column, examples: Column, note: Column, minimal: Column) -> Column:
    """Instruction, terms, examples, corrective note and text; the minimal form leaves all but the text out."""
    part = lambda head, c: F.when((F.coalesce(c, F.lit("")) != "") & ~minimal, F.concat(F.lit(head), c))
    return F.concat_ws("\n", language_line(language), part("Terms: ", terms), part("Examples: ", examples), F.when(F.coalesce(note, F.lit("")) != "", F.concat(F.lit("Note: "), note)), F.concat(F.lit("Text: "), masked))


def call(prompts: DataFrame, provider: Provider, workers: int) -> DataFrame:
    """prompts (id, attempt, prompt, model) with reply and error; at most `workers` calls run at once. An error is a row."""

    def run(batches):
        for pdf in batches:
            yield provider(pdf)[["id", "attempt", "prompt", "model", "reply", "error", "input_tokens", "output_tokens"]]

    return prompts.select("id", "attempt", "prompt", "model").repartition(workers).mapInPandas(run, "id long, attempt int, prompt string, model string, reply string, error string, input_tokens int, output_tokens int")


def judge(rows: DataFrame) -> DataFrame:
    """Restored text, QA, and whether the reply is hard bad (runaway, stray Chinese, critical) or soft bad (English left, romanised, moderate)."""
    r = rows.withColumn("_u", T.unmask(F.col("reply"), F.col("toks")))
    r = r.withColumn("final", F.col("_u.text")).withColumn("missing", F.col("_u.missing")).drop("_u")
    r = r.withColumn("qa_issues", qa.run_checks(F.col("text"), F.col("final"), F.col("missing"), F.col("terms"), F.col("toks")))
    runaway = F.length("reply") > 6 * F.length("masked") + 200
    stray = F.col("reply").rlike(f"[{T.CJK}]")
    left = F.filter(T.latin_leftovers(F.col("final"), F.col("toks"), qa.whitelist()), lambda w: ~T.all_upper(w))
    words = F.filter(F.regexp_extract_all(T.blank_tokens(F.col("masked")), F.lit("[A-Za-z]{3,}"), F.lit(0)), lambda w: ~T.all_upper(w))
    romanised = (F.size(words) >= 2) & (T.cyrillic_ratio(F.col("final")) < 0.15)
    bare = F.regexp_replace("reply", r"\[\[P\d+\]\]|[\x{3400}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]", "")
    return (
        r.withColumn("hard_bad", runaway | stray | qa.has_severity(F.col("qa_issues"), qa.CRITICAL))
        .withColumn("soft_bad", (F.size(left) > 0) | romanised | qa.has_severity(F.col("qa_issues"), qa.MODERATE))
        .withColumn("repairable", stray & (T.cyrillic_ratio(bare) > 0.6)).withColumn("left", F.array_join(F.slice(left, 1, 6), ", "))
    )


def retry_ladder(todo: DataFrame, provider: Provider, language: str = "Russian", model: str = "main", fallback: str | None = None, workers: int = 8) -> tuple[DataFrame, DataFrame]:
    """(results, call log) of distinct texts (id, text, masked, toks, terms, examples), in at most four passes over what is still pending.

    1 normal; 2 with the reason; 3 minimal; 4 the fallback model, as a repair of a mostly translated draft. A clean reply is accepted at
    once; one that is only soft bad is tried again and accepted as the fourth; a hard bad one stops after 3 where there is no fallback. Calls that
    fail are tried again; a failed fourth gives a critical row."""
    pending = store(todo.withColumn("note", F.lit("")).withColumn("draft", F.lit(None).cast("string")))
    done, log = None, None
    for attempt in range(1, ATTEMPTS + 1):
        name = fallback if attempt == FALLBACK_AT and fallback else model
        note = F.when(F.col("draft").isNotNull() & F.lit(attempt == FALLBACK_AT), F.concat(F.lit("Repair this draft: "), F.col("draft"))).otherwise(F.col("note"))
        terms = F.array_join(F.transform("terms", lambda t: F.concat(t["en_term"], F.lit(" = "), t["target_term"])), "; ")
        prompts = pending.select("id", F.lit(attempt).alias("attempt"), build_prompt(F.lit(language), F.col("masked"), terms, F.col("examples"), note, F.lit(attempt == 3)).alias("prompt"), F.lit(name).alias("model"))
        replies = store(call(prompts, provider, workers))
        log = replies if log is None else log.unionByName(replies)
        fatal = replies.where(F.col("error").startswith(FATAL)).select("error").first()
        if fatal:
            raise Stopped(fatal["error"], done, log)
        seen = judge(pending.join(replies.select("id", "reply", "error"), "id"))
        failed = F.col("error").isNotNull()
        clean = ~F.col("hard_bad") & ~F.col("soft_bad")
        stop = F.lit(attempt == ATTEMPTS) | (~failed & (clean | (F.lit(attempt == 3 and not fallback) & F.col("hard_bad"))))
        seen = store(seen.withColumn("stop", F.coalesce(stop, F.lit(attempt == ATTEMPTS))).withColumn("attempts", F.lit(attempt)))
        issues = F.when(failed, qa.when(F.lit(True), "api_error", qa.CRITICAL, F.col("error"))).otherwise(F.col("qa_issues"))
        out = seen.where("stop").select("id", "text", F.when(failed, "").otherwise(F.col("final")).alias("translated_text"), F.when(failed, "llm").otherwise(F.when(F.coalesce("examples", F.lit("")) != "", "fuzzy").otherwise("llm")).alias("match_type"), issues.alias("qa_issues"), "attempts")
        done = out if done is None else done.unionByName(out)
        why = F.when(failed, F.col("note")).when(~F.col("hard_bad"), F.concat(F.lit("English or Latin letters were left: "), F.col("left"))).otherwise(F.lit("tokens were lost or invented"))
        pending = store(seen.where("not stop").select(*[c for c in todo.columns], why.alias("note"), F.when(F.col("repairable"), F.col("reply")).alias("draft")))
        if pending.isEmpty():
            break
    return done, log


def redo(todo: DataFrame, provider: Provider, language: str = "Russian", model: str = "main", workers: int = 8) -> tuple[DataFrame, DataFrame]:
    """(drafts, call log): one corrective call for each pair (id, text, translated_text, masked, toks, terms, findings); calls that fail give no draft.

    A draft is text, translated_text (the old one), new_text, new_qa, new_critical and the pair's other columns."""
    terms = F.array_join(F.transform("terms", lambda t: F.concat(t["en_term"], F.lit(" = "), t["target_term"])), "; ")
    note = F.concat(F.lit("A reviewer found in an earlier translation: "), F.col("findings"), F.lit(" Correct that, change nothing that was right, and translate errors of the source as they stand."))
    prompt = build_prompt(F.lit(language), F.col("masked"), terms, F.lit(""), note, F.lit(False))
    replies = store(call(todo.select("id", F.lit(ATTEMPTS + 1).alias("attempt"), prompt.alias("prompt"), F.lit(model).alias("model")), provider, workers))
    d = todo.join(replies.where("error is null").select("id", "reply"), "id").withColumn("_u", T.unmask(F.col("reply"), F.col("toks")))
    d = d.withColumn("new_text", F.col("_u.text")).withColumn("new_qa", qa.run_checks(F.col("text"), F.col("_u.text"), F.col("_u.missing"), F.col("terms"), F.col("toks")))
    return store(d.withColumn("new_critical", qa.has_severity(F.col("new_qa"), qa.CRITICAL)).drop("_u", "reply")), replies


def token_usage(log: DataFrame) -> DataFrame:
    return log.groupBy("model", "attempt").agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def fan_out(segments: DataFrame, results: DataFrame, key_col: str = "key") -> DataFrame:
    """Each segment with its canonical text's result, in its own capitals."""
    r = results.select(F.col(key_col), F.col("text").alias("canon"), F.col("translated_text").alias("_t"), "match_type", "qa_issues")
    return segments.join(r, key_col).withColumn("translated_text", T.match_case(F.col("text"), F.col("canon"), F.col("_t"))).drop("_t")


def first_ocr_of_page(results: DataFrame) -> DataFrame:
    """The first OCR row of each page gets an issue; a page's first row comes from an aggregate, not a window over all rows."""
    first = results.where("from_ocr").groupBy("doc_id", "page").agg(F.min("seq").alias("seq")).withColumn("_f", F.lit(True))
    j = results.join(first, ["doc_id", "page", "seq"], "left")
    return j.withColumn("qa_issues", F.concat("qa_issues", qa.when(F.col("_f"), "ocr_replica_review", qa.MODERATE, "check the scanned page"))).drop("_f")


def progress_marks(rows: DataFrame, every: int = 25) -> DataFrame:
    last = rows.groupBy("doc_id").agg(F.max("seq").alias("last"))
    return rows.join(last, "doc_id").where((F.col("seq") % every == 0) | (F.col("seq") == F.col("last"))).drop("last")
