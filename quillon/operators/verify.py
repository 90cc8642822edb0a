"""Scoring: batches for the second model, its replies, confidence, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import qa
from quillon.functions import text as T

from .engine import call, store
from .provider import FATAL

# Dimensions and their weights, and bounds of the score.
WEIGHTS = {"meaning": 0.40, "completeness": 0.25, "terminology": 0.15, "grammar": 0.20}
OVER_WEAKEST, THRESHOLD, WATCH_BELOW = 25, 85, 95
BATCH_ITEMS, BATCH_CHARS = 15, 6000
SKIPPED = ("passthrough", "rule", "skipped", "exact")


def wants_score(protected: tuple[str, ...] = ()) -> Column:
    """Whether a second model has to score a result: it has letters of its own and a model or the glossary gave it."""
    letters = T.blank_tokens(T.mask(F.col("text"), protected)["masked"])
    return (F.col("translated_text") != "") & ~F.col("match_type").isin(*SKIPPED) & ~qa.has_rule(F.col("qa_issues"), "api_error") & letters.rlike("[A-Za-z]")


def to_verify(results: DataFrame, protected: tuple[str, ...] = ()) -> DataFrame:
    return results.where(wants_score(protected))


def pack_batches(pairs: DataFrame, group_col: str, order_col: str, size: Column, max_items: int = BATCH_ITEMS, max_chars: int = BATCH_CHARS) -> DataFrame:
    """pairs with batch (from 0): greedy in order; a batch ends before the item that would be one too many or exceed the characters.

    A fold over the ordered sizes of a group (one document): what is held is a size for each item, not its text."""
    keyed = pairs.withColumn("_size", size)
    items = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col("_size").cast("long").alias("z"))))

    def step(acc, x):
        full = (acc["n"] > 0) & ((acc["n"] >= max_items) | (acc["z"] + x["z"] > max_chars))
        b = F.when(full, acc["b"] + 1).otherwise(acc["b"])
        state = {"b": b, "n": F.when(full, F.lit(1)).otherwise(acc["n"] + 1), "z": F.when(full, x["z"]).otherwise(acc["z"] + x["z"])}
        return state, F.struct(x["o"].cast("long").alias("o"), b.alias("b"))

    start = {"b": F.lit(0), "n": F.lit(0), "z": F.lit(0).cast("long")}
    plan = keyed.groupBy(group_col).agg(items.alias("_i")).select(group_col, F.explode(T.scan(F.col("_i"), start, step, "struct<o:bigint,b:int>")).alias("_p"))
    plan = plan.select(group_col, F.col("_p.o").alias(order_col), F.col("_p.b").alias("batch"))
    return keyed.drop("_size").join(plan, [group_col, order_col])


def score(value: Column) -> Column:
    """A stated score: half-even, within 0 and 100, null if it is no number."""
    x = F.bround(value.try_cast("double"))
    return F.when(x.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), x.cast("int"))))


def confidence(scores: dict[str, Column], stated: Column) -> Column:
    """The weighted mean, no higher than what was stated and little above the weakest score; half-even. Hundredths are summed as whole numbers: a sum of doubles misses ties."""
    first, *others = [F.lit(round(100 * w)) * scores[d] for d, w in WEIGHTS.items()]
    mean = sum(others, first) / 100
    weakest = F.least(*scores.values()) + OVER_WEAKEST
    return F.bround(F.least(mean, F.coalesce(stated.cast("double"), mean), weakest.cast("double"))).cast("int")


REPLY = "results array<struct<id:string,meaning:string,completeness:string,terminology:string,grammar:string,confidence:string,verdict:string,issues:string>>"


def parse_replies(replies: DataFrame) -> DataFrame:
    """replies (batch_id, n_items, raw) to batch_id, item and the record: fences and text around the JSON don't matter; items with an
    id out of range or a dimension without a score are absent; of an item scored twice the last counts."""
    bare = F.regexp_replace(F.regexp_replace("raw", r"(?U)^\s+|\s+$", ""), r"(?m)^```(?:json)?|```$", "")
    start = F.instr(bare, "{")
    body = F.when(start > 0, F.regexp_extract(bare, r"(?s)(\{.*\})", 1))
    rows = replies.select("batch_id", "n_items", F.from_json(body, REPLY)["results"].alias("_r")).select("batch_id", "n_items", F.posexplode("_r").alias("_at", "_x"))
    dims = {d: score(F.col(f"_x.{d}")) for d in WEIGHTS}
    item = F.col("_x.id").try_cast("int")
    ok = item.between(1, F.col("n_items"))
    for c in dims.values():
        ok = ok & c.isNotNull()
    verdict = F.lower(F.coalesce(F.col("_x.verdict"), F.lit("")))
    rec = F.struct(
        *[c.alias(d) for d, c in dims.items()], confidence(dims, score(F.col("_x.confidence"))).alias("confidence"),
        F.when(verdict.isin("ok", "minor", "major"), verdict).otherwise("minor").alias("verdict"), F.left(F.trim(F.coalesce(F.col("_x.issues"), F.lit(""))), F.lit(400)).alias("issues"),
    )
    scored = rows.where(ok).select("batch_id", item.alias("item"), "_at", rec.alias("rec"))
    return scored.groupBy("batch_id", "item").agg(F.max_by("rec", "_at").alias("rec")).select("batch_id", "item", "rec.*")


RUBRIC = "Score each translation into {language} from 0 to 100 for " + ", ".join(WEIGHTS) + '. Answer with JSON: {{"results": [{{"id", ' + ", ".join(f'"{d}"' for d in WEIGHTS) + ', "confidence", "verdict": ok, minor or major, "issues"}}]}}, each id once.'


def pair_digest(model: str, language: str) -> Column:
    """What a score depends on: rubric, model, both texts, required terms."""
    return F.sha2(F.to_json(F.struct(F.lit(RUBRIC.format(language=language)).alias("r"), F.lit(model).alias("m"), F.col("text").alias("s"), F.col("translated_text").alias("t"), F.coalesce("terms_line", F.lit("")).alias("g"))).cast("binary"), 256)


def verify_prompt(items: Column, language: str) -> Column:
    """The rubric, then each item (item, text, translated_text, terms_line) under its number, Word markers blanked."""
    bare = lambda c: F.regexp_replace(c, "⟦[0-9tb]+⟧", " ")
    told = lambda x: F.concat(F.lit("\n### "), x["item"].cast("string"), F.lit("\nSource: "), bare(x["text"]), F.lit("\nTranslation: "), bare(x["translated_text"]), F.when(F.coalesce(x["terms_line"], F.lit("")) != "", F.concat(F.lit("\nRequired terms: "), x["terms_line"])).otherwise(""))
    return F.concat(F.lit(RUBRIC.format(language=language)), F.array_join(F.transform(items, told), ""))


def score_pairs(pairs: DataFrame, provider, cache: DataFrame | None = None, language: str = "Russian", model: str = "verifier", workers: int = 8, max_items: int = BATCH_ITEMS, max_chars: int = BATCH_CHARS) -> tuple[DataFrame, DataFrame, str | None]:
    """(scores, call log, what stopped it) of distinct pairs (text, translated_text, terms_line); scores carry the pair's digest for the cache.

    Pairs that the cache has scored cost nothing. The others go out in batches; what a reply leaves out is asked for once more, numbered anew. A fatal error
    leaves the rest without a score. Batches are packed within shares of the pairs, dealt by digest, so no task holds them all."""
    keyed = store(pairs.withColumn("digest", pair_digest(model, language)))
    record = ["digest", *WEIGHTS, "confidence", "verdict", "issues"]
    have = keyed.join(cache.select(*record), "digest") if cache is not None else None
    todo = keyed.join(cache.select("digest"), "digest", "left_anti") if cache is not None else keyed
    share = max(1, -(-todo.count() // 5000))
    dealt = todo.withColumn("share", F.pmod(F.xxhash64("digest"), F.lit(share))).withColumn("ord", F.row_number().over(Window.partitionBy("share").orderBy("digest")))
    packed = pack_batches(dealt, "share", "ord", F.length("text") + F.length("translated_text"), max_items, max_chars)
    asked = store(packed.withColumn("batch_id", F.col("share") * 100_000 + F.col("batch")).withColumn("item", F.row_number().over(Window.partitionBy("batch_id").orderBy("ord"))).drop("share", "batch", "ord"))
    stopped, log, found = None, None, None
    for attempt in (1, 2):
        items = F.array_sort(F.collect_list(F.struct("item", "text", "translated_text", "terms_line")))
        prompts = asked.groupBy(F.col("batch_id").alias("id")).agg(items.alias("i"), F.count(F.lit(1)).cast("int").alias("n"))
        replies = store(call(prompts.select("id", F.lit(attempt).alias("attempt"), verify_prompt(F.col("i"), language).alias("prompt"), F.lit(model).alias("model")), provider, workers))
        log = replies if log is None else log.unionByName(replies)
        raw = prompts.select("id", "n").join(replies.where("error is null"), "id").select(F.col("id").alias("batch_id"), F.col("n").alias("n_items"), F.col("reply").alias("raw"))
        got = store(asked.join(parse_replies(raw), ["batch_id", "item"]).select("text", "translated_text", *record))
        found = got if found is None else found.unionByName(got)
        first = replies.where(F.col("error").startswith(FATAL)).select("error").first()
        if first:
            stopped = first["error"]
            break
        asked = store(asked.join(got.select("digest"), "digest", "left_anti").withColumn("item", F.row_number().over(Window.partitionBy("batch_id").orderBy("item"))))
        if asked.isEmpty():
            break
    scores = found if have is None else found.unionByName(have.select("text", "translated_text", *record))
    return scores, log, stopped


def missing_items(asked: DataFrame, scored: DataFrame) -> DataFrame:
    """Items (batch_id, item) without a record, numbered anew for the second call."""
    left = asked.join(scored, ["batch_id", "item"], "left_anti")
    return left.withColumn("new_item", F.row_number().over(Window.partitionBy("batch_id").orderBy("item")))


def apply_scores(results: DataFrame, scores: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """results joined to scores by (text, translated_text), with the two issues that follow; a score that is absent is null.

    With a column `asked`, rows that were not asked for have no score and no issue."""
    asked = F.col("asked") if "asked" in results.columns else F.lit(True)
    joined = results.join(scores, ["text", "translated_text"], "left")
    for name in [c for c in scores.columns if c not in ("text", "translated_text")]:
        joined = joined.withColumn(name, F.when(asked, F.col(name)))
    extra = F.concat(
        qa.when(asked & F.col("confidence").isNull(), "verification_unavailable", qa.MODERATE, "not scored"),
        qa.when(F.col("confidence") < threshold, "low_confidence", qa.MODERATE, F.concat(F.col("confidence").cast("string"), F.lit("/100 "), F.coalesce("verdict", F.lit("")))),
    )
    return joined.withColumn("qa_issues", F.concat("qa_issues", extra))


def weak(results: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    return results.where((F.col("confidence") < threshold) & (F.coalesce("issues", F.lit("")) != "") & F.col("match_type").isin("llm", "fuzzy") & ~F.col("from_ocr"))


#: What a better draft replaces besides the text and its confidence, where the draft brings it.
REPLACED = {"qa_issues": "new_qa", "verdict": "new_verdict", "issues": "new_issues", **{d: f"new_{d}" for d in WEIGHTS}}


def repair_merge(results: DataFrame, drafts: DataFrame) -> DataFrame:
    """Drafts (text, translated_text, new_text, new_confidence, new_critical, ...) replace a row only where they score higher and hold nothing critical."""
    brought = {old: new for old, new in REPLACED.items() if new in drafts.columns and old in results.columns}
    good = drafts.where(~F.col("new_critical")).select("text", "translated_text", "new_text", "new_confidence", *brought.values())
    j = results.join(good, ["text", "translated_text"], "left")
    better = F.coalesce(F.col("new_confidence") > F.col("confidence"), F.lit(False))
    j = j.withColumn("repaired", better)
    for old, new in {"translated_text": "new_text", "confidence": "new_confidence", **brought}.items():
        j = j.withColumn(old, F.when(F.col("repaired"), F.col(new)).otherwise(F.col(old)))
    return j.drop("new_text", "new_confidence", *brought.values())


def summary(results: DataFrame, by: list[str], threshold: int = THRESHOLD) -> DataFrame:
    """Confidence of a document weighted by length, and its counts. Sums fold map-side."""
    scored = F.col("confidence").isNotNull()
    w = F.greatest(F.lit(10), F.length("text"))
    return results.groupBy(*by).agg(
        F.count_if(scored).alias("verified"), F.count_if(~scored & F.col("asked")).alias("unverified"),
        F.bround(F.sum(F.when(scored, w * F.col("confidence"))) / F.sum(F.when(scored, w)), 1).alias("document_confidence"),
        F.min("confidence").alias("lowest_segment"), F.count_if(F.col("confidence") < threshold).alias("below_threshold"),
        F.count_if((F.col("confidence") >= threshold) & (F.col("confidence") < WATCH_BELOW)).alias("watch_band"),
    )


# One text, one translation


def _translated() -> Column:
    return (F.col("translated_text") != "") & F.col("match_type").isin("llm", "fuzzy", "exact")


def _nowhere() -> Column:
    """A key that no group has, one of a thousand: rows that belong to no group must not all meet in the task of null."""
    return F.concat(F.lit("\0"), F.pmod(F.xxhash64("text"), F.lit(1000)).cast("string"))


def harmonise(results: DataFrame, max_chars: int = 80) -> DataFrame:
    """Short labels that differ by case, spacing or final punctuation get one translation: an approved one, else the best scored, else the first.

    The group's best row comes from one aggregate and is joined back, so a label on every page is no window of its own."""
    fits = _translated() & (F.length("text") <= max_chars) & ~F.contains("text", F.lit("\n"))
    keyed = results.withColumn("_k", F.when(fits, T.key_norm(F.col("text"))))
    spread = F.coalesce("_k", _nowhere())
    norm = T.key_norm(F.col("translated_text"))
    best = F.max_by(F.struct("text", "translated_text", "confidence"), F.struct(F.col("match_type") == "exact", F.coalesce("confidence", F.lit(0)), -F.col("seq")))
    groups = keyed.where(F.col("_k").isNotNull()).groupBy(F.col("_k").alias("_g")).agg(best.alias("_b"), F.min(norm).alias("_lo"), F.max(norm).alias("_hi")).where(F.col("_lo") != F.col("_hi"))
    j = keyed.withColumn("_j", spread).join(groups, F.col("_j") == F.col("_g"), "left").drop("_j")
    change = F.coalesce(norm != T.key_norm(F.col("_b.translated_text")), F.lit(False))
    new = F.concat(T.core(F.col("_b.translated_text")), T.suffix(F.col("text")))
    new = F.when(T.all_upper(F.col("text")) & ~T.all_upper(F.col("_b.text")), F.upper(new)).otherwise(new)
    return (
        j.withColumn("harmonised", change)
        .withColumn("qa_issues", F.when(change, F.filter("qa_issues", lambda q: ~q["rule"].isin("low_confidence", "inconsistent_translation"))).otherwise(F.col("qa_issues")))
        .withColumn("confidence", F.when(change, F.coalesce(F.col("_b.confidence"), F.col("confidence"))).otherwise(F.col("confidence")))
        .withColumn("translated_text", F.when(change, new).otherwise(F.col("translated_text")))
        .drop("_k", "_g", "_b", "_lo", "_hi")
    )


def inconsistent(results: DataFrame) -> DataFrame:
    """key, n_variants, shown: texts with more than one normalised translation, with the first three of their beginnings. One pass makes (key, variant, beginning)
    distinct, map-side first; only keys with several variants are ranked."""
    rows = results.where(_translated()).select(T.key_norm(F.col("text")).alias("key"), T.key_norm(F.col("translated_text")).alias("v"), F.left("translated_text", F.lit(40)).alias("t")).distinct()
    per = Window.partitionBy("key")
    odd = rows.withColumn("lo", F.min("v").over(per)).withColumn("hi", F.max("v").over(per)).where("lo <> hi").drop("lo", "hi")
    told = odd.withColumn("r", F.dense_rank().over(per.orderBy("t"))).withColumn("u", F.dense_rank().over(per.orderBy("v")))
    return told.groupBy("key").agg(F.max("u").cast("long").alias("n_variants"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("r") <= 3, F.col("t")))), " | ").alias("shown"))


def flag_inconsistent(results: DataFrame) -> DataFrame:
    odd = inconsistent(results)
    j = results.withColumn("key", F.coalesce(F.when(_translated(), T.key_norm(F.col("text"))), _nowhere())).join(odd, "key", "left")
    return j.withColumn("qa_issues", F.concat("qa_issues", qa.when(F.col("n_variants") > 1, "inconsistent_translation", qa.MODERATE, F.col("shown")))).drop("key", "n_variants", "shown")


def release_gate(results: DataFrame, by: list[str]) -> DataFrame:
    """failed: a call failed or a placeholder leaked; review: a critical or moderate issue; else pass."""
    crit, mod = F.filter("qa_issues", lambda i: i["severity"] == "critical"), F.filter("qa_issues", lambda i: i["severity"] == "moderate")
    out = results.groupBy(*by).agg(
        F.sum(F.size(crit)).alias("critical"), F.sum(F.size(mod)).alias("moderate"),
        F.max(qa.has_rule(F.col("qa_issues"), "api_error", "leaked_placeholder")).alias("_failed"),
    )
    return out.withColumn("status", F.when(F.col("_failed"), "failed").when(F.col("critical") + F.col("moderate") > 0, "review").otherwise("pass")).drop("_failed")


def segment_counts(segments: DataFrame, by: list[str]) -> DataFrame:
    """Segments with Chinese, and those that OCR read."""
    return segments.groupBy(*by).agg(F.count_if(F.col("text").rlike(f"[{T.CJK}]")).alias("cjk_segments"), F.count_if("from_ocr").alias("ocr_segments"))


def match_counts(results: DataFrame, by: list[str]) -> DataFrame:
    return results.groupBy(*by).agg(F.count_if(F.col("match_type") == "exact").alias("exact"), F.count_if(F.col("match_type") == "fuzzy").alias("fuzzy"), F.count_if(~F.col("match_type").isin("exact", "fuzzy")).alias("other"))


def review_rows(results: DataFrame) -> DataFrame:
    """doc_id, seq, location, source, target, notes, shade: the review table."""
    note = F.filter(
        F.array(
            F.when(F.col("from_ocr"), "OCR"), F.when(F.col("match_type") == "exact", "approved memory"), F.when(F.col("match_type") == "fuzzy", "guided by examples"),
            F.when(F.col("match_type") == "glossary", "glossary"), F.when(F.col("match_type") == "rule", "fixed rule"),
            F.when(F.col("confidence").isNotNull(), F.concat(F.lit("score "), F.col("confidence").cast("string"))),
            F.when(F.size("qa_issues") > 0, F.array_join(F.transform("qa_issues", lambda i: F.concat(i["severity"], F.lit(": "), i["rule"])), "; ")),
        ), lambda x: x.isNotNull())
    return results.select("doc_id", "seq", "location", F.col("text").alias("source"), F.col("translated_text").alias("target"), F.array_join(note, "; ").alias("notes"), qa.severity_rank(F.col("qa_issues"), F.col("from_ocr")).alias("shade"))


def review_top(results: DataFrame, n: int = 40) -> DataFrame:
    """The n first flagged rows, critical first, then by place: a top-k that needs no full sort."""
    rows = results.where(qa.has_severity(F.col("qa_issues"), qa.CRITICAL, qa.MODERATE)).withColumn("_c", qa.has_severity(F.col("qa_issues"), qa.CRITICAL))
    return rows.orderBy(F.desc("_c"), "location", "doc_id", "seq").limit(n).drop("_c")


def review_rest(results: DataFrame, n: int = 40) -> DataFrame:
    """One row: how many flagged rows `review_top` does not show."""
    flagged = results.where(qa.has_severity(F.col("qa_issues"), qa.CRITICAL, qa.MODERATE))
    return flagged.agg(F.greatest(F.lit(0), F.count(F.lit(1)) - n).alias("more"))


def outcome(summary: DataFrame, mismatches: DataFrame, stopped: str | None = None, key: str = "doc_id") -> DataFrame:
    """The summary with what stopped the verifier (null: nothing) and where the output's structure differs from the source's (key, what, source, output)."""
    told = F.concat("what", F.lit(": "), F.col("source").cast("string"), F.lit(" in the source, "), F.col("output").cast("string"), F.lit(" in the output"))
    odd = mismatches.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(told)), "; ").alias("structure"))
    return summary.join(odd, key, "left").withColumn("stopped_by", F.lit(stopped).cast("string"))
