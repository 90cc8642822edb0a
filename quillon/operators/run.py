"""The whole run: segments in, released translations out.

route -> cache -> provider passes -> QA -> scoring -> repair -> harmonising -> gate. Each distinct text is translated once and each distinct pair
scored once; passes that call a model are written out before anything reads them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import qa
from quillon.functions import text as T
from quillon.sources import readers

from . import engine, memory, route, verify

TERMS = "array<struct<pos:bigint,en_term:string,target_term:string>>"


@dataclass(frozen=True)
class Config:
    """Settings of a run; what a cached result depends on is in `signature_parts`."""

    code: str = "ru"
    model: str = "main"
    fallback: str | None = None
    verifier: str = "verifier"
    threshold: int = verify.THRESHOLD
    similar: float = 0.85
    workers: int = 8
    protected: tuple[str, ...] = ()
    listed: tuple[str, ...] = qa.WHITELIST

    @property
    def language(self) -> str:
        return route.LANGUAGES.get(self.code, self.code)

    def signature_parts(self) -> list:
        return [F.lit(str(x)) for x in (self.code, self.model, self.fallback, self.similar, self.protected, self.listed)]


@dataclass
class Result:
    """results: a row for each segment; summary and gate: one for each document; log: every call; cache, scores: what the next run may reuse."""

    results: DataFrame
    summary: DataFrame
    gate: DataFrame
    log: DataFrame | None
    cache: DataFrame
    scores: DataFrame | None
    stopped: str | None = None
    counts: DataFrame | None = field(default=None)


class Engine:
    """A translator and, if scores are wanted, a verifier, each a provider, with approved memory and glossary."""

    def __init__(self, translator, verifier=None, config: Config | None = None):
        self.translator, self.verifier, self.config = translator, verifier, config or Config()

    def run(self, segments: DataFrame, tm: DataFrame, glossary: DataFrame, cache: DataFrame | None = None, scores: DataFrame | None = None, cache_root: str | None = None) -> Result:
        """segments: doc_id, seq, text, page, location, from_ocr. With `cache_root`, results are kept there even if a fatal error ends the run (`engine.Stopped`)."""
        c, spark = self.config, segments.sparkSession
        cache = cache if cache is not None else spark.createDataFrame([], readers.CACHE)
        routed = self._routed(segments, tm, glossary)
        texts = engine.store(self._wanted(routed, tm, glossary))
        usable = engine.store(usable_cache(texts, cache, c.listed))
        todo = texts.join(usable.select("text"), "text", "left_anti").withColumn("id", F.xxhash64("text"))
        log = None
        try:
            done, log = engine.retry_ladder(todo.select("id", "text", "masked", "toks", "terms", "examples"), self.translator, c.language, c.model, c.fallback, c.workers)
        except engine.Stopped as stop:
            if cache_root and stop.done is not None:
                self._keep(cache, self._cached(texts, stop.done), cache_root)
            raise
        fresh = engine.store(done)
        cache = self._keep(cache, self._cached(texts, fresh), cache_root)
        both = fresh.select("text", "translated_text", "match_type", "qa_issues").unionByName(usable.select("text", "translated_text", "match_type", "qa_issues"))
        answers = texts.select("text", "key").join(both, "text")
        rows = engine.store(self._assembled(routed, answers))
        rows = engine.first_ocr_of_page(rows)
        stopped, found = None, None
        rows = rows.withColumn("asked", verify.wants_score(c.protected))
        if self.verifier is None:
            rows = rows.withColumn("asked", F.lit(False)).select("*", *[F.lit(None).cast("int").alias(d) for d in (*verify.WEIGHTS, "confidence")], F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("issues"), F.lit(False).alias("repaired"))
        else:
            rows, found, log, stopped, cache = self._scored(rows, texts, scores, log, cache, cache_root)
        rows = verify.flag_inconsistent(verify.harmonise(rows))
        rows = engine.store(rows)
        summary = verify.summary(rows, ["doc_id"], c.threshold)
        gate = verify.release_gate(rows, ["doc_id"])
        return Result(rows, summary, gate, log, cache, found, stopped, verify.match_counts(rows, ["doc_id"]))

    def _routed(self, segments: DataFrame, tm: DataFrame, glossary: DataFrame) -> DataFrame:
        s = memory.glossary_exact(memory.tm_exact(segments, tm), glossary)
        r = route.route(s, self.config.code, self.config.protected).withColumn("scan", T.blank_tokens(F.col("masked"), " "))
        return engine.store(r.withColumn("key", T.key_canon(F.col("text"), F.col("toks"))).drop("tm_target", "gl_target"))

    def _wanted(self, routed: DataFrame, tm: DataFrame, glossary: DataFrame) -> DataFrame:
        """One row for each text that a model must translate: key, text, masked, toks, terms, terms_line, examples, sig."""
        c = self.config
        own = routed.where(F.col("match_type").isNull()).withColumn("ord", F.struct("doc_id", "seq"))
        canon = memory.canonical(own, "key", order_col="ord").select("key", F.col("canon").alias("text"))
        texts = canon.withColumn("_m", T.mask(F.col("text"), c.protected)).select("key", "text", "_m.masked", "_m.toks").withColumn("scan", T.blank_tokens(F.col("masked"), " "))
        terms = memory.terms_for(memory.maximal_spans(memory.glossary_hits(texts, glossary, ["key"], "scan"), ["key"]), ["key"])
        like = memory.tm_fuzzy(texts, tm, c.similar)
        told = F.transform(F.array_sort(F.collect_list(F.struct("rank", "source_text", "target_text"))), lambda x: F.concat(x["source_text"], F.lit(" = "), x["target_text"]))
        like = like.groupBy("text").agg(F.array_join(told, "; ").alias("examples"))
        out = texts.join(terms, "key", "left").join(like, "text", "left")
        out = out.withColumn("terms", F.coalesce("terms", F.array().cast(TERMS))).withColumn("terms_line", F.coalesce("terms_line", F.lit(""))).withColumn("examples", F.coalesce("examples", F.lit("")))
        seal = memory.tm_digest(tm).first()
        sig = memory.signature(F.col("text"), F.col("masked"), F.col("terms_line"), F.lit(f"{seal['n']}:{seal['x']}"), *c.signature_parts())
        return out.drop("scan").withColumn("sig", sig).withColumn("model", F.lit(c.model))

    def _cached(self, texts: DataFrame, done: DataFrame) -> DataFrame:
        """What is worth keeping of new results: calls that failed are not."""
        ok = done.where(~qa.has_rule(F.col("qa_issues"), "api_error")).select("text", "translated_text", "match_type", "qa_issues")
        return texts.select("model", "text", "sig").join(ok, "text").select("model", "text", "translated_text", "match_type", "qa_issues", "sig")

    def _keep(self, cache: DataFrame, fresh: DataFrame, root: str | None) -> DataFrame:
        merged = engine.store(memory.merge_cache(cache, fresh, ["model", "text"]))
        if root:
            readers.swap_table(merged, root, uuid.uuid4().hex)
        return merged

    def _assembled(self, routed: DataFrame, answers: DataFrame) -> DataFrame:
        """Routed rows with QA of what a rule or the memory gave, model rows with their canonical text's answer in their own capitals."""
        gave = routed.where(F.col("match_type").isNotNull())
        none = F.array().cast(TERMS)
        checks = qa.run_checks(F.col("text"), F.col("translated_text"), T.empty(), none, F.col("toks"), qa.whitelist(self.config.listed))
        issues = F.when(F.col("match_type") == "skipped", route.route_issues(gave)).when(F.col("match_type") == "rule", qa.none()).otherwise(checks)
        gave = gave.withColumn("qa_issues", issues)
        asked = engine.fan_out(routed.where(F.col("match_type").isNull()).drop("match_type", "translated_text"), answers).drop("canon")
        return gave.unionByName(asked.select(*gave.columns))

    def _scored(self, rows: DataFrame, texts: DataFrame, scores: DataFrame | None, log, cache: DataFrame, root: str | None):
        c = self.config
        lines = texts.select("key", "terms_line")
        keyed = rows.join(lines, "key", "left")
        pairs = keyed.where("asked").groupBy("text", "translated_text").agg(F.max(F.coalesce("terms_line", F.lit(""))).alias("terms_line"))
        found, calls, stopped = verify.score_pairs(pairs, self.verifier, scores, c.language, c.verifier, c.workers)
        log = calls if log is None else log.unionByName(calls)
        rows = engine.store(verify.apply_scores(rows, found.drop("digest"), c.threshold))
        weak = verify.weak(rows, c.threshold)
        todo = weak.groupBy("text", "translated_text").agg(F.first("masked").alias("masked"), F.first("toks").alias("toks"), F.first("key").alias("key"), F.first("issues").alias("findings"), F.first("match_type").alias("match_type"), F.first("confidence").alias("old"))
        todo = engine.store(todo.join(texts.select("key", "terms"), "key", "left").withColumn("terms", F.coalesce("terms", F.array().cast(TERMS))).withColumn("id", F.xxhash64("text", "translated_text")))
        if stopped or todo.isEmpty():
            return rows.withColumn("repaired", F.lit(False)), found, log, stopped, cache
        drafts, calls = engine.redo(todo, self.translator, c.language, c.model, c.workers)
        log = log.unionByName(calls)
        again = drafts.select("text", F.col("new_text").alias("translated_text"), F.array_join(F.transform("terms", lambda t: F.concat(t["en_term"], F.lit(" = "), t["target_term"])), "; ").alias("terms_line")).distinct()
        better, calls, stopped = verify.score_pairs(again, self.verifier, scores, c.language, c.verifier, c.workers)
        log, found = log.unionByName(calls), found.unionByName(better)
        judged = engine.store(drafts.join(better.select("text", F.col("translated_text").alias("new_text"), *[F.col(x).alias(f"new_{x}") for x in (*verify.WEIGHTS, "confidence", "verdict", "issues")]), ["text", "new_text"]))
        rows = engine.store(verify.repair_merge(rows, judged))
        won = judged.where(F.col("new_confidence") > F.col("old")).select("text", F.col("new_text").alias("translated_text"), "match_type", F.col("new_qa").alias("qa_issues")).dropDuplicates(["text"])
        return rows, found, log, stopped, self._keep(cache, self._cached(texts, won), root)


def usable_cache(texts: DataFrame, cache: DataFrame, listed=qa.WHITELIST) -> DataFrame:
    """Cached answers of texts (model, text, sig, terms, toks) that today's rules still pass: the issues stored with them are not trusted."""
    old = cache.select("model", "text", "sig", "translated_text", "match_type")
    j = texts.join(old, ["model", "text", "sig"])
    j = j.withColumn("qa_issues", qa.run_checks(F.col("text"), F.col("translated_text"), T.empty(), F.col("terms"), F.col("toks"), qa.whitelist(listed)))
    return j.where(~qa.has_severity(F.col("qa_issues"), qa.CRITICAL, qa.MODERATE))
