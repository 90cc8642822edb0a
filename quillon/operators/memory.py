"""Approved memory, glossary and result cache: the lookups that decide what needs a model call.

No side is broadcast by hand, but for a glossary that has been counted and is small: dimensions are reduced to a row for each key first, and Catalyst picks the join by their size."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import fuzzy, qa
from quillon.functions import text as T


def first_by(df: DataFrame, key: str, *values: str, pos: str = "pos") -> DataFrame:
    """For each key the row of smallest pos: the first entry wins, however rows are partitioned."""
    return df.groupBy(key).agg(F.min_by(F.struct(*values), F.col(pos)).alias("_v")).select(key, *[F.col(f"_v.{v}").alias(v) for v in values])


def tm_exact(segments: DataFrame, tm: DataFrame, text_col: str = "text") -> DataFrame:
    """segments with tm_target (null: no hit): the strict key first, then the key that also ignores a final full stop."""
    ok = tm.where(F.col("status") == "approved")
    strict = first_by(ok.withColumn("k1", T.key_strict(F.col("source_text"))), "k1", "target_text").withColumnRenamed("target_text", "_t1")
    soft = first_by(ok.withColumn("k2", T.key_soft(F.col("source_text"))), "k2", "target_text").withColumnRenamed("target_text", "_t2")
    keyed = segments.withColumn("k1", T.key_strict(F.col(text_col))).withColumn("k2", T.key_soft(F.col(text_col)))
    return keyed.join(strict, "k1", "left").join(soft, "k2", "left").withColumn("tm_target", T.colon_like(F.col(text_col), F.coalesce("_t1", "_t2"))).drop("k1", "k2", "_t1", "_t2")


def glossary_exact(segments: DataFrame, glossary: DataFrame, text_col: str = "text") -> DataFrame:
    """segments with gl_target: the whole text is a term, with the same punctuation first, then loosely. Texts with Chinese have none."""
    raw = lambda c: F.lower(T.squeeze(F.col(c)))
    same = first_by(glossary.withColumn("k1", raw("en_term")), "k1", "target_term").withColumnRenamed("target_term", "_t1")
    loose = first_by(glossary.withColumn("k2", T.key_loose(F.col("en_term"))), "k2", "target_term").withColumnRenamed("target_term", "_t2")
    keyed = segments.withColumn("k1", raw(text_col)).withColumn("k2", T.key_loose(F.col(text_col)))
    hit = F.when(~F.col(text_col).rlike(f"[{T.CJK}]"), T.glossary_case(F.col(text_col), F.coalesce("_t1", "_t2")))
    return keyed.join(same, "k1", "left").join(loose, "k2", "left").withColumn("gl_target", hit).drop("k1", "k2", "_t1", "_t2")


def _term_pattern(term: Column) -> Column:
    plural = F.when(F.substring(term, -1, 1).rlike(r"\p{L}"), F.lit("(?:s|es)?")).otherwise(F.lit(""))
    # The first sign is looked for before what stands in front of it: most places fail there, and cheaply.
    return F.concat(F.lit("(?iuU)(?="), T.escaped(F.left(term, F.lit(1))), F.lit(r")(?<!\w)"), T.escaped(term), plural, F.lit(r"(?!\w)"))


#: Up to so many terms a glossary goes to every task; a larger one meets words of texts that travel without their texts.
SMALL_GLOSSARY = 2_000


def _first_hits(segments: DataFrame, glossary: DataFrame, keys: list[str], text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """glossary_hits with further columns of the segments; a hit may come more than once."""
    hay = F.replace(F.regexp_replace(F.col(text_col), r"(?U)\s+", " "), F.lit(" & "), F.lit(" and "))
    seg = segments.select(*keys, *keep, hay.alias("_hay"))
    words = F.regexp_extract_all(F.lower("_hay"), F.lit(r"(?U)\w+"), F.lit(0))
    signs = F.regexp_extract_all("_hay", F.lit(r"(?U)[^\w\s]"), F.lit(0))
    spread = lambda ws: F.concat(ws, F.transform(ws, lambda w: F.regexp_replace(w, "s$", "")), F.transform(ws, lambda w: F.regexp_replace(w, "es$", "")))
    term = F.replace(F.col("en_term"), F.lit(" & "), F.lit(" and "))
    word = F.nullif(F.regexp_extract(F.lower(term), r"(?U)(\w+)", 1), F.lit(""))
    gl = glossary.select("pos", "en_term", "target_term", "exact_only", term.alias("_term"), T.key_loose(F.col("en_term")).alias("_k"), F.coalesce(word, F.left(F.trim(term), F.lit(1))).alias("_w"), word.isNull().alias("_sign"))
    first = gl.select("_w", "_sign").take(SMALL_GLOSSARY + 1)
    if len(first) <= SMALL_GLOSSARY:
        # Words that begin no term go at once, so few are told apart and looked up.
        begin = {r["_w"] + end for r in first if r["_w"] is not None for end in ("", "s", "es")}
        forms = spread(F.filter(words, lambda w: w.isin(sorted(begin))))
        forms = F.concat(signs, forms) if any(r["_sign"] for r in first) else forms
        pairs = seg.withColumn("_w", F.explode(F.array_distinct(forms))).join(F.broadcast(gl), "_w")
    else:
        # Words are told apart as hashes: telling strings apart takes the square of their number. What hashes bring in vain the patterns drop.
        digests = F.array_distinct(F.transform(F.concat(signs, spread(words)), lambda w: F.xxhash64(w)))
        found = seg.select(*keys, F.explode(digests).alias("_d")).join(gl.withColumn("_d", F.xxhash64("_w")), "_d").drop("_d").distinct()
        pairs = seg.join(found, keys)
    pairs = pairs.where(~F.coalesce("exact_only", F.lit(False)) | (F.col("_k") == T.key_loose(F.col("_hay"))))
    found = pairs.withColumn("s", F.regexp_instr("_hay", _term_pattern(F.col("_term"))) - 1).where(F.col("s") >= 0)
    span = F.length(F.regexp_substr("_hay", _term_pattern(F.col("_term"))))
    return found.select(*keys, *keep, "pos", "en_term", "target_term", "s", (F.col("s") + span).alias("e"))


def glossary_hits(segments: DataFrame, glossary: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, pos, en_term, target_term, s, e: the first whole-word occurrence of each term in each text (s from 0, e exclusive).

    An inverted index on the first word of a term turns the regex join into an equi join; only its pairs are matched.
    A word that may be a plural is looked up without its ending as well; a term without any word is found by its first sign."""
    return _first_hits(segments, glossary, keys, text_col, ()).distinct()


def terms_absent(pairs: DataFrame, glossary: DataFrame, keys: list[str], text_col: str = "text", target_col: str = "target") -> DataFrame:
    """keys, pos, en_term: terms of the text that its translation lacks, judged where the text is read, so translations don't travel."""
    hits = _first_hits(pairs, glossary, keys, text_col, (target_col,))
    return hits.where(~T.term_present(F.col("target_term"), F.col(target_col))).select(*keys, "pos", "en_term").distinct()


def maximal_spans(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Hits not contained in a strictly longer hit of the same text: none that begins earlier reaches as far, none that begins there reaches further."""
    earlier = F.max("e").over(Window.partitionBy(*keys).orderBy("s").rangeBetween(Window.unboundedPreceding, -1))
    same = F.max("e").over(Window.partitionBy(*keys, "s"))
    told = hits.withColumn("_far", earlier).withColumn("_here", same)
    return told.where((F.coalesce("_far", F.lit(-1)) < F.col("e")) & (F.col("_here") == F.col("e"))).drop("_far", "_here")


def terms_for(hits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, terms (array in glossary order), terms_line for prompts."""
    arr = F.array_sort(F.collect_list(F.struct("pos", "en_term", "target_term")))
    out = hits.groupBy(*keys).agg(arr.alias("terms"))
    return out.withColumn("terms_line", F.array_join(F.transform("terms", lambda t: F.concat(t["en_term"], F.lit(" = "), t["target_term"])), "; "))


def tm_fuzzy(texts: DataFrame, tm: DataFrame, threshold: float = 0.85, top: int = 3, text_col: str = "text") -> DataFrame:
    """text, rank, ratio, pos, source_text, target_text: approved entries whose difflib ratio to the text is high enough, best first.

    The ratio is at most 2*min/(la+lb), so only texts of like length meet: lengths are cut into steps of that bound, a text lies in its own step
    and an entry in its own and both neighbours. Texts are dealt into shares of a step and entries into blocks, so no group holds them all;
    in a group `fuzzy.above` compares all pairs by bounds that lose none, and difflib what is left."""
    reach = (2 - threshold) / threshold
    bucket = lambda n: F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.log(F.lit(reach))).cast("int")
    size = lambda c: F.length(F.lower(c))
    ref = tm.where((F.col("status") == "approved") & F.col("source_text").isNotNull()).select("pos", "source_text", "target_text", size("source_text").alias("_m"))
    m = ref.agg(F.count(F.lit(1)).alias("n"), F.min("_m").alias("lo"), F.max("_m").alias("hi")).first()
    blocks = max(1, -(-m["n"] // 5000))
    like = texts.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull() & size("text").between(int((m["lo"] or 0) / reach) - 1, int((m["hi"] or 0) * reach) + 1))
    shares = max(1, -(-like.count() // 50_000))
    own = like.distinct().select("text", bucket(size("text")).alias("_s"), F.pmod(F.xxhash64("text"), F.lit(shares)).cast("int").alias("_share"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    step = bucket(F.col("_m"))
    near = ref.withColumn("_s", F.explode(F.array(step - 1, step, step + 1))).withColumn("_block", F.pmod(F.xxhash64("source_text", "pos"), F.lit(blocks)).cast("int"))
    near = near.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).select("pos", "source_text", "target_text", "_s", "_share", "_block")

    def compare(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = fuzzy.above([x.lower() for x in a["text"]], [y.lower() for y in b["source_text"]], threshold)
        i, j = [f[0] for f in found], [f[1] for f in found]
        return pd.DataFrame({"text": a["text"].to_numpy()[i], "ratio": [f[2] for f in found], "pos": b["pos"].to_numpy()[j], "source_text": b["source_text"].to_numpy()[j], "target_text": b["target_text"].to_numpy()[j]})

    keys = ("_s", "_share", "_block")
    scored = own.groupBy(*keys).cogroup(near.groupBy(*keys)).applyInPandas(compare, "text string, ratio double, pos long, source_text string, target_text string")
    w = Window.partitionBy("text").orderBy(F.desc("ratio"), "pos")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("text", "rank", "ratio", "pos", "source_text", "target_text")


# Canonical texts and the cache


def canonical(segments: DataFrame, key_col: str, text_col: str = "text", order_col: str = "seq") -> DataFrame:
    """key, canon: one text for each key, the first, or the first that is not all capitals if there is one."""
    rank = F.struct(T.all_upper(F.col(text_col)), F.col(order_col))
    return segments.groupBy(key_col).agg(F.min_by(text_col, rank).alias("canon"))


def ordered_distinct(df: DataFrame, key: str, pos: str, parts: int = 200) -> DataFrame:
    """key, place: distinct keys numbered from 0 in order of their first place (a number). Parts number themselves; a row for each part carries the sums of those before.

    Parts are ranges of the place, cut at bounds that are read once: the partition in which a row lies may differ between two readings of one plan."""
    bounds = sorted(set(df.agg(F.percentile_approx(pos, [i / parts for i in range(1, parts)], 20 * parts).alias("q")).first()["q"] or []))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("_p"))) if bounds else F.lit(0)
    firsts = df.groupBy(key).agg(F.min(pos).alias("_p")).withColumn("_part", part)
    own = firsts.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy("_p")))
    sizes = firsts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_b", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    return own.join(before, "_part").select(key, (F.col("_b") + F.col("_r") - 1).alias("place"))


def pending(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """wanted (model, text, sig) that the cache lacks, has under another signature, or has with an issue that blocks release."""
    usable = cache.where(~qa.has_severity(F.col("qa_issues"), qa.CRITICAL, qa.MODERATE)).select("model", "text", "sig")
    return wanted.join(usable, ["model", "text", "sig"], "left_anti")


def stale(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    other = cache.select("model", "text", F.col("sig").alias("old_sig"))
    return wanted.join(other, ["model", "text"]).where(F.col("sig") != F.col("old_sig")).drop("old_sig")


def merge_cache(theirs: DataFrame, ours: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer merge by key; our row wins as a whole where both have one."""
    values = [c for c in theirs.columns if c not in keys]
    a, b = theirs.withColumn("_a", F.lit(True)), ours.withColumn("_b", F.lit(True))
    for c in values:
        a, b = a.withColumnRenamed(c, f"_a_{c}"), b.withColumnRenamed(c, f"_b_{c}")
    return a.join(b, keys, "full").select(*keys, *[F.when(F.col("_b"), F.col(f"_b_{c}")).otherwise(F.col(f"_a_{c}")).alias(c) for c in values])


def signature(*parts: Column, policy: str = "1") -> Column:
    """Digest of all that a cached result depends on; policy is the version of our own rules."""
    return F.sha2(F.to_json(F.struct(F.lit(policy).alias("policy"), *[p.alias(f"p{i}") for i, p in enumerate(parts)])).cast("binary"), 256)


def tm_digest(tm: DataFrame) -> DataFrame:
    """One row: a digest of all approved entries that doesn't depend on their order, so that any edit changes it."""
    h = F.xxhash64("pos", "source_text", "target_text")
    return tm.where(F.col("status") == "approved").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"))


def block_reuse(blocks: DataFrame, results: DataFrame) -> DataFrame:
    """Replica blocks with the result of the same source text; the first result of a text wins."""
    firsts = first_by(results, "text", "translated_text", "match_type", "qa_issues", pos="seq")
    return blocks.join(firsts, "text", "left")
