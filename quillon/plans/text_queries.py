"""Queries over segments: keys, masking, memory, routing, QA, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import qa
from quillon.functions import text as T
from quillon.operators import engine, memory, route, verify

from . import derived as D
from .registry import query

NUM = "[0-9]+(?:[.,][0-9]+)?"
WITH = "WITH RECURSIVE "


@query(f"{WITH}{D.SEG} SELECT source, count(*) AS n_segments, count(DISTINCT text) AS n_distinct FROM seg GROUP BY source")
def segments_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return D.segments(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n_segments"), F.count_distinct("text").alias("n_distinct"))


QA_SQL = rf"""{WITH}{D.PAIRS}, n AS (
  SELECT source, text, target, list_transform(regexp_extract_all(text, '{NUM}'), lambda x: replace(x, ',', '.')) AS a, list_transform(regexp_extract_all(target, '{NUM}'), lambda x: replace(x, ',', '.')) AS b FROM pairs
), i AS (
  SELECT source, 'critical' AS severity, 'numeric_mismatch' AS rule FROM n WHERE list_sort(a) <> list_sort(b)
  UNION ALL SELECT source, 'critical', 'leaked_placeholder' FROM n WHERE regexp_matches(target, '\[\[\s*P\d+\s*\]\]')
  UNION ALL SELECT source, 'critical', 'suspiciously_short_output' FROM n WHERE length(trim(target)) < length(trim(regexp_replace(text, '[.…_\s]{{4,}}', ' ', 'g'))) * 0.3 AND length(trim(regexp_replace(text, '[.…_\s]{{4,}}', ' ', 'g'))) > 20
  UNION ALL SELECT source, 'critical', 'suspiciously_long_output' FROM n WHERE length(target) > 6 * length(text) + 200
  UNION ALL SELECT source, 'critical', 'empty_output' FROM n WHERE trim(target) = ''
  UNION ALL SELECT source, 'moderate', 'mixed_script_token' FROM n WHERE len(list_filter(regexp_extract_all(target, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '[\x{{0400}}-\x{{04ff}}]'))) > 0
) SELECT source, severity, rule, count(*) AS n FROM i GROUP BY ALL"""


@query(QA_SQL)
def qa_severity_by_source(spark: SparkSession, sf: str) -> DataFrame:
    s, t = F.col("text"), F.col("target")
    issues = F.concat(qa.numeric_mismatch(s, t, T.PLAIN_NUMBER), qa.leaked_placeholder(t), qa.suspiciously_short_output(s, t), qa.suspiciously_long_output(s, t), qa.empty_output(t), qa.mixed_script_token(t))
    return D.pairs(spark, sf).select("source", F.explode(issues).alias("i")).groupBy("source", F.col("i.severity").alias("severity"), F.col("i.rule").alias("rule")).agg(F.count(F.lit(1)).alias("n"))


MASK_SHAPES = (r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+", T.PLAIN_NUMBER)


@query(rf"{WITH}{D.SEG} SELECT doc_id, seq, len(x) AS n_tokens, array_to_string(x, ' ') AS tokens FROM (SELECT doc_id, seq, regexp_extract_all(text, '(?:{MASK_SHAPES[0]})|(?:{NUM})') AS x FROM seg) WHERE len(x) > 0")
def mask_counts(spark: SparkSession, sf: str) -> DataFrame:
    m = D.segments(spark, sf).where(F.col("text").rlike("[0-9@]")).select("doc_id", "seq", T.mask(F.col("text"), pattern=T.mask_pattern(shapes=MASK_SHAPES).removeprefix("(?U)")).alias("m"))
    return m.where(F.size("m.toks") > 0).select("doc_id", "seq", F.size("m.toks").cast("long").alias("n_tokens"), F.array_join("m.toks", " ").alias("tokens"))


@query(rf"""{WITH}{D.SEG}, u AS (SELECT doc_id, seq, text, regexp_extract_all(text, '{NUM}') AS toks FROM seg)
SELECT doc_id, seq, text AS restored, 0::BIGINT AS n_missing FROM u WHERE len(toks) > 0""")
def unmask_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """unmask(mask(x)) is x with nothing missing."""
    s = D.segments(spark, sf).where(F.col("text").rlike("[0-9]")).select("doc_id", "seq", T.mask(F.col("text"), pattern=T.PLAIN_NUMBER).alias("m"))
    u = s.where(F.size("m.toks") > 0).select("doc_id", "seq", T.unmask(F.col("m.masked"), F.col("m.toks")).alias("u"))
    return u.select("doc_id", "seq", F.col("u.text").alias("restored"), F.size("u.missing").cast("long").alias("n_missing"))


@query(rf"""{WITH}{D.SEG}, s AS (SELECT text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS q FROM seg), k AS (
  SELECT rtrim(lower(q), ' :') AS k1, rtrim(lower(q), ' :.') AS k2, rtrim(lower(trim(regexp_replace(replace(text, '&', 'and'), '\s+', ' ', 'g'))), ' :.;,') AS k3, trim(regexp_replace(lower(text), '[\s.:]+', ' ', 'g')) AS k4 FROM s)
SELECT count(DISTINCT k1) AS strict_keys, count(DISTINCT k2) AS soft_keys, count(DISTINCT k3) AS loose_keys, count(DISTINCT k4) AS norm_keys FROM k""")
def key_tm_groups(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    # Keys meet as 128-bit digests: texts don't travel.
    digest = lambda k: F.struct(F.xxhash64(k).alias("a"), F.xxhash64(k, F.lit(7)).alias("b"))
    keys = D.segments(spark, sf).select(F.explode(F.array(*[F.struct(F.lit(n).alias("n"), digest(k).alias("k")) for n, k in (("strict_keys", T.key_strict(t)), ("soft_keys", T.key_soft(t)), ("loose_keys", T.key_loose(t)), ("norm_keys", T.key_norm(t)))])).alias("x"))
    # distinct first, map-side, then counted: four exact counts from one pass.
    d = keys.select("x.*").distinct().groupBy("n").count()
    return d.groupBy().agg(*[F.max(F.when(F.col("n") == n, F.col("count"))).alias(n) for n in ("strict_keys", "soft_keys", "loose_keys", "norm_keys")])


TM_SQL = rf"""{D.TM}, ok AS (SELECT pos, target_text, lower(trim(regexp_replace(source_text, '\s+', ' ', 'g'))) AS q FROM tm WHERE status = 'approved'),
 t1 AS (SELECT rtrim(q, ' :') AS k, arg_min(target_text, pos) AS t FROM ok GROUP BY 1), t2 AS (SELECT rtrim(q, ' :.') AS k, arg_min(target_text, pos) AS t FROM ok GROUP BY 1),
 hit AS (SELECT s.*, coalesce(t1.t, t2.t) AS t FROM (SELECT *, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS q FROM seg) s LEFT JOIN t1 ON rtrim(s.q, ' :') = t1.k LEFT JOIN t2 ON rtrim(s.q, ' :.') = t2.k)"""


@query(f"{WITH}{D.SEG}, {TM_SQL} SELECT doc_id, seq, CASE WHEN text LIKE '%:' AND t NOT LIKE '%:' THEN t || ':' ELSE t END AS tm_target FROM hit WHERE t IS NOT NULL")
def tm_two_pass(spark: SparkSession, sf: str) -> DataFrame:
    return memory.tm_exact(D.segments(spark, sf), D.memory(spark, sf)).where("tm_target is not null").select("doc_id", "seq", "tm_target")


def _one_term(i: int, term: str) -> str:
    """First whole-word hit of one term: the match with its two neighbours is looked for, then found again by position."""
    return rf"""SELECT doc_id, seq, {i} AS pos, '{term}' AS en_term, strpos(hay, m) - 1 AS s, strpos(hay, m) + length(m) - 3 AS e
   FROM (SELECT doc_id, seq, hay, regexp_extract(hay, '(?i)[^\p{{L}}\p{{N}}_]{term}(?:s|es)?[^\p{{L}}\p{{N}}_]') AS m FROM h WHERE contains(lower(hay), '{term}')) WHERE m <> ''"""


GLOSS_HITS = rf"""{D.GLOSS}, h AS (SELECT doc_id, seq, ' ' || replace(regexp_replace(text, '\s+', ' ', 'g'), ' & ', ' and ') || ' ' AS hay FROM seg),
 hits AS ({" UNION ALL ".join(_one_term(i, t) for i, (t, _) in enumerate(D.GLOSSARY))})"""


@query(f"{WITH}{D.SEG}, {GLOSS_HITS} SELECT doc_id, seq, en_term, s::INT AS s, e::INT AS e FROM hits")
def glossary_hits(spark: SparkSession, sf: str) -> DataFrame:
    h = memory.glossary_hits(D.segments(spark, sf), D.glossary(spark), ["doc_id", "seq"])
    return h.select("doc_id", "seq", "en_term", F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"))


@query(f"{WITH}{D.SEG}, {GLOSS_HITS} SELECT a.doc_id, a.seq, a.en_term, a.s::INT AS s FROM hits a WHERE NOT EXISTS (SELECT 1 FROM hits b WHERE a.doc_id = b.doc_id AND a.seq = b.seq AND b.s <= a.s AND a.e <= b.e AND b.e - b.s > a.e - a.s)")
def maximal_spans(spark: SparkSession, sf: str) -> DataFrame:
    h = memory.glossary_hits(D.segments(spark, sf), D.glossary(spark), ["doc_id", "seq"])
    return memory.maximal_spans(h, ["doc_id", "seq"]).select("doc_id", "seq", "en_term", F.col("s").cast("int").alias("s"))


@query(f"{WITH}{D.SEG}, {GLOSS_HITS}, m AS (SELECT a.* FROM hits a WHERE NOT EXISTS (SELECT 1 FROM hits b WHERE a.doc_id = b.doc_id AND a.seq = b.seq AND b.s <= a.s AND a.e <= b.e AND b.e - b.s > a.e - a.s)) SELECT doc_id, seq, string_agg(m.en_term || ' = ' || target_term, '; ' ORDER BY m.pos) AS terms_line FROM m JOIN gloss USING (pos) GROUP BY doc_id, seq")
def terms_for(spark: SparkSession, sf: str) -> DataFrame:
    h = memory.maximal_spans(memory.glossary_hits(D.segments(spark, sf), D.glossary(spark), ["doc_id", "seq"]), ["doc_id", "seq"])
    return memory.terms_for(h, ["doc_id", "seq"]).select("doc_id", "seq", "terms_line")


@query()
def tm_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    return memory.tm_fuzzy(D.segments(spark, sf), D.memory(spark, sf)).select("text", "rank", "ratio", "source_text")


ROUTE_SQL = rf"""{WITH}{D.SEG}, {TM_SQL}, {D.GLOSS}, r AS (
  SELECT source, CASE WHEN text LIKE '[OCR FAILED:%' THEN 'skipped' WHEN regexp_full_match(text, '(?i)p{{1,2}}age\s*\d+\s*[of\s]{{1,6}}\d+') THEN 'rule'
    WHEN NOT regexp_matches(regexp_replace(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+', '', 'g'), '[A-Za-z]') THEN 'passthrough' WHEN t IS NOT NULL THEN 'exact'
    WHEN EXISTS (SELECT 1 FROM gloss g WHERE g.en_term = rtrim(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), ' :.;,')) THEN 'glossary' WHEN regexp_full_match(text, '[A-Z]\.?') THEN 'passthrough' ELSE 'model' END AS match_type FROM hit)
SELECT source, match_type, count(*) AS n FROM r GROUP BY ALL"""


@query(ROUTE_SQL)
def route_counts(spark: SparkSession, sf: str) -> DataFrame:
    s = memory.glossary_exact(memory.tm_exact(D.segments(spark, sf), D.memory(spark, sf)), D.glossary(spark))
    return route.route(s).groupBy("source", F.coalesce("match_type", F.lit("model")).alias("match_type")).agg(F.count(F.lit(1)).alias("n"))


@query(rf"""{WITH}{D.PAIRS}, n AS (SELECT doc_id, seq, list_transform(regexp_extract_all(text, '{NUM}'), lambda x: replace(x, ',', '.')) AS a, list_transform(regexp_extract_all(target, '{NUM}'), lambda x: replace(x, ',', '.')) AS b FROM pairs),
 t AS (SELECT doc_id, seq, unnest(a) AS token, 1 AS d FROM n UNION ALL SELECT doc_id, seq, unnest(b), -1 FROM n)
SELECT doc_id, seq, token, CAST(sum(d) AS BIGINT) AS diff FROM t GROUP BY ALL HAVING sum(d) <> 0""")
def numeric_multiset_diff(spark: SparkSession, sf: str) -> DataFrame:
    p = D.pairs(spark, sf)
    toks = lambda c, d: p.select("doc_id", "seq", F.explode(T.numbers(F.col(c), T.PLAIN_NUMBER)).alias("token"), F.lit(d).alias("d"))
    return toks("text", 1).unionByName(toks("target", -1)).groupBy("doc_id", "seq", "token").agg(F.sum("d").alias("diff")).where("diff <> 0")


LISTED = ", ".join(f"'{w}'" for w in qa.WHITELIST)


@query(rf"""{WITH}{D.PAIRS}, w AS (SELECT doc_id, seq, unnest(regexp_extract_all(target, '[A-Za-z]{{3,}}')) AS w FROM pairs)
SELECT doc_id, seq, count(DISTINCT w) AS n_left FROM w WHERE lower(w) NOT IN ({LISTED}) GROUP BY ALL""")
def latin_leftovers(spark: SparkSession, sf: str) -> DataFrame:
    left = T.latin_leftovers(F.col("target"), T.empty(), qa.whitelist())
    return D.pairs(spark, sf).select("doc_id", "seq", F.size(left).cast("long").alias("n_left")).where("n_left > 0")


@query(rf"""{WITH}{D.PAIRS}, c AS (SELECT doc_id, seq, length(regexp_replace(target, '[^\x{{0400}}-\x{{04ff}}]', '', 'g')) AS c, length(regexp_replace(target, '[^\p{{L}}]', '', 'g')) AS l FROM pairs)
SELECT doc_id, seq, CASE WHEN l = 0 THEN 1.0 ELSE c / l END AS ratio FROM c""")
def cyrillic_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return D.pairs(spark, sf).select("doc_id", "seq", T.cyrillic_ratio(F.col("target")).alias("ratio"))


@query(rf"""{WITH}{D.SEG}, p AS (SELECT doc_id, seq, text, CASE WHEN (doc_id + seq) % 4 = 0 THEN translate(text, 'ABCEHKMOPTX', 'АВСЕНКМОРТХ') ELSE text END AS target FROM seg),
 c AS (SELECT doc_id, seq, target, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9-]*[0-9][\p{{L}}\p{{N}}_-]*')) AS code FROM p)
SELECT doc_id, seq, count(*) AS n_codes FROM c WHERE translate(code, 'ABCEHKMOPTX', 'АВСЕНКМОРТХ') <> code AND contains(target, translate(code, 'ABCEHKMOPTX', 'АВСЕНКМОРТХ')) AND NOT contains(target, code) GROUP BY ALL""")
def homoglyphs(spark: SparkSession, sf: str) -> DataFrame:
    s = D.segments(spark, sf)
    target = F.when((F.col("doc_id") + F.col("seq")) % 4 == 0, F.translate("text", *T.LOOKALIKE)).otherwise(F.col("text"))
    return s.select("doc_id", "seq", F.size(T.lookalikes(F.col("text"), target)).cast("long").alias("n_codes")).where("n_codes > 0")


@query(rf"""{WITH}{D.PAIRS} SELECT doc_id, seq, list_filter(regexp_extract_all(target, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '[\x{{0400}}-\x{{04ff}}]'))[1] AS token
FROM pairs WHERE len(list_filter(regexp_extract_all(target, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '[\x{{0400}}-\x{{04ff}}]'))) > 0""")
def mixed_script(spark: SparkSession, sf: str) -> DataFrame:
    return D.pairs(spark, sf).select("doc_id", "seq", T.mixed_script(F.col("target")).alias("token")).where("token is not null")


@query(f"{WITH}{D.PAIRS} SELECT source, count(*) FILTER (length(target) > 6 * length(text) + 200) AS n_long, count(*) FILTER (length(trim(target)) < length(trim(text)) * 0.3 AND length(trim(text)) > 20) AS n_short FROM pairs GROUP BY source")
def length_outliers(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length(F.trim("text"))
    return D.pairs(spark, sf).groupBy("source").agg(F.count_if(F.length("target") > 6 * F.length("text") + 200).alias("n_long"), F.count_if((F.length(F.trim("target")) < n * 0.3) & (n > 20)).alias("n_short"))


@query(rf"""{WITH}{D.PAIRS}, {GLOSS_HITS}, w AS (
  SELECT h.doc_id, h.seq, h.en_term, lower(p.target) AS hay, list_transform(regexp_extract_all(lower(g.target_term), '[\p{{L}}\p{{N}}_]+'), lambda w: CASE WHEN length(w) <= 3 THEN w WHEN length(w) = 4 THEN left(w, 3) WHEN length(w) <= 6 THEN left(w, length(w) - 2) WHEN length(w) <= 8 THEN left(w, greatest(5, length(w) - 3)) ELSE left(w, 6) END) AS stems
  FROM hits h JOIN gloss g USING (pos) JOIN pairs p ON p.doc_id = h.doc_id AND p.seq = h.seq)
SELECT doc_id, seq, en_term FROM w WHERE len(list_filter(stems, lambda s: NOT contains(hay, s))) > 0""")
def term_presence(spark: SparkSession, sf: str) -> DataFrame:
    """Glossary terms of the source that the translation lacks."""
    return memory.terms_absent(D.pairs(spark, sf), D.glossary(spark), ["doc_id", "seq"]).select("doc_id", "seq", "en_term")


CACHE_SQL = f"{WITH}{D.SEG}, want AS (SELECT DISTINCT 'm' AS model, text, length(text) % 5 AS sig FROM seg), cache AS (SELECT 'm' AS model, text, CASE WHEN length(text) % 3 = 0 THEN 9 ELSE length(text) % 5 END AS sig, length(text) % 7 = 0 AS blocked FROM (SELECT DISTINCT text FROM seg WHERE doc_id % 2 = 0))"


def _cache(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s = D.segments(spark, sf)
    n = F.length("text")
    want = s.select(F.lit("m").alias("model"), "text", (n % 5).alias("sig")).distinct()
    have = s.where("doc_id % 2 = 0").select("text").distinct()
    issues = qa.when(n % 7 == 0, "numeric_mismatch", qa.CRITICAL)
    return want, have.select(F.lit("m").alias("model"), "text", F.when(n % 3 == 0, 9).otherwise(n % 5).alias("sig"), issues.alias("qa_issues"))


@query(f"{CACHE_SQL} SELECT w.text, w.sig FROM want w LEFT JOIN cache c ON w.text = c.text AND w.sig = c.sig AND NOT c.blocked WHERE c.text IS NULL")
def cache_pending(spark: SparkSession, sf: str) -> DataFrame:
    return memory.pending(*_cache(spark, sf)).select("text", "sig")


@query(f"{CACHE_SQL} SELECT w.text, w.sig FROM want w JOIN cache c ON w.text = c.text AND w.sig <> c.sig")
def cache_stale(spark: SparkSession, sf: str) -> DataFrame:
    return memory.stale(*_cache(spark, sf)).select("text", "sig")


@query("WITH a AS (SELECT o_custkey AS k, max(o_totalprice) AS v, 'old' AS who FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1), b AS (SELECT o_custkey AS k, min(o_totalprice) AS v, 'new' AS who FROM orders WHERE o_orderkey % 3 < 2 GROUP BY 1) SELECT coalesce(b.k, a.k) AS k, CASE WHEN b.k IS NOT NULL THEN b.v ELSE a.v END AS v, coalesce(b.who, a.who) AS who FROM a FULL JOIN b ON a.k = b.k")
def cache_merge(spark: SparkSession, sf: str) -> DataFrame:
    o = D.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_totalprice", "o_orderkey")
    a = o.where("o_orderkey % 3 > 0").groupBy("k").agg(F.max("o_totalprice").alias("v")).withColumn("who", F.lit("old"))
    b = o.where("o_orderkey % 3 < 2").groupBy("k").agg(F.min("o_totalprice").alias("v")).withColumn("who", F.lit("new"))
    return memory.merge_cache(a, b, ["k"])


CANON = rf"""{WITH}{D.SEG}, c AS (SELECT doc_id, seq, text, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS key, (text = upper(text) AND text <> lower(text) AND NOT contains(text, 'ß')) AS caps FROM seg),
 canon AS (SELECT key, arg_min(text, (caps, doc_id, seq)) AS canon FROM c GROUP BY key)"""


@query(f"{CANON} SELECT key, canon FROM canon")
def canon_pick(spark: SparkSession, sf: str) -> DataFrame:
    s = D.segments(spark, sf).withColumn("key", F.lower(T.squeeze(F.col("text")))).withColumn("ord", F.struct("doc_id", "seq"))
    return memory.canonical(s, "key", order_col="ord").select("key", "canon")


@query(f"{CANON} SELECT doc_id, seq, canon, text = canon AS same FROM c JOIN canon USING (key)")
def canon_fanout(spark: SparkSession, sf: str) -> DataFrame:
    s = D.segments(spark, sf).withColumn("key", F.lower(T.squeeze(F.col("text")))).withColumn("ord", F.struct("doc_id", "seq"))
    return s.join(memory.canonical(s, "key", order_col="ord"), "key").select("doc_id", "seq", "canon", (F.col("text") == F.col("canon")).alias("same"))


@query(f"""{WITH}{D.SEG}, o AS (SELECT doc_id, seq, 2 * length(text) AS z, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS r FROM seg),
 f AS (SELECT doc_id, seq, r, 0 AS batch, 1 AS n, z AS used FROM o WHERE r = 1 UNION ALL
   SELECT o.doc_id, o.seq, o.r, CASE WHEN f.n >= 15 OR f.used + o.z > 6000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.n >= 15 OR f.used + o.z > 6000 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 15 OR f.used + o.z > 6000 THEN o.z ELSE f.used + o.z END
   FROM f JOIN o ON o.doc_id = f.doc_id AND o.r = f.r + 1)
SELECT doc_id, seq, batch FROM f""")
def batch_pack(spark: SparkSession, sf: str) -> DataFrame:
    s = D.segments(spark, sf).select("doc_id", "seq", "text")
    return verify.pack_batches(s, "doc_id", "seq", 2 * F.length("text")).select("doc_id", "seq", "batch")


def _score_arith(d: int) -> str:
    return f"(conv_id * {7 + d} + turn * {11 + 2 * d}) % 120 - 5"


@query(f"""WITH r AS (SELECT conv_id AS batch_id, turn AS item, {", ".join(f"greatest(0, least(100, {_score_arith(i)})) AS {d}" for i, d in enumerate(verify.WEIGHTS))},
  CASE WHEN turn % 4 = 0 THEN NULL ELSE greatest(0, least(100, (conv_id + turn * 5) % 110)) END AS stated, CASE turn % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'major' ELSE 'minor' END AS verdict
  FROM (SELECT DISTINCT conv_id, turn + 1 AS turn FROM conversations) WHERE (conv_id + turn) % 13 <> 0)
SELECT batch_id, item::INT AS item, meaning::INT AS meaning, completeness::INT AS completeness, terminology::INT AS terminology, grammar::INT AS grammar,
  round_even(least(0.40 * meaning + 0.25 * completeness + 0.15 * terminology + 0.20 * grammar, coalesce(stated, 100), least(meaning, completeness, terminology, grammar) + 25), 0)::INT AS confidence, verdict FROM r""")
def score_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Replies are written as JSON, fenced, with an item that has no score and one that is out of range, and parsed back."""
    c = D.table(spark, sf, "conversations").select("conv_id", (F.col("turn") + 1).alias("turn")).distinct()
    dims = {d: F.expr(_score_arith(i)).cast("string") for i, d in enumerate(verify.WEIGHTS)}
    dims["grammar"] = F.when((F.col("conv_id") + F.col("turn")) % 13 == 0, F.lit("n/a")).otherwise(dims["grammar"])
    stated = F.when(F.col("turn") % 4 == 0, F.lit(None).cast("string")).otherwise(((F.col("conv_id") + F.col("turn") * 5) % 110).cast("string"))
    verdict = F.when(F.col("turn") % 3 == 0, "OK").when(F.col("turn") % 3 == 1, "major").otherwise("odd")
    row = F.struct(F.col("turn").cast("string").alias("id"), *[v.alias(k) for k, v in dims.items()], stated.alias("confidence"), verdict.alias("verdict"), F.lit(" late ").alias("issues"))
    stray = F.struct(F.lit("999").alias("id"), *[F.lit("50").alias(k) for k in dims], F.lit("50").alias("confidence"), F.lit("ok").alias("verdict"), F.lit("").alias("issues"))
    raw = c.groupBy("conv_id").agg(F.to_json(F.struct(F.concat(F.array_sort(F.collect_list(row)), F.array(F.first(stray))).alias("results"))).alias("j"))
    replies = raw.select(F.col("conv_id").alias("batch_id"), F.lit(200).alias("n_items"), F.concat(F.lit("```json\n"), F.col("j"), F.lit("\n```")).alias("raw"))
    return verify.parse_replies(replies).drop("issues")


@query(f"""{WITH}{D.SCORED} SELECT source, count(confidence) AS verified, count(*) FILTER (confidence IS NULL AND asked) AS unverified,
  round_even(sum(greatest(10, length(text)) * confidence)::DOUBLE / sum(CASE WHEN confidence IS NOT NULL THEN greatest(10, length(text)) END), 1) AS document_confidence,
  min(confidence) AS lowest_segment, count(*) FILTER (confidence < 85) AS below_threshold, count(*) FILTER (confidence >= 85 AND confidence < 95) AS watch_band FROM scored GROUP BY source""")
def doc_summary(spark: SparkSession, sf: str) -> DataFrame:
    return verify.summary(D.scored(spark, sf), ["source"])


VARIANTS = rf"""{D.SCORED}, v AS (SELECT trim(regexp_replace(lower(text), '[\s.:]+', ' ', 'g')) AS key, trim(regexp_replace(lower(translated_text), '[\s.:]+', ' ', 'g')) AS v, left(translated_text, 40) AS t, * FROM scored WHERE translated_text <> '' AND match_type IN ('llm', 'fuzzy', 'exact'))"""


@query(f"{WITH}{VARIANTS} SELECT key, count(DISTINCT v) AS n_variants, array_to_string(list_sort(list(DISTINCT t))[1:3], ' | ') AS shown FROM v GROUP BY key HAVING count(DISTINCT v) > 1")
def inconsistent(spark: SparkSession, sf: str) -> DataFrame:
    return verify.inconsistent(D.scored(spark, sf))


@query(rf"""{WITH}{VARIANTS}, g AS (SELECT *, doc_id * 100000 + seq AS o FROM v WHERE length(text) <= 80), b AS (
  SELECT key AS bkey, arg_max(translated_text, (match_type = 'exact', coalesce(confidence, 0), -o)) AS bt, arg_max(text, (match_type = 'exact', coalesce(confidence, 0), -o)) AS bs FROM g GROUP BY key HAVING count(DISTINCT v) > 1)
SELECT g.doc_id, g.seq, CASE WHEN text = upper(text) AND text <> lower(text) AND NOT contains(text, 'ß') AND NOT (bs = upper(bs) AND bs <> lower(bs) AND NOT contains(bs, 'ß')) THEN replace(lower(rtrim(bt, ' :.;') || substr(text, length(rtrim(text, ' :.;')) + 1)), 'ß', 'ss')
  ELSE lower(rtrim(bt, ' :.;') || substr(text, length(rtrim(text, ' :.;')) + 1)) END AS new_text FROM g JOIN b ON key = bkey WHERE v <> trim(regexp_replace(lower(bt), '[\s.:]+', ' ', 'g'))""")
def harmonise(spark: SparkSession, sf: str) -> DataFrame:
    r = D.scored(spark, sf).withColumn("qa_issues", qa.none()).withColumn("own_seq", F.col("seq")).withColumn("seq", F.col("doc_id") * 100000 + F.col("seq"))
    h = verify.harmonise(r).where("harmonised")
    return h.select("doc_id", F.col("own_seq").alias("seq"), F.lower("translated_text").alias("new_text"))


@query(f"""{WITH}{D.SCORED}, d AS (SELECT text, translated_text, arg_min(confidence, (doc_id, seq)) + 5 - length(text) % 11 AS nc, length(text) % 6 = 0 AS crit FROM scored WHERE confidence < 85 AND match_type IN ('llm', 'fuzzy') AND NOT from_ocr GROUP BY text, translated_text)
SELECT s.doc_id, s.seq, coalesce(NOT d.crit AND d.nc > s.confidence, false) AS repaired, CASE WHEN coalesce(NOT d.crit AND d.nc > s.confidence, false) THEN d.nc ELSE s.confidence END AS confidence
FROM scored s LEFT JOIN d ON s.text = d.text AND s.translated_text = d.translated_text""")
def repair_merge(spark: SparkSession, sf: str) -> DataFrame:
    r = D.scored(spark, sf).withColumn("issues", F.lit("late"))
    drafts = verify.weak(r).groupBy("text", "translated_text").agg(F.min_by("confidence", F.struct("doc_id", "seq")).alias("c")).select("text", "translated_text", F.concat("translated_text", F.lit("!")).alias("new_text"), (F.col("c") + 5 - F.length("text") % 11).alias("new_confidence"), (F.length("text") % 6 == 0).alias("new_critical"))
    return verify.repair_merge(r, drafts).select("doc_id", "seq", "repaired", "confidence")


STRAY_KNOWN = ", ".join(f"'{w}'" for w in (*qa.WHITELIST, *T.UNITS))


@query(rf"""{WITH}{D.PAIRS}, w AS (SELECT unnest(regexp_extract_all(regexp_replace(target, '(?:https?://|www\.)\S+|[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_-]+(?:\.[\p{{L}}\p{{N}}_-]+)+', ' ', 'g'), '[A-Za-z][A-Za-z''-]{{2,}}')) AS word FROM pairs)
SELECT word, count(*) AS n FROM w WHERE lower(word) NOT IN ({STRAY_KNOWN}) AND NOT (word = upper(word) AND word <> lower(word)) GROUP BY word ORDER BY n DESC, word LIMIT 12""")
def stray_top(spark: SparkSession, sf: str) -> DataFrame:
    words = D.pairs(spark, sf).select(F.explode(T.stray_words(F.col("target"), qa.whitelist())).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(12)


def _issues() -> F.Column:
    return F.concat(qa.when(F.col("confidence").isNull(), "verification_unavailable", qa.MODERATE), qa.when(F.col("confidence") < 85, "low_confidence", qa.MODERATE), qa.leaked_placeholder(F.col("translated_text")), qa.empty_output(F.col("translated_text")))


GATE = rf"{D.SCORED}, q AS (SELECT *, (confidence IS NULL)::INT AS unv, coalesce((confidence < 85)::INT, 0) AS low, regexp_matches(translated_text, '\[\[\s*P\d+\s*\]\]')::INT AS leak, (trim(translated_text) = '')::INT AS void FROM scored)"


@query(f"{WITH}{GATE} SELECT doc_id, CAST(sum(leak + void) AS BIGINT) AS critical, CAST(sum(unv + low) AS BIGINT) AS moderate, CASE WHEN max(leak) = 1 THEN 'failed' WHEN sum(leak + void + unv + low) > 0 THEN 'review' ELSE 'pass' END AS status FROM q GROUP BY doc_id")
def release_gate(spark: SparkSession, sf: str) -> DataFrame:
    return verify.release_gate(D.scored(spark, sf).withColumn("qa_issues", _issues()), ["doc_id"])


@query(f"""{WITH}{GATE} SELECT doc_id, seq, concat_ws('; ', CASE WHEN from_ocr THEN 'OCR' END, CASE match_type WHEN 'exact' THEN 'approved memory' WHEN 'fuzzy' THEN 'guided by examples' WHEN 'rule' THEN 'fixed rule' END, 'score ' || confidence,
  nullif(concat_ws('; ', CASE WHEN unv = 1 THEN 'moderate: verification_unavailable' END, CASE WHEN low = 1 THEN 'moderate: low_confidence' END, CASE WHEN leak = 1 THEN 'critical: leaked_placeholder' END, CASE WHEN void = 1 THEN 'critical: empty_output' END), '')) AS notes,
  CASE WHEN leak + void > 0 THEN 'critical' WHEN unv + low > 0 THEN 'moderate' WHEN from_ocr THEN 'ocr' ELSE 'none' END AS shade FROM q""")
def review_rows(spark: SparkSession, sf: str) -> DataFrame:
    return verify.review_rows(D.scored(spark, sf).withColumn("qa_issues", _issues())).select("doc_id", "seq", "notes", "shade")


@query(f"{WITH}{GATE} SELECT doc_id, seq, location, leak + void > 0 AS critical FROM q WHERE leak + void + unv + low > 0 ORDER BY leak + void > 0 DESC, location, doc_id, seq LIMIT 40")
def review_top40(spark: SparkSession, sf: str) -> DataFrame:
    r = D.scored(spark, sf).withColumn("qa_issues", _issues())
    return verify.review_top(r).select("doc_id", "seq", "location", qa.has_severity(F.col("qa_issues"), qa.CRITICAL).alias("critical"))


@query(f"{WITH}{GATE} SELECT greatest(0, count(*) - 40) AS more FROM q WHERE leak + void + unv + low > 0")
def review_rest(spark: SparkSession, sf: str) -> DataFrame:
    return verify.review_rest(D.scored(spark, sf).withColumn("qa_issues", _issues()))


@query(f"""{WITH}{D.SCORED}, s AS (SELECT doc_id, count(confidence) AS verified FROM scored GROUP BY doc_id)
SELECT doc_id, verified, CASE WHEN doc_id % 3 = 0 THEN 'paragraphs: 2 in the source, 3 in the output; tables: ' || (doc_id % 7) || ' in the source, 9 in the output' END AS structure, 'fatal: HTTP 402' AS stopped_by FROM s""")
def doc_outcome(spark: SparkSession, sf: str) -> DataFrame:
    s = verify.summary(D.scored(spark, sf), ["doc_id"]).select("doc_id", "verified")
    odd = s.where("doc_id % 3 = 0").select("doc_id", F.explode(F.array(F.struct(F.lit("tables").alias("what"), (F.col("doc_id") % 7).alias("source"), F.lit(9).alias("output")), F.struct(F.lit("paragraphs").alias("what"), F.lit(2).cast("long").alias("source"), F.lit(3).alias("output")))).alias("x")).select("doc_id", "x.*")
    return verify.outcome(s, odd, "fatal: HTTP 402")


@query(f"{WITH}{GATE} SELECT source, CAST(sum(leak + void) AS BIGINT) AS critical, CAST(sum(unv + low) AS BIGINT) AS moderate FROM q GROUP BY source")
def severity_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda s: F.sum(F.size(F.filter("qa_issues", lambda i: i["severity"] == s))).alias(s)
    return D.scored(spark, sf).withColumn("qa_issues", _issues()).groupBy("source").agg(n("critical"), n("moderate"))


@query(f"{WITH}{D.SCORED} SELECT source, count(*) FILTER (match_type = 'exact') AS exact, count(*) FILTER (match_type = 'fuzzy') AS fuzzy, count(*) FILTER (match_type NOT IN ('exact', 'fuzzy')) AS other FROM scored GROUP BY source")
def match_counts(spark: SparkSession, sf: str) -> DataFrame:
    return verify.match_counts(D.scored(spark, sf), ["source"])


@query(f"{WITH}{D.SCORED} SELECT doc_id, seq, confidence FROM scored WHERE confidence < 85 ORDER BY confidence, doc_id, seq")
def weak_sorted(spark: SparkSession, sf: str) -> DataFrame:
    return D.scored(spark, sf).where("confidence < 85").select("doc_id", "seq", "confidence").orderBy("confidence", "doc_id", "seq")


@query(f"{WITH}{D.SCORED}, f AS (SELECT text, arg_min(translated_text, (doc_id, seq)) AS first_target FROM scored GROUP BY text) SELECT doc_id, seq, first_target FROM scored JOIN f USING (text)")
def block_reuse(spark: SparkSession, sf: str) -> DataFrame:
    s = D.scored(spark, sf)
    first = memory.first_by(s.withColumn("ord", F.struct("doc_id", "seq")), "text", "translated_text", pos="ord").withColumnRenamed("translated_text", "first_target")
    return s.select("doc_id", "seq", "text").join(first, "text").select("doc_id", "seq", "first_target")


@query(f"{WITH}{D.SEG}, l AS (SELECT *, max(seq) OVER (PARTITION BY doc_id) AS last FROM seg) SELECT doc_id, seq FROM l WHERE seq % 25 = 0 OR seq = last")
def progress_marks(spark: SparkSession, sf: str) -> DataFrame:
    return engine.progress_marks(D.segments(spark, sf)).select("doc_id", "seq")


@query(f"{WITH}{D.SEG}, p AS (SELECT doc_id, seq, seq // 12 AS page FROM seg WHERE doc_id % 17 = 0) SELECT doc_id, min(seq) AS seq, page FROM p GROUP BY doc_id, page")
def ocr_first_per_page(spark: SparkSession, sf: str) -> DataFrame:
    r = D.segments(spark, sf).select("doc_id", "seq", F.expr("seq div 12").alias("page"), (F.col("doc_id") % 17 == 0).alias("from_ocr"), qa.none().alias("qa_issues"))
    return engine.first_ocr_of_page(r).where(F.size("qa_issues") > 0).select("doc_id", "seq", "page")


@query(rf"""{WITH}{D.SEG} SELECT doc_id, seq, page_no FROM (SELECT doc_id, seq, 'Page ' || (seq + 1) || ' of ' || (doc_id % 50 + 1) AS p, 'Страница ' || (seq + 1) || ' из ' || (doc_id % 50 + 1) AS page_no FROM seg)""")
def page_rule(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("PPage "), (F.col("seq") + 1).cast("string"), F.lit(" of "), (F.col("doc_id") % 50 + 1).cast("string"))
    return D.segments(spark, sf).select("doc_id", "seq", T.page_rule(t).alias("page_no"))


@query(rf"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS bare FROM pages""")
def strip_markup(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "pages").select("page_id", T.squeeze(T.strip_markup(F.col("html"))).alias("bare"))


def echo_provider(pdf):
    """A deterministic stand-in for a model: transliterates, fails or errs on some first attempts, by the length of the prompt."""
    import pandas as pd

    table = str.maketrans(D.LATIN, D.CYRILLIC)
    rows = []
    for r in pdf.itertuples():
        text = r.prompt.rpartition("Text: ")[2]
        out = "".join(p if p.startswith("[[P") else p.translate(table) for p in __import__("re").split(r"(\[\[P\d+\]\])", text))
        n = len(text)
        error = "timeout" if n % 11 == 0 and r.attempt < 2 else None
        reply = text if n % 7 == 0 and r.attempt < 3 else out + " [[P9]]" if n % 13 == 0 and r.attempt < 2 else out
        rows.append((r.id, r.attempt, r.prompt, r.model, None if error else reply, error, len(r.prompt) // 4, n // 4))
    return pd.DataFrame(rows, columns=["id", "attempt", "prompt", "model", "reply", "error", "input_tokens", "output_tokens"])


def _ladder(spark: SparkSession, sf: str):
    tm = D.memory(spark, sf).select("pos", "source_text")
    m = tm.withColumn("m", T.mask(F.col("source_text")))
    todo = m.select(F.col("pos").alias("id"), F.col("source_text").alias("text"), "m.masked", "m.toks", F.array().cast("array<struct<pos:bigint,en_term:string,target_term:string>>").alias("terms"), F.lit("").alias("examples"))
    return engine.retry_ladder(todo, echo_provider, fallback="second", workers=4)


@query()
def retry_ladder(spark: SparkSession, sf: str) -> DataFrame:
    return _ladder(spark, sf)[0]


@query()
def token_usage(spark: SparkSession, sf: str) -> DataFrame:
    return engine.token_usage(_ladder(spark, sf)[1])
