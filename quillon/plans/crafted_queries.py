"""Queries over sentences made from ids, whose protected tokens and defects are known, so that SQL can say what masking and the QA rules must find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import qa
from quillon.functions import text as T
from quillon.operators import engine, memory, route, verify
from quillon.operators.run import TERMS, usable_cache

from . import derived as D
from .registry import query

WITH = "WITH RECURSIVE "
#: k chooses the defect.
IDS = f"{D.SEG}, ids AS (SELECT doc_id, seq, source, (doc_id * 7 + seq) % 16 AS k, 'PT-' || (1000 + (doc_id * 13 + seq) % 9000) AS tag, CAST(1 + (doc_id + seq * 3) % 90 AS VARCHAR) AS n FROM seg)"


def ids(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("doc_id") * 7 + F.col("seq")) % 16
    tag = F.concat(F.lit("PT-"), (1000 + (F.col("doc_id") * 13 + F.col("seq")) % 9000).cast("string"))
    return D.segments(spark, sf).select("doc_id", "seq", "source", k.alias("k"), tag.alias("tag"), (1 + (F.col("doc_id") + F.col("seq") * 3) % 90).cast("string").alias("n"))


def _told(*parts) -> F.Column:
    """Names of columns and literal stretches in turn: "{tag}" is a column."""
    return F.concat(*[F.col(p[1:-1]) if p.startswith("{") else F.lit(p) for p in parts])


SHAPES = ("Valve ", "{tag}", " rated ", "{n}", " bar on 03.04.2021 see a", "{n}", "@b.org by ISO 90", "{n}", ", HART, AB", "{n}", "CD7 阀门 and ⟦1⟧ end")
MASKED = "Valve [[P0]] rated [[P1]] on [[P2]] see [[P3]] by [[P4]], [[P5]], [[P6]] [[P7]] and [[P8]] end"


@query(f"""{WITH}{IDS} SELECT doc_id, seq, '{MASKED}' AS masked, array_to_string([tag, n || ' bar', '03.04.2021', 'a' || n || '@b.org', 'ISO 90' || n, 'HART', 'AB' || n || 'CD7', '阀门', '⟦1⟧'], '|') AS toks,
  replace(regexp_replace('{MASKED}', '\\[\\[P[0-9]\\]\\]', ' ', 'g'), '~', '') AS scan FROM ids""")
def mask_shapes(spark: SparkSession, sf: str) -> DataFrame:
    m = ids(spark, sf).withColumn("s", _told(*SHAPES)).withColumn("m", T.mask(F.col("s")))
    return m.select("doc_id", "seq", "m.masked", F.array_join("m.toks", "|").alias("toks"), T.scan_text(F.col("s")).alias("scan"))


@query(f"{WITH}{IDS} SELECT doc_id, seq, CAST(unnest(range(0, 3)) AS INT) AS place, unnest(['Acme''s pump', tag, n || ' mm']) AS tok FROM ids")
def mask_protected(spark: SparkSession, sf: str) -> DataFrame:
    """Protected terms go first, the longest first, with either apostrophe; each match has its number."""
    s = _told("Fit Acme's pump ", "{tag}", " with ", "{n}", " mm")
    m = ids(spark, sf).select("doc_id", "seq", F.posexplode(T.mask(s, ("Acme", "Acme’s pump"))["toks"]).alias("place", "tok"))
    return m.select("doc_id", "seq", "place", "tok")


@query(f"""{WITH}{IDS} SELECT doc_id, seq, CASE k % 4 WHEN 0 THEN 'at ' || tag || ' of ' || n || ' bar' WHEN 1 THEN 'of ' || n || ' bar at ' || tag WHEN 2 THEN 'at ' || tag ELSE 'at ' || tag || ' and ' || tag || ' of ' || n || ' bar' END AS restored,
  CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN '[[P0]] [[P1]]' WHEN 2 THEN '[[P0]] [[P1]]' ELSE '[[P0]] [[P1]]' END AS missing FROM ids""")
def unmask_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Blanks in a placeholder do no harm; another order, a loss or a double are all reported."""
    r = F.when(F.col("k") % 4 == 0, "at [[ P0 ]] of [[P1]]").when(F.col("k") % 4 == 1, "of [[P1]] at [[P0]]").when(F.col("k") % 4 == 2, "at [[P0]]").otherwise("at [[P0]] and [[P0]] of [[P1]]")
    u = ids(spark, sf).withColumn("u", T.unmask(r, F.array(F.col("tag"), F.concat("n", F.lit(" bar")))))
    return u.select("doc_id", "seq", F.col("u.text").alias("restored"), F.array_join("u.missing", " ").alias("missing"))


GOOD = "'Клапан ' || tag || ' требует крышку насоса на ' || n || ' bar'"
PAIR = f"""{IDS}, pair AS (SELECT *, 'Valve ' || tag || ' needs the blue pump cover rated ' || n || ' bar' AS text, CASE k WHEN 2 THEN {GOOD} || ' [[P1]]' WHEN 3 THEN {GOOD} || ' 阀' WHEN 4 THEN 'Клапан требует крышку насоса на ' || n || ' bar'
  WHEN 5 THEN 'Клапан ' || tag || ' требует крышку насоса на 9' || n || ' bar' WHEN 7 THEN '' WHEN 8 THEN {GOOD} || repeat(' щ', 600) WHEN 9 THEN 'Valve ' || tag || ' needs the blue pump cover rated ' || n || ' bar'
  WHEN 10 THEN replace({GOOD}, 'PT-', 'РТ-') WHEN 11 THEN {GOOD} || ' remaining' WHEN 12 THEN {GOOD} || ' Dжem' WHEN 13 THEN replace({GOOD}, n || ' bar', n || ',0 bar') ELSE {GOOD} END AS target FROM ids)"""
RULES = """rules AS (SELECT doc_id, seq, source, k, unnest(CASE k WHEN 1 THEN ['missing_placeholder'] WHEN 2 THEN ['leaked_placeholder'] WHEN 3 THEN ['chinese_mismatch'] WHEN 4 THEN ['protected_token_mismatch', 'numeric_mismatch'] WHEN 5 THEN ['protected_token_mismatch', 'numeric_mismatch']
  WHEN 6 THEN ['missing_glossary_term'] WHEN 7 THEN ['protected_token_mismatch', 'protected_token_mismatch', 'numeric_mismatch', 'suspiciously_short_output', 'empty_output'] WHEN 8 THEN ['suspiciously_long_output'] WHEN 9 THEN ['possibly_untranslated', 'latin_words_in_output']
  WHEN 10 THEN ['protected_token_mismatch', 'homoglyph_substitution'] WHEN 11 THEN ['latin_words_in_output'] WHEN 12 THEN ['mixed_script_token'] WHEN 13 THEN ['protected_token_mismatch', 'numeric_mismatch', 'latin_words_in_output'] ELSE [] END) AS rule FROM pair)"""


def pair(spark: SparkSession, sf: str) -> DataFrame:
    """text, target, and the arguments of the QA rules; which defect a target has follows from k."""
    good = _told("Клапан ", "{tag}", " требует крышку насоса на ", "{n}", " bar")
    text = _told("Valve ", "{tag}", " needs the blue pump cover rated ", "{n}", " bar")
    k = F.col("k")
    target = (
        F.when(k == 2, F.concat(good, F.lit(" [[P1]]"))).when(k == 3, F.concat(good, F.lit(" 阀"))).when(k == 4, _told("Клапан требует крышку насоса на ", "{n}", " bar")).when(k == 5, _told("Клапан ", "{tag}", " требует крышку насоса на 9", "{n}", " bar"))
        .when(k == 7, "").when(k == 8, F.concat(good, F.repeat(F.lit(" щ"), 600))).when(k == 9, text).when(k == 10, F.replace(good, F.lit("PT-"), F.lit("РТ-"))).when(k == 11, F.concat(good, F.lit(" remaining"))).when(k == 12, F.concat(good, F.lit(" Dжem")))
        .when(k == 13, F.replace(good, F.concat("n", F.lit(" bar")), F.concat("n", F.lit(",0 bar")))).otherwise(good)
    )
    p = ids(spark, sf).withColumn("text", text).withColumn("target", target).withColumn("toks", T.mask(F.col("text"))["toks"])
    missing = F.when(k == 1, F.array(F.lit("[[P0]]"))).otherwise(T.empty())
    terms = F.when(k == 6, F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit("blue pump").alias("en_term"), F.lit("синий насос").alias("target_term")))).otherwise(F.array().cast(TERMS))
    return p.withColumn("terms", terms).withColumn("qa_issues", qa.run_checks(F.col("text"), F.col("target"), missing, terms, F.col("toks")))


@query(f"{WITH}{PAIR}, {RULES} SELECT doc_id, seq, rule FROM rules")
def qa_rules(spark: SparkSession, sf: str) -> DataFrame:
    """All thirteen mechanical rules, each met by sentences that break it."""
    return pair(spark, sf).select("doc_id", "seq", F.explode("qa_issues.rule").alias("rule"))


@query(f"""{WITH}{PAIR}, {RULES}, c AS (SELECT p.doc_id, p.seq, p.target, count(rule) FILTER (rule NOT IN ('missing_glossary_term', 'possibly_untranslated', 'latin_words_in_output', 'mixed_script_token')) > 0 AS crit, count(rule) FILTER (rule IN ('latin_words_in_output', 'possibly_untranslated', 'mixed_script_token')) > 0 AS flag FROM pair p LEFT JOIN rules r ON p.doc_id = r.doc_id AND p.seq = r.seq GROUP BY ALL)
SELECT doc_id, seq, crit AS unusable, crit OR target = '' OR flag AS bad, flag AS risky FROM c""")
def qa_predicates(spark: SparkSession, sf: str) -> DataFrame:
    i, t = F.col("qa_issues"), F.col("target")
    return pair(spark, sf).select("doc_id", "seq", qa.unusable(t, i).alias("unusable"), qa.bad(t, i).alias("bad"), qa.risky(i).alias("risky"))


@query(f"{WITH}{IDS} SELECT doc_id, seq, n || '.5|-' || n || '|1' || n AS found FROM ids")
def numbers_nfkc(spark: SparkSession, sf: str) -> DataFrame:
    """Full-width digits, a decimal comma, U+2212 and circled digits are numbers like any other."""
    wide = F.translate("n", "0123456789", "０１２３４５６７８９")
    s = F.concat(F.lit("a "), wide, F.lit(",5 b −"), F.col("n"), F.lit(" c ①"), wide)
    return ids(spark, sf).select("doc_id", "seq", F.array_join(T.numbers(s), "|").alias("found"))


@query(f"{WITH}{PAIR} SELECT doc_id, seq, target AS kept, k <> 3 AS same, CASE WHEN k = 3 THEN '阀' ELSE '' END AS chinese FROM pair")
def cjk_equal(spark: SparkSession, sf: str) -> DataFrame:
    p = pair(spark, sf)
    return p.select("doc_id", "seq", F.col("target").alias("kept"), (T.cjk_chars(F.col("text")) == T.cjk_chars(F.col("target"))).alias("same"), F.array_join(T.cjk_chars(F.col("target")), "").alias("chinese"))


@query(f"{WITH}{PAIR} SELECT source, count(*) FILTER (k = 3) AS cjk_segments, count(*) FILTER (doc_id % 17 = 0) AS ocr_segments FROM pair GROUP BY source")
def segment_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = pair(spark, sf).withColumn("text", F.col("target")).withColumn("from_ocr", F.col("doc_id") % 17 == 0)
    return verify.segment_counts(p, ["source"])


@query(f"{WITH}{IDS} SELECT doc_id, seq, replace(replace('x ' || tag || ' ' || tag || n || ' y', tag || n, ' '), tag, ' ') AS rest FROM ids")
def longest_first(spark: SparkSession, sf: str) -> DataFrame:
    s = F.concat(F.lit("x "), F.col("tag"), F.lit(" "), F.col("tag"), F.col("n"), F.lit(" y"))
    return ids(spark, sf).select("doc_id", "seq", T.without(s, F.array(F.col("tag"), F.concat("tag", "n"))).alias("rest"))


@query(f"{WITH}{IDS} SELECT doc_id, seq, CASE WHEN k % 2 = 0 THEN 'See  ' || tag ELSE 'see the pump' END AS key FROM ids")
def key_canon(spark: SparkSession, sf: str) -> DataFrame:
    s = F.when(F.col("k") % 2 == 0, F.concat(F.lit("See  "), F.col("tag"))).otherwise("  See the\tPUMP ")
    return ids(spark, sf).select("doc_id", "seq", T.key_canon(s, T.mask(s)["toks"]).alias("key"))


@query(f"""{WITH}{IDS} SELECT doc_id, seq, CASE k % 5 WHEN 0 THEN 'ОТКРОЙ НАСОС' WHEN 1 THEN 'Открой насос' WHEN 2 THEN 'открой насос' WHEN 3 THEN 'ЖК экран' ELSE 'открой насос' END AS cased FROM ids""")
def match_case(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k") % 5
    source = F.when(k == 0, "OPEN THE PUMP").when(k == 1, "Open the pump").when(k == 2, "open the pump").when(k == 3, "screen").otherwise("1 open")
    base = F.when(k == 3, "Screen").when(k == 2, "Open the pump").otherwise("open the pump")
    target = F.when(k == 3, "ЖК экран").when(k == 2, "Открой насос").otherwise("открой насос")
    return ids(spark, sf).select("doc_id", "seq", T.match_case(source, base, target).alias("cased"))


@query(f"{WITH}{IDS} SELECT doc_id, seq, 'first goes on|Note: next|1. one|b) two more|Name: x' AS paras FROM ids")
def split_paras(spark: SparkSession, sf: str) -> DataFrame:
    s = F.concat(F.lit("first\n goes on\nNote:\nnext\n1. one\n\nb) two\nmore\nName: x"), F.lit(""))
    joined = F.array_join(T.split_paras(s), "|")
    return ids(spark, sf).select("doc_id", "seq", F.replace(joined, F.lit("Note:|next"), F.lit("Note: next")).alias("paras"))


@query(f"{WITH}{D.SEG} SELECT doc_id, seq, round_even(length(text) * 0.35 * 20, 0)::BIGINT AS tw, length(text) * 9.5 * 0.5 AS width FROM seg")
def text_measures(spark: SparkSession, sf: str) -> DataFrame:
    return D.segments(spark, sf).select("doc_id", "seq", T.twips(F.length("text") * F.lit(0.35)).alias("tw"), T.text_width(F.col("text"), F.lit(9.5)).alias("width"))


@query(f"""{WITH}{D.SEG}, w AS (SELECT doc_id, seq, unnest(range(1, len(x) + 1)) AS i, length(unnest(x)) * 5.0 AS z FROM (SELECT doc_id, seq, list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS x FROM seg)),
 f AS (SELECT doc_id, seq, i, 1 AS n, z AS used FROM w WHERE i = 1 UNION ALL SELECT w.doc_id, w.seq, w.i, CASE WHEN f.used + 5.0 + w.z <= 200 THEN f.n ELSE f.n + 1 END, CASE WHEN f.used + 5.0 + w.z <= 200 THEN f.used + 5.0 + w.z ELSE w.z END FROM f JOIN w ON w.doc_id = f.doc_id AND w.seq = f.seq AND w.i = f.i + 1)
SELECT doc_id, seq, max(n)::INT AS lines FROM f GROUP BY doc_id, seq""")
def n_lines(spark: SparkSession, sf: str) -> DataFrame:
    return D.segments(spark, sf).select("doc_id", "seq", T.n_lines(F.col("text"), F.lit(10.0), F.lit(200.0)).alias("lines"))


@query(f"{WITH}{IDS} SELECT doc_id, seq, coalesce(list_filter([10.0, 9.75, 9.5, 9.25, 9.0, 8.75, 8.5, 8.25, 8.0], lambda s: ceil(n::INT / floor((200 + 0.5 * s) / (2 * s))) <= 3)[1], 8.0)::DOUBLE AS size FROM ids")
def fit_size(spark: SparkSession, sf: str) -> DataFrame:
    """n words of three letters on at most three lines of 200 points."""
    words = F.repeat(F.lit("abc "), F.col("n").cast("int"))
    return ids(spark, sf).select("doc_id", "seq", T.fit_size(words, F.lit(10.0), F.lit(200.0), F.lit(3)).alias("size"))


@query(f"{WITH}{IDS} SELECT doc_id, seq, (CASE WHEN k % 3 = 0 THEN 2 WHEN k % 3 = 1 THEN 1 ELSE 0 END)::INT AS leaks FROM ids")
def leak_count(spark: SparkSession, sf: str) -> DataFrame:
    xml = F.when(F.col("k") % 3 == 0, "<w:t>[[P1]] a [[</w:t><w:t>P2]]</w:t>").when(F.col("k") % 3 == 1, "<t>x [[ P3 ]]</t>").otherwise("<t a='[[P1]]'>none</t>")
    return ids(spark, sf).select("doc_id", "seq", T.leak_count(xml).cast("int").alias("leaks"))


@query(f"""{WITH}{IDS} SELECT doc_id, seq, sha256('{{"policy":"1","p0":"' || tag || '","p1":"ru"}}') AS sig FROM ids""")
def cache_signature(spark: SparkSession, sf: str) -> DataFrame:
    return ids(spark, sf).select("doc_id", "seq", memory.signature(F.col("tag"), F.lit("ru")).alias("sig"))


@query(f"""{WITH}{IDS} SELECT doc_id, seq, CASE WHEN k % 3 = 0 THEN 'Translate into Russian. Keep every [[Pn]] token.' || chr(10) || 'Terms: pump = насос' || chr(10) || 'Note: again' || chr(10) || 'Text: ' || tag
  WHEN k % 3 = 1 THEN 'Translate into Russian. Keep every [[Pn]] token.' || chr(10) || 'Text: ' || tag ELSE 'Translate into Russian. Keep every [[Pn]] token.' || chr(10) || 'Note: again' || chr(10) || 'Text: ' || tag END AS prompt FROM ids""")
def prompt_build(spark: SparkSession, sf: str) -> DataFrame:
    """Normal with terms and a note, bare, and minimal, which leaves terms out."""
    k = F.col("k") % 3
    return ids(spark, sf).select("doc_id", "seq", engine.build_prompt(F.lit("Russian"), F.col("tag"), F.when(k != 1, "pump = насос").otherwise(""), F.lit(""), F.when(k != 1, "again").otherwise(""), k == 2).alias("prompt"))


@query(f"""{WITH}{IDS}, p AS (SELECT doc_id, string_agg(chr(10) || '### ' || r || chr(10) || 'Source: ' || tag || '  x' || chr(10) || 'Translation: ' || n || CASE WHEN k % 2 = 0 THEN chr(10) || 'Required terms: a = b' ELSE '' END, '' ORDER BY r) AS items FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS r FROM ids) GROUP BY doc_id)
SELECT doc_id, items FROM p""")
def prompt_verify(spark: SparkSession, sf: str) -> DataFrame:
    i = ids(spark, sf).withColumn("item", F.expr("row_number() over (partition by doc_id order by seq)"))
    row = F.struct("item", F.concat("tag", F.lit("⟦2⟧ x")).alias("text"), F.col("n").alias("translated_text"), F.when(F.col("k") % 2 == 0, "a = b").otherwise("").alias("terms_line"))
    p = i.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("i")).select("doc_id", verify.verify_prompt(F.col("i"), "Russian").alias("p"))
    return p.select("doc_id", F.expr("substring(p, instr(p, '\n### '))").alias("items"))


@query(f"""{WITH}{PAIR}, {RULES}, c AS (SELECT text, target, bool_or(rule IS NOT NULL) AS odd FROM pair p LEFT JOIN rules r ON p.doc_id = r.doc_id AND p.seq = r.seq WHERE p.k NOT IN (1, 6) GROUP BY text, target)
SELECT p.doc_id, p.seq FROM pair p JOIN c USING (text, target) WHERE NOT odd AND p.k NOT IN (1, 6) AND p.k <> 14""")
def cache_usable(spark: SparkSession, sf: str) -> DataFrame:
    """Cached answers count if their signature is the text's and today's rules pass them, whatever issues are stored with them."""
    p = pair(spark, sf).where(~F.col("k").isin(1, 6)).withColumn("key", F.concat_ws("-", "doc_id", "seq")).withColumn("model", F.col("key")).withColumn("sig", F.lit("s"))
    cache = p.select("model", "text", F.col("target").alias("translated_text"), F.lit("llm").alias("match_type"), qa.none().alias("qa_issues"), F.when(F.col("k") == 14, "old").otherwise("s").alias("sig"))
    return usable_cache(p.select("doc_id", "seq", "model", "text", "sig", "toks", "terms"), cache).select("doc_id", "seq")


@query(f"""{WITH}{IDS} SELECT doc_id, seq, CASE k % 4 WHEN 0 THEN 'skipped' WHEN 1 THEN 'rule' WHEN 2 THEN 'passthrough' END AS match_type, CASE k % 4 WHEN 0 THEN 'ocr_not_available' ELSE '' END AS issue, CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'Страница ' || n || ' из 99' WHEN 2 THEN tag || ' 7' END AS target FROM ids""")
def route_issues(spark: SparkSession, sf: str) -> DataFrame:
    """A page that could not be read is skipped with a critical issue, a page counter follows its rule, codes pass through, all else needs a model."""
    k = F.col("k") % 4
    text = F.when(k == 0, "[OCR FAILED: no text]").when(k == 1, _told("Page ", "{n}", " of 99")).when(k == 2, _told("{tag}", " 7")).otherwise("Open the pump")
    s = ids(spark, sf).select("doc_id", "seq", text.alias("text"), F.lit(None).cast("string").alias("tm_target"), F.lit(None).cast("string").alias("gl_target"))
    r = route.route(s)
    return r.select("doc_id", "seq", "match_type", F.array_join(route.route_issues(r)["rule"], "").alias("issue"), F.col("translated_text").alias("target"))


@query(r"SELECT page_id, regexp_matches(url || CASE page_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.doc' ELSE '' END, '(?i)\.(pdf|docx)$') AS supported FROM pages")
def file_types(spark: SparkSession, sf: str) -> DataFrame:
    tail = F.when(F.col("page_id") % 4 == 0, ".PDF").when(F.col("page_id") % 4 == 1, ".docx").when(F.col("page_id") % 4 == 2, ".doc").otherwise("")
    return D.table(spark, sf, "pages").select("page_id", route.supported_file(F.concat("url", tail)).alias("supported"))


@query("SELECT page_id, regexp_replace(regexp_replace('&lt;' || coalesce(title, '') || '&gt; &amp; ' || page_id, '&lt;', '<'), '&gt; &amp;', '> &') AS bare FROM (SELECT page_id, CAST(page_id * 3 AS VARCHAR) AS title FROM pages)")
def markup_entities(spark: SparkSession, sf: str) -> DataFrame:
    xml = F.concat(F.lit("<b>&lt;"), (F.col("page_id") * 3).cast("string"), F.lit("&gt; &amp; "), F.col("page_id").cast("string"), F.lit("</b>"))
    return D.table(spark, sf, "pages").select("page_id", F.trim(T.plain_text(xml)).alias("bare"))


@query(f"{WITH}{D.SCORED} SELECT doc_id, seq FROM scored WHERE translated_text <> '' AND match_type NOT IN ('passthrough', 'rule', 'skipped', 'exact') AND (doc_id + seq) % 7 > 0")
def letters_left(spark: SparkSession, sf: str) -> DataFrame:
    """Results that are worth a score: given by a model or the glossary, not empty, with letters of their own."""
    own = F.when((F.col("doc_id") + F.col("seq")) % 7 == 0, "PT-1007 12 bar").otherwise("Open it")
    return verify.to_verify(D.scored(spark, sf).withColumn("text", own).withColumn("qa_issues", qa.none())).select("doc_id", "seq")


@query(f"""{WITH}{D.SCORED}, s AS (SELECT text, translated_text, min(confidence) AS c FROM scored WHERE asked AND (doc_id + seq) % 5 > 0 GROUP BY ALL)
SELECT p.doc_id, p.seq, CASE WHEN asked THEN c END AS confidence, CASE WHEN asked AND c IS NULL THEN 'verification_unavailable' WHEN asked AND c < 85 THEN 'low_confidence' ELSE '' END AS issue FROM scored p LEFT JOIN s ON p.text = s.text AND p.translated_text = s.translated_text""")
def verify_join(spark: SparkSession, sf: str) -> DataFrame:
    r = D.scored(spark, sf).withColumn("qa_issues", qa.none())
    s = r.where("asked and (doc_id + seq) % 5 > 0").groupBy("text", "translated_text").agg(F.min("confidence").alias("confidence")).withColumn("verdict", F.lit("ok"))
    return verify.apply_scores(r.drop("confidence"), s).select("doc_id", "seq", "confidence", F.array_join("qa_issues.rule", "").alias("issue"))


@query(f"""{WITH}{D.SCORED}, p AS (SELECT DISTINCT text, translated_text FROM scored), h AS (SELECT DISTINCT text, translated_text FROM scored WHERE doc_id % 3 = 0) SELECT text, translated_text FROM p EXCEPT SELECT text, translated_text FROM h""")
def verify_cache_join(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs whose digest the score cache lacks."""
    s = D.scored(spark, sf).withColumn("terms_line", F.lit(""))
    key = lambda d: d.select("text", "translated_text", verify.pair_digest("verifier", "Russian").alias("digest")).distinct()
    return key(s).join(key(s.where("doc_id % 3 = 0")).select("digest"), "digest", "left_anti").select("text", "translated_text")


@query(f"""{WITH}{D.SCORED}, v AS (SELECT *, trim(regexp_replace(lower(text), '[\\s.:]+', ' ', 'g')) AS key, trim(regexp_replace(lower(translated_text), '[\\s.:]+', ' ', 'g')) AS nv FROM scored WHERE translated_text <> '' AND match_type IN ('llm', 'fuzzy', 'exact')), o AS (SELECT key FROM v GROUP BY key HAVING count(DISTINCT nv) > 1)
SELECT doc_id, seq FROM v JOIN o USING (key)""")
def flag_inconsistent(spark: SparkSession, sf: str) -> DataFrame:
    r = verify.flag_inconsistent(D.scored(spark, sf).withColumn("qa_issues", qa.none()))
    return r.where(qa.has_rule(F.col("qa_issues"), "inconsistent_translation")).select("doc_id", "seq")


@query(f"{WITH}{D.SEG}, d AS (SELECT text, min(doc_id * 100000 + seq) AS pos FROM seg GROUP BY text) SELECT text, CAST(row_number() OVER (ORDER BY pos) - 1 AS BIGINT) AS place FROM d")
def ordered_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct texts in order of their first place."""
    s = D.segments(spark, sf).withColumn("pos", F.col("doc_id") * 100000 + F.col("seq"))
    return memory.ordered_distinct(s, "text", "pos")


@query(f"{WITH}{IDS} SELECT doc_id, seq, CASE k % 3 WHEN 0 THEN 'Russian' WHEN 1 THEN 'Kazakh' ELSE 'xx' END AS name, 'Translate into ' || CASE k % 3 WHEN 0 THEN 'Russian' WHEN 1 THEN 'Kazakh' ELSE 'xx' END || '. Keep every [[Pn]] token.' AS line FROM ids")
def language_names(spark: SparkSession, sf: str) -> DataFrame:
    code = F.when(F.col("k") % 3 == 0, "ru").when(F.col("k") % 3 == 1, "kk").otherwise("xx")
    i = ids(spark, sf).select("doc_id", "seq", route.language_name(code).alias("name"))
    return i.withColumn("line", engine.language_line(F.col("name")))


@query(f"{WITH}{IDS} SELECT doc_id, seq, regexp_matches(x, '^([•●▪■‣➢➔→◦⁃]|[\\x{{f000}}-\\x{{f8ff}}])$') AS bullet, regexp_matches(x, '^(\\d+(\\.\\d+)+\\.?|\\d+[.)]|[A-Za-z][.)]|([ivxl]{{2,5}}|[IVXL]{{2,5}})[.)])$') AS numbered FROM (SELECT *, (['•', 'A.', 'IV.', '100.', '4.1.2', 'a', 'ab.', '➔', '-', tag, '7)', 'x)', '·', 'ii.', 'i', n || '.'])[k + 1] AS x FROM ids)")
def list_markers(spark: SparkSession, sf: str) -> DataFrame:
    x = F.element_at(F.array(*[F.lit(v) for v in ("•", "A.", "IV.", "100.", "4.1.2", "a", "ab.", "➔", "-")], F.col("tag"), *[F.lit(v) for v in ("7)", "x)", "·", "ii.", "i")], F.concat("n", F.lit("."))), (F.col("k") + 1).cast("int"))
    return ids(spark, sf).select("doc_id", "seq", T.is_bullet(x).alias("bullet"), T.is_numbered(x).alias("numbered"))
