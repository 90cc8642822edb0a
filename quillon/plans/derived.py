"""Tables that the queries work on, derived from the driver's tables; each has its SQL beside it.

The tables hold no Cyrillic and few codes, so translations are derived by transliteration, with defects planted by arithmetic on ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.sources import readers

LATIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
CYRILLIC = "абцдефгхижклмнопярстувщьызАБЦДЕФГХИЖКЛМНОПЯРСТУВЩЬЫЗ"
GLOSSARY = [("that", "то"), ("with", "вместе"), ("this", "это"), ("from", "откуда"), ("in the", "внутри"), ("of the", "принадлежащий"), ("the and", "союз"), ("and the", "сочетание"), ("by the", "рядом"), ("to be", "существовать"), ("and", "и"), ("is", "есть"), ("as a", "словно"), ("with the", "совместно")]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def segments(spark: SparkSession, sf: str) -> DataFrame:
    return readers.segments(table(spark, sf, "documents"), "doc_id", "text", "source", "lang")


SEG = r"""seg AS (
  SELECT doc_id, source, lang, seq, text FROM (
    SELECT doc_id, source, lang, unnest(range(0, len(l))) AS seq, regexp_replace(unnest(l), '^[ \t\r\n\f\x0b]+|[ \t\r\n\f\x0b]+$', '', 'g') AS text
    FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS l FROM documents)) WHERE text <> '')"""


def transliterated(text: Column) -> Column:
    return F.translate(text, LATIN, CYRILLIC)


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Segments with a translation; what is wrong with it follows from doc_id and seq."""
    s = segments(spark, sf).withColumn("k", (F.col("doc_id") * 7 + F.col("seq")) % 13)
    t = transliterated(F.col("text"))
    target = (
        F.when(F.col("k") == 0, F.regexp_replace(t, "[0-9]+", "")).when(F.col("k") == 1, F.concat(t, F.lit(" [[P0]]"))).when(F.col("k") == 2, F.col("text"))
        .when(F.col("k") == 3, "").when(F.col("k") == 4, F.concat(F.repeat(F.concat(t, F.lit(" ")), 7), F.repeat(F.lit("щ"), 220))).when(F.col("k") == 5, F.left(t, F.floor(F.length(t) / 5).cast("int")))
        .when(F.col("k") == 6, F.concat(t, F.lit(" Dжem")))
        .otherwise(t)
    )
    return s.withColumn("target", target)


PAIRS = (
    SEG
    + f""", pairs AS (
  SELECT *, CASE k WHEN 0 THEN regexp_replace(t, '[0-9]+', '', 'g') WHEN 1 THEN t || ' [[P0]]' WHEN 2 THEN text WHEN 3 THEN '' WHEN 4 THEN repeat(t || ' ', 7) || repeat('щ', 220)
         WHEN 5 THEN left(t, length(t) // 5) WHEN 6 THEN t || ' Dжem' ELSE t END AS target
  FROM (SELECT *, (doc_id * 7 + seq) % 13 AS k, translate(text, '{LATIN}', '{CYRILLIC}') AS t FROM seg))"""
)


def memory(spark: SparkSession, sf: str) -> DataFrame:
    """Approved sentence pairs from the lines of `benchmark`."""
    rows = readers.segments(table(spark, sf, "benchmark"), "item_id", "text")
    return rows.select((F.col("item_id") * 1000 + F.col("seq")).alias("pos"), F.col("text").alias("source_text"), transliterated(F.col("text")).alias("target_text"), F.when(F.col("item_id") % 5 == 0, "draft").otherwise("approved").alias("status"))


TM = rf"""tm AS (
  SELECT item_id * 1000 + seq AS pos, text AS source_text, translate(text, '{LATIN}', '{CYRILLIC}') AS target_text, CASE WHEN item_id % 5 = 0 THEN 'draft' ELSE 'approved' END AS status
  FROM (SELECT item_id, unnest(range(0, len(l))) AS seq, regexp_replace(unnest(l), '^[ \t\r\n\f\x0b]+|[ \t\r\n\f\x0b]+$', '', 'g') AS text FROM (SELECT item_id, string_split(text, chr(10)) AS l FROM benchmark)) WHERE text <> '')"""


def glossary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, a, b, False) for i, (a, b) in enumerate(GLOSSARY)], "pos long, en_term string, target_term string, exact_only boolean")


GLOSS = "gloss(pos, en_term, target_term) AS (VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(GLOSSARY)) + ")"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Segments with translation, route and a confidence that follows from ids; every ninth has none."""
    p = pairs(spark, sf)
    h = (F.col("doc_id") * 31 + F.col("seq") * 17) % 101
    kind = F.element_at(F.array(F.lit("llm"), F.lit("fuzzy"), F.lit("exact"), F.lit("rule"), F.lit("passthrough")), ((F.col("doc_id") + F.col("seq")) % 5 + 1).cast("int"))
    c = F.when((F.col("doc_id") + F.col("seq")) % 9 == 0, F.lit(None)).otherwise(F.least(F.lit(100), 40 + h)).cast("int")
    return p.select("doc_id", "source", "seq", "text", F.col("target").alias("translated_text"), kind.alias("match_type"), c.alias("confidence"), ((F.col("doc_id") + F.col("seq")) % 3 > 0).alias("asked"), (F.col("doc_id") % 17 == 0).alias("from_ocr"), F.concat(F.lit("p"), F.floor(F.col("seq") / 12).cast("string")).alias("location"))


SCORED = (
    PAIRS
    + """, scored AS (
  SELECT doc_id, source, seq, text, target AS translated_text, (['llm', 'fuzzy', 'exact', 'rule', 'passthrough'])[(doc_id + seq) % 5 + 1] AS match_type,
         CASE WHEN (doc_id + seq) % 9 = 0 THEN NULL ELSE least(100, 40 + (doc_id * 31 + seq * 17) % 101) END::INT AS confidence,
         (doc_id + seq) % 3 > 0 AS asked, doc_id % 17 = 0 AS from_ocr, 'p' || (seq // 12) AS location
  FROM pairs)"""
)


def _grid(name: str) -> str:
    return {
        "page": "cast(seq div 12 as int)", "top": "cast((seq % 12) * 14 as double)", "x0": "cast(50 + (length(text) % 7) * 40 as double)",
        "x1": "cast(50 + (length(text) % 7) * 40 + least(length(text) * 3, 200) as double)",
    }[name]


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Segments laid out as blocks: twelve lines a page, two of them on one row."""
    s = segments(spark, sf)
    row = "cast(((seq % 12) div 2) * 28 as double)"
    return s.select("doc_id", F.expr(_grid("page")).alias("page"), F.col("seq").alias("block_id"), "seq", "text", F.expr(f"{_grid('x0')} + (seq % 2) * 260").alias("x0"), F.expr(f"{_grid('x1')} + (seq % 2) * 260").alias("x1"), F.expr(row).alias("top"), F.expr(f"{row} + 12").alias("bottom"), F.lit(1).alias("nlines"))


BLOCKS = (
    SEG
    + """, blocks AS (
  SELECT doc_id, CAST(seq // 12 AS INT) AS page, seq AS block_id, seq, text, (50 + (length(text) % 7) * 40 + (seq % 2) * 260)::DOUBLE AS x0,
         (50 + (length(text) % 7) * 40 + least(length(text) * 3, 200) + (seq % 2) * 260)::DOUBLE AS x1,
         (((seq % 12) // 2) * 28)::DOUBLE AS top, (((seq % 12) // 2) * 28 + 12)::DOUBLE AS bottom, 1 AS nlines FROM seg)"""
)


def words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the segments on a fixed pitch."""
    s = segments(spark, sf).select("doc_id", "seq", F.posexplode(F.split("text", " ")).alias("i", "text"))
    return s.select("doc_id", F.expr("cast(seq div 12 as int)").alias("page"), "seq", "i", "text", F.expr("cast(40 + (i % 12) * 45 as double)").alias("x0"), F.expr("cast(40 + (i % 12) * 45 + least(length(text) * 5, 44) as double)").alias("x1"), F.expr("cast((seq % 12) * 60 + (i div 12) * 12 as double)").alias("top"), F.expr("cast((seq % 12) * 60 + (i div 12) * 12 + 10 as double)").alias("bottom"), F.expr("(seq + i) % 23 <> 0").alias("upright"), F.lit(10.0).alias("size"))


WORDS = (
    SEG
    + """, words AS (
  SELECT doc_id, CAST(seq // 12 AS INT) AS page, seq, i, text, (40 + (i % 12) * 45)::DOUBLE AS x0, (40 + (i % 12) * 45 + least(length(text) * 5, 44))::DOUBLE AS x1,
         ((seq % 12) * 60 + (i // 12) * 12)::DOUBLE AS top, ((seq % 12) * 60 + (i // 12) * 12 + 10)::DOUBLE AS bottom, (seq + i) % 23 <> 0 AS upright
  FROM (SELECT doc_id, seq, unnest(range(0, len(w))) AS i, unnest(w) AS text FROM (SELECT doc_id, seq, string_split(text, ' ') AS w FROM seg)))"""
)


def laid(spark: SparkSession, sf: str) -> DataFrame:
    """Words set one after the other, twelve a row, with list marks, wide gaps, page counters and tops that waver by a point."""
    w = words(spark, sf).drop("x0", "x1", "top", "bottom")
    mark = F.when(F.expr("i % 12 = 0 and seq % 7 = 1"), F.concat(F.lit("4."), (F.col("seq") % 9 + 1).cast("string"))).when(F.expr("i % 12 = 0 and seq % 7 = 2"), F.concat(F.lit("•"), F.col("text")))
    mark = mark.when(F.expr("i % 12 = 0 and seq % 7 = 3"), "a)").when(F.expr("i % 12 = 9 and seq % 11 = 5"), "Page").otherwise(F.col("text"))
    w = w.withColumn("text", mark).withColumn("row", F.expr("i div 12"))
    wide = F.expr("length(text) * 5 + 4 + if(i % 12 = 0 and seq % 7 in (1, 3), 30, 0) + if(i % 12 = 5 and seq % 5 = 0, 20, 0)")
    at = F.coalesce(F.sum(wide).over(Window.partitionBy("doc_id", "seq", "row").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    w = w.withColumn("x0", (40 + at).cast("double"))
    top = "cast((seq % 12) * 40000 + row * 12 + i % 2 as double)"
    size = F.when(F.col("seq") % 4 == 0, 12.0).otherwise(10.0)
    return w.select("doc_id", "page", "text", "x0", (F.col("x0") + F.length("text") * 5).alias("x1"), F.expr(top).alias("top"), (F.expr(top) + 10).alias("bottom"), "upright", size.alias("size"))


LAID = (
    WORDS
    + """, marked AS (
  SELECT doc_id, page, seq, i, i // 12 AS row, upright, CASE WHEN i % 12 = 0 AND seq % 7 = 1 THEN '4.' || (seq % 9 + 1) WHEN i % 12 = 0 AND seq % 7 = 2 THEN '•' || text WHEN i % 12 = 0 AND seq % 7 = 3 THEN 'a)' WHEN i % 12 = 9 AND seq % 11 = 5 THEN 'Page' ELSE text END AS text FROM words),
 laid AS (
  SELECT doc_id, page, text, x0, x0 + length(text) * 5 AS x1, top, top + 10 AS bottom, upright, CASE WHEN seq % 4 = 0 THEN 12.0 ELSE 10.0 END::DOUBLE AS size
  FROM (SELECT *, (40 + coalesce(sum(length(text) * 5 + 4 + CASE WHEN i % 12 = 0 AND seq % 7 IN (1, 3) THEN 30 ELSE 0 END + CASE WHEN i % 12 = 5 AND seq % 5 = 0 THEN 20 ELSE 0 END) OVER (PARTITION BY doc_id, seq, row ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS x0,
    ((seq % 12) * 40000 + row * 12 + i % 2)::DOUBLE AS top FROM marked))"""
)


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """One table of two by two cells on each page."""
    p = segments(spark, sf).select("doc_id", F.expr("cast(seq div 12 as int)").alias("page")).distinct()
    return p.select("doc_id", "page", F.lit(0).alias("table_id"), F.expr("cast(100 + (doc_id % 5) * 10 as double)").alias("x0"), F.expr("cast(300 + (doc_id % 5) * 10 as double)").alias("x1"), F.expr("cast(50 + (page % 3) * 20 as double)").alias("top"), F.expr("cast(210 + (page % 3) * 20 as double)").alias("bottom"))


BOXES = """, boxes AS (
  SELECT DISTINCT doc_id, CAST(seq // 12 AS INT) AS page, 0 AS table_id, (100 + (doc_id % 5) * 10)::DOUBLE AS x0, (300 + (doc_id % 5) * 10)::DOUBLE AS x1,
         (50 + ((seq // 12) % 3) * 20)::DOUBLE AS top, (210 + ((seq // 12) % 3) * 20)::DOUBLE AS bottom FROM seg)"""


def cells(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf).withColumn("row", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("col", F.explode(F.array(F.lit(0), F.lit(1))))
    return b.select("doc_id", "page", "table_id", "row", "col", (F.col("x0") + F.col("col") * 100).alias("x0"), (F.col("x0") + F.col("col") * 100 + 100).alias("x1"), (F.col("top") + F.col("row") * 80).alias("top"), (F.col("top") + F.col("row") * 80 + 80).alias("bottom"))


CELLS = BOXES + """, cells AS (
  SELECT doc_id, page, table_id, r AS "row", c AS "col", x0 + c * 100 AS x0, x0 + c * 100 + 100 AS x1, top + r * 80 AS top, top + r * 80 + 80 AS bottom
  FROM boxes, (VALUES (0), (1)) a(r), (VALUES (0), (1)) b(c))"""


def job_events(spark: SparkSession, sf: str) -> DataFrame:
    """A simulation: users' events as reports of jobs, one job for each user and day."""
    e = table(spark, sf, "events")
    job = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd"))
    first = F.expr("row_number() over (partition by user_id, date_format(ts, 'yyyyMMdd') order by ts, event_id)")
    e = e.withColumn("job_id", job).withColumn("n", first)
    kind = F.when(F.col("n") == 1, "submit").when(F.col("n") == 2, "start").when(F.col("event_type") == "error", "fail").when(F.col("event_id") % 11 == 0, "cancel").when(F.col("event_id") % 7 == 0, "finish").otherwise("progress")
    return e.select("job_id", "ts", F.col("event_id").alias("ord"), kind.alias("kind"), F.col("event_type").alias("stage"), (F.col("event_id") % 130).cast("int").alias("percent"), F.when(F.col("event_type") == "error", F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error"))


JOBS = """jobs AS (
  SELECT job_id, ts, event_id AS ord, CASE WHEN n = 1 THEN 'submit' WHEN n = 2 THEN 'start' WHEN event_type = 'error' THEN 'fail' WHEN event_id % 11 = 0 THEN 'cancel' WHEN event_id % 7 = 0 THEN 'finish' ELSE 'progress' END AS kind,
         event_type AS stage, CAST(event_id % 130 AS INT) AS percent, CASE WHEN event_type = 'error' THEN 'e' || event_id END AS error
  FROM (SELECT *, user_id || '-' || strftime(ts, '%Y%m%d') AS job_id, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y%m%d') ORDER BY ts, event_id) AS n FROM events))"""
