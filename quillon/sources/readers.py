"""Small sources: knowledge base files, caches, job state, settings, OCR words, documents as segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import qa

TM = "source_text string, target_text string, status string, origin string"
GLOSSARY = "en_term string, target_term string, notes string, internal_note string, exact_only boolean"
CACHE = f"model string, text string, translated_text string, match_type string, qa_issues {qa.ISSUES}, sig string"
JOB = "job_id string, input_path string, output_dir string, options map<string,string>, status string, progress int, stage string, critical int, moderate int, document_score double, review_required boolean, error string, files map<string,string>, created_at timestamp, started_at timestamp, finished_at timestamp, cancel_requested boolean"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array file with pos, its order; empty if there is no such file; a row of another shape is an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"pos long, {schema}")
    text = spark.read.option("wholetext", True).text(path)
    parsed = text.select(F.posexplode(F.from_json("value", f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>", {"mode": "FAILFAST"})).alias("pos", "r"))
    return parsed.select(F.col("pos").cast("long").alias("pos"), "r.*")


def memory(spark: SparkSession, path: str) -> DataFrame:
    return json_rows(spark, path, TM)


def glossary(spark: SparkSession, path: str) -> DataFrame:
    return json_rows(spark, path, GLOSSARY).withColumn("exact_only", F.coalesce("exact_only", F.lit(False)))


def word_list(spark: SparkSession, path: str, default: tuple[str, ...] = ()) -> list[str]:
    """A JSON array of strings, bounded by its nature; the default if the file is missing or malformed."""
    if not exists(spark, path):
        return list(default)
    row = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "array<string>").alias("w")).first()
    return list(row["w"]) if row and row["w"] else list(default)


def save_rows(df: DataFrame, path: str) -> None:
    """Knowledge base rows as one JSON array in order of pos, as `json_rows` reads it. Such a file is edited by hand and read whole; tables that grow belong in Parquet."""
    rows = F.array_sort(F.collect_list(F.struct("pos", *[c for c in df.columns if c != "pos"])))
    bare = F.transform(rows, lambda r: r.dropFields("pos"))
    df.agg(F.to_json(bare, {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def cache(spark: SparkSession, path: str) -> DataFrame:
    """The cached results; empty where there are none or they can't be read."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    empty = spark.createDataFrame([], CACHE)
    if not exists(spark, path):
        return empty
    try:
        df = spark.read.schema(CACHE).parquet(path)
        df.isEmpty()
        return df
    except (PySparkException, Py4JJavaError):
        return empty


def swap_table(df: DataFrame, root: str, run: str) -> str:
    """Writes a new version beside the old ones and then the pointer to it; readers never meet a half-written table."""
    spark = df.sparkSession
    path = f"{root}/v={run}"
    df.write.mode("errorifexists").parquet(path)
    spark.createDataFrame([(path,)], "path string").coalesce(1).write.mode("overwrite").text(f"{root}/current")
    return path


def current_path(spark: SparkSession, root: str) -> str | None:
    """Where the version lies that the pointer names."""
    row = spark.read.text(f"{root}/current").first() if exists(spark, f"{root}/current") else None
    return row["value"] if row else None


def current_table(spark: SparkSession, root: str) -> DataFrame | None:
    path = current_path(spark, root)
    return spark.read.parquet(path) if path else None


def job_state(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Jobs from their JSON files (one job a file, or one a line): unreadable ones are dropped, unknown fields ignored."""
    return spark.read.schema(JOB).option("mode", "DROPMALFORMED").option("multiLine", not lines).json(path).where(F.col("job_id").isNotNull())


def settings(lines: DataFrame, real: DataFrame | None = None) -> DataFrame:
    """key, value of KEY=value lines (column value): comments and blanks are skipped, quotes stripped, a byte order mark tolerated; a real
    setting wins, then the first line of a key."""
    v = F.trim(F.regexp_replace("value", "^\\x{feff}", ""))
    rows = lines.withColumn("_v", v).where((F.col("_v") != "") & ~F.col("_v").startswith("#") & F.contains("_v", F.lit("=")))
    pair = F.split("_v", "=", 2)
    rows = rows.select(F.trim(pair[0]).alias("key"), F.regexp_replace(F.trim(pair[1]), "^(['\"])(.*)\\1$", "$2").alias("value"), F.col("line") if "line" in lines.columns else F.monotonically_increasing_id().alias("line")).where("key <> ''")
    firsts = rows.groupBy("key").agg(F.min_by("value", "line").alias("value"))
    if real is None:
        return firsts
    return firsts.join(real.select("key", F.col("value").alias("_r")), "key", "left").select("key", F.coalesce("_r", "value").alias("value"))


def ocr_lines(words: DataFrame) -> DataFrame:
    """Lines of OCR words (doc_id, page, block, par, line, i, word, conf): confident words with a letter or digit, joined; lines of three letters or more."""
    good = words.where((F.col("conf") >= 60) & F.col("word").rlike(r"[\p{L}\p{N}]"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda s: s["word"]), " ")
    return good.groupBy("doc_id", "page", "block", "par", "line").agg(line.alias("text")).where(F.regexp_count("text", F.lit(r"\p{L}")) >= 3)


def ocr_stub(pages: DataFrame) -> DataFrame:
    """A page that OCR failed on is one row that says so, not an error."""
    return pages.select("doc_id", "page", F.concat(F.lit("[OCR FAILED: "), F.coalesce("error", F.lit("unknown")), F.lit("]")).alias("text"), F.lit(True).alias("from_ocr"))


def scanned_pages(words: DataFrame, pages: DataFrame, least: int = 10) -> DataFrame:
    """Pages with fewer text characters than a real text page has."""
    n = words.groupBy("doc_id", "page").agg(F.sum(F.length("text")).alias("n"))
    return pages.join(n, ["doc_id", "page"], "left").where(F.coalesce("n", F.lit(0)) < least).drop("n")


_BOX = "doc_id long, page int, x0 double, x1 double, top double, bottom double"
#: What is on a page, as a tool that reads PDF geometry exports it: one JSON object a line for each word, glyph, cell, rule, span or picture.
GEOMETRY = {
    "words": f"{_BOX}, text string, upright boolean, size double", "chars": f"{_BOX}, seq long, text string, upright boolean, up boolean",
    "cells": f"{_BOX}, table_id int, row int, col int, text string", "edges": f"{_BOX}, edge_id long, orientation string, linewidth double",
    "spans": f"{_BOX}, text string, size double, bold boolean, family string", "images": f"{_BOX}, image_id long", "pages": "doc_id long, page int, width double, height double",
}


def geometry(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The geometry table of a kind; lines that are no JSON are dropped, unknown fields ignored."""
    return spark.read.schema(GEOMETRY[kind]).option("mode", "DROPMALFORMED").json(path)


def page_segments(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """Segments of laid-out pages: table cells first, row by row, then blocks; blank ones dropped, texts stripped; seq is that order."""
    from pyspark.sql import Window

    strip = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    c = cells.select("doc_id", "page", strip.alias("text"), F.lit("table_cell").alias("kind"), F.lit(0).alias("_o"), "table_id", "row", "col", F.format_string("p%d/t%d/r%d/c%d", "page", "table_id", "row", "col").alias("location"))
    b = blocks.select("doc_id", "page", strip.alias("text"), F.lit("paragraph").alias("kind"), F.lit(1).alias("_o"), F.col("block_id").cast("int").alias("table_id"), F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("col"), F.format_string("p%d/b%d", "page", "block_id").alias("location"))
    rows = c.unionByName(b).where("text <> ''")
    order = Window.partitionBy("doc_id").orderBy("page", "_o", "table_id", "row", "col")
    return rows.withColumn("seq", F.row_number().over(order) - 1).withColumn("table_id", F.when(F.col("_o") == 0, F.col("table_id"))).drop("_o")


def segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """Non-blank lines of documents, stripped; seq is the line's place. Narrow: no shuffle."""
    lines = docs.select(id_col, *keep, F.posexplode(F.split(F.col(text_col), "\n")).alias("seq", "raw"))
    strip = F.btrim("raw", F.lit(" \t\r\n\f\x0b"))
    return lines.select(id_col, *keep, F.col("seq").cast("long").alias("seq"), strip.alias("text")).where("text <> ''")
