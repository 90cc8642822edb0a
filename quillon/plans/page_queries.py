"""Queries over pages, files, tables of a knowledge base and state: what the readers, writers and page operators have not met elsewhere."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import qa
from quillon.functions import text as T
from quillon.operators import engine, layout as L, memory, verify
from quillon.sources import docx, readers, sinks

from . import derived as D
from .registry import query

WITH = "WITH RECURSIVE "


def _folder(spark: SparkSession) -> str:
    return f"{engine.shared_dir(spark).rstrip('/')}/quillon/{uuid.uuid4().hex}"


# Pages


@query(f"""{WITH}{D.BLOCKS}{D.CELLS}, r AS (SELECT doc_id, page, 0 AS o, table_id AS a, "row" AS r, "col" AS c, 'c' || "row" || "col" AS text, 'table_cell' AS kind FROM cells WHERE ("row" + "col") % 3 <> 2 UNION ALL SELECT doc_id, page, 1, block_id, NULL, NULL, text, 'paragraph' FROM blocks)
SELECT doc_id, page, kind, text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, o, a, r, c) - 1 AS INT) AS seq FROM r""")
def page_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Table cells of a page first, row by row, then its blocks; blank cells dropped."""
    cell = F.concat(F.lit(" c"), F.col("row").cast("string"), F.col("col").cast("string"), F.lit("\n"))
    cells = D.cells(spark, sf).withColumn("text", F.when((F.col("row") + F.col("col")) % 3 == 2, "  ").otherwise(cell))
    return readers.page_segments(cells, D.blocks(spark, sf)).select("doc_id", "page", "kind", "text", F.col("seq").cast("int").alias("seq"))


@query(f"{WITH}{D.WORDS}, p AS (SELECT DISTINCT doc_id, page FROM words UNION SELECT doc_id, 9999 FROM documents), n AS (SELECT doc_id, page, sum(length(text)) AS n FROM words WHERE seq % 12 < 1 AND i < 2 GROUP BY ALL) SELECT p.doc_id, p.page, '[OCR FAILED: no reader]' AS text FROM p LEFT JOIN n USING (doc_id, page) WHERE coalesce(n, 0) < 10")
def scanned_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with hardly any text, each as the one row that says that it could not be read."""
    w = D.words(spark, sf)
    pages = w.select("doc_id", "page").distinct().unionByName(D.table(spark, sf, "documents").select("doc_id", F.lit(9999).alias("page"))).distinct()
    return readers.ocr_stub(readers.scanned_pages(w.where("seq % 12 < 1 and i < 2"), pages).withColumn("error", F.lit("no reader"))).select("doc_id", "page", "text")


@query(f"{WITH}{D.WORDS} SELECT doc_id, page, text, x0, x1, top, bottom, upright FROM words")
def geometry_files(spark: SparkSession, sf: str) -> DataFrame:
    """Words of pages from JSON lines, one of which is broken."""
    path = _folder(spark)
    lines = D.words(spark, sf).select(F.to_json(F.struct("doc_id", "page", "top", "bottom", "upright", "size", F.lit(1).alias("odd"), "x0", "x1", "text")).alias("value"))
    # What seldom changes stands first, so that compression meets it as one stretch.
    lines.unionByName(spark.createDataFrame([("{broken",)], "value string")).write.text(path, compression="gzip")
    return readers.geometry(spark, path, "words").select("doc_id", "page", "text", "x0", "x1", "top", "bottom", "upright")


@query(f"""{WITH}{D.BLOCKS}, s AS (SELECT doc_id, page, block_id AS sid, x0 + 2 AS x0, x1 - 2 AS x1, top, bottom, 8 + block_id % 3 AS size, block_id % 2 = 0 AS bold, length(text) AS n FROM blocks WHERE block_id % 4 <> 3),
 j AS (SELECT b.doc_id, b.page, b.block_id, arg_max(s.size, (s.n, s.size)) AS size, arg_max(s.bold, (s.n, s.size)) AS bold FROM blocks b JOIN s ON b.doc_id = s.doc_id AND b.page = s.page AND (s.x0 + s.x1) / 2 BETWEEN b.x0 AND b.x1 AND (s.top + s.bottom) / 2 BETWEEN b.top AND b.bottom GROUP BY ALL)
SELECT b.doc_id, b.page, b.block_id, coalesce(j.size, 10)::DOUBLE AS size, coalesce(j.bold, false) AS bold FROM blocks b LEFT JOIN j USING (doc_id, page, block_id)""")
def font_style(spark: SparkSession, sf: str) -> DataFrame:
    b = D.blocks(spark, sf)
    s = b.where("block_id % 4 <> 3").select("doc_id", "page", "text", (F.col("x0") + 2).alias("x0"), (F.col("x1") - 2).alias("x1"), "top", "bottom", (8 + F.col("block_id") % 3).cast("double").alias("size"), (F.col("block_id") % 2 == 0).alias("bold"), F.lit("sans").alias("family"))
    return L.font_style(b.drop("text"), s).select("doc_id", "page", "block_id", "size", "bold")


@query(f"""{WITH}{D.SEG}, x AS (SELECT doc_id, seq, (doc_id + seq) % 4 AS k FROM seg) SELECT doc_id, seq, CASE k WHEN 0 THEN 'center' WHEN 1 THEN 'justify' ELSE 'left' END AS align, CASE k WHEN 1 THEN 15.0 WHEN 2 THEN -20.0 ELSE 0.0 END::DOUBLE AS indent FROM x""")
def block_align(spark: SparkSession, sf: str) -> DataFrame:
    """Lines about the page's middle, lines that end at the column's edge with a first-line indent, and hanging ones."""
    k = (F.col("doc_id") + F.col("seq")) % 4
    of = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    x0s = F.when(k == 0, of(200)).when(k == 1, of(65, 50, 50)).when(k == 2, of(50, 70, 70)).otherwise(of(50, 51, 50))
    x1s = F.when(k == 0, of(400)).when(k == 1, of(550, 549, 300)).when(k == 2, of(550, 400, 300)).otherwise(of(300, 549, 550))
    s = D.segments(spark, sf).withColumn("x0s", x0s).withColumn("x1s", x1s)
    return s.select("doc_id", "seq", L.block_align(F.col("x0s"), F.col("x1s"), F.lit(50.0), F.lit(550.0), F.lit(600.0), F.lit(False)).alias("align"), L.indent(F.col("x0s")).alias("indent"))


@query(f"""{WITH}{D.BLOCKS}{D.BOXES}, e AS (SELECT doc_id, page, block_id, x0, x1, bottom + 1 AS top FROM blocks UNION ALL SELECT doc_id, page, -block_id - 1, x0, x0 + 30 + block_id % 30, bottom + 9 FROM blocks)
SELECT e.doc_id, e.page, e.block_id AS edge_id FROM e WHERE x1 - x0 > 40 AND block_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.doc_id = e.doc_id AND b.page = e.page AND e.x0 >= b.x0 - 2 AND e.x1 <= b.x1 + 2 AND e.top >= b.top - 2 AND e.top <= b.bottom + 2)""")
def standalone_rules(spark: SparkSession, sf: str) -> DataFrame:
    b = D.blocks(spark, sf)
    e = b.select("doc_id", "page", F.col("block_id").alias("edge_id"), "x0", "x1", (F.col("bottom") + 1).alias("top")).unionByName(b.select("doc_id", "page", (-F.col("block_id") - 1).alias("edge_id"), "x0", (F.col("x0") + 30 + F.col("block_id") % 30).alias("x1"), (F.col("bottom") + 9).alias("top")))
    e = e.withColumn("orientation", F.lit("h"))
    return L.standalone_rules(e, D.boxes(spark, sf), e.where("edge_id % 3 = 0")).select("doc_id", "page", "edge_id")


@query(f"""{WITH}{D.BLOCKS}{D.BOXES}, p AS (SELECT *, 400.0 + (doc_id % 4) * 200 AS h, 300.0 + (page % 3) * 300 AS w FROM boxes)
SELECT doc_id, page FROM p WHERE (x1 - x0) * (bottom - top) < 0.6 * w * h AND top >= 0.06 * h AND bottom <= 0.92 * h AND NOT EXISTS (SELECT 1 FROM blocks b WHERE b.doc_id = p.doc_id AND b.page = p.page AND block_id % 6 = 0 AND p.x0 < b.x1 AND p.x1 > b.x0 AND p.top < b.bottom AND p.bottom > b.top)""")
def movable_pictures(spark: SparkSession, sf: str) -> DataFrame:
    p = D.boxes(spark, sf).withColumnRenamed("table_id", "image_id")
    pages = p.select("doc_id", "page", (300.0 + (F.col("page") % 3) * 300).alias("width"), (400.0 + (F.col("doc_id") % 4) * 200).alias("height"))
    return L.movable_pictures(p, pages, D.blocks(spark, sf).where("block_id % 6 = 0")).select("doc_id", "page")


@query(f"{WITH}{D.BLOCKS}, p AS (SELECT doc_id, unnest(range(0, 3))::INT AS page FROM documents) SELECT p.doc_id, p.page FROM p WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE b.doc_id = p.doc_id AND b.page = p.page)")
def drawing_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = D.table(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("page"))
    return L.drawing_pages(pages, D.words(spark, sf).select("doc_id", "page").distinct())


@query(f"{WITH}{D.SCORED} SELECT doc_id, (seq // 12)::INT AS page, string_agg(translated_text, chr(10) ORDER BY seq) AS text FROM scored WHERE from_ocr GROUP BY doc_id, seq // 12")
def ocr_page_text(spark: SparkSession, sf: str) -> DataFrame:
    return L.ocr_page_text(D.scored(spark, sf).withColumn("page", F.expr("cast(seq div 12 as int)")))


@query(f"""{WITH}{D.SEG}{D.CELLS} SELECT doc_id, page, "row", "col", CASE WHEN ("row" + doc_id) % 2 = 0 THEN 'a b' ELSE 'a ' || chr(10) || ' b' END AS text FROM cells""")
def table_cells(spark: SparkSession, sf: str) -> DataFrame:
    c = D.cells(spark, sf).withColumn("text", F.lit("a \n b"))
    r = c.where("(row + doc_id) % 2 = 0").select("doc_id", "page", "table_id", "row", "col", F.lit(True).alias("rotated"))
    return L.table_cells(c, r).select("doc_id", "page", "row", "col", "text")


@query(f"""{WITH}{D.SEG}{D.CELLS} SELECT doc_id, page, "row", max(10 + (doc_id + "col" * 7) % 13)::DOUBLE AS height FROM cells GROUP BY ALL""")
def row_need(spark: SparkSession, sf: str) -> DataFrame:
    return L.row_need(D.cells(spark, sf).withColumn("height", (10 + (F.col("doc_id") + F.col("col") * 7) % 13).cast("double"))).select("doc_id", "page", "row", "height")


#: Two tables at the same place on every page, and a third that wanders; texts that reach into the head of some pages.
BANDS = f"""{D.SEG}, pg AS (SELECT DISTINCT doc_id, (seq // 12)::INT AS page FROM seg), tb AS (SELECT doc_id, page, 1 AS t, 10.0 AS x0, 90.0 AS x1, 20.0 AS top, 60.0 AS bottom FROM pg UNION ALL SELECT doc_id, page, 2, 10.0, 90.0, 940.0, 980.0 FROM pg UNION ALL SELECT doc_id, page, 3, 10.0 + page * 20, 90.0, 300.0 + page * 30, 420.0 FROM pg)"""


@query(f"""{WITH}{BANDS}, k AS (SELECT doc_id, t, count(*) AS n FROM tb WHERE t < 3 GROUP BY ALL), np AS (SELECT doc_id, count(*) AS pages FROM pg GROUP BY 1), fl AS (SELECT doc_id, page, 30.0 AS top, 50.0 AS bottom FROM pg WHERE (doc_id + page) % 5 = 0)
SELECT tb.doc_id, tb.page, t, CASE WHEN np.pages < 2 OR t = 3 OR fl.top IS NOT NULL THEN 'body' WHEN t = 1 THEN 'header' ELSE 'footer' END AS place FROM tb JOIN np USING (doc_id) LEFT JOIN fl ON fl.doc_id = tb.doc_id AND fl.page = tb.page""")
def header_footer_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Tables that repeat become header and footer, but for pages whose text reaches into them."""
    pages = D.segments(spark, sf).select("doc_id", F.expr("cast(seq div 12 as int)").alias("page")).distinct().withColumn("height", F.lit(1000.0))
    at = lambda t, x0, top, bottom: pages.select("doc_id", "page", F.lit(t).alias("t"), x0.cast("double").alias("x0"), F.lit(90.0).alias("x1"), top.cast("double").alias("top"), F.lit(bottom).alias("bottom"))
    tb = at(1, F.lit(10), F.lit(20), 60.0).unionByName(at(2, F.lit(10), F.lit(940), 980.0)).unionByName(at(3, 10 + F.col("page") * 20, 300 + F.col("page") * 30, 420.0))
    flow = pages.where("(doc_id + page) % 5 = 0").select("doc_id", "page", F.lit(30.0).alias("top"), F.lit(50.0).alias("bottom"))
    return L.header_footer_tables(tb, L.repeat_tables(tb, pages), pages, flow).select("doc_id", "page", "t", "place")


@query(f"""{WITH}{BANDS} SELECT doc_id, t, 10 // 4 * 0 + 2 AS k_x0, count(*) AS n FROM tb WHERE t < 3 GROUP BY doc_id, t HAVING count(*) >= 2""")
def repeat_tables_planted(spark: SparkSession, sf: str) -> DataFrame:
    """The tables planted on every page are found, the one that wanders is not."""
    pages = D.segments(spark, sf).select("doc_id", F.expr("cast(seq div 12 as int)").alias("page")).distinct()
    tb = pages.select("doc_id", "page", F.explode(F.array(*[F.struct(x.cast("double").alias("x0"), F.lit(90.0).alias("x1"), t.cast("double").alias("top"), F.lit(b).alias("bottom")) for x, t, b in ((F.lit(10), F.lit(20), 60.0), (F.lit(10), F.lit(940), 980.0), (10 + F.col("page") * 20, 300 + F.col("page") * 30, 420.0))])).alias("b")).select("doc_id", "page", "b.*")
    return L.repeat_tables(tb, pages).select("doc_id", F.when(F.col("k_top") == 5, 1).otherwise(2).alias("t"), F.col("k_x0").cast("int").alias("k_x0"), "n")


@query(f"""{WITH}{D.SEG}, x AS (SELECT doc_id, seq, 'XT' || (100 + seq) AS code FROM seg WHERE (doc_id + seq) % 4 = 0) SELECT doc_id, seq, 1 AS n_codes FROM x""")
def homoglyphs_planted(spark: SparkSession, sf: str) -> DataFrame:
    """A code with Latin letters of which the target has only the Cyrillic look-alikes, in every fourth segment."""
    s = D.segments(spark, sf)
    code = F.concat(F.lit("XT"), (100 + F.col("seq")).cast("string"))
    target = F.when((F.col("doc_id") + F.col("seq")) % 4 == 0, F.translate(code, *T.LOOKALIKE)).otherwise(code)
    return s.select("doc_id", "seq", F.size(T.lookalikes(F.concat(F.lit("use "), code), target)).alias("n_codes")).where("n_codes > 0")


@query(f"""{WITH}{D.BLOCKS}, s AS (SELECT doc_id, page, block_id // 4 AS grid, block_id % 4 // 2 AS row, block_id % 2 AS col, text FROM blocks)
SELECT doc_id, page, grid::INT AS grid, row::INT AS row, col::INT AS col, text FROM s""")
def grid_table(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of a grid with their texts, widths and heights; here the texts, joined with what continues them."""
    b = D.blocks(spark, sf).withColumn("size", F.lit(10.0))
    g = b.select("doc_id", "page", "block_id", F.expr("cast(block_id div 4 as int)").alias("grid"), F.expr("cast(block_id % 4 div 2 as int)").alias("row"), F.expr("cast(block_id % 2 as int)").alias("col"), F.lit(False).alias("continuation"))
    return L.grid_table(g, b).select("doc_id", "page", "grid", "row", "col", "text")


# Files


@query(f"{WITH}{D.TM} SELECT CAST(row_number() OVER (ORDER BY pos) - 1 AS BIGINT) AS pos, source_text, target_text, status FROM tm")
def kb_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A memory saved as a JSON array file and loaded again, in order."""
    path = _folder(spark)
    readers.save_rows(D.memory(spark, sf).select("pos", "source_text", "target_text", "status", F.lit("test").alias("origin")), path)
    return readers.memory(spark, path).select("pos", "source_text", "target_text", "status")


@query(f"{WITH}{D.SEG}, w AS (SELECT DISTINCT source AS word FROM seg WHERE source IS NOT NULL) SELECT word FROM w UNION ALL SELECT 'hart' UNION ALL SELECT 'npt'")
def term_lists(spark: SparkSession, sf: str) -> DataFrame:
    """A word list from its JSON file, and the default where the file is missing."""
    path = _folder(spark)
    words = D.segments(spark, sf).where("source is not null").agg(F.to_json(F.sort_array(F.collect_set("source"))).alias("value"))
    words.coalesce(1).write.text(path)
    return spark.createDataFrame([(w,) for w in [*readers.word_list(spark, path), *readers.word_list(spark, path + "-none", ("hart", "npt"))]], "word string")


@query(f"{WITH}{D.SEG} SELECT DISTINCT text, length(text) % 5 AS n FROM seg")
def cache_table(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of a cache table, the second merged over the first; a reader meets the second."""
    root = _folder(spark)
    s = D.segments(spark, sf).select("text").distinct()
    row = lambda d, t: d.select(F.lit("m").alias("model"), "text", t.cast("string").alias("translated_text"), F.lit("llm").alias("match_type"), qa.none().alias("qa_issues"), F.lit("s").alias("sig"))
    first = row(s.where(F.length("text") % 2 == 0), F.lit("old"))
    readers.swap_table(first, root, "1")
    readers.swap_table(memory.merge_cache(readers.current_table(spark, root), row(s, F.length("text") % 5), ["model", "text"]), root, "2")
    return readers.cache(spark, readers.current_path(spark, root)).select("text", F.col("translated_text").cast("int").alias("n"))


@query("SELECT CAST(user_id AS VARCHAR) AS job_id, 'Done' AS status, CAST(max(event_id) % 100 AS INT) AS progress FROM events GROUP BY user_id")
def job_state_files(spark: SparkSession, sf: str) -> DataFrame:
    """Job state written as JSON and read back; a file of another shape is dropped and unknown fields are ignored."""
    path = _folder(spark)
    j = D.table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("job_id")).agg((F.max("event_id") % 100).cast("int").alias("progress")).withColumn("status", F.lit("Done")).withColumn("odd", F.lit(1))
    j.write.json(path)
    return readers.job_state(spark, path, lines=True).select("job_id", "status", "progress")


@query(f"""{WITH}{D.SCORED}, r AS (SELECT doc_id, count(*) AS n, coalesce(sum(confidence), 0)::BIGINT AS total FROM scored GROUP BY doc_id) SELECT * FROM r""")
def report_files(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON report a document, written and read back: as many segments, the same scores."""
    r = D.scored(spark, sf).withColumn("verdict", F.lit("ok")).withColumn("issues", F.lit(""))
    path = _folder(spark)
    sinks.save_reports(sinks.reports(r, verify.summary(r, ["doc_id"])), path)
    back = spark.read.schema("doc_id long, summary struct<verified: long>, segments array<struct<seq: long, confidence: int>>").json(path)
    return back.select("doc_id", F.size("segments").cast("long").alias("n"), F.aggregate("segments", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["confidence"], F.lit(0))).alias("total"))


@query(f"{WITH}{D.SEG} SELECT count(*) * 2 AS calls, sum(length(text))::BIGINT * 2 AS chars FROM seg")
def call_log(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs append their calls to one log."""
    path = _folder(spark)
    s = D.segments(spark, sf)
    calls = s.select(F.xxhash64("text").alias("id"), F.lit(1).alias("attempt"), F.lit("p").alias("prompt"), F.lit("m").alias("model"), F.col("text").alias("reply"), F.lit(None).cast("string").alias("error"), F.lit(1).alias("input_tokens"), F.lit(1).alias("output_tokens"))
    for _ in range(2):
        sinks.append_log(calls, path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.length("response")).alias("chars"))


# Word files


def word_files(spark: SparkSession, sf: str) -> DataFrame:
    """path, content: each document as a Word file, a paragraph for each line: its first word bold, the rest plain, what was deleted and a field besides; each third line in a table."""

    def build(batches):
        for path, seqs, texts in docx.rows_of(batches):
            yield str(path), _word_file(zip(seqs, texts, strict=True))

    lines = D.segments(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("line")).select("doc_id", "line.seq", "line.text")
    return lines.mapInArrow(lambda batches: docx.frames(build(batches), docx.FILE, "content"), "path string, content binary")


NOT_XML = re.compile("[^\t -퟿-�\U00010000-\U0010ffff]")


def _word_file(lines) -> bytes:
    t = lambda s: f'<w:t xml:space="preserve">{escape(NOT_XML.sub("", s))}</w:t>'
    body = []
    for seq, text in lines:
        head, blank, rest = text.partition(" ")
        p = f"<w:p><w:r><w:rPr><w:b/></w:rPr>{t(head + blank)}</w:r><w:del><w:r>{t('gone')}</w:r></w:del>" + (f"<w:ins><w:r>{t(rest)}</w:r></w:ins>" if rest else "") + "</w:p>"
        body.append(f"<w:tbl><w:tr><w:tc>{p}</w:tc></w:tr></w:tbl>" if seq % 3 == 0 else p)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{docx.W}"><w:body>{"".join(body)}</w:body></w:document>')
    return out.getvalue()


UNITS = f"""{D.SEG}, u AS (SELECT doc_id, seq, CASE WHEN strpos(text, ' ') > 0 THEN '⟦1⟧' || left(text, strpos(text, ' ')) || '⟦2⟧' || substr(text, strpos(text, ' ') + 1) ELSE text END AS text, seq % 3 = 0 AS cell FROM seg WHERE regexp_matches(text, '[A-Za-z]'))"""


@query(f"{WITH}{UNITS} SELECT doc_id, text, CASE WHEN cell THEN 'table_cell' ELSE 'paragraph' END AS kind, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS BIGINT) AS seq FROM u")
def word_units(spark: SparkSession, sf: str) -> DataFrame:
    """Units of the files: deleted text is gone, inserted text ordinary, looks marked, cells told from paragraphs."""
    return docx.read_docx(word_files(spark, sf)).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "kind", "seq")


@query(f"{WITH}{UNITS} SELECT doc_id, 'X ' || text AS text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS BIGINT) AS seq FROM u")
def word_rewritten(spark: SparkSession, sf: str) -> DataFrame:
    """Every unit replaced, the file written, and read again."""
    files = word_files(spark, sf).repartition("path")  # built once: both uses read this exchange
    units = docx.read_docx(files)
    out = docx.write_docx(files, units.select("doc_id", "location", F.regexp_replace("text", "^(⟦1⟧)?", "$1X ").alias("translated_text"), F.lit(True).alias("flagged")))
    plain = F.regexp_replace("text", "^⟦1⟧X ", "X ⟦1⟧")
    return docx.read_docx(out).select(F.col("doc_id").cast("long").alias("doc_id"), plain.alias("text"), "seq")


@query(f"{WITH}{D.SEG} SELECT doc_id, count(*) FILTER (seq % 3 = 0)::INT AS tables, 0 AS pictures, count(*)::INT AS paragraphs FROM seg GROUP BY doc_id")
def word_structure(spark: SparkSession, sf: str) -> DataFrame:
    return docx.structure_table(word_files(spark, sf)).select(F.col("path").cast("long").alias("doc_id"), "tables", "pictures", "paragraphs")


@query(f"{WITH}{D.SEG}, s AS (SELECT doc_id, seq, 'r' || (seq % 4) AS rel FROM seg) SELECT doc_id, seq, 'header' || substr(rel, 2) AS part, 'H' || substr(rel, 2) AS info FROM s WHERE rel <> 'r3'")
def section_refs(spark: SparkSession, sf: str) -> DataFrame:
    s = D.segments(spark, sf).select("doc_id", "seq", F.concat(F.lit("r"), (F.col("seq") % 4).cast("string")).alias("rel_id"))
    rel = s.where("rel_id <> 'r3'").select("doc_id", "rel_id", F.concat(F.lit("header"), F.substring("rel_id", 2, 9)).alias("part")).distinct()
    parts = rel.select("doc_id", "part", F.concat(F.lit("H"), F.substring("rel_id", 2, 9)).alias("info"))
    return docx.section_refs(s, rel, parts).select("doc_id", "seq", "part", "info")
