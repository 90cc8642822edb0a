"""Queries over laid-out words, blocks and boxes, and over document tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import layout as L
from quillon.sources import docx, readers

from . import derived as D
from .registry import query

WITH = "WITH RECURSIVE "
IN_BOX = "(w.x0 + w.x1) / 2 BETWEEN b.x0 - {s} AND b.x1 + {s} AND (w.top + w.bottom) / 2 BETWEEN b.top - {s} AND b.bottom + {s}"


@query(f"{WITH}{D.WORDS}{D.BOXES} SELECT w.doc_id, w.page, count(*) AS n FROM words w LEFT JOIN boxes b ON w.doc_id = b.doc_id AND w.page = b.page AND {IN_BOX.format(s=0)} WHERE b.doc_id IS NULL GROUP BY ALL")
def words_outside_tables(spark: SparkSession, sf: str) -> DataFrame:
    return L.words_outside_tables(D.words(spark, sf), D.boxes(spark, sf)).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"))


@query(f"{WITH}{D.WORDS}{D.CELLS} SELECT w.doc_id, w.page, w.seq, w.i, b.row, b.col FROM words w JOIN cells b ON w.doc_id = b.doc_id AND w.page = b.page AND {IN_BOX.format(s=1)}")
def words_in_cell(spark: SparkSession, sf: str) -> DataFrame:
    return L.words_in_cell(D.words(spark, sf), D.cells(spark, sf)).select("doc_id", "page", "seq", "i", "row", "col")


@query(f"""{WITH}{D.BLOCKS}{D.BOXES}, s AS (SELECT doc_id, page, 'top' AS side, top AS fixed, x0 AS lo, x1 AS hi FROM boxes UNION ALL SELECT doc_id, page, 'bottom', bottom, x0, x1 FROM boxes)
SELECT s.doc_id, s.page, s.side, coalesce(sum(CASE WHEN e.doc_id IS NULL THEN 0 ELSE greatest(0, least(s.hi, e.x1) - greatest(s.lo, e.x0)) END), 0) / (s.hi - s.lo) AS cover, coalesce(sum(CASE WHEN e.doc_id IS NULL THEN 0 ELSE greatest(0, least(s.hi, e.x1) - greatest(s.lo, e.x0)) END), 0) / (s.hi - s.lo) > 0.6 AS bordered
FROM s LEFT JOIN blocks e ON s.doc_id = e.doc_id AND s.page = e.page AND abs(e.bottom + 2 - s.fixed) <= 2 GROUP BY s.doc_id, s.page, s.side, s.lo, s.hi""")
def edge_cover(spark: SparkSession, sf: str) -> DataFrame:
    """Rules under the blocks as edges, top and bottom of each table as sides."""
    b = D.boxes(spark, sf)
    side = lambda n: b.select("doc_id", "page", F.lit(n).alias("side"), F.lit("h").alias("orientation"), F.col(n).alias("fixed"), F.col("x0").alias("lo"), F.col("x1").alias("hi"))
    e = D.blocks(spark, sf).select("doc_id", "page", F.lit("h").alias("orientation"), "x0", "x1", (F.col("bottom") + 2).alias("top"), (F.col("bottom") + 2).alias("bottom"), F.lit(0.5).alias("linewidth"))
    return L.edge_cover(side("top").unionByName(side("bottom")), e).select("doc_id", "page", "side", "cover", "bordered")


@query(f"{WITH}{D.BLOCKS} SELECT DISTINCT a.doc_id, a.page, a.block_id FROM blocks a JOIN blocks b ON a.doc_id = b.doc_id AND a.page = b.page AND a.block_id <> b.block_id AND least(a.bottom, b.bottom) - greatest(a.top, b.top) > 0.3 * least(a.bottom - a.top, b.bottom - b.top) AND (b.x0 >= a.x1 OR b.x1 <= a.x0)")
def side_by_side(spark: SparkSession, sf: str) -> DataFrame:
    return L.side_by_side(D.blocks(spark, sf)).select("doc_id", "page", "block_id")


@query(f"""{WITH}{D.BLOCKS}, e AS (SELECT doc_id, page, block_id AS edge_id, x0 + 4 AS x0, x1 - (block_id % 4) * 30 AS x1, bottom + (block_id % 9) - 3 AS top FROM blocks)
SELECT b.doc_id, b.page, b.block_id, e.edge_id FROM blocks b JOIN e ON b.doc_id = e.doc_id AND b.page = e.page WHERE e.top - b.bottom BETWEEN -7 AND 5 AND least(e.x1, b.x1) - greatest(e.x0, b.x0) > 0.5 * (b.x1 - b.x0) AND e.x0 >= b.x0 - 8 AND e.x1 <= b.x1 + 30""")
def underline_match(spark: SparkSession, sf: str) -> DataFrame:
    b = D.blocks(spark, sf)
    e = b.select("doc_id", "page", F.col("block_id").alias("edge_id"), F.lit("h").alias("orientation"), (F.col("x0") + 4).alias("x0"), (F.col("x1") - (F.col("block_id") % 4) * 30).alias("x1"), (F.col("bottom") + (F.col("block_id") % 9) - 3).alias("top"))
    return L.underline_match(b, e)


LABELS = """, ln AS (SELECT doc_id, page, block_id AS line_id, CASE WHEN block_id % 2 = 0 THEN 'No ' || block_id ELSE text END AS text, CASE WHEN block_id % 2 = 0 THEN 60 ELSE 160 END::DOUBLE AS x0, CASE WHEN block_id % 2 = 0 THEN 110 ELSE 400 END::DOUBLE AS x1, top FROM blocks)"""


@query(f"""{WITH}{D.BLOCKS}{LABELS}, c AS (SELECT t.doc_id, t.page, t.line_id, l.line_id AS label_id, l.x1 AS lx1 FROM ln t JOIN ln l ON t.doc_id = l.doc_id AND t.page = l.page AND t.line_id <> l.line_id
 WHERE length(t.text) >= 8 AND length(l.text) <= 22 AND len(string_split(l.text, ' ')) <= 4 AND abs(l.top - t.top) < 2.5 AND t.x0 - l.x1 > 18 AND t.x0 - l.x1 < 160
 AND NOT EXISTS (SELECT 1 FROM ln k WHERE k.doc_id = t.doc_id AND k.page = t.page AND ((abs(k.top - l.top) < 2.5 AND k.x1 < l.x0 - 8) OR (abs(k.top - t.top) < 2.5 AND l.x1 <= k.x0 AND k.x1 <= t.x0))))
SELECT doc_id, page, line_id, arg_max(label_id, (lx1, -label_id)) AS label_id FROM c GROUP BY ALL""")
def label_pairs(spark: SparkSession, sf: str) -> DataFrame:
    even = F.col("block_id") % 2 == 0
    ln = D.blocks(spark, sf).select("doc_id", "page", F.col("block_id").alias("line_id"), F.when(even, F.concat(F.lit("No "), F.col("block_id").cast("string"))).otherwise(F.col("text")).alias("text"), F.when(even, 60.0).otherwise(160.0).alias("x0"), F.when(even, 110.0).otherwise(400.0).alias("x1"), "top", F.lit(False).alias("bulleted"))
    return L.label_pairs(ln)


@query(f"""{WITH}{D.BLOCKS}, p AS (SELECT doc_id, page, block_id AS ord, CASE WHEN block_id % 7 <> 3 THEN ((block_id // 5) % 3 * 10)::DOUBLE END AS lx, (200 + CASE WHEN block_id % 11 = 5 THEN 9 ELSE 0 END)::DOUBLE AS tx, CASE WHEN block_id % 7 = 3 THEN NULL WHEN block_id % 3 = 0 THEN '1.2' ELSE 'ab' END AS label FROM blocks),
 b AS (SELECT *, CASE WHEN lag(tx) OVER w IS NULL OR abs(tx - lag(tx) OVER w) >= 3 OR (lx IS NOT NULL AND coalesce(abs(lx - last_value(lx IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) >= 3, true)) THEN 1 ELSE 0 END AS brk FROM p WINDOW w AS (PARTITION BY doc_id, page ORDER BY ord)),
 r AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY doc_id, page ORDER BY ord) AS BIGINT) AS run FROM b)
SELECT doc_id, page, ord, run FROM r QUALIFY count(lx) OVER (PARTITION BY doc_id, page, run) >= 2 OR (count(lx) OVER (PARTITION BY doc_id, page, run) = 1 AND bool_or(coalesce(label = '1.2', false)) OVER (PARTITION BY doc_id, page, run))""")
def label_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh line wraps: it has no label and goes on with its run."""
    wraps = F.col("block_id") % 7 == 3
    p = D.blocks(spark, sf).select("doc_id", "page", F.col("block_id").alias("ord"), F.when(~wraps, F.expr("cast((block_id div 5) % 3 * 10 as double)")).alias("label_x"), F.expr("cast(200 + if(block_id % 11 = 5, 9, 0) as double)").alias("text_x"), F.when(wraps, F.lit(None)).when(F.col("block_id") % 3 == 0, "1.2").otherwise("ab").alias("label"))
    return L.label_runs(p).select("doc_id", "page", "ord", "run")


@query(f"{WITH}{D.BLOCKS}{D.BOXES}, p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM blocks GROUP BY 1), t AS (SELECT doc_id, count(*) AS tables FROM boxes GROUP BY 1), g AS (SELECT doc_id, count(*) AS pictures FROM boxes WHERE page % 2 = 1 GROUP BY 1) SELECT doc_id, pages, coalesce(tables, 0) AS tables, coalesce(pictures, 0) AS pictures FROM p LEFT JOIN t USING (doc_id) LEFT JOIN g USING (doc_id)")
def page_structure(spark: SparkSession, sf: str) -> DataFrame:
    boxes = D.boxes(spark, sf)
    return L.structure(D.blocks(spark, sf), boxes, boxes.where("page % 2 = 1"))


@query(f"""{WITH}{D.BLOCKS}{D.BOXES} SELECT DISTINCT p.doc_id, p.page FROM boxes p JOIN blocks b ON p.doc_id = b.doc_id AND p.page = b.page AND p.x0 < b.x1 AND p.x1 > b.x0 AND p.top < b.bottom AND p.bottom > b.top""")
def picture_collides(spark: SparkSession, sf: str) -> DataFrame:
    return L.picture_collides(D.boxes(spark, sf), D.blocks(spark, sf)).select("doc_id", "page").distinct()


@query(f"""{WITH}{D.BLOCKS}, f AS (SELECT doc_id, page, bottom, ((block_id * 7) % 40 - 5)::DOUBLE AS drift FROM blocks)
SELECT b.doc_id, b.page, b.block_id, greatest(0.0, coalesce((SELECT max(f.drift) FROM f WHERE f.doc_id = b.doc_id AND f.page = b.page AND f.bottom <= b.top + 2), 0.0)) AS shift FROM blocks b""")
def drift_asof(spark: SparkSession, sf: str) -> DataFrame:
    b = D.blocks(spark, sf)
    return L.drift_asof(b, b.select("doc_id", "page", "bottom", ((F.col("block_id") * 7) % 40 - 5).cast("double").alias("drift"))).select("doc_id", "page", "block_id", "shift")


@query(f"""{WITH}{D.BLOCKS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY block_id) AS r, (block_id % 6)::DOUBLE AS growth FROM blocks),
 f AS (SELECT doc_id, page, block_id, r, bottom AS cur, growth - least(greatest(top, 1.0) - 1, 0) AS slack, greatest(top, 1.0) - least(greatest(top, 1.0) - 1, 0) AS gap FROM o WHERE r = 1
  UNION ALL SELECT o.doc_id, o.page, o.block_id, o.r, greatest(f.cur, o.bottom), f.slack - least(greatest(o.top - f.cur, 1.0) - 1, f.slack) + o.growth, greatest(o.top - f.cur, 1.0) - least(greatest(o.top - f.cur, 1.0) - 1, f.slack)
  FROM f JOIN o ON o.doc_id = f.doc_id AND o.page = f.page AND o.r = f.r + 1)
SELECT doc_id, page, block_id AS ord, gap FROM f""")
def flow_gaps(spark: SparkSession, sf: str) -> DataFrame:
    f = D.blocks(spark, sf).select("doc_id", "page", F.col("block_id").alias("ord"), "top", "bottom", (F.col("block_id") % 6).cast("double").alias("growth"))
    return L.flow_gaps(f).select("doc_id", "page", "ord", "gap")


REPEATS = r"""SELECT doc_id, key_text, key_top, count(DISTINCT page) AS n FROM (SELECT doc_id, page, regexp_replace(text, '\d+', '#', 'g') AS key_text, round_even(top / 4, 0)::BIGINT AS key_top FROM blocks) GROUP BY ALL"""


@query(f"{WITH}{D.BLOCKS}, n AS ({REPEATS}), p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM blocks GROUP BY doc_id) SELECT n.* FROM n JOIN p USING (doc_id) WHERE n >= 2 AND n >= 0.6 * pages")
def repeat_blocks(spark: SparkSession, sf: str) -> DataFrame:
    b = D.blocks(spark, sf)
    return L.repeats(b, b.select("doc_id", "page").distinct())


@query(f"""{WITH}{D.BLOCKS}{D.BOXES}, k AS (SELECT doc_id, page, round_even(x0 / 4, 0)::BIGINT AS k_x0, round_even(top / 4, 0)::BIGINT AS k_top, round_even(x1 / 4, 0)::BIGINT AS k_x1, round_even(bottom / 4, 0)::BIGINT AS k_bottom FROM boxes),
 p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM blocks GROUP BY doc_id)
SELECT doc_id, k_x0, k_top, k_x1, k_bottom, n FROM (SELECT doc_id, k_x0, k_top, k_x1, k_bottom, count(DISTINCT page) AS n FROM k GROUP BY ALL) JOIN p USING (doc_id) WHERE n >= 2 AND n >= 0.6 * pages""")
def repeat_tables(spark: SparkSession, sf: str) -> DataFrame:
    return L.repeat_tables(D.boxes(spark, sf), D.blocks(spark, sf).select("doc_id", "page").distinct())


@query(f"""{WITH}{D.BLOCKS}, n AS ({REPEATS}), p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM blocks GROUP BY doc_id), r AS (SELECT n.* FROM n JOIN p USING (doc_id) WHERE n >= 2 AND n >= 0.6 * pages)
SELECT b.doc_id, b.page, b.block_id FROM blocks b WHERE ((top < 0.06 * 170 OR bottom > 0.92 * 170) AND nlines <= 2) OR EXISTS (SELECT 1 FROM r WHERE r.doc_id = b.doc_id AND r.key_text = regexp_replace(b.text, '\\d+', '#', 'g') AND r.key_top = round_even(b.top / 4, 0)::BIGINT)""")
def pinned_blocks(spark: SparkSession, sf: str) -> DataFrame:
    b = D.blocks(spark, sf)
    pages = b.select("doc_id", "page").distinct().withColumn("height", F.lit(170.0))
    return L.pinned(b, pages, L.repeats(b, pages)).select("doc_id", "page", "block_id")


@query(f"""{WITH}{D.WORDS}, c AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, page ORDER BY x0, top, seq, i ROWS UNBOUNDED PRECEDING) AS col FROM (SELECT *, CASE WHEN lag(x0) OVER w IS NULL OR x0 - lag(x0) OVER w >= 3 THEN 1 ELSE 0 END AS brk FROM words WHERE NOT upright WINDOW w AS (PARTITION BY doc_id, page ORDER BY x0, top, seq, i)))
SELECT doc_id, page, CAST(col AS BIGINT) AS col, count(*) AS n, min(top) AS top, max(bottom) AS bottom, min(x0) AS x0 FROM c GROUP BY doc_id, page, col""")
def rotated_columns(spark: SparkSession, sf: str) -> DataFrame:
    r = L.rotated_blocks(D.words(spark, sf).withColumn("text", F.lit("w")))
    return r.select("doc_id", "page", "col", F.size(F.split("text", " ")).cast("long").alias("n"), "top", "bottom", "x0")


@query(f"""{WITH}{D.WORDS}, g AS (SELECT doc_id, page, i, (i * 37)::DOUBLE AS line FROM (SELECT DISTINCT doc_id, page FROM words), (SELECT unnest(range(0, 20))::INT AS i)), v AS (SELECT DISTINCT doc_id, page, x0 AS v FROM words)
SELECT v.doc_id, v.page, v, arg_min(i, (abs(line - v), i)) AS i FROM v JOIN g ON v.doc_id = g.doc_id AND v.page = g.page GROUP BY ALL""")
def nearest_grid(spark: SparkSession, sf: str) -> DataFrame:
    v = D.words(spark, sf).select("doc_id", "page", F.col("x0").alias("v")).distinct()
    g = v.select("doc_id", "page").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("at", (F.col("i") * 37).cast("double"))
    return L.nearest_grid(v, g)


@query(f"""{WITH}{D.WORDS}, g AS (SELECT doc_id, page, seq AS grid, x0 FROM words), c AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY doc_id, page, grid ORDER BY x0) AS BIGINT) AS col FROM (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY doc_id, page, grid ORDER BY x0) >= 10 THEN 1 ELSE 0 END AS brk FROM g))
SELECT doc_id, page, grid, col, min(x0) AS start, count(*) AS cells FROM c GROUP BY ALL""")
def grid_columns(spark: SparkSession, sf: str) -> DataFrame:
    return L.grid_columns(D.words(spark, sf).select("doc_id", "page", F.col("seq").alias("grid"), "x0"))


@query(f"""{WITH}{D.WORDS}, v AS (SELECT DISTINCT doc_id, page, x0 / 40 AS v FROM words), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY v) AS r FROM v),
 f AS (SELECT doc_id, page, r, v AS kept, true AS keep FROM o WHERE r = 1 UNION ALL SELECT o.doc_id, o.page, o.r, CASE WHEN o.v - f.kept > 1.5 THEN o.v ELSE f.kept END, o.v - f.kept > 1.5 FROM f JOIN o ON o.doc_id = f.doc_id AND o.page = f.page AND o.r = f.r + 1)
SELECT doc_id, page, count(*) FILTER (keep) AS n, max(kept) AS last FROM f GROUP BY ALL""")
def snap_1d(spark: SparkSession, sf: str) -> DataFrame:
    v = D.words(spark, sf).groupBy("doc_id", "page").agg(F.collect_set(F.col("x0") / 40).alias("v")).withColumn("s", L.snap(F.col("v")))
    return v.select("doc_id", "page", F.size("s").cast("long").alias("n"), F.array_max("s").alias("last"))


@query(f"""{WITH}{D.SEG}{D.CELLS}, c AS (SELECT doc_id, page, table_id, "row" AS r0, "col" AS c0, 1 + (doc_id % 2) AS rs, 1 + (page % 3) AS cs FROM cells)
SELECT doc_id, page, r0::INT AS "row", c0::INT AS "col", unnest(range(r0, r0 + rs))::INT AS r, c FROM (SELECT *, unnest(range(c0, c0 + cs))::INT AS c FROM c)""")
def span_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    c = D.cells(spark, sf).select("doc_id", "page", "row", "col", (1 + F.col("doc_id") % 2).cast("int").alias("rowspan"), (1 + F.col("page") % 3).cast("int").alias("colspan"))
    return L.span_occupancy(c).select("doc_id", "page", "row", "col", "r", "c")


@query(f"""{WITH}{D.SEG}{D.CELLS}, w AS (SELECT doc_id, page, table_id, "col", 100::DOUBLE AS width, max(60 + (doc_id * 3 + "row" * 7 + "col" * 55) % 70)::DOUBLE AS need FROM cells GROUP BY doc_id, page, table_id, "col"),
 s AS (SELECT *, greatest(0, need - width) AS lack, greatest(0, width - need) AS slack, sum(greatest(0, need - width)) OVER t AS l, sum(greatest(0, width - need)) OVER t AS s FROM w WINDOW t AS (PARTITION BY doc_id, page, table_id))
SELECT doc_id, page, "col", width + CASE WHEN l > 0 THEN least(l, 0.8 * s) * lack / l ELSE 0 END - CASE WHEN s > 0 THEN least(l, 0.8 * s) * slack / s ELSE 0 END AS new_width FROM s""")
def col_need(spark: SparkSession, sf: str) -> DataFrame:
    c = D.cells(spark, sf).select("doc_id", "page", "table_id", "col", F.lit(1).alias("colspan"), (60 + (F.col("doc_id") * 3 + F.col("row") * 7 + F.col("col") * 55) % 70).cast("double").alias("need"))
    return L.col_need(c, c.select("doc_id", "page", "table_id", "col", F.lit(100.0).alias("width")).distinct()).select("doc_id", "page", "col", "new_width")


@query(f"""{WITH}{D.WORDS}{D.CELLS}, j AS (SELECT b.*, w.x0 AS wx0, w.x1 AS wx1, w.top AS wtop, w.bottom AS wbottom, min(w.top) OVER (PARTITION BY b.doc_id, b.page, b.table_id, b."row", b."col") AS first FROM words w JOIN cells b ON w.doc_id = b.doc_id AND w.page = b.page AND {IN_BOX.format(s=1)}),
 g AS (SELECT doc_id, page, "row", "col", min(wx0) FILTER (abs(wtop - first) < 3) - x0 AS lg, x1 - max(wx1) FILTER (abs(wtop - first) < 3) AS rg, min(wtop) - top AS tg, bottom - max(wbottom) AS bg, x1 - x0 AS width FROM j GROUP BY doc_id, page, "row", "col", x0, x1, top, bottom)
SELECT doc_id, page, "row", "col", CASE WHEN abs(lg - rg) <= greatest(8, 0.06 * width) THEN 'center' WHEN rg <= 6 AND lg > 20 THEN 'right' ELSE 'left' END AS align, CASE WHEN abs(tg - bg) <= 3 THEN 'center' WHEN tg > bg THEN 'bottom' ELSE 'top' END AS valign FROM g""")
def cell_align(spark: SparkSession, sf: str) -> DataFrame:
    return L.cell_align(D.words(spark, sf), D.cells(spark, sf)).select("doc_id", "page", "row", "col", "align", "valign")


@query(f"""{WITH}{D.WORDS}{D.CELLS} SELECT w.doc_id, w.page, b."row", b."col", avg((NOT upright)::INT) > 0.5 AS rotated FROM words w JOIN cells b ON w.doc_id = b.doc_id AND w.page = b.page AND {IN_BOX.format(s=0)} WHERE trim(w.text) <> '' GROUP BY ALL""")
def cell_rotated(spark: SparkSession, sf: str) -> DataFrame:
    return L.cell_rotated(D.words(spark, sf), D.cells(spark, sf)).select("doc_id", "page", "row", "col", "rotated")


@query(f"""{WITH}{D.WORDS}, c AS (SELECT doc_id, page, seq * 10000 + i AS id, left(text, 1) AS ch, x0 / 100 AS x0, top / 100 AS top FROM words)
SELECT doc_id, page, count(*) AS n FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE a.doc_id = b.doc_id AND a.page = b.page AND a.ch = b.ch AND abs(a.x0 - b.x0) <= 1 AND abs(a.top - b.top) <= 1 AND b.id < a.id) GROUP BY ALL""")
def dedupe_glyphs(spark: SparkSession, sf: str) -> DataFrame:
    c = D.words(spark, sf).select("doc_id", "page", (F.col("seq") * 10000 + F.col("i")).alias("seq"), F.left("text", F.lit(1)).alias("text"), (F.col("x0") / 100).alias("x0"), (F.col("top") / 100).alias("top"))
    return L.dedupe_glyphs(c).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"))


@query(f"{WITH}{D.WORDS}, g AS (SELECT doc_id, page, CASE WHEN sum(CASE WHEN i % 3 > 0 THEN 1 ELSE -1 END) >= 0 THEN 'up' ELSE 'down' END AS dir FROM words WHERE NOT upright GROUP BY ALL) SELECT * FROM g")
def rot_dirs(spark: SparkSession, sf: str) -> DataFrame:
    return L.rot_dirs(D.words(spark, sf).withColumn("up", F.col("i") % 3 > 0))


@query(f"""{WITH}{D.SEG}, w AS (SELECT doc_id, seq, unnest(range(0, len(x))) AS i, unnest(x) AS word FROM (SELECT doc_id, seq, string_split(text, ' ') AS x FROM seg))
SELECT doc_id, seq, string_agg(word, ' ' ORDER BY i) AS text FROM w WHERE 40 + (i * 13 + seq * 7) % 60 >= 60 AND regexp_matches(word, '[\\p{{L}}\\p{{N}}]') GROUP BY doc_id, seq HAVING length(regexp_replace(string_agg(word, ' ' ORDER BY i), '[^\\p{{L}}]', '', 'g')) >= 3""")
def ocr_lines(spark: SparkSession, sf: str) -> DataFrame:
    w = D.segments(spark, sf).select("doc_id", "seq", F.posexplode(F.split("text", " ")).alias("i", "word")).withColumn("conf", (40 + (F.col("i") * 13 + F.col("seq") * 7) % 60).cast("double"))
    w = w.select("doc_id", F.lit(0).alias("page"), F.lit(0).alias("block"), F.lit(0).alias("par"), F.col("seq").alias("line"), "i", "word", "conf")
    return readers.ocr_lines(w).select("doc_id", F.col("line").alias("seq"), "text")


@query(f"{WITH}{D.SEG}, k AS (SELECT doc_id, seq, 'K' || (seq % 7) AS key, text AS value FROM seg) SELECT 'K' || (doc_id % 40) || '_' || key AS key, arg_min(rtrim(ltrim(value)), doc_id * 100000 + seq) AS value FROM k GROUP BY 1")
def settings_lines(spark: SparkSession, sf: str) -> DataFrame:
    k = F.concat(F.lit("K"), (F.col("doc_id") % 40).cast("string"), F.lit("_K"), (F.col("seq") % 7).cast("string"))
    lines = D.segments(spark, sf).select(F.concat(F.lit(" "), k, F.lit(" = '"), F.trim("text"), F.lit("'")).alias("value"), (F.col("doc_id") * 100000 + F.col("seq")).alias("line"))
    return readers.settings(lines)


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Words of segments as tokens of a document: every ninth a field mark, every seventh a tab, looks that change."""
    w = D.segments(spark, sf).select("doc_id", F.col("seq").alias("par"), F.posexplode(F.split("text", " ")).alias("seq", "text"))
    kind = F.when(F.col("seq") % 9 == 8, "field").when(F.col("seq") % 7 == 6, "tab").otherwise("text")
    mark = F.when(F.col("seq") % 9 == 8, F.when((F.col("par") + F.col("seq")) % 2 == 0, "begin").otherwise("end"))
    return w.select("doc_id", "par", "seq", kind.alias("kind"), F.when(kind == "text", F.concat(F.col("text"), F.lit(" "))).otherwise("").alias("text"), F.when(F.expr("(seq div 4) % 2 = 0"), "b").otherwise("").alias("look"), mark.alias("mark"))


TOKENS = (
    D.SEG
    + """, tok AS (SELECT doc_id, par, seq, kind, CASE WHEN kind = 'text' THEN w || ' ' ELSE '' END AS text, CASE WHEN (seq // 4) % 2 = 0 THEN 'b' ELSE '' END AS look, CASE WHEN seq % 9 = 8 THEN CASE WHEN (par + seq) % 2 = 0 THEN 'begin' ELSE 'end' END END AS mark
  FROM (SELECT *, CASE WHEN seq % 9 = 8 THEN 'field' WHEN seq % 7 = 6 THEN 'tab' ELSE 'text' END AS kind FROM (SELECT doc_id, seq AS par, unnest(range(0, len(x))) AS seq, unnest(x) AS w FROM (SELECT doc_id, seq, string_split(text, ' ') AS x FROM seg))))"""
)


@query(f"""{WITH}{TOKENS}, s AS (SELECT *, sum(CASE mark WHEN 'begin' THEN 1 WHEN 'end' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY par, seq ROWS UNBOUNDED PRECEDING) AS s FROM tok),
 d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY par, seq ROWS UNBOUNDED PRECEDING)) AS depth FROM s)
SELECT doc_id, par, count(*) AS n FROM (SELECT doc_id, par, coalesce(lag(depth) OVER (PARTITION BY doc_id ORDER BY par, seq), 0) > 0 AS inside FROM d) WHERE inside GROUP BY ALL""")
def docx_field_depth(spark: SparkSession, sf: str) -> DataFrame:
    return docx.field_depth(tokens(spark, sf)).where("in_field").groupBy("doc_id", "par").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{WITH}{TOKENS}, s AS (SELECT *, CAST(sum((kind = 'field')::INT) OVER (PARTITION BY doc_id, par ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS span FROM tok)
SELECT doc_id, par, span, count(*) AS n FROM s WHERE kind <> 'field' GROUP BY ALL""")
def docx_spans(spark: SparkSession, sf: str) -> DataFrame:
    return docx.token_spans(tokens(spark, sf)).groupBy("doc_id", "par", "span").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{WITH}{TOKENS}, s AS (SELECT *, sum((kind = 'field')::INT) OVER (PARTITION BY doc_id, par ORDER BY seq ROWS UNBOUNDED PRECEDING) AS span FROM tok), t AS (SELECT * FROM s WHERE kind <> 'field'),
 l AS (SELECT *, row_number() OVER o = 1 AS first, kind = 'text' AND trim(text) <> '' AS shown, last_value(CASE WHEN kind = 'text' AND trim(text) <> '' THEN look END IGNORE NULLS) OVER (PARTITION BY doc_id, par, span ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, first_value(look) OVER o AS lead FROM t WINDOW o AS (PARTITION BY doc_id, par, span ORDER BY seq)),
 g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id, par, span ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, first OR (shown AND look <> coalesce(prev, lead)) AS fresh FROM l)),
 m AS (SELECT *, max(g) OVER (PARTITION BY doc_id, par, span) > 1 AS many FROM g)
SELECT doc_id, par, CAST(span AS BIGINT) AS span, string_agg(CASE WHEN many AND fresh THEN '⟦' || g || '⟧' ELSE '' END || CASE kind WHEN 'tab' THEN '⟦t⟧' ELSE text END, '' ORDER BY seq) AS text FROM m GROUP BY ALL""")
def docx_unit_text(spark: SparkSession, sf: str) -> DataFrame:
    return docx.token_text(docx.token_spans(tokens(spark, sf)))


_NUMBERED = "^(\\d+(\\.\\d+)+\\.?|\\d+[.)]|[A-Za-z][.)]|([ivxl]{2,5}|[IVXL]{2,5})[.)])$"
_BULLET = "^[•●▪■‣➢➔→◦⁃\\x{f000}-\\x{f8ff}]"
_ALONG = "PARTITION BY doc_id, page, r ORDER BY x0, x1, top, text"
LINES = f"""{D.LAID}, u AS (SELECT *, CASE WHEN top - lag(top) OVER w < 2.5 OR abs(bottom - lag(bottom) OVER w) < 1.5 THEN 0 ELSE 1 END AS fresh FROM laid WHERE upright AND text <> '' WINDOW w AS (PARTITION BY doc_id, page ORDER BY top, bottom, x0, x1, text)),
 ur AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page ORDER BY top, bottom, x0, x1, text ROWS UNBOUNDED PRECEDING) AS r FROM u),
 ug AS (SELECT *, x0 - max(x1) OVER ({_ALONG} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap, regexp_full_match(text, '(?i)p{{1,2}}age') AS counter, regexp_matches(text, '{_NUMBERED}') AS num FROM ur),
 ub AS (SELECT *, gap IS NULL OR gap >= 14 OR counter AS brk FROM ug),
 uc AS (SELECT *, coalesce(brk AND NOT counter AND gap < 60 AND lag(brk) OVER w AND lag(num) OVER w, false) AS near FROM ub WINDOW w AS ({_ALONG})),
 ud AS (SELECT *, sum((NOT near)::INT) OVER ({_ALONG} ROWS UNBOUNDED PRECEDING) AS run FROM uc),
 ue AS (SELECT *, near AND sum(near::INT) OVER (PARTITION BY doc_id, page, r, run ORDER BY x0, x1, top, text ROWS UNBOUNDED PRECEDING) % 2 = 1 AS joins FROM ud),
 ul AS (SELECT *, sum((brk AND NOT joins)::INT) OVER ({_ALONG} ROWS UNBOUNDED PRECEDING) AS line FROM ue),
 uw AS (SELECT doc_id, page, r, line, list(struct_pack(a := x0, b := x1, t := text) ORDER BY x0, x1, text) AS w, max(x1) AS x1, min(top) AS top, max(bottom) AS bottom, max(size) AS size FROM ul GROUP BY ALL),
 um AS (SELECT *, regexp_matches(w[1].t, '{_BULLET}') AS bul, regexp_matches(w[1].t, '{_NUMBERED}') AND len(w) > 1 AND w[2].a - w[1].b > 6 AS num FROM uw),
 un AS (SELECT *, CASE WHEN num OR (bul AND length(w[1].t) = 1) THEN w[2:] ELSE w END AS rest FROM um),
 uo AS (SELECT doc_id, page, top, bottom, x1, size, rest[1].a AS x0, CASE WHEN bul THEN left(w[1].t, 1) WHEN num THEN w[1].t END AS marker, array_to_string(list_transform(rest, lambda x: x.t), ' ') AS told, bul AND length(w[1].t) > 1 AS cut FROM un),
 lines AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY top, x0, x1, text) - 1 AS INT) AS line_id FROM (SELECT * EXCLUDE (told, cut), CASE WHEN cut THEN substr(told, 2) ELSE told END AS text FROM uo) WHERE text <> '')"""


@query(f"{WITH}{LINES} SELECT doc_id, page, line_id, text, marker, x0, x1, top, bottom, size FROM lines")
def line_assembly(spark: SparkSession, sf: str) -> DataFrame:
    return L.assemble_lines(D.laid(spark, sf)).select("doc_id", "page", "line_id", "text", "marker", "x0", "x1", "top", "bottom", "size")


PARAS = f"""{LINES}, b1 AS (SELECT *, min(x0) OVER p + 0.75 * (max(x1) OVER p - min(x0) OVER p) AS far, CASE WHEN top - lag(top) OVER t < 2.5 THEN 0 ELSE 1 END AS fresh FROM lines WINDOW p AS (PARTITION BY doc_id, page), t AS (PARTITION BY doc_id, page ORDER BY top, x0, line_id)),
 b2 AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page ORDER BY top, x0, line_id ROWS UNBOUNDED PRECEDING) AS r FROM b1),
 b3 AS (SELECT *, min(x1) OVER (PARTITION BY doc_id, page, r) < x0 - 8 AS cell FROM b2),
 b4 AS (SELECT *, top - lag(top) OVER f AS step, top - lag(bottom) OVER f AS space, x0 - lag(x0) OVER f AS shift, lag(x0) OVER f + lag(x1) OVER f - x0 - x1 AS lean, lag(size) OVER f AS usize, lag(x1) OVER f > far AS ran FROM b3 WINDOW f AS (PARTITION BY doc_id, page, cell ORDER BY line_id)),
 b5 AS (SELECT *, coalesce(NOT cell AND marker IS NULL AND abs(size - usize) < 0.6 AND space >= 0 AND space < usize AND step > 1 AND ran AND (abs(shift) < 3 OR abs(lean) < 6 OR (shift > 3 AND shift < 40)), false) AS goes FROM b4),
 b6 AS (SELECT *, coalesce(goes AND lag(goes) OVER f AND abs(step - lag(step) OVER f) >= 0.35 * step, false) AS odd FROM b5 WINDOW f AS (PARTITION BY doc_id, page, cell ORDER BY line_id)),
 b7 AS (SELECT *, sum((NOT odd)::INT) OVER (PARTITION BY doc_id, page, cell ORDER BY line_id ROWS UNBOUNDED PRECEDING) AS run FROM b6),
 b8 AS (SELECT *, NOT goes OR (odd AND sum(odd::INT) OVER (PARTITION BY doc_id, page, cell, run ORDER BY line_id ROWS UNBOUNDED PRECEDING) % 2 = 1) AS new FROM b7),
 b9 AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id, page, cell ORDER BY line_id ROWS UNBOUNDED PRECEDING) AS b FROM b8),
 paras AS (SELECT doc_id, page, min(line_id) AS head, string_agg(text, ' ' ORDER BY line_id) AS text, arg_min(marker, line_id) FILTER (marker IS NOT NULL OR new) AS marker, min(x0) AS x0, max(x1) AS x1, arg_min(top, line_id) AS top, arg_max(bottom, line_id) AS bottom, arg_max(size, (length(text), -line_id)) AS size, count(*)::INT AS nlines, array_to_string(list(x0::INT ORDER BY line_id), ',') AS starts FROM b9 GROUP BY doc_id, page, cell, b)"""


@query(f"{WITH}{PARAS} SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY head) - 1 AS INT) AS block_id, text, marker, x0, x1, top, bottom, size, nlines, starts FROM paras")
def block_assembly(spark: SparkSession, sf: str) -> DataFrame:
    b = L.assemble_blocks(L.assemble_lines(D.laid(spark, sf)))
    return b.select("doc_id", "page", "block_id", "text", "marker", "x0", "x1", "top", "bottom", "size", "nlines", F.array_join(F.transform("x0s", lambda x: x.cast("int").cast("string")), ",").alias("starts"))


#: Blocks in two columns with short heads, single ones below some rows, markers, and starts that stray.
CELL_BLOCKS = f"""{D.BLOCKS}, g0 AS (SELECT doc_id, page, block_id, CASE WHEN (doc_id + block_id) % 31 = 7 THEN '•' END AS marker, text, 60 + (block_id % 2) * 260 + CASE WHEN (doc_id * 3 + block_id) % 29 = 5 THEN 14 WHEN block_id % 5 = 1 THEN 4 ELSE 0 END AS x0, top, bottom, 1 AS nlines FROM blocks WHERE (doc_id + block_id) % 8 <> 4),
 g1 AS (SELECT * EXCLUDE (x0, nlines), x0::DOUBLE AS x0, (x0 + 100)::DOUBLE AS x1, nlines FROM g0 WHERE marker IS NULL)"""
_ROWS = "PARTITION BY doc_id, page ORDER BY r"
GRIDS = f"""{CELL_BLOCKS}, g2 AS (SELECT *, CASE WHEN top - lag(top) OVER (PARTITION BY doc_id, page ORDER BY top, x0, block_id) < 2.5 THEN 0 ELSE 1 END AS fresh FROM g1),
 g3 AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page ORDER BY top, x0, block_id ROWS UNBOUNDED PRECEDING) AS r FROM g2),
 g4 AS (SELECT *, x0 - lag(x1) OVER (PARTITION BY doc_id, page, r ORDER BY x0, block_id) AS space FROM g3),
 g5 AS (SELECT doc_id, page, r, count(*) AS n, min(space) AS space, length(arg_min(text, (x0, block_id))) AS chars, arg_min(x0, (x0, block_id)) AS hx, arg_min(top, (x0, block_id)) AS htop, arg_min(bottom, (x0, block_id)) AS hbottom, max(bottom) AS low FROM g4 GROUP BY ALL),
 g6 AS (SELECT *, n >= 2 AND chars <= 45 AND space > 8 AS wide, coalesce(htop - lag(low) OVER ({_ROWS}) < 2 * greatest(hbottom - htop, 8), false) AS near FROM g5),
 g7 AS (SELECT *, NOT wide AND coalesce(n = 1 AND hx >= last_value(CASE WHEN wide THEN hx END IGNORE NULLS) OVER ({_ROWS} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 3, false) AS more FROM g6),
 g8 AS (SELECT *, NOT wide AND NOT more AS alone FROM g7),
 g9 AS (SELECT *, CASE WHEN NOT near OR alone OR coalesce(lag(alone) OVER ({_ROWS}), true) THEN 1 ELSE 0 END AS brk FROM g8),
 ga AS (SELECT *, sum(brk) OVER ({_ROWS} ROWS UNBOUNDED PRECEDING) AS part FROM g9),
 gb AS (SELECT *, sum(wide::INT) OVER (PARTITION BY doc_id, page, part ORDER BY r ROWS UNBOUNDED PRECEDING) AS nth, sum(wide::INT) OVER (PARTITION BY doc_id, page, part) AS n_wide FROM ga),
 gc AS (SELECT g4.doc_id, g4.page, block_id, x0, r, part, wide, nth - 1 AS row FROM g4 JOIN gb USING (doc_id, page, r) WHERE n_wide >= 3 AND nth > 0 AND (wide OR more)),
 gd AS (SELECT *, sum(far) OVER (PARTITION BY doc_id, page, part ORDER BY x0, block_id ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY doc_id, page, part ORDER BY x0, block_id) >= 10 THEN 1 ELSE 0 END AS far FROM gc WHERE wide)),
 ge AS (SELECT doc_id, page, part, start, row_number() OVER (PARTITION BY doc_id, page, part ORDER BY start) - 1 AS col, count(*) OVER (PARTITION BY doc_id, page, part) AS k FROM (SELECT doc_id, page, part, c, min(x0) AS start FROM gd GROUP BY ALL)),
 gf AS (SELECT w.doc_id, w.page, w.part, w.row, w.block_id, arg_min(e.col, (abs(e.start - w.x0), e.col)) AS col, min(abs(e.start - w.x0)) AS far, any_value(e.k) AS k FROM gc w JOIN ge e USING (doc_id, page, part) WHERE w.wide AND e.k <= 8 GROUP BY ALL),
 gg AS (SELECT doc_id, page, part, any_value(k) AS k FROM (SELECT doc_id, page, part, col, any_value(k) AS k, count(*) AS n, count(DISTINCT row) AS m, max(far) AS far FROM gf GROUP BY ALL) GROUP BY ALL HAVING min(n) >= 2 AND bool_and(n = m) AND max(far) <= 12 AND count(*) = any_value(k)),
 gh AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY part) - 1 AS grid FROM gg)"""


@query(f"""{WITH}{GRIDS} SELECT doc_id, page, grid::INT AS grid, row::INT AS row, col::INT AS col, block_id, false AS continuation FROM gf JOIN gh USING (doc_id, page, part)
UNION ALL SELECT doc_id, page, grid::INT, row::INT, (k - 1)::INT, block_id, true FROM gc JOIN gh USING (doc_id, page, part) WHERE NOT wide""")
def grid_detect(spark: SparkSession, sf: str) -> DataFrame:
    stray = F.expr("60 + (block_id % 2) * 260 + case when (doc_id * 3 + block_id) % 29 = 5 then 14 when block_id % 5 = 1 then 4 else 0 end").cast("double")
    b = D.blocks(spark, sf).where("(doc_id + block_id) % 8 <> 4").withColumn("marker", F.expr("case when (doc_id + block_id) % 31 = 7 then '•' end")).withColumn("x0", stray).withColumn("x1", F.col("x0") + 100)
    return L.detect_grids(b)


@query()
def spaced_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth line letter-spaced, and put together again."""
    s = D.segments(spark, sf)
    spaced = F.trim(F.regexp_replace("text", r"(\p{L})", "$1 "))
    return L.rebuild_spaced(s.select("doc_id", "seq", F.when(F.col("seq") % 5 == 4, spaced).otherwise(F.col("text")).alias("text")))


@query(f"{WITH}{D.SEG}, t AS (SELECT doc_id, seq, CASE WHEN seq % 5 = 4 THEN trim(regexp_replace(text, '(\\p{{L}})', '\\1 ', 'g')) ELSE text END AS text FROM seg), w AS (SELECT doc_id, seq, list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM t) SELECT doc_id, seq FROM w WHERE len(w) >= 12 AND len(list_filter(w, lambda x: regexp_full_match(x, '\\p{{L}}{{1,2}}'))) >= 0.7 * len(w)")
def letter_spaced(spark: SparkSession, sf: str) -> DataFrame:
    spaced = F.trim(F.regexp_replace("text", r"(\p{L})", "$1 "))
    t = F.when(F.col("seq") % 5 == 4, spaced).otherwise(F.col("text"))
    return D.segments(spark, sf).where(T.is_letter_spaced(t)).select("doc_id", "seq")
