"""Mixing sources to target weights by systematic sampling, with DataFrame operations only.

Within a source every document expects target/size copies. Documents are laid end to end in a fixed order, each as
long as its expected copies; one random offset is added to that prefix sum, and a document is emitted once for each
whole number that its stretch crosses. Lying in order of size, long and short documents are both taken in proportion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, free_name, materialise

#: The weights that sources repeat, in order of code point, null last; the share of all words; the most of a source.
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (source, source_size, n) with target: `share` of all words by weight, none above `most` times its size.

    Sources stop in order of size to weight. The level to which the others are filled follows from the sums of those
    that have stopped, so one pass in that order finds what resharing the excess again and again ends in. A row per source, so one task will do."""
    k = len(weights)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % k + 1).cast("int"))
    rows = sizes.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(most)))
    rows = rows.withColumn("ratio", F.col("most") / F.col("weight"))
    line = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("all_size", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("done_most", F.coalesce(F.sum("most").over(before), F.lit(0.0))).withColumn("done_weight", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("all_size") * F.lit(float(share)) - F.col("done_most")) / (F.col("all_weight") - F.col("done_weight")))
    )
    # The first source, in that order, that its level doesn't fill: all from there on get that level.
    held = rows.withColumn("open", F.when(F.col("level") <= F.col("ratio"), F.col("level")))
    level = F.first("open", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn("target", F.coalesce(F.least(level * F.col("weight"), F.col("most")), F.col("most"))).select("source", "source_size", "n", "weight", "target")


def _size_class(size: Column) -> tuple[Column, Column]:
    """Length of the size in binary, and its leading digits: a class in order of size, the same in any engine."""
    return F.length(F.bin(size)), F.substring(F.bin(size), 1, 4)


def annotate(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, offset: float = 0.4375, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every document.

    A null text has size 0, a null source is a source of its own, last. A source without words has target 0 and takes
    nothing. Rows that repeat an id are documents of their own. No rows give no rows. `offset` is the
    random one, fixed by the caller (a multiple of 1/1024 keeps the sums exact), so reruns agree.
    """
    d = materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text_col).alias("size")))
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    goal = targets(sizes, weights, share, most).select(F.col("source").alias("gsource"), "source_size", "target")
    span = d.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    lo, hi = span["lo"] or 0, span["hi"] or 0
    step = max(1, -(-(hi - lo + 1) // max(64, min(4096, span["n"] // 500_000))))
    # Places in a source: rows are ranked within small parts (size class and range of ids), and parts before are summed.
    length, lead = _size_class(F.col("size"))
    parts = d.withColumn("c1", length).withColumn("c2", lead).withColumn("c3", F.coalesce(F.floor((F.col("doc_id") - F.lit(lo)) / F.lit(step)), F.lit(-1)))
    key = ["source", "c1", "c2", "c3"]
    counts = parts.groupBy(*key).agg(F.count(F.lit(1)).alias("m"))
    before = counts.withColumn("before", F.sum("m").over(Window.partitionBy("source").orderBy("c1", "c2", "c3")) - F.col("m"))
    before = before.join(goal, F.col("source").eqNullSafe(F.col("gsource"))).select(F.col("source").alias("bs"), *[F.col(c).alias(f"b{c}") for c in key[1:]], "before", "source_size", "target")
    ranked = parts.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "size")))
    on = F.col("source").eqNullSafe(F.col("bs")) & (F.col("c1") == F.col("bc1")) & (F.col("c2") == F.col("bc2")) & (F.col("c3") == F.col("bc3"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = F.col("before") + F.col("r")
    crossed = F.floor(place * F.col("rate") + F.lit(offset)) - F.floor((place - 1) * F.col("rate") + F.lit(offset))
    copies = F.least(F.greatest(crossed, F.lit(0).cast("long")), F.lit(int(-(-most // 1))).cast("long"))
    return ranked.join(before, on).withColumn("rate", rate).withColumn("copies", copies.cast("long")).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The documents that the mix takes, all columns as they came, each as often as it is taken."""
    n, tid, ts, tn = (free_name(docs, x) for x in ("mix_copies", "mix_id", "mix_source", "mix_size"))
    marks = annotate(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    # Rows that repeat id, source and size are alike to the mix: their copies are shared out, the first ones more.
    folded = marks.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("sum"), F.count(F.lit(1)).alias("m")).select(F.col("doc_id").alias(tid), F.col("source").alias(ts), F.col("size").alias(tn), F.greatest(F.when(F.col("sum") > 0, F.ceil(F.col("sum") / F.col("m"))).otherwise(0), F.lit(0)).alias(n))
    on = docs[id_col].eqNullSafe(F.col(tid)) & docs[source_col].eqNullSafe(F.col(ts)) & (n_words(text_col) == F.col(tn))
    names = [F.col(f"`{c}`") for c in docs.columns]
    got = docs.join(folded.where(F.col(n) > 0), on)
    return got.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n).cast("long"))).alias(n)).select(*names)


ORACLE = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source
), r AS (
  SELECT *, 2.0::DOUBLE * source_size AS most, 2.0::DOUBLE * source_size / w AS ratio FROM s
), v AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(most) OVER o, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0.0)) AS lev
  FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), h AS (
  SELECT *, first_value(CASE WHEN lev <= ratio THEN lev END IGNORE NULLS) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM v
), t AS (
  SELECT source, source_size, coalesce(least(level * w, most), most) AS target FROM h
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY length(bin(d.size)), substr(bin(d.size), 1, 4), d.doc_id) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(k * rate + 0.4375) - floor((k - 1) * rate + 0.4375)) AS BIGINT) AS taken
FROM p
"""
