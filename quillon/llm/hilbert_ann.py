"""Approximate nearest neighbours on shifted space-filling curves.

Vectors are projected to a few principal directions (fitted on a bounded sample) and, for each of
several random rotations and shifts of that space, keyed by their place on a Hilbert curve. Spark
range-partitions each ordering; a query is scored against the key windows around its own place, on
every curve, and the windows' best are merged and reranked on the original vectors.

How far a window must reach depends on the data: clustered vectors need little, isotropic ones much.
So the reach is fitted: for a bounded sample of queries the exact neighbours are found in blocks, and
the reach is the smallest that holds `recall_goal` of them on at least one curve. Every row is indexed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise

CURVES, PROJECTED, BITS = 4, 8, 7
#: Rows on which projection is fitted; queries on which the reach is fitted.
FIT_ROWS, FIT_QUERIES = 4096, 256


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer cells (rows of n coordinates of `bits` bits), n*bits <= 62.

    Gray-code transform of the coordinates from the highest bit down, then their bits interleaved."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    for b in range(bits - 1, 0, -1):
        q, low = np.int64(1 << b), np.int64((1 << b) - 1)
        for i in range(n):
            on = (x[:, i] & q) != 0
            x[on, 0] ^= low
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= swap
            x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    for b in range(bits - 1, 0, -1):
        turn[(x[:, n - 1] >> b) & 1 == 1] ^= (1 << b) - 1
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def _usable(vec: str) -> F.Column:
    v = F.col(vec)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)


def _model(sample: np.ndarray, seed: int = 7) -> dict:
    """Principal directions of a bounded sample, then for each curve a rotation, a shift and a scale."""
    rng = np.random.default_rng(seed)
    centre = sample.mean(0)
    _, _, axes = np.linalg.svd(sample - centre, full_matrices=False)
    axes = axes[:PROJECTED]
    flat = (sample - centre) @ axes.T
    turns = []
    for _ in range(CURVES):
        turn, _ = np.linalg.qr(rng.normal(size=(flat.shape[1], flat.shape[1])))
        at = flat @ turn
        lo, hi = at.min(0), at.max(0)
        width = np.maximum(hi - lo, 1e-12) * 1.25
        turns.append((turn, lo - width * rng.uniform(0, 0.2, len(lo)), width))
    return {"centre": centre, "axes": axes, "turns": turns}


def _keys(model: dict, x: np.ndarray, curve: int) -> np.ndarray:
    turn, lo, width = model["turns"][curve]
    at = ((x - model["centre"]) @ model["axes"].T @ turn - lo) / width
    return hilbert_keys(np.clip((at * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1), BITS)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by score, ties to the smaller id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= edge
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of q with each row of x in double precision, one summation order whatever the block: equal vectors get equal scores."""
    out = np.zeros(len(x))
    for j in range(len(q)):
        out += q[j] * x[:, j]
    return out


def _rerank(q: np.ndarray, x: np.ndarray, k: int):
    """For each row of q the rows of x that can be among its k best, and their exact scores: a matrix product chooses, with room for its rounding."""
    rough = q @ x.T
    slack = 1e-9 * (1 + np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max(initial=0))
    for i in range(len(q)):
        edge = np.partition(rough[i], len(x) - k)[len(x) - k] - slack[i] if len(x) > k else -np.inf
        rows = np.flatnonzero(rough[i] >= edge)
        yield rows, _exact(q[i], x[rows])


def search(vectors: DataFrame, is_query: F.Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", recall_goal: float = 0.96) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest found by inner product, nearest first, ties to the smaller id.

    Vectors that are null, empty, zero or hold a null, NaN or infinity take no part, nor do rows with a null id
    or another length than most. Equal vectors are indexed once with their k+1 smallest ids, which is all that a
    list of k can show of them. Of rows that repeat an id the one with the smallest vector (in order of its components) counts, and it is a query if any of
    them is. Other columns play no part. With no vectors or no queries the result is empty.
    """
    spark = vectors.sparkSession
    out_schema = "query_id long, rank int, vec_id long, score double"
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("q")).where(_usable("v") & F.col("id").isNotNull())
    lengths = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], out_schema)
    dim = lengths[0]["d"]
    # One row an id: rows that repeat one are folded map-side.
    base = materialise(base.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"), F.max(F.coalesce("q", F.lit(False))).alias("q")))
    # Copies of a vector: their smallest ids, ranked before the shuffle and again after it, in salted parts first.
    hashed = base.select("id", "v", "q", F.xxhash64("v").alias("h"), F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt"))
    part = hashed.withColumn("r", F.row_number().over(Window.partitionBy("h", "v", "salt").orderBy("id"))).where(F.col("r") <= k + 1)
    few = part.withColumn("r", F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))).where(F.col("r") <= k + 1)
    points = materialise(few.groupBy("h", "v").agg(F.min("id").alias("pid"), F.sort_array(F.collect_list("id")).alias("ids")).drop("h"))
    # Queries ask once for each distinct vector, so copies of one never meet in a task.
    askers = base.where("q").select(F.col("id").alias("query_id"), F.col("v").alias("qv")).join(points.select("pid", F.col("v").alias("pv")), F.col("qv") == F.col("pv")).select("query_id", F.col("pid").alias("qid"))
    askers = materialise(askers)
    asked = askers.select("qid").distinct()
    n = points.count()

    model = _model(_stack(points.orderBy(F.xxhash64("pid"), "pid").limit(FIT_ROWS).select("v").toPandas()["v"]))

    def key_rows(batches):
        for pdf in batches:
            x = _stack(pdf["v"])
            for c in range(CURVES):
                if len(pdf):
                    yield pd.DataFrame({"curve": c, "key": _keys(model, x, c), "pid": pdf["pid"], "v": pdf["v"], "ids": pdf["ids"]})

    keyed = points.mapInPandas(key_rows, "curve int, key long, pid long, v array<double>, ids array<long>")
    # Global places on each curve: Spark range-partitions, parts count themselves, and the sums of the parts before are added.
    ranged = materialise(keyed.repartitionByRange(max(8, min(2000, CURVES * n // 20000)), "curve", "key", "pid").sortWithinPartitions("curve", "key", "pid").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("m"))
    before = sizes.select("curve", "part", (F.sum("m").over(Window.partitionBy("curve").orderBy("part")) - F.col("m")).alias("before"))
    placed = materialise(
        ranged.withColumn("r", F.row_number().over(Window.partitionBy("curve", "part").orderBy("key", "pid"))).join(before, ["curve", "part"]).select("curve", "pid", "v", "ids", (F.col("before") + F.col("r") - 1).alias("place"))
    )

    reach = _fit_reach(asked, points, placed, k, recall_goal, n)
    block = int(min(65536, max(256, n // 32)))
    span = -(-reach // block)
    last = (n - 1) // block

    blocks = placed.select("curve", (F.col("place") / block).cast("long").alias("block"), "v", "ids")
    asks = placed.join(asked, placed["pid"] == asked["qid"]).select(F.col("curve").alias("c"), "qid", (F.col("place") / block).cast("long").alias("at"), F.col("v").alias("qv"))
    asks = asks.withColumn("b", F.explode(F.sequence(F.greatest(F.col("at") - span, F.lit(0)), F.least(F.col("at") + span, F.lit(last))))).select("c", "b", "qid", "qv")

    def score(key, q: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(q) and len(own):
            x = _stack(own["v"])
            size = own["ids"].map(len).to_numpy()
            ids, first = np.concatenate(own["ids"].to_numpy()), np.cumsum(size) - size
            for lo in range(0, len(q), 64):
                some = q.iloc[lo : lo + 64]
                for qid, (near, s) in zip(some["qid"], _rerank(_stack(some["qv"]), x, k + 1), strict=True):
                    top, who = _best(np.repeat(s, size[near]), np.concatenate([ids[first[r] : first[r] + size[r]] for r in near]), k + 1)
                    rows.append((qid, who, top))
        return pd.DataFrame(rows, columns=["qid", "ids", "scores"])

    found = asks.groupBy("c", "b").cogroup(blocks.groupBy("curve", "block")).applyInPandas(score, "qid long, ids array<long>, scores array<double>")

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(np.concatenate(pdf["ids"].to_numpy()), return_index=True)
        top, who = _best(np.concatenate(pdf["scores"].to_numpy())[at], ids, k + 1)
        return pd.DataFrame({"qid": [key[0]], "ids": [who], "scores": [top]})

    best = found.groupBy("qid").applyInPandas(merge, "qid long, ids array<long>, scores array<double>")
    pairs = askers.join(best, "qid").withColumn("near", F.slice(F.filter(F.arrays_zip("ids", "scores"), lambda x: x["ids"] != F.col("query_id")), 1, k))
    return pairs.select("query_id", F.posexplode("near").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score"))


def _fit_reach(asked: DataFrame, points: DataFrame, placed: DataFrame, k: int, goal: float, n: int) -> int:
    """Rows to either side of a query that hold `goal` of the sample's exact neighbours on some curve."""
    some = points.join(asked.orderBy(F.xxhash64("qid"), "qid").limit(FIT_QUERIES), F.col("pid") == F.col("qid")).select("pid", "v").orderBy("pid").toPandas()
    if not len(some):
        return 1
    qx, qid = _stack(some["v"]), some["pid"].to_numpy()

    def exact(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x, pid = _stack(pdf["v"]), pdf["pid"].to_numpy()
            rows = []
            for lo in range(0, len(x), 4096):
                s = qx @ x[lo : lo + 4096].T
                for i in range(len(qx)):
                    mine = pid[lo : lo + 4096] != qid[i]
                    top, who = _best(s[i][mine], pid[lo : lo + 4096][mine], k)
                    rows.append((i, who, top))
            yield pd.DataFrame(rows, columns=["i", "ids", "scores"])

    def merge(key, pdf):
        _, who = _best(np.concatenate(pdf["scores"].to_numpy()), np.concatenate(pdf["ids"].to_numpy()), k)
        return pd.DataFrame({"i": key[0], "pid": who})

    true = points.select("pid", "v").mapInPandas(exact, "i int, ids array<long>, scores array<double>").groupBy("i").applyInPandas(merge, "i int, pid long")
    spark = points.sparkSession
    own = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(qid)).astype(np.int32), "pid": qid}), "i int, pid long")
    at_q = placed.join(F.broadcast(own), "pid").select("i", "curve", F.col("place").alias("qplace"))
    gap = true.join(F.broadcast(at_q), "i").join(placed.select("curve", "pid", "place"), ["curve", "pid"]).groupBy("i", "pid").agg(F.min(F.abs(F.col("place") - F.col("qplace"))).alias("gap"))
    found = gap.agg(F.percentile("gap", F.lit(goal)).alias("g")).first()["g"]
    return int(min(n, max(1, np.ceil(found or 1))))
