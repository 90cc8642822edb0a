"""Exact deduplication against an immutable snapshot and within a new batch.

A snapshot is a table of digests that never changes. For every bucket of digests it carries one
static binary-fuse filter (three positions per key, 8-bit fingerprints, about 1.2 bytes a key). A new
batch is first grouped by digest; each of its digests then asks the filter of its bucket. A negative
is certain: the text is new. A positive joins the exact bucket, and only there texts are compared
byte for byte. Everything is dealt out by digest; the texts of positives are the only ones that move.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import crc_fold, free_name, materialise, text_or_empty

#: Digests behind one filter: bounds what a task holds, whatever the corpus.
KEYS_PER_FILTER = 4096

_U = np.uint64
FILTER_SCHEMA = "bucket long, seed long, segment long, n_segments long, prints binary"


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _places(keys: np.ndarray, seed: int, segment: int, n_segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three positions in neighbouring segments for each key, and its fingerprint."""
    h = _spread(keys + _U(seed))
    first = ((h >> _U(32)) * _U(n_segments) >> _U(32)).astype(np.int64)
    g = _spread(h)
    mask = segment - 1
    inner = np.stack([(g >> _U(s)).astype(np.int64) & mask for s in (0, 20, 40)])
    return (first + np.arange(3)[:, None]) * segment + inner, (h & _U(255)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """A binary-fuse filter of distinct 64-bit keys: seed, segment length, segments of first positions, fingerprints.

    Peels whole waves of keys that are alone at some position, then assigns the waves backwards."""
    keys = np.unique(keys)
    n = len(keys)
    segment = 1 << max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25))
    n_segments = max(1, int(np.ceil(max(n, 1) * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2))) / segment)))
    for attempt in range(200):
        if attempt and attempt % 20 == 0:
            n_segments = n_segments + n_segments // 8 + 1
        seed = int(_spread(np.array([attempt + 1], _U))[0] >> _U(1))
        at, prints = _places(keys, seed, segment, n_segments)
        size = segment * (n_segments + 2)
        count = np.bincount(at.ravel(), minlength=size)
        who = np.zeros(size, np.int64)
        for row in at:
            np.bitwise_xor.at(who, row, np.arange(n))
        waves, left = [], n
        frontier = np.flatnonzero(count == 1)
        while len(frontier):
            key, pick = np.unique(who[frontier], return_index=True)
            spot = frontier[pick]
            waves.append((key, spot))
            left -= len(key)
            touched = at[:, key]
            for row in touched:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(who, row, key)
            near = np.unique(touched)
            frontier = near[count[near] == 1]
        if not left:
            table = np.zeros(size, np.uint8)
            for key, spot in reversed(waves):
                a, b, c = table[at[:, key]]
                table[spot] = prints[key] ^ a ^ b ^ c ^ table[spot]
            return seed, segment, n_segments, table
    raise RuntimeError("no binary-fuse filter found")


def ask_filter(keys: np.ndarray, seed: int, segment: int, n_segments: int, prints: np.ndarray) -> np.ndarray:
    at, mark = _places(keys, seed, segment, n_segments)
    return (prints[at[0]] ^ prints[at[1]] ^ prints[at[2]]) == mark


def normalised(c: str = "text"):
    """The text without any of the characters 20 and 09 to 0D; null counts as empty."""
    return F.regexp_replace(text_or_empty(c), r"[\x20\x09-\x0D]+", "")


def group_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each (digest, id): n rows, longest. Map-side sums keep a group of copies from meeting in one task."""
    text = text_or_empty(text_col)
    return (
        docs.select(F.col(id_col).alias("id"), F.sha2(normalised(text_col).cast("binary"), 256).alias("sha"), F.length(text).alias("n_chars"))
        .groupBy("sha", "id", "n_chars").agg(F.count(F.lit(1)).alias("n"))
    )


def representatives(digests: DataFrame) -> DataFrame:
    """Of each digest the row that stays: most code points, then smallest id (null last). Bitwise not of the id turns the order round without overflow."""
    best = F.max(F.struct("n_chars", F.bitwise_not("id").alias("inv")))
    return digests.groupBy("sha").agg(best.alias("best"), F.sum("n").alias("size")).select(
        "sha", F.bitwise_not("best.inv").alias("id"), F.col("best.n_chars").alias("n_chars"), "size"
    )


def key_of(sha: str = "sha"):
    """64 bits of the digest as a long, apart from those that choose the bucket."""
    return F.xxhash64(F.col(sha))


def bucket_of(n_buckets: int, sha: str = "sha"):
    return F.pmod(F.conv(F.substring(F.col(sha), 1, 12), 16, 10).cast("long"), F.lit(n_buckets))


def build_filters(snapshot: DataFrame, n_buckets: int) -> DataFrame:
    """One filter row for each bucket of the snapshot's digests."""

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        seed, segment, n_segments, prints = build_filter(pdf["key"].to_numpy(np.int64).view(_U))
        return pd.DataFrame({"bucket": [key[0]], "seed": [seed], "segment": [segment], "n_segments": [n_segments], "prints": [prints.tobytes()]})

    return snapshot.select(bucket_of(n_buckets).alias("bucket"), key_of().alias("key")).groupBy("bucket").applyInPandas(build, FILTER_SCHEMA)


def screen(batch: DataFrame, filters: DataFrame, n_buckets: int) -> DataFrame:
    """The batch's digests that a filter knows: all that the snapshot has, and one in some 256 of the others."""

    def ask(key, pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(pdf):
            return pdf[["sha"]].iloc[:0]
        f = own.iloc[0]
        keys = pdf["key"].to_numpy(np.int64).view(_U)
        return pdf.loc[ask_filter(keys, int(f.seed), int(f.segment), int(f.n_segments), np.frombuffer(f.prints, np.uint8)), ["sha"]]

    asked = batch.select("sha", bucket_of(n_buckets).alias("bucket"), key_of().alias("key"))
    return asked.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(ask, "sha string")


def confirmed(positives: DataFrame, batch: DataFrame, snapshot: DataFrame, texts: DataFrame) -> DataFrame:
    """Positives that join the snapshot's exact bucket and whose text has the same bytes as its representative's."""
    pairs = materialise(positives.join(batch.select("sha", F.col("id").alias("batch_id"), F.col("n_chars").alias("batch_chars")), "sha").join(snapshot.select("sha", F.col("id").alias("snap_id"), F.col("n_chars").alias("snap_chars")), "sha"))
    wanted = pairs.select("sha", F.col("batch_id").alias("wid"), F.col("batch_chars").alias("wchars"), F.lit(True).alias("new")).unionByName(
        pairs.select("sha", F.col("snap_id").alias("wid"), F.col("snap_chars").alias("wchars"), F.lit(False).alias("new"))
    )
    same = (F.length("wtext") == F.col("wchars")) & (F.sha2(normalised("wtext").cast("binary"), 256) == F.col("sha"))
    got = texts.join(wanted.hint("merge"), F.col("tid").eqNullSafe(F.col("wid"))).where(same).select("sha", "new", normalised("wtext").alias("bytes")).dropDuplicates(["sha", "new"])
    new = got.where("new").select("sha", F.col("bytes").alias("a"))
    old = got.where(~F.col("new")).select("sha", F.col("bytes").alias("b"))
    return new.join(old, "sha").where(F.col("a") == F.col("b")).select("sha")


class Snapshot:
    """What never changes of a snapshot: a row for each (digest, id), one for each digest, the filters, and the documents themselves for byte checks."""

    def __init__(self, docs: DataFrame, rows: DataFrame, reps: DataFrame, filters: DataFrame, n_buckets: int):
        self.docs, self.rows, self.reps, self.filters, self.n_buckets = docs, rows, reps, filters, n_buckets


def _digested(docs: DataFrame, id_col: str, text_col: str, keys_per_filter: int, write) -> Snapshot:
    rows = write("rows", group_digests(docs, id_col, text_col))
    reps = write("reps", representatives(rows))
    n_buckets = max(1, -(-reps.count() // keys_per_filter))
    filters = write("filters", build_filters(reps, n_buckets).withColumn("n_buckets", F.lit(n_buckets)))
    return Snapshot(docs.select(F.col(id_col).alias("tid"), text_or_empty(text_col).alias("wtext")), rows, reps, filters.drop("n_buckets"), n_buckets)


def build_snapshot(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keys_per_filter: int = KEYS_PER_FILTER) -> Snapshot:
    """Digests docs once and writes digests and filters to `path`; later batches open them (`open_snapshot`) and hash only themselves."""

    def write(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")

    return _digested(docs, id_col, text_col, keys_per_filter, write)


def open_snapshot(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> Snapshot:
    """The snapshot that `build_snapshot` wrote of the same docs."""
    rows, reps, filters = (docs.sparkSession.read.parquet(f"{path}/{name}") for name in ("rows", "reps", "filters"))
    first = filters.select("n_buckets").first()
    return Snapshot(docs.select(F.col(id_col).alias("tid"), text_or_empty(text_col).alias("wtext")), rows, reps, filters.drop("n_buckets"), first["n_buckets"] if first else 1)


def annotate(batch: DataFrame, snapshot: DataFrame | Snapshot | None = None, id_col: str = "doc_id", text_col: str = "text", keys_per_filter: int = KEYS_PER_FILTER) -> DataFrame:
    """A row for each row of batch and snapshot: id, keep_id, group_size, kept, sha, new (in the batch), known (its text is in the snapshot).

    Texts are equal when identical after white space (20, 09 to 0D) is deleted; null counts as empty.
    Of equal texts the one with most code points stays, then the smallest id; a null id comes last.
    Of rows that repeat an id and text exactly, one counts as kept. An empty table gives no rows;
    other columns, whatever their names, are ignored. A batch group joins the snapshot's only if its digest passed the filter, the exact bucket and the byte check.
    """
    fresh = materialise(group_digests(batch, id_col, text_col).withColumn("new", F.lit(True)))
    fresh_reps = materialise(representatives(fresh))
    if snapshot is None:
        return _label(fresh, fresh_reps.withColumn("new", F.lit(True)).withColumn("known", F.lit(False)), id_col)
    if isinstance(snapshot, DataFrame):
        snapshot = _digested(snapshot, id_col, text_col, keys_per_filter, lambda _, df: materialise(df))
    texts = batch.select(F.col(id_col).alias("tid"), text_or_empty(text_col).alias("wtext")).unionByName(snapshot.docs)
    known = materialise(confirmed(screen(fresh_reps, snapshot.filters, snapshot.n_buckets), fresh_reps, snapshot.reps, texts))
    # Confirmed digests make one group of the batch's and the snapshot's; all others stay groups of their side.
    order = lambda t: F.struct(t["n_chars"].alias("n_chars"), F.bitwise_not(t["id"]).alias("inv"))
    a, b = fresh_reps.alias("a"), snapshot.reps.alias("b")
    both = known.join(a, "sha").join(b, "sha").select("sha", F.greatest(order({c: F.col(f"a.{c}") for c in ("n_chars", "id")}), order({c: F.col(f"b.{c}") for c in ("n_chars", "id")})).alias("best"), (F.col("a.size") + F.col("b.size")).alias("both_size"))
    sides = fresh_reps.withColumn("new", F.lit(True)).unionByName(snapshot.reps.withColumn("new", F.lit(False))).join(both, "sha", "left")
    hit = F.col("best").isNotNull()
    groups = sides.select("sha", "new", F.when(hit, F.bitwise_not("best.inv")).otherwise(F.col("id")).alias("id"), F.when(hit, F.col("best.n_chars")).otherwise(F.col("n_chars")).alias("n_chars"), F.when(hit, F.col("both_size")).otherwise(F.col("size")).alias("size"), hit.alias("known"))
    return _label(fresh.unionByName(snapshot.rows.withColumn("new", F.lit(False))), groups, id_col)


def _label(rows: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    """Rows with the group of their digest and side. groups has one row for each of these, so a hot digest is on one side only and a skewed join splits it."""
    g = groups.select(F.col("sha").alias("gsha"), F.col("new").alias("gnew"), F.col("id").alias("keep_id"), F.col("n_chars").alias("keep_chars"), F.col("size").alias("group_size"), F.col("known").alias("gknown"))
    best = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
    return (
        rows.join(g, (F.col("sha") == F.col("gsha")) & (F.col("new") == F.col("gnew")))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        .select(F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"), (best & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"), "new", (F.col("new") & F.col("gknown")).alias("known"), F.col("n").alias("n_same"))
    )


def keep_documents(docs: DataFrame, snapshot: DataFrame | Snapshot | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns as they came; with a snapshot, texts that it has are gone.

    Rows that repeat id and text give one row, the smallest by their other columns' JSON."""
    marks = annotate(docs, snapshot, id_col, text_col) if snapshot is not None else annotate(*halves(docs, id_col), id_col, text_col)
    stay = marks.where(F.col("kept") & F.col("new") & ~F.col("known")) if snapshot is not None else marks.where("kept")
    sid, ssha, sn, sha, row = (free_name(docs, x) for x in ("stay_id", "stay_sha", "stay_n", "own_sha", "own_row"))
    stay = stay.select(F.col(id_col).alias(sid), F.col("text_sha256").alias(ssha), F.col("n_same").alias(sn))
    own = docs.withColumn(sha, F.sha2(normalised(text_col).cast("binary"), 256))
    both = own.join(stay, own[id_col].eqNullSafe(F.col(sid)) & (F.col(sha) == F.col(ssha)))
    names = [F.col(f"`{c}`") for c in docs.columns]
    # An id met more than once with one text is rare; its rows are folded map-side.
    folded = both.where(F.col(sn) > 1).groupBy(id_col, sha).agg(F.min_by(F.struct(*names), F.concat(F.lpad(F.length(text_or_empty(text_col)).cast("string"), 12, "0"), F.to_json(F.struct(*names)))).alias(row))
    return both.where(F.col(sn) == 1).select(*names).unionByName(folded.select(f"{row}.*"))


def halves(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """A corpus without an older snapshot: the rows with even crc32(id) play the snapshot, the others the new batch."""
    old = F.coalesce(crc_fold(id_col, 2) == 0, F.lit(True))
    return docs.where(~old), docs.where(old)
