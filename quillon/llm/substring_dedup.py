"""Substring deduplication: Rabin-Karp hashes of every window of `width` words, compared in Spark.

Documents are dealt into chunks that are ranges of doc_id, cut at quantiles. A chunk hashes all its windows, drops those that it has
met earlier itself, and sends the sorted distinct hashes on, dealt by a second, independent hash into buckets. A bucket
sees every chunk's hashes of its range; for each hash the first chunk, in order of doc_id, owns it. Every other
chunk gets one bit for each hash it sent: starts earlier or not. The chunk then marks the words of such windows; runs of
marked words are the maximal removal intervals. So a window costs 8 bytes in the shuffle and the texts move once.

A false match needs equal 64-bit hashes within one bucket, which another hash of other word hashes chooses. The number of buckets follows the input, so the
expected number of false matches grows in proportion to the windows (some 1e-13 for each), not with their square.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _words as W

#: Text of a chunk in bytes, and hashes of a bucket, on average; bounds of chunks that are looked up one by one; seed of the second word hash.
CHUNK_BYTES, BUCKET_HASHES, MOST_BOUNDS, SECOND = 6_000_000, 1_000_000, 20_000, 0xC2B2AE3D27D4EB4F
_U = np.uint64
OUT = "doc_id long, n_words long, n_removed long, intervals array<struct<first:int,last:int>>, kept_sha256 string"
OUT_FULL = "doc_id long, n_words long, n_removed long, intervals array<struct<first:int,last:int>>, kept string, kept_sha256 string"


def _sorted_rows(t: pa.Table) -> pa.Table:
    """In order of doc_id, null last; rows that repeat an id in order of their text."""
    t = t.combine_chunks()
    return t.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _windows(t: pa.Table, width: int, n_buckets: int):
    """For the chunk's windows in order: bucket, hash, their first word; words of rows."""
    data, offsets = W.buffers(t.column("text"))
    hashes, firsts, rows = [], [], []
    base = 0
    buckets, at_all = [], []
    for lo, hi in W.blocks(offsets):
        some, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = W.words(some, off)
        w = W.hash_words(some, starts, ends)
        at, _ = W.windows_in_rows(first, width)
        if len(at):
            hashes.append(W.hash_windows(w, width)[at])
            second = W.hash_windows(W.hash_words(some, starts, ends, SECOND), width, W.WORD_BASE_2)
            buckets.append((second[at] % _U(n_buckets)).astype(np.int64))
        at_all.append(at + base)
        firsts.append(first[:-1] + base)
        rows.append((lo, hi, some, starts, ends, first, base))
        base += len(starts)
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return cat(buckets, np.int64), cat(hashes, _U), cat(at_all, np.int64), rows, base


def _distinct(buckets: np.ndarray, hashes: np.ndarray):
    """Windows in order of (bucket, hash, place): that order, which of them are first of their hash, and where buckets begin."""
    order = np.lexsort((hashes, buckets))  # stable: equal hashes stay in order of place
    b, h = buckets[order], hashes[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (b[1:] != b[:-1]) | (h[1:] != h[:-1])
    return order, fresh, b[fresh], h[fresh]


def _place(bounds: list[int], value: Column) -> Column:
    """How many of the sorted bounds the value has reached, by halving."""
    steps = F.array(*[F.lit(1 << b) for b in range(len(bounds).bit_length() - 1, -1, -1)])
    all_ = F.lit(bounds)
    return F.aggregate(steps, F.lit(0), lambda at, jump: F.when(F.get(all_, at + jump - 1) <= value, at + jump).otherwise(at))


def chunked(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> tuple[DataFrame, int]:
    """docs as (chunk, doc_id, text), and their bytes. Chunks are ranges of doc_id in order (null last) that hold about as many documents each, however ids lie.

    Their bounds are quantiles, at most MOST_BOUNDS; with more chunks than that each range is cut into equal parts."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    s = base.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum(F.octet_length("text").cast("long")).alias("size")).first()
    lo, hi, size = s["lo"] or 0, s["hi"] or 0, s["size"] or 0
    n = max(1, -(-size // chunk_bytes))
    ranges = min(n, MOST_BOUNDS)
    bounds = []
    if ranges > 1:
        asked = [i / ranges for i in range(1, ranges)]
        bounds = sorted(set(base.agg(F.percentile_approx("doc_id", asked, 20 * ranges).alias("q")).first()["q"] or []))
    parts = -(-n // ranges)
    edges = [lo, *bounds, hi + 1]
    at = _place(bounds, F.col("doc_id")) if bounds else F.lit(0)
    own = base.select("doc_id", "text", at.alias("at"))
    if parts > 1:
        start, end = F.get(F.lit(edges), F.col("at")), F.get(F.lit(edges), F.col("at") + 1)
        part = F.least(F.floor((F.col("doc_id") - start) / F.greatest(end - start, F.lit(1)) * F.lit(parts)), F.lit(parts - 1))
        own = own.withColumn("at", F.col("at") * F.lit(parts) + part)
    chunk = F.when(F.col("doc_id").isNull(), F.lit(ranges * parts + 1)).otherwise(F.col("at")).cast("long")
    return own.select(chunk.alias("chunk"), "doc_id", "text"), size


def remove_repeats(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, intervals (first and last word removed, 0-based, maximal), kept text (words joined by one space), kept_sha256.

    A word goes if some window of `width` words that covers it has a word sequence that also starts earlier: in a smaller
    doc_id, or earlier in the same document. Windows are judged on the input. A null or empty text has no words. Documents shorter than a window
    stay whole. A null id counts as larger than any. Rows that repeat an id are judged as separate documents, in order of text. Other columns, whatever their names, play no part. No rows give no rows.
    """
    rows, size = chunked(docs, id_col, text_col, chunk_bytes)
    n_buckets = max(1, -(-size // 6 // BUCKET_HASHES))

    def hash_chunk(t: pa.Table) -> pa.Table:
        chunk = t.column("chunk")[0].as_py()
        buckets, hashes, _, _, _ = _windows(_sorted_rows(t), width, n_buckets)
        _, _, b, h = _distinct(buckets, hashes)
        names, begin = np.unique(b, return_index=True)
        cuts = np.append(begin, len(h))
        blobs = [h[cuts[i] : cuts[i + 1]].tobytes() for i in range(len(names))]
        return pa.table({"chunk": pa.array([chunk] * len(names), pa.int64()), "bucket": pa.array(names, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    def judge_bucket(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        order = np.argsort(t.column("chunk").to_numpy(), kind="stable")
        blobs = t.column("blob")
        arrays = [np.frombuffer(blobs[int(i)].as_buffer(), _U) for i in order]
        sizes = [len(a) for a in arrays]
        allh = np.concatenate(arrays) if arrays else np.zeros(0, _U)
        by = np.argsort(allh, kind="stable")  # equal hashes in order of chunk
        again = np.zeros(len(allh), bool)
        s = allh[by]
        again[by[1:]] = s[1:] == s[:-1]
        ends = np.cumsum(sizes)
        bits = [np.packbits(again[e - m : e]).tobytes() for e, m in zip(ends, sizes, strict=True)]
        return pa.table({"chunk": t.column("chunk").take(pa.array(order)), "bucket": t.column("bucket").take(pa.array(order)), "bits": pa.array(bits, pa.binary())})

    def mark_chunk(t: pa.Table, replies: pa.Table) -> pa.Table:
        t = _sorted_rows(t)
        buckets, hashes, at, parts, n_words = _windows(t, width, n_buckets)
        order, fresh, b, _ = _distinct(buckets, hashes)
        earlier = np.zeros(len(b), bool)
        got = {k.as_py(): v for k, v in zip(replies.column("bucket"), replies.column("bits"), strict=True)}
        names, begin = np.unique(b, return_index=True)
        cuts = np.append(begin, len(b))
        for i, name in enumerate(names):
            m = int(cuts[i + 1] - cuts[i])
            earlier[cuts[i] : cuts[i + 1]] = np.unpackbits(np.frombuffer(got[int(name)].as_buffer(), np.uint8), count=m).astype(bool)
        repeats = ~fresh | earlier[np.cumsum(fresh) - 1] if len(order) else np.zeros(0, bool)
        delta = np.zeros(n_words + 1, np.int32)
        where = at[order[repeats]]
        np.add.at(delta, where, 1)
        np.add.at(delta, where + width, -1)
        gone = np.cumsum(delta[:-1]) > 0
        ids = t.column("doc_id")
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_words", "n_removed", "intervals", "kept", "kept_sha256")}
        for lo, hi, some, starts, ends, first, base in parts:
            raw = some.tobytes()
            for r in range(lo, hi):
                a, z = int(first[r - lo]), int(first[r - lo + 1])
                mine = gone[base + a : base + z]
                kept, runs = _kept(raw, starts[a:z], ends[a:z], mine)
                out["doc_id"].append(ids[r].as_py())
                out["n_words"].append(z - a)
                out["n_removed"].append(int(mine.sum()))
                out["intervals"].append(runs)
                if with_text:
                    out["kept"].append(kept.decode("utf-8", "replace"))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "intervals": pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])), "kept": pa.string(), "kept_sha256": pa.string()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items() if with_text or k != "kept"})

    by_chunk = rows.groupBy("chunk")
    sent = by_chunk.applyInArrow(hash_chunk, "chunk long, bucket long, blob binary")
    judged = sent.groupBy("bucket").applyInArrow(judge_bucket, "chunk long, bucket long, bits binary")
    return by_chunk.cogroup(judged.groupBy("chunk")).applyInArrow(mark_chunk, OUT_FULL if with_text else OUT)


def _kept(raw: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> tuple[bytes, list[dict]]:
    """Words that stay, joined by one space, and the runs of those that go."""
    if not len(starts):
        return b"", []
    lo, hi = int(starts[0]), int(ends[-1])
    if not gone.any():
        return b" ".join(raw[lo:hi].split()), []  # bytes.split() cuts at 20 and 09 to 0D alone
    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
    runs = [{"first": int(a), "last": int(z) - 1} for a, z in zip(edge[::2], edge[1::2], strict=True)]
    return b" ".join(raw[s:e] for s, e in zip(starts[~gone], ends[~gone], strict=True)), runs

