"""WARC fixity audit with Merkle trees.

Records of a WARC file lie at byte offsets. Each record is hashed; the records that begin in one range of RANGE bytes make a leaf,
whose hash covers their offsets, lengths and digests in order; FANOUT neighbouring nodes make a node of the next level, up to one
root for each file. Two replicas are compared from the roots down: only children of nodes that differ are looked at on the next
level, and only records in ranges that differ are compared one by one. What an operator step groups is bounded: the records of one
range, or FANOUT nodes."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise, text_or_empty

#: Bytes of a leaf's range; children of a node; records of a file that `lay_out` makes, on average.
RANGE, FANOUT, FILE_RECORDS = 1 << 16, 16, 512


# Reading and writing files


_NEXT = b"\r\n\r\nWARC/"


def parse_records(data: bytes) -> Iterator[tuple[int, int, str, str, bytes]]:
    """Offset, length, type, target and block of each record in an uncompressed WARC file; their stretches cover the file.

    What is no record (no WARC line or end of header, a Content-Length that is absent, no number, or does not end at the two line ends that close a
    record) is one stretch of type `corrupt`, without target, up to the next WARC line that follows two line ends; there reading goes on."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at) if data.startswith(b"WARC/", at) else -1
        head = {k.lower(): v for k, v in (m.groups() for m in re.finditer(rb"(?m)^([\w-]+):[ \t]*(.*?)\r?$", data[at:end]))} if end >= 0 else {}
        said = head.get(b"content-length", b"")
        size = int(said) if re.fullmatch(rb"[0-9]{1,18}", said) else -1
        stop = end + 4 + size + 4
        if end >= 0 and size >= 0 and data[stop - 4 : stop] == b"\r\n\r\n":
            yield at, stop - at, head.get(b"warc-type", b"").decode("utf-8", "replace"), head.get(b"warc-target-uri", b"").decode("utf-8", "replace"), data[end + 4 : end + 4 + size]
        else:
            found = data.find(_NEXT, at)
            stop = found + 4 if found >= 0 else len(data)
            yield at, stop - at, "corrupt", "", data[at:stop]
        at = stop


def unzipped(raw: bytes) -> bytes:
    """The bytes of a gzipped file, member by member, as far as they can be read; other files as they are."""
    if raw[:2] != b"\x1f\x8b":
        return bytes(raw)
    out, rest = [], bytes(raw)
    while rest:
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(rest))
        except zlib.error:
            break
        rest = member.unused_data
    return b"".join(out)


def read_warc(files: DataFrame, name_col: str = "path", content_col: str = "content") -> DataFrame:
    """Records (file, offset, length, type, uri, sha256) of files as Spark's binaryFile source gives them, gzipped or not.

    Offsets are those of the unzipped bytes. Damage gives rows of type `corrupt` (see `parse_records`); of a broken gzip file what can be read counts.
    A null content has no records. A worker holds one file at a time, so files should be of the usual size of about a GB at most."""
    import hashlib

    def run(batches):
        for pdf in batches:
            for name, raw in zip(pdf["file"], pdf["raw"], strict=True):
                data = unzipped(raw)
                rows = [(name, o, n, t, u, hashlib.sha256(memoryview(data)[o : o + n]).hexdigest()) for o, n, t, u, _ in parse_records(data)]
                yield pd.DataFrame(rows, columns=["file", "offset", "length", "type", "uri", "sha256"])

    return files.select(F.regexp_extract(F.col(name_col), "([^/]+)$", 1).alias("file"), F.col(content_col).alias("raw")).where(F.col("raw").isNotNull()).mapInPandas(run, "file string, offset long, length long, type string, uri string, sha256 string")


def record_text(uri: str = "url", body: str = "html"):
    """A WARC response record as text; null counts as empty. Length is in UTF-8 bytes."""
    block = text_or_empty(body)
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), text_or_empty(uri), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n"))


def lay_out(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html", file_records: int = FILE_RECORDS) -> DataFrame:
    """Record table of an archive written from pages: file (a number), offset, length, sha256, record_id, copy.

    Pages are dealt into files by a digest of the whole row, so no id or host can fill a file; in a file they lie in order of id, null first, then digest.
    Rows that repeat in all three columns are records of their own, one behind the other, `copy` counting from 0. No rows give no records.
    Other columns, whatever their names, play no part. `stored_sha256` is the digest of the bytes that a replica with known damage holds (see `decayed`)."""
    text = record_text("uri", "body")
    rows = pages.select(F.col(id_col).alias("record_id"), F.col(uri_col).alias("uri"), F.col(body_col).alias("body"))
    rows = rows.select("record_id", text.alias("text"), F.sha2(text.cast("binary"), 256).alias("sha256"))
    rows = rows.select("record_id", F.octet_length("text").cast("long").alias("length"), "sha256", F.sha2(decayed(F.col("text"), F.col("sha256")).cast("binary"), 256).alias("stored_sha256"))
    rows = materialise(rows.groupBy("record_id", "length", "sha256", "stored_sha256").agg(F.count(F.lit(1)).alias("n")))
    files = max(1, -(-rows.count() // file_records))
    dealt = F.sha2(F.concat_ws("|", F.coalesce(F.col("record_id").cast("string"), F.lit("-")), "sha256").cast("binary"), 256)
    rows = rows.withColumn("file", F.pmod(F.conv(F.substring(dealt, 1, 8), 16, 10).cast("long"), F.lit(files)))
    line = Window.partitionBy("file").orderBy(F.col("record_id").asc_nulls_first(), "sha256")
    rows = rows.withColumn("first", F.sum(F.col("length") * F.col("n")).over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length") * F.col("n"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return rows.select("file", (F.col("first") + F.col("copy") * F.col("length")).alias("offset"), "length", "sha256", "record_id", "copy", "stored_sha256")


def decayed(text: Column, sha: Column) -> Column:
    """The bytes that a decaying replica holds of a record: of some, chosen by the record's digest, one bit of the header has flipped."""
    return F.when(F.substring(sha, 1, 2) == "2a", F.regexp_replace(text, "^((?s:.*?)Content-Type: )text", "$1Text")).otherwise(text)


# Trees


def leaves(records: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """file, node, hash: one leaf for each range of offsets in which records begin."""
    entry = F.concat_ws(" ", F.lpad(F.col("offset").cast("string"), 20, "0"), F.col("length").cast("string"), F.col("sha256"))
    return records.groupBy("file", F.floor(F.col("offset") / F.lit(range_bytes)).cast("long").alias("node")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "\n").cast("binary"), 256).alias("hash"))


def above(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The next level of a tree."""
    child = F.concat_ws(" ", F.lpad(F.col("node").cast("string"), 20, "0"), F.col("hash"))
    return nodes.groupBy("file", F.floor(F.col("node") / F.lit(fanout)).cast("long").alias("node")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(child)), "\n").cast("binary"), 256).alias("hash"))


def tree(records: DataFrame, levels: int, range_bytes: int = RANGE, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the leaves to the roots."""
    out = [leaves(records, range_bytes)]
    for _ in range(levels):
        out.append(above(out[-1], fanout))
    return out


def depth(largest_offset: int, range_bytes: int = RANGE, fanout: int = FANOUT) -> int:
    levels, span = 0, range_bytes
    while span <= largest_offset:
        span, levels = span * fanout, levels + 1
    return levels


def audit(ours: DataFrame, theirs: DataFrame, range_bytes: int = RANGE, fanout: int = FANOUT) -> DataFrame:
    """file, offset and status (corrupt, missing, extra) of every record in which the replica `theirs` differs from `ours`.

    Both are tables with file, offset, length, sha256; a file's offsets are distinct. Equal replicas give no rows, and cost their roots' comparison."""
    top = ours.agg(F.max("offset").alias("m")).unionByName(theirs.agg(F.max("offset").alias("m"))).agg(F.max("m")).first()[0]
    if top is None:
        return ours.sparkSession.createDataFrame([], f"file {dict(ours.dtypes)['file']}, offset long, status string")
    levels = depth(int(top), range_bytes, fanout)
    a = [materialise(x) for x in tree(ours, levels, range_bytes, fanout)]
    b = [materialise(x) for x in tree(theirs, levels, range_bytes, fanout)]
    odd = None
    for level in range(levels, -1, -1):
        x, y = a[level], b[level]
        if odd is not None:
            parent = odd.select("file", F.col("node").alias("parent"))
            x, y = (t.withColumn("parent", F.floor(F.col("node") / F.lit(fanout)).cast("long")).join(parent, ["file", "parent"], "left_semi").drop("parent") for t in (x, y))
        odd = x.select("file", "node", F.col("hash").alias("ha")).join(y.select("file", "node", F.col("hash").alias("hb")), ["file", "node"], "full").where(~F.col("ha").eqNullSafe(F.col("hb"))).select("file", "node")
    odd = materialise(odd)

    def within(t: DataFrame, tag: str) -> DataFrame:
        own = t.select("file", "offset", F.concat_ws(" ", F.col("length").cast("string"), "sha256").alias(tag), F.floor(F.col("offset") / F.lit(range_bytes)).cast("long").alias("node"))
        return own.join(odd, ["file", "node"], "left_semi").drop("node")

    both = within(ours, "x").join(within(theirs, "y"), ["file", "offset"], "full").where(~F.col("x").eqNullSafe(F.col("y")))
    return both.select("file", "offset", F.when(F.col("x").isNull(), "extra").when(F.col("y").isNull(), "missing").otherwise("corrupt").alias("status"))


def damage(records: DataFrame) -> DataFrame:
    """The replica with known damage, for tests and the query: some records' bytes have changed (and are hashed as they are), some are lost, some are there twice.

    Which ones follows from the record's digest, so any engine can tell."""
    mark = F.substring("sha256", 1, 2)
    kept = records.where(mark != "07")
    again = kept.where(mark == "c3").withColumn("offset", F.col("offset") + 1)
    return kept.unionByName(again).withColumn("sha256", F.col("stored_sha256"))
