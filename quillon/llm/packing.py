"""Best-two-fit packing of token sequences.

Only lengths matter to a packing, and there are at most `capacity` of them. So Spark counts the lengths,
the plan is made on that histogram (each step packs as many equal bins as the counts allow), and every
piece finds its sequence from its rank among the pieces of its length. Nothing that grows with the corpus
reaches the driver."""

from __future__ import annotations

import array
import base64
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise

CAPACITY = 2048
#: Ids of one worker's remembered words.
MEMO = 400_000

_SPACED = re.compile(r"\s\s|^ | $|\0")
_CUT = re.compile(r"(?<=\S)(?= \S)")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Encoder(dict):
    """Token ids (little-endian 32-bit) of parts of text, remembered.

    Parts are cut before a blank between two non-blanks, where the tokenizer always starts a new word, so the ids of a
    text are those of its parts in turn. The vocabulary's merges are applied by the fast encoder, on the same vocabulary as ranks.
    Before that a text is cut at the JSON's added tokens, wherever they stand; each is one id."""

    def __init__(self, path: str):
        import tiktoken

        import public_tokenizers

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path[: -len(".json")] + ".tiktoken", "rb"))}
        self.core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        added = json.load(open(path, encoding="utf-8"))["added_tokens"]
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in added):
            raise ValueError(f"added tokens of {path} that are not found literally")
        self.added = {a["content"]: array.array("I", [a["id"]]).tobytes() for a in added}
        longest = sorted(self.added, key=len, reverse=True)
        self.at_added = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if added else None

    def __missing__(self, part: str) -> bytes:
        if len(part) > 2 and part[-1] in ".," and part[-2].isalpha():
            ids = self[part[:-1]] + self[part[-1]]
        else:
            ids = array.array("I", self.core(part)).tobytes()
        if len(part) <= 40:
            if len(self) >= MEMO:
                self.clear()
            self[part] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            # Odd places hold the added tokens, even ones what lies between.
            return b"".join(self.added[x] if i % 2 else self.plain_ids(x) for i, x in enumerate(self.at_added.split(text)) if x)
        return self.plain_ids(text)

    def plain_ids(self, text: str) -> bytes:
        parts = _CUT.split(text) if _SPACED.search(text) else text.replace(" ", "\0 ").split("\0")
        return b"".join(map(self.__getitem__, parts))


_encoders: dict[str, _Encoder] = {}


def tokenise(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """The pieces of every document: its ids and an end id 0, cut into full pieces from the end, so that the first may be shorter."""
    path = path or vocabulary_path()

    def run(batches):
        enc = _encoders.get(path) or _encoders.setdefault(path, _Encoder(path))
        for batch in batches:
            ids, cols = batch.column(0), ([], [], [], [], [])
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or ""
                raw = (enc.ids(text) if text else b"") + b"\0\0\0\0"
                n, at, k = len(raw) // 4, 0, 0
                doc = ids[i].as_py()
                while at < n:
                    end = at + ((n - at) % capacity or capacity)
                    for c, v in zip(cols, (doc, k, at, end - at, zlib.crc32(memoryview(raw)[4 * at : 4 * end])), strict=True):
                        c.append(v)
                    at, k = end, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bins as (lengths in the bin, number of such bins), from the number of pieces of each length.

    A bin starts with the longest piece left and is filled greedily with the longest that fits. Then its smallest piece
    gives way to two unpacked ones where these fill the widened gap more tightly; the pair that leaves least is taken."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    out, sizes = [], np.arange(capacity + 1)
    while left.any():
        # The longest length with pieces left, at or below each length (0: none).
        def floor_of(avail: np.ndarray) -> np.ndarray:
            return np.maximum.accumulate(np.where(avail > 0, sizes, 0))

        avail, bin_, gap = left.copy(), [], capacity
        below = floor_of(avail)
        while gap and below[gap]:
            take = int(below[gap])
            bin_.append(take)
            avail[take] -= 1
            gap -= take
            if not avail[take]:
                below = floor_of(avail)
        if gap and len(bin_) > 1:
            small = min(bin_)
            room = gap + small
            first = np.flatnonzero(avail[: room] > 0)
            second = below[room - first]
            alone = (second == first) & (avail[first] < 2)
            for i in np.flatnonzero(alone):
                second[i] = below[first[i] - 1] if first[i] > 1 else 0
            total = np.where(second > 0, first + second, 0)
            if len(total) and total.max() > small:
                j = int(total.argmax())
                bin_.remove(small)
                bin_ += [int(first[j]), int(second[j])]
        used = np.bincount(bin_, minlength=capacity + 1)
        times = int((left[used > 0] // used[used > 0]).min())
        left -= used * times
        out.append((bin_, times))
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, length, ...) with sequence_id and offset. An empty table gives none; repeated rows are pieces of their own."""
    spark = pieces.sparkSession
    pieces = materialise(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, next_rank, base = [], {}, 0
    for lengths, times in plan(counts, capacity):
        offset = 0
        for length in lengths:
            start = next_rank.get(length, 0)
            slots.append((length, start, start + times, base, offset))
            next_rank[length] = start + times
            offset += length
        base += times
    # Rank of a piece among those of its length: parts of a length are counted, parts before are summed, rows ranked within.
    total = sum(counts.values())
    parts = max(32, min(4096, total // 50_000))
    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts))
    keyed = pieces.withColumn("part", part)
    sizes = keyed.groupBy("length", "part").agg(F.count(F.lit(1)).alias("m"))
    before = sizes.select("length", "part", (F.sum("m").over(Window.partitionBy("length").orderBy("part")) - F.col("m")).alias("before"))
    ranked = keyed.withColumn("r", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start"))).join(before, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("r") - 1)
    # The plan as one array per length: its slots in order of rank. A piece finds its own by halving: the last that starts at or before its rank.
    by_length: dict[int, list] = {}
    for length, start, _, seq, offset in slots:
        by_length.setdefault(length, []).append((start, seq, offset))
    most = max((len(v) for v in by_length.values()), default=1)
    look = spark.createDataFrame([(k, v) for k, v in sorted(by_length.items())], "length long, slots array<struct<start:long,seq:long,at:long>>")
    steps = F.array(*[F.lit(1 << b) for b in range(most.bit_length() - 1, -1, -1)])
    last = F.aggregate(steps, F.lit(0), lambda at, jump: F.when(F.get("slots", at + jump)["start"] <= F.col("rank"), at + jump).otherwise(at))
    # At most `capacity` rows of lengths, whatever the corpus.
    placed = ranked.join(F.broadcast(look), "length").withColumn("slot", F.get("slots", last))
    keep = [c for c in pieces.columns]
    return placed.select(*keep, (F.col("slot.seq") + F.col("rank") - F.col("slot.start")).alias("sequence_id"), F.col("slot.at").alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document; a null text counts as empty (one end id).

    Added tokens of the vocabulary that stand in a text are one id each, as its JSON says. A null id stays null; rows that repeat are packed
    each for itself; other columns, whatever their names, play no part; no rows give none."""
    return pack(tokenise(docs, capacity, id_col, text_col), capacity)
