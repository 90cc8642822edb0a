"""Near-duplicates by ProbMinHash over weighted five-word shingles, banding and exact verification.

Each shingle d of weight w is a Poisson process of rate w; its arrivals fall on random ones of m registers, and a
register keeps the shingle that arrives first. Two documents agree on a register with probability J_P, the probability
Jaccard similarity. Shingles are handled in waves: all first arrivals, then the second ones of those that can still win,
until no arrival can come before the latest register; long documents stop after about one arrival a shingle.

Registers are cut into bands; documents that share a band are candidates. Within a band's bucket no pairs are listed: see
`link_buckets`. Every pair of a bucket is either compared, already connected, or known to be less similar.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _words as W
from ._common import free_name, materialise, text_or_empty

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 5
_U = np.uint64


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> _U(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE):
    """Distinct shingles of each row: row, hash, count; and words of each row. A row with fewer words has one shingle, all its words."""
    starts, ends, first = W.words(data, offsets)
    w = W.hash_words(data, starts, ends)
    n_words = np.diff(first)
    at, row = W.windows_in_rows(first, width)
    h = W.hash_windows(w, width)[at] if len(at) else np.zeros(0, _U)
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(short):
        extra = np.array([int(W.hash_windows(w[first[r] : first[r + 1]], int(n_words[r]))[0]) for r in short], _U)
        h, row = np.concatenate([h, extra]), np.concatenate([row, short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(fresh)
    count = np.diff(np.append(at, len(h)))
    return row[at], h[at], count, n_words, (w, first)


def digests(w: np.ndarray, first: np.ndarray) -> np.ndarray:
    """16 bytes for each row's sequence of word hashes, as two columns of longs."""
    out = b"".join(hashlib.blake2b(w[a:z], digest_size=16).digest() for a, z in zip(first[:-1], first[1:], strict=True))
    return np.frombuffer(out, np.int64).reshape(-1, 2)


def weight(count: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(count)


def signatures(row: np.ndarray, h: np.ndarray, w: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """ProbMinHash: for each row and register the hash of the shingle that arrives there first (0 if the row has none)."""
    early = np.full(n_rows * m, np.inf)
    who = np.zeros(n_rows * m, _U)
    at = np.zeros(len(h))
    live = np.arange(len(h))
    wave = 0
    while len(live):
        wave += 1
        r = W.mix(h[live] + _U((wave * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        at[live] += -np.log(_uniform(r)) / w[live]
        place = row[live] * m + (W.mix(r ^ _U(0xA5A5A5A5A5A5A5A5)) % _U(m)).astype(np.int64)
        t = at[live]
        np.minimum.at(early, place, t)
        won = early[place] == t
        who[place[won]] = h[live][won]
        last = early.reshape(n_rows, m).max(1)
        live = live[t < last[row[live]]]
    return who.reshape(n_rows, m)


def probability_jaccard(ha: np.ndarray, hb: np.ndarray) -> float:
    """Exact J_P of two sorted multisets of shingles."""
    a, ca = np.unique(ha, return_counts=True)
    b, cb = np.unique(hb, return_counts=True)
    if not len(a) or not len(b):
        return 0.0
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    if ca.max() == 1 and cb.max() == 1:
        return len(both) / (len(a) + len(b) - len(both))
    wa, wb = weight(ca), weight(cb)
    xa, xb = wa[ia], wb[ib]
    ratio = xa / xb
    order = np.argsort(ratio)
    ra, rb, r = xa[order], xb[order], ratio[order]
    only_a, only_b = wa.sum() - xa.sum(), wb.sum() - xb.sum()
    tail = only_a + np.append(np.cumsum(ra[::-1])[::-1], 0.0)
    head = only_b + np.append(0.0, np.cumsum(rb))
    lo = np.searchsorted(r, r, "left")
    return float((ra / (tail[lo] + r * head[lo])).sum())


def sign(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """id, n_words, d1, d2 (digest of the words) and band hashes of every document."""

    def run(batches):
        for batch in batches:
            data, offsets = W.buffers(batch.column(1))
            ids = batch.column(0)
            for lo, hi in W.blocks(offsets):
                row, h, count, n_words, seq = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
                d = digests(*seq)
                sig = signatures(row, h, weight(count), hi - lo, bands * rows)
                mixed = np.zeros((hi - lo, bands), _U)
                for i in range(rows):
                    mixed = W.mix(mixed * _U(W.WORD_BASE) + sig[:, i::rows])
                mixed = W.mix(mixed + np.arange(1, bands + 1, dtype=_U) * _U(W.WORD_BASE_2))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * bands), pa.array(mixed.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n_words, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), flat], ["id", "n_words", "d1", "d2", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "id long, n_words long, d1 long, d2 long, bands array<long>")


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """id and its sorted shingles with repeats, 8 bytes each."""

    def run(batches):
        for batch in batches:
            data, offsets = W.buffers(batch.column(1))
            for lo, hi in W.blocks(offsets):
                row, h, count, *_ = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                blobs = [np.repeat(h[a:z], count[a:z]).tobytes() for a, z in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(blobs, pa.binary())], ["id", "set"])

    return texts.mapInArrow(run, "id long, set binary")


def verify(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b) those with J_P of at least `similarity`. One a may be in very many pairs: b's set is fetched first, so what meets a's is large enough to be split."""

    def run(batches):
        for batch in batches:
            a, b, sa, sb = (batch.column(i) for i in range(4))
            keep = [probability_jaccard(np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)) >= similarity for x, y in zip(sa, sb, strict=True)]
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    return _with_sets(pairs, sets).mapInArrow(run, "a long, b long")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, sa, sb and the other columns of pairs. Merge joins at every size: sets grow with the corpus."""
    more = [c for c in pairs.columns if c not in ("a", "b")]
    own = sets.select(F.col("id").alias("b"), F.col("set").alias("sb")).hint("merge")
    heads = sets.select(F.col("id").alias("a"), F.col("set").alias("sa")).hint("merge")
    return pairs.join(own, "b").join(heads, "a").select("a", "b", "sa", "sb", *more)


def components(links: DataFrame) -> DataFrame:
    """id, comp (smallest id connected) of all ends of links (a, b).

    Every node repeatedly takes the smallest label around it, then its label's label; each round is written out."""
    edges = materialise(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = materialise(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), F.col("comp").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        step = labels.join(near, "id").select("id", F.least("comp", "c").alias("comp"), F.col("comp").alias("old"))
        jump = step.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        new = materialise(step.join(jump, "comp", "left").select("id", F.least("comp", F.coalesce("up", "comp")).alias("comp"), "old"))
        labels = new.select("id", "comp")
        if new.where(F.col("comp") != F.col("old")).isEmpty():
            return labels


def connect(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps (id, comp) after more links: those join labels, and only the labels they join are walked again."""
    own = lambda c: comps.select(F.col("id").alias(c), F.col("comp").alias(f"c{c}"))
    ends = links.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where(F.col("a") != F.col("b"))
    top = components(ends)
    nodes = comps.unionByName(top.select("id", F.col("id").alias("comp")).join(comps, "id", "left_anti"))
    return materialise(nodes.join(top.select(F.col("id").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("id", F.coalesce("top", "comp").alias("comp")))


def _label(member: DataFrame, comps: DataFrame) -> DataFrame:
    return member.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def link_buckets(member: DataFrame, sets: DataFrame, similarity: float, small: int = 16, hubs: int = 3) -> DataFrame:
    """id, comp of the documents that links connect, if similar ones share a bucket, without listing a large bucket's pairs.

    The document in most and largest buckets is a bucket's hub. Hubs are compared with the rest of their buckets a few
    times over, each time among those no hub has reached. A bucket that then still holds several components is settled exactly: a small
    one by its pairs; in a large one, documents d and e, of which the hub h does not reach d, share shingles that h lacks, or all they share lies in h
    (`sharing` finds both kinds of pairs from their rarest shared shingle)."""
    size = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    sized = member.join(size, "bucket")
    central = sized.groupBy("id").agg(F.sum("n").alias("w"))
    member = materialise(sized.join(central, "id").select("bucket", "id", "w"))
    hub = F.max(F.struct("w", (-F.col("id")).alias("i"))).alias("m")
    first, comps, rest = None, None, member
    for _ in range(hubs):
        lead = materialise(rest.groupBy("bucket").agg(hub, F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", (-F.col("m.i")).alias("a")))
        meets = rest.join(lead, "bucket").where(F.col("id") != F.col("a")).select("a", F.col("id").alias("b")).distinct()
        found = materialise(verify(meets, sets, similarity))
        if comps is None:
            comps = components(found)
        elif not found.isEmpty():
            comps = connect(comps, found)
        head = lead.join(comps.select(F.col("id").alias("a"), F.col("comp").alias("acomp")), "a", "left").select("bucket", "a", F.coalesce("acomp", "a").alias("acomp"))
        # Who is with a hub is placed; the others of a bucket that is not small go on among themselves.
        rest = materialise(_label(rest, comps).join(head, "bucket").where((F.col("comp") != F.col("acomp")) & (F.col("id") != F.col("a"))).select("bucket", "id", "w"))
        if first is None:
            # From here on only buckets that still hold someone unplaced matter, and only their documents' sets.
            first = lead
            open_ = rest.select("bucket").distinct()
            member = materialise(member.join(open_, "bucket", "left_semi"))
            sets = materialise(sets.join(member.select("id").distinct(), "id", "left_semi"))
        if rest.isEmpty():
            return comps
    heads = first.select("bucket", "a")
    rows = _label(member, comps).join(heads, "bucket").where(F.col("id") != F.col("a"))
    state = rows.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("bucket", "n")
    rows = materialise(rows.join(state, "bucket").select("bucket", "id", "comp", "a", "n"))
    if rows.isEmpty():
        return comps
    few = rows.where(F.col("n") <= small).select("bucket", "id", "comp")
    pairs = few.join(few.select("bucket", F.col("id").alias("b"), F.col("comp").alias("bcomp")), "bucket").where((F.col("id") < F.col("b")) & (F.col("comp") != F.col("bcomp"))).select(F.col("id").alias("a"), "b")
    many = rows.where(F.col("n") > small).select("a", F.col("id").alias("b"), "comp").distinct()
    hubs_in = comps.select(F.col("id").alias("a"), F.col("comp").alias("acomp"))
    apart = many.join(hubs_in, "a", "left").select("a", "b", "comp", (F.col("comp") != F.coalesce("acomp", "a")).alias("out"))
    pairs = pairs.unionByName(sharing(materialise(_beyond(apart, sets, similarity)), similarity))
    found = materialise(verify(_ordered(pairs).distinct(), sets, similarity))
    return comps if found.isEmpty() else connect(comps, found)


def sharing(tokens: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b), one of them out of their hub's reach and of another component, that can have J_P of `similarity`.

    A row of tokens is a document of a hub, with the shingles that the hub lacks (kind 0) or has (kind 1) and `base`, the weight that it may share besides these.
    Shingles of a kind are put in order from the rarest to the most frequent among the hub's documents. If a shingle is the rarest that two
    documents share, each shares at most `base` and the weight from this shingle on. Without repeats that is a number of shingles o, and J_P, then
    the Jaccard similarity, reaches t only if o >= t / (1 + t) (size + size'): the sizes of partners that the shingle can serve are bounded.
    With repeats J_P is at most the shared part of either document's weight. So a pair is met only at a shingle that could be its
    rarest, and frequent shingles meet nobody but those that share little else."""
    t, key = float(similarity), ["a", "kind", "s"]
    rows = tokens.select("a", "kind", "id", "comp", "out", "base", "size", "weight", "plain", F.explode("more").alias("m")).select("*", "m.s", F.col("m.w").alias("mw")).drop("m")
    often = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("f"), F.max("out").alias("any")).where((F.col("f") > 1) & F.col("any")).select(*key, "f")
    own = Window.partitionBy("a", "kind", "id").orderBy(F.desc("f"), "s").rowsBetween(Window.unboundedPreceding, 0)
    most = rows.join(often, key).withColumn("most", F.col("base") + F.sum("mw").over(own)).where(F.col("most") >= (t - 1e-9) * F.col("weight"))
    met = materialise(most.select(*key, "id", "comp", "out", "size", "plain", (F.col("most") * ((1 + t) / t) - F.col("size") + 1e-6).alias("reach")))
    other = met.select(*key, *[F.col(c).alias(f"o_{c}") for c in ("id", "comp", "size", "plain", "reach")])
    serves = ~(F.col("plain") & F.col("o_plain")) | ((F.col("reach") >= F.col("o_size")) & (F.col("o_reach") >= F.col("size")))
    return met.where("out").join(other, key).where((F.col("id") != F.col("o_id")) & (F.col("comp") != F.col("o_comp")) & serves).select(F.col("id").alias("a"), F.col("o_id").alias("b"))


def _beyond(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """For pairs (a hub, b, comp, out) what `sharing` takes.

    Kind 1, for pairs that share nothing beyond the hub: both have `similarity` of their weight in the hub; and where no shingle
    repeats, the partner of one out of reach has fewer than the hub, for else that one would reach the hub as well."""
    kind = pa.list_(pa.struct([("s", pa.int64()), ("w", pa.float64())]))
    names = ["a", "kind", "id", "comp", "out", "base", "size", "weight", "plain", "more"]

    def run(batches):
        for batch in batches:
            cols: dict[str, list] = {n: [] for n in names}
            more_s, more_w, ends = [], [], [0]
            for i in range(batch.num_rows):
                h, times = np.unique(np.frombuffer(batch.column(2)[i].as_buffer(), _U), return_counts=True)
                d, count = np.unique(np.frombuffer(batch.column(3)[i].as_buffer(), _U), return_counts=True)
                w, has = weight(count), np.isin(d, h, assume_unique=True)
                top, hub_top = int(count.max(initial=1)), int(times.max(initial=1))
                whole, inside = float(w.sum()), float(w[has].sum())
                kinds = [(0, ~has, inside)]
                if inside >= (similarity - 1e-9) * whole and (top > 1 or hub_top > 1 or len(d) < len(h) or batch.column(5)[i].as_py()):
                    kinds.append((1, has, 0.0))
                for k, which, base in kinds:
                    more_s.append(d[which])
                    more_w.append(w[which])
                    ends.append(ends[-1] + int(which.sum()))
                    for n, v in zip(names, (batch.column(0)[i].as_py(), k, batch.column(1)[i].as_py(), batch.column(4)[i].as_py(), batch.column(5)[i].as_py(), base, len(d), whole, top == 1), strict=False):
                        cols[n].append(v)
            flat = pa.StructArray.from_arrays([pa.array((np.concatenate(more_s) if more_s else np.zeros(0, _U)).view(np.int64)), pa.array(np.concatenate(more_w) if more_w else np.zeros(0))], ["s", "w"])
            kinds_of = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.int64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*(pa.array(cols[n], k) for n, k in zip(names, kinds_of, strict=False)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat).cast(kind)], names)

    return _with_sets(pairs, sets).mapInArrow(run, "a long, kind int, id long, comp long, out boolean, base double, size long, weight double, plain boolean, more array<struct<s:bigint,w:double>>")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id (smallest id of its class), class_size, kept (it is that id).

    Documents are linked when the probability Jaccard similarity of their shingles, of weight 1 + ln(count), is at least
    `similarity`; classes are what links connect. Documents with the same words are one class without comparison. A
    document of fewer than `width` words is one shingle; one without words (null, empty, white space) is alone. A null
    id is its own class. Rows that share an id are one document to the classes. No rows give no rows.
    """
    signed = materialise(sign(docs, id_col, text_col, width, bands, rows))
    some = signed.where((F.col("n_words") > 0) & F.col("id").isNotNull())
    # One document for each word sequence; min() folds copies map-side.
    reps = materialise(some.groupBy("d1", "d2", "n_words").agg(F.min(F.struct("id", "bands")).alias("m")).select("d1", "d2", "n_words", F.col("m.id").alias("id"), F.col("m.bands").alias("bands")))
    member = reps.select("id", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("bucket")
    member = materialise(member.join(shared, "bucket").select("bucket", "id"))
    wanted = member.select("id").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    sets = materialise(shingle_sets(texts.join(wanted, "id", "left_semi"), width))
    comps = link_buckets(member, sets, similarity)
    # Classes of word sequences, then of documents; the smallest id of a class is that of one of its sequences.
    seq = reps.join(comps, "id", "left").select("d1", "d2", "n_words", F.coalesce("comp", "id").alias("class_id"))
    own = signed.select("id", "d1", "d2", "n_words")
    placed = own.where((F.col("n_words") > 0) & F.col("id").isNotNull()).join(seq, ["d1", "d2", "n_words"]).select("id", "class_id")
    placed = materialise(placed.unionByName(own.where((F.col("n_words") == 0) | F.col("id").isNull()).select("id", F.col("id").alias("class_id"))))
    size = placed.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size")).select(F.col("class_id").alias("c"), "class_size")
    null = F.col("id").isNull()
    return placed.join(size, F.col("class_id") == F.col("c"), "left").select(F.col("id").alias(id_col), "class_id", F.when(null, 1).otherwise(F.col("class_size")).cast("long").alias("class_size"), (null | (F.col("id") == F.col("class_id"))).alias("kept"))


def keep_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents whose id is their class's smallest, all columns as they came; those without an id stay."""
    gone = free_name(docs, "near_id")
    out = classes(docs, id_col, text_col, **how).where(~F.col("kept")).select(F.col(id_col).alias(gone)).distinct()
    return docs.join(out, F.col(id_col) == F.col(gone), "left_anti")
