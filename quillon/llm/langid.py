"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of hashed letter trigrams (lower case, TF as ln(1 + count), length 1). Each language has several
centroids, clustered from a bounded sample of its labelled texts; the nearest by cosine names the language. A text whose
nearest centroid is further away than nearly all of that centroid's training texts is flagged as rejected."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._common import text_or_empty

#: Hashed trigram dimensions; centroids of a language; labelled texts that fit it, at most about this many of each language and of all.
DIMS, CENTROIDS, FIT_ROWS, FIT_TOTAL = 4096, 6, 600, 6000
BLOCK = 1_000_000
#: Share of a centroid's training texts that its radius leaves out.
OUTSIDE = 0.005


def _letters(c: str) -> Column:
    return F.lower(text_or_empty(c))


#: Bytes that carry language: ASCII letters and all of non-ASCII; every other byte is a gap.
_LETTER = np.zeros(256, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed trigram counts of each row, as float32; runs of gaps count as one gap only where they border a letter."""
    n = len(offsets) - 1
    b = _LETTER[data].astype(np.uint32)
    if len(b) < 3:
        return np.zeros((n, DIMS), np.float32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    use = (b[1:-1] > 0) & ((b[:-2] > 0) | (b[2:] > 0))
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))[:-2]
    # Trigrams across the end of a text belong to none.
    last = np.zeros(len(data) + 1, bool)
    last[offsets[1:]] = True
    use &= ~(last[1:-2] | last[2:-1])
    place = (code * np.uint32(2654435761)) >> np.uint32(32 - 12)
    return np.bincount(row[use] * DIMS + place[use], minlength=n * DIMS).reshape(n, DIMS).astype(np.float32)


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf) * idf
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.maximum(size, 1e-12)


def _rows(batch, block: int = BLOCK):
    """Row ranges whose texts and count tables stay small."""
    data, offsets = W.buffers(batch.column(1))
    for lo, hi in W.blocks(offsets, block):
        for a in range(lo, hi, 256):
            z = min(hi, a + 256)
            yield a, z, data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]


def fit(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """A model from rows for which `trains` holds and whose language is known: languages, idf, centroids, radii.

    About FIT_ROWS texts of each language, and FIT_TOTAL of all, are taken by a hash of the id; whole texts are counted on the executors, and only
    their tables of DIMS counts (8 KB each, so about 50 MB at most, whatever the texts and however many languages) come to the driver.
    Texts that are null or empty teach nothing; rows that repeat teach as often as they are there; other columns, whatever their names, play no part."""
    known = docs.where(trains & F.col(lang_col).isNotNull() & (F.length(text_or_empty(text_col)) > 0)).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), _letters(text_col).alias("text"))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    n_langs = sizes.count()
    if not n_langs:
        return {"langs": [], "idf": np.ones(DIMS, np.float32), "centroids": np.zeros((0, DIMS), np.float32), "of": np.zeros(0, int), "radius": np.zeros(0)}
    scale = 1 << 40
    each = F.lit(max(1.0, min(FIT_ROWS, FIT_TOTAL / n_langs)))
    share = sizes.select("lang", (F.lit(scale) * F.least(F.lit(1.0), each / F.col("n"))).cast("long").alias("share"))
    # A row for each language; so many that they would weigh something are joined without a hint.
    sample = known.join(F.broadcast(share) if n_langs <= 100_000 else share, "lang").where(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(11)), F.lit(scale)) < F.col("share"))

    def run(batches):
        for batch in batches:
            for a, z, data, off in _rows(batch):
                tf = counts(data, off)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.array([np.minimum(r, 65535).astype(np.uint16).tobytes() for r in tf], pa.binary())], ["lang", "tf"])

    got = sample.select("lang", "text").mapInArrow(run, "lang string, tf binary").toPandas()
    tf = np.stack([np.frombuffer(x, np.uint16) for x in got["tf"]]).astype(np.float32) if len(got) else np.zeros((0, DIMS), np.float32)
    lang = got["lang"].to_numpy()
    idf = (np.log((1 + len(tf)) / (1 + (tf > 0).sum(0))) + 1).astype(np.float32)
    x = vectors(tf, idf)
    langs, centroids, of, radius = sorted(set(lang)), [], [], []
    for i, name in enumerate(langs):
        own = x[lang == name]
        centre = _clusters(own, min(CENTROIDS, len(own)))
        near = (own @ centre.T).argmax(1)
        for j in range(len(centre)):
            mine = own[near == j] @ centre[j]
            if len(mine):
                centroids.append(centre[j])
                of.append(i)
                radius.append(1 - np.quantile(mine, OUTSIDE))
    return {"langs": langs, "idf": idf, "centroids": np.array(centroids, np.float32), "of": np.array(of), "radius": np.array(radius)}


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from rows that lie far apart."""
    order = np.lexsort(x[:, :8].T)
    x = x[order]
    pick = [int((x @ x.mean(0)).argmax())]
    while len(pick) < k:
        pick.append(int((x @ x[pick].T).max(1).argmin()))
    centre = x[pick]
    for _ in range(20):
        near = (x @ centre.T).argmax(1)
        centre = np.stack([x[near == j].mean(0) if (near == j).any() else centre[j] for j in range(k)])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    return centre


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row, from its whole text alone.

    score is the share of the best language among the languages' best cosines, sharpened (0 to 1). `und`, score 0: a null or
    empty text, one without letters, or a model without languages. rejected: the text lies outside its centroid's radius.
    Rows that repeat give repeated rows; no rows give none."""
    langs, of = model["langs"], model["of"]

    def run(batches):
        for batch in batches:
            name = np.full(batch.num_rows, None, object)
            score, out = np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            for a, z, data, off in _rows(batch):
                if langs:
                    cos = vectors(counts(data, off), model["idf"]) @ model["centroids"].T
                    best = np.stack([cos[:, of == i].max(1) for i in range(len(langs))], 1)
                    win = best.argmax(1)
                    power = np.exp(20 * (best - best.max(1, keepdims=True)))
                    name[a:z] = np.array(langs, object)[win]
                    score[a:z] = 1 / power.sum(1)
                    near = cos.argmax(1)
                    out[a:z] = 1 - cos.max(1) > model["radius"][near]
            has = np.array(batch.column(2).to_numpy(zero_copy_only=False), bool)
            name[~has] = "und"
            name[[x is None for x in name]] = "und"
            score[name == "und"] = 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name, pa.string()), pa.array(score), pa.array(out)], ["doc_id", "lang_pred", "score", "rejected"])

    kind = dict(docs.dtypes)[id_col]
    has = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col(id_col), _letters(text_col).alias("text"), has.alias("has")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


