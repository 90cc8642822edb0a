"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows around what they find.

The lexicon is learned from labelled texts: words that toxic texts have far oftener than others. Its trie is walked together with the
Levenshtein automata of all its terms at once; the states met are remembered, so a word costs about one step a letter, and most words leave
the automaton after two or three. Hits are weighed by their window: inside quotation marks or next to a word of reporting they count as
quoted. A logistic function of abuse, misspelled abuse, quoted hits and density, fitted on the same sample, gives the score."""

from __future__ import annotations

import bisect
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._common import text_or_empty

#: Labelled texts of each class that the fit takes at most (about), and terms of the lexicon.
FIT_ROWS, TERMS = 4000, 3000
#: Least number of toxic sample texts with a term; how far its rate there must exceed that of other texts, in logs, after allowing for chance.
SUPPORT, MARGIN, CERTAIN = 3, 1.5, 1.64
#: Words to either side that make up a hit's context.
WINDOW = 6
REPORTING = frozenset(b"said says saying quote quoted quotes called wrote writes word words term terms phrase reported allegedly example means".split())
#: ASCII other than letters, digits and quotes separates words; texts are lowered by Arrow.
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
KNOWN = 400_000


class Automaton:
    """All words within an edit distance of some term: none for terms of under 5 letters and those in `strict`, one up to 9, two beyond."""

    def __init__(self, terms: list[str], strict: frozenset[str] = frozenset()):
        self.strict = strict
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.reach: list[int] = [0]
        for t in terms:
            node, room = 0, self.room(t)
            self.reach[0] = max(self.reach[0], room)
            for c in t:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.reach.append(0)
                    self.children[node][c] = nxt
                node = nxt
                self.reach[node] = max(self.reach[node], room)
            self.term[node] = t
        self.start = self._close({0: 0})
        self.steps: dict[tuple, tuple] = {}

    def room(self, term: str) -> int:
        return 0 if term in self.strict else allowed(term)

    def _close(self, state: dict[int, int]) -> tuple:
        """Adds what is reached by leaving out letters of a term."""
        stack = list(state.items())
        while stack:
            node, e = stack.pop()
            for child in self.children[node].values():
                if e + 1 <= self.reach[child] and e + 1 < state.get(child, 99):
                    state[child] = e + 1
                    stack.append((child, e + 1))
        return tuple(sorted(state.items()))

    def _step(self, state: tuple, c: str) -> tuple:
        new: dict[int, int] = {}

        def add(node: int, e: int) -> None:
            if e <= self.reach[node] and e < new.get(node, 99):
                new[node] = e

        for node, e in state:
            for letter, child in self.children[node].items():
                add(child, e + (letter != c))
            add(node, e + 1)
        return self._close(new) if new else ()

    def nearest(self, word: str) -> tuple[str, int] | None:
        """The term nearest to the word, within its distance; ties to the first in order."""
        state, steps = self.start, self.steps
        for c in word:
            key = (state, c)
            nxt = steps.get(key)
            if nxt is None:
                nxt = self._step(state, c)
                if len(steps) > 200_000:
                    steps.clear()
                steps[key] = nxt
            if not nxt:
                return None
            state = nxt
        ends = [(e, self.term[n]) for n, e in state if self.term[n] is not None and e <= self.room(self.term[n])]
        return (min(ends)[1], min(ends)[0]) if ends else None


def allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


def split(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


_MARK = re.compile(rb'["\n]|\xe2\x80[\x9c\x9d\x9e]|\xc2[\xab\xbb]')
#: Opening marks and those that close them; a straight mark closes itself.
_CLOSED_BY = {b'"': b'"', b"\xe2\x80\x9c": b"\xe2\x80\x9d", b"\xe2\x80\x9e": b"\xe2\x80\x9c\xe2\x80\x9d", b"\xc2\xab": b"\xc2\xbb"}


def _spans(raw: bytes) -> list[tuple[int, int]]:
    """Passages between quotation marks on one line, of any length, from one pass over the marks: a mark with no partner on its line opens nothing."""
    out, opened = [], None
    for m in _MARK.finditer(raw):
        mark = m.group()
        if mark == b"\n":
            opened = None
        elif opened is None:
            opened = (mark, m.start()) if mark in _CLOSED_BY else None
        elif mark in _CLOSED_BY[opened[0]]:
            out.append((opened[1], m.end()))
            opened = None
    return out


class Finder:
    """Features of a text from the lexicon: exact abuse, misspelled abuse, quoted hits (sums of weights), hits by length, different words hit (up to 4)."""

    def __init__(self, lexicon: dict[str, float], strict: frozenset[str] = frozenset()):
        self.weights = lexicon
        self.automaton = Automaton(sorted(lexicon), strict)
        self.hits: dict[bytes, tuple[float, int]] = {}
        self.clean: set[bytes] = set()

    def _learn(self, words: set[bytes]) -> None:
        if len(self.clean) > KNOWN:
            self.clean.clear()
        for w in words:
            got = self.automaton.nearest(w.decode("utf-8", "replace")) if len(w) > 2 else None
            if got:
                # The more of a term is misspelled, the less the word counts.
                self.hits[w] = (self.weights[got[0]] * (1 - got[1] / len(got[0])), got[1])
            elif len(w) <= 64:
                self.clean.add(w)

    def misspelled(self, raw: bytes) -> set[str]:
        """Terms that the text has misspelled."""
        near = (self.automaton.nearest(w.decode("utf-8", "replace")) for w in set(split(raw)) if len(w) > 2)
        return {got[0] for got in near if got and got[1]}

    def features(self, raw: bytes) -> tuple[float, float, float, float, float]:
        words = split(raw)
        kinds = set(words)
        new = kinds - self.clean
        new = {w for w in new if w not in self.hits}
        if new:
            self._learn(new)
        found = kinds & self.hits.keys()
        if not found:
            return 0.0, 0.0, 0.0, 0.0, 0.0
        quoted = _spans(raw)
        opens = [a for a, _ in quoted]
        exact = fuzzy = said = 0.0
        different = set()
        if quoted:
            at = [(m.start(), m.group()) for m in re.finditer(rb"[a-z0-9\x80-\xff]+", raw)]
        else:
            at = [(0, w) for w in words]
        for i, (place, w) in enumerate(at):
            if w not in found:
                continue
            weight, edits = self.hits[w]
            around = [x for _, x in at[max(0, i - WINDOW) : i + WINDOW + 1]]
            k = bisect.bisect_right(opens, place) - 1
            if (k >= 0 and place < quoted[k][1]) or not REPORTING.isdisjoint(around):
                said += weight
                continue
            different.add(w)
            if edits:
                fuzzy += weight
            else:
                exact += weight
        return exact, fuzzy, said, (exact + fuzzy) / (len(words) + 20), min(len(different), 4)


def _shape(f: np.ndarray) -> np.ndarray:
    return np.column_stack([np.log1p(f[:, 0]), np.log1p(f[:, 1]), np.log1p(f[:, 2]), np.log1p(100 * f[:, 3]), f[:, 4] > 1, f[:, 4] > 2])


def _lower(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts in lower case: the one way that fit, score and filter lower them."""
    return W.buffers(pa.compute.utf8_lower(text.fill_null("")))


def _run_features(text: pa.Array, finder: Finder) -> np.ndarray:
    data, offsets = _lower(text)
    raw = data.tobytes()
    return np.array([finder.features(raw[offsets[i] : offsets[i + 1]]) for i in range(len(offsets) - 1)], float).reshape(-1, 5)


def sample(docs: DataFrame, labels: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """text and label of about FIT_ROWS labelled texts of each class, taken by a hash of the id among rows for which `trains` holds."""
    own = labels.where(trains & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("lid")).agg(F.max(label_col).alias("label"))
    texts = docs.select(F.col(id_col).alias("did"), text_or_empty(text_col).alias("text"))
    sizes = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    scale = 1 << 20
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(int(scale * min(1.0, FIT_ROWS / n))))])
    own = own.where(F.pmod(F.xxhash64(F.col("lid").cast("string"), F.lit(5)), F.lit(scale)) < share[F.col("label")])
    own = own.hint("broadcast")  # about 2 * FIT_ROWS rows by construction
    return texts.join(own, F.col("did") == F.col("lid")).select("text", (F.col("label") > 0).cast("int").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """A model: lexicon (term, weight) and the coefficients of the score. Without both classes among the labels the lexicon is empty and every score is 0.

    Words of the bounded sample are counted by class on the executors; the strongest TERMS words, the terms met misspelled and
    five numbers for each sample text come to the driver. Labels that are null, or of documents that are not there, teach nothing; of labels that repeat an id the
    highest counts; a null id has no label; other columns, whatever their names, play no part."""
    empty = {"lexicon": {}, "strict": frozenset(), "coef": np.array([-30.0, 0, 0, 0, 0, 0, 0])}
    rows = sample(docs, labels, trains, id_col, text_col, label_col)
    if rows is None:
        return empty
    rows = rows.repartition(8).persist()
    try:
        totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        n1, n0 = totals.get(1, 0), totals.get(0, 0)
        if not n1 or not n0:
            return empty

        def once(batches):
            for batch in batches:
                data, offsets = _lower(batch.column(0))
                raw, label = data.tobytes(), batch.column(1).to_numpy()
                sums: dict[bytes, list[int]] = {}
                for i in range(batch.num_rows):
                    text = raw[offsets[i] : offsets[i + 1]]
                    place = label[i] * (1 + zlib.crc32(text) % 2)  # toxic texts are counted by halves
                    for w in set(split(text)):
                        if len(w) > 2 and not w.isdigit():
                            sums.setdefault(w, [0, 0, 0])[place] += 1
                yield pa.RecordBatch.from_pydict({"word": pa.array([w.decode("utf-8", "replace") for w in sums], pa.string()), **{f"c{k}": pa.array([v[j] for v in sums.values()], pa.int64()) for j, k in enumerate("0ab")}})

        def learn(part: DataFrame, m1: int, m0: int) -> dict[str, float]:
            seen = part.select("text", "label").mapInArrow(once, "word string, c0 long, ca long, cb long").groupBy("word").agg(F.sum("c0").alias("c0"), F.sum(F.col("ca") + F.col("cb")).alias("c1"), F.least(F.sum("ca"), F.sum("cb")).alias("half"))
            least = max(2, min(SUPPORT + m1 // 400, 12))
            ratio = F.log(((F.col("c1") + 0.5) / (m1 + 1.0)) / ((F.col("c0") + 0.5) / (m0 + 1.0)))
            spread = F.sqrt(1.0 / (F.col("c1") + 0.5) + 1.0 / (F.col("c0") + 0.5))
            # A term that only one half of the toxic texts has is likely chance.
            strong = seen.where((F.col("c1") >= least) & (F.col("half") >= (least // 4 if least > 2 else 0))).withColumn("ratio", ratio).where(F.col("ratio") - CERTAIN * spread > (MARGIN if least > 2 else 0.0))
            return {r["word"]: float(r["ratio"]) for r in strong.orderBy(F.desc(F.col("ratio") * F.col("c1")), "word").limit(TERMS).collect()}

        # The score is fitted on texts that a first lexicon has not seen, so that words it owes to chance get no credit; then all teach the lexicon.
        apart = F.pmod(F.xxhash64("text", F.lit(3)), F.lit(3)) == 0
        lexicon = learn(rows.where(~apart), max(1, 2 * n1 // 3), max(1, 2 * n0 // 3))
        strict = _strict(rows, lexicon, n1, n0)

        def features(batches):
            finder = Finder(lexicon, strict)
            for batch in batches:
                f = _run_features(batch.column(0), finder)
                yield pa.RecordBatch.from_pydict({"label": batch.column(1), **{f"f{i}": pa.array(f[:, i]) for i in range(5)}})

        got: pd.DataFrame = rows.where(apart).select("text", "label").mapInArrow(features, "label int, f0 double, f1 double, f2 double, f3 double, f4 double").toPandas()
        if len(set(got["label"])) == 2:
            lexicon = learn(rows, n1, n0)
            strict = _strict(rows, lexicon, n1, n0)
    finally:
        rows.unpersist()
    got = got.sort_values(list(got.columns))
    n1, n0 = int((got["label"] == 1).sum()), int((got["label"] == 0).sum())
    if not n1 or not n0:
        return empty | {"lexicon": lexicon, "strict": strict}
    return {"lexicon": lexicon, "strict": strict, "coef": _logistic(_shape(got[["f0", "f1", "f2", "f3", "f4"]].to_numpy()), got["label"].to_numpy())}


def _strict(rows: DataFrame, lexicon: dict[str, float], n1: int, n0: int) -> frozenset[str]:
    """Terms whose misspellings in the sample are not clearly oftener in toxic texts: these are found only as they are. At most TERMS rows come to the driver."""

    def run(batches):
        finder = Finder(lexicon)
        for batch in batches:
            data, offsets = _lower(batch.column(0))
            raw = data.tobytes()
            hits = [(t, y) for i, y in enumerate(batch.column(1).to_pylist()) for t in finder.misspelled(raw[offsets[i] : offsets[i + 1]])]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in hits], pa.string()), pa.array([y for _, y in hits], pa.int32())], ["term", "label"])

    found = rows.select("text", "label").mapInArrow(run, "term string, label int").groupBy("term").agg(F.sum("label").alias("m1"), F.sum(1 - F.col("label")).alias("m0"))
    # Nearly all misspellings met must be abuse; a term without any keeps its reach.
    return frozenset(r["term"] for r in found.where(F.col("m0") / F.lit(max(n0, 1)) * 10 >= F.col("m1") / F.lit(max(n1, 1))).collect())


#: Features (places in `_shape`) that can only speak for label 1, and those that can only speak against it.
ABUSE, QUOTED = (0, 1, 3, 4, 5), (2,)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, with a small penalty. Coefficients of the wrong sign are taken out, the worst first, until none is left."""
    free = list(range(x.shape[1]))
    while True:
        got = _newton(x[:, free], y)
        coef = np.zeros(x.shape[1] + 1)
        coef[0], coef[1 + np.array(free, int)] = got[0], got[1:]
        wrong = {j: -coef[1 + j] for j in ABUSE if coef[1 + j] < 0} | {j: coef[1 + j] for j in QUOTED if coef[1 + j] > 0}
        if not wrong:
            return coef
        free.remove(max(wrong, key=wrong.get))


def _newton(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    coef = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [0.3] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ coef)
        coef += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return coef


def score(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns `keep` and score, predicted, abuse, misspelled, quoted for every row, from its whole text alone.

    Null and empty texts score as a text without hits. Rows that repeat give repeated rows; no rows give none."""
    coef = model["coef"]

    def run(batches):
        finder = Finder(model["lexicon"], model["strict"])
        for batch in batches:
            n = batch.num_columns - 1
            f = _run_features(batch.column(n), finder)
            p = 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(f)), _shape(f)]) @ coef, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(f[:, 2])], [*names, "score", "predicted", "abuse", "misspelled", "quoted"])

    # Columns travel under names of their own, so that extra ones of any name do no harm.
    names = [f"k{i}" for i in range(len(keep))]
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], text_or_empty(text_col).alias("text"))
    out = own.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)) + ", score double, predicted int, abuse double, misspelled double, quoted double")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "score", "predicted", "abuse", "misspelled", "quoted")


def keep_documents(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs without those predicted toxic, all columns as they came, whatever their names.

    A text is scored beside its row, so nothing is joined. Null and empty texts score as a text without hits; rows that repeat are judged alike; no rows give none."""
    coef, lexicon, strict = model["coef"], model["lexicon"], model["strict"]
    at = docs.columns.index(text_col)

    def run(batches):
        finder = Finder(lexicon, strict)
        for batch in batches:
            raw = batch.column(at)
            f = _run_features(raw, finder)
            stay = np.column_stack([np.ones(len(f)), _shape(f)]) @ coef < 0
            yield batch.filter(pa.array(stay))

    return docs.mapInArrow(run, docs.schema)
