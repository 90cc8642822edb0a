"""What the operators do at the edges: damage, clashing names, copies of rows, very long texts, and the pipeline stage by stage."""

import collections
import gzip
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import _common, exact_dedup, hilbert_ann, langid, minhash, mixing, packing, pii, substring_dedup, toxicity, warc_fixity
from quillon.llm import _words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(n, seed, stem="w"):
    rng = np.random.default_rng(seed)
    return " ".join(f"{stem}{i}" for i in rng.integers(0, 300, n))


def test_word_hashes_tell_long_alike_words_apart():
    """Two words of 2048 bytes on which every polynomial modulo 2**64 agrees."""
    one = bytes(97 + bin(i).count("1") % 2 for i in range(2048))
    two = bytes(98 - bin(i).count("1") % 2 for i in range(2048))
    data = np.frombuffer(one + b" " + two + b" " + one, np.uint8)
    h = W.hash_words(data, *W.words(data, np.array([0, len(data)]))[:2])
    assert h[0] == h[2] != h[1]
    words = [b"", b"a", b"a\0", b"ab", b"abcdefgh", b"abcdefghi", b"bcdefgha", b"abcdefgh\0"]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    assert len(set(W.hash_words(data, (ends - [len(w) for w in words])[1:], ends[1:]).tolist())) == len(words) - 1


# Exact duplicates


def test_batches_against_a_saved_snapshot(spark, tmp_path):
    old = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], "doc_id long, text string")
    exact_dedup.build_snapshot(old, str(tmp_path / "s"), keys_per_filter=1)
    snap = exact_dedup.open_snapshot(old, str(tmp_path / "s"))
    new = spark.createDataFrame([(10, "a  b"), (11, "d"), (12, "d "), (None, "d")], "doc_id long, text string")
    got = {(r["doc_id"], r["new"]): r for r in exact_dedup.annotate(new, snap).collect()}
    assert got[10, True]["known"] and got[10, True]["keep_id"] == 10 and got[1, False]["group_size"] == 3
    assert not got[11, True]["known"] and got[11, True]["keep_id"] == 12 and got[11, True]["group_size"] == 3
    assert [r["doc_id"] for r in exact_dedup.keep_documents(new, snap).collect()] == [12]


def test_a_filter_that_denies_all_keeps_groups_apart(spark, monkeypatch):
    """The filter decides: where it says no, batch and snapshot stay groups of their own."""
    monkeypatch.setattr(exact_dedup, "screen", lambda batch, filters, n: batch.select("sha").limit(0))
    old, new = (spark.createDataFrame([(i, "same")], "doc_id long, text string") for i in (1, 2))
    assert {r["group_size"] for r in exact_dedup.annotate(new, old).collect()} == {1}


# Near duplicates


def test_hot_bucket_of_truncated_and_repeating_copies_equals_all_pairs(spark):
    """One bucket: copies cut at many places, copies with shared edits, texts that repeat, so both ways of sharing with the hub count."""
    rng, base = np.random.default_rng(11), np.arange(1, 301, dtype=np.uint64)
    sets = {0: base}
    for i in range(1, 70):
        if i % 3 == 0:
            s = base[: int(rng.integers(120, 300))]
        elif i % 3 == 1:
            s = np.concatenate([rng.permutation(base)[: int(rng.integers(200, 300))], 1000 + 10 * rng.integers(0, 4, 1).astype(np.uint64)[0] + np.arange(40, dtype=np.uint64)])
        else:
            s = np.repeat(base[:200], rng.integers(1, 4, 200))
        sets[i] = np.sort(s)
    want = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and want[a] != want[b] and minhash.probability_jaccard(sets[a], sets[b]) >= 0.8:
                lo, hi = sorted((want[a], want[b]))
                want = {i: lo if c == hi else c for i, c in want.items()}
    assert 1 < len(set(want.values())) < 60
    member = spark.createDataFrame([(1, i) for i in sets], "bucket long, id long")
    blobs = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "id long, set binary")
    for hubs in (1, 3):
        got = {r["id"]: r["comp"] for r in minhash.link_buckets(member, blobs, 0.8, small=4, hubs=hubs).collect()}
        assert {i: got.get(i, i) for i in sets} == want


# Languages


def brute_language(model, text):
    """The nearest centroid by plain loops."""
    b = [x if 97 <= x < 123 or x >= 128 else 0 for x in text.lower().encode()]
    tf = np.zeros(langid.DIMS)
    for p, q, r in zip(b, b[1:], b[2:], strict=False):
        if q and (p or r):
            tf[(((p << 16 | q << 8 | r) * 2654435761) % 2**32) >> 20] += 1
    x = np.log1p(tf) * model["idf"]
    cos = model["centroids"] @ (x / max(np.sqrt((x * x).sum()), 1e-12))
    return model["langs"][model["of"][int(cos.argmax())]]


def test_langid_against_brute_force_and_edges(spark):
    langs = {"aa": "abcde", "bb": "vwxyz"}
    rng = np.random.default_rng(1)
    speak = lambda lang, n: " ".join("".join(rng.choice(list(langs[lang]), 5)) for _ in range(n))
    rows = [(i, speak(lang, 30), lang) for i in range(60) for lang in (["aa", "bb"][i % 2],)]
    df = spark.createDataFrame([*rows, (60, None, "aa"), (61, "", "bb"), (62, "123 !", None), (63, speak("aa", 20000), None), (None, speak("bb", 9), None), (0, rows[0][1], "aa")], "doc_id long, text string, lang string")
    df = df.withColumn("share", F.lit("x")).withColumn("n", F.lit(1)).withColumn("has", F.lit("y")).withColumn("id", F.lit(7))
    model = langid.fit(df, F.coalesce(F.col("doc_id") % 3 != 1, F.lit(False)))
    got = langid.predict(df, model).collect()
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    assert len(got) == 66
    for r in got:
        t = texts[r["doc_id"]]
        assert r["lang_pred"] == ("und" if not t or not re.search("[a-z]", t) else brute_language(model, t)) and 0 <= r["score"] <= 1
    assert all(r["lang_pred"] == dict((i, la) for i, _, la in rows)[r["doc_id"]] for r in got if r["doc_id"] is not None and r["doc_id"] < 60)
    tie = langid.predict(spark.createDataFrame([(1, "qqq"), (2, "qqq")], "doc_id long, text string"), model).collect()
    assert tie[0]["lang_pred"] == tie[1]["lang_pred"]
    many = spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(50)], "doc_id long, text string, lang string")
    assert len(langid.fit(many, F.lit(True))["langs"]) == 50


# WARC files


def record(body, uri="u", said=None):
    return f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: {uri}\r\nContent-Length: {len(body) if said is None else said}\r\n\r\n{body}\r\n\r\n".encode()


def test_damaged_records_are_reported_and_reading_goes_on():
    a, b, c = record("one", "a"), record("two", "b"), record("three", "c")
    for bad in (record("two", "b", "abc"), record("two", "b", "99999"), record("two", "b", "1"), record("two", "b", "-3"), b.replace(b"WARC/1.0", b"XARC/1.0"), b.replace(b"Content-Length", b"Kontent-Length")):
        got = list(warc_fixity.parse_records(a + bad + c))
        assert [g[2] for g in got] == ["resource", "corrupt", "resource"] and [g[3] for g in got] == ["a", "", "c"]
        assert [g[0] for g in got] == [0, len(a), len(a) + len(bad)] and sum(g[1] for g in got) == len(a + bad + c)
    cut = list(warc_fixity.parse_records(a + c[:-6]))
    assert [g[2] for g in cut] == ["resource", "corrupt"] and not list(warc_fixity.parse_records(b""))


def test_two_replicas_of_bytes(spark):
    """Files read, hashed and compared: a flipped bit, a damaged header, a lost end, a broken gzip file; the other files cost their roots."""
    files = {f"f{i}.warc": b"".join(record(prose(40, 100 * i + j), f"{i}/{j}") for j in range(8)) for i in range(6)}
    theirs = dict(files)
    at = files["f1.warc"].find(b" w", 900) + 1
    theirs["f1.warc"] = files["f1.warc"][:at] + b"W" + files["f1.warc"][at + 1 :]
    theirs["f2.warc"] = files["f2.warc"].replace(b"Content-Length: ", b"Content-Length: x", 1)
    theirs["f3.warc"] = files["f3.warc"][:-50]
    theirs["f4.warc"] = gzip.compress(files["f4.warc"])
    theirs["f5.warc"] = gzip.compress(files["f5.warc"])[:200]
    table = lambda d: warc_fixity.read_warc(spark.createDataFrame([(f"x/{k}", bytearray(v)) for k, v in d.items()], "path string, content binary"))
    found = collections.defaultdict(collections.Counter)
    for r in warc_fixity.audit(table(files), table(theirs), range_bytes=512, fanout=2).collect():
        found[r["file"]][r["status"]] += 1
    assert found["f1.warc"] == {"corrupt": 1} and found["f2.warc"]["corrupt"] == 1 and found["f3.warc"]["corrupt"] == 1
    assert "f0.warc" not in found and "f4.warc" not in found and sum(found["f5.warc"].values()) >= 7


def test_archive_ignores_other_columns(spark):
    pages = spark.createDataFrame([(1, "u", "h", 1, 2), (1, "u", "h", 3, 4), (None, None, None, 5, 6)], "page_id long, url string, html string, offset int, text int")
    got = warc_fixity.lay_out(pages).collect()
    assert len(got) == 3 and sorted(r["copy"] for r in got) == [0, 0, 1]


# Nearest neighbours


def test_recall_where_windows_leave_most_rows_out(spark):
    """Clustered vectors: windows hold a small part of the rows, and nine tenths of the exact neighbours."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(120, 16)) * 4
    x = (centres[rng.integers(0, 120, 24000)] + rng.normal(size=(24000, 16)) * 0.4).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    hold = {}
    fitted = hilbert_ann._fit_reach

    def spy(*args):
        hold["reach"] = fitted(*args)
        return hold["reach"]

    hilbert_ann._fit_reach = spy
    try:
        rows = hilbert_ann.search(df, F.col("vec_id") % 100 == 0, k=20).collect()
    finally:
        hilbert_ann._fit_reach = fitted
    got = collections.defaultdict(set)
    for r in rows:
        got[r["query_id"]].add(r["vec_id"])
    d, hit = x.astype(np.float64), 0
    queries = list(range(0, 24000, 100))
    for q in queries:
        s = d @ d[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.lexsort((np.arange(len(s)), -s))[:20].tolist()))
    assert hit / (20 * len(queries)) >= 0.9
    print("reach", hold["reach"], "recall", hit / (20 * len(queries)))
    assert hold["reach"] < 24000 / 8


def test_ids_that_repeat_in_a_search(spark):
    v = [[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [0.5, 0.5]]
    df = spark.createDataFrame([(0, v[0]), (0, v[0]), (1, v[1]), (1, v[2]), (2, v[3]), (None, v[0])], "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("q", F.lit("x"))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in hilbert_ann.search(df, F.col("vec_id") == 0, k=5).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 0.5), (0, 2, 1, 0.0)]


# Repeated passages


def test_substrings_of_ids_that_lie_apart(spark):
    """Chunks are cut at quantiles: one id far away does not put the others in one chunk."""
    shared = prose(30, 1)
    rows = [(i if i < 99 else 10**15, prose(50, i + 10) + " " + (shared if i % 9 == 0 else "")) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit(1)).withColumn("at", F.lit(2))
    parts, _ = substring_dedup.chunked(df, "doc_id", "text", 1000)
    assert parts.groupBy("chunk").count().agg(F.max("count")).first()[0] < 20
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(df, 20, chunk_bytes=1000).collect()}
    assert got == {d: 30 if i % 9 == 0 and i else 0 for i, (d, _) in enumerate(rows)}


# Toxicity


@pytest.fixture(scope="module")
def abusive(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(600):
        kind = 2 if i % 30 == 2 else i % 6 if i % 6 != 2 else 3
        tail = {0: " you worthless scumbag", 1: " you worthles scumbagg", 2: ' he said "worthless scumbag" there', 3: "", 4: "", 5: ""}[kind]
        rows.append((i, prose(40, int(rng.integers(10**6))) + tail, int(kind < 2)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").withColumn("label", F.lit("x")).withColumn("lid", F.lit("y")).withColumn("toxic", F.lit(5))
    labels = spark.createDataFrame([(i, y, "z") for i, _, y in rows], "doc_id long, toxic int, text string")
    return rows, docs, toxicity.fit(docs, labels, F.col("doc_id") % 5 != 0)


def test_misspelled_only_and_quoted_only(spark, abusive):
    _, _, model = abusive
    probe = ["you wortless scumbag", "worthlesss scumbug worthlless scumbog", 'he said "worthless scumbag" once', '"' + "so " * 400 + 'worthless scumbag" was his word', prose(20, 5), '"a" worthless scumbag "b"']
    df = spark.createDataFrame([(i, prose(30, i) + " " + t) for i, t in enumerate(probe)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    assert [got[i]["predicted"] for i in range(6)] == [1, 1, 0, 0, 0, 1]
    assert got[1]["abuse"] == 0 and got[1]["misspelled"] > 0 and got[3]["abuse"] == 0 and got[3]["quoted"] > 0 and got[5]["quoted"] == 0
    assert all(model["coef"][1 + j] >= 0 for j in toxicity.ABUSE) and all(model["coef"][1 + j] <= 0 for j in toxicity.QUOTED)


def test_stage_and_score_agree(spark, abusive):
    rows, docs, model = abusive
    odd = spark.createDataFrame([(700, "İ ΑΣ WORTHLESS SCUMBAG"), (701, None), (702, ""), (703, "x" * 200_000 + " you worthless scumbag"), (None, "you worthless scumbag"), (0, rows[0][1])], "doc_id long, text string").withColumn("label", F.lit("x")).withColumn("lid", F.lit("y")).withColumn("toxic", F.lit(5))
    all_ = docs.unionByName(odd)
    marks = toxicity.score(all_, model).collect()
    kept = toxicity.keep_documents(all_, model)
    assert kept.columns == all_.columns and len(marks) == 606
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter(r["doc_id"] for r in marks if not r["predicted"])
    assert {r["doc_id"] for r in marks if r["doc_id"] is None or r["doc_id"] >= 700 if r["predicted"]} == {700, 703, None}


# Personal data


def test_many_hits_cost_no_square(spark):
    n = 30_000
    text = ", ".join(str(i % 90 + 10) for i in range(n)) + " me@x.org" + " +49 123 456 789;" * 3000
    df = spark.createDataFrame([(None, text), (None, text), (1, "é 10.0.0.1 and 10.0.0.2")], "doc_id long, text string").withColumn("kind", F.lit("x")).withColumn("s0", F.lit(1))
    got = pii.report(df).collect()
    assert [r["n_phone"] for r in got] == [3000, 3000, 0] and got[0]["spans"] == got[1]["spans"]
    assert [text[int(a) : int(z)] for k, a, z in (s.split(":") for s in got[0]["spans"].split(",")) if k == "phone"] == ["+49 123 456 789"] * 3000
    assert got[2]["spans"] == "ip:2:10,ip:15:23"


# The pipeline


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage's decisions against brute force, on the table that the stage before it left."""
    rows = []
    for i in range(240):
        t = prose(60, i, f"s{i % 7}x")
        if i % 10 == 3:
            t += " you worthless scumbag"
        if i % 10 == 5:
            t = re.sub(" ", "  ", prose(60, i - 5, f"s{(i - 5) % 7}x"))
        if i % 10 == 7:
            t = prose(60, i - 7, f"s{(i - 7) % 7}x") + " tail"
        rows.append((i, t, "en", [None, "a", "b", "c"][i % 4], len(t), "extra"))
    rows += [(900, None, None, "a", 0, None), (901, "", None, "b", 0, None), (3, rows[3][1], "en", "c", 1, "again")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 10 == 3)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = _common.materialise(stage(spark, docs, str(tmp_path)))
        seen[name] = docs.collect()
    columns = ["doc_id", "text", "lang", "source", "n_chars", "kept"]
    assert all(list(r.asDict()) == columns for name in ("toxicity", "exact_dedup", "near_dedup", "mixing") for r in seen[name][:1])
    clean = [r for r in rows if "scumbag" not in (r[1] or "")]
    assert sorted(r["doc_id"] for r in seen["toxicity"]) == sorted(r[0] for r in clean)
    groups = collections.defaultdict(list)
    for r in clean:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append((-len(r[1] or ""), r[0]))
    assert sorted(r["doc_id"] for r in seen["exact_dedup"]) == sorted(min(v)[1] for v in groups.values())
    left = {r["doc_id"]: r["text"] or "" for r in seen["exact_dedup"]}
    sh = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in left.items() for w in (WORD.findall(t),) if w}
    top = {i: i for i in left}
    for a in sorted(sh):
        for b in sorted(sh):
            if a < b and top[a] != top[b] and len(sh[a] & sh[b]) / len(sh[a] | sh[b]) >= 0.8:
                lo, hi = sorted((top[a], top[b]))
                top = {i: lo if c == hi else c for i, c in top.items()}
    assert sorted(r["doc_id"] for r in seen["near_dedup"]) == sorted(set(top.values()))
    want = collections.Counter({r["doc_id"]: r["copies"] for r in mixing.annotate(spark.createDataFrame(seen["near_dedup"], docs_schema())).collect() if r["copies"]})
    assert collections.Counter(r["doc_id"] for r in seen["mixing"]) == want
    sizes = collections.Counter()
    for r in seen["mixing"]:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    before = collections.Counter()
    for r in seen["near_dedup"]:
        before[r["source"]] += len(WORD.findall(r["text"] or ""))
    goal = dict(zip(["a", "b", "c", None], brute_targets([before[s] for s in ("a", "b", "c", None)]), strict=True))
    assert all(abs(sizes[s] - goal[s]) <= 0.05 * goal[s] + 130 for s in goal)
    pieces = seen["packing"]
    assert collections.Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == want
    assert {r["sequence_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} and max(r["offset"] + r["length"] for r in pieces) <= packing.CAPACITY
    assert _common.clean(spark) > 0


def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long, kept string"


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Shares by weight; what is above a source's most is dealt out again until nothing is."""
    w = [weights[i % 3] for i in range(len(sizes))]
    held, target = set(), [0.0] * len(sizes)
    while True:
        room = share * sum(sizes) - sum(most * sizes[i] for i in held)
        total = sum(w[i] for i in range(len(sizes)) if i not in held)
        target = [most * s if i in held else room * w[i] / total for i, s in enumerate(sizes)]
        over = {i for i, t in enumerate(target) if i not in held and t > most * sizes[i]}
        if not over or total == sum(w[i] for i in over):
            return [min(t, most * s) for t, s in zip(target, sizes, strict=True)]
        held |= over


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


