"""The corpus operators against brute force, and on nulls, empties, ties, repeated rows, empty tables and extra columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import exact_dedup, hilbert_ann, langid, minhash, mixing, packing, pii, substring_dedup, toxicity, warc_fixity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = np.random.default_rng(3)
VOCAB = [f"w{i}" for i in range(400)]


def text(n, rng=RNG):
    return " ".join(rng.choice(VOCAB, n))


BASE = [text(120) for _ in range(12)]
TEXTS = [*BASE, BASE[0], BASE[0] + " ", " ".join(BASE[1].split()[:60] + ["changed"] + BASE[1].split()[61:]), BASE[2] + " " + BASE[3], None, "", " \t\n", "one two", "one  two", "日本 語", text(3000)]
ROWS = [(i, t, "en", f"s{i % 3}" if i % 7 else None, 0) for i, t in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string, lang string, source string, size int"


@pytest.fixture(scope="module")
def docs(spark):
    """`size` clashes with a name that operators use inside."""
    return spark.createDataFrame([*ROWS, (None, "no id", None, None, 1), (3, BASE[3], "en", "s0", 2)], SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_fuse_filter_has_no_false_negatives():
    for n in (0, 1, 2, 3, 50, 5000):
        keys = RNG.integers(0, 2**63, n, dtype=np.int64).view(np.uint64)
        f = exact_dedup.build_filter(keys)
        assert exact_dedup.ask_filter(keys, *f).all()
        others = RNG.integers(0, 2**63, 20000, dtype=np.int64).view(np.uint64)
        assert exact_dedup.ask_filter(others, *f).mean() < 0.02


def test_exact_dedup(spark, docs, none):
    rows = docs.select("doc_id", "text").collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append((-len(r["text"] or ""), math.inf if r["doc_id"] is None else r["doc_id"]))
    got = exact_dedup.annotate(*exact_dedup.halves(docs), keys_per_filter=4).collect()
    assert len(got) == len(rows)
    by = {hashlib.sha256(k.encode()).hexdigest(): (min(v)[1], len(v)) for k, v in groups.items()}
    for r in got:
        assert (math.inf if r["keep_id"] is None else r["keep_id"], r["group_size"]) == by[r["text_sha256"]]
    assert sum(r["kept"] for r in got) == len(groups)
    kept = exact_dedup.keep_documents(docs)
    assert kept.count() == len(groups) and kept.columns == docs.columns
    assert exact_dedup.annotate(none, none).count() == 0 and exact_dedup.annotate(docs, none).count() == len(rows)


def test_exact_dedup_against_a_snapshot(spark, docs):
    new = spark.createDataFrame([(100, BASE[0] + "\n", "en", "x", 0), (101, "fresh", "en", "x", 0), (102, "fresh", "en", "x", 0)], SCHEMA)
    assert [r["doc_id"] for r in exact_dedup.keep_documents(new, docs).collect()] == [101]


def shingle_set(t, k=5):
    w = WORD.findall(t or "")
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_minhash_classes(docs, none):
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(docs).collect()}
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in docs.collect() if r["doc_id"] is not None}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                assert (got[a] == got[b]) == (j >= 0.8), (a, b, j)
    assert got[16] == 16 and got[17] == 17 and got[None] is None
    assert minhash.classes(none).count() == 0
    assert minhash.keep_documents(docs).columns == docs.columns


def test_minhash_large_bucket_loses_no_link(spark):
    """Near copies of one text: classes are those of all pairs."""
    base, rng = [f"b{i}" for i in range(150)], np.random.default_rng(5)
    texts = []
    for _ in range(60):
        w = list(base)
        for at in rng.choice(150, rng.integers(0, 6), replace=False):
            w[at] = f"x{rng.integers(0, 3)}{at}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(df).collect()}
    sets = [shingle_set(t) for t in texts]
    up = list(range(60))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(60):
        for b in range(a):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                i, j = sorted((top(a), top(b)))
                up[j] = i
    assert got == {i: top(i) for i in range(60)}


def test_link_buckets_loses_no_link_of_repeated_shingles(spark):
    """One bucket of over 17 texts: what connects is what links of all pairs connect. Documents 1 and 2 are the later hubs, so no hub is 30, 31 or above."""
    own, times = iter(range(10**6, 10**7)), np.repeat
    fresh = lambda n: [next(own) for _ in range(n)]
    core, plain, rng = list(range(1, 86)), list(range(200, 295)), np.random.default_rng(8)
    for hub, pair in (([*times(core, 3), *fresh(60)], [[*times(core, 3), *fresh(15)] for _ in range(2)]), ([*times(plain[:48], 20), *plain[48:]], [[*plain, *fresh(5)] for _ in range(2)]), (None, None)):
        sets = {0: hub or [*times(core, 3)], **{i: fresh(60) for i in range(1, 20)}}
        sets |= dict(enumerate(pair or [[*times(rng.choice(core, 75, False), rng.integers(1, 5)), *fresh(12)] for _ in range(25)], 30))
        sets = {i: np.sort(np.array(s, np.uint64)) for i, s in sets.items()}
        assert not pair or minhash.probability_jaccard(sets[30], sets[31]) >= 0.8 > minhash.probability_jaccard(sets[0], sets[30])
        want = {i: i for i in sets}
        for a in sets:
            for b in sets:
                if a < b and minhash.probability_jaccard(sets[a], sets[b]) >= 0.8 and want[a] != want[b]:
                    lo, hi = sorted((want[a], want[b]))
                    want = {i: lo if c == hi else c for i, c in want.items()}
        member = spark.createDataFrame([(1, i) for i in sets], "bucket long, id long")
        blobs = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "id long, set binary")
        got = {r["id"]: r["comp"] for r in minhash.link_buckets(member, blobs, 0.8).collect()}
        assert {i: got.get(i, i) for i in sets} == want


def test_probability_jaccard_is_estimated_and_exact():
    a, b = np.arange(1, 200, dtype=np.uint64), np.arange(50, 250, dtype=np.uint64)
    assert minhash.probability_jaccard(a, b) == pytest.approx(150 / 249)
    wa = np.sort(np.concatenate([a, a[:60], a[:60]]))
    u, c = np.unique(wa, return_counts=True)
    ja = minhash.probability_jaccard(wa, b)
    wx, wy = dict(zip(u.tolist(), minhash.weight(c), strict=True)), {int(x): 1.0 for x in b}
    brute = sum(1 / sum(max(wx.get(e, 0) / wx[d], wy.get(e, 0) / wy[d]) for e in {*wx, *wy}) for d in wx.keys() & wy.keys())
    assert ja == pytest.approx(brute)
    h = np.concatenate([minhash.W.mix(u), minhash.W.mix(b)])
    w = np.concatenate([minhash.weight(c), np.ones(len(b))])
    sig = minhash.signatures(np.repeat([0, 1], [len(u), len(b)]), h, w, 2, 4096)
    assert (sig[0] == sig[1]).mean() == pytest.approx(brute, abs=0.03)


def test_langid(spark, none):
    rng = np.random.default_rng(1)
    sylls = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ein", "ung", "ver"]}
    rows = [(i, " ".join("".join(rng.choice(sylls[g], 3)) for _ in range(40)), g) for i in range(200) for g in ("aa" if i % 2 else "bb",)]
    rows += [(900, None, "aa"), (901, "12 -- 34", "bb"), (902, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, F.col("doc_id") % 3 != 1)
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    assert all(got[i]["lang_pred"] == g for i, _, g in rows if i < 200) and all(0 <= r["score"] <= 1 for r in got.values())
    assert {got[i]["lang_pred"] for i in (900, 901, 902)} == {"und"}
    assert langid.predict(none, langid.fit(none, F.lit(True))).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "x" * (i * 37 % 900)) for i in range(300)] + [(None, None, None), (5, "http://h/5", "x" * 185)], "page_id long, url string, html string")
    a = warc_fixity.lay_out(pages, file_records=40).cache()
    assert a.count() == 302
    assert warc_fixity.audit(a, a, 2048, 4).count() == 0
    b = warc_fixity.damage(a)
    want = collections.Counter()
    for r in a.collect():
        want["missing"] += r["sha256"][:2] == "07"
        want["corrupt"] += r["sha256"][:2] == "2a"
        want["extra"] += r["sha256"][:2] == "c3"
    assert collections.Counter(r["status"] for r in warc_fixity.audit(a, b, 2048, 4).collect()) == +want
    raw = pages.where("page_id in (1, 2)").select(warc_fixity.record_text().alias("t")).collect()
    data = "".join(r["t"] for r in raw).encode()
    got = list(warc_fixity.parse_records(data))
    assert [g[0] for g in got] == [0, got[0][1]] and sum(g[1] for g in got) == len(data)
    files = spark.createDataFrame([("d/f.warc", bytearray(data)), ("d/g.warc", bytearray(b"")), ("h", None)], "path string, content binary")
    assert warc_fixity.read_warc(files).count() == 2
    empty = pages.limit(0)
    assert warc_fixity.audit(warc_fixity.lay_out(empty), warc_fixity.lay_out(empty)).count() == 0


def test_hilbert_keys_visit_every_cell_by_steps_of_one():
    for n, bits in ((2, 3), (3, 2)):
        cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * n)).reshape(n, -1).T
        keys = hilbert_ann.hilbert_keys(cells, bits)
        path = cells[np.argsort(keys)]
        assert sorted(keys) == list(range(len(cells))) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_ann(spark):
    x = RNG.normal(size=(300, 8)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(300, None, 0), (301, [0.0] * 8, 0), (302, [float("nan")] * 8, 0), (303, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = collections.defaultdict(list)
    for r in hilbert_ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    d, hit = x.astype(np.float64), 0
    assert sorted(got) == list(range(0, 300, 20))
    for q, found in got.items():
        s = d @ d[q]
        s[q] = -np.inf
        hit += len({v for v, _ in found} & set(np.lexsort((np.arange(300), -s))[:20]))
        assert len(found) == 20 and all(abs(s[v] - c) < 1e-9 for v, c in found) and q not in [v for v, _ in found]
    assert hit >= 0.9 * 20 * len(got)
    assert hilbert_ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_substring_dedup(docs, none):
    rows = sorted((math.inf if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in docs.collect())
    seen, want = set(), collections.Counter()
    for i, t in rows:
        w = WORD.findall(t)
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            key = tuple(w[a : a + 20])
            if key in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[(i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    for size in (500, 10**6):
        got = substring_dedup.remove_repeats(docs, chunk_bytes=size).collect()
        assert collections.Counter((math.inf if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want
    assert substring_dedup.remove_repeats(none).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_edit_distance():
    terms = ["idiot", "moron", "pathetic", "bad", "worthlessness"]
    auto = toxicity.Automaton(terms)
    for w in [*terms, "idoit", "idiots", "idio", "xidiot", "idyoot", "bat", "pathetik", "worthlesness", "worthlesnes", "wrthlesnes", "", "moronic"]:
        near = sorted((edits(w, t), t) for t in terms if edits(w, t) <= toxicity.allowed(t))
        assert auto.nearest(w) == ((near[0][1], near[0][0]) if near else None), w


def test_toxicity(spark, none):
    rng = np.random.default_rng(2)
    rows = [(i, text(60, rng) + (" you idiotx scumbag" if i % 5 == 0 else ""), 1 if i % 5 == 0 else 0) for i in range(400)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, text(40, rng) + " IDIOTX, scumbug"), (901, None), (902, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, F.col("doc_id") % 4 != 0)
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    assert all(got[i]["predicted"] == y for i, _, y in rows)
    assert got[900]["predicted"] == 1 and got[900]["misspelled"] > 0 and got[901]["predicted"] == got[902]["predicted"] == 0
    assert toxicity.keep_documents(df, model).count() == len(rows) - 80 + 2
    blank = toxicity.fit(none, labels.limit(0), F.lit(True))
    assert toxicity.score(none, blank).count() == 0 and toxicity.score(df, blank).where("predicted = 1").count() == 0


def luhn(d):
    return sum(x * (1 + i % 2) - 9 * (x * (1 + i % 2) > 9) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_pii(t):
    found = []
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for o, (k, p) in enumerate(pats.items()):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": lambda m=m: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda d=d: 12 <= len(d) <= 19 and luhn(d), "phone": lambda d=d: 9 <= len(d) <= 15}[k]():
                found.append((m.start(), o, f"{k}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(found))


PII = [
    "a.b@c.org", "x@y.z.w_c@d.org", "é😀 me@q.de, you@q.de", "1.2.3.4.5.6.7.8", "300.1.1.1", "0001.2.3.255", "4111 1111 1111 1111", "4111-1111 1111-1112", "+1 (809) 555-2752 call", "+12", "+1+1 234 567 89",
    "a@b", "@", "++", "9" * 5000, "a" * 5000 + "@", "1 " * 3000, "mail 4111111111111111 at 10.0.0.1 or z@z.zz +49 30 1234567", "", None, "x.@-.-", "a@b.c@d.e",
]


def test_pii(spark, none):
    df = spark.createDataFrame(list(enumerate(PII)), "doc_id long, text string").withColumn("spans", F.lit(1))
    for r in pii.report(df).collect():
        want = brute_pii(PII[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (r, want)
    ibans = spark.createDataFrame([(1, "iban DE89 3704 0044 0532 0130 00 x"), (2, "DE89 3704 0044 0532 0130 01"), (3, "call 809-555-2752"), (4, "no 809-555-2752")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.report(ibans).collect()}
    assert "iban:5:32" in got[1] and "iban" not in got[2] and got[3] == "local_phone:5:17" and got[4] == ""
    assert pii.report(none).count() == 0


def test_pii_iban_ends_where_its_country_says(spark):
    """Whatever word follows, the IBAN is found, and only it; a wrong check digit is still none."""
    ibans = ["ES9121000418450200051332", "ES91 2100 0418 4502 0005 1332", "SE4550000000058398257466", "BE68539007547034", "AT611904300234573201", "CZ6508000000192000145399", "PL61109010140000071219812874", "DE89 3704 0044 0532 0130 00", "NO9386011117947", "FR1420041010050500013M02606"]
    tails = ["", " BIC CAIXESBB", " BIC", " 5 days", " BANK", " A1", ", x", " BANK CODE 1234"]
    rows = [(x, x + t) for x in ibans for t in tails] + [(None, x[:-1] + str((int(x[-1]) + 1) % 10) + t) for x in ibans for t in tails] + [(None, ibans[0] + "7"), (None, ibans[0] + "a"), (None, "x" + ibans[0])]
    df = spark.createDataFrame([(i, "é " + t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    for r in pii.report(df).collect():
        x = rows[r["doc_id"]][0]
        assert [s for s in r["spans"].split(",") if s.startswith("iban")] == ([f"iban:2:{2 + len(x)}"] if x else []), (rows[r["doc_id"]], r["spans"])


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    odd = spark.createDataFrame([(500, "a  b \n c"), (501, " lead"), (502, "trail "), (503, "<|endoftext|> x,y."), (504, "tab\tnbsp x '’s I'll"), (505, "\0 \0"), (506, "中" * 5000)], "doc_id long, text string")
    all_ = docs.select("doc_id", "text").unionByName(odd)
    ids = collections.defaultdict(list)
    for r in all_.collect():
        ids[r["doc_id"]].append(t.encode(r["text"] or "", add_special_tokens=False).ids + [0])
    for capacity in (64, 2048):
        rows = packing.pack_documents(all_, capacity).collect()
        assert sum(r["length"] for r in rows) == sum(len(x) for v in ids.values() for x in v)
        for r in rows:
            seg = np.array(ids[r["doc_id"]][0][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert zlib.crc32(seg) == r["ids_crc32"] and (r["piece"] == 0 or r["length"] == capacity)
        by = collections.defaultdict(list)
        for r in rows:
            by[r["sequence_id"]].append((r["offset"], r["length"]))
        for v in by.values():
            at = 0
            for o, n in sorted(v):
                assert o == at
                at += n
            assert at <= capacity
        assert len(by) <= 1.25 * math.ceil(sum(r["length"] for r in rows) / capacity) + 1
    assert packing.pack_documents(none).count() == 0


def test_packing_finds_added_tokens_in_text(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x,<|endoftext|><|endoftext|>  y. ", " <|endoftext|>\n", "<|endoftext|", "one two<|endoftext|>three. <|ENDOFTEXT|>", "w <|endoftext|> " * 500]
    want = [t.encode(x, add_special_tokens=False).ids + [0] for x in texts]
    assert want[0] == [64, 220, 50256, 275, 0]
    for capacity in (64, 2048):
        rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), capacity).collect()
        assert sum(r["length"] for r in rows) == sum(map(len, want))
        assert all(zlib.crc32(np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for r in rows)


def step_by_step(counts, capacity):
    """Best-two-fit, one bin at a time."""
    left, out = dict(counts), []
    while any(left.values()):
        bin_, gap = [], capacity
        while fits := [n for n, k in left.items() if k and n <= gap]:
            bin_.append(max(fits))
            left[max(fits)] -= 1
            gap -= max(fits)
        if gap and len(bin_) > 1:
            small = min(bin_)
            room = gap + small
            pairs = [(a + b, a, b) for a, k in left.items() if k for b, m in left.items() if m - (a == b) > 0 and a + b <= room]
            best = max((t for t, _, _ in pairs), default=0)
            if best > small:
                _, a, b = min((x for x in pairs if x[0] == best), key=lambda x: x[1])
                bin_.remove(small)
                bin_ += [a, b]
                left[small] += 1
                left[a] -= 1
                left[b] -= 1
        out.append(tuple(sorted(bin_)))
    return sorted(out)


def test_plan_is_that_of_one_bin_at_a_time():
    rng = np.random.default_rng(4)
    for _ in range(60):
        capacity = int(rng.integers(8, 40))
        counts = {int(n): int(rng.integers(1, 9)) for n in rng.choice(np.arange(1, capacity + 1), int(rng.integers(1, 8)), replace=False)}
        got = packing.plan(counts, capacity)
        assert sorted(tuple(sorted(b)) for b, times in got for _ in range(times)) == step_by_step(counts, capacity)


def test_plan_replaces_the_smallest_by_two():
    # 60 + 30 leaves 10; 30 gives way to 22 + 18, which fill the gap of 40.
    assert packing.plan({60: 1, 30: 1, 22: 1, 18: 1}, 100)[0] == ([60, 18, 22], 1)


def test_mixing(docs, none, spark):
    got = mixing.annotate(docs).collect()
    size = collections.Counter()
    for r in docs.collect():
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    order = sorted(size, key=lambda s: (s is None, s))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(size.values()), {}, set(order)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > 2 * size[s]}
        for s in full or open_:
            target[s] = 2 * size[s] if full else level * w[s]
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and r["taken"] <= 2 * r["size"]
    assert len(got) == docs.count() and sorted(map(str, got)) == sorted(map(str, mixing.annotate(docs.repartition(5)).collect()))
    assert mixing.mix(docs).columns == docs.columns and mixing.annotate(none).count() == 0
    many = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(id % 97 + 1 as int)) as text", "concat('s', id % 4) as source")
    sums = mixing.annotate(many).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"]) <= 0.02 * r["g"] for r in sums)


