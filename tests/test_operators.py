"""Lookups, scores, layout, Word files and jobs on small tables."""

import io
import zipfile
from xml.etree import ElementTree as ET

import pytest
from pyspark.sql import functions as F

from quillon.functions import qa
from quillon.operators import engine, layout, memory, verify
from quillon.sources import docx, readers
from quillon.streaming import jobs


def test_memory_first_entry_wins_whatever_the_partitions(spark):
    tm = spark.createDataFrame([(1, "Pump.", "насос1", "approved"), (0, "pump", "насос0", "approved"), (2, "Draft", "x", "draft")], "pos long, source_text string, target_text string, status string").repartition(3)
    seg = spark.createDataFrame([("Pump:",), ("PUMP.",), ("draft",)], "text string")
    got = {r["text"]: r["tm_target"] for r in memory.tm_exact(seg, tm).collect()}
    assert got == {"Pump:": "насос0:", "PUMP.": "насос1", "draft": None}


def test_glossary_plural_and_maximal(spark):
    gl = spark.createDataFrame([(0, "pump", "насос", False), (1, "feed pump", "питательный насос", False), (2, "Date", "Дата", True)], "pos long, en_term string, target_term string, exact_only boolean")
    seg = spark.createDataFrame([(1, "Two feed\npumps by Date"), (2, "pumping"), (3, "date:")], "id int, text string")
    hits = memory.glossary_hits(seg, gl, ["id"])
    assert {(r["id"], r["en_term"]) for r in hits.collect()} == {(1, "pump"), (1, "feed pump"), (3, "Date")}
    assert {(r["id"], r["en_term"]) for r in memory.maximal_spans(hits, ["id"]).collect()} == {(1, "feed pump"), (3, "Date")}


def test_glossary_hits_small_and_large_and_no_text_travels(spark, monkeypatch):
    terms = [("pump", False), ("feed pump", False), ("Date", True), ("&x", False), ("pass", False)]
    gl = spark.createDataFrame([(i, t, t.upper(), x) for i, (t, x) in enumerate(terms)], "pos long, en_term string, target_term string, exact_only boolean")
    seg = spark.createDataFrame([(1, "Two feed\npumps by Date, pump pump", "PUMP"), (2, "pumping &x", "&X"), (3, "date:", "нет"), (4, "PASSES", "нет")], "id int, text string, target string")
    rows = lambda d: {tuple(r) for r in d.collect()}
    plan = memory.glossary_hits(seg, gl, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    hits, absent = rows(memory.glossary_hits(seg, gl, ["id"])), rows(memory.terms_absent(seg, gl, ["id"]).select("id", "en_term"))
    assert {(h[0], h[2]) for h in hits} == {(1, "pump"), (1, "feed pump"), (2, "&x"), (3, "Date"), (4, "pass")} and absent == {(1, "feed pump"), (3, "Date"), (4, "pass")}
    monkeypatch.setattr(memory, "SMALL_GLOSSARY", 0)
    assert rows(memory.glossary_hits(seg, gl, ["id"])) == hits and rows(memory.terms_absent(seg, gl, ["id"]).select("id", "en_term")) == absent


def test_fuzzy_is_difflib(spark):
    from difflib import SequenceMatcher

    tm = spark.createDataFrame([(i, t, "t", "approved") for i, t in enumerate(["the main valve", "the main valves", "other"])], "pos long, source_text string, target_text string, status string")
    got = memory.tm_fuzzy(spark.createDataFrame([("The main valve!",)], "text string"), tm).orderBy("rank").collect()
    assert [r["source_text"] for r in got] == sorted(["the main valve", "the main valves"], key=lambda s: -SequenceMatcher(None, "the main valve!", s).ratio())


def test_fuzzy_bounds_lose_no_pair():
    from difflib import SequenceMatcher

    from quillon.functions import fuzzy

    right = ["", "a", "阀门 one two", "the main valve of the pump " * 3, "abcdefgh" * 16, "xyz " * 80]
    left = [r[k:] + add for r in right for k in (0, 1, 7) for add in ("", "q", "门 two")] + ["İstanbul".lower(), "\ud800"]
    want = {(i, j, r) for i, a in enumerate(left) for j, b in enumerate(right) if (r := SequenceMatcher(None, a, b).ratio()) >= 0.85}
    assert sorted(fuzzy.above(left, right, 0.85)) == sorted(want) and len(want) > 10


def test_cache_pending_and_merge(spark):
    bad = [("numeric_mismatch", "critical", "")]
    cache = spark.createDataFrame([("m", "a", "1", []), ("m", "b", "0", []), ("m", "c", "1", bad)], f"model string, text string, sig string, qa_issues {qa.ISSUES}")
    want = spark.createDataFrame([("m", x, "1") for x in "abcd"], "model string, text string, sig string")
    assert {r["text"] for r in memory.pending(want, cache).collect()} == {"b", "c", "d"}
    a = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")
    b = spark.createDataFrame([(2, None), (3, "new")], "k int, v string")
    assert {(r["k"], r["v"]) for r in memory.merge_cache(a, b, ["k"]).collect()} == {(1, "old"), (2, None), (3, "new")}


def test_replies(spark):
    good = '```json\n{"results":[{"id":1,"meaning":90.5,"completeness":100,"terminology":100,"grammar":100,"verdict":"OK"},{"id":2,"meaning":"x","completeness":1,"terminology":1,"grammar":1},{"id":9,"meaning":1,"completeness":1,"terminology":1,"grammar":1}]}\n```'
    rows = spark.createDataFrame([(1, 2, good), (2, 2, "sorry"), (3, 1, None)], "batch_id long, n_items int, raw string")
    got = verify.parse_replies(rows).collect()
    assert [(r["batch_id"], r["item"], r["meaning"], r["confidence"], r["verdict"]) for r in got] == [(1, 1, 90, 96, "ok")]


def test_places_hold_when_a_plan_is_read_in_other_partitions(spark):
    rows = spark.range(0, 6000, 1, 6).select(F.concat(*[F.sha2(F.concat(F.lit(f"{i} "), ((F.col("id") * 7) % 2000).cast("string")), 512) for i in range(8)]).alias("k"), (F.col("id") * 3).alias("pos"))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "64k")
    try:
        got = {r["k"]: r["place"] for r in memory.ordered_distinct(rows, "k", "pos").collect()}
    finally:
        spark.conf.unset(size)
    assert [got[r["k"]] for r in rows.where("pos < 6000").orderBy("pos").collect()] == list(range(2000))
    assert memory.ordered_distinct(rows.limit(0), "k", "pos").count() == 0


def test_confidence_of_an_exact_tie_is_half_even(spark):
    raw = '{"results":[{"id":1,"meaning":41,"completeness":51,"terminology":61,"grammar":71}]}'
    assert verify.parse_replies(spark.createDataFrame([(1, 1, raw)], "batch_id long, n_items int, raw string")).first()["confidence"] == 52


def test_lines_blocks_and_snap(spark):
    w = [(1, 0, "Big", 10.0, 30.0), (1, 0, "pump", 34.0, 60.0)]
    words = spark.createDataFrame([(d, p, x0, x1, 5.0, 15.0, True, 10.0, t) for d, p, t, x0, x1 in w] + [(1, 0, 10.0, 25.0, 30.0, 40.0, True, 10.0, "•one")], "doc_id long, page int, x0 double, x1 double, top double, bottom double, upright boolean, size double, text string")
    lines = layout.assemble_lines(words).orderBy("line_id").collect()
    assert [(r["text"], r["marker"]) for r in lines] == [("Big pump", None), ("one", "•")]
    assert len(layout.assemble_blocks(layout.assemble_lines(words)).collect()) == 2
    assert spark.range(1).select(layout.snap(F.array(*[F.lit(float(x)) for x in (0, 1, 2, 3)])).alias("s")).first()["s"] == [0.0, 2.0]


def test_spaced_lines_are_read_with_the_words_of_the_others(spark):
    rows = [(1, 0, "open the main valve and close the main pump"), (1, 1, "o p e n t h e m a i n v a l v e"), (1, 2, "O p e n t h e m a i n v a l v e"), (1, 3, "c l o s e t h e p u m p n o w"), (2, 0, "no spaced line here")]
    got = {r["text"]: r["fixed"] for r in layout.rebuild_spaced(spark.createDataFrame(rows, "doc_id long, seq long, text string")).collect()}
    assert got[rows[1][2]] == "open the main valve" and got[rows[2][2]] in ("open the main valve", "Open the main valve") and got[rows[3][2]].startswith("close the pump ")
    assert len(got) == 3


def test_lines_without_upright_words_and_odd_rows(spark):
    schema = "doc_id long, page int, x0 double, x1 double, top double, bottom double, upright boolean, size double, text string"
    rows = [(1, 0, 10.0, 30.0, 5.0, 15.0, False, 10.0, "side"), (2, 0, 10.0, 30.0, 5.0, 15.0, True, 10.0, None), (2, 0, 10.0, 20.0, 5.0, 15.0, True, 10.0, "A."), (2, 0, 60.0, 90.0, 6.0, 15.0, True, 10.0, "title"), (2, 0, 95.0, 120.0, 5.0, 15.0, True, 10.0, "Page"), (2, 0, 10.0, 20.0, 40.0, 50.0, True, 10.0, "➔"), (2, 0, 10.0, 20.0, 40.0, 50.0, True, 10.0, "➔")]
    got = [(r["doc_id"], r["text"], r["marker"]) for r in layout.assemble_lines(spark.createDataFrame(rows, schema)).orderBy("line_id").collect()]
    assert got == [(2, "title", "A."), (2, "Page", None), (2, "➔", "➔")]
    assert layout.assemble_blocks(layout.assemble_lines(spark.createDataFrame([], schema))).count() == 0


def word_file(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{docx.W}"><w:body>{body}</w:body></w:document>')
        z.writestr("other.bin", b"kept")
    return out.getvalue()


BODY = (
    "<w:p><w:r><w:t>Plain </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:tab/><w:t>end</w:t></w:r></w:p>"
    "<w:p><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:ins><w:r><w:t>new</w:t></w:r></w:ins></w:p><w:p><w:r><w:t>12</w:t></w:r></w:p>"
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>Cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
)


def test_docx_units_and_round_trip(spark):
    raw = word_file(BODY)
    got = docx.extract(raw)
    assert [(t, k) for _, t, k, _ in got] == [("⟦1⟧Plain ⟦2⟧bold⟦t⟧⟦3⟧end", "paragraph"), ("new", "paragraph"), ("Cell", "table_cell")]
    same = docx.translate(raw, lambda t, loc: (t, False))
    assert [r[1] for r in docx.extract(same)] == [r[1] for r in got]
    with zipfile.ZipFile(io.BytesIO(same)) as z:
        assert z.read("other.bin") == b"kept"
    files = spark.createDataFrame([("a.docx", bytearray(raw)), ("b.docx", bytearray(b"junk"))], "path string, content binary")
    seg = docx.read_docx(files)
    assert seg.count() == 3
    out = docx.write_docx(files.where("path = 'a.docx'"), seg.select("doc_id", "location", F.upper("text").alias("translated_text"), F.lit(True).alias("flagged")))
    assert "NEW" in [r[1] for r in docx.extract(bytes(out.first()["content"]))]
    assert docx.structure_counts(raw)["tables"] == 1


FIELDS = (
    '<w:p><w:r><w:t>Before </w:t></w:r><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:t>CODE</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r><w:hyperlink><w:r><w:t>linked</w:t></w:r></w:hyperlink><w:r><w:t> after</w:t><w:br/></w:r></w:p>'
    '<w:tbl><w:tblPr/><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>inner</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>'
    '<w:p><w:r><w:rPr><w:b w:val="0"/></w:rPr><w:t>off </w:t></w:r><w:r><w:t>same</w:t></w:r></w:p>'
)


def test_word_walk_cuts_at_fields_and_links_and_names_cells():
    got = {loc: t for _, t, _, loc in docx.extract(word_file(FIELDS))}
    assert got == {"document/p0": "Before", "document/p0.1": "linked", "document/p0.2": "after⟦b⟧", "document/tbl0/row0/col0/p1": "a", "document/tbl0/row0/col1/p2": "b", "document/tbl1/row0/col0/p3": "inner", "document/p4": "off same"}
    out = docx.extract(docx.translate(word_file(FIELDS), lambda t, loc: ("X" if loc.endswith("p0.1") else t, True)))
    assert {loc: t for _, t, _, loc in out} == {**got, "document/p0.1": "X"}
    lost = docx.translate(word_file(BODY), lambda t, loc: ("⟦9⟧all ⟦2⟧kept", False))
    assert docx.extract(lost)[0][1] == "⟦1⟧all ⟦2⟧kept"


def test_word_files_are_handled_many_at_a_time_and_meet_their_own_results(spark):
    raw, other = word_file(BODY), word_file("<w:p><w:r><w:t>Other</w:t></w:r></w:p>")
    files = spark.createDataFrame([(f"{i}.docx", bytearray(raw if i % 2 else other)) for i in range(600)] + [("0.docx", bytearray(raw)), ("alone.docx", bytearray(raw))], "path string, content binary")
    seg = docx.read_docx(files)
    assert seg.count() == 300 * 3 + 300 + 2 * 3
    found = seg.where("doc_id <> 'alone.docx'").select("doc_id", "location", F.concat("doc_id", F.lit(" "), "location").alias("translated_text"), (F.col("seq") == 0).alias("flagged")).distinct()
    found = found.unionByName(spark.createDataFrame([("none.docx", "document/p0", "lost", True)], found.schema))
    out = docx.write_docx(files, found)
    # A call of Python for each file (FlatMapGroupsInPandas) took 2 ms and more besides the file's own work.
    assert "InPandas" not in out._jdf.queryExecution().toString() + seg._jdf.queryExecution().toString()
    rows = [(r["path"], bytes(r["content"])) for r in out.collect()]
    assert len(rows) == 602 and len({p for p, _ in rows}) == 601
    for path, content in rows:
        got = docx.extract(content)
        assert [t for _, t, _, _ in got] == ([t for _, t, _, _ in docx.extract(raw)] if path == "alone.docx" else [f"{path} {loc}" for *_, loc in got])


def test_frames_of_word_rows_are_bounded_and_whole():
    rows = [(str(i), bytes(1 << 20 if i % 1000 == 0 else 3)) for i in range(10000)]
    got = list(docx.frames(rows, docx.FILE, "content"))
    assert list(docx.rows_of(got)) == rows and max(b.num_rows for b in got) <= docx.FRAME_ROWS and max(b.nbytes for b in got) < 2 * docx.FRAME_SIZE
    assert list(docx.frames([], docx.FILE, "content")) == []


def test_xml_is_what_elementtree_writes():
    for source in (BODY, FIELDS, '<w:p xmlns:q="urn:q" q:b="1" a="&lt;&quot;&#10;&#9;&#13;&amp;&gt;" xml:space="preserve"> x &amp; <q:y xmlns:r="urn:r" r:z=""/>tail &gt;<w:t></w:t></w:p>'):
        root = ET.fromstring(f'<w:document xmlns:w="{docx.W}" xmlns:mc="{docx.MC}">{source}</w:document>')
        assert docx.xml(root) == ET.tostring(root, encoding="UTF-8", xml_declaration=True)


def test_word_rewritten_as_its_sql_on_odd_lines(spark, tmp_path):
    from quillon.plans import page_queries

    spark.createDataFrame([(1, "One two\n\n 12\nthree <&> \f", "s", "en"), (2, None, "s", "en"), (3, "\n \u2028x y", "s", "en")], "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = page_queries.word_rewritten(spark, str(tmp_path))
    assert "InPandas" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == [(1, "X ⟦1⟧One ⟦2⟧two", 0), (1, "X ⟦1⟧three ⟦2⟧<&>", 1), (3, "X ⟦1⟧\u2028x ⟦2⟧y", 0)]


def test_paths_and_saved_state(spark, tmp_path):
    from quillon.sources import sinks

    assert sinks.inside("/a/b", "c/d") and sinks.inside("/a/b", ".") and not sinks.inside("/a/b", "../bc") and not sinks.inside("/a/b", "/etc")
    keep = jobs.save_state(str(tmp_path))
    batch = lambda *rows: spark.createDataFrame(rows, "job_id string, status string")
    keep(batch(("a", "Queued"), ("b", "Queued")), 0)
    keep(batch(("b", "Done"), ("c", "Queued")), 1)
    assert {(r["job_id"], r["status"]) for r in readers.current_table(spark, str(tmp_path)).collect()} == {("a", "Queued"), ("b", "Done"), ("c", "Queued")}
    scores = spark.createDataFrame([("d1", "t", "u", 90), ("d1", "t", "u", 90)], "digest string, text string, translated_text string, confidence int")
    sinks.save_scores(scores, str(tmp_path / "s"), "1")
    assert [tuple(r) for r in readers.current_table(spark, str(tmp_path / "s")).collect()] == [("d1", 90)]


def test_settings_and_segments(spark):
    lines = spark.createDataFrame([(0, "﻿A = '1'"), (1, "# no"), (2, "A=2"), (3, ""), (4, "B=x=y")], "line long, value string")
    real = spark.createDataFrame([("B", "real")], "key string, value string")
    assert {(r["key"], r["value"]) for r in readers.settings(lines, real).collect()} == {("A", "1"), ("B", "real")}
    d = spark.createDataFrame([(1, " a \n\n b"), (2, None)], "doc_id long, text string")
    assert [(r["seq"], r["text"]) for r in readers.segments(d).collect()] == [(0, "a"), (2, "b")]


EVENTS = [("a", 1, "submit", None, 0), ("a", 2, "start", None, 0), ("a", 3, "progress", "x", 40), ("a", 4, "progress", "y", 20), ("a", 5, "finish", None, 0), ("a", 6, "fail", None, 0), ("b", 1, "submit", None, 0), ("b", 2, "cancel", None, 0), ("b", 3, "start", None, 0), ("c", 1, "submit", None, 0), ("c", 2, "start", None, 0), ("c", 3, "progress", "z", 150), ("c", 4, "cancel", None, 0), ("c", 5, "progress", "z", 160), ("d", 1, "start", None, 0)]
WANT = {"a": ("Done", 100), "b": ("Cancelled", 0), "c": ("Cancelled", 99)}


def events(spark):
    return spark.createDataFrame([(j, o, k, s, p, None) for j, o, k, s, p in EVENTS], "job_id string, ord long, kind string, stage string, percent int, error string").withColumn("ts", F.timestamp_seconds("ord"))


def test_jobs_batch(spark):
    got = {r["job_id"]: (r["status"], r["progress"]) for r in jobs.final_state(events(spark).repartition(3)).collect()}
    assert got == WANT


@pytest.mark.parametrize("files", [1, 3])
def test_jobs_stream(spark, tmp_path, files):
    """One batch or many end alike."""
    e = events(spark)
    for i in range(files):
        e.where((F.col("ord") - 1) % 6 >= 0 if files == 1 else F.floor((F.col("ord") - 1) / 2) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    rows = {}
    q = jobs.run_stream(stream).writeStream.outputMode("update").foreachBatch(lambda df, _: rows.update({r["job_id"]: (r["status"], r["progress"]) for r in df.collect()})).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows == WANT


def test_ladder_ends_and_logs(spark):
    from quillon.plans.text_queries import echo_provider

    terms = F.array().cast("array<struct<pos:bigint,en_term:string,target_term:string>>")
    todo = spark.createDataFrame([(i, "word " * (i + 1)) for i in range(12)], "id long, text string").select("id", "text", F.col("text").alias("masked"), F.array().cast("array<string>").alias("toks"), terms.alias("terms"), F.lit("").alias("examples"))
    done, log = engine.retry_ladder(todo, echo_provider, fallback="second", workers=2)
    rows = done.collect()
    assert sorted(r["id"] for r in rows) == list(range(12)) and max(r["attempts"] for r in rows) <= 4
    assert log.count() >= 12
