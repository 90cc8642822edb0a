"""A run from segments to the release gate, with stand-ins for both models, and the control of calls around them."""

import json
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.operators import engine, memory, provider, run, verify
from quillon.plans import derived as D
from quillon.sources import readers

COLS = ["id", "attempt", "prompt", "model", "reply", "error", "input_tokens", "output_tokens"]
TABLE = str.maketrans(D.LATIN, D.CYRILLIC)


def translate(text):
    return "".join(p if p.startswith("[[P") else p.translate(TABLE) for p in re.split(r"(\[\[P\d+\]\])", text))


def translator(pdf):
    """Transliterates; a text with "stuck" fails on every call; a repair says so."""
    rows = []
    for r in pdf.itertuples():
        text = r.prompt.rpartition("Text: ")[2]
        fails = "stuck" in text
        out = translate(text) + (" лучше" if "A reviewer found" in r.prompt else "")
        rows.append((r.id, r.attempt, r.prompt, r.model, None if fails else out, "timeout" if fails else None, 1, 1))
    return pd.DataFrame(rows, columns=COLS)


def verifier(pdf):
    """Scores 60 with a finding for texts with "weak" that were not repaired, 97 else; leaves the first item of a first call out."""
    rows = []
    for r in pdf.itertuples():
        items = re.findall(r"### (\d+)\nSource: (.*?)\nTranslation: (.*?)(?=\n|$)", r.prompt)
        out = []
        for n, source, target in items[1 if r.attempt == 1 else 0 :]:
            low = "weak" in source and "лучше" not in target
            out.append({"id": int(n), **dict.fromkeys(verify.WEIGHTS, 60 if low else 97), "verdict": "major" if low else "ok", "issues": "stiff" if low else ""})
        rows.append((r.id, r.attempt, r.prompt, r.model, json.dumps({"results": out}), None, 1, 1))
    return pd.DataFrame(rows, columns=COLS)


SEGMENTS = [
    (1, 0, "Open the pump", False), (1, 1, "OPEN THE PUMP", False), (1, 2, "12.5", False), (1, 3, "Page 2 of 9", False), (1, 4, "Known line:", False), (1, 5, "valve", False),
    (2, 0, "A weak text here", False), (2, 1, "This one is stuck", False), (2, 2, "[OCR FAILED: x]", True), (3, 0, "All is well now", False), (3, 1, "All is well now", True),
]


@pytest.fixture(scope="module")
def inputs(spark):
    seg = spark.createDataFrame(SEGMENTS, "doc_id long, seq long, text string, from_ocr boolean").withColumn("page", F.lit(0)).withColumn("location", F.concat(F.lit("p"), F.col("seq")))
    tm = spark.createDataFrame([(0, "known line", "известная строка", "approved")], "pos long, source_text string, target_text string, status string")
    gl = spark.createDataFrame([(0, "valve", "клапан", False)], "pos long, en_term string, target_term string, exact_only boolean")
    return seg, tm, gl


@pytest.fixture(scope="module")
def first(inputs, tmp_path_factory):
    return run.Engine(translator, verifier).run(*inputs, cache_root=str(tmp_path_factory.mktemp("cache")))


def test_run_from_segments_to_gate(first):
    got = {(r["doc_id"], r["seq"]): r for r in first.results.collect()}
    assert len(got) == len(SEGMENTS)
    kinds = {k: r["match_type"] for k, r in got.items()}
    assert [kinds[1, i] for i in range(6)] == ["llm", "llm", "passthrough", "rule", "exact", "glossary"] and kinds[2, 2] == "skipped"
    assert got[1, 0]["translated_text"] == translate("Open the pump") and got[1, 1]["translated_text"] == translate("Open the pump").upper()
    assert got[1, 4]["translated_text"] == "известная строка:" and got[1, 5]["translated_text"] == "клапан"
    assert got[2, 0]["repaired"] and got[2, 0]["confidence"] == 97 and got[2, 0]["translated_text"].endswith("лучше")
    rules = {k: [i["rule"] for i in r["qa_issues"]] for k, r in got.items()}
    assert rules[2, 1] == ["api_error"] and rules[2, 2] == ["ocr_not_available", "ocr_replica_review"] and rules[3, 0] == []
    assert got[1, 2]["confidence"] is None and got[1, 0]["confidence"] == 97
    gate = {r["doc_id"]: r["status"] for r in first.gate.collect()}
    assert gate == {1: "pass", 2: "failed", 3: "review"}
    assert {r["doc_id"]: r["verified"] for r in first.summary.collect()}[1] == 3


def test_second_run_calls_no_model_for_what_is_cached(inputs, first):
    again = run.Engine(translator, verifier).run(*inputs, cache=first.cache, scores=first.scores)
    calls = [r for r in again.log.where("attempt <= 4 and model <> 'verifier'").collect()]
    assert {r["prompt"].rpartition("Text: ")[2] for r in calls} == {"This one is stuck"}
    assert again.log.where("model = 'verifier'").count() == 0
    key = lambda r: (r["doc_id"], r["seq"], r["translated_text"], r["confidence"])
    assert sorted(map(key, again.results.collect()), key=str) == sorted(map(key, first.results.collect()), key=str)


def test_an_approved_edit_makes_cached_results_stale(inputs, first):
    seg, tm, gl = inputs
    more = tm.unionByName(tm.limit(0).sparkSession.createDataFrame([(9, "new", "новое", "approved")], tm.schema))
    e = run.Engine(translator)
    texts = e._wanted(e._routed(seg, more, gl), more, gl)
    assert run.usable_cache(texts, first.cache).count() == 0
    assert run.usable_cache(e._wanted(e._routed(seg, tm, gl), tm, gl), first.cache).count() > 0


def test_cached_results_must_pass_todays_rules(spark, inputs, first):
    seg, tm, gl = inputs
    e = run.Engine(translator)
    texts = engine.store(e._wanted(e._routed(seg, tm, gl), tm, gl))
    bad = first.cache.withColumn("translated_text", F.concat("translated_text", F.lit(" [[P7]]"))).withColumn("qa_issues", F.array().cast(readers.qa.ISSUES))
    assert run.usable_cache(texts, bad).count() == 0


def test_fatal_error_ends_the_run_and_keeps_what_was_done(spark, inputs, tmp_path):
    def dead_on_second(pdf):
        out = translator(pdf)
        late = out["attempt"] > 1
        out.loc[late, "error"], out.loc[late, "reply"] = provider.FATAL + "HTTP 402", None
        return out

    with pytest.raises(engine.Stopped, match="402"):
        run.Engine(dead_on_second).run(*inputs, cache_root=str(tmp_path))
    kept = readers.current_table(spark, str(tmp_path))
    assert "Open the pump" in {r["text"] for r in kept.collect()}


def test_verifier_that_is_rejected_leaves_no_scores(inputs):
    def dead(pdf):
        return pd.DataFrame([(r.id, r.attempt, r.prompt, r.model, None, provider.FATAL + "HTTP 401", 0, 0) for r in pdf.itertuples()], columns=COLS)

    got = run.Engine(translator, dead).run(*inputs)
    assert got.stopped.startswith(provider.FATAL) and got.results.where("confidence is not null").count() == 0
    assert got.results.where("asked").select(F.explode("qa_issues.rule").alias("r")).where("r = 'verification_unavailable'").count() == got.results.where("asked").count()


def test_answers_of_a_service():
    waits = []

    def service(*answers):
        left = list(answers)

        def send(payload):
            x = left.pop(0)
            if isinstance(x, Exception):
                raise x
            return x(payload) if callable(x) else x

        return send

    ok = (200, {"text": " да "})
    assert provider.ask(service((429, {}), TimeoutError(), (503, {}), ok), {}, waits.append)["text"] == " да " and waits == [2, 5, 15]
    with pytest.raises(TimeoutError):
        provider.ask(service(*[TimeoutError()] * 4), {}, waits.append)
    with pytest.raises(provider.FatalError):
        provider.ask(service((402, {"m": "no credit"})), {}, waits.append)
    for answer in ((200, {"error": "x"}), (200, {"text": ""}), (404, {})):
        with pytest.raises(RuntimeError):
            provider.ask(service(answer), {}, waits.append)
    seen = []
    provider.ask(service(lambda p: seen.append(p) or (400, {"error": "Reasoning is not supported"}), lambda p: seen.append(p) or ok), {"reasoning": 1, "prompt": "x"}, waits.append)
    assert seen[1] == {"prompt": "x"}
    rows = provider.http_provider(service((200, {"text": "a"}), (403, {}), ok), sleep=waits.append)(pd.DataFrame({"id": [1, 2, 3], "attempt": 1, "prompt": "p", "model": "m"}))
    assert rows["reply"].tolist()[0] == "a" and rows["error"].str.startswith(provider.FATAL).tolist()[1:] == [True, True]
