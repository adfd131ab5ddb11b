from __future__ import annotations

import json

import pytest

from phraseloom import analyze, analyze_records
from phraseloom.operators.records import ERROR_PREFIX, NO_PHRASE, request_records, request_rejects
from phraseloom.schemas import RESPONSE
from phraseloom.sources.requests import read_requests, stream_requests, write_response_records, write_responses
from phraseloom.sources.tables import write_model
from phraseloom.streaming.scoring import score_stream


def body(*records):
    return json.dumps({"values": [{"recordId": r, "data": d} for r, d in records]})


MANY = ". ".join(f"name{i:02}x" for i in range(40)) + "."
BODIES = {
    "good": body(
        ("meta1", {"content": "The rare disease came. Nobody knew about the rare disease then! End."}),
        ("meta2", {"content": "Unknown words only. Some more of them here."}),
        ("many", {"content": MANY}),
        ("meta1", {"content": "of the and."}),
    ),
    "bad records": body(
        ("missing", {"text": "x"}), ("null", {"content": None}), ("number", {"content": 5}),
        ("list", {"content": ["rare disease."]}), ("object", {"content": {"a": 1}}), ("empty", {"content": ""}), ("none", None),
    ),
    "no records": '{"values": []}',
    "not json": "By the way, this is no request",
    "other json": '{"value": 1}',
    "cut": '{"values": [{"recordId": "a", "data": {"content": "rare dis',
}


@pytest.fixture(scope="module")
def bodies(spark):
    return spark.createDataFrame(list(BODIES.items()), "request_id string, body string")


@pytest.fixture(scope="module")
def model(spark):
    rows = [("rare disease", 9.0), ("disease came", 1.0), ("rare disease came", 8.0)]
    rows += [(f"name{i:02}x", 50.0 - i) for i in range(40)]
    return spark.createDataFrame(rows, "phrase string, bm25 double")


@pytest.fixture(scope="module")
def answers(bodies, model):
    return {r.request_id: json.loads(r.body)["values"] for r in analyze(bodies, model).collect()}


def test_shape_of_an_answer(answers):
    first = answers["good"][0]
    assert list(first) == ["recordId", "data", "errors", "warnings"]
    assert first["recordId"] == "meta1" and first["errors"] == [] and first["warnings"] == []
    assert json.loads(first["data"]["keyphrases"]) == ["rare disease", "rare disease came"]
    assert json.loads(first["data"]["summaries"]) == ["The rare disease came", " Nobody knew about the rare disease then"]


def test_candidates_without_a_match_are_no_error(answers):
    second = answers["good"][1]
    assert second["errors"] == [] and json.loads(second["data"]["keyphrases"]) == []
    assert json.loads(second["data"]["summaries"]) == ["Unknown words only"] * 3


def test_thirty_phrases_best_first(answers):
    assert json.loads(answers["good"][2]["data"]["keyphrases"]) == [f"name{i:02}x" for i in range(30)]


def test_no_candidate_is_an_error_and_the_record_stays(answers):
    assert answers["good"][3] == {"recordId": "meta1", "data": {}, "errors": [ERROR_PREFIX + NO_PHRASE], "warnings": []}


def test_bad_records_are_answered_with_an_error_each(answers):
    got = {r["recordId"]: r["errors"] for r in answers["bad records"]}
    assert {k: v[0].removeprefix(ERROR_PREFIX) for k, v in got.items()} == {
        "missing": "content is missing", "null": "content is null", "number": "content is not a string",
        "list": "content is not a string", "object": "content is not a string", "empty": NO_PHRASE,
        "none": "content is missing",
    }
    assert all(len(v) == 1 for v in got.values())


def test_bodies_that_are_no_request_fail_whole(bodies, answers):
    assert {r.request_id for r in request_rejects(bodies).collect()} == {"not json", "other json", "cut"}
    assert set(answers) == {"good", "bad records", "no records"} and answers["no records"] == []
    assert request_records(bodies).count() == 11


def test_records_have_the_response_schema(bodies, model):
    record = analyze_records(bodies, model).schema["record"].dataType
    assert [(f.name, f.dataType.simpleString()) for f in record] == [(f.name, f.dataType.simpleString()) for f in RESPONSE]


def test_files_in_and_out(spark, bodies, model, answers, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for name, text in BODIES.items():
        (inbox / f"{name.replace(' ', '_')}.json").write_text(text)
    (inbox / "ignored.txt").write_text("x")
    requests = read_requests(spark, str(inbox))
    assert requests.count() == len(BODIES)
    write_responses(analyze(requests, model), str(tmp_path / "out"))
    lines = [json.loads(r.value)["values"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(map(json.dumps, lines)) == sorted(map(json.dumps, answers.values()))
    write_response_records(analyze_records(requests, model), str(tmp_path / "records"))
    assert spark.read.json(str(tmp_path / "records")).count() == 11


def test_stream_answers_what_the_batch_answers(spark, bodies, model, tmp_path):
    inbox, out, model_path = tmp_path / "in", tmp_path / "out", str(tmp_path / "model")
    inbox.mkdir()
    write_model(model, model_path)
    items = list(BODIES.items())

    def drop_in(batch):
        for name, text in batch:
            (inbox / f"{name.replace(' ', '_')}.json").write_text(text)

    def run():
        requests = stream_requests(spark, str(inbox), files_per_batch=2)
        score_stream(requests, model_path, str(out), str(tmp_path / "state")).awaitTermination()

    drop_in(items[:3])
    run()
    drop_in(items[3:])
    run()
    run()  # nothing new: nothing is answered twice
    streamed = sorted(str(r.record) for r in spark.read.parquet(str(out)).collect())
    batch = sorted(str(r.record) for r in analyze_records(bodies, model).collect())
    assert streamed == batch
    assert len(list(out.glob("batch=*"))) > 1


def test_a_body_is_parsed_once_for_answers_and_rejects(spark, monkeypatch):
    """The one plan with a parser is the one that writes the records."""
    from phraseloom.plans import pipelines

    bodies = spark.createDataFrame(
        [("a", '{"values":[{"recordId":"1","data":{"content":"Rare disease."}}]}'), ("b", '{"values":[]}'), ("c", "no json"), ("d", None)],
        "request_id string, body string",
    )
    plans = []
    plain = pipelines.stage

    def stage(df, name, workspace=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name, workspace)

    monkeypatch.setattr(pipelines, "stage", stage)
    known = spark.createDataFrame([("rare disease", 9.0)], "phrase string, bm25 double")
    answers, rejects = pipelines.analyze_with_rejects(bodies, known)
    assert {r.request_id for r in answers.collect()} == {"a", "b"}
    assert {(r.request_id, r.corrupt_body) for r in rejects.collect()} == {("c", "no json"), ("d", "")}
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in (answers, rejects)]
    assert sum(p.count("from_json") for p in plans) == 1
