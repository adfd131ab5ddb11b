from __future__ import annotations

import json
from dataclasses import replace

import pytest

import phraseloom.__main__ as cli
from phraseloom.__main__ import main
from phraseloom.session import MB, SHUFFLE_PER_INPUT_BYTE, settings
from phraseloom.sources.tables import read_model


@pytest.fixture()
def store(tmp_path):
    root = tmp_path / "store" / "notes"
    root.mkdir(parents=True)
    # 'rare disease' is in two of forty notes, 'common fact' in all of them
    for i in range(40):
        rare = "The doctor met a rare disease. It is a rare disease of the young. " if i < 2 else ""
        (root / f"n{i}.txt").write_text(f"{rare}The common fact. The note of day {i} by word{i}.")
    (root / "scan.pdf").write_bytes(b"%PDF")
    return str(tmp_path / "store")


def test_build_then_analyze_enrich_and_stream(spark, store, tmp_path):
    model, out, inbox = str(tmp_path / "model"), tmp_path / "out", tmp_path / "in"
    main(["build", "--input", store, "--folder", "notes", "--model", model, "--min-bm25", "1.5", "--rejects", str(tmp_path / "bad")])
    phrases = {r.phrase for r in read_model(spark, model).collect()}
    assert "rare disease" in phrases and "common fact" not in phrases
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1
    inbox.mkdir()
    request = {"values": [{"recordId": "r1", "data": {"content": "We saw a rare disease in the town. Nothing else."}}]}
    (inbox / "q.json").write_text(json.dumps(request))
    (inbox / "bad.json").write_text("no request")
    (inbox / "none.json").write_text('{"values":[]}')
    main(["analyze", "--requests", str(inbox), "--model", model, "--output", str(out)])
    assert [r.corrupt_body for r in spark.read.parquet(str(out) + "-rejects").collect()] == ["no request"]
    bodies = [json.loads(r.value) for r in spark.read.text(str(out)).collect()]
    assert len(bodies) == 2 and {"values": []} in bodies
    answer = next(b for b in bodies if b["values"])["values"][0]
    assert json.loads(answer["data"]["keyphrases"]) == ["rare disease"]
    assert json.loads(answer["data"]["summaries"]) == ["We saw a rare disease in the town"]
    streamed = tmp_path / "streamed"
    main(["stream", "--requests", str(inbox), "--model", model, "--output", str(streamed), "--state", str(tmp_path / "state")])
    assert spark.read.parquet(str(streamed)).first().record.data == answer["data"]
    main(["enrich", "--input", store, "--output", str(tmp_path / "rich"), "--min-bm25", "1.5", "--fallback", "lead"])
    rich = {r.filename: r for r in spark.read.parquet(str(tmp_path / "rich")).collect()}
    assert len(rich) == 40 and "rare disease" in rich["n0.txt"].terms
    assert rich["n9.txt"].creation_ts is not None


def test_sampled_build_and_table_input(spark, store, tmp_path):
    docs = str(tmp_path / "docs")
    spark.read.text(store + "/notes", wholetext=True).selectExpr("value as text", "md5(value) as doc_id").write.parquet(docs)
    sizes = []
    for extra in ([], ["--sample", "1"]):
        model = str(tmp_path / f"m{len(sizes)}")
        main(["build", "--input", docs, "--format", "parquet", "--model", model, "--min-bm25", "-9"] + extra)
        sizes.append(read_model(spark, model).count())
    assert sizes[0] > sizes[1]


def test_settings_grow_with_the_input():
    small, middle, large = settings(10 * MB, 8), settings(1024**4, 800), settings(100 * 1024**4, 8000)
    assert small["spark.sql.shuffle.partitions"] == "8"
    assert 800 < int(middle["spark.sql.shuffle.partitions"]) < int(large["spark.sql.shuffle.partitions"])
    per_partition = 100 * 1024**4 * SHUFFLE_PER_INPUT_BYTE / int(large["spark.sql.shuffle.partitions"])
    assert 0.9 * 256 * MB < per_partition <= 256 * MB
    assert small["spark.sql.files.maxPartitionBytes"] == large["spark.sql.files.maxPartitionBytes"]


def test_the_whole_corpus_is_used_unless_a_sample_is_asked_for(spark, store, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "DEFAULTS", replace(cli.DEFAULTS, max_documents=3))
    model = str(tmp_path / "m")
    main(["build", "--input", store, "--folder", "notes", "--model", model, "--min-bm25", "1.5"])
    assert "rare disease" in {r.phrase for r in read_model(spark, model).collect()}
    assert spark.read.parquet(model + "-rejects").count() == 1


def test_titles_count_in_a_corpus_and_not_in_a_score(spark, tmp_path):
    """File names hold a phrase that no text has."""
    root = tmp_path / "named"
    root.mkdir()
    for i in range(40):
        (root / (f"strange device {'x' * i}.txt" if i < 2 else f"n{i}.txt")).write_text(f"The note of day {i} by word{i}.")
    (root / "blank.txt").write_text("  ")
    main(["build", "--input", str(root), "--model", str(tmp_path / "m"), "--min-bm25", "1.0"])
    assert any(r.phrase.startswith("strange device") for r in read_model(spark, str(tmp_path / "m")).collect())
    main(["enrich", "--input", str(root), "--output", str(tmp_path / "rich"), "--min-bm25", "1.0"])
    rich = spark.read.parquet(str(tmp_path / "rich"))
    assert rich.count() == 40 and not any("strange device" in " ".join(r.terms) for r in rich.collect())
    assert [r.reason for r in spark.read.parquet(str(tmp_path / "rich-rejects")).collect()] == ["file is blank"]
