"""Models that grow batch by batch equal a build over everything."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from phraseloom import LanguageTagger, build_model
from phraseloom.__main__ import parser, run
from phraseloom.operators import corpus, model
from phraseloom.params import DEFAULTS
from phraseloom.plans import incremental
from phraseloom.sources import tables
from tests import brute
from tests.test_scores import close, frame, random_corpus

P = replace(DEFAULTS, min_bm25=-50.0)
TAGGER = LanguageTagger()


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")


def rows(m):
    return sorted(map(tuple, m.withColumn("bm25", F.round("bm25", 8)).select("lang", "phrase", "bm25").collect()))


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_three_batches_equal_one_build(spark, docs, tmp_path, least):
    p = replace(P, min_corpus_count=least)
    path = str(tmp_path / "profile")
    for i in range(3):
        incremental.add_documents(docs.where(F.col("doc_id") % 3 == i), path, str(i), TAGGER, p)
    incremental.add_documents(docs.where(F.col("doc_id") % 3 == 1), path, "1", TAGGER, p)  # once more, after a failure
    grown = incremental.grown_model(spark, path, p)
    assert rows(grown) == rows(build_model(docs, TAGGER, p))
    incremental.compact(spark, path, str(tmp_path / "one"), p)
    assert rows(incremental.grown_model(spark, str(tmp_path / "one"), p)) == rows(grown)


def test_withdrawn_documents_leave_no_trace(spark, docs, tmp_path):
    path = str(tmp_path / "profile")
    incremental.add_documents(docs, path, "all", TAGGER, P)
    for i in (0, 1):
        incremental.withdraw_documents(docs.where(F.col("doc_id") % 4 == i), path, f"gone-{i}", TAGGER, P)
    rest = docs.where(F.col("doc_id") % 4 > 1)
    assert rows(incremental.grown_model(spark, path, P)) == rows(build_model(rest, TAGGER, P))
    cells = incremental.read_cells(spark, path, P)
    assert cells.where("docs <= 0").count() == 0
    assert cells.exceptAll(incremental.document_cells(rest, TAGGER, P).select(cells.columns)).count() == 0


def test_one_remaining_holder_is_known_after_any_withdrawal(spark):
    """A phrase that two documents held is held by the other one."""
    bags = random_corpus(3)
    gone = [d for i, d in enumerate(bags) if i % 2]
    left = {d: b for d, b in bags.items() if d not in gone}
    for id_type in ("string", "bigint"):
        typed = lambda df: df if id_type == "string" else df.withColumn("doc_id", F.xxhash64("doc_id"))  # noqa: E731, B023
        every = corpus.phrase_cells(typed(frame(spark, bags)))
        out = corpus.withdrawn_cells(corpus.phrase_cells(typed(frame(spark, {d: bags[d] for d in gone}))))
        profile = corpus.profile_of_cells(corpus.merged_cells(every.unionByName(out)))
        _, _, n, avgdl = brute.corpus(left)
        assert tuple(corpus.stats_of_profile(profile).first()) == (n, avgdl)
        p = replace(DEFAULTS, min_bm25=0.0)
        close({r.phrase: r.bm25 for r in model.model_of_profile(profile, p).collect()}, brute.model(left, 0.0))


def test_growing_reads_no_earlier_text(spark, docs, tmp_path):
    path = str(tmp_path / "profile")
    incremental.add_documents(docs, path, "all", TAGGER, P)
    plan = incremental.grown_model(spark, path, P)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan and "regexp" not in plan and "Python" not in plan and "SortAggregate" not in plan


def test_what_a_table_of_cells_cannot_do_is_an_error(spark):
    p = replace(P, min_corpus_count=4)
    one, many = corpus.phrase_cells(frame(spark, random_corpus(1))), corpus.phrase_cells(frame(spark, random_corpus(1)), p)
    with pytest.raises(ValueError):
        corpus.merged_cells(one, p)
    with pytest.raises(ValueError):
        corpus.withdrawn_cells(many)


def test_empty_batches(spark, docs, tmp_path):
    path = str(tmp_path / "profile")
    incremental.add_documents(docs.where("false"), path, "none", TAGGER, P)
    assert incremental.grown_model(spark, path, P).collect() == []
    incremental.add_documents(docs, path, "all", TAGGER, P)
    assert rows(incremental.grown_model(spark, path, P)) == rows(build_model(docs, TAGGER, P))


def test_command_line_grows_a_model_and_builds_from_phrase_files(spark, docs, tmp_path):
    half = tmp_path / "half"
    for i in (0, 1):
        docs.where(F.col("doc_id") % 2 == i).write.parquet(f"{half}{i}")
        args = ["build", "--format", "parquet", "--input", f"{half}{i}", "--model", str(tmp_path / "model"), "--rejects", str(tmp_path / f"r{i}")]
        run(spark, parser().parse_args([*args, "--profile", str(tmp_path / "profile"), "--segment", str(i)]))
    titled = docs.withColumn("file", F.col("doc_id").cast("string"))
    want = build_model(titled, TAGGER, title_col="file")
    assert rows(tables.read_model(spark, str(tmp_path / "model"))) == rows(want)

    counts = spark.createDataFrame([("a", "x y", 2), ("a", "x y", 1), ("b", "x y", 1), ("b", "z", 2), ("c", "w", 1)], "file string, phrase string, tf long")
    tables.write_delimited(counts, str(tmp_path / "phrases"))
    (tmp_path / "phrases" / "more.txt").write_text("d\tw\tmany\nd\tv\t5\n")
    got = tables.phrases_of_files(tables.read_delimited(spark, str(tmp_path / "phrases"))).collect()
    assert sorted(map(tuple, got)) == [("a", 3, "x y", 3), ("b", 3, "x y", 1), ("b", 3, "z", 2), ("c", 1, "w", 1), ("d", 5, "v", 5)]
    run(spark, parser().parse_args(["build", "--format", "phrases", "--input", str(tmp_path / "phrases"), "--model", str(tmp_path / "m2"), "--min-bm25=-9"]))
    bags = {"a": {"x y": 3}, "b": {"x y": 1, "z": 2}, "c": {"w": 1}, "d": {"v": 5}}
    close({r.phrase: r.bm25 for r in tables.read_model(spark, str(tmp_path / "m2")).collect()}, brute.model(bags, -9.0))
