"""What the plans must and must not hold."""

from __future__ import annotations

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from phraseloom import LanguageTagger, PandasTagger, build_model
from phraseloom.operators import corpus, joins, model, phrases, ranking
from phraseloom.params import DEFAULTS
from phraseloom.plans import pipelines
from phraseloom.sources import tables


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def scan(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def model_plan(scan):
    return final_plan(build_model(scan.where("lang = 'en'")))


def test_model_reads_and_tokenizes_the_corpus_once(model_plan):
    assert model_plan.count("Scan parquet") == 1
    assert model_plan.count("regexp_extract_all") == 1
    assert "ReusedExchange" in model_plan


def test_model_pushes_filter_and_columns_to_the_scan(model_plan):
    assert "EqualTo(lang,en)" in model_plan
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string,lang:string>", model_plan)


def test_no_text_and_no_array_crosses_a_shuffle_of_the_model(scan):
    # every exchange sits above the generator that turns bags into rows
    plan = executed(build_model(scan)).splitlines()
    depth = {name: [len(l) - len(l.lstrip(" :+-*()0123456789")) for l in plan if name in l] for name in ("Exchange", "Generate")}
    assert min(depth["Generate"]) > min(depth["Exchange"])
    text_scan = next(i for i, l in enumerate(plan) if "Scan parquet" in l)
    generate = next(i for i, l in enumerate(plan) if "Generate" in l)
    assert not any("Exchange" in l for l in plan[generate:text_scan])


def test_corpus_scalars_are_broadcast_and_nothing_else_is_crossed(model_plan):
    assert "BroadcastNestedLoopJoin" in model_plan and "CartesianProduct" not in model_plan
    assert model_plan.count("BroadcastExchange") == 1


@pytest.mark.parametrize("name", ["phrase_model", "doc_keyphrases", "enriched_documents", "response_records"])
def test_default_path_has_no_python_node(spark, sf_dir, name):
    plan = executed(contract.queries()[name](spark, sf_dir))
    assert not re.search(r"EvalPython|MapInPandas|MapInArrow|PythonUDF", plan)


def test_python_tagger_runs_once_in_arrow_batches(scan):
    tagger = PandasTagger(lambda ts: ["NN"] * len(ts))
    plan = final_plan(build_model(scan, tagger))
    assert plan.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in plan


def test_counting_in_documents_needs_no_shuffle(scan):
    assert "Exchange" not in executed(phrases.doc_phrases(phrases.phrase_bags(scan)))
    assert "Exchange" not in executed(corpus.document_lengths(phrases.phrase_bags(scan)))


@pytest.mark.parametrize("id_type", ["bigint", "string"])
def test_aggregates_hash_whatever_the_id_is(scan, id_type):
    docs = scan.withColumn("doc_id", F.col("doc_id").cast(id_type))
    plan = executed(build_model(docs))
    assert "SortAggregate" not in plan and "ReusedExchange" in final_plan(build_model(docs))


def test_averaging_reuses_the_partitioning_by_phrase(model_plan):
    top = model_plan[: model_plan.index("BroadcastNestedLoopJoin")]
    assert top.count("HashAggregate") == 2 and "Exchange" not in top


@pytest.fixture()
def shuffled_joins(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def hot_rows(spark):
    ids = spark.range(0, 120_000, 1, 8)
    word = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("w"), F.hash("id")))
    return ids.select(F.col("id").alias("doc_id"), word.alias("phrase"))


def hot_model(spark, path):
    hot_rows(spark).select("phrase").distinct().withColumn("bm25", F.lit(6.0)).write.parquet(path)
    return tables.read_model(spark, path)


def test_a_phrase_in_a_third_of_all_rows_is_split(spark, shuffled_joins, tmp_path):
    rows, known = hot_rows(spark), hot_model(spark, str(tmp_path / "model"))
    assert "SortMergeJoin(skew=true)" in final_plan(ranking.document_matches(rows, known).agg(F.count("bm25")))
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        matches = ranking.document_matches(rows, known).withColumn("task", F.spark_partition_id())
        per_task = matches.where("phrase = 'hot'").groupBy("task").count()
        assert matches.count() == 120_000
        assert per_task.count() > 4 and per_task.agg(F.max("count")).first()[0] < 20_000
    finally:
        spark.conf.unset("spark.sql.adaptive.skewJoin.enabled")


@pytest.mark.parametrize("least", [1, 2])
def test_frequencies_of_a_phrase_in_a_third_of_all_rows_are_split(spark, shuffled_joins, least):
    rows = hot_rows(spark).withColumns({"tf": F.lit(1).cast("long"), "dl": F.lit(1).cast("long")})
    counts = corpus.phrase_counts(rows)
    p = replace(DEFAULTS, min_corpus_count=least)
    assert "SortMergeJoin(skew=true)" in final_plan(model.scoring_inputs(rows, counts, p).agg(F.count("cf")))
    if least == 2:  # the hot phrase alone remains, and is small
        return
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        inputs = model.scoring_inputs(rows, counts, p).withColumn("task", F.spark_partition_id())
        per_task = inputs.where("phrase = 'hot'").groupBy("task").count()
        assert per_task.agg(F.max("count")).first()[0] < 20_000
        assert inputs.where("phrase = 'hot' and cf = 40000").count() == 40_000
    finally:
        spark.conf.unset("spark.sql.adaptive.skewJoin.enabled")


def test_few_long_phrases_are_not_broadcast_by_their_number(spark, scan, tmp_path):
    # 120 phrases of 320,000 characters; as a file, above the default limit of 10 MB
    known = spark.range(120, numPartitions=1).select(
        F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(5000)), lambda i: F.sha2((F.col("id") * 5000 + i).cast("string").cast("binary"), 256))).alias("phrase"),
        F.lit(6.0).alias("bm25"),
    )
    known.write.parquet(str(tmp_path / "model"))
    rows = scan.select("doc_id", F.col("lang").alias("phrase"))
    plan = executed(ranking.document_matches(rows, tables.read_model(spark, str(tmp_path / "model"))))
    assert "BuildRight" not in plan and plan.count("Scan parquet") == 2


def test_ways_to_match_agree(spark, shuffled_joins, tmp_path):
    rows, known = hot_rows(spark), hot_model(spark, str(tmp_path / "model")).where("hash(phrase) % 5 < 2")
    plain = rows.join(known, "phrase").select("doc_id", "phrase", "bm25")
    for got in (ranking.document_matches(rows, known), joins.salted_join(rows, known, 3).select("doc_id", "phrase", "bm25")):
        assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0


@pytest.mark.parametrize("least", [1, 3, 6])
def test_any_minimum_count_reads_and_tokenizes_the_corpus_once(scan, least):
    plan = final_plan(build_model(scan.where("lang = 'en'"), p=replace(DEFAULTS, min_corpus_count=least)))
    assert plan.count("Scan parquet") == 1 and plan.count("regexp_extract_all") == 1
    assert "ReusedExchange" in plan


def test_all_languages_are_one_read(scan):
    plan = final_plan(build_model(scan, LanguageTagger()))
    assert plan.count("Scan parquet") == 1 and "ReusedExchange" in plan
    # one row per language is broadcast, and nothing is crossed
    assert plan.count("BroadcastExchange") == 1 and "NestedLoop" not in plan and "Cartesian" not in plan


def test_ranking_and_collecting_share_one_shuffle(scan):
    bags = phrases.phrase_bags(scan)
    known = scan.select(F.col("lang").alias("phrase"), F.lit(6.0).alias("bm25"))
    plan = executed(ranking.keyphrase_lists(pipelines.rank_bags(bags, known)))
    assert plan.count("Exchange hashpartitioning(doc_id") == 1


def test_documents_bucketed_by_id_are_not_shuffled_again(spark, scan, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS shelf LOCATION '{tmp_path}/shelf'")
    try:
        tables.write_bucketed(scan.select("doc_id", "text"), "shelf.docs", 8)
        docs = spark.table("shelf.docs")
        known = scan.select(F.col("lang").alias("phrase"), F.lit(6.0).alias("bm25"))
        plan = executed(pipelines.summarize(docs, known)).split("SortMergeJoin [doc_id")[1]
        left = plan[: plan.index("Exchange")]
        assert "Scan parquet spark_catalog.shelf.docs" in left
    finally:
        spark.sql("DROP DATABASE IF EXISTS shelf CASCADE")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tags_are_named_once_and_not_in_conditions(scan):
    # a tag that a filter computes again is code too long for the JVM to compile
    for tagger in (None, LanguageTagger()):
        plan = executed(phrases.content_tokens(phrases.tagged_tokens(scan, tagger)))
        assert not any("CASE WHEN" in l for l in plan.splitlines() if "Filter" in l)


def test_runs_of_token_rows_need_one_exchange_and_no_window(scan):
    tagger = LanguageTagger()
    plan = executed(phrases.phrase_runs(phrases.tagged_tokens(scan, tagger), tagger=tagger))
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan


def test_runs_count_the_tokens_that_close(spark):
    tagged = spark.createDataFrame(
        [(1, i, t, g) for i, (t, g) in enumerate([("Big", "JJ"), ("dogs", "NN"), (".", "."), ("the", "DT"), ("cat", "NN"), ("!", "."), ("end", "NN")])],
        "doc_id long, pos int, token string, tag string",
    )
    assert [tuple(r) for r in phrases.phrase_runs(tagged).orderBy("run").collect()] == [(1, 0, "big dog"), (1, 2, "cat")]
    flushed = phrases.phrase_runs(tagged, replace(DEFAULTS, flush_trailing=True)).orderBy("run").collect()
    assert [tuple(r) for r in flushed] == [(1, 0, "big dog"), (1, 2, "cat"), (1, 3, "end")]


def test_sorts_of_phrases_start_with_the_phrase(spark, scan, shuffled_joins, tmp_path):
    # the language tells few rows apart, and comparing first bytes of it decides nothing
    bags = phrases.phrase_bags(scan, LanguageTagger())
    known = model.phrase_model(phrases.doc_phrases(bags))
    assert re.findall(r"Sort \[(\w+)#", executed(known)) == ["phrase"] * 2
    tables.write_model(known, str(tmp_path / "model"))
    joined = joins.join_on_phrase(phrases.doc_phrases(bags), tables.read_model(spark, str(tmp_path / "model")))
    assert re.findall(r"Sort \[(\w+)#", executed(joined)) == ["phrase"] * 2
    assert joined.columns == ["lang", "phrase", "doc_id", "dl", "tf", "bm25"]


def test_no_token_is_matched_to_a_pattern_of_its_own(scan):
    plan = executed(scan.select(phrases.candidates(F.col("text"), LanguageTagger()).alias("x")))
    assert "RLIKE" not in plan and plan.count("regexp_extract_all") == 4
