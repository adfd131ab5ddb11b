from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from phraseloom.operators import corpus, model
from phraseloom.params import DEFAULTS
from tests import brute

FIXTURE = {
    "d1": {"alpha": 2, "beta": 1, "solo": 1},
    "d2": {"alpha": 1, "gamma": 3},
    "d3": {"beta": 1, "alpha": 4},
    "d4": {"once": 1},
    "d5": {"delta": 2, "beta": 1, "alpha": 3},
}


def frame(spark, bags):
    rows = [(d, sum(b.values()), p, tf) for d, b in bags.items() for p, tf in b.items()]
    return spark.createDataFrame(rows, "doc_id string, dl long, phrase string, tf long")


def by_pair(df):
    return {(r.doc_id, r.phrase): r.bm25 for r in df.collect()}


def close(a: dict, b: dict):
    assert a.keys() == b.keys()
    for k in a:
        assert (a[k] is None and b[k] is None) or a[k] == pytest.approx(b[k], abs=1e-9)


def test_fixture_has_the_worked_out_values(spark):
    p = replace(DEFAULTS, min_bm25=-10.0)
    dp = frame(spark, FIXTURE)
    counts = corpus.phrase_counts(dp)
    assert {r.phrase: r.cf for r in corpus.repeated_phrases(counts).collect()} == {
        "alpha": 10, "beta": 3, "gamma": 3, "delta": 2,
    }
    stats = corpus.corpus_stats(dp)
    assert tuple(stats.first()) == (4, 4.0)  # 4.5 rounds to even
    close(
        by_pair(model.doc_keyphrases(dp, counts, stats, p)),
        {
            ("d1", "beta"): -0.8472978603872037,
            ("d2", "gamma"): -1.3314680663227485,
            ("d3", "beta"): -0.7686825949904529,
            ("d5", "beta"): -0.7034170916422069,
            ("d5", "delta"): 0.0,
        },
    )
    expected = {"delta": 0.0, "beta": -0.7731325156732879, "gamma": -1.3314680663227485}
    close({r.phrase: r.bm25 for r in model.phrase_model(dp, p).collect()}, expected)
    scored = model.doc_keyphrases(dp, counts, stats, p)
    close({r.phrase: r.bm25 for r in scored.groupBy("phrase").agg(F.avg("bm25").alias("bm25")).where(F.col("bm25") >= p.min_bm25).collect()}, expected)


def test_scores_too_frequent_to_exist_are_null_and_never_pass(spark):
    dp = frame(spark, FIXTURE)
    counts, stats = corpus.phrase_counts(dp), corpus.corpus_stats(dp)
    all_scores = by_pair(model.bm25_scores(dp, counts, stats))
    close(all_scores, brute.scores(FIXTURE))
    assert [k for k, v in all_scores.items() if v is None] != []


def random_corpus(seed, docs=40, hot=True):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    bags = {}
    for d in range(docs):
        bag = {rng.choice(words): rng.randint(1, 3) for _ in range(rng.randint(1, 8))}
        if rng.random() < 0.3:
            bag[f"only{d}"] = 1
        if hot and d % 3 == 0:
            bag["everywhere"] = 2
        bags[f"d{d}"] = bag
    for d in range(docs, docs + docs // 2):  # a third of the corpus is one text
        bags[f"d{d}"] = {"copy": 1, "of": 2, "text": 1}
    bags["lonely"] = {"never again": 1}
    return bags


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("threshold", [-100.0, 0.0, 1.0, 5.0])
def test_model_of_random_corpora(spark, seed, threshold):
    bags = random_corpus(seed)
    p = replace(DEFAULTS, min_bm25=threshold)
    dp = frame(spark, bags)
    _, _, n, avgdl = brute.corpus(bags)
    assert tuple(corpus.corpus_stats(dp, p).first()) == (n, avgdl)
    close({r.phrase: r.bm25 for r in model.phrase_model(dp, p).collect()}, brute.model(bags, threshold))
    passed = {k: s for k, s in brute.scores(bags).items() if s is not None and s >= threshold}
    got = model.doc_keyphrases(dp, corpus.phrase_counts(dp), corpus.corpus_stats(dp), p)
    close(by_pair(got), passed)


@pytest.mark.parametrize("id_type", ["string", "bigint"])
@pytest.mark.parametrize("min_count", [1, 2, 3, 4, 7])
def test_any_minimum_count(spark, min_count, id_type):
    bags = random_corpus(9)
    p = replace(DEFAULTS, min_bm25=1.0, min_corpus_count=min_count)
    dp = frame(spark, bags)
    if id_type == "bigint":
        dp = dp.withColumn("doc_id", F.xxhash64("doc_id"))
    _, _, n, avgdl = brute.corpus(bags, min_count)
    assert tuple(corpus.corpus_stats(dp, p).first()) == (n, avgdl)
    close({r.phrase: r.bm25 for r in model.phrase_model(dp, p).collect()}, brute.model(bags, 1.0, min_count))


@pytest.mark.parametrize("min_count", [2, 3, 5])
def test_cells_keep_a_bounded_number_of_holders(spark, min_count):
    bags = {f"d{i}": {"copied": 1, "text": 1} for i in range(300)}
    profile = corpus.phrase_profile(frame(spark, bags), replace(DEFAULTS, min_corpus_count=min_count))
    assert profile.agg(F.max(F.size("holders"))).first()[0] <= min_count - 1


def test_frequency_join_gives_every_phrase_its_count(spark):
    bags = random_corpus(5)
    dp = frame(spark, bags)
    _, cf, _, _ = brute.corpus(bags)
    got = {(r.doc_id, r.phrase): r.cf for r in model.scoring_inputs(dp, corpus.phrase_counts(dp)).collect()}
    assert got == {(d, q): cf[q] for d, b in bags.items() for q in b if q in cf}


def test_copies_collapse_in_the_profile(spark):
    bags = {f"d{i}": {"copied": 2, "text": 1} for i in range(500)} | {"x": {"copied": 2, "text": 1, "more": 4}}
    assert corpus.phrase_profile(frame(spark, bags).withColumn("doc_id", F.hash("doc_id"))).count() == 5
    cells = {(r.phrase, r.tf, r.dl): (r.docs, r.cf) for r in corpus.phrase_profile(frame(spark, bags)).collect()}
    assert cells == {
        ("copied", 2, 3): (500, 1002), ("text", 1, 3): (500, 501),
        ("copied", 2, 7): (1, 1002), ("text", 1, 7): (1, 501), ("more", 4, 7): (1, 4),
    }


def test_empty_corpus_gives_an_empty_model(spark):
    dp = frame(spark, {"d": {"x": 1}}).where("false")
    assert model.phrase_model(dp).collect() == []
    assert corpus.corpus_stats(dp).first().n == 0
    # only singletons: nothing is left either
    assert model.phrase_model(frame(spark, {"d": {"x": 1}, "e": {"y": 1}})).collect() == []


def test_model_scores_reach_the_threshold(spark, sf_dir):
    from phraseloom import build_model

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en'")
    m = build_model(docs)
    assert m.count() > 0 and m.where("bm25 < 5.0").count() == 0
    again = build_model(docs.repartition(13))
    assert m.withColumn("bm25", F.round("bm25", 9)).exceptAll(again.withColumn("bm25", F.round("bm25", 9))).count() == 0
