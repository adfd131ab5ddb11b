"""Corpora of several languages in one run."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from phraseloom import LanguageTagger, build_model, extract_keyphrases, summarize
from phraseloom.functions.lexicon import LEXICONS
from phraseloom.operators import corpus, model, phrases
from phraseloom.operators.tagging import RuleTagger
from phraseloom.params import DEFAULTS
from phraseloom.plans import pipelines
from phraseloom.sources import tables

P = replace(DEFAULTS, min_bm25=-50.0)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.withColumn("bm25", F.round("bm25", 9)).select(*columns, "bm25").collect())


def test_each_language_is_as_if_built_alone(docs):
    together = build_model(docs, LanguageTagger(), P)
    for lang, lexicon in LEXICONS.items():
        alone = build_model(docs.where(F.col("lang") == lang), RuleTagger(lexicon), P)
        assert rows(together.where(F.col("lang") == lang), "phrase") == rows(alone, "phrase") != []


def test_missing_and_unknown_languages_count_as_the_default(docs):
    unknown = F.when(F.col("doc_id") % 2 == 0, F.lit(None)).otherwise("xx")
    mixed = docs.withColumn("lang", F.when(F.col("lang") == "en", unknown).otherwise(F.col("lang")))
    assert rows(build_model(mixed, LanguageTagger(), P), "lang", "phrase") == rows(
        build_model(docs, LanguageTagger(), P), "lang", "phrase"
    )
    french = LanguageTagger(default="fr")
    got = build_model(docs.where("lang = 'fr'").withColumn("lang", F.lit(None).cast("string")), french, P)
    assert rows(got, "phrase") == rows(build_model(docs.where("lang = 'fr'"), RuleTagger(LEXICONS["fr"]), P), "phrase")


def test_the_same_word_is_another_phrase_in_another_language(spark):
    texts = [("en", "Gift shop. Gift card. "), ("de", "Gift Schlange. Gift Glas. ")]
    rows_ = [(2 * i + k, lang, text * (1 + i % 2)) for i in range(30) for k, (lang, text) in enumerate(texts)]
    found = spark.createDataFrame(rows_, "doc_id long, lang string, text string")
    counts = corpus.phrase_counts(phrases.doc_phrases(phrases.phrase_bags(found, LanguageTagger())))
    got = {(r.lang, r.phrase): r.cf for r in counts.collect()}
    assert got["en", "gift shop"] == got["de", "gift schlange"] == 45 and ("de", "gift shop") not in got


def test_scoring_uses_the_language_of_the_document(spark, docs, tmp_path):
    path = str(tmp_path / "model")
    tables.write_model(build_model(docs, LanguageTagger()), path)
    known = tables.read_model(spark, path)
    assert known.columns == ["lang", "phrase", "bm25"]
    ranked = extract_keyphrases(docs, known).join(docs, "doc_id").select("lang", "phrase", F.round("bm25", 9).alias("bm25"))
    assert ranked.count() > 0
    assert ranked.exceptAll(ranked.join(known.withColumn("bm25", F.round("bm25", 9)), ["lang", "phrase", "bm25"])).count() == 0
    # documents that name no language are of the default one
    plain = docs.where("lang = 'en'").drop("lang")
    assert extract_keyphrases(plain, known).exceptAll(extract_keyphrases(docs, known).join(plain.select("doc_id"), "doc_id", "left_semi")).count() == 0
    assert summarize(docs, known).count() == docs.count()


def test_phrases_without_a_language_do_not_meet_a_model_with_one(docs):
    known = build_model(docs, LanguageTagger())
    with pytest.raises(ValueError, match="LanguageTagger"):
        pipelines.rank_bags(phrases.phrase_bags(docs, RuleTagger()), known)


def test_tokens_runs_and_arrays_agree(docs):
    tagger = LanguageTagger()
    by_runs = phrases.phrase_runs(phrases.tagged_tokens(docs, tagger), tagger=tagger).select("doc_id", "phrase")
    by_arrays = phrases.candidate_phrases(docs, tagger).select("doc_id", "phrase")
    assert by_runs.count() > 0 and by_runs.exceptAll(by_arrays).count() == by_arrays.exceptAll(by_runs).count() == 0


def test_scalars_of_a_language_do_not_depend_on_the_others(spark):
    rng = random.Random(1)
    rows_ = []
    for d in range(60):
        bag = {rng.choice("abcdefgh"): rng.randint(1, 3) for _ in range(4)}
        rows_ += [(d, "en" if d % 3 else "fr", sum(bag.values()), p, tf) for p, tf in bag.items()]
    dp = spark.createDataFrame(rows_, "doc_id long, lang string, dl long, phrase string, tf long")
    together = {r.lang: (r.n, r.avgdl) for r in corpus.corpus_stats(dp).collect()}
    assert together == {lang: tuple(corpus.corpus_stats(dp.where(F.col("lang") == lang).drop("lang")).first()) for lang in ("en", "fr")}
    assert model.phrase_model(dp.where("false"), P).collect() == []
