"""Scores of (document, phrase) pairs and the model they average to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phraseloom.functions.bm25 import bm25, can_reach
from phraseloom.operators.corpus import join_frequencies, phrase_profile, repeated_phrases, stats_of_profile
from phraseloom.operators.joins import phrase_keys
from phraseloom.params import DEFAULTS, Params


def scoring_inputs(phrases: DataFrame, counts: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(doc_id, phrase, tf, cf, dl): document phrases with their corpus
    frequency. The document length already rides on the phrase row."""
    joined = join_frequencies(phrases, counts, lambda c: repeated_phrases(c, p), p)
    return joined.select("doc_id", *phrase_keys(joined), "tf", "cf", "dl")


def with_stats(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Rows with the scalars of their corpus: the one row of a global
    aggregate, or a row for each language that has a lexicon."""
    if "lang" in stats.columns:
        return rows.join(F.broadcast(stats), "lang")
    return rows.crossJoin(F.broadcast(stats))


def with_score(rows: DataFrame, stats: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    return with_stats(rows, stats).withColumn(
        "bm25", bm25(F.col("n"), F.col("avgdl"), F.col("cf"), F.col("tf"), F.col("dl"), p)
    )


def bm25_scores(phrases: DataFrame, counts: DataFrame, stats: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Every score, NULL where the phrase is too frequent to have one."""
    return with_score(scoring_inputs(phrases, counts, p), stats, p).select("doc_id", "phrase", "bm25")


def doc_keyphrases(phrases: DataFrame, counts: DataFrame, stats: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Scores that reach the threshold. Phrases that cannot reach it, the most
    frequent ones, leave the counts before the join."""

    def reachable(c: DataFrame) -> DataFrame:
        return with_stats(repeated_phrases(c, p), stats).where(can_reach(F.col("n"), F.col("cf"), p.min_bm25, p))

    rows = with_score(join_frequencies(phrases, counts, reachable, p), stats, p)
    return rows.where(F.col("bm25") >= p.min_bm25).select("doc_id", "phrase", "bm25")


def phrase_model(phrases: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """The model straight from the phrase profile: the mean per phrase of what
    ``doc_keyphrases`` gives, without a row per (document, phrase) after the
    first exchange."""
    return model_of_profile(phrase_profile(phrases, p), p)


def model_of_profile(profile: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """([lang,] phrase, bm25) of a profile, however it came about."""
    stats = stats_of_profile(profile, p)
    n, cf = F.col("n"), F.col("cf")
    scored = with_score(profile.where(cf >= p.min_corpus_count), stats, p).where(
        can_reach(n, cf, p.min_bm25, p) & (F.col("bm25") >= p.min_bm25)
    )
    mean = F.sum(F.col("bm25") * F.col("docs")) / F.sum("docs")
    return scored.groupBy(*phrase_keys(profile)).agg(mean.alias("bm25")).where(F.col("bm25") >= p.min_bm25)
