"""Document phrases looked up in the model and ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phraseloom.operators.joins import join_on_phrase
from phraseloom.params import DEFAULTS, Params


def document_matches(phrases: DataFrame, model: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(doc_id, phrase, bm25) of the phrases that are in the model, a written
    table. New documents may share a phrase that was rare in its corpus."""
    return join_on_phrase(phrases, model, p).select("doc_id", "phrase", "bm25")


def rank_key(score: Column, p: Params = DEFAULTS) -> Column:
    return F.round(score, p.rank_decimals)


def document_keyphrases(matches: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(doc_id, rank, phrase, bm25): the best phrases of each document, by
    score, ties by phrase."""
    best_first = Window.partitionBy("doc_id").orderBy(rank_key(F.col("bm25"), p).desc(), "phrase")
    return (
        matches.withColumn("rank", F.row_number().over(best_first))
        .where(F.col("rank") <= p.max_keyphrases)
        .select("doc_id", "rank", "phrase", "bm25")
    )


def keyphrase_lists(keyphrases: DataFrame) -> DataFrame:
    """(doc_id, keyphrases array<struct<phrase,bm25>>) in rank order; at most
    ``max_keyphrases`` elements. Same partitioning as the ranking, no shuffle."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "phrase", "bm25")))
    return keyphrases.groupBy("doc_id").agg(
        F.transform(ranked, lambda x: F.struct(x["phrase"].alias("phrase"), x["bm25"].alias("bm25"))).alias(
            "keyphrases"
        )
    )


def phrase_names(keyphrases: Column) -> Column:
    return F.transform(keyphrases, lambda x: x["phrase"])
