"""Extractive summaries: the sentences that hold the best phrases.

A document meets its ranked phrases in one row, so scoring its sentences needs
no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phraseloom.functions.columns import fold, let
from phraseloom.functions.text import is_summary_sentence, sentences
from phraseloom.operators.ranking import rank_key
from phraseloom.params import DEFAULTS, Params


def no_phrases() -> Column:
    return F.expr("cast(array() as array<struct<phrase:string,bm25:double>>)")


def vocabulary(keyphrases: Column, p: Params = DEFAULTS) -> Column:
    """The phrases that add to sentence scores."""
    return F.slice(F.coalesce(keyphrases, no_phrases()), 1, p.vocabulary_size)


def sentence_total(sentence: Column, vocab: Column, p: Params = DEFAULTS) -> Column:
    """Scores of the contained phrases, added in rank order. Containment is by
    characters, not by words."""

    def total(lowered: Column) -> Column:
        return F.aggregate(
            F.filter(vocab, lambda v: F.contains(lowered, v["phrase"])), F.lit(0.0), lambda acc, v: acc + v["bm25"]
        )

    return F.when(is_summary_sentence(sentence, p.longer_than, p.min_words), let(fold(sentence), total)).otherwise(0.0)


def fallback(pieces: Column, p: Params = DEFAULTS) -> Column:
    """Without a scoring sentence: the first one repeated, or the first ones."""
    if p.fallback == "lead":
        return F.slice(pieces, 1, p.summary_sentences)
    repeated = F.array_repeat(F.get(pieces, F.lit(0)), F.least(F.lit(p.summary_sentences), F.size(pieces)))
    return F.when(pieces.isNotNull(), repeated)


def best_sentences(pieces: Column, vocab: Column, p: Params = DEFAULTS) -> Column:
    """array<int>: the best scoring sentences, back in text order."""
    scored = F.transform(pieces, lambda s, i: F.struct(sentence_total(s, vocab, p).alias("total"), i.alias("sentence")))
    hits = F.filter(scored, lambda m: m["total"] > 0)
    order = F.transform(
        hits, lambda m: F.struct((-rank_key(m["total"], p)).alias("worse"), m["sentence"].alias("sentence"))
    )
    best = F.slice(F.sort_array(order), 1, p.summary_sentences)
    return F.sort_array(F.transform(best, lambda m: m["sentence"]))


def summary(text: Column, vocab: Column, p: Params = DEFAULTS) -> Column:
    """array<string>: the best sentences in text order, as they stand. A
    document that matched nothing is not searched."""

    def pick(pieces: Column, v: Column) -> Column:
        chosen = F.when(F.size(v) > 0, best_sentences(pieces, v, p))
        return let(
            chosen,
            lambda at: F.when(F.size(at) > 0, F.transform(at, lambda i: F.get(pieces, i))).otherwise(
                fallback(pieces, p)
            ),
        )

    return let(vocab, lambda v: let(sentences(text), lambda pieces: pick(pieces, v)))


def with_vocabulary(docs: DataFrame, lists: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Documents, each with its vocabulary; empty where nothing matched."""
    return docs.join(lists, "doc_id", "left").withColumn("vocab", vocabulary(F.col("keyphrases"), p))


def document_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(id_col, F.posexplode(sentences(F.col(text_col))).alias("sentence", "piece"))


def sentence_hits(docs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(doc_id, sentence, phrase, bm25): every eligible sentence with every
    vocabulary phrase it contains. Expects the rows of ``with_vocabulary``."""
    eligible = (
        docs.where(F.size("vocab") > 0)
        .select("doc_id", "vocab", F.posexplode(sentences(F.col("text"))).alias("sentence", "piece"))
        .where(is_summary_sentence(F.col("piece"), p.longer_than, p.min_words))
    )
    return (
        eligible.select("doc_id", "sentence", fold(F.col("piece")).alias("lowered"), F.inline("vocab"))
        .where(F.contains("lowered", "phrase"))
        .select("doc_id", "sentence", "phrase", "bm25")
    )


def sentence_scores(docs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(doc_id, sentence, total) of the sentences that score."""
    totals = let(F.col("vocab"), lambda v: F.transform(sentences(F.col("text")), lambda s: sentence_total(s, v, p)))
    return (
        docs.where(F.size("vocab") > 0)
        .select("doc_id", F.posexplode_outer(totals).alias("sentence", "total"))
        .where(F.col("total") > 0)
    )


def document_summaries(docs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(doc_id, summary array<string>). Expects the rows of ``with_vocabulary``."""
    return docs.select("doc_id", summary(F.col("text"), F.col("vocab"), p).alias("summary"))
