"""Corpus-wide aggregates: frequencies, lengths, the two corpus scalars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.internal import InternalFunction

from phraseloom.operators.joins import join_on_phrase, phrase_keys
from phraseloom.params import DEFAULTS, Params
from phraseloom.staging import Workspace, stage


def document_lengths(bags: DataFrame) -> DataFrame:
    """(doc_id, dl) of documents with at least one candidate."""
    return bags.where(F.col("dl") > 0).select("doc_id", "dl")


def phrase_counts(phrases: DataFrame) -> DataFrame:
    """([lang,] phrase, cf): occurrences in the whole corpus, or in all
    documents of the language."""
    return phrases.groupBy(*phrase_keys(phrases)).agg(F.sum("tf").alias("cf"))


def repeated_phrases(counts: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    return counts.where(F.col("cf") >= p.min_corpus_count)


def join_frequencies(
    phrases: DataFrame,
    counts: DataFrame,
    keep: Callable[[DataFrame], DataFrame] = lambda c: c,
    p: Params = DEFAULTS,
    workspace: Workspace | None = None,
) -> DataFrame:
    """Document phrases with ``cf``, of the phrases ``keep`` leaves in the
    counts. The counts are written first, so that the join has no aggregate
    between its sorts and its exchanges and a hot phrase can be split."""
    kept = keep(stage(counts, "counts", workspace))
    return join_on_phrase(phrases, kept.select(*phrase_keys(kept), "cf"), p)


def drop_rare(phrases: DataFrame, counts: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Document phrases without those the corpus holds too few times."""
    return join_frequencies(phrases, counts, lambda c: repeated_phrases(c, p), p).drop("cf")


def holder_marks(phrases: DataFrame) -> dict[str, Column]:
    """Long columns that tell documents apart: the id itself, or a 128-bit
    digest of any other kind of id. Longs keep the aggregate that carries them
    a hash aggregate, and a path of some hundred bytes out of the shuffle."""
    if isinstance(phrases.schema["doc_id"].dataType, T.IntegralType):
        return {"holder": F.col("doc_id").cast("long")}
    return {"holder": F.xxhash64("doc_id"), "holder2": F.xxhash64(F.lit(1), "doc_id")}


def holder_aggregates(marks: dict[str, Column], most: int) -> dict[str, Column]:
    """Aggregates that name the documents of a cell, if there are at most
    ``most``. One document is the exclusive or of all marks of the cell, from
    which marks can also be taken out again; more are kept in a bounded heap.
    Whatever the cell holds, its state has a fixed size."""
    if most <= 1:
        return {name: F.bit_xor(mark) for name, mark in marks.items()}
    return {"holders": InternalFunction.collect_top_k(F.struct(*(m.alias(n) for n, m in marks.items())), most, False)}


def phrase_cells(phrases: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """([lang,] phrase, tf, dl, docs, holder.. or holders): documents per
    (phrase, tf, dl). A table of cells can be added to another."""
    found = holder_aggregates(holder_marks(phrases), p.min_corpus_count - 1)
    return phrases.groupBy(*phrase_keys(phrases), "tf", "dl").agg(
        F.count(F.lit(1)).alias("docs"), *[a.alias(name) for name, a in found.items()]
    )


def merged_cells(cells: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """One cell for all that have the same key. Where at most
    ``min_corpus_count - 1`` documents remain, none of the merged lists was cut,
    so the merged list names them all."""
    keys = [*phrase_keys(cells), "tf", "dl"]
    docs = F.sum("docs").alias("docs")
    if "holders" in cells.columns:
        heap = InternalFunction.collect_top_k(F.col("h"), max(p.min_corpus_count - 1, 1), False).alias("holders")
        rows = cells.select(*keys, "docs", F.posexplode("holders").alias("i", "h"))
        rows = rows.withColumn("docs", F.when(F.col("i") == 0, F.col("docs")).otherwise(0))
        return rows.groupBy(*keys).agg(docs, heap)
    if p.min_corpus_count > 2:
        raise ValueError("the cells name one document each, too few for this minimum count")
    marks = [c for c in cells.columns if c.startswith("holder")]
    return cells.groupBy(*keys).agg(docs, *(F.bit_xor(m).alias(m) for m in marks)).where("docs <> 0")


def withdrawn_cells(cells: DataFrame) -> DataFrame:
    """What to add to cells to take the documents of ``cells`` out of them."""
    if "holders" in cells.columns:
        raise ValueError("documents can be withdrawn for a minimum count of 2 or less")
    return cells.withColumn("docs", -F.col("docs"))


def profile_of_cells(cells: DataFrame) -> DataFrame:
    """([lang,] phrase, tf, dl, docs, holders, cf), partitioned by phrase."""
    keys = phrase_keys(cells)
    # Rows are sorted by the phrase first: a sort compares the first bytes of
    # its first key in place, and by those of a language nothing is decided.
    whole_phrase = Window.partitionBy(*reversed(keys))
    profile = cells.repartition(*keys).withColumn("cf", F.sum(F.col("tf") * F.col("docs")).over(whole_phrase))
    # Reading the marks everywhere gives every reader of the profile the same
    # columns, which lets Spark reuse the exchange: the corpus is read and
    # counted once per query.
    marks = [c for c in cells.columns if c.startswith("holder")]
    for name in marks:
        profile = profile.where(F.size(name) > 0 if name == "holders" else F.col(name).isNotNull())
    holders = F.col("holders") if marks == ["holders"] else F.array(F.struct(*marks))
    return profile.select(*keys, "tf", "dl", "docs", holders.alias("holders"), "cf")


def phrase_profile(phrases: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """([lang,] phrase, tf, dl, docs, holders, cf), partitioned by phrase.

    A score depends on a document only through (tf, dl). Counting the documents
    per (phrase, tf, dl) before anything is grouped by phrase alone turns a
    phrase that a third of the corpus holds, or a text copied many times, into
    as many rows as it has distinct pairs, so no phrase is a hot key.
    ``holders`` marks documents of the cell: all of them where the corpus holds
    the phrase less than ``min_corpus_count`` times, as it then has fewer
    documents than that.
    """
    return profile_of_cells(phrase_cells(phrases, p))


def stats_of_profile(profile: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """([lang,] n, avgdl) without going back to the documents.

    Documents of length L hold L occurrences each, so the occurrences found in
    rows of that length, divided by L, count them. A phrase below the minimum
    count costs its holders their occurrences of it; holders left with none
    drop out of n.
    """
    lang = [k for k in phrase_keys(profile) if k != "phrase"]
    lost = F.col("cf") < p.min_corpus_count
    nobody = F.array(F.lit(None).cast(profile.schema["holders"].dataType.elementType))
    rows = profile.select(
        *lang,
        "dl",
        F.when(lost, F.col("tf")).otherwise(F.col("tf") * F.col("docs")).alias("occurrences"),
        F.explode(F.when(lost, F.col("holders")).otherwise(nobody)).alias("loser"),
    )
    marks = profile.schema["holders"].dataType.elementType.names
    by_holder = rows.groupBy(*lang, "dl", *(F.col("loser")[m].alias(m) for m in marks))
    by_holder = by_holder.agg(F.sum("occurrences").alias("occurrences"))
    lost = F.col(marks[0]).isNotNull()
    by_length = by_holder.groupBy(*lang, "dl").agg(
        F.expr("sum(occurrences) div dl").alias("docs"),
        F.sum(F.when(~lost, F.col("occurrences")).otherwise(0)).alias("kept"),
        F.sum(F.when(lost & (F.col("occurrences") == F.col("dl")), 1).otherwise(0)).alias("emptied"),
    )
    n = F.coalesce(F.sum(F.col("docs") - F.col("emptied")), F.lit(0))
    return by_length.groupBy(*lang).agg(n.alias("n"), F.bround(F.try_divide(F.sum("kept"), n), 0).alias("avgdl"))


def corpus_stats(phrases: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """One row, or one per language: documents that still hold a phrase after
    phrases below the minimum count are dropped, and their mean length, rounded
    half to even."""
    return stats_of_profile(phrase_profile(phrases, p), p)
