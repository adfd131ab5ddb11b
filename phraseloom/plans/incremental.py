"""A model that grows with its corpus.

What a model needs of a document is its phrase cells. They are kept as a table
of segments, a folder each: one per batch of documents that came, and one per
batch that was withdrawn, whose counts are negative. Corpus scalars and model
are derived from the merged cells, so no text of an earlier batch is read
again. A segment is written as a whole under its name; writing it once more,
after a failure, replaces it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phraseloom.operators.corpus import merged_cells, phrase_cells, profile_of_cells, withdrawn_cells
from phraseloom.operators.model import model_of_profile
from phraseloom.operators.phrases import doc_phrases
from phraseloom.operators.tagging import Tagger
from phraseloom.params import DEFAULTS, Params
from phraseloom.plans.pipelines import corpus_bags


def document_cells(
    docs: DataFrame, tagger: Tagger | None = None, p: Params = DEFAULTS, title_col: str | None = None
) -> DataFrame:
    return phrase_cells(doc_phrases(corpus_bags(docs, tagger, p, title_col)), p)


def write_segment(cells: DataFrame, path: str, segment: str) -> None:
    cells.write.mode("overwrite").parquet(f"{path.rstrip('/')}/segment={segment}")


def add_documents(
    docs: DataFrame,
    path: str,
    segment: str,
    tagger: Tagger | None = None,
    p: Params = DEFAULTS,
    title_col: str | None = None,
) -> None:
    """Documents that are not in the corpus yet."""
    write_segment(document_cells(docs, tagger, p, title_col), path, segment)


def withdraw_documents(
    docs: DataFrame,
    path: str,
    segment: str,
    tagger: Tagger | None = None,
    p: Params = DEFAULTS,
    title_col: str | None = None,
) -> None:
    """Documents that are in the corpus, as they were when they came; for a
    minimum count of 2 or less."""
    write_segment(withdrawn_cells(document_cells(docs, tagger, p, title_col)), path, segment)


def read_cells(spark: SparkSession, path: str, p: Params = DEFAULTS) -> DataFrame:
    return merged_cells(spark.read.parquet(path).drop("segment"), p)


def compact(spark: SparkSession, path: str, into: str, p: Params = DEFAULTS) -> None:
    """All segments as one, in another table."""
    write_segment(read_cells(spark, path, p), into, "merged")


def grown_model(spark: SparkSession, path: str, p: Params = DEFAULTS) -> DataFrame:
    """([lang,] phrase, bm25) of the documents that came and were not
    withdrawn: what a build over them gives."""
    return model_of_profile(profile_of_cells(read_cells(spark, path, p)), p)
