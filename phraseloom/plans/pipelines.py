"""The jobs a user calls: build, extract, summarize, analyze, enrich.

Inputs are DataFrames of documents with a unique ``doc_id`` and a ``text``;
outputs are lazy DataFrames. A ``model`` to score with is a written table
(``read_model``). What several stages read is written once; pass a
``workspace`` to have those tables removed when the job is over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phraseloom.operators.corpus import corpus_stats, phrase_counts
from phraseloom.operators.enrich import enriched_documents
from phraseloom.operators.model import doc_keyphrases, phrase_model
from phraseloom.operators.phrases import doc_phrases, phrase_bags, text_bags
from phraseloom.operators.ranking import document_keyphrases, document_matches, keyphrase_lists
from phraseloom.operators.records import (
    NO_PHRASE,
    empty_of,
    record_key,
    records_of,
    rejects_of,
    request_rows,
    response_record,
    responses,
)
from phraseloom.operators.selection import sampled_documents, split_rejects
from phraseloom.operators.summary import document_summaries, summary, vocabulary, with_vocabulary
from phraseloom.operators.tagging import LanguageTagger, Tagger
from phraseloom.params import DEFAULTS, Params
from phraseloom.staging import Workspace, stage


def corpus_bags(
    docs: DataFrame, tagger: Tagger | None = None, p: Params = DEFAULTS, title_col: str | None = None
) -> DataFrame:
    """Phrase bags of the documents; a row without text has no phrases."""
    return phrase_bags(docs, tagger, p, title_col=title_col)


def build_model(
    docs: DataFrame,
    tagger: Tagger | None = None,
    p: Params = DEFAULTS,
    title_col: str | None = None,
    sample: bool = False,
) -> DataFrame:
    """([lang,] phrase, bm25). ``sample`` restricts the corpus to
    ``max_documents``. With a ``LanguageTagger`` the model is one of all
    languages, each scored by its own documents. The corpus is read once."""
    corpus = sampled_documents(docs, p) if sample else docs
    return phrase_model(doc_phrases(corpus_bags(corpus, tagger, p, title_col)), p)


def tagger_for(docs: DataFrame, model: DataFrame, tagger: Tagger | None) -> Tagger | None:
    """A model of languages needs phrases of languages: those of the column
    ``lang``, or without one all of the default language."""
    if tagger is None and "lang" in model.columns:
        return LanguageTagger("lang" if "lang" in docs.columns else None)
    return tagger


def score_corpus(
    docs: DataFrame,
    tagger: Tagger | None = None,
    p: Params = DEFAULTS,
    title_col: str | None = None,
    workspace: Workspace | None = None,
) -> DataFrame:
    """(doc_id, phrase, bm25) of every document phrase that passes, before the
    average. Three passes read the phrases, so they are written first."""
    phrases = doc_phrases(stage(corpus_bags(docs, tagger, p, title_col), "bags", workspace))
    return doc_keyphrases(phrases, phrase_counts(phrases), corpus_stats(phrases, p), p)


def rank_bags(bags: DataFrame, model: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Ranked phrases of the texts; titles count in a corpus only."""
    return document_keyphrases(document_matches(doc_phrases(text_bags(bags)), model, p), p)


def extract_keyphrases(
    docs: DataFrame, model: DataFrame, tagger: Tagger | None = None, p: Params = DEFAULTS
) -> DataFrame:
    """(doc_id, rank, phrase, bm25): up to ``max_keyphrases`` per document."""
    return rank_bags(corpus_bags(docs, tagger_for(docs, model, tagger), p), model, p)


def ranked_documents(
    docs: DataFrame,
    model: DataFrame,
    tagger: Tagger | None = None,
    p: Params = DEFAULTS,
    bags: DataFrame | None = None,
) -> DataFrame:
    """Documents with ``keyphrases`` and ``vocab``, all documents kept."""
    bags = corpus_bags(docs, tagger_for(docs, model, tagger), p) if bags is None else bags
    return with_vocabulary(docs, keyphrase_lists(rank_bags(bags, model, p)), p)


def summarize(
    docs: DataFrame,
    model: DataFrame,
    tagger: Tagger | None = None,
    p: Params = DEFAULTS,
    bags: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, summary)."""
    return document_summaries(ranked_documents(docs, model, tagger, p, bags), p)


def answered_records(
    rows: DataFrame,
    model: DataFrame,
    tagger: Tagger | None = None,
    p: Params = DEFAULTS,
    workspace: Workspace | None = None,
) -> DataFrame:
    """(request_id, pos, record struct) of ``rows``, a written table that
    ``request_rows`` made."""
    records = records_of(rows).withColumn("doc_id", record_key())
    asked = records.where(F.col("problem").isNull()).select("doc_id", F.col("content").alias("text"))
    # Kept as one table: its lengths tell which records hold no phrase at all.
    bags = stage(phrase_bags(asked, tagger_for(asked, model, tagger), p), "bags", workspace)
    lists = keyphrase_lists(rank_bags(bags, model, p))
    found = bags.select("doc_id", "dl").join(lists, "doc_id", "left")
    problem = F.coalesce(F.col("problem"), F.when(F.col("dl") == 0, NO_PHRASE))
    answered = records.join(found, "doc_id", "left").withColumn("problem", problem)
    keyphrases = F.col("keyphrases")
    picked = summary(F.col("content"), vocabulary(keyphrases, p), p)
    return answered.select("request_id", "pos", response_record(F.col("problem"), keyphrases, picked).alias("record"))


def analyze_records(
    bodies: DataFrame,
    model: DataFrame,
    tagger: Tagger | None = None,
    p: Params = DEFAULTS,
    workspace: Workspace | None = None,
) -> DataFrame:
    """(request_id, pos, record struct): an answer for every record of every
    request, errors included."""
    rows = stage(request_rows(bodies), "requests", workspace)
    return answered_records(rows, model, tagger, p, workspace)


def analyze_with_rejects(
    bodies: DataFrame,
    model: DataFrame,
    tagger: Tagger | None = None,
    p: Params = DEFAULTS,
    workspace: Workspace | None = None,
) -> tuple[DataFrame, DataFrame]:
    """((request_id, body) answers, (request_id, corrupt_body) rejects): the
    JSON answer to every parseable request, also to one without records, and
    the others. Each body is parsed once, when its records are written."""
    rows = stage(request_rows(bodies), "requests", workspace)
    return responses(answered_records(rows, model, tagger, p, workspace), empty_of(rows)), rejects_of(rows)


def analyze(
    bodies: DataFrame,
    model: DataFrame,
    tagger: Tagger | None = None,
    p: Params = DEFAULTS,
    workspace: Workspace | None = None,
) -> DataFrame:
    return analyze_with_rejects(bodies, model, tagger, p, workspace)[0]


def enrich(
    docs: DataFrame,
    tagger: Tagger | None = None,
    p: Params = DEFAULTS,
    path_col: str = "file",
    created: Column | None = None,
    model: DataFrame | None = None,
    workspace: Workspace | None = None,
) -> DataFrame:
    """Search documents of a corpus, scored against ``model`` or against the
    model of the corpus itself, which counts file names as titles. Phrases are
    extracted once for both uses. Rows without a text are ``split_rejects``."""
    docs, _ = split_rejects(docs)
    tagger = tagger if model is None else tagger_for(docs, model, tagger)
    bags = stage(corpus_bags(docs, tagger, p, None if model is not None else path_col), "bags", workspace)
    if model is None:
        model = stage(phrase_model(doc_phrases(bags), p), "model", workspace)
    return enriched_documents(ranked_documents(docs, model, tagger, p, bags), p, path_col, created)
