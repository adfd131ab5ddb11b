"""Corpus-wide key phrases and extractive summaries on Spark."""

from phraseloom.operators.tagging import ContextTagger, LanguageTagger, PandasTagger, RuleTagger
from phraseloom.params import Params
from phraseloom.plans.pipelines import (
    analyze,
    analyze_records,
    build_model,
    enrich,
    extract_keyphrases,
    score_corpus,
    summarize,
)

__all__ = [
    "ContextTagger",
    "LanguageTagger",
    "PandasTagger",
    "Params",
    "RuleTagger",
    "analyze",
    "analyze_records",
    "build_model",
    "enrich",
    "extract_keyphrases",
    "score_corpus",
    "summarize",
]
