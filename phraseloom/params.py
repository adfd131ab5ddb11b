"""Every constant that decides a result, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # scoring
    k1: float = 1.2
    b: float = 0.75
    min_bm25: float = 5.0
    min_corpus_count: int = 2
    # candidates
    min_token_length: int = 3
    flush_trailing: bool = False
    # corpus selection, where a sample is asked for
    max_documents: int = 100_000
    sample_seed: str = "phraseloom"
    # key phrases of a document
    max_keyphrases: int = 30
    # Averages over shuffled rows differ in their last bits between runs, so
    # ranks are taken on the score rounded to this many decimals.
    rank_decimals: int = 6
    # Where the session does not split skewed joins, a phrase is spread over
    # this many keys.
    salts: int = 32
    # summaries
    summary_sentences: int = 3
    summary_pool: int = 20
    summary_phrases: int = 10
    longer_than: int = 20
    min_words: int = 3
    fallback: str = "repeat"  # or "lead"

    def __post_init__(self) -> None:
        if self.fallback not in ("repeat", "lead"):
            raise ValueError(f"fallback must be 'repeat' or 'lead', not {self.fallback!r}")

    @property
    def vocabulary_size(self) -> int:
        """Phrases that take part in sentence scores: two nested cuts."""
        return min(self.summary_pool, self.summary_phrases)


DEFAULTS = Params()
