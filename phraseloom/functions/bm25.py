"""The score of one phrase in one document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from phraseloom.params import DEFAULTS, Params


def rarity(n: Column, cf: Column) -> Column:
    """Logarithm of how much of the corpus lacks the phrase. ``cf`` counts
    occurrences, not documents, so the argument can be negative; the result is
    NULL there (NaN would pass a ``>=`` test)."""
    return F.when(n - cf + 0.5 > 0, F.ln((n - cf + 0.5) / (cf + 0.5)))


def bm25(n: Column, avgdl: Column, cf: Column, tf: Column, dl: Column, p: Params = DEFAULTS) -> Column:
    return rarity(n, cf) * (tf * (p.k1 + 1)) / (tf + p.k1 * (1 - p.b + (p.b * dl / avgdl)))


def can_reach(n: Column, cf: Column, threshold: float, p: Params = DEFAULTS) -> Column:
    """False only for phrases no document can lift to ``threshold``: the term
    frequency factor stays below k1 + 1. Drops the most frequent phrases of a
    corpus, which are the hot keys, before anything is joined."""
    if threshold <= 0 or not (p.k1 >= 0 and 0 <= p.b <= 1):
        return F.lit(True)
    return rarity(n, cf) * (p.k1 + 1) >= threshold * (1 - 1e-9)
