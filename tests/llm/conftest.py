from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from phraseloom.llm.queries import reachable

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns
    that clash with names the operators use inside."""
    reachable(spark)

    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        docs = spark.createDataFrame(full, SCHEMA).repartition(3)
        for name in ("id", "row", "label", "kept", "n_words", "words", "items", "spans", "key", "host", "score", "base", "number"):
            docs = docs.withColumn(name, F.lit("clash"))
        return docs

    return build


@pytest.fixture(scope="session")
def hard(make):
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return make(
        [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "One"), (6, long), (7, long + " more"), (None, "one two"),
         (None, None), (8, "é\x00ü 🎉 " * 30), (9, "x" * 200_000), (10, "a b\n" * 300)]
    )
