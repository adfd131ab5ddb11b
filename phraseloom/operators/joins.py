"""Joins on a phrase, of which any may be in a third of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseloom.params import DEFAULTS, Params


def phrase_keys(df: DataFrame) -> list[str]:
    """What tells phrases apart: the language too, where rows have one."""
    return [c for c in ("lang", "phrase") if c in df.columns]


def splits_skew(spark: SparkSession) -> bool:
    settings = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")
    return all(spark.conf.get(s) == "true" for s in settings)


def salted_join(rows: DataFrame, table: DataFrame, salts: int) -> DataFrame:
    """Every phrase is spread over ``salts`` keys by document, and ``table`` is
    repeated for each."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    repeated = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return salted.join(repeated, [*phrase_keys(table), "salt"]).drop("salt")


def join_on_phrase(rows: DataFrame, table: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Rows of documents with the columns of ``table``, a written table of one
    row per phrase. Both sides come straight from an exchange, so adaptive
    execution splits the partition of a hot phrase; without that the phrases
    are salted. No side is broadcast but by the session's own byte limit, which
    is held against the size of the table's files. A table with languages
    needs rows with languages; one without serves rows of any."""
    if "lang" in table.columns and "lang" not in rows.columns:
        raise ValueError("the table is kept per language, and the rows have none: extract them with a LanguageTagger")
    if splits_skew(rows.sparkSession):
        # the phrase first, as first bytes decide most comparisons of a sort
        keys = phrase_keys(table)
        return rows.join(table, keys[::-1]).select(*keys, *(c for c in [*rows.columns, *table.columns] if c not in keys))
    return salted_join(rows, table, p.salts)
