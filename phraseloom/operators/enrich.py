"""Search documents: terms and summary next to the content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phraseloom.functions.columns import base64_encode, basename, file_type
from phraseloom.operators.ranking import phrase_names
from phraseloom.operators.summary import no_phrases, summary
from phraseloom.params import DEFAULTS, Params


def enriched_documents(
    docs: DataFrame, p: Params = DEFAULTS, path_col: str = "file", created: Column | None = None
) -> DataFrame:
    """Rows of ``with_vocabulary`` that carry a file path, in the shape of the
    search index."""
    path = F.col(path_col)
    return docs.select(
        base64_encode(path).alias("id"),
        basename(path).alias("filename"),
        file_type(path).alias("filetype"),
        F.col("text").alias("content"),
        summary(F.col("text"), F.col("vocab"), p).alias("summary"),
        phrase_names(F.coalesce("keyphrases", no_phrases())).alias("terms"),
        (F.lit(None) if created is None else created).cast(T.TimestampType()).alias("creation_ts"),
    )


def term_facets(enriched: DataFrame) -> DataFrame:
    return enriched.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("docs"))


def facets(enriched: DataFrame, interval: str = "month", top: int = 10) -> DataFrame:
    """(field, value, docs, rank): the values of every facetable field that most
    documents have, ties by value. Times fall into intervals (``date_trunc``
    units), named by their first day. One read and one shuffle for all fields;
    a document without a value of a field is missing there."""
    day = F.date_format(F.date_trunc(interval, "creation_ts"), "yyyy-MM-dd")
    named = lambda field, value: F.struct(F.lit(field).alias("field"), value.alias("value"))
    each = F.concat(
        F.array(named("filetype", F.col("filetype")), named("creation_ts", day)),
        F.transform("terms", lambda t: named("terms", t)),
    )
    counted = enriched.select(F.inline(each)).where("value is not null").groupBy("field", "value")
    counted = counted.agg(F.count(F.lit(1)).alias("docs"))
    order = Window.partitionBy("field").orderBy(F.desc("docs"), "value")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def facet(enriched: DataFrame, field: str, *more: Column) -> DataFrame:
    """Documents per value of a field, with further aggregates if asked."""
    return enriched.groupBy(field).agg(F.count(F.lit(1)).alias("docs"), *more)
