"""Delimited phrase files, the phrase table and the model table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phraseloom.operators.joins import phrase_keys


def write_delimited(phrases: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``file TAB phrase TAB count`` lines, one file per task, no quoting."""
    phrases.select(
        F.concat_ws("\t", F.col("file").cast("string"), "phrase", F.col("tf").cast("string")).alias("value")
    ).write.mode(mode).text(path)


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """(file, phrase, tf) of the lines that have exactly three fields."""
    fields = spark.read.text(path).select(F.split("value", "\t", -1).alias("f")).where(F.size("f") == 3)
    return fields.select(
        F.get("f", F.lit(0)).alias("file"),
        F.get("f", F.lit(1)).alias("phrase"),
        F.get("f", F.lit(2)).try_cast("long").alias("tf"),
    )


def phrases_of_files(counts: DataFrame) -> DataFrame:
    """(doc_id, dl, phrase, tf) of what phrase files hold, to build a model
    from: a phrase that a file names twice is counted together, lines without
    a count are skipped."""
    summed = counts.where(F.col("tf") > 0).groupBy(F.col("file").alias("doc_id"), "phrase").agg(F.sum("tf").alias("tf"))
    return summed.withColumn("dl", F.sum("tf").over(Window.partitionBy("doc_id"))).select("doc_id", "dl", "phrase", "tf")


def append_phrases(phrases: DataFrame, path: str) -> None:
    phrases.write.mode("append").parquet(path)


def write_model(model: DataFrame, path: str) -> None:
    """Full rebuild. The model leaves its last aggregate hashed by phrase, so
    sorting inside the partitions is all that is left to do; sorted files let a
    reader skip row groups when it looks for few phrases."""
    keys = phrase_keys(model)
    model.select(*keys, "bm25").sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """(phrase, bm25), with ``lang`` where the model is kept per language."""
    model = spark.read.parquet(path)
    return model.select(*phrase_keys(model), "bm25")


def write_enriched(enriched: DataFrame, path: str) -> None:
    """A folder per file type. An empty one would be read back as NULL, so it
    is written as ``none``."""
    kind = F.when(F.col("filetype") == "", "none").otherwise(F.col("filetype"))
    enriched.withColumn("filetype", kind).write.mode("overwrite").partitionBy("filetype").parquet(path)


def write_bucketed(docs: DataFrame, table: str, buckets: int, id_col: str = "doc_id") -> None:
    """Documents stored by id. Joining a summary's key phrases back to the text
    then moves the key phrases only; from a plain table the text moves once."""
    docs.write.mode("overwrite").bucketBy(buckets, id_col).sortBy(id_col).saveAsTable(table)
