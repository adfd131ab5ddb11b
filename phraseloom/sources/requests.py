"""Request bodies in, response bodies out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_requests(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(request_id, body): one file is one request."""
    return _as_bodies(spark.read.option("pathGlobFilter", glob).text(path, wholetext=True))


def stream_requests(spark: SparkSession, path: str, glob: str = "*.json", files_per_batch: int = 1000) -> DataFrame:
    """The same, as files arrive."""
    return _as_bodies(
        spark.readStream.format("text")
        .option("wholetext", "true")
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )


def _as_bodies(files: DataFrame) -> DataFrame:
    return files.select(F.col("_metadata.file_path").alias("request_id"), F.col("value").alias("body"))


def write_responses(answers: DataFrame, path: str) -> None:
    """One JSON answer per line."""
    answers.select(F.col("body").alias("value")).write.mode("overwrite").text(path)


def write_response_records(records: DataFrame, path: str) -> None:
    """One response record per line, for outputs too large for one envelope."""
    records.select("record.*").write.mode("overwrite").json(path)
