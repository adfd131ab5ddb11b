"""Session settings for a given input size."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

MB = 1024 * 1024
# Bytes written to the largest exchange of a model build per byte of compressed
# text: 13.3 to 15.3 MB for 8.9 MB, measured on the English test documents.
SHUFFLE_PER_INPUT_BYTE = 1.7
TARGET_PARTITION = 256 * MB
SCAN_SPLIT = 128 * MB


def settings(input_bytes: int, cores: int) -> dict[str, str]:
    """Scan splits of one size, and shuffle partitions of about
    ``TARGET_PARTITION`` however large the input is; adaptive execution merges
    the small ones and splits the skewed ones."""
    partitions = math.ceil(input_bytes * SHUFFLE_PER_INPUT_BYTE / TARGET_PARTITION)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(max(cores, partitions)),
        "spark.sql.files.maxPartitionBytes": str(SCAN_SPLIT),
        "spark.sql.session.timeZone": "UTC",
    }


def input_bytes(spark: SparkSession, path: str) -> int:
    """Bytes below a path, in any file system that Spark reads."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def apply(spark: SparkSession, input_bytes: int) -> SparkSession:
    for key, value in settings(input_bytes, spark.sparkContext.defaultParallelism).items():
        spark.conf.set(key, value)
    return spark
