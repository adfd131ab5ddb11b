"""The registered queries of the training-data operators: (spark, sf_dir) to a
DataFrame over whole tables, by the operators' production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseloom.llm import (
    alignment,
    bpe,
    collocations,
    decontaminate,
    fingerprints,
    licenses,
    neardup,
    quality,
    secrets,
    sharding,
    toxicity,
    urlfilter,
    warc,
)
from phraseloom.staging import stage

Query = Callable[[SparkSession, str], DataFrame]
ROOT = str(Path(__file__).resolve().parents[2])


# Rows and bytes that go to a Python worker at once: texts may be long, and the
# buffers of a batch exist several times, in the JVM and in the worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def reachable(spark: SparkSession) -> None:
    """Lets Python workers started by a local session import this package from
    where the driver did; a cluster has it installed. Batches are kept small."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, paths]))
    for key, value in BATCH.items():
        spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def license_paths(docs: DataFrame) -> DataFrame:
    """The documents as files of a tree: per source, directories of 1,000 ids
    and in them of 50; the first of each 50 is the LICENSE of the lowest
    directory, the second one of the directory above, the third one of the
    source's."""
    turn = F.pmod("doc_id", F.lit(50))
    low = F.col("doc_id") - turn
    high = (low - F.pmod(low, F.lit(1000))).cast("string")
    more = F.concat(F.lit("LICENSE."), "doc_id")
    name = F.when(turn == 0, "LICENSE").otherwise(F.concat("doc_id", F.lit(".txt")))
    path = (
        F.when(turn == 1, F.concat_ws("/", "source", high, more))
        .when(turn == 2, F.concat_ws("/", "source", more))
        .otherwise(F.concat_ws("/", "source", high, low.cast("string"), name))
    )
    return docs.select("doc_id", path.alias("path"), "text")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.licensed(license_paths(table(spark, sf_dir, "documents")), keep=("doc_id",))
    return found.withColumn("own_score", F.round("own_score", 6))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("base")
    return found.select(
        "doc_id",
        secrets.count_of(base, 0).alias("n_assign"),
        secrets.count_of(base, 1).alias("n_access"),
        secrets.count_of(base, 2).alias("n_hex"),
        F.sha2(secrets.span_text(base), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encoded(table(spark, sf_dir, "documents"), tokenizer_path()))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), neardup.MinHash(shingle=2))
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.sharded(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages")).drop("score")


def op10_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    found = alignment.aligned(table(spark, sf_dir, "documents"), *paths)
    digest = F.coalesce(F.sha2("groups", 256), F.lit("")).alias("groups_sha256")
    found = stage(found.select("*", digest).drop("groups"), "aligned")
    return alignment.scored(found).withColumnRenamed("id", "doc_id")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda: [F.sha2("edited", 256).alias("edited_sha256")]
    docs = table(spark, sf_dir, "documents")
    found = fingerprints.compared(docs, keep=digest)
    return fingerprints.with_classes(found, fingerprints.linked(found, docs)).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Query]:
    own = [
        op1_quality_rules,
        op2_license_scan,
        op3_secret_scan,
        op4_decontamination,
        op5_toxicity,
        op6_bpe_encoding,
        op7_near_duplicates,
        op8_sharding,
        op9_url_filter,
        op10_warc_archives,
        op11_token_alignment,
        op12_collocations,
        op13_fingerprints,
    ]
    return {f.__name__: f for f in own}
