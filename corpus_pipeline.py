"""A corpus pipeline of five stages over the documents table.

Each stage takes the documents that the one before it kept, and its decisions
take effect: quality rules remove documents and frequent lines, of near
duplicates one stays, contaminated documents go, secrets are replaced, and
what remains is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phraseloom.llm import bpe, decontaminate, neardup, quality, secrets
from phraseloom.llm.queries import reachable, table, tokenizer_path
from phraseloom.staging import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reachable(spark)
    return quality.cleaned(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8: one document of each group stays."""
    reachable(spark)
    return neardup.deduplicated(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs.select(*COLUMNS))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of ids and decoded text, and the ids themselves."""
    reachable(spark)
    found = bpe.encoded(docs, tokenizer_path())
    return bpe.digests(found, "doc_id", keep_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("BPE encoding", bpe_encoding),
]

# The secret models and the encoding are beyond SQL; tests compare the stages
# with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
