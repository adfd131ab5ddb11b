"""Written intermediate tables.

A result that several later stages read (the phrase bags of a corpus, the
published model) is written once as Parquet in the folder the session names in
``spark.checkpoint.dir``. The rest of the job reads the columns it needs from
there: lineage ends at the table, nothing is tokenized twice, and a lost
executor costs only the tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def staging_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError(
                f"{CHECKPOINT_CONF} is not set; on a cluster it must name a folder "
                "that every executor can reach"
            )
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="phraseloom-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{staging_dir(spark)}/phraseloom/{name}-{uuid.uuid4().hex}"


class Workspace:
    """Written tables of one job. Results are lazy and read them, so they stay
    until ``close``; use it as a context manager where the result is written
    inside the block."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a DataFrame over the written table."""
        path = scratch_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        sc = self.spark.sparkContext
        while self.paths:
            path = sc._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *exc) -> None:
        self.close()


def stage(df: DataFrame, name: str, workspace: Workspace | None = None) -> DataFrame:
    return (workspace or Workspace(df.sparkSession)).stage(df, name)
