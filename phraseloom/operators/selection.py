"""Which documents enter a corpus, and over how many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phraseloom.functions.columns import let
from phraseloom.functions.patterns import BLANK
from phraseloom.params import DEFAULTS, Params


def sampled_documents(docs: DataFrame, p: Params = DEFAULTS, id_col: str = "doc_id") -> DataFrame:
    """Random sample of at most ``max_documents``: the ids with the smallest
    digests, the same on every run with the same seed.

    A top-k over all rows would send k rows from every task to one. Digests
    are uniform, so the k smallest of N lie below about k/N: rows above that
    bound plus ten standard deviations are dropped where they are read, and
    about k ids in all reach the last step. Texts follow by a join.
    """
    k = p.max_documents
    digest = F.md5(F.concat(F.lit(f"{p.sample_seed}:"), F.col(id_col).cast("string")))
    ids = docs.select(F.col(id_col), digest.alias("digest"))
    bound = docs.agg(((F.lit(k + 10 * k**0.5 + 100)) / F.count(F.lit(1))).alias("share"))
    head = F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") / float(2**32)
    chosen = ids.crossJoin(F.broadcast(bound)).where(head <= F.col("share")).orderBy("digest").limit(k)
    return docs.join(chosen.select(id_col), id_col, "left_semi")


def spread(scan: DataFrame) -> DataFrame:
    """Tokenizing is work for the CPU. Where a scan gives fewer tasks than
    there are cores (a small file, or one with few row groups), distribute its
    rows; a large table has more tasks than cores and stays as it is. For plain
    scans: asking a plan with a shuffle for its partitions would run it."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def split_rejects(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents with text, rows without any and the reason). A text that is
    an expression is evaluated once: its value and the verdict leave one
    generator, below which no filter can be pushed."""

    def verdict(text: Column) -> Column:
        reason = F.when(text.isNull(), "text is missing").when(~text.rlike(f"[^{BLANK}]"), "text is blank")
        return F.struct(text.alias(text_col), reason.alias("reason"))

    others = [c for c in docs.columns if c not in (text_col, "reason")]
    judged = docs.select(*others, F.inline(F.array(let(F.col(text_col), verdict))))
    judged = judged.select(*(c for c in docs.columns if c != "reason"), "reason")
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())
