"""A reproducible shuffle into shards, by a Feistel permutation.

Rows are numbered from 0 in the order of their keys. A Feistel network, keyed
by a seed, permutes the smallest range of 4**k numbers that holds all rows;
where it leads outside the rows, it is applied again until it leads inside
(cycle walking), so the rows themselves are permuted. Row number r goes to
shard ``p(r) mod shards``, slot ``p(r) div shards``: both can be computed for
any r, and inverted, without the table. Shard counts are at most one apart.

Numbers need no sort of the table in one task: rows are counted per bucket of
hashed keys, the counts (one per bucket, some ``bucket_rows`` rows each) are
summed up, and a row's number is its bucket's offset plus its rank inside.

The key of a row is its id, its text's CRC-32 and its size. Equal rows are
interchangeable; they are counted first and get a run of numbers, so any number
of copies is one row until the last step. A null id sorts first, a null text is
empty with size 1. An empty table gives no rows. Columns other than id and text
are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phraseloom.staging import stage

ROUNDS = 6
SHARDS = 8
SEED = 20240607
BUCKET_ROWS = 50_000
RUN = 10_000


def half_bits(rows: int) -> int:
    """Bits of each half of the smallest even-sized range that holds ``rows``."""
    return max(1, -(-max(1, rows - 1).bit_length() // 2))


def _round_keys(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, ROUNDS, dtype=np.uint64)


def _scrambled(half: np.ndarray, key: np.uint64, mask: np.uint64) -> np.ndarray:
    h = half * np.uint64(0x9E3779B97F4A7C15) + key
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) & mask


def _network(x: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    mask = np.uint64((1 << bits) - 1)
    left, right = x >> np.uint64(bits), x & mask
    for key in keys:
        left, right = right, left ^ _scrambled(right, key, mask)
    return (right << np.uint64(bits)) | left


def permuted(numbers: np.ndarray, rows: int, seed: int = SEED, inverse: bool = False) -> np.ndarray:
    """Where each of ``numbers`` (0 to rows - 1) goes, or comes from."""
    x = np.asarray(numbers, dtype=np.uint64)
    bits, keys = half_bits(rows), _round_keys(seed)
    keys = keys[::-1] if inverse else keys
    x = _network(x, bits, keys)
    while (outside := np.flatnonzero(x >= np.uint64(rows))).size:
        x[outside] = _network(x[outside], bits, keys)
    return x.astype(np.int64)


def place(numbers: np.ndarray, rows: int, shards: int = SHARDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of row numbers."""
    to = permuted(numbers, rows, seed)
    return to % shards, to // shards


def number_of(shard: int, slot: int, rows: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number that stands in a slot."""
    return int(permuted(np.array([slot * shards + shard]), rows, seed, inverse=True)[0])


def numbered(keys: DataFrame, rows: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``keys`` (columns and ``copies``) with ``first``, the number of the
    first copy; numbers are gapless in order of bucket and columns."""
    columns = [c for c in keys.columns if c != "copies"]
    buckets = max(1, rows // bucket_rows)
    placed = stage(keys.withColumn("bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets))), "keys")
    counts = placed.groupBy("bucket").agg(F.sum("copies").alias("size"))
    # one row per bucket: some rows / bucket_rows
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("ahead", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    return ranked.join(stage(offsets, "offsets"), "bucket").select(
        *columns, "copies", (F.col("offset") + F.col("ahead")).alias("first")
    )


def _permutation(rows: int, seed: int):
    @F.pandas_udf("long")
    def to(numbers: pd.Series) -> pd.Series:
        return pd.Series(permuted(numbers.to_numpy(), rows, seed))

    return to


def sharded(
    docs: DataFrame,
    shards: int = SHARDS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row per document: id, ``size`` (bytes of UTF-8 plus 1), ``text_crc32``,
    ``number`` (before the shuffle), ``shard`` and ``slot``."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    keys = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    keys = stage(keys.groupBy("id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies")), "row-keys")
    rows = keys.agg(F.sum("copies")).first()[0] or 0
    first = numbered(keys, rows)
    # copies become rows in two steps, runs first
    steps = F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1, F.lit(RUN).cast("long"))
    runs = first.withColumn("run", F.explode(steps))
    last = F.least(F.col("run") + RUN, F.col("first") + F.col("copies")) - 1
    each = runs.withColumn("number", F.explode(F.sequence(F.col("run"), last)))
    to: Column = _permutation(max(1, rows), seed)(F.col("number"))
    moved = each.select("id", "size", "text_crc32", "number", to.alias("to"))
    return moved.select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        "number",
        F.pmod("to", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("to") / shards).cast("long").alias("slot"),
    )
