"""Quality rules: lines that too many documents of a host share.

Each line is normalised (A-Z to a-z, white space to one blank, digits to 0)
and hashed; per host, the distinct documents of each line are counted. A line
in more documents than the limit is removed wherever it stands but in the
document of the smallest id, so that one copy of what is shared remains. The
limit is a count and does not grow with the host; hosts with few distinct texts
are guarded by a share as well. A document of which
too few words remain is depleted and rejected, as is one that fails the base
rules.

Two documents with equal texts are one document for the count: copies are for
the near-duplicate operator, and must not make each other's lines frequent.

A null text is empty, a null host is the host ''. Repeated rows each get their
own row; an empty table gives no rows. Columns other than the three named are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phraseloom.llm import textblocks as tb
from phraseloom.staging import stage


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    # A line is removed if more than this many documents of its host have it;
    # where the host has fewer distinct texts than ``small_host``, also more
    # than this share of them must.
    line_documents: int = 10
    line_share: float = 0.1
    small_host: int = 100
    # A document is depleted if fewer than this share of its words remain.
    min_remaining: float = 0.3


DEFAULTS = QualityRules()
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
LINES = "array<struct<line:long,words:int>>"


def _line_edges(texts: tb.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of every line."""
    data, offsets = texts
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    end = np.sort(np.concatenate([offsets[1:], breaks]))
    count = 1 + np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1])
    return np.repeat(np.arange(len(count)), count), start, end


def _measure(texts: tb.Texts) -> tuple[list[np.ndarray], pa.Array]:
    """(the five counts, the distinct normalised lines) of each text."""
    data, offsets = texts
    n = len(offsets) - 1
    words = tb.find_words(texts, tb.SPACED)
    n_words = np.diff(words.bounds)
    head = (data & 0xC0) != 0x80  # first byte of a character
    word_chars = tb.per_text(head & tb.SPACED.word[data], offsets)
    n_symbols = tb.per_text(SYMBOLS[data], offsets)

    at, h = tb.windows(words, 3)
    key = tb.mix(h + words.text_of()[at].astype(tb.U64) * tb.U64(tb.BASE))
    _, which, count = np.unique(key, return_inverse=True, return_counts=True)
    covered = np.zeros(len(words.hash), dtype=bool)
    for i in range(3):
        covered[at[count[which] > 1] + i] = True
    n_repeat = tb.per_text(covered, words.bounds)

    text, start, end = _line_edges(texts)
    first, last = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
    has = last > first
    text, start, end, first, last = text[has], start[has], end[has], first[has], last[has]
    raw = tb.segment_hashes(data, start, end, tb.SPACED.value)
    distinct = np.unique(np.stack([text.astype(tb.U64), raw]), axis=1)[0].astype(np.int64)
    n_dup = np.bincount(text, minlength=n) - np.bincount(distinct, minlength=n)

    normal = tb.find_words(texts, tb.SPACED_NORMAL).hash
    line = tb.segment_hashes(normal, first, last)
    order = np.lexsort((line, text))
    text, line, size = text[order], line[order], (last - first)[order]
    new = np.ones(len(line), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (line[1:] != line[:-1])
    heads = np.flatnonzero(new)
    total = np.add.reduceat(size, heads) if len(heads) else size
    rows = pa.StructArray.from_arrays(
        [pa.array(line[heads].view(np.int64)), pa.array(total.astype(np.int32))], names=["line", "words"]
    )
    return [n_words, word_chars, n_symbols, n_dup, n_repeat], tb.lists(rows, np.bincount(text[heads], minlength=n))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in tb.blocks(batches, "text"):
        counts, lines = _measure(tb.texts_of(block.column("text")))
        columns = [block.column(c) for c in ("id", "host", "text_hash")]
        yield pa.RecordBatch.from_arrays(
            [*columns, *(pa.array(c.astype(np.int64)) for c in counts), lines],
            names=["id", "host", "text_hash", *COUNTS, "lines"],
        )


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """A row per document: counts and line hashes; the text is left behind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        F.xxhash64(text).alias("text_hash"),
        text.alias("text"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in COUNTS)
    found = rows.mapInArrow(_measured, f"id {kind}, host string, text_hash long, {counts}, lines {LINES}")
    return found.withColumn("row", F.monotonically_increasing_id())


def frequent_lines(rows: DataFrame, rules: QualityRules = DEFAULTS) -> DataFrame:
    """(host, line, documents, first): the lines above the limits."""
    lines = rows.select("host", "id", "text_hash", F.inline("lines"))
    counted = lines.groupBy("host", "line").agg(
        F.countDistinct("text_hash").alias("documents"), F.min("id").alias("first")
    )
    hosts = rows.groupBy("host").agg(F.countDistinct("text_hash").alias("of"))
    often = counted.where(F.col("documents") > rules.line_documents).join(hosts, "host")
    large = F.col("of") >= rules.small_host
    return often.where(large | (F.col("documents") > F.col("of") * rules.line_share)).drop("of")


def judged(rows: DataFrame, rules: QualityRules = DEFAULTS) -> DataFrame:
    """``rows`` of ``measured`` as a written table, with ``removed_lines``
    (hashes), ``removed_words``, ``base_failed``, ``depleted`` and ``kept``."""
    often = stage(frequent_lines(rows, rules), "frequent-lines").select("host", "line", "first")
    lines = rows.select("row", "host", "id", F.inline("lines"))
    # both sides come straight from an exchange, so a line that a third of
    # all documents have is split by adaptive execution
    cut = lines.join(often, ["host", "line"]).where(~F.col("id").eqNullSafe(F.col("first")))
    cut = cut.groupBy("row").agg(
        F.collect_list("line").alias("removed_lines"), F.sum("words").alias("removed_words")
    )
    left = F.col("n_words") - F.col("removed_words")
    base = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    )
    return (
        rows.drop("lines")
        .join(cut, "row", "left")
        .withColumn("removed_lines", F.coalesce("removed_lines", F.array().cast("array<bigint>")))
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
        .withColumn("base_failed", base)
        .withColumn("depleted", left < F.col("n_words") * rules.min_remaining)
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    )


def quality(
    docs: DataFrame,
    rules: QualityRules = DEFAULTS,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """A row per document: id, the five counts, ``base_failed``, ``kept``,
    ``removed_words`` and ``depleted``."""
    rows = judged(stage(measured(docs, id_col, text_col, host_col), "measured"), rules)
    return rows.select(
        F.col("id").alias(id_col), *COUNTS, "base_failed", "kept", "removed_words", "depleted"
    )


def _without_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in tb.blocks(batches, "text"):
        removed = block.column("removed_lines")
        at = block.schema.get_field_index("text")
        texts = block.column(at).to_pylist()
        for i in np.flatnonzero(np.asarray(removed.value_lengths().fill_null(0)) > 0).tolist():
            gone = np.array(removed[i].as_py(), dtype=np.int64)
            one = tb.texts_of(pa.array([texts[i]]))
            normal = tb.find_words(one, tb.SPACED_NORMAL)
            _, start, end = _line_edges(one)
            first, last = np.searchsorted(normal.start, start), np.searchsorted(normal.start, end)
            line = tb.segment_hashes(normal.hash, first, last).view(np.int64)
            stays = ~(np.isin(line, gone) & (last > first))
            texts[i] = "\n".join(x for x, keep in zip(texts[i].split("\n"), stays.tolist(), strict=True) if keep)
        yield block.set_column(at, "text", pa.array(texts, pa.string()))


def cleaned(docs: DataFrame, rules: QualityRules = DEFAULTS) -> DataFrame:
    """The documents that are kept, without the removed lines; the columns of
    ``documents`` (doc_id, text, lang, source, n_chars)."""
    rows = judged(stage(measured(docs, "doc_id", "text", "source"), "measured"), rules)
    verdicts = (
        rows.where("kept")
        .groupBy("id", "host", "text_hash")
        .agg(F.max("removed_lines").alias("removed_lines"))
    )
    verdicts = verdicts.select(*(F.col(c).alias(f"v_{c}") for c in verdicts.columns))
    columns = docs.columns
    match = (
        F.col("doc_id").eqNullSafe(F.col("v_id"))
        & (F.coalesce(F.col("source").cast("string"), F.lit("")) == F.col("v_host"))
        & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("v_text_hash"))
    )
    kept = docs.join(verdicts, match).select(*columns, F.col("v_removed_lines").alias("removed_lines"))
    texts = kept.mapInArrow(_without_lines, kept.schema).drop("removed_lines")
    return texts.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*columns)
