"""Collocations: phrases that occur more often than their parts suggest.

Phrases of one to five words inside pieces of text are counted per language. A
phrase is frequent only if the phrases one word shorter at either end are, so
lengths are counted one after the other: each pass over the texts skips windows
whose shorter halves a bit filter of fixed size does not know, and adds up the
rest per block before the shuffle. What the filter lets through by chance is
counted exactly and leaves with the infrequent.

The counts that remain are two streams, one in order of the words from the
left, one from the right, dealt out by ranges and sorted. Every prefix of a
phrase is in the first stream, and its last row of that length precedes the
phrase; so one pass in step reads the counts of all left parts, and the row
that follows tells the count of the only extension that can be as frequent as
the phrase itself. The second stream gives right parts and left extensions.
Each task tells its first and last counts in one row, and the tasks after it
begin with them. Nothing is looked up by a hash, and no word's phrases need to
meet in one task.

Of the ways to cut a phrase in two, the least score counts. Phrases that never
occur outside a longer one are dropped.

A null text is empty, a null language is ``und``. Very long texts are blocks of
their own. Repeated rows count as often as they are there. Empty tables give no
rows; columns other than language and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phraseloom.llm import textblocks as tb
from phraseloom.staging import stage


@dataclass(frozen=True)
class Mining:
    longest: int = 5
    min_count: int = 100
    top: int = 2000
    # the filter of frequent phrases: 4 MB
    filter_bits: int = 25


DEFAULTS = Mining()
BLOCK_BYTES = 4 << 20
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
LETTERS = tb.alphabet(b"\x20\x09" + PIECE_ENDS, fold=True)
PHRASES = tb.alphabet(b"\x20")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IS_END = np.isin(np.arange(256), np.frombuffer(PIECE_ENDS, np.uint8))
PAGE = 32768


def _rolled(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    h = np.zeros(len(at), dtype=tb.U64)
    for i in range(size):
        h = h * tb.U64(tb.BASE) + words[at + i]
    return h


def _slots(phrase: np.ndarray, lang: np.ndarray, bits: int) -> np.ndarray:
    return tb.mix(phrase ^ lang) & tb.U64((1 << bits) - 1)


def _string_hashes(strings: pa.Array, letters: tb.Alphabet) -> np.ndarray:
    """Of whole strings, or of the words they are made of, as windows have it."""
    words = tb.find_words(tb.texts_of(strings), letters)
    out = np.zeros(len(strings), dtype=tb.U64)
    size = np.diff(words.bounds)
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        out[rows] = _rolled(words.hash, words.bounds[rows], n)
    return out


def _language_hashes(langs: pa.Array) -> np.ndarray:
    return _string_hashes(langs, tb.alphabet(b"")) if len(langs) else np.zeros(0, tb.U64)


class _Block:
    """Words of a block of texts, numbered, with their piece and language."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        data, offsets = tb.texts_of(texts)
        data = LOWER[data]
        words = tb.find_words(tb.Texts(data, offsets), LETTERS)
        text = words.text_of()
        # pieces are known by how many ends and texts came before
        ends = np.cumsum(IS_END[data]) if len(data) else np.zeros(0, np.int64)
        self.piece = (ends[words.start] if len(words.start) else words.start) + text
        self.hash = words.hash
        langs = langs.dictionary_encode()
        self.langs = langs.dictionary
        self.lang = langs.indices.to_numpy(zero_copy_only=False)[text]
        bounds = np.zeros(len(words.start) + 1, np.int64)
        np.cumsum(words.end - words.start, out=bounds[1:])
        inside = np.zeros(len(data) + 1, np.int8)
        inside[words.start] += 1
        inside[words.end] -= 1
        spelled = data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
        column = pa.LargeStringArray.from_buffers(len(words.start), pa.py_buffer(bounds.tobytes()), pa.py_buffer(spelled.tobytes()))
        column = column.dictionary_encode()
        self.words, self.word = column.dictionary, column.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def windows(self, size: int, bits: np.ndarray | None, filter_bits: int) -> np.ndarray:
        """Where windows begin whose shorter halves may be frequent."""
        k = len(self.word) - size + 1
        if k <= 0:
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.piece[:k] == self.piece[size - 1 :])
        if bits is None:
            return at
        lang = _language_hashes(self.langs)
        for shift in (0, 1):
            slot = _slots(_rolled(self.hash, at + shift, size - 1), lang[self.lang[at]], filter_bits)
            at = at[bits[slot >> tb.U64(3)] >> (slot & tb.U64(7)).astype(np.uint8) & 1 == 1]
        return at

    def counted(self, at: np.ndarray, size: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """(language, phrase, occurrences) of the windows at ``at``."""
        key = self.lang[at].astype(np.int64)
        for i in range(size):
            # numbers of the phrases so far stay below the number of windows
            key = np.unique(key, return_inverse=True)[1] * len(self.words) + self.word[at + i]
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        first = at[first]
        parts = [self.words.take(pa.array(self.word[first + i])) for i in range(size)]
        phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if size > 1 else parts[0]
        return self.langs.take(pa.array(self.lang[first])), phrase, count


def _count(size: int, known: Broadcast | None, how: Mining, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if known is None else known.value
        for rows in tb.blocks(batches, "text", block_bytes):
            block = _Block(rows.column("lang").cast(pa.large_string()), rows.column("text"))
            lang, phrase, count = block.counted(block.windows(size, bits, how.filter_bits), size)
            if size == 1:  # all words of a language, under no phrase
                totals = np.bincount(block.lang, minlength=len(block.langs))
                lang, count = pa.concat_arrays([lang, block.langs]), np.concatenate([count, totals])
                phrase = pa.concat_arrays([phrase, pa.nulls(len(totals), pa.large_string())])
            for i in range(0, len(count), 50_000):
                part = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [lang[part].cast(pa.string()), phrase[part].cast(pa.string()), pa.array(count[part], pa.int64())],
                    names=["lang", "phrase", "f"],
                )

    return run


def _filter(frequent: DataFrame, how: Mining) -> Broadcast:
    """The bits of all phrases in ``frequent``: a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("lang").dictionary_encode()
            hashes = _language_hashes(lang.dictionary.cast(pa.large_string()))[lang.indices.to_numpy(zero_copy_only=False)]
            slots = _slots(_string_hashes(batch.column("phrase"), PHRASES), hashes, how.filter_bits)
            yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64))], names=["slot"])

    slots = frequent.select("lang", "phrase").mapInArrow(run, "slot long")
    page, place = F.expr(f"slot div {PAGE}"), F.expr(f"slot % {PAGE}")
    bits = np.zeros(max(1 << how.filter_bits, PAGE) // 8, np.uint8)
    for row in slots.groupBy(page.alias("page")).agg(F.bitmap_construct_agg(place).alias("bits")).collect():
        bits[row.page * PAGE // 8 : (row.page + 1) * PAGE // 8] = np.frombuffer(row.bits, np.uint8)
    return frequent.sparkSession.sparkContext.broadcast(bits)


def frequent_phrases(docs: DataFrame, how: Mining = DEFAULTS, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f) of the phrases that occur ``min_count`` times at
    least, (lang, n) of all words). ``docs``: lang, text."""
    known, levels, total = None, [], None
    for size in range(1, how.longest + 1):
        found = docs.mapInArrow(_count(size, known, how, block_bytes), "lang string, phrase string, f long")
        found = found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        found = stage(found.where(F.col("phrase").isNull() | (F.col("f") >= how.min_count)), f"phrases-{size}")
        if size == 1:
            total = found.where("phrase is null").select("lang", F.col("f").alias("n"))
            found = found.where("phrase is not null")
        levels.append(found)
        if size < how.longest:
            known = _filter(found, how)
    union = levels[0]
    for level in levels[1:]:
        union = union.unionByName(level)
    return union, total


def _in_step(names: list[str], parts: int):
    """Rows in order get the counts of their first 1, 2, ... words, as far as
    the task has seen them, and the count of the row that follows if that is
    one word longer. Last comes the row the task tells the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen, head, held = np.zeros(parts, np.int64), None, None

        def told(rows: pa.RecordBatch, below: np.ndarray, after, first) -> pa.RecordBatch:
            n = rows.num_rows
            columns = [pa.array(below[:, k], pa.int64(), mask=below[:, k] == 0) for k in range(parts)]
            columns += [pa.array(after, pa.int64()), pa.array([first] * n, pa.int64()), pa.array([part] * n, pa.int64())]
            extra = [*(f"below_{k + 1}" for k in range(parts)), "after", "first_size", "part"]
            return pa.RecordBatch.from_arrays([*rows.columns, *columns], names=[*names, *extra])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            size, f = (batch.column(c).to_numpy() for c in ("size", "f"))
            head = head or (int(size[0]), int(f[0]))
            at, last = np.arange(len(f)), len(f) - 1
            below, before = np.zeros((len(f), parts), np.int64), seen.copy()
            for k in range(parts):
                place = np.maximum.accumulate(np.where(size == k + 1, at, -1))
                count = np.where(place >= 0, f[place], seen[k])
                below[:, k] = np.where(size > k + 1, count, 0)
                before[k] = count[last - 1] if last else seen[k]
            after = np.where(size[1:] == size[:-1] + 1, f[1:], 0)
            if last:
                yield told(batch.slice(0, last), below[:last], after, None)
            held, tail, seen = batch.slice(last), (below[last:], int(size[last]), int(f[last])), before
        if held is not None:
            yield told(held, tail[0], [None], None)
            if tail[1] <= parts:
                seen[tail[1] - 1] = tail[2]
            empty = pa.RecordBatch.from_arrays([pa.nulls(1, x.type) for x in held.columns], names=names)
            yield told(empty, seen[None, :], [head[1]], head[0])

    return run


def in_step(stream: DataFrame, words: Column, how: Mining) -> DataFrame:
    """``stream`` (lang, size, f, ...) with ``below``, the counts of the first
    1, 2, ... ``words`` of each phrase, and ``after``, the largest count that
    a phrase of one more word has, if that is the phrase's own; else less."""
    parts = how.longest - 1
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    counts = [f"below_{k + 1}" for k in range(parts)]
    schema = f"{fields}, {', '.join(c + ' long' for c in counts)}, after long, first_size long, part long"
    keyed = stream.withColumn("in_order", words)
    ordered = keyed.repartitionByRange("lang", "in_order").sortWithinPartitions("lang", "in_order").drop("in_order")
    told = stage(ordered.mapInArrow(_in_step(stream.columns, parts), schema), "in-step")
    # one row per task: what came before it and what comes next
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    following = Window.orderBy("part")
    tasks = told.where("first_size is not null").select(
        "part",
        *(F.last(c, ignorenulls=True).over(earlier).alias(f"earlier_{c}") for c in counts),
        F.lead("first_size").over(following).alias("next_size"),
        F.lead("after").over(following).alias("next_f"),
    )
    # its size is bounded by the number of tasks
    rows = told.where("first_size is null").join(F.broadcast(stage(tasks, "tasks")), "part")
    size = F.col("size")
    here = [F.when(size > k + 1, F.coalesce(c, f"earlier_{c}")) for k, c in enumerate(counts)]
    last = F.when(F.col("next_size") == size + 1, F.col("next_f")).otherwise(0)
    return rows.select(*stream.columns, F.array(*here).alias("below"), F.coalesce("after", last).alias("after"))


def collocations(
    docs: DataFrame, how: Mining = DEFAULTS, lang_col: str = "lang", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``,
    its count ``a``, those of its parts ``l`` and ``r``, words ``n``, ``score``."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    docs = docs.select(lang, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    phrases, total = frequent_phrases(docs, how, block_bytes)
    words = F.split("phrase", " ")
    stream = phrases.withColumn("size", F.size(words).cast("long"))
    left = in_step(stream, words, how).withColumnsRenamed({"below": "lefts", "after": "longer"})
    both = in_step(left, F.reverse(words), how)
    whole = (F.col("size") == 1) | (F.col("longer") == F.col("f")) | (F.col("after") == F.col("f"))
    found = both.where(~whole).join(total, "lang")

    def cut(k: Column) -> Column:
        l, r = F.get("lefts", k - 1), F.get("below", F.col("size").cast("int") - k - 1)
        wide = lambda c: c.cast("decimal(19,0)")
        score = F.call_function("div", wide(F.col("f")) * wide(F.col("n")) * F.lit(1000).cast("decimal(4,0)"), wide(l) * wide(r))
        return F.struct(score.alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    weakest = F.array_min(F.transform(F.sequence(F.lit(1), F.col("size").cast("int") - 1), cut))
    found = found.select("lang", "phrase", F.col("f").alias("a"), "n", weakest.alias("cut"))
    found = found.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= how.top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
