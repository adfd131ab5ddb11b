"""Alignment of two tokenizers' tokens, by divide and conquer at shared cuts.

A text is encoded by a byte-level BPE (A; a ``tokenizers`` file, whose ids are
the ranks that ``tiktoken`` merges by) and by a piece BPE (B). Byte offsets
at which tokens of both end are cuts. An interval of tokens is halved at the
cut nearest its middle, found by bisection of the other side's ends; both
halves are cut likewise, and an interval without a cut is a group. Every A
token of a group is linked with every B token of it.

Neither tokenizer joins a blank to the letter, digit or sign before it, so
texts come apart there, and each distinct chunk of a block is encoded, checked
and cut once. Texts with other blanks than single ones are split with the same
rule by a pattern; a text without any such place is one chunk.

``scored`` weighs links by the corpus: a pair of ids counts the documents that
hold it linked. Documents stay in blocks of some megabytes; a block sends each
of its distinct pairs once, gets their counts back and sums them up for its
documents, so nothing is shuffled per link and no count is held whole anywhere.

A null or empty text, and one whose tokens of either kind do not join to a
blank and the text, has no tokens: zeros, and null for its groups. Very long
texts are blocks of their own. Repeated rows are documents of their own, null
ids too. Empty tables give no rows. Columns other than id and text are not
read. Both files are opened on every machine that runs tasks, by the same path.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from public_tokenizers import PATTERN
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from phraseloom.llm import textblocks as tb
from phraseloom.llm.bpe import byte_symbols
from phraseloom.staging import stage

BLOCK_BYTES = 2 << 20
# a blank after one of these begins a chunk, but not at the end of a text: no
# white space among them
SAFE = "[!-~À-ɏ]"
BREAK = re.compile(f"(?s)(?<={SAFE})(?= .)")
OTHER_BLANK = re.compile(rf"(?<!{SAFE}) | \Z")
FOUND = (
    "block long, keys array<long>, held array<long>, pairs binary, times binary, "
    "n_a long, n_b long, n_groups long, n_links long, groups string"
)


def groups(ends_a: np.ndarray, ends_b: np.ndarray, start_a: np.ndarray, start_b: np.ndarray) -> np.ndarray:
    """Rows (i, j, k, l), in order: the groups of tokens i to j of A and k to l
    of B. ``ends``: where tokens end, counted through all texts; text t has the
    tokens from start[t] to start[t + 1], up to the same end on both sides."""
    todo = np.stack([start_a[:-1], start_a[1:], start_b[:-1], start_b[1:]])
    leaves = []
    while todo.size:
        i, j, k, l = todo
        middle = (i + j - 1) // 2
        cut_a, cut_b = np.full(len(i), -1), np.full(len(i), -1)
        # the common end nearest the middle; the end of all is none
        looking, step = np.flatnonzero((j - i > 1) & (l - k > 1)), 0
        while looking.size:
            x = middle[looking] + ((step + 1) // 2 if step % 2 else -(step // 2))
            inside = (x >= i[looking]) & (x < j[looking] - 1)
            x = np.clip(x, 0, len(ends_a) - 1)
            y = np.searchsorted(ends_b, ends_a[x])
            hit = inside & (ends_b[y] == ends_a[x])
            cut_a[looking[hit]], cut_b[looking[hit]] = x[hit] + 1, y[hit] + 1
            step += 1
            looking = looking[~hit & (j - i > step)[looking]]
        cut = cut_a >= 0
        leaves.append(todo[:, ~cut])
        left = np.stack([i[cut], cut_a[cut], k[cut], cut_b[cut]])
        right = np.stack([cut_a[cut], j[cut], cut_b[cut], l[cut]])
        todo = np.concatenate([left, right], axis=1)
    rows = np.concatenate(leaves, axis=1).T if leaves else np.zeros((0, 4), np.int64)
    return rows[np.argsort(rows[:, 0], kind="stable")]


class Aligned(NamedTuple):
    """Chunks' tokens, counted, and their groups in writing."""

    counts: np.ndarray  # (chunk, 4): tokens of A, of B, groups, links
    written: list[str]
    bounds: np.ndarray  # the links of chunk c are links[bounds[c]:bounds[c + 1]]
    links: np.ndarray  # id of A << 32 | id of B
    times: np.ndarray


class Aligner:
    def __init__(self, byte_path: str, piece_path: str):
        byte = {s: i for i, s in enumerate(byte_symbols())}
        with open(byte_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary = model["vocab"]
        made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if made != sorted(made):
            raise ValueError(f"{byte_path}: ids are not in the order of merges")
        # an entry with other symbols is an added token, which no text yields
        spelled = {i: bytes(byte[c] for c in t) for t, i in vocabulary.items() if all(c in byte for c in t)}
        ranks = {t: i for i, t in spelled.items()}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = SentencePieceProcessor(model_file=piece_path)
        self.bytes_a = pa.array([spelled.get(i, b"") for i in range(max(spelled) + 1)], pa.large_binary())
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = pa.array(
            [
                bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                for i, p in enumerate(pieces)
            ],
            pa.large_binary(),
        )
        self.decimal = pa.array([str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))], pa.large_string())

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of ``chunks``, which begin with the blank that B adds."""
        if not chunks:
            return [], []
        return [self.a.encode_ordinary(c) for c in chunks], self.b.encode([c[1:] for c in chunks], num_threads=1)

    def spells(self, chunk: str, a: list[int], b: list[int]) -> bool:
        """Whether the tokens of either side join to the chunk."""
        return all(
            b"".join(table.take(pa.array(ids, pa.int64())).to_pylist()) == chunk.encode()
            for table, ids in ((self.bytes_a, a), (self.bytes_b, b))
        )

    def align(self, chunks: list[str]) -> tuple[Aligned, list[int]]:
        """The chunks aligned, and which of them do not equal their tokens;
        those have none."""
        lists_a, lists_b = self.encode(chunks)
        whole = "".join(chunks).encode()
        wrong: list[int] = []
        while True:
            a, start_a, joined_a, ends_a = _flat(lists_a, self.bytes_a)
            b, start_b, joined_b, ends_b = _flat(lists_b, self.bytes_b)
            if wrong or joined_a == joined_b == whole:
                break
            wrong = [i for i, c in enumerate(chunks) if not self.spells(c, lists_a[i], lists_b[i])]
            for i in wrong:
                lists_a[i], lists_b[i] = [], []
        some = np.flatnonzero(np.diff(start_a) > 0)
        g = groups(ends_a, ends_b, np.append(start_a[some], len(a)), np.append(start_b[some], len(b)))
        n_a, n_b = g[:, 1] - g[:, 0], g[:, 3] - g[:, 2]
        chunk = np.searchsorted(start_a, g[:, 0], "right") - 1
        counts = np.zeros((len(chunks), 4), np.int64)
        counts[:, 0], counts[:, 1] = np.diff(start_a), np.diff(start_b)
        counts[:, 2] = np.bincount(chunk, minlength=len(chunks))
        np.add.at(counts[:, 3], chunk, n_a * n_b)
        links, times, of = _links(a, b, g, chunk)
        bounds = np.searchsorted(of, np.arange(len(chunks) + 1))
        return Aligned(counts, self.write(a, b, g, start_a, start_b), bounds, links, times), wrong

    def write(self, a: np.ndarray, b: np.ndarray, g: np.ndarray, start_a: np.ndarray, start_b: np.ndarray) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for each chunk."""
        n_a, n_b = g[:, 1] - g[:, 0], g[:, 3] - g[:, 2]
        ids, after = np.zeros(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int8)
        # before a token of a group come both sides of all earlier groups
        at_a = np.arange(len(a)) + np.repeat(g[:, 2], n_a)
        at_b = np.arange(len(b)) + np.repeat(g[:, 1], n_b)
        ids[at_a], ids[at_b] = a, b
        after[at_a[g[:, 1] - 1]], after[at_b[g[:, 3] - 1]] = 1, 2
        bounds = start_a + start_b
        after[bounds[1:][np.diff(bounds) > 0] - 1] = 3
        signs = pa.array([",", "|", ";", ""], pa.large_string()).take(pa.array(after))
        parts = pc.binary_join_element_wise(self.decimal.take(pa.array(ids)), signs, pa.scalar("", pa.large_string()))
        offsets, data = _buffers(parts)
        cut = offsets[bounds].tolist()
        text = data.decode()
        return [text[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]


def _buffers(column: pa.Array) -> tuple[np.ndarray, bytes]:
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), b""
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets - offsets[0], data.to_pybytes()[offsets[0] : offsets[-1]] if data else b""


def _flat(lists: list[list[int]], table: pa.Array) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
    """All ids, where each list begins, their bytes, and where each id's end."""
    start = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=start[1:])
    ids = np.fromiter(chain.from_iterable(lists), np.int64, int(start[-1]))
    offsets, joined = _buffers(table.take(pa.array(ids)))
    return ids, start, joined, offsets[1:]


# Groups with more links than this are counted by their distinct ids first.
MANY_LINKS = 1 << 12


def _links(a: np.ndarray, b: np.ndarray, g: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, how often, chunk) of the links of all groups, by chunk; a key may
    come several times."""
    n_a, n_b = g[:, 1] - g[:, 0], g[:, 3] - g[:, 2]
    few = np.flatnonzero(n_a * n_b <= MANY_LINKS)
    # each token of A meets all of B in its group
    m = n_a[few]
    x = np.repeat(g[few, 0] - (np.cumsum(m) - m), m) + np.arange(m.sum())
    k, size = np.repeat(g[few, 2], m), np.repeat(n_b[few], m)
    y = np.repeat(k - (np.cumsum(size) - size), size) + np.arange(size.sum())
    keys = [np.repeat(a[x], size) << 32 | b[y]]
    chunk, times = [np.repeat(np.repeat(of[few], m), size)], [np.ones(len(y), np.int64)]
    for i in np.flatnonzero(n_a * n_b > MANY_LINKS).tolist():
        in_a, count_a = np.unique(a[g[i, 0] : g[i, 1]], return_counts=True)
        in_b, count_b = np.unique(b[g[i, 2] : g[i, 3]], return_counts=True)
        keys.append((in_a[:, None] << 32 | in_b).reshape(-1))
        times.append((count_a[:, None] * count_b).reshape(-1))
        chunk.append(np.full(len(keys[-1]), of[i]))
    key, often, chunk = np.concatenate(keys), np.concatenate(times), np.concatenate(chunk)
    order = np.argsort(chunk, kind="stable")
    return key[order], often[order], chunk[order]


@lru_cache(maxsize=2)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def chunks(text: str | None) -> list[str]:
    """A blank and the text, in chunks that begin with a blank."""
    if not text:
        return []
    if OTHER_BLANK.search(text):
        return BREAK.split(" " + text)
    return [" " + part for part in text.split(" ")]


def _narrow(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in as few bytes as they need."""
    most = int(values.max(initial=0))
    return values.astype(next(t for t in ("u1", "u2", "u4", "u8") if most <= np.iinfo(t).max))


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _summed(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their weights."""
    order = np.argsort(keys, kind="stable")
    keys, weight = keys[order], weight[order]
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(weight, heads) if len(keys) else weight


def _align_block(texts: list[str | None], known: Aligner):
    """(keys, documents that hold each, columns per document)."""
    split = [chunks(t) for t in texts]
    number = {c: i for i, c in enumerate(dict.fromkeys(chain.from_iterable(split)))}
    found, wrong = known.align(list(number))
    if wrong:
        names = list(number)
        names = {names[i] for i in wrong}
        split = [[] if not names.isdisjoint(s) else s for s in split]
    n, m = len(texts), max(len(number), 1)
    size = np.fromiter(map(len, split), np.int64, n)
    at = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(size.sum()))
    of = np.repeat(np.arange(n), size)
    sums = np.zeros((n, 4), np.int64)
    np.add.at(sums, of, found.counts[at])
    spelled, place = [], 0
    for k in size.tolist():
        spelled.append(";".join([found.written[i] for i in at[place : place + k].tolist()]) if k else None)
        place += k
    # links of a document: those of its chunks, as often as it holds the chunk
    keys, local = np.unique(found.links, return_inverse=True)
    held, often = _summed(of * m + at, np.ones(len(at), np.int64))
    of, at = held // m, held % m
    count = found.bounds[at + 1] - found.bounds[at]
    entry = np.repeat(found.bounds[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    pair, total = _summed(
        np.repeat(of, count) * max(len(keys), 1) + local[entry], found.times[entry] * np.repeat(often, count)
    )
    of, pair = pair // max(len(keys), 1), pair % max(len(keys), 1)
    ends = np.searchsorted(of, np.arange(n + 1))
    pairs = [pair[a:b].astype(np.uint32).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    often_ = [_narrow(total[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return keys, np.bincount(pair, minlength=len(keys)), pairs, often_, sums, spelled


def _aligned(byte_path: str, piece_path: str, block_bytes: int):
    names = ["id", "aligned", *(x.split()[0] for x in FOUND.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(byte_path, piece_path)
        block = TaskContext.get().partitionId() << 32
        for rows in tb.blocks(batches, "text", block_bytes):
            keys, held, pairs, times, sums, spelled = _align_block(rows.column("text").to_pylist(), known)
            n, kind = rows.num_rows, rows.schema.field("id").type
            # a row for the block, then its documents
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.nulls(1, kind), rows.column("id")]),
                    pa.array([False] + [True] * n),
                    pa.array([block] * (n + 1), pa.int64()),
                    pa.array([keys] + [None] * n, pa.list_(pa.int64())),
                    pa.array([held] + [None] * n, pa.list_(pa.int64())),
                    pa.array([None, *pairs], pa.binary()),
                    pa.array([None, *times], pa.binary()),
                    *(pa.array([None, *sums[:, i].tolist()], pa.int64()) for i in range(4)),
                    pa.array([None, *spelled], pa.string()),
                ],
                names=names,
            )
            block += 1

    return run


def aligned(
    docs: DataFrame,
    byte_path: str,
    piece_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """A row per document (``aligned``): ``id``, ``n_a``, ``n_b``,
    ``n_groups``, ``n_links`` and ``groups`` (``a1,a2|b1;a3|b2,b3`` by ids),
    its distinct pairs of ids (``pairs``, ``times``: packed numbers); and a row
    per block of documents that names the pairs (``keys``, ``held``)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_aligned(byte_path, piece_path, block_bytes), f"id {kind}, aligned boolean, {FOUND}")


def pair_counts(found: DataFrame) -> DataFrame:
    """(key, count, best): the documents that hold each pair of ids linked, and
    whether no other pair of its A id is held by more."""
    pairs = found.where("not aligned").select(F.explode(F.arrays_zip("keys", "held")).alias("p"))
    counts = pairs.groupBy(F.col("p.keys").alias("key")).agg(F.sum("p.held").alias("count"))
    counts = stage(counts.withColumn("a", F.shiftright("key", 32)), "pair-counts")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("key", "count", (F.col("count") == F.col("most")).alias("best"))


def _sum_up(carried: list[str]):
    def run(docs: pa.Table, priced: pa.Table) -> pa.Table:
        order = np.argsort(priced.column("place").to_numpy())
        count = priced.column("count").to_numpy()[order]
        best = priced.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
        n_best, sums = [], []
        for pairs, times in zip(docs.column("pairs").to_pylist(), docs.column("times").to_pylist(), strict=True):
            pair = np.frombuffer(pairs, np.uint32)
            often = _wide(times, len(pair))
            n_best.append(int((often * best[pair]).sum()))
            sums.append(int((often * count[pair]).sum()))
        return docs.select(carried).append_column("n_best", pa.array(n_best, pa.int64())).append_column(
            "count_sum", pa.array(sums, pa.int64())
        )

    return run


def scored(found: DataFrame) -> DataFrame:
    """The documents of ``found``, a written table that ``aligned`` made, with
    its columns but those of blocks and pairs, and with ``n_best``
    (links whose pair is the most frequent of its A id) and ``count_sum`` (of
    the counts of all links)."""
    inner = {"aligned", *(x.split()[0] for x in FOUND.split(", ")[:5])}
    carried = [f for f in found.schema if f.name not in inner]
    places = found.where("not aligned").select("block", F.posexplode("keys").alias("place", "key"))
    priced = places.join(pair_counts(found), "key").select(F.col("block").alias("of_block"), "place", "count", "best")
    docs = found.where("aligned").select(F.col("block").alias("own_block"), "pairs", "times", *(f"`{f.name}`" for f in carried))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried)
    return (
        docs.groupBy("own_block")
        .cogroup(priced.groupBy("of_block"))
        .applyInArrow(_sum_up([f.name for f in carried]), f"{schema}, n_best long, count_sum long")
    )
