"""Verbatim test passages in training documents, by suffix arrays.

The documents of a block are a shard: its words are numbered by the vocabulary
of the test set, and the suffixes that can begin a window (at least a window's
length of such words) are sorted into a suffix array by prefix doubling. Every
test suffix that begins a window is binary-searched in the array; the interval
it gives holds all places of the window in the shard. Each such place is
searched in turn among the sorted test suffixes: the longer of its agreements
with both neighbours is the longest verbatim match there. Nothing is shuffled:
shards are rows that a task holds anyway, and they are joined to no other.

The test set is dealt out by hash to parts of about ``PART_BYTES`` of text.
Tasks build each part once, suffix array included, and write it to a table; the
driver hands the finished parts over to the executors one by one, so it holds
one at a time, and workers load a part from their machine's disk. Each shard is
searched for each part in turn; no array is sorted twice.

A null text has no words. An item with fewer words than a window is a window
itself; an item without words is none. Item ids are compared as strings, a null
id is the empty string. Repeated items count once per id. Empty tables give no
rows, or no hits. A very long text is a shard of its own. Columns other than
those named are not read; one that has the name of a result gives way to it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phraseloom.llm import textblocks as tb
from phraseloom.staging import stage

WINDOW = 10
PART_BYTES = 16 << 20
# parts that a worker keeps in memory
LOADED = 4
FOUND = (
    "n_words long, n_hit long, items array<string>, longest_match long, longest_item string, longest_at long"
)


class TestPart(NamedTuple):
    """Some test items, their words numbered by their own vocabulary."""

    item_ids: np.ndarray  # object
    vocabulary: np.ndarray  # sorted word hashes; word k has number k + 1
    ids: np.ndarray  # the items' words as numbers, a break (0) after each item
    item_of: np.ndarray  # for each of ``ids``, a position in item_ids
    array: np.ndarray  # all suffixes in order
    window_at: np.ndarray  # where in ``ids`` each distinct window begins
    window_size: np.ndarray
    owner_bounds: np.ndarray  # owners of window w: owners[bounds[w]:bounds[w + 1]]
    owners: np.ndarray  # positions in item_ids
    longest: int


def test_part(item_ids: list[str], texts: list[str | None], size: int) -> TestPart:
    words = tb.find_words(tb.texts_of(pa.array(texts, pa.string())), tb.ALPHANUMERIC)
    vocabulary, number = np.unique(words.hash, return_inverse=True)
    count = np.diff(words.bounds)
    text = words.text_of()
    longest = int(count.max(initial=0))
    ids = np.insert(number + 1, words.bounds[1:], 0)
    item_of = np.insert(text, words.bounds[1:], np.arange(len(count)))
    at, _ = tb.windows(words, size)
    short = np.flatnonzero((count > 0) & (count < size))
    at = np.concatenate([at, words.bounds[short]])
    item = text[at]
    at, length = at + item, np.minimum(count[item], size)
    # equal windows are one, owned by all their items
    padded = np.zeros((len(at), size), dtype=np.int64)
    for i in range(size):
        rows = np.flatnonzero(length > i)
        padded[rows, i] = ids[at[rows] + i]
    _, first, which = np.unique(padded, axis=0, return_index=True, return_inverse=True)
    pairs = np.unique(np.stack([which.reshape(-1), item]), axis=1)
    return TestPart(
        np.array(item_ids, dtype=object),
        vocabulary,
        ids,
        item_of,
        suffix_array(ids, np.flatnonzero(ids), longest),
        at[first],
        length[first],
        np.searchsorted(pairs[0], np.arange(len(first) + 1)),
        pairs[1],
        longest,
    )


def suffix_array(ids: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` ordered by the words that follow each, up to ``depth``.
    ``ids`` holds a break (0) at its end at least."""
    rank = ids.astype(np.int64)
    done = 1
    while done < depth:
        after = np.zeros_like(rank)
        after[:-done] = rank[done:]
        # past a break nothing counts
        key = rank * (rank.max(initial=0) + 1) + after
        key[rank == 0] = 0
        _, rank = np.unique(key, return_inverse=True)
        done *= 2
    return starts[np.argsort(rank[starts], kind="stable")]


def _bound(ids, array, other, at, size, upper: bool) -> np.ndarray:
    """For each other[at:at + size], how many suffixes of ``ids`` sort before
    it (``upper``: or begin with it). All halve their intervals at once."""
    lo = np.zeros(len(at), dtype=np.int64)
    hi = np.full(len(at), len(array), dtype=np.int64)
    while (halved := np.flatnonzero(lo < hi)).size:
        mid = (lo[halved] + hi[halved]) // 2
        place, there, length = array[mid], at[halved], size[halved]
        before = np.full(len(halved), upper)
        go, i = np.arange(len(halved)), 0
        while (go := go[(length[go] > i) & (place[go] + i < len(ids)) & (there[go] + i < len(other))]).size:
            a, b = ids[place[go] + i], other[there[go] + i]
            before[go[a < b]], before[go[a > b]] = True, False
            go, i = go[(a == b) & (a > 0)], i + 1
        lo[halved[before]] = mid[before] + 1
        hi[halved[~before]] = mid[~before]
    return lo


def _agreement(ids: np.ndarray, at: np.ndarray, other: np.ndarray, there: np.ndarray) -> np.ndarray:
    """How many words are equal from both places on."""
    size = np.zeros(len(at), dtype=np.int64)
    go = np.arange(len(at))
    while len(go):
        a = ids[at[go] + size[go]]
        go = go[(a > 0) & (a == other[there[go] + size[go]])]
        size[go] += 1
    return size


class Hits(NamedTuple):
    at: np.ndarray  # first word of each occurrence of a window
    window: np.ndarray
    size: np.ndarray
    place: np.ndarray  # each distinct first word
    match: np.ndarray  # words of its longest match
    item: np.ndarray  # an item that holds it


def _search(words: tb.Words, part: TestPart) -> Hits | None:
    if not len(part.window_at) or not len(words.hash):
        return None
    near = np.minimum(np.searchsorted(part.vocabulary, words.hash), len(part.vocabulary) - 1)
    ids = np.where(part.vocabulary[near] == words.hash, near + 1, 0)
    text = words.text_of()
    # where the run of known words of the same text ends
    n = len(ids)
    end = np.full(n, n)
    last = np.flatnonzero(text[1:] != text[:-1])
    end[last] = last + 1
    unknown = np.flatnonzero(ids == 0)
    end[unknown] = unknown
    end = np.minimum.accumulate(end[::-1])[::-1]
    fits = end - np.arange(n) >= part.window_size.min()
    if not fits.any():
        return None
    # only runs that can hold a window remain, each closed by a break
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, np.flatnonzero(fits), 1)
    np.add.at(edge, end[fits], -1)
    inside = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    broken = np.flatnonzero((np.diff(inside) > 1) | (text[inside[1:]] != text[inside[:-1]])) + 1
    origin = np.append(np.insert(inside, broken, -1), -1)
    packed = np.where(origin >= 0, ids[origin], 0)
    starts = np.flatnonzero(origin >= 0)
    starts = starts[fits[origin[starts]]]
    array = suffix_array(packed, starts, part.longest)
    low, high = (_bound(packed, array, part.ids, part.window_at, part.window_size, x) for x in (False, True))
    count = high - low
    if not count.any():
        return None
    window = np.repeat(np.arange(len(count)), count)
    found = array[low[window] + np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)]
    place = np.unique(found)
    rank = _bound(part.ids, part.array, packed, place, np.full(len(place), part.longest), False)
    match, item = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
    for side in (rank - 1, rank):
        suffix = part.array[np.clip(side, 0, len(part.array) - 1)]
        size = _agreement(packed, place, part.ids, suffix)
        longer = size > match
        match[longer], item[longer] = size[longer], part.item_of[suffix[longer]]
    return Hits(origin[found], window, part.window_size[window], origin[place], match, item)


class _Parts:
    """The parts of the test set, one at a time."""

    # the parts that a worker has loaded, the latest last
    loaded: dict[int, tuple[Broadcast, TestPart]] = {}

    def __init__(self, sent: list[Broadcast], size: int):
        self.sent, self.size = sent, size

    def __iter__(self) -> Iterator[TestPart]:
        for sent in self.sent:
            known = _Parts.loaded.get(id(sent))
            # a broadcast is an object of its own in each worker; held here, its id is not used again
            if known is None or known[0] is not sent:
                while len(_Parts.loaded) >= LOADED:
                    _Parts.loaded.pop(next(iter(_Parts.loaded)))
                known = _Parts.loaded[id(sent)] = sent, TestPart(*pickle.loads(sent.value))
                vars(sent).pop("_value", None)  # read from disk again if asked for
            yield known[1]


def _scan_block(texts: tb.Texts, parts: _Parts) -> list[pa.Array]:
    words = tb.find_words(texts, tb.ALPHANUMERIC)
    n = len(words.bounds) - 1
    text = words.text_of()
    cover = np.zeros(len(text) + 1, dtype=np.int64)
    best = np.zeros(n, dtype=np.int64)
    best_at = np.full(n, -1, dtype=np.int64)
    best_item = np.full(n, None, dtype=object)
    owned: list[tuple[np.ndarray, np.ndarray]] = []
    for part in parts:
        hits = _search(words, part)
        if hits is None:
            continue
        np.add.at(cover, hits.at, 1)
        np.add.at(cover, hits.at + hits.size, -1)
        pairs = np.unique(np.stack([text[hits.at], hits.window]), axis=1)
        lo, hi = part.owner_bounds[pairs[1]], part.owner_bounds[pairs[1] + 1]
        count = hi - lo
        owner = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
        pairs = np.unique(np.stack([np.repeat(pairs[0], count), part.owners[owner]]), axis=1)
        owned.append((pairs[0], part.item_ids[pairs[1]]))
        # matches of a window or more, and items shorter than that
        long = hits.match >= parts.size
        at = np.concatenate([hits.place[long], hits.at])
        match = np.concatenate([hits.match[long], hits.size])
        item = np.concatenate([hits.item[long], part.owners[part.owner_bounds[hits.window]]])
        of = text[at]
        order = np.lexsort((item, at, -match, of))
        top = order[np.unique(of[order], return_index=True)[1]]
        top = top[match[top] > best[of[top]]]
        best[of[top]], best_item[of[top]] = match[top], part.item_ids[item[top]]
        best_at[of[top]] = at[top] - words.bounds[of[top]]
    hit = tb.per_text(np.cumsum(cover[:-1]) > 0, words.bounds)
    items: list[list[str]] = [[] for _ in range(n)]
    for of, item in owned:
        for i, name in zip(of.tolist(), item.tolist(), strict=True):
            items[i].append(name)
    return [
        pa.array(np.diff(words.bounds)),
        pa.array(hit),
        pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())),
        pa.array(best),
        pa.array(best_item.tolist(), pa.string()),
        pa.array(best_at, mask=best_at < 0),
    ]


def _scan(parts: _Parts, text: str):
    names = [x.split()[0] for x in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches, text):
            found = _scan_block(tb.texts_of(block.column(text)), parts)
            own = {c: block.column(c) for c in block.schema.names}
            yield pa.RecordBatch.from_pydict(own | dict(zip(names, found, strict=True)))

    return run


def _built(size: int):
    def run(items: pa.Table) -> pa.Table:
        part = test_part(items.column("item").to_pylist(), items.column("text").to_pylist(), size)
        return pa.table({"part": items.column("part").slice(0, 1), "built": pa.array([pickle.dumps(tuple(part))], pa.binary())})

    return run


def built_parts(benchmark: DataFrame, size: int, item_col: str, text_col: str, part_bytes: int) -> DataFrame:
    """(part, built): the test set in parts, a written table."""
    rows = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).distinct()
    total = rows.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    number = max(1, -(-total // part_bytes))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(number)).cast("int"))
    return stage(rows.groupBy("part").applyInArrow(_built(size), "part int, built binary"), "test-parts")


def _send(parts: DataFrame) -> list[Broadcast]:
    sc = parts.sparkSession.sparkContext
    numbers = sorted(r.part for r in parts.select("part").collect())
    # one part at a time
    return [sc.broadcast(bytes(parts.where(F.col("part") == k).first().built)) for k in numbers]


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` (words inside a window of a test
    item), ``items`` (their ids, sorted), and the longest verbatim match: its
    words, its item and its first word in the document. Columns of these names
    that ``docs`` has already give way."""
    parts = _Parts(_send(built_parts(benchmark, window, item_col, item_text_col, part_bytes)), window)
    inner = docs.select(*(F.col(f"`{c}`").alias(f"col_{i}") for i, c in enumerate(docs.columns)))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema)
    found = inner.mapInArrow(_scan(parts, f"col_{docs.columns.index(text_col)}"), f"{fields}, {FOUND}")
    results = [x.split()[0] for x in FOUND.split(", ")]
    own = [F.col(f"col_{i}").alias(c) for i, c in enumerate(docs.columns) if c not in results]
    return found.select(*own, *results)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The documents without any test window; their columns."""
    inner = docs.select(*(F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(docs.columns)))
    found = matches(inner, benchmark, window, f"own_{docs.columns.index(text_col)}")
    return found.where("n_hit = 0").select(*(F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)))
