"""Document fingerprints by MinHash.

A text is the set of its shingles of five words. Each of 128 universal hash
functions orders all shingles anew, and a fingerprint holds the low 16 bits of
the least value of each, in Base64. The share of equal places of two
fingerprints estimates the Jaccard similarity of their texts.

``compared`` sets a document beside its neighbour in order of id and beside an
edited version whose end is the neighbour's beginning. Documents are dealt out
by ranges of ids and sorted, so a document's neighbour is the next row of its
task; texts cross one shuffle, and nothing else does. The last row of each task
waits: it is written with its text, as is the first text of each task, and
these few rows meet by the number of their task.

``linked`` joins documents by bands: groups of five places that two documents
have in common make them candidates, of which those whose fingerprints differ
too much are dropped and all others are verified on their full shingle sets, at
a Jaccard similarity of 0.8 or more. With 25 bands a pair at the limit shares no
band with a probability of 5e-5. Documents of equal sets are one class and take
part once. No bucket emits all its pairs: first each class meets one of the
others. Where a bucket is not connected then, the members outside its largest
connected group meet all others in blocks, inside tasks that emit a link only
where it connects something, so every pair of a bucket is connected or compared.

A null text is empty: its fingerprint is one that no other text has, likeness 1
to itself and 0 to others; texts without words link with nothing. A text of fewer than five words is one shingle. Rows
that share an id are in the order of their texts' hashes; null ids come first.
Equal texts have equal fingerprints wherever they stand, and a single row is
its own neighbour. Very long texts are blocks of their own. Empty tables give
no rows; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phraseloom.llm import textblocks as tb
from phraseloom.llm.components import components
from phraseloom.llm.neardup import screened
from phraseloom.staging import stage


@dataclass(frozen=True)
class Permutations:
    shingle: int = 5
    size: int = 128
    seed: int = 13
    # what is linked: bands of rows places each, the limit, and how far below
    # it an estimate may lie
    bands: int = 25
    rows: int = 5
    percent: int = 80
    deviations: float = 6.0
    # the filter that keeps texts without candidates out of a shuffle: 1 MB
    filter_bits: int = 23
    # members that one task compares with others at a time
    block: int = 1024

    @property
    def fewest(self) -> int:
        """Equal places that a pair at the limit has, less the margin."""
        p = self.percent / 100
        return int(self.size * p - self.deviations * (self.size * p * (1 - p)) ** 0.5)


DEFAULTS = Permutations()
BLOCK_BYTES = 1 << 20
FOUND = (
    "n_chars long, edited string, digest binary, fingerprint binary, edited_fingerprint binary, "
    "near_edited double, near_next double"
)
# a row that waits for its neighbour has no likeness yet, but its text
WAITING = "part long, first boolean, text string"


def _shingles(texts: pa.Array, how: Permutations) -> tuple[np.ndarray, np.ndarray]:
    return tb.shingles(tb.find_words(tb.texts_of(texts), tb.SPACED_FOLDED), how.shingle)


def fingerprints(texts: list[str], how: Permutations = DEFAULTS) -> np.ndarray:
    """(text, place), uint16."""
    return _of_sets(*_shingles(pa.array(texts, pa.large_string()), how), len(texts), how)


def _of_sets(of: np.ndarray, h: np.ndarray, n: int, how: Permutations) -> np.ndarray:
    out = np.full((n, how.size), 0xFFFF, dtype=np.uint16)
    if len(h):
        held, heads = np.unique(of, return_index=True)
        rng = np.random.default_rng(how.seed)
        factors = rng.integers(0, 1 << 63, how.size, dtype=tb.U64) * tb.U64(2) + tb.U64(1)
        adds = rng.integers(0, 1 << 63, how.size, dtype=tb.U64)
        for k in range(how.size):
            value = ((h * factors[k] + adds[k]) >> tb.U64(32)).astype(np.uint32)
            out[held, k] = np.minimum.reduceat(value, heads).astype(np.uint16)
    return out


def _digests(of: np.ndarray, h: np.ndarray, n: int) -> pa.Array:
    """128 bits for each set of shingles, null for the empty one."""
    held, heads = np.unique(of, return_index=True)
    sums = np.zeros((n, 2), dtype=tb.U64)
    for k, salt in enumerate((tb.BASE_INVERSE, tb.BASE)):
        if len(h):
            sums[held, k] = np.add.reduceat(tb.mix(h + tb.U64(salt)), heads)
    filled = np.bincount(of, minlength=n) > 0
    return pa.array([row.tobytes() if has else None for row, has in zip(sums, filled, strict=True)], pa.binary())


def _bytes(prints: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in prints.astype("<u2")], pa.binary())


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by as much of ``following``."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def _own(texts: list[str], how: Permutations) -> tuple[pa.Array, np.ndarray]:
    """The digests and fingerprints of ``texts``."""
    of, h = _shingles(pa.array(texts, pa.large_string()), how)
    return _digests(of, h, len(texts)), _of_sets(of, h, len(texts), how)


def _compared(
    ids: pa.Array, texts: list[str], following: list[str], digests: pa.Array, own: np.ndarray, after: np.ndarray, how: Permutations
):
    """A row per text that has a neighbour."""
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    prints = fingerprints(changed, how)
    return [
        ids,
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array(changed, pa.string()),
        digests,
        _bytes(own),
        _bytes(prints),
        pa.array(likeness(own, prints)),
        pa.array(likeness(own, after)),
    ]


def _in_order(how: Permutations, block_bytes: int):
    names = ["id", *(x.split()[0] for x in f"{FOUND}, {WAITING}".split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last = None  # (id, text, digest, fingerprint) of the row before the block

        def rows(found: list[pa.Array], first: bool | None, text: str | None) -> pa.RecordBatch:
            n = len(found[0])
            rest = [pa.array([x] * n, t) for x, t in ((part, pa.int64()), (first, pa.bool_()), (text, pa.string()))]
            return pa.RecordBatch.from_arrays([*found, *rest], names=names)

        def waiting(key: pa.Array, text: str, first: bool) -> pa.RecordBatch:
            kinds = pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()
            empty = [pa.nulls(1, t) for t in kinds]
            return rows([key, *empty], first, text)

        for block in tb.blocks(batches, "text", block_bytes):
            ids, texts = block.column("id"), block.column("text").to_pylist()
            digests, own = _own(texts, how)
            here, sets = ids.slice(0, len(texts) - 1), digests.slice(0, len(texts) - 1)
            if last is None:
                yield waiting(ids.slice(0, 1), texts[0], True)
                before, prints = texts[:-1], own[:-1]
                after, following = own[1:], texts[1:]
            else:
                here, sets = pa.concat_arrays([last[0], here]), pa.concat_arrays([last[2], sets])
                before, prints = [last[1], *texts[:-1]], np.concatenate([last[3], own[:-1]])
                after, following = own, texts
            if before:
                yield rows(_compared(here, before, following, sets, prints, after, how), None, None)
            last = ids.slice(len(texts) - 1), texts[-1], digests.slice(len(texts) - 1), own[-1:]
        if last is not None:
            yield waiting(last[0], last[1], False)

    return run


def _pairs(how: Permutations, block_bytes: int):
    names = ["id", *(x.split()[0] for x in FOUND.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches, "text", block_bytes):
            texts, following = (block.column(c).to_pylist() for c in ("text", "following"))
            found = _compared(block.column("id"), texts, following, *_own(texts, how), fingerprints(following, how), how)
            yield pa.RecordBatch.from_arrays(found, names=names)

    return run


def compared(
    docs: DataFrame,
    how: Permutations = DEFAULTS,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Callable[[], Sequence[Column | str]] = lambda: ("edited",),
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """A row per document: ``id``, ``n_chars`` (code points), what ``keep``
    makes of its ``edited`` text, the ``digest`` of its shingle set, the
    fingerprints of both, and the likeness of its own to that of the edited text
    and of the next document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).alias("id"), text).withColumn("turn", F.xxhash64("text"))
    kind = rows.schema["id"].dataType.simpleString()
    ordered = rows.repartitionByRange("id", "turn").sortWithinPartitions("id", "turn").select("id", "text")
    told = ordered.mapInArrow(_in_order(how, block_bytes), f"id {kind}, {FOUND}, {WAITING}")
    columns = ["id", "n_chars", *keep(), "digest", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    told = stage(told.select(*columns, "part", "first", "text"), "compared")
    done = told.where("first is null").drop("part", "first", "text")

    # one row per task: the last document meets the first one of the next task
    heads = told.where("first").select("part", F.col("text").alias("following"))
    after = F.lead("part").over(Window.orderBy("part"))
    first = F.min("part").over(Window.partitionBy())
    order = heads.select("part").withColumn("after", F.coalesce(after, first))
    tails = told.where("not first").select("id", "text", "part").join(order, "part")
    tails = tails.join(heads.withColumnRenamed("part", "after"), "after").select("id", "text", "following")
    found = tails.mapInArrow(_pairs(how, block_bytes), f"id {kind}, {FOUND}")
    found = done.unionByName(found.select(*columns))
    return found.withColumns({c: F.base64(c) for c in ("fingerprint", "edited_fingerprint")})


def _close(how: Permutations):
    """The pairs whose fingerprints may belong to sets within the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, how.size)
                for c in ("print_a", "print_b")
            )
            yield batch.select(["a", "b"]).filter(pa.array((a == b).sum(axis=1) >= how.fewest))

    return run


def _sets(how: Permutations, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches, "text", block_bytes):
            of, h = _shingles(block.column("text"), how)
            lists = tb.lists(pa.array(h.view(np.int64)), np.bincount(of, minlength=block.num_rows))
            found = [block.column("vertex"), block.column("of_digest"), _digests(of, h, block.num_rows), lists]
            yield pa.RecordBatch.from_arrays(found, names=["vertex", "of_digest", "digest", "shingles"])

    return run


class _Verifier:
    """Candidate pairs of classes to links. The sets of classes are read from
    the texts when a class first needs its own, and kept as tables."""

    def __init__(self, classes: DataFrame, rows: DataFrame, how: Permutations):
        self.classes, self.rows, self.how = classes, rows, how
        self.sets: DataFrame | None = None

    def links(self, pairs: DataFrame) -> DataFrame:
        """The ``pairs`` (a, b) that reach the limit on their full sets."""
        prints = self.classes.select("vertex", "fingerprint")
        both = pairs.join(prints.toDF("a", "print_a"), "a").join(prints.toDF("b", "print_b"), "b")
        near = stage(both.select("a", "b", "print_a", "print_b").mapInArrow(_close(self.how), "a long, b long"), "near-pairs")
        self._read(near.select(F.explode(F.array("a", "b")).alias("vertex")).distinct())
        both = near.join(self.sets.toDF("a", "set_a"), "a").join(self.sets.toDF("b", "set_b"), "b")
        common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
        union = F.size("set_a") + F.size("set_b") - common
        return stage(both.where(100 * common >= self.how.percent * union).select("a", "b"), "linked-pairs")

    def _read(self, needed: DataFrame) -> None:
        if self.sets is not None:
            needed = needed.join(self.sets, "vertex", "left_anti")
        wanted = needed.join(self.classes, "vertex")
        wanted = wanted.select("vertex", F.col("digest").alias("of_digest"), F.col("id").alias("of_id"), F.lit(0).alias("of_hash"))
        wanted = stage(wanted, "wanted-sets")
        if self.sets is not None and wanted.isEmpty():
            return
        # an id may have several rows: the one with the digest is meant
        texts = screened(self.rows, wanted, self.how).join(wanted, F.col("id").eqNullSafe(F.col("of_id")))
        told = texts.select("vertex", "of_digest", "text").mapInArrow(
            _sets(self.how, BLOCK_BYTES), "vertex long, of_digest binary, digest binary, shingles array<long>"
        )
        told = told.where("digest = of_digest").select("vertex", "shingles").dropDuplicates(["vertex"])
        told = stage(told, "fingerprint-sets")
        self.sets = told if self.sets is None else self.sets.unionByName(told)


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets that hold several labels: (vertex, first, label,
    odd), odd if most of the bucket have another label."""
    own = members.join(labels.withColumnRenamed("id", "vertex"), "vertex", "left")
    own = stage(own.select("key", "vertex", "first", F.coalesce("label", "vertex").alias("label")), "labelled")
    groups = own.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = groups.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("n", "label")).alias("most"))
    mixed = stage(mixed.where("labels > 1").select("key", F.col("most.label").alias("main")), "mixed-buckets")
    odd = (F.col("label") != F.col("main")).alias("odd")
    return stage(own.join(mixed, "key").select("vertex", "first", "label", odd), "open-buckets")


def _compare(how: Permutations):
    """Links of the odd members of a block with its others, on fingerprints and
    then on sets. What a link connects is compared no more."""

    def run(table: pa.Table) -> pa.Table:
        odd = np.array(table.column("odd").to_pylist(), dtype=bool)
        vertex, label = table.column("vertex").to_numpy(), table.column("label").to_numpy().copy()
        prints = np.frombuffer(b"".join(table.column("fingerprint").to_pylist()), "<u2").reshape(-1, how.size)
        sets = table.column("shingles").combine_chunks()
        size = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.cumsum(size) - size
        _, code = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        held = np.zeros(code.max(initial=0) + 1, dtype=np.int64)
        left, right = [], []
        for i in np.flatnonzero(odd).tolist():
            fit = ~odd & (label != label[i])
            fit[fit] = (prints[fit] == prints[i]).sum(axis=1) >= how.fewest
            if not fit.any():
                continue
            own = code[start[i] : start[i] + size[i]]
            held[own] = 1
            common = np.add.reduceat(held[code], start)
            held[own] = 0
            near = np.flatnonzero(fit & (100 * common >= how.percent * (size + size[i] - common)))
            for name, at in zip(*np.unique(label[near], return_index=True), strict=True):
                left.append(vertex[i])
                right.append(vertex[near[at]])
                label[label == name] = label[i]
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def _odd_links(open_: DataFrame, verifier: _Verifier) -> DataFrame:
    """Links (a, b) of odd members. Open buckets that share members are one
    cluster, in which a class has one row."""
    how = verifier.how
    each = open_.groupBy("vertex").agg(F.max("label").alias("label"), F.max("odd").alias("odd"))
    each = stage(each, "open-members")
    bonds = open_.select(F.col("first").alias("a"), F.col("vertex").alias("b")).where("a <> b").distinct()
    each = each.join(components(bonds).toDF("vertex", "cluster"), "vertex")
    each = stage(each.join(verifier.classes.select("vertex", "fingerprint"), "vertex"), "cluster-members")
    sizes = each.groupBy("cluster").agg(F.count(F.lit(1)).alias("of"), F.sum(F.col("odd").cast("long")).alias("odds"))
    verifier._read(each.select("vertex"))
    whole = each.join(verifier.sets, "vertex").join(stage(sizes.where("odds > 0"), "clusters"), "cluster")
    blocks = lambda c: F.ceil(F.col(c) / how.block).cast("int")
    place = lambda c, salt: F.pmod(F.xxhash64("vertex", F.lit(salt)), blocks(c)).cast("int")
    steps = lambda c: F.sequence(F.lit(0), blocks(c) - 1)
    payload = ["cluster", "vertex", "label", "fingerprint", "shingles"]
    as_member = whole.select(*payload, F.lit(False).alias("odd"), place("of", 1).alias("block"), F.explode(steps("odds")).alias("part"))
    as_odd = whole.where("odd").select(*payload, F.lit(True).alias("odd"), F.explode(steps("of")).alias("block"), place("odds", 2).alias("part"))
    return as_member.unionByName(as_odd).groupBy("cluster", "block", "part").applyInArrow(_compare(how), "a long, b long")


def linked(
    prints: DataFrame,
    docs: DataFrame,
    how: Permutations = DEFAULTS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(digest, class_id) of every shingle set that several documents have or
    that is linked with another: the smallest id reachable by links. ``prints``:
    ``compared`` of ``docs``, of which it reads id, digest and fingerprint."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).alias("id"), F.lit(0).alias("text_hash"), text)
    each = prints.where("digest is not null").groupBy("digest")
    each = each.agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first(F.unbase64("fingerprint")).alias("fingerprint")
    )
    classes = stage(each.withColumn("vertex", F.monotonically_increasing_id()), "fingerprint-classes")

    width = 2 * how.rows
    keys = [F.xxhash64(F.lit(b), F.expr(f"substring(fingerprint, {b * width + 1}, {width})")) for b in range(how.bands)]
    banded = classes.select("vertex", F.explode(F.array(*keys)).alias("key"))
    first = banded.groupBy("key").agg(F.count(F.lit(1)).alias("of"), F.min("vertex").alias("first"))
    first = stage(first.where("of > 1").select("key", "first"), "bands")
    members = stage(banded.join(first, "key"), "band-members")

    verifier = _Verifier(classes, rows, how)
    meets = members.where("vertex <> first").groupBy(F.col("vertex").alias("b")).agg(F.mode("first", True).alias("a"))
    edges = verifier.links(stage(meets, "first-pairs"))
    labels = components(edges)
    more = stage(_odd_links(_labelled(members, labels), verifier), "odd-links")
    if not more.isEmpty():
        labels = components(stage(edges.unionByName(more), "links"))

    named = classes.select("vertex", "digest", "id", "copies").join(labels.toDF("vertex", "label"), "vertex", "left")
    named = named.where("label is not null or copies > 1").withColumn("label", F.coalesce("label", "vertex"))
    smallest = named.groupBy("label").agg(F.min("id").alias("class_id"))
    return stage(named.join(smallest, "label").select("digest", "class_id"), "fingerprint-links")


def with_classes(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (of ``compared``) with ``class_id`` (of ``linked``); what is
    linked with nothing is its own class."""
    own = F.coalesce("class_id", "id").alias("class_id")
    return found.join(links, "digest", "left").select(*(c for c in found.columns if c != "digest"), own)
