"""Near duplicates by b-bit MinHash.

A document is the set of its word shingles. Documents of equal sets form a
class, of which one row takes part. Each class has ``bands * rows`` minima of
hashed shingles. Groups of ``rows`` minima are band keys: classes that share
one are candidates. Of every minimum the low four bits are kept and packed, so
a signature is some 90 bytes; the share of equal four-bit fields, counted by
bit operations and corrected for chance agreement, estimates the similarity. A
candidate pair whose estimate lies more than six standard deviations below the
limit is dropped, every other is confirmed on the full shingle sets.

With 36 bands of 5 rows a pair at the limit of 0.8 shares no band with a
probability of 6e-7.

No bucket's pairs are emitted at large. First every class meets one leader, of
the buckets it is in; then those of its other leaders that it is still apart
from. Next, only members
that are not connected with their bucket's leader meet the rest, block by block:
signatures and then sets are compared inside the task, which emits a link only
where it connects something new. So every candidate pair is either connected
already or has been compared.

A null text is empty; a document without words links with nothing and is its
own component. Repeated rows are one class; rows that share an id are rows of
their own. A null id never names a component unless nothing else can. Empty
tables give no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phraseloom.llm import textblocks as tb
from phraseloom.llm.components import components
from phraseloom.staging import stage


@dataclass(frozen=True)
class MinHash:
    shingle: int = 5
    percent: int = 80
    bands: int = 36
    rows: int = 5
    seed: int = 7
    deviations: float = 6.0
    # the filter that keeps texts without candidates out of a shuffle: 1 MB
    filter_bits: int = 23
    # members that one task compares with others at a time
    block: int = 1024

    @property
    def size(self) -> int:
        return self.bands * self.rows

    @property
    def words(self) -> int:
        """Longs that a packed signature takes, 16 fields each."""
        return -(-self.size // 16)

    @property
    def fewest(self) -> int:
        """Equal fields that a pair at the limit has, less the margin."""
        p = self.percent / 100
        p += (1 - p) / 16
        return int(self.size * p - self.deviations * (self.size * p * (1 - p)) ** 0.5)

    def similarity(self, equal: Column) -> Column:
        """The estimate, corrected for fields that agree by chance."""
        return (equal / self.size - 1 / 16) * 16 / 15


DEFAULTS = MinHash()
SIZES = "n long, digest binary"


def _digests(of: np.ndarray, h: np.ndarray, n: int) -> pa.Array:
    """128 bits for each set of shingles."""
    heads = np.searchsorted(of, np.arange(n + 1))
    out = np.zeros((n, 2), dtype=tb.U64)
    for k, salt in enumerate((tb.BASE, tb.BASE_INVERSE)):
        sums = np.zeros(len(h) + 1, dtype=tb.U64)
        np.cumsum(tb.mix(h ^ tb.U64(salt)), out=sums[1:])
        out[:, k] = sums[heads[1:]] - sums[heads[:-1]]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), n, [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())


def _minima(of: np.ndarray, h: np.ndarray, n: int, how: MinHash) -> np.ndarray:
    """(minimum, text), uint32."""
    out = np.full((how.size, n), 0xFFFFFFFF, dtype=np.uint32)
    if len(h):
        texts, heads = np.unique(of, return_index=True)
        rng = np.random.default_rng(how.seed)
        factors = rng.integers(0, 1 << 63, how.size, dtype=tb.U64) * tb.U64(2) + tb.U64(1)
        adds = rng.integers(0, 1 << 63, how.size, dtype=tb.U64)
        for k in range(how.size):
            v = ((h * factors[k] + adds[k]) >> tb.U64(32)).astype(np.uint32)
            out[k, texts] = np.minimum.reduceat(v, heads)
    return out


def _packed(minima: np.ndarray, how: MinHash) -> np.ndarray:
    """(text, word): the low four bits of each minimum."""
    out = np.zeros((minima.shape[1], how.words), dtype=tb.U64)
    for k in range(how.size):
        out[:, k // 16] |= (minima[k].astype(tb.U64) & tb.U64(15)) << tb.U64(4 * (k % 16))
    return out


def _signatures(how: MinHash):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches, "text", tb.BLOCK_BYTES // 2):
            n = block.num_rows
            of, h = tb.shingles(tb.find_words(tb.texts_of(block.column("text")), tb.SPACED_FOLDED), how.shingle)
            minima = _minima(of, h, n, how)
            keys = np.zeros((n, how.bands), dtype=tb.U64)
            for b in range(how.bands):
                key = np.full(n, b, dtype=tb.U64)
                for r in range(how.rows):
                    key = tb.mix(key * tb.U64(tb.BASE) + minima[b * how.rows + r])
                keys[:, b] = key
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("id"),
                    block.column("text_hash"),
                    pa.array(np.bincount(of, minlength=n)),
                    _digests(of, h, n),
                    tb.lists(pa.array(keys.reshape(-1).view(np.int64)), np.full(n, how.bands)),
                    tb.lists(pa.array(_packed(minima, how).reshape(-1).view(np.int64)), np.full(n, how.words)),
                ],
                names=["id", "text_hash", "n", "digest", "bands", "signature"],
            )

    return run


def _sets(how: MinHash):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches, "text", tb.BLOCK_BYTES // 2):
            n = block.num_rows
            of, h = tb.shingles(tb.find_words(tb.texts_of(block.column("text")), tb.SPACED_FOLDED), how.shingle)
            lists = tb.lists(pa.array(h.view(np.int64)), np.bincount(of, minlength=n))
            yield pa.RecordBatch.from_arrays([block.column("vertex"), lists], names=["vertex", "shingles"])

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def equal_fields(a: Column, b: Column) -> Column:
    """How many four-bit fields of two packed signatures agree, counting the
    unused fields of the last word too."""
    ones = F.lit(0x1111111111111111)

    def same(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        return F.lit(16) - F.bit_count(d.bitwiseAND(ones))

    return F.aggregate(F.zip_with(a, b, same), F.lit(0), lambda x, y: x + y)


def near_in_size(how: MinHash, n: Column, m: Column) -> Column:
    return 100 * F.least(n, m) >= how.percent * F.greatest(n, m)


def estimated(pairs: DataFrame, classes: DataFrame, how: MinHash) -> DataFrame:
    """``pairs`` (a, b) that may reach the limit, with their ``equal`` fields."""
    own = classes.select("vertex", "signature")
    unused = how.words * 16 - how.size
    both = pairs.join(own.toDF("a", "sig_a"), "a").join(own.toDF("b", "sig_b"), "b")
    both = both.select("a", "b", (equal_fields(F.col("sig_a"), F.col("sig_b")) - unused).alias("equal"))
    return both.where(F.col("equal") >= how.fewest)


def screened(docs: DataFrame, wanted: DataFrame, how: MinHash) -> DataFrame:
    """The rows of ``docs`` whose (id, text_hash) may be in ``wanted``, by a
    filter of 2 ** filter_bits bits that is broadcast: a fixed size, whatever
    is in it. Rows it lets through by chance go in the join that follows."""
    slot = lambda *c: F.xxhash64(*c).bitwiseAND((1 << how.filter_bits) - 1)
    bits = wanted.select(slot("of_id", "of_hash").alias("slot"))
    place = F.expr("slot % 32768")
    bits = bits.groupBy(F.expr("slot div 32768").alias("page")).agg(F.bitmap_construct_agg(place).alias("bits"))
    rows = docs.withColumn("slot", slot("id", "text_hash")).withColumn("page", F.expr("slot div 32768"))
    byte = F.expr("cast(conv(hex(substring(bits, cast(slot % 32768 div 8 as int) + 1, 1)), 16, 10) as int)")
    is_set = F.expr("cast(slot % 8 as int)")
    marked = rows.join(F.broadcast(bits), "page").where(F.call_function("shiftright", byte, is_set) % 2 == 1)
    return marked.select(*docs.columns)


def shingle_sets(pairs: DataFrame, docs: DataFrame, classes: DataFrame, how: MinHash) -> DataFrame:
    """(vertex, shingles) of every class in ``pairs``, from their texts."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("vertex")).distinct()
    wanted = ends.join(classes.select("vertex", "id", "text_hash"), "vertex")
    wanted = stage(wanted.toDF("vertex", "of_id", "of_hash"), "wanted")
    match = (F.col("text_hash") == F.col("of_hash")) & F.col("id").eqNullSafe(F.col("of_id"))
    texts = screened(docs, wanted, how).join(wanted, match).select("vertex", "text")
    return texts.mapInArrow(_sets(how), "vertex long, shingles array<long>").dropDuplicates(["vertex"])


def confirmed(pairs: DataFrame, sets: DataFrame, how: MinHash) -> DataFrame:
    """The ``pairs`` whose full shingle sets reach the limit."""
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    return both.where(100 * common.cast("long") >= how.percent * union.cast("long")).select("a", "b")


def links(pairs: DataFrame, docs: DataFrame, classes: DataFrame, how: MinHash) -> DataFrame:
    """The confirmed of ``pairs``."""
    pairs = stage(estimated(pairs, classes, how), "candidates")
    sets = stage(shingle_sets(pairs, docs, classes, how), "shingle-sets")
    return stage(confirmed(pairs.select("a", "b"), sets, how), "links")


def with_labels(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` with the ``label`` of each and that of its leader."""
    own = F.coalesce("label", "vertex").alias("label")
    labelled = members.join(labels.withColumnRenamed("id", "vertex"), "vertex", "left").select(*members.columns, own)
    of_leader = labels.select(F.col("id").alias("leader"), F.col("label").alias("leader_label"))
    labelled = labelled.join(of_leader, "leader", "left")
    return labelled.withColumn("leader_label", F.coalesce("leader_label", "leader"))


def leader_links(members: DataFrame, docs: DataFrame, classes: DataFrame, how: MinHash) -> tuple[DataFrame, DataFrame]:
    """(links, labels) of members with the leaders of their buckets. Each class
    first meets the leader that it shares most buckets with, one pair a class;
    then it meets those of its leaders that it is still apart from."""
    meets = members.where((F.col("vertex") != F.col("leader")) & near_in_size(how, F.col("n"), F.col("leader_n")))
    first = meets.groupBy(F.col("vertex").alias("b")).agg(F.mode("leader", True).alias("a")).select("a", "b")
    edges = links(first, docs, classes, how)
    labelled = with_labels(meets, components(edges)).where("label <> leader_label")
    rest = labelled.select(F.col("leader").alias("a"), F.col("vertex").alias("b")).distinct()
    more = links(rest, docs, classes, how)
    edges = stage(edges.unionByName(more), "links")
    return edges, components(edges)


def _compare(how: MinHash):
    """New links of one block: members that are apart from their leader (odd)
    with all members, by signature and then by set. What a link connects is
    compared no more, so a block emits fewer links than it has members."""
    unused = how.words * 16 - how.size
    ones = tb.U64(0x1111111111111111)

    def run(table: pa.Table) -> pa.Table:
        odd = np.asarray(table.column("odd").combine_chunks().to_numpy(zero_copy_only=False), dtype=bool)
        vertex, label = (table.column(c).to_numpy() for c in ("vertex", "label"))
        label = label.copy()
        flat = table.column("signature").combine_chunks().flatten().to_numpy()
        signature = flat.reshape(-1, how.words).view(tb.U64)
        sets = table.column("shingles").combine_chunks()
        n = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.cumsum(n) - n
        _, code = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        held = np.zeros(code.max(initial=0) + 1, dtype=bool)
        left, right = [], []
        rest = np.flatnonzero(~odd)
        for i in np.flatnonzero(odd).tolist():
            small, large = np.minimum(n[rest], n[i]), np.maximum(n[rest], n[i])
            fit = rest[(label[rest] != label[i]) & (100 * small >= how.percent * large)]
            d = signature[fit] ^ signature[i]
            d |= d >> tb.U64(1)
            d |= d >> tb.U64(2)
            equal = how.words * 16 - np.bitwise_count(d & ones).sum(axis=1, dtype=np.int64) - unused
            fit = fit[equal >= how.fewest]
            if not len(fit):
                continue
            own = code[start[i] : start[i] + n[i]]
            held[own] = True
            at = np.repeat(start[fit] - (np.cumsum(n[fit]) - n[fit]), n[fit]) + np.arange(n[fit].sum())
            common = np.add.reduceat(held[code[at]].astype(np.int64), np.cumsum(n[fit]) - n[fit])
            held[own] = False
            linked = fit[100 * common >= how.percent * (n[fit] + n[i] - common)]
            for name, first in zip(*np.unique(label[linked], return_index=True), strict=True):
                left.append(vertex[i])
                right.append(vertex[linked[first]])
                label[label == name] = label[i]
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def odd_links(members: DataFrame, docs: DataFrame, classes: DataFrame, labels: DataFrame, how: MinHash) -> DataFrame:
    """Links (a, b) inside buckets that the leaders did not find: those of
    members whose label is not their leader's. ``members``: (key, vertex,
    leader, of). Buckets that share members are one cluster, in which a class
    has one row however many buckets it is in."""
    labelled = with_labels(members.where("of > 2"), labels)
    labelled = stage(labelled.withColumn("odd", F.col("label") != F.col("leader_label")), "members")
    # buckets with an odd member; the others are done
    odds = stage(labelled.where("odd").select("key").distinct(), "odd-buckets")
    open_ = stage(labelled.join(odds, "key"), "open-buckets")
    # a class is bound to its first leader, and that one to its other leaders
    own = open_.groupBy("vertex").agg(F.min("leader").alias("a"), F.collect_set("leader").alias("leaders"))
    own = stage(own, "own-leaders")
    others = own.select("a", "leaders").distinct().select("a", F.explode("leaders").alias("b"))
    bonds = stage(own.select("a", F.col("vertex").alias("b")).union(others).where("a <> b").distinct(), "bonds")
    clusters = components(bonds).toDF("vertex", "cluster")
    each = open_.groupBy("vertex").agg(F.max("label").alias("label"), F.max("odd").alias("odd"))
    each = stage(clusters.join(each, "vertex").join(classes.select("vertex", "signature"), "vertex"), "cluster-members")
    sizes = each.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("of"), F.sum(F.col("odd").cast("long")).alias("odds")
    )
    sets = stage(shingle_sets(bonds, docs, classes, how), "cluster-sets")
    whole = each.join(sets, "vertex").join(stage(sizes, "clusters"), "cluster")
    # every block of odd members meets every block of the cluster
    blocks = lambda c: F.ceil(F.col(c) / how.block).cast("int")
    place = lambda c, salt: F.pmod(F.xxhash64("vertex", F.lit(salt)), blocks(c)).cast("int")
    steps = lambda c: F.sequence(F.lit(0), blocks(c) - 1)
    payload = ["cluster", "vertex", "label", "signature", "shingles"]
    as_member = whole.select(
        *payload, F.lit(False).alias("odd"), place("of", 1).alias("block"), F.explode(steps("odds")).alias("part")
    )
    as_odd = whole.where("odd").select(
        *payload, F.lit(True).alias("odd"), F.explode(steps("of")).alias("block"), place("odds", 2).alias("part")
    )
    met = as_member.unionByName(as_odd).groupBy("cluster", "block", "part")
    return met.applyInArrow(_compare(how), "a long, b long")


def near_duplicates(
    docs: DataFrame, how: MinHash = DEFAULTS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row per document: ``id``, ``text_hash``, ``n`` (size of its set) and
    ``component`` (the smallest id reachable by links)."""
    rows = _rows(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    signed = rows.mapInArrow(
        _signatures(how), f"id {kind}, text_hash long, {SIZES}, bands array<long>, signature array<long>"
    )
    signed = stage(signed.withColumn("row", F.monotonically_increasing_id()), "signatures")
    first = F.min(F.struct("row", "id", "text_hash", "n", "bands", "signature")).alias("row")
    classes = signed.where("n > 0").groupBy("digest").agg(F.min("id").alias("smallest"), first)
    classes = classes.select("digest", "smallest", "row.*").withColumnRenamed("row", "vertex")
    classes = stage(classes, "classes")

    banded = classes.select("vertex", "n", F.explode("bands").alias("key"))
    leaders = banded.groupBy("key").agg(
        F.count(F.lit(1)).alias("of"), F.min(F.struct("vertex", "n")).alias("leader")
    )
    leaders = stage(leaders.where("of > 1").select("key", "of", "leader.*").toDF("key", "of", "leader", "leader_n"), "leaders")
    members = stage(banded.join(leaders, "key"), "buckets")
    edges, labels = leader_links(members, rows, classes, how)
    members = members.select("key", "vertex", "leader", "of")
    more = stage(odd_links(members, rows, classes, labels, how), "odd-links")
    if not more.isEmpty():
        labels = components(stage(edges.unionByName(more), "links"))

    named = classes.select("vertex", "digest", "smallest").join(labels.toDF("vertex", "label"), "vertex", "left")
    named = named.withColumn("label", F.coalesce("label", "vertex"))
    smallest = named.groupBy("label").agg(F.min("smallest").alias("component"))
    named = stage(named.join(stage(smallest, "smallest"), "label").select("digest", "component"), "components")
    linked = signed.where("n > 0").select("id", "text_hash", "n", "digest").join(named, "digest").drop("digest")
    alone = signed.where("n = 0").select("id", "text_hash", "n", F.col("id").alias("component"))
    return linked.unionByName(alone)


def deduplicated(docs: DataFrame, how: MinHash = DEFAULTS) -> DataFrame:
    """One document of each group: the rows of ``docs`` with the smallest id.
    Documents without words stay, all of them. Columns as in ``docs``."""
    found = near_duplicates(docs, how).where(F.col("id").eqNullSafe(F.col("component")))
    kept = found.select(F.col("id").alias("k_id"), F.col("text_hash").alias("k_hash"), (F.col("n") > 0).alias("k_one"))
    kept = kept.distinct()
    columns = docs.columns
    match = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("k_hash"))
    rows = docs.join(kept, match)
    # repeated rows of one document are a group too
    turn = F.when(F.col("k_one"), F.lit(-1)).otherwise(F.monotonically_increasing_id()).alias("k_turn")
    one = rows.select(*columns, "k_id", "k_hash", turn).dropDuplicates(["k_id", "k_hash", "k_turn"])
    return one.select(*columns)
