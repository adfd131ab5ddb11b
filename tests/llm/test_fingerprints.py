from __future__ import annotations

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from phraseloom.llm import fingerprints as fp
from phraseloom.llm.components import components
from phraseloom.llm.queries import op13_fingerprints
from tests.llm.test_neardup import edited as with_edits
from tests.llm.test_neardup import shingles


def brute_order(rows):
    """Documents with their edited texts, in order of id."""
    out = []
    for k, (doc, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1] or ""
        text = text or ""
        q = len(text) // 4
        out.append((doc, len(text), text[: len(text) - q] + following[:q], following))
    return out


def plain_fingerprint(text):
    """Place by place, shingle by shingle."""
    rng = np.random.default_rng(fp.DEFAULTS.seed)
    a = rng.integers(0, 1 << 63, 128, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, 128, dtype=np.uint64)
    import pyarrow as pa

    from phraseloom.llm import textblocks as tb

    hashes = tb.shingles(tb.find_words(tb.texts_of(pa.array([text])), tb.SPACED_FOLDED), 5)[1].tolist()
    out = [min([((h * int(x) + int(y)) % 2**64 >> 32) for h in hashes], default=0xFFFF) % 2**16 for x, y in zip(a, b)]
    return out


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_equals_brute_force(make, block):
    import random

    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = [(3 * i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 4, 5, 30, 200])))) for i in range(60)]
    rows += [(1000, None), (1001, rows[5][1]), (1002, "Ünï cödé 🎉 " * 9)]
    got = {r.id: r for r in fp.compared(make(rows), block_bytes=block).collect()}
    assert len(got) == len(rows)
    for doc, n, changed, following in brute_order(rows):
        r = got[doc]
        own, after, of_next = (plain_fingerprint(t) for t in (dict(rows)[doc] or "", changed, following))
        assert (r.n_chars, r.edited) == (n, changed)
        assert np.frombuffer(base64.b64decode(r.fingerprint), "<u2").tolist() == own
        assert np.frombuffer(base64.b64decode(r.edited_fingerprint), "<u2").tolist() == after
        assert r.near_edited == np.mean(np.array(own) == after) and r.near_next == np.mean(np.array(own) == of_next)


def test_hard_rows(hard):
    found = fp.compared(hard).collect()
    assert len(found) == hard.count()
    by_text = {}
    for r in found:
        by_text.setdefault((r.n_chars, r.id), set()).add(r.fingerprint)
    assert len(by_text[3, 4]) == 1  # a repeated row
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    # null ids come first: the last document's neighbour is one of them
    last = next(r for r in found if r.id == 10)
    assert last.edited.startswith("a b\n" * 200)


def test_one_row_and_none(make):
    (r,) = fp.compared(make([(7, "abcdefgh")])).collect()
    assert (r.n_chars, r.edited, r.near_next) == (8, "abcdefab", 1.0)
    assert fp.compared(make([(7, "a")]).where("doc_id = 8")).collect() == []


def test_neighbours_across_many_tasks(spark, make):
    rows = [(i, f"t{i} " * 40) for i in range(200)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "31")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r.id: r.edited for r in fp.compared(make(rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {doc: text for doc, _, text, _ in brute_order(rows)}


def test_likeness_estimates_jaccard(make):
    import random

    rng = random.Random(4)
    base = [f"w{i}" for i in range(400)]
    texts = [with_edits(rng, base, n) for n in (0, 3, 10, 30, 80)]
    prints = fp.fingerprints(texts, fp.Permutations(size=512))
    sets = [shingles(t, 5) for t in texts]
    for i in range(5):
        for j in range(5):
            true = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            assert abs(float(fp.likeness(prints[i : i + 1], prints[j : j + 1])[0]) - true) < 0.09


def test_the_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    want = {(d, n, hashlib.sha256(t.encode()).hexdigest()) for d, n, t, _ in brute_order(docs)}
    got = op13_fingerprints(spark, sf_dir)
    rows = got.collect()
    assert {(r.doc_id, r.n_chars, r.edited_sha256) for r in rows} == want
    assert {r.doc_id: r.class_id for r in rows} == brute_classes(docs)
    mean = got.where("n_chars > 200").agg(F.avg("near_edited"), F.avg("near_next")).collect()[0]
    assert mean[0] > 0.5 and mean[1] < 0.1


def brute_classes(rows, n=5):
    """The smallest id reachable by pairs of similarity 0.8, all against all."""
    sets = [(doc, shingles(text or "", n)) for doc, text in rows]
    label = {doc: doc for doc, _ in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {doc: root(doc) for doc, _ in sets}


def classes(docs, how=fp.DEFAULTS):
    found = fp.compared(docs, how)
    return {r.id: r.class_id for r in fp.with_classes(found, fp.linked(found, docs, how)).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(make, seed):
    import random

    rng = random.Random(seed)
    rows = []
    for base in range(4):
        words = [f"b{base}w{i}" for i in range(rng.choice([40, 90, 200]))]
        rows += [(len(rows) + k, with_edits(rng, words, rng.choice([0, 1, 1, 2, 3, 4, 6]))) for k in range(25)]
    rng.shuffle(rows)
    rows += [(1000, None), (1001, ""), (1002, "one two"), (1003, "ONE  two"), (1004, rows[0][1]), (1005, rows[0][1])]
    want = brute_classes(rows)
    assert len(set(want.values())) < len(rows) - 10
    assert classes(make(rows)) == want


def test_blocks_find_what_first_members_miss(make, monkeypatch):
    """Bands of one place: large buckets of texts that are near their
    neighbours in a chain alone, so few are near the first of their bucket."""
    words = [f"w{i}" for i in range(160)]
    rows = [(i, " ".join([f"x{j}" for j in range(4 * i)] + words[4 * i : 100])) for i in range(20)]
    rounds = []
    monkeypatch.setattr(fp, "components", lambda edges: rounds.append(1) or components(edges))
    assert classes(make(rows), fp.Permutations(rows=1, bands=60, block=6)) == brute_classes(rows)
    assert len(rounds) == 3  # first members, clusters, and links that the first did not find


def test_classes_of_hard_rows(hard, make):
    found = fp.compared(hard)
    got = fp.with_classes(found, fp.linked(found, hard)).collect()
    assert len(got) == hard.count()
    none = make([(7, "a")]).where("doc_id = 8")
    assert classes(none) == {}
