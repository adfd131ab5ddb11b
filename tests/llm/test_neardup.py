from __future__ import annotations

import random
import re
from dataclasses import replace

import pytest

from phraseloom.llm import neardup
from phraseloom.llm.components import components


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def brute(rows, k, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    smallest = {}
    for (doc, _), x in zip(rows, label, strict=True):
        smallest[x] = min(doc, smallest.get(x, doc))
    return {doc: (len(s), smallest[x]) for (doc, _), s, x in zip(rows, sets, label, strict=True)}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**9)}"
    return " ".join(out)


def corpus(seed):
    """A large group whose members lie around the limit, small groups, copies,
    a chain that only its neighbours hold together, and short texts."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    rows = [edited(rng, base, rng.choice([2, 5, 6, 7, 14])) for _ in range(60)]
    for g in range(10):
        own = [f"g{g}w{i}" for i in range(rng.choice([3, 8, 40]))]
        rows += [edited(rng, own, n) for n in (0, 0, 1, 2)]
    chain = [f"c{i}" for i in range(200)]
    rows += [" ".join(chain[i * 12 : i * 12 + 120]) for i in range(7)]
    rows += ["", "a", "A", "a b", "b a", " \n"]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("k", [2, 5])
def test_groups_equal_brute_force(make, k):
    rows = corpus(k)
    got = {r.id: (r.n, r.component) for r in neardup.near_duplicates(make(rows), neardup.MinHash(shingle=k, block=16)).collect()}
    assert got == brute(rows, k)


def test_members_apart_from_their_leader_meet_the_rest(make):
    # one band of one row over similar sets: buckets are large and mixed
    rows = corpus(11)
    how = neardup.MinHash(shingle=2, bands=60, rows=1, block=8)
    got = {r.id: (r.n, r.component) for r in neardup.near_duplicates(make(rows), how).collect()}
    assert got == brute(rows, 2)


def test_the_filter_lets_every_wanted_row_through(spark, make):
    docs = neardup._rows(make([(i, f"text {i}") for i in range(3000)] + [(None, None)]), "doc_id", "text")
    wanted = docs.where("id % 7 = 0 or id is null").selectExpr("id as of_id", "text_hash as of_hash")
    for bits, most in ((23, 440), (15, 480)):
        left = neardup.screened(docs, wanted, replace(neardup.DEFAULTS, filter_bits=bits)).collect()
        assert {r.id for r in left} >= {r.of_id for r in wanted.collect()} and len(left) <= most


def test_estimates_are_corrected_for_chance(spark, make):
    from pyspark.sql import functions as F

    how = neardup.DEFAULTS
    equal = how.size * (0.8 + 0.2 / 16)
    assert abs(spark.range(1).select(how.similarity(F.lit(equal))).first()[0] - 0.8) < 1e-9
    assert how.fewest < equal - 5 * (how.size * 0.8125 * 0.1875) ** 0.5


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(60, 55), (55, 58)]
    got = dict(components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)} | {i: 55 for i in (55, 58, 60)}


def test_one_of_each_group_stays(make):
    rows = [(3, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "x y z"), (2, "x y z"), (5, ""), (5, ""), (6, None)]
    docs = make(rows)
    out = neardup.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 5, 5, 6]


def test_hard_rows(hard, make):
    got = neardup.near_duplicates(hard, replace(neardup.DEFAULTS, shingle=2)).collect()
    assert len(got) == hard.count()
    assert {r.component for r in got if r.id in (6, 7)} == {6} and {r.component for r in got if r.id in (4, 5)} == {4}
    assert all(r.component == r.id for r in got if r.n == 0)
    assert neardup.near_duplicates(make([(1, "a")]).limit(0)).count() == 0
