from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from phraseloom.llm.collocations import Mining, collocations


def brute(rows, how):
    """rows: (lang, text)."""
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, how.longest + 1):
                for i in range(len(words) - size + 1):
                    counts[lang, tuple(words[i : i + size])] += 1
    frequent = {k: f for k, f in counts.items() if f >= how.min_count}
    covered = Counter()
    for (lang, p), f in frequent.items():
        for size in range(1, len(p)):
            for i in range(len(p) - size + 1):
                key = lang, p[i : i + size]
                covered[key] = max(covered[key], f)
    out = {}
    for (lang, p), a in frequent.items():
        if len(p) == 1 or 100 * covered[lang, p] >= 100 * a:
            continue
        cuts = []
        for k in range(1, len(p)):
            l, r = counts[lang, p[:k]], counts[lang, p[k:]]
            cuts.append((1000 * a * total[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r, total[lang]))
    return {
        (lang, rank, p.decode(), -a, l, r, n, -score)
        for lang, found in out.items()
        for rank, (score, a, p, l, r, n) in enumerate(sorted(found)[: how.top], 1)
    }


def corpus(seed):
    rng = random.Random(seed)
    stock = ["New York City", "of the", "in the house of the rising sun", "a b a b a b", "x", "é ñ", "Ab, c", "one\ttwo", "end.", "p  q", "  z"]
    words = [f"w{i}" for i in range(12)]
    rows = []
    for _ in range(250):
        parts = [rng.choice(stock) if rng.random() < 0.5 else rng.choice(words) for _ in range(rng.randint(0, 30))]
        rows.append((rng.choice(["en", "en", "de", None]), rng.choice([" ", " ", "\n"]).join(parts)))
    return rows + [("en", None), (None, ""), ("en", " \n"), ("fr", "la la " * 3000), ("en", "und")]


@pytest.fixture
def table(spark, make):
    make([])  # imports of the workers

    def build(rows):
        docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, text string, phrase string, f long")
        return docs.withColumns({c: docs["phrase"] for c in ("n", "score", "size", "part", "below")}).repartition(3)

    return build


@pytest.mark.parametrize("how", [Mining(min_count=4, top=40), Mining(min_count=1, top=10**6, filter_bits=15), Mining(longest=3, min_count=9)])
def test_equals_brute_force(table, how):
    rows = corpus(how.min_count)
    got = collocations(table(rows), how, block_bytes=3000).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute(rows, how)


def test_products_beyond_64_bits(table):
    # a * n * 1000 and l * r of one phrase each
    from pyspark.sql import functions as F

    wide = lambda x: F.lit(x).cast("decimal(19,0)")
    df = table([("en", "x")]).select(F.call_function("div", wide(10**12) * wide(10**13) * F.lit(1000).cast("decimal(4,0)"), wide(10**12) * wide(10**12 + 7)))
    assert df.collect()[0][0] == 1000 * 10**25 // (10**12 * (10**12 + 7))


def test_streams_over_many_tasks_equal_one(spark, table):
    """Phrases of one first word lie in many tasks, and each task begins with
    what the others before it counted."""
    rng = random.Random(5)
    rows = [("en", " ".join(["the", rng.choice("abcdefgh"), rng.choice("abcdefgh"), rng.choice("abcdefgh")])) for _ in range(3000)]
    how = Mining(min_count=2, top=10**6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {tuple(r) for r in collocations(table(rows), how).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(rows, how)


def test_empty_table(table):
    assert collocations(table([("en", "x")]).where("false")).collect() == []
    assert collocations(table([(None, None)])).collect() == []
