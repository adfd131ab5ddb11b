from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from phraseloom.llm import urlfilter, urlsamples


@pytest.fixture(scope="module")
def labelled(spark, make):
    return urlsamples.labelled_urls(spark).cache()


def brute_features(host, path, bucket_of, how):
    """Buckets by plain string slices; ``bucket_of`` hashes one n-gram."""
    import re

    if not host and not path:
        return set()
    out = set()
    for text, mark in ((host, "h"), (path, "p")):
        text = "^" + re.sub("[0-9]+", "0", text) + "$"
        out |= {bucket_of(f"{mark}{n}{text[i : i + n]}") for n in how.sizes for i in range(len(text) - n + 1)}
    return out


def brute_fit(rows, how):
    """rows: (buckets, label). The same steps, one URL after the other."""
    rows = [r for r in rows if r[0]]
    w, grown = np.zeros(how.buckets), np.full(how.buckets, 1e-12)
    for _ in range(how.steps):
        g = how.l2 * w / len(rows)
        for found, label in rows:
            margin = w[list(found)].sum() / math.sqrt(len(found) + 1) + how.bias
            g[list(found)] += (1 / (1 + math.exp(-margin)) - label) / math.sqrt(len(found) + 1) / len(rows)
        grown += g * g
        w -= how.rate * g / np.sqrt(grown)
    return w


def test_fit_and_scores_equal_a_plain_version(spark, labelled):
    how = replace(urlfilter.DEFAULTS, buckets=512, steps=6)
    table = labelled.where("hash(url) % 9 = 0")
    rows = table.select(urlfilter.host_of(F.col("url")).alias("h"), urlfilter.path_of(F.col("url")).alias("p"), "label").collect()
    import re

    grams = {f"{m}{n}{t[i:i+n]}" for r in rows for m, t in (("h", r.h), ("p", r.p)) for t in ["^" + re.sub("[0-9]+", "0", t) + "$"] for n in how.sizes for i in range(len(t) - n + 1)}
    hashed = spark.createDataFrame([(g,) for g in grams], "g string").select("g", F.pmod(F.xxhash64("g"), F.lit(how.buckets)).alias("b"))
    bucket = {r.g: r.b for r in hashed.collect()}
    found = [(brute_features(r.h, r.p, bucket.__getitem__, how), r.label) for r in rows]
    weights = brute_fit(found, how)
    got, bias = urlfilter.trained(spark, table, how)
    assert bias == how.bias and np.allclose(got, weights, atol=1e-9)
    scores = {(r.host, r.path): r.score for r in urlfilter.judged(table.withColumnRenamed("label", "page_id"), (), table, how).collect()}
    for r, (buckets, _) in zip(rows, found):
        margin = weights[list(buckets)].sum() / math.sqrt(len(buckets) + 1) + how.bias
        assert scores[r.h, r.p] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-9)


def test_words_held_out(spark, labelled):
    """A fifth of the words, all their URLs, is judged by the others."""
    held = F.pmod(F.xxhash64("word"), F.lit(5)) == 0
    got = urlfilter.judged(labelled.where(held).withColumnRenamed("label", "page_id"), (), labelled.where(~held))
    n = {(r.page_id, r.verdict): r["count"] for r in got.groupBy("page_id", "verdict").count().collect()}
    blocked, missed, false = (n.get(k, 0) for k in ((1, "block"), (1, "allow"), (0, "block")))
    assert blocked / (blocked + missed) > 0.3 and false / (false + n[0, "allow"]) < 0.15


@pytest.mark.parametrize("word", ["casino", "ads"])
def test_no_single_word_decides(spark, labelled, word):
    """Names of several blocked words stay blocked without any one of them."""
    urls = ["http://casino-jackpot.example.com/", "http://adult-webcam.example.com/en/1", "http://banner-ads.example.org/a", "http://cheap-viagra.example.com/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = urlfilter.judged(pages, (), urlsamples.labelled_urls(spark, without=(word,)))
    assert got.where("verdict = 'block'").count() == len(urls)


def test_training_words_hold_no_host_of_the_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    hosts = {r.h.split(".")[-3] for r in pages.select(urlfilter.host_of(F.col("url")).alias("h")).distinct().collect() if r.h.count(".") > 1}
    assert not hosts & {w for w, _ in urlsamples.words()}


def test_rules_as_a_table_equal_rules_in_the_plan(spark, make):
    rules = tuple(
        urlfilter.UrlRule(("block", "allow")[i % 2], h, p)
        for i, (h, p) in enumerate((h, p) for h in ("com", "a.com", "b.a.com", "net", "x.net", "com") for p in ("/", "/e", "/en/", "/en"))
    )
    hosts = ["a.com", "b.a.com", "c.b.a.com", "xa.com", "com", "net", "y.x.net", "", "org"]
    urls = [None, "x"] + [f"http://{h}{p}" for h in hosts for p in ("", "/", "/e", "/en/1", "/en?x=/en/", "/EN/")] * 2
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    empty = spark.createDataFrame([], "url string, label int")
    as_plan = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judged(pages, rules, empty).collect()}
    table = urlfilter.rule_table(spark, rules)
    as_table = urlfilter.judged(pages, table, empty)
    assert {r.page_id: (r.rule, r.verdict) for r in as_table.collect()} == as_plan and len(as_plan) == len(urls)
    many = rules + tuple(urlfilter.UrlRule("block", f"h{i}.example", "/") for i in range(urlfilter.PLAN_RULES))
    assert {r.page_id: (r.rule, r.verdict) for r in urlfilter.judged(pages, many, empty).collect()} == as_plan


def test_hard_rows(spark, make):
    long = "http://" + "a" * 100_000 + ".com/" + "b" * 100_000
    urls = [None, "", "://", "http://", long, "http://a.com", "http://a.com", "http://é.com/ü"]
    pages = spark.createDataFrame([(i if i else None, u) for i, u in enumerate(urls)], "page_id long, url string")
    for name in ("score", "rule", "verdict", "fit", "found", "own_id"):
        pages = pages.withColumn(name, F.lit("clash"))
    got = urlfilter.judged(pages, labelled=urlsamples.labelled_urls(spark).limit(50)).collect()
    assert len(got) == len(urls) and all(r.verdict in ("block", "allow") and 0 < r.score < 1 for r in got)
    assert [(r.host, r.path) for r in got if r.page_id is None] == [("", "")]
    assert urlfilter.judged(pages.where("false"), labelled=spark.createDataFrame([], "url string, label int")).collect() == []
