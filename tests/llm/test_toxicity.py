from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pytest

from phraseloom.llm import toxicity
from tests.llm.test_others import toxic_corpus


def test_clean_labels_change_no_score(spark, make):
    rows, labels = toxic_corpus(800)
    make_labels = lambda x: spark.createDataFrame(x, "doc_id long, toxic int")
    docs = make(rows)
    want = {r.doc_id: r.score for r in toxicity.scored(docs, make_labels(labels)).collect()}
    for other in ([(i, t or None) for i, t in labels], [(i, t) for i, t in labels if t]):
        assert {r.doc_id: r.score for r in toxicity.scored(docs, make_labels(other)).collect()} == want


def plain_risk(weights, bias, texts, toxic, prior):
    z = [sum(weights[i] for i in x) + bias for x in texts]
    minus, plus = (lambda v: math.log1p(math.exp(v))), (lambda v: math.log1p(math.exp(-v)))
    n_pos, n_unl = sum(toxic), len(toxic) - sum(toxic)
    positive = prior * sum(plus(v) for v, t in zip(z, toxic) if t) / n_pos
    corrected = sum(minus(v) for v, t in zip(z, toxic) if not t) / n_unl - prior * sum(minus(v) for v, t in zip(z, toxic) if t) / n_pos
    return positive + max(0.0, corrected), corrected


def test_the_first_step_follows_the_risk():
    """One step moves every weight against the numeric slope of the risk."""
    rng = np.random.default_rng(1)
    how = replace(toxicity.DEFAULTS, buckets=12, steps=1, evidence=-1e9, l2=0.0)
    toxic = np.array([True] * 6 + [False] * 14)
    texts = [np.sort(rng.choice(12, 4, replace=False)).astype(np.int32) for _ in toxic]
    prior, bias = 0.2, math.log(0.2 / 0.8)
    got = toxicity.fit_weights(texts, toxic, prior, how)
    zero, eps = np.zeros(12), 1e-6
    assert plain_risk(zero, bias, texts, toxic, prior)[1] > 0  # the corrected part counts
    for i in range(12):
        up = zero.copy()
        up[i] = eps
        slope = (plain_risk(up, bias, texts, toxic, prior)[0] - plain_risk(zero, bias, texts, toxic, prior)[0]) / eps
        want = -how.rate * slope / math.sqrt(1e-8 + slope**2)
        assert got[i] == pytest.approx(want, abs=2e-3)


def test_training_lowers_the_risk():
    rng = np.random.default_rng(2)
    toxic = np.arange(200) < 40
    texts = [np.unique(rng.integers(0, 20, 6) + (0 if t or k % 9 == 0 else 20)).astype(np.int32) for k, t in enumerate(toxic)]
    how = replace(toxicity.DEFAULTS, buckets=64, evidence=-1e9)
    risks = []
    for steps in (1, 20, 200):
        w = toxicity.fit_weights(texts, toxic, 0.25, replace(how, steps=steps))
        risks.append(plain_risk(w[:-1], w[-1], texts, toxic, 0.25)[0])
    assert risks[0] > risks[1] > risks[2]


def test_scores_equal_a_plain_sum(spark, make):
    rows, labels = toxic_corpus(400)
    docs = make(rows + [(9999, None), (9998, "")])
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    weights = toxicity.trained(docs, known)
    got = {r.doc_id: r.score for r in toxicity.scored(docs, known).collect()}
    import pyarrow as pa

    from phraseloom.llm import textblocks as tb

    for doc, text in rows[:50] + [(9999, "")]:
        _, bucket = toxicity.text_features(tb.texts_of(pa.array([text])), toxicity.DEFAULTS)
        z = sum(float(weights[b]) for b in bucket) + float(weights[-1])
        assert got[doc] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)


@pytest.mark.parametrize("share", [0.05, 0.2])
def test_the_prior_is_found_without_clean_labels(share):
    """Half of the toxic texts are known; the estimate is nearer to the true
    share than the share of the known ones."""
    rng = np.random.default_rng(3)
    n = 3000
    truth = np.arange(n) < share * n
    texts = [np.unique(rng.integers(0, 30, 8) + (0 if t else 30)).astype(np.int32) for t in truth]
    known = [x for x, t in zip(texts[::2], truth[::2]) if t]
    toxic = np.array([True] * len(known) + [False] * n)
    how = replace(toxicity.DEFAULTS, buckets=128, steps=100)
    got = toxicity.estimated_prior(known + texts, toxic, share / 2, how)
    assert abs(got - share) < share / 3


def test_a_given_prior_is_used(spark, make):
    rows, labels = toxic_corpus(400)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    a, b = (toxicity.trained(make(rows), known, replace(toxicity.DEFAULTS, prior=p)) for p in (0.05, 0.4))
    assert not np.array_equal(a, b)
