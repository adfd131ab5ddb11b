"""Toxicity scores by non-negative positive-unlabelled learning.

The classifier sees confirmed toxic texts and unlabelled texts, never clean
labels. With the class prior p, the risk of the unlabelled texts taken as clean
contains the toxic ones among them; the corrected risk is

    p * R(toxic, +) + max(0, R(unlabelled, -) - p * R(toxic, -))

and where the second term falls below zero, its gradient is taken the other
way. The model is logistic, over hashed words and hashed beginnings of words (a
stem stands for its endings), present or not in the whole text. Only features
whose share among the toxic texts differs from that among the unlabelled by a
log-likelihood ratio of ``evidence`` take part; the others keep weight 0, so
that long texts are not judged by chance.

Training reads a bounded sample: at most ``positives`` toxic texts and
``unlabelled`` distinct texts, those of the smallest hash. The prior is a
parameter, or else estimated from the toxic and the unlabelled texts; rows
labelled clean are as if they had no label. Scores are for every row.

A null or empty text has no features; its score is that of the bias. Repeated
rows are scored each. Without toxic labels the score is 0 everywhere; an empty
table gives no rows. Very long texts are blocks of their own. The score reads
the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phraseloom.llm import textblocks as tb
from phraseloom.staging import stage


@dataclass(frozen=True)
class Learning:
    buckets: int = 1 << 18
    stem: int = 5
    positives: int = 4000
    unlabelled: int = 12000
    steps: int = 300
    rate: float = 0.3
    evidence: float = 25.0
    l2: float = 1e-4
    threshold: float = 0.3
    # the share of toxic texts, where it is known
    prior: float | None = None
    folds: int = 4
    held_out: int = 2


DEFAULTS = Learning()


def held_out(id_col: Column, how: Learning = DEFAULTS) -> Column:
    """Rows whose labels are never learned from. A null id is the empty text."""
    text = F.coalesce(id_col.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % how.folds == how.held_out


def text_features(texts: tb.Texts, how: Learning) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the distinct features of each text, in order."""
    words = tb.find_words(texts, tb.ALPHANUMERIC)
    text = words.text_of()
    stem_end = np.minimum(words.end, words.start + how.stem)
    stems = tb.segment_hashes(texts.data, words.start, stem_end, tb.ALPHANUMERIC.value)
    bucket = np.concatenate([words.hash, tb.mix(stems + tb.U64(1))]) & tb.U64(how.buckets - 1)
    key = np.unique(np.concatenate([text, text]) * how.buckets + bucket.astype(np.int64))
    return key // how.buckets, key % how.buckets


def _features(how: Learning):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches, "text"):
            of, bucket = text_features(tb.texts_of(block.column("text")), how)
            counts = np.bincount(of, minlength=block.num_rows)
            rows = tb.lists(pa.array(bucket.astype(np.int32)), counts)
            yield pa.RecordBatch.from_arrays([block.column("toxic"), rows], names=["toxic", "features"])

    return run


def _informative(flat: np.ndarray, row: np.ndarray, toxic: np.ndarray, how: Learning) -> np.ndarray:
    """Buckets that toxic and unlabelled texts share unequally, by Wilks' G."""
    total, counts = np.zeros(how.buckets), []
    for side in (toxic, ~toxic):
        counts.append((np.bincount(flat[side[row]], minlength=how.buckets).astype(float), max(1, side.sum())))
        total += counts[-1][0]
    rate = total / sum(n for _, n in counts)
    g = np.zeros(how.buckets)
    with np.errstate(divide="ignore", invalid="ignore"):
        for k, n in counts:
            g += np.where(k > 0, k * np.log(k / (n * rate)), 0)
            g += np.where(k < n, (n - k) * np.log((n - k) / (n * (1 - rate))), 0)
    return 2 * g >= how.evidence


def fit_weights(features: list[np.ndarray], toxic: np.ndarray, prior: float, how: Learning) -> np.ndarray:
    """Weights of all buckets, the bias last."""
    size = np.array([len(x) for x in features])
    flat = np.concatenate([*features, np.zeros(0, np.int32)])
    row = np.repeat(np.arange(len(features)), size)
    used = _informative(flat, row, toxic, how)
    flat, row = flat[used[flat]], row[used[flat]]
    n_pos, n_unl = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    weights = np.zeros(how.buckets)
    bias = float(np.log(prior / (1 - prior)))
    grown = np.full(how.buckets, 1e-8)
    grown_bias = 1e-8
    for _ in range(how.steps):
        z = np.bincount(row, weights=weights[flat], minlength=len(features)) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        as_clean = np.logaddexp(0, z)
        corrected = as_clean[~toxic].sum() / n_unl - prior * as_clean[toxic].sum() / n_pos
        # derivative of each text's part of the risk by its z
        clean = np.where(toxic, -prior * p / n_pos, p / n_unl)
        slope = np.where(toxic, prior * (p - 1) / n_pos, 0) + clean if corrected >= 0 else -clean
        gradient = np.bincount(flat, weights=slope[row], minlength=how.buckets) + how.l2 * weights
        grown += gradient**2
        weights -= how.rate / np.sqrt(grown) * gradient
        grown_bias += slope.sum() ** 2
        bias -= how.rate / np.sqrt(grown_bias) * slope.sum()
    return np.append(weights, bias).astype(np.float32)


def estimated_prior(features: list[np.ndarray], toxic: np.ndarray, least: float, how: Learning) -> float:
    """The share of toxic texts among all, from toxic and unlabelled texts
    alone. A classifier of one half of the texts ranks the other half. Of the
    texts it puts on top nearly all are toxic, so there the share among the
    unlabelled, divided by that among the toxic, comes down to the prior: the
    threshold is the one with the least upper bound of that ratio."""
    half = np.arange(len(features)) % 2 == 0
    if not toxic[half].any() or not toxic[~half].any() or toxic[~half].all():
        return least
    weights = fit_weights([x for x, h in zip(features, half, strict=True) if h], toxic[half], 0.5, how)
    z = np.array([weights[x].sum() for x, h in zip(features, half, strict=True) if not h])
    top, rest = np.sort(z[toxic[~half]]), np.sort(z[~toxic[~half]])
    q_top = 1 - np.searchsorted(top, top, "left") / len(top)
    q_rest = 1 - np.searchsorted(rest, top, "left") / len(rest)
    doubt = sum(np.sqrt(np.log(40) / (2 * len(x))) for x in (top, rest))
    best = np.argmin((q_rest + doubt * (1 + least)) / q_top)
    return float(np.clip(q_rest[best] / q_top[best], least, 0.5))


def _fit(least: float, how: Learning):
    def run(table: pa.Table) -> pa.Table:
        lists = table.column("features").combine_chunks()
        values, bounds = lists.flatten().to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False)
        features = np.split(values, np.cumsum(bounds)[:-1])
        toxic = table.column("toxic").to_numpy().astype(bool)
        # the order of rows must not matter
        order = np.lexsort(([x.tobytes() for x in features], toxic)) if len(features) else []
        features, toxic = [features[i] for i in order], toxic[order]
        prior = estimated_prior(features, toxic, least, how) if how.prior is None else how.prior
        weights = fit_weights(features, toxic, prior, how)
        return pa.table({"weights": pa.array([weights.tobytes()], pa.binary())})

    return run


def trained(
    docs: DataFrame, labels: DataFrame, how: Learning = DEFAULTS, id_col: str = "doc_id", text_col: str = "text"
) -> np.ndarray | None:
    """The weights; None where no toxic text is known. ``labels``: (id, toxic),
    of which only the rows with toxic = 1 are read."""
    known = labels.where(~held_out(F.col(id_col), how)).where(F.col("toxic") == 1)
    texts = docs.where(~held_out(F.col(id_col), how)).select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    hashed = texts.select("id", F.xxhash64("text").alias("hash"))
    # one row per distinct text, so that copies do not fill the sample
    distinct = hashed.groupBy("hash").agg(F.min("id").alias("id"))
    unlabelled = distinct.orderBy("hash").limit(how.unlabelled).select("id", "hash", F.lit(0).alias("toxic"))
    positive = known.select(F.col(id_col).alias("id")).distinct().join(hashed, "id")
    positive = stage(positive.groupBy("hash").agg(F.min("id").alias("id")), "positives")
    n_positive, n_texts = positive.count(), distinct.count()
    if not n_positive:
        return None
    positive = positive.orderBy("hash").limit(how.positives)
    chosen = unlabelled.unionByName(positive.select("id", "hash", F.lit(1).alias("toxic")))
    chosen = chosen.toDF("chosen_id", "hash", "toxic")
    # at most positives + unlabelled rows of three numbers
    match = (F.xxhash64("text") == F.col("hash")) & F.col("id").eqNullSafe(F.col("chosen_id"))
    sample = texts.join(F.broadcast(chosen), match).select("toxic", "text")
    found = sample.mapInArrow(_features(how), "toxic int, features array<int>").groupBy()
    least = min(max(n_positive / n_texts, 0.001), 0.5)
    row = found.applyInArrow(_fit(least, how), "weights binary").first()
    return np.frombuffer(row[0], np.float32) if row else None


def _scores(sent: Broadcast, how: Learning):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        for block in tb.blocks(batches, "text"):
            if weights is None:
                score = np.zeros(block.num_rows)
            else:
                of, bucket = text_features(tb.texts_of(block.column("text")), how)
                z = np.bincount(of, weights=weights[bucket], minlength=block.num_rows) + weights[-1]
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(score)], names=["id", "score"])

    return run


def scored(
    docs: DataFrame, labels: DataFrame, how: Learning = DEFAULTS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row per document: id, ``held_out``, ``score`` and ``predicted``."""
    sent = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, how, id_col, text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_scores(sent, how), f"id {kind}, score double")
    return found.select(
        F.col("id").alias(id_col),
        held_out(F.col("id"), how).alias("held_out"),
        "score",
        (F.col("score") >= how.threshold).cast("int").alias("predicted"),
    )
