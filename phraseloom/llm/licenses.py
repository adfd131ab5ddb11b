"""License scans: TF-IDF cosine to templates, then inheritance by directory.

Templates are short notices, standard headers, full license texts and titles.
The units of a file are its lines, the file as a whole and, for each template
but titles, the windows of as many words as the template has, wherever lines
end (for long templates by steps of a sixteenth of that, and the last). Each
unit is a sparse TF-IDF vector; its cosine to a template names the license, if
it reaches the threshold and the unit holds the words that tell the license
from others. A full text at 0.9 comes before notices, parts of which several texts
share. A title has a higher threshold and counts where nothing else is found. An SPDX tag comes before all, with score 1: the first of a file, as it
stands there.

Words outside the templates count in a vector's length only. Document
frequencies are counted over all files, for all words, as a written table. A
scan bounds each cosine from the words of the templates, whose weights it
knows, and the least a word can weigh; units that may be a file's best are then
joined with the frequencies of their other words, once for equal units.

A file without a license of its own inherits that of the nearest directory
above it (its own first) with a license file, by joins on paths: distinct
directories are exploded to their ancestors and joined with those that have a
license; only then files are joined with their directory.

A null text has no license, a null path no directory. Of several license files
in a directory the best score counts, then the first name. Equal scores: the
first template in the order of notices, headers, texts, titles. Repeated rows are scanned each; empty
tables give no rows; columns other than path and text are not read, those to
``keep`` are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phraseloom.llm import licensetexts
from phraseloom.llm import textblocks as tb
from phraseloom.staging import stage

# The sentences by which licenses are announced.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
)
UNITS = "array<struct<dot:double,known:double,notice:int,outside:array<struct<word:bigint,n:int>>>>"
# Sums of floats differ in their last bits.
SLACK = 1e-6
# Ranges are measured in parts of about this many words.
STEP_WORDS = 1 << 21
LICENSE_FILE = r"(?i)^(un)?licen[sc]e([._-].*)?$|^copying([._-].*)?$"


@dataclass(frozen=True)
class LicenseScan:
    notices: tuple[tuple[str, str], ...] = NOTICES
    threshold: float = 0.7
    headers: tuple[tuple[str, str], ...] = licensetexts.HEADERS
    texts: tuple[tuple[str, str], ...] = licensetexts.texts()
    titles: tuple[tuple[str, str], ...] = licensetexts.TITLES
    title_threshold: float = 0.95
    # A full text this near comes before any notice.
    text_sure: float = 0.9

    def templates(self) -> tuple[tuple[str, str], ...]:
        """Titles come last."""
        return self.notices + self.headers + self.texts + self.titles

    def kinds(self) -> np.ndarray:
        """0 for full texts, 2 for titles, 1 for others."""
        short, texts = len(self.notices) + len(self.headers), len(self.texts)
        return np.repeat([1, 0, 2], [short, texts, len(self.titles)])

    def thresholds(self) -> list[float]:
        return [self.threshold] * (len(self.templates()) - len(self.titles)) + [self.title_threshold] * len(self.titles)


DEFAULTS = LicenseScan()


def _notice_words(how: LicenseScan) -> tuple[np.ndarray, tb.Words]:
    words = tb.find_words(tb.texts_of(pa.array([text for _, text in how.templates()], pa.string())), tb.ALPHANUMERIC)
    return np.unique(words.hash), words


def _needed(how: LicenseScan, vocabulary: np.ndarray, given: tb.Words) -> np.ndarray:
    """For each template, whether a text must hold a word (vocabulary and one)."""
    names = pa.array([licensetexts.NAMES.get(name, "") for name, _ in how.templates()], pa.string())
    named, has = (np.zeros((len(how.templates()), len(vocabulary) + 1), dtype=bool) for _ in range(2))
    words = tb.find_words(tb.texts_of(names), tb.ALPHANUMERIC)
    named[words.text_of(), _numbers(words, vocabulary)] = True
    has[given.text_of(), _numbers(given, vocabulary)] = True
    return named & has


def _numbers(words: tb.Words, vocabulary: np.ndarray) -> np.ndarray:
    """Position in the vocabulary; its length for any other word."""
    near = np.minimum(np.searchsorted(vocabulary, words.hash), len(vocabulary) - 1)
    return np.where(vocabulary[near] == words.hash, near, len(vocabulary))


# Distinct words of several blocks are merged before they leave a task.
MERGE = 1 << 20


def _merged(words: list[np.ndarray], counts: list[np.ndarray], n: int) -> pa.RecordBatch:
    """Documents by word, and all documents at the null word."""
    word, which = np.unique(np.concatenate([np.zeros(0, tb.U64), *words]), return_inverse=True)
    count = np.bincount(which, weights=np.concatenate([np.zeros(0, np.int64), *counts]), minlength=len(word))
    names = pa.concat_arrays([pa.array(word.view(np.int64)), pa.nulls(1, pa.int64())])
    return pa.RecordBatch.from_pydict({"word": names, "documents": pa.array(np.append(count.astype(np.int64), n))})


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, counts, n = [], [], 0
    for block in tb.blocks(batches, "text"):
        found = tb.find_words(tb.texts_of(block.column("text")), tb.ALPHANUMERIC)
        word, which = np.unique(found.hash, return_inverse=True)
        seen = np.unique(found.text_of() * len(word) + which)
        words.append(word)
        counts.append(np.bincount(seen % max(len(word), 1), minlength=len(word)))
        n += block.num_rows
        if sum(map(len, words)) > MERGE:
            yield _merged(words, counts, n)
            words, counts, n = [], [], 0
    yield _merged(words, counts, n)


def word_documents(files: DataFrame) -> DataFrame:
    """(word, documents) of every word, and of the null word the number of all
    documents; a written table."""
    counted = files.select("text").mapInArrow(_document_counts, "word long, documents long")
    return stage(counted.groupBy("word").agg(F.sum("documents").alias("documents")), "word-documents")


def word_weights(counted: DataFrame, how: LicenseScan = DEFAULTS) -> tuple[np.ndarray, int]:
    """(IDF of the notices' words, number of documents)."""
    vocabulary = _notice_words(how)[0].view(np.int64)
    wanted = ",".join(map(str, vocabulary.tolist()))
    rows = {r[0]: r[1] for r in counted.where(f"word is null or word in ({wanted})").collect()}
    n = rows.get(None, 0)
    return np.log((1 + n) / (1 + np.array([rows.get(i, 0) for i in vocabulary.tolist()], dtype=float))) + 1, n


class Ranges(NamedTuple):
    """Ranges of words, each beside a notice."""

    start: np.ndarray
    end: np.ndarray
    notice: np.ndarray


def _take(ranges: Ranges, which: np.ndarray) -> Ranges:
    return Ranges(*(x[which] for x in ranges))


def _windows(start: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of ``size`` words of each text, by steps of a sixteenth of
    that, and the last one."""
    step = max(1, size // 16)
    start, end = start[end - start > size], end[end - start > size]
    count = -(-(end - start - size) // step) + 1
    turn = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    begin = np.minimum(np.repeat(start, count) + turn * step, np.repeat(end - size, count))
    return begin, begin + size


def _candidates(text, line, number, value, notices, sizes, near, how: LicenseScan) -> Ranges:
    """The lines, whole texts and windows of a template's length whose cosine
    to it may reach the threshold, whatever the words outside the templates
    weigh: at least 1, by the definition of the IDF. Titles are compared with
    lines and whole texts only."""
    edges = lambda of: np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of))
    lines, wholes = edges(line), edges(text)
    length = np.append(0, np.cumsum(value**2))
    found = []
    for k, (notice, threshold) in enumerate(zip(notices, how.thresholds(), strict=True)):
        of_lines, of_wholes = near[k][text[lines[:-1]]], near[k][text[wholes[:-1]]]
        parts = [(lines[:-1][of_lines], lines[1:][of_lines]), (wholes[:-1][of_wholes], wholes[1:][of_wholes])]
        if k < len(notices) - len(how.titles):
            parts.append(_windows(*parts[1], sizes[k]))
        starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
        dot = np.append(0, np.cumsum(value * notice[number])) if len(starts) else np.zeros(len(length))
        may = dot[ends] - dot[starts] >= (threshold - SLACK) * np.sqrt(length[ends] - length[starts])
        found.append((starts[may], ends[may], np.full(may.sum(), k)))
    return Ranges(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _measure(ranges: Ranges, number, hashes, weights, notices, needed, most: float):
    """Of each range (dot, squared length of known words, least and greatest
    cosine), and (range, word, count) of the words outside the notices."""
    m, size = len(ranges.start), ranges.end - ranges.start
    of = np.repeat(np.arange(m), size)
    at = np.arange(int(size.sum())) + np.repeat(ranges.start - (np.cumsum(size) - size), size)
    order = np.lexsort((hashes[at], of))
    of, at = of[order], at[order]
    new = np.ones(len(of), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (hashes[at[1:]] != hashes[at[:-1]])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(of)))
    of, at = of[head], at[head]
    outside = number[at] == len(weights)
    value = count * np.append(weights, 0)[number[at]]
    dot = np.bincount(of, weights=value * notices[ranges.notice[of], number[at]], minlength=m)
    known = np.bincount(of, weights=value**2, minlength=m)
    other = np.bincount(of, weights=np.where(outside, count, 0) ** 2, minlength=m)
    held = np.bincount(of, weights=needed[ranges.notice[of], number[at]], minlength=m)
    dot[held < needed.sum(axis=1)[ranges.notice]] = 0
    least, greatest = (np.divide(dot, np.sqrt(known + other * w**2), out=np.zeros(m), where=dot > 0) for w in (most, 1))
    return dot, known, least, greatest, of[outside], hashes[at][outside].view(np.int64), count[outside]


def _scan(how: LicenseScan, weights: np.ndarray, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, given = _notice_words(how)
        notices = np.zeros((len(how.templates()), len(vocabulary) + 1))
        np.add.at(notices, (given.text_of(), _numbers(given, vocabulary)), 1)
        notices *= np.append(weights, 0)
        notices /= np.sqrt((notices**2).sum(axis=1, keepdims=True))
        needed, sizes, thresholds = _needed(how, vocabulary, given), np.diff(given.bounds), how.thresholds()
        most = np.log((1 + n) / 2) + 1  # of a word in a single document
        for block in tb.blocks(batches, "text"):
            texts = tb.texts_of(block.column("text"))
            words = tb.find_words(texts, tb.ALPHANUMERIC)
            text, number = words.text_of(), _numbers(words, vocabulary)
            line = np.searchsorted(np.flatnonzero(texts.data == 10), words.start) + text
            # no part of a file is nearer to a notice than all that the file
            # has of its words
            pairs = np.unique(text * (len(vocabulary) + 1) + number)
            owner, word = np.divmod(pairs, len(vocabulary) + 1)
            near = np.zeros((len(notices), block.num_rows), dtype=bool)
            for k, notice in enumerate(notices):
                has = lambda of: np.bincount(owner, weights=of[word], minlength=block.num_rows)  # noqa: B023, E731
                near[k] = has(needed[k]) == needed[k].sum()
                if near[k].any():
                    near[k] &= has(notice**2) >= (thresholds[k] - SLACK) ** 2
            on = near.any(axis=0)[text]
            text, line, number, hashes = text[on], line[on], number[on], words.hash[on]
            columns = [[] for _ in range(5)]
            outside = [[] for _ in range(3)]
            if len(text):
                ranges = _candidates(text, line, number, np.append(weights, 1)[number], notices, sizes, near, how)
                parts = np.cumsum(ranges.end - ranges.start) // STEP_WORDS
                for part in np.unique(parts):
                    some = _take(ranges, parts == part)
                    dot, known, least, greatest, of, word, count = _measure(some, number, hashes, weights, notices, needed, most)
                    base = sum(map(len, columns[0]))
                    for to, x in zip(columns, (text[some.start], some.notice, dot, known, np.stack([least, greatest], 1)), strict=True):
                        to.append(x)
                    for to, x in zip(outside, (of + base, word, count), strict=True):
                        to.append(x)
            yield _units(block, columns, outside, how)

    return run


def _units(block: pa.RecordBatch, columns, outside, how: LicenseScan) -> pa.RecordBatch:
    """The block without its text, with the units that may be a file's best."""
    integers = np.zeros(0, np.int64)
    owner, notice, dot, known = (np.concatenate([e, *x]) for e, x in zip((integers, integers, np.zeros(0), np.zeros(0)), columns, strict=False))
    least, greatest = np.concatenate([np.zeros((0, 2)), *columns[4]]).T
    of, word, count = (np.concatenate([integers, *x]) for x in outside)
    # the best of each kind of template
    kind = how.kinds()[notice]
    best = np.zeros((3, block.num_rows))
    np.maximum.at(best, (kind, owner), least)
    stays = (greatest >= np.array(how.thresholds())[notice] - SLACK) & (greatest >= best[kind, owner] - SLACK)
    order = np.flatnonzero(stays)[np.argsort(owner[stays], kind="stable")]
    place = np.full(len(owner), -1)
    place[order] = np.arange(len(order))
    of, word, count = place[of][stays[of]], word[stays[of]], count[stays[of]]
    turn = np.argsort(of, kind="stable")
    words = pa.StructArray.from_arrays([pa.array(word[turn]), pa.array(count[turn].astype(np.int32))], names=["word", "n"])
    units = pa.StructArray.from_arrays(
        [pa.array(dot[order]), pa.array(known[order]), pa.array(notice[order].astype(np.int32)), tb.lists(words, np.bincount(of, minlength=len(order)))],
        names=["dot", "known", "notice", "outside"],
    )
    kept = {c: block.column(c) for c in block.schema.names if c != "text"}
    return pa.RecordBatch.from_pydict(kept | {"units": tb.lists(units, np.bincount(owner[order], minlength=block.num_rows))})


def best_notices(scanned: DataFrame, counted: DataFrame, n: int, how: LicenseScan = DEFAULTS) -> DataFrame:
    """(row, own_license, own_score) of the rows with a unit at the threshold."""
    units = scanned.select("row", F.inline("units"))
    open_units = units.where(F.size("outside") > 0).withColumn("key", F.xxhash64("outside"))
    # what the words outside the notices weigh, once for equal units
    weight = F.log((1 + F.lit(n)) / (1 + F.col("documents"))) + 1
    once = open_units.select("key", "outside").dropDuplicates(["key"]).select("key", F.inline("outside"))
    length = once.join(counted, "word").groupBy("key").agg(F.sum((F.col("n") * weight) ** 2).alias("other"))
    length = stage(length, "license-units")
    both = units.where(F.size("outside") == 0).select("row", "dot", "known", "notice", F.lit(0.0).alias("other"))
    both = both.unionByName(open_units.join(length, "key").select("row", "dot", "known", "notice", "other"))
    score = F.round(F.col("dot") / F.sqrt(F.col("known") + F.col("other")), 12)
    kind = F.get(F.array(*(F.lit(k) for k in how.kinds().tolist())), F.col("notice"))
    found = both.select("row", "notice", kind.alias("kind"), score.alias("score"))
    found = found.where(F.col("score") >= F.when(F.col("kind") == 2, how.title_threshold).otherwise(how.threshold))
    first = F.when(F.col("kind") == 2, 2).when((F.col("kind") == 0) & (F.col("score") >= how.text_sure), 0).otherwise(1)
    top = found.groupBy("row").agg(F.min(F.struct(first.alias("first"), (-F.col("score")).alias("score"), "notice")).alias("top"))
    names = F.array(*(F.lit(name) for name, _ in how.templates()))
    return top.select("row", F.get(names, F.col("top.notice")).alias("own_license"), (-F.col("top.score")).alias("own_score"))


def spdx_tag(text: Column) -> Column:
    """The expression of the first SPDX tag of a text."""
    term = r"[(]?[A-Za-z0-9][A-Za-z0-9.+:-]*[)]?"
    tag = F.regexp_extract(text, rf"SPDX-License-Identifier:[ \t]*({term}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{term})*)", 1)
    return F.when(text.contains("SPDX-License-Identifier:") & (tag != ""), tag)


def directory_of(path: Column) -> Column:
    """What comes before the last slash; '' where there is none."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), ""))


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def ancestors(directory: Column) -> Column:
    """array<struct(depth, above)>: the directory and all above it, '' last."""
    parts = F.split(directory, "/")
    depth = F.sequence(F.lit(0), F.when(directory == "", 0).otherwise(F.size(parts)))
    return F.transform(
        depth, lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, F.lit(1), d), "/").alias("above"))
    )


def licensed(
    files: DataFrame,
    keep: tuple[str, ...] = (),
    how: LicenseScan = DEFAULTS,
    path_col: str = "path",
    text_col: str = "text",
) -> DataFrame:
    """A row per file: the columns to ``keep``, ``path``, ``own_license``,
    ``own_score``, ``license`` and ``inherited_from`` (a directory)."""
    given = files.select(
        F.struct(*keep, F.lit(1).alias("file")).alias("kept"),
        F.col(path_col).cast("string").alias("path"),
        F.col(text_col).alias("text"),
        spdx_tag(F.col(text_col)).alias("tag"),
    )
    counted = word_documents(given)
    weights, n = word_weights(counted, how)
    kept_type = given.schema["kept"].dataType.simpleString()
    scanned = given.mapInArrow(_scan(how, weights, n), f"kept {kept_type}, path string, tag string, units {UNITS}")
    scanned = stage(scanned.withColumn("row", F.monotonically_increasing_id()), "license-scan")
    own = scanned.drop("units").join(best_notices(scanned, counted, n, how), "row", "left").drop("row")
    own = own.withColumn("own_score", F.when(F.col("tag").isNotNull(), 1.0).otherwise(F.col("own_score")))
    own = own.withColumn("own_license", F.coalesce("tag", "own_license")).drop("tag")
    own = stage(own.withColumn("directory", directory_of(F.col("path"))), "licenses")

    named = own.where(name_of(F.col("path")).rlike(LICENSE_FILE) & F.col("own_license").isNotNull())
    best = F.min(F.struct((-F.col("own_score")).alias("score"), "path", "own_license")).alias("best")
    sources = named.groupBy(F.col("directory").alias("above")).agg(best)
    sources = stage(sources.select("above", F.col("best.own_license").alias("given")), "license-directories")
    directories = own.select("directory").where("directory is not null").distinct()
    chains = directories.select("directory", F.inline(ancestors(F.col("directory"))))
    nearest = chains.join(sources, "above").groupBy("directory").agg(F.max(F.struct("depth", "above", "given")).alias("near"))
    nearest = stage(nearest.select("directory", "near.above", "near.given"), "inherited")
    both = own.join(nearest, "directory", "left")
    inherited = F.col("own_license").isNull()
    return both.select(
        *(F.col(f"kept.{c}").alias(c) for c in keep),
        "path",
        "own_license",
        "own_score",
        F.coalesce("own_license", "given").alias("license"),
        F.when(inherited, F.col("above")).alias("inherited_from"),
    )
