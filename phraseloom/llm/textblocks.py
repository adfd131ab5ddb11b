"""Words, lines and windows of many texts at once, as numpy arrays.

Texts come as the UTF-8 bytes of an Arrow column. Word classes are sets of
bytes: every byte of a non-ASCII character is a word byte, so no text is ever
decoded. A word, line or window is known by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts are worked on in blocks of about this many bytes (one text at least).
BLOCK_BYTES = 4 << 20
# Hashes are summed up in steps of this many bytes, so that a text of any
# length needs no more than a few bytes of memory per byte of text.
STEP = 1 << 18
U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    table = np.full(n, base, dtype=U64)
    table[0] = 1
    return np.cumprod(table, dtype=U64)


POWERS = _powers(BASE, STEP)
INVERSE_POWERS = _powers(BASE_INVERSE, STEP)


class Alphabet(NamedTuple):
    word: np.ndarray  # bool per byte: part of a word
    value: np.ndarray  # uint64 per byte: what the hash sees; never 0


def alphabet(separators: bytes, fold: bool = False, digits: bool = True) -> Alphabet:
    """``fold``: A-Z count as a-z. ``digits=False``: all digits count as 0."""
    word = np.ones(256, dtype=bool)
    value = np.arange(1, 257, dtype=U64)
    if fold:
        value[ord("A") : ord("Z") + 1] = value[ord("a") : ord("z") + 1]
    if not digits:
        value[ord("0") : ord("9") + 1] = value[ord("0")]
    word[np.frombuffer(separators, dtype=np.uint8)] = False
    return Alphabet(word, value)


WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
# words are what white space separates
SPACED = alphabet(WHITE)
SPACED_FOLDED = alphabet(WHITE, fold=True)
SPACED_NORMAL = alphabet(WHITE, fold=True, digits=False)
# words of letters and digits; A-Z are letters that count as a-z
ALPHANUMERIC = alphabet(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), fold=True)


class Texts(NamedTuple):
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64; text i is data[offsets[i]:offsets[i + 1]]


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray  # the words of text i are bounds[i]:bounds[i + 1]
    hash: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def texts_of(column: pa.Array) -> Texts:
    """A null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return Texts(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    return Texts(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0])


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in blocks of about ``limit`` bytes of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // limit)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(29))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(32))


def segment_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """A hash of values[start[i]:end[i]] for each i; segments are in order and
    do not overlap. With ``table``, values are looked up in it first."""
    out = np.zeros(len(start), dtype=U64)
    for a in range(0, len(values), STEP):
        b = min(a + STEP, len(values))
        i, j = np.searchsorted(end, a, "right"), np.searchsorted(start, b, "left")
        if i >= j:
            continue
        part = values[a:b] if table is None else table[values[a:b]]
        sums = np.zeros(b - a + 1, dtype=U64)
        np.cumsum(part * POWERS[: b - a], out=sums[1:])
        lo, hi = np.maximum(start[i:j], a) - a, np.minimum(end[i:j], b) - a
        out[i:j] += (sums[hi] - sums[lo]) * U64(pow(BASE, a, 1 << 64))
    if len(start):
        steps = _powers(pow(BASE_INVERSE, STEP, 1 << 64), int(start[-1]) // STEP + 1)
        out *= INVERSE_POWERS[start % STEP] * steps[start // STEP]
    return mix(out + (end - start).astype(U64))


def find_words(texts: Texts, letters: Alphabet) -> Words:
    data, offsets = texts
    word = letters.word[data]
    before, after = np.zeros_like(word), np.zeros_like(word)
    before[1:], after[:-1] = word[:-1], word[1:]
    filled = offsets[1:] > offsets[:-1]
    before[offsets[:-1][filled]] = False
    after[offsets[1:][filled] - 1] = False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    del word, before, after
    bounds = np.searchsorted(start, offsets)
    return Words(start, end, bounds, segment_hashes(data, start, end, letters.value))


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first word, hash) of every window of n words."""
    k = len(words.hash) - n + 1
    if k <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    text = words.text_of()
    h = np.zeros(k, dtype=U64)
    for i in range(n):
        h = h * U64(BASE) + words.hash[i : i + k]
    at = np.flatnonzero(text[:k] == text[n - 1 :])
    return at, mix(h[at])


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct windows of n words of every text, by text
    and hash. A text of fewer words, but not none, has itself as its one."""
    at, h = windows(words, n)
    text = words.text_of()
    count = np.diff(words.bounds)
    short = np.flatnonzero((count > 0) & (count < n))
    start = words.bounds[short]
    whole = segment_hashes(words.hash, start, words.bounds[short + 1]) if len(short) else np.zeros(0, U64)
    of, h = np.concatenate([text[at], short]), np.concatenate([h, whole])
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
    return of[new], h[new]


def per_text(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of mask[bounds[i]:bounds[i + 1]] are true."""
    sums = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column whose row i holds the next counts[i] values."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
