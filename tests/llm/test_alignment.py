from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from phraseloom.llm import alignment
from phraseloom.llm.bpe import byte_symbols
from phraseloom.llm.queries import op11_token_alignment
from phraseloom.staging import stage

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def library():
    """Text to groups of ids, by both libraries on the whole text and a walk
    along both sides."""
    a, b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    byte = {s: i for i, s in enumerate(byte_symbols())}

    def run(text):
        if not text:
            return None
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces)]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return None
        ends_a, ends_b = (np.cumsum([len(x) for x in side]).tolist() for side in (bytes_a, bytes_b))
        common, out, i, k = set(ends_a) & set(ends_b), [], 0, 0
        while i < len(ids_a):
            j, l = i, k
            while ends_a[j] not in common:
                j += 1
            while ends_b[l] not in common:
                l += 1
            out.append((ids_a[i : j + 1], ids_b[k : l + 1]))
            i, k = j + 1, l + 1
        return out

    return run


def brute(rows, library):
    found = [library(t) for _, t in rows]
    held = defaultdict(set)
    for d, gs in enumerate(found):
        for x, y in gs or []:
            for i in x:
                for j in y:
                    held[i, j].add(d)
    count = {k: len(v) for k, v in held.items()}
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for (doc, _), gs in zip(rows, found, strict=True):
        links = [(i, j) for x, y in gs or [] for i in x for j in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs or [])
        out.append(
            (doc, sum(len(x) for x, _ in gs or []), sum(len(y) for _, y in gs or []), len(gs or []), len(links), text,
             sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links))
        )
    return out


def scored(docs, **how):
    found = alignment.scored(stage(alignment.aligned(docs, *PATHS, **how), "aligned"))
    rows = found.select("id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum").collect()
    return [(*r[:5], r[5] or "", *r[6:]) for r in rows]


def texts(seed):
    rng = random.Random(seed)
    parts = ["hello", "World", "naïve", "thnttion", " ", "  ", "\n", "\t", "日本語", "🎉", "x" * 40, "don't", "<|endoftext|>", "</s>",
             "<0x41>", "1234567", " ", "　", "é", "é", ".", ", ", "\x00", "ﬁ", "​", "a b", "=====", "Ω≈ç"]
    return [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) + rng.choice(["", "", " ", "\n"]) for _ in range(200)] + [
        "".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(200)]


def test_equals_the_libraries_and_a_walk(make, library):
    rows = list(enumerate(texts(3))) + [(900, "▁ is another sign"), (901, " lead"), (902, "trail "), (903, " "), (904, "same"), (904, "same")]
    assert sorted(scored(make(rows), block_bytes=2000)) == sorted(brute(rows, library))


def test_hard_rows(hard, library):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    assert sorted(scored(hard), key=repr) == sorted(brute(rows, library), key=repr)


def test_groups_by_bisection_equal_a_walk():
    rng = random.Random(8)
    for _ in range(200):
        texts = rng.randint(0, 4)
        ends, starts = ([], []), ([0], [0])
        base = 0
        for _ in range(texts):
            size = rng.randint(1, 60)
            for side in (0, 1):
                inner = sorted(rng.sample(range(1, size), min(size - 1, rng.randint(0, 20))))
                ends[side].extend(base + x for x in [*inner, size])
                starts[side].append(len(ends[side]))
            base += size
        got = alignment.groups(*(np.array(x, np.int64) for x in (*ends, *starts)))
        common = sorted(set(ends[0]) & set(ends[1]))
        i = [0, *(ends[0].index(c) + 1 for c in common)]
        k = [0, *(ends[1].index(c) + 1 for c in common)]
        assert got.tolist() == [list(x) for x in zip(i[:-1], i[1:], k[:-1], k[1:])]


def test_long_groups_without_cuts_count_distinct_ids():
    a, b = np.array([5, 5, 6] * 40), np.array([1, 2] * 60)
    g = np.array([[0, 120, 0, 120]])
    key, often, of = alignment._links(a, b, g, np.array([0]))
    want = Counter((int(x) << 32 | int(y)) for x in a for y in b)
    assert dict(zip(key.tolist(), often.tolist())) == want and set(of.tolist()) == {0}


def test_empty_table(make):
    assert scored(make([(1, "a")]).where("doc_id = 2")) == []


def test_the_query_over_the_whole_table(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = [(*r[:5], hashlib.sha256(r[5].encode()).hexdigest() if r[5] else "", *r[6:]) for r in brute(docs, library)]
    got = op11_token_alignment(spark, sf_dir)
    rows = got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect()
    assert sorted(map(tuple, rows)) == sorted(want)
