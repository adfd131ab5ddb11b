from __future__ import annotations

import random

import pytest
from tokenizers import Tokenizer

from phraseloom.llm import bpe
from phraseloom.llm.queries import tokenizer_path

PIECES = ["a", "b", "e", "th", "ing", "'s", "'ll", " ", "\n", "1", "23", "É", "é", "Σ", "ΑΣ ", "İ", "ß", "<|endoftext|>", "<|endof", "!!!", "\x00",
          "\u00a0", "中文", "🎉", "\u200b", "ǅ", "</w>", "_", "ly", "\x85", "ẞ", "Ꭰ", "²", "ำ", "\u0345", "\u088f"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokenizer_path())
    t.no_padding()
    t.no_truncation()
    return t


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(tokenizer_path())


def texts(seed, alphabet, n, longest):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("alphabet, n, longest", [(PIECES, 5000, 12), ("aehtinorsl", 5000, 25), ("ab", 2000, 40)])
def test_ids_and_text_equal_the_library(own, library, alphabet, n, longest):
    for text in texts(longest, alphabet, n, longest):
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_token_text_in_threes(own, library):
    rng = random.Random(9)
    tokens = [t.replace("</w>", "") for t in library.get_vocab()]
    for _ in range(3000):
        text = "".join(rng.choice(tokens) for _ in range(3))
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids, text


def test_memory_does_not_change_ids(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 3)
    text = "some words and some other words again some words"
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_documents(hard, library):
    got = bpe.encoded(hard, tokenizer_path()).join(hard.select("doc_id", "text").distinct(), "doc_id").collect()
    for r in got:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)
    assert bpe.digests(bpe.encoded(hard, tokenizer_path())).count() == hard.count()
    assert bpe.encoded(hard.limit(0), tokenizer_path()).count() == 0
