"""Byte-pair encoding by dynamic programming over prefixes, and its inverse.

The vocabulary is a public ``tokenizers`` file: BPE with a mark at word ends.
A word is a string of symbols, one per byte, the last one marked. Every prefix
of a word has one encoding, so its last token is unique. An automaton reports,
for each position, all tokens that end there; the right one is that whose
predecessor, the last token of the prefix it leaves, is *compatible* with it:
the two would not be merged across their border before each is complete. So
one last token is stored per prefix, and back-pointers from the end give the
ids. No merge is ever replayed.

Text is normalised as the file asks (NFC, white space, lower case) and split
into words by its pattern; added tokens are cut out first. Python does this for
pieces of text in Latin letters, where versions of Unicode agree; any other
piece is normalised and split by the library itself.

Decoding joins the tokens by one blank, as a file without a decoder does.

A null text is empty and has no tokens. Words of any length take time in
proportion to their length and memory per symbol. Repeated rows are encoded
each; empty tables give no rows; columns other than id and text are not read.
The file is opened on every machine that runs tasks, by the same path.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from phraseloom.llm import textblocks as tb

# Symbols that end a word are moved to this private area.
WORD_END = 0xE000
# Encoded words and answered pairs that a worker remembers: when there are this
# many, they become the older half, and that is dropped. Results do not depend
# on it.
MEMORY = 120_000
# Up to here, all versions of Unicode agree on letters and cases.
LATIN = "\u0250"
OUTSIDE = (-1, -1)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in such files:
    itself where it is printable in Latin-1, else the next one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + rest.index(b)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")")
        self.library = Tokenizer.from_file(path)
        symbols = byte_symbols()
        self.plain = symbols
        self.ending = [chr(WORD_END + b) for b in range(256)]
        mark = self.mark = dict(zip(symbols, self.ending, strict=True))

        def own(token: str) -> str:
            if not token.endswith(self.suffix):
                return token
            body = token[: -len(self.suffix)]
            return body[:-1] + mark[body[-1]]

        vocabulary = model["vocab"]
        self.token = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self.added.items()}
        # a token is made by its first merge; single symbols are made by none
        self.rank = dict.fromkeys(vocabulary.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = vocabulary[left], vocabulary[right]
            made = vocabulary[left + right]
            self.merged[pair] = rank
            if made not in self.parts:
                self.parts[made], self.rank[made] = pair, rank
        self.automaton = ahocorasick.Automaton()
        self.symbol_id = {}
        for text, i in vocabulary.items():
            if text in self.added:
                continue
            key = own(text)
            if len(key) == 1:
                self.symbol_id[key] = i
            self.automaton.add_word(key, (len(key), i))
        self.automaton.make_automaton()
        self.words: dict[str, list[int]] = {}
        self.older_words: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of both texts together is just these two.

        Undoing the later of the two merges again and again, down to symbols,
        gives every pair of tokens that met at the border, and when: a merge
        of such a pair that comes before the merge just undone would have
        crossed the border. Of equal ranks the leftmost place goes first,
        which is the left token's own merge, or the crossing one if the right
        token is undone.
        """
        rank, parts, merged = self.rank, self.parts, self.merged
        undone, before_right = None, False
        while True:
            crossing = merged.get((left, right))
            if crossing is not None and (
                undone is None or crossing < undone or (crossing == undone and before_right)
            ):
                return False
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                undone, before_right, left = a, False, parts[left][1]
            else:
                undone, before_right, right = b, True, parts[right][0]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given as symbols with the last one marked."""
        last: list[tuple[int, int]] = [OUTSIDE] * (len(word) + 1)
        pairs, compatible = self.pairs, self.compatible
        done = 0
        for end, (size, token) in self.automaton.iter(word):
            end += 1
            if end == done:
                continue
            start = end - size
            if start:
                before = last[start][1]
                if before < 0:
                    continue
                pair = (before, token)
                fits = pairs.get(pair)
                if fits is None:
                    fits = pairs[pair] = compatible(before, token)
                if not fits:
                    continue
            last[end] = (start, token)
            done = end
        ids, at = [], len(word)
        while at:
            at, token = last[at]
            ids.append(token)
        return ids[::-1]

    def split(self, text: str) -> list[str]:
        """The words of a piece of text, in symbols, the last one marked."""
        if max(text, default="") < LATIN:
            plain, ending = self.plain, self.ending
            found = []
            for word in self.pattern.findall(unicodedata.normalize("NFC", text).lower()):
                data = word.encode()
                found.append("".join([plain[b] for b in data[:-1]]) + ending[data[-1]])
            return found
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [symbols[:-1] + self.mark[symbols[-1]] for symbols, _ in pieces]

    def remembered(self, word: str, symbols: str | None = None) -> list[int]:
        found = self.older_words.get(word)
        if found is None:
            found = self.encode_word(symbols if symbols is not None else self.split(word)[0])
        if len(self.words) >= MEMORY:
            self.older_words, self.words = self.words, {}
        self.words[word] = found
        return found

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in self.cut.split(text):
            if piece in self.added:
                ids.append(self.added[piece])
            elif max(piece, default="") < LATIN:
                for word in self.pattern.findall(unicodedata.normalize("NFC", piece).lower()):
                    ids += self.words.get(word) or self.remembered(word)
            else:
                for symbols in self.split(piece):
                    ids += self.words.get(symbols) or self.remembered(symbols, symbols)
        if len(self.pairs) > MEMORY:
            self.pairs.clear()
        return ids

    def decode(self, ids: list[int]) -> str:
        token = self.token
        return " ".join([token[i] for i in ids])


@lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    return Bpe(path)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for block in tb.blocks(batches, "text"):
            ids = [bpe.encode(t) if t else [] for t in block.column("text").to_pylist()]
            decoded = [bpe.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())],
                names=["id", "ids", "decoded"],
            )

    return run


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, ``ids`` (array<int>) and ``decoded``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_encode(path), f"id {kind}, ids array<int>, decoded string")
    return found.withColumnRenamed("id", id_col)


def digests(found: DataFrame, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Counts and SHA-256 digests in place of ids and decoded text."""
    return found.select(
        id_col,
        *(["ids"] if keep_ids else []),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
