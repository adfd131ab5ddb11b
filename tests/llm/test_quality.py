from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import replace

import pyarrow as pa
import pytest

from phraseloom.llm import quality, textblocks

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    words = re.findall(WORD, text)
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force_on_random_texts():
    rng = random.Random(1)
    texts = ["", "a", None, " a b\n", "a b c a b c\n\na b\na b\n \n", "é ü\x00 é ü\x00 é ü\x00\n# $"]
    texts += ["".join(rng.choice("ab \n#é|") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    counts, _ = quality._measure(textblocks.texts_of(pa.array(texts)))
    assert [tuple(int(c[i]) for c in counts) for i in range(len(texts))] == [brute(t or "") for t in texts]


def test_hashes_do_not_depend_on_the_step():
    words = textblocks.texts_of(pa.array(["ab cd " * 50_000 + "x" * 600_000, "ab cd " + "x" * 600_000]))
    found = textblocks.find_words(words, textblocks.SPACED)
    assert len(set(found.hash.tolist())) == 3


def body(i, n=60):
    # letters only, as digits are folded
    name = "".join("abcdefghij"[int(c)] for c in str(i))
    return " ".join(f"d{name}w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(n))


def test_frequent_lines_go_and_depleted_documents_are_rejected(make):
    rows = [(i, f"Menu  LINE 1\n{body(i)}") for i in range(20)]
    rows += [(100 + i, ("menu line 2 " * 1) + "\n" + f"Short {i}" ) for i in range(3)]
    boiler = " ".join(f"b{k}" for k in range(60))
    rows += [(200 + i, f"{boiler}\nown{i} text") for i in range(15)]
    got = {r.doc_id: r for r in quality.quality(make(rows)).collect()}
    assert all(got[i].kept for i in range(20))
    # digits are folded: "menu line 2" is the same line
    assert got[0].removed_words == 0 and all(got[i].removed_words == 3 for i in range(1, 20))
    assert got[200].kept and not got[200].depleted
    assert all(got[200 + i].depleted and not got[200 + i].kept for i in range(1, 15))


def test_copies_do_not_make_lines_frequent_and_hosts_are_apart(make):
    rows = [(i, body(1) + "\n" + body(2)) for i in range(40)]
    rows += [(100 + i, body(50 + i) + "\nshared line here", f"h{i % 5}") for i in range(25)]
    got = quality.quality(make(rows)).collect()
    assert all(r.kept and r.removed_words == 0 for r in got)


def test_cleaned_keeps_columns_and_removes_lines(make):
    docs = make([(i, f"Menu line\n{body(i)}\n") for i in range(20)]).select("doc_id", "text", "lang", "source", "n_chars")
    out = quality.cleaned(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        assert r.text == ("Menu line\n" if r.doc_id == 0 else "") + body(r.doc_id) + "\n" and r.n_chars == len(r.text)


def test_hard_rows(hard):
    got = quality.quality(hard).collect()
    assert len(got) == hard.count()
    assert [(r.n_words, r.base_failed, r.kept) for r in got if r.doc_id == 1] == [(0, True, False)]
    kept = quality.cleaned(hard.select("doc_id", "text", "lang", "source", "n_chars"), replace(quality.DEFAULTS, min_words=0, max_repeat_percent=100))
    assert kept.count() == hard.count()


def test_empty_table(make):
    assert quality.quality(make([(1, "a")]).limit(0)).count() == 0


@pytest.mark.parametrize("share", [0.01, 0.5])
def test_both_limits_must_be_passed_in_small_hosts(make, share):
    rows = [(i, f"top line\n{body(i)}") for i in range(15)] + [(100 + i, body(100 + i)) for i in range(25)]
    got = quality.quality(make(rows), replace(quality.DEFAULTS, line_share=share)).collect()
    assert sum(r.removed_words > 0 for r in got) == (14 if share < 0.3 else 0)


@pytest.mark.parametrize("size", [100, 3000])
def test_a_growing_host_keeps_no_line_that_a_small_one_loses(make, size):
    rows = [(i, f"top line\n{body(i)}") for i in range(11)] + [(100 + i, body(100 + i)) for i in range(size - 11)]
    got = quality.quality(make(rows)).collect()
    assert sum(r.removed_words > 0 for r in got) == 10
