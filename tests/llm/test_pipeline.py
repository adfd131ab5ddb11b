from __future__ import annotations

import random
import re

from tokenizers import Tokenizer

import corpus_pipeline
from phraseloom.llm.queries import tokenizer_path
from tests.llm.test_decontaminate import brute as contamination
from tests.llm.test_neardup import brute as groups
from tests.llm.test_quality import brute as counts


def test_stages_and_their_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name


def test_run_equals_brute_force(spark, tmp_path):
    """No line is frequent here; that rule has its own test."""
    rng = random.Random(6)
    words = [f"v{i}" for i in range(4000)]
    mk = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, mk(14)) for i in range(5)]
    texts = [mk(rng.randint(30, 120)) for _ in range(60)]
    texts += [t + " end" for t in texts[:10]] + texts[10:15] + [None, "", "spam spam spam " * 30]
    texts += [f"{mk(40)} {items[i][1]} {mk(20)}" for i in range(5)]
    texts += [f"{mk(30)} password=abcdefgh12 {mk(30)}"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    kept = []
    for i, t, *_ in rows:
        n_words, _, _, _, repeated = counts(t or "")
        if n_words >= 50 and 100 * repeated <= 50 * n_words:
            kept.append((i, t))
    component = groups(kept, 5)
    kept = [(i, t) for i, t in kept if component[i][1] == i]
    kept = [(i, t) for i, t in kept if not contamination(t, items, 10)[1]]
    library = Tokenizer.from_file(tokenizer_path())
    library.no_padding()
    library.no_truncation()
    want = {i: library.encode(re.sub("password=abcdefgh12", "[SECRET]", t), add_special_tokens=False).ids for i, t in kept}
    assert got == want
