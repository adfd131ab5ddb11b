from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from phraseloom.functions import words
from phraseloom.functions.columns import after_last_slash, before_last_slash, fold
from phraseloom.functions.lexicon import ENGLISH, LEXICONS
from phraseloom.functions.patterns import at_least_words
from phraseloom.operators.phrases import candidate_phrases, content_tokens, document_tokens, phrase_runs, tagged_tokens
from phraseloom.operators.tagging import LanguageTagger, PandasTagger, RuleTagger
from phraseloom.params import DEFAULTS
from tests.brute import word_count


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("Old drugs, new uses.", ["Old", "drugs", ",", "new", "uses", "."]),
        ("It's co-author-level work", ["It", "'", "s", "co-author-level", "work"]),
        ("The nation's bill DOESN'T", ["The", "nation", "'", "s", "bill", "DOES", "N'T"]),
        ("I'd've said o'clock 'so they're", ["I", "'", "d", "'", "ve", "said", "o'clock", "'", "so", "they", "'", "re"]),
        ("a--b -c d-", ["a", "-", "-", "b", "-", "c", "d", "-"]),
        ("dogs' $1,443 x²", ["dogs", "'", "$", "1", ",", "443", "x²"]),
        ("x y z\x85w", ["x", "y", "z", "w"]),
        ("", []),
        (" \n\t", []),
    ],
)
def test_tokenize(spark, text, tokens):
    assert column(spark, [text], words.tokenize) == [tokens]


def test_tags(spark):
    expected = {
        "the": "DT", "of": "IN", "and": "CC", "was": "VB", "can": "MD", "quickly": "RB", "family": "NN",
        "daily": "JJ", "running": "VBG", "king": "NN", "tested": "VBD", "possible": "JJ", "famous": "JJ",
        "helpful": "JJ", "active": "JJ", "public": "JJ", "national": "JJ", "drug": "NN", "2018": "CD",
        "seven": "CD", ".": ".", "?": ".", ",": ",", ";": ":", "$": "SYM", "—": "SYM",
        "ptk6": "NN", "co-author": "NN",
    }
    got = column(spark, list(expected), lambda c: words.rule_tag(c, ENGLISH))
    assert dict(zip(expected, got)) == expected


def test_singular(spark):
    expected = {
        "people": "person", "men": "man", "women": "woman", "specimen": "specimen", "children": "child",
        "nations": "nation", "countries": "country", "ties": "tie", "boxes": "box", "classes": "class",
        "churches": "church", "wishes": "wish", "heroes": "hero", "shoes": "shoe", "houses": "house",
        "virus": "virus", "viruses": "virus", "analysis": "analysis", "analyses": "analysis", "crises": "crisis",
        "wives": "wife", "wolves": "wolf", "lives": "life", "teeth": "tooth", "data": "datum",
        "criteria": "criterion", "series": "series", "news": "news", "was": "was", "has": "has", "glass": "glass",
        "states": "state", "movies": "movie", "does": "does", "drug": "drug", "said": "said",
    }
    got = column(spark, list(expected), words.singular)
    assert dict(zip(expected, got)) == expected


ODD = [
    "İstanbul", "STRASSE", "naïve", "x²", "½", "Ⅷ", "日本", "ét", "٣٤٥", "12", "123", "1990s", "ab", "abc", "ly",
    "only", "family", "FAMILY", "The", "WERE", "it's", "co-op", "-", "|", "😀", "́", "oxen", "ies", "men",
]


@pytest.mark.parametrize("lang", LEXICONS)
def test_break_test_says_what_tags_say(spark, sf_dir, lang):
    lexicon = LEXICONS[lang]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = document_tokens(docs).select(F.col("token").alias("t")).distinct()
    odd = spark.createDataFrame([(w,) for w in ODD], "t string")
    every = seen.union(odd).select(fold(F.col("t")).alias("t"))
    t = F.col("t")
    by_tag = ~words.is_content(t, words.rule_tag(t, lexicon), 3)
    wrong = every.where(words.closes_phrase(t, lexicon, 3) != by_tag)
    assert wrong.collect() == []


def test_noun_branch_and_other_branch_cover_content(spark):
    rows = [("drug", "NN"), ("Nations", "NNPS"), ("old", "JJR"), ("used", "VBN"), ("the", "DT"), ("co-x", "NN"), ("US", "NNP")]
    df = spark.createDataFrame([(i, 0, a, b) for i, (a, b) in enumerate(rows)], "doc_id int, pos int, token string, tag string")
    assert [r.token for r in content_tokens(df).orderBy("doc_id").collect()] == ["drug", "Nations", "old", "used"]


def test_tagged_text_parts(spark):
    assert column(spark, ["and/or/CC", "x/NN"], after_last_slash) == ["CC", "NN"]
    assert column(spark, ["and/or/CC", "x/NN"], before_last_slash) == ["and/or", "x"]


def test_pandas_tagger_tags_tokens(spark):
    docs = spark.createDataFrame([(1, "Red fish swim."), (2, "")], "doc_id int, text string")
    tagger = PandasTagger(lambda ts: ["XX" if t == "fish" else "NN" for t in ts])
    got = [(r.token, r.tag) for r in tagged_tokens(docs, tagger).orderBy("pos").collect()]
    assert got == [("Red", "NN"), ("fish", "XX"), ("swim", "NN"), (".", "NN")]
    assert tagged_tokens(docs, RuleTagger()).columns == tagged_tokens(docs, tagger).columns


def test_at_least_words_edges(spark):
    for n in (0, 1, 2, 3, 4):
        texts = ["", " ", "a", " a", "a b", " a b", "a b c", "a b c d ", "\n\t a  b c", "a "]
        assert column(spark, texts, lambda c: c.rlike(at_least_words(n))) == [word_count(t) >= n for t in texts]


@pytest.mark.parametrize(
    ("text", "tags"),
    [
        ("to run", "TO VB"),
        ("the run", "DT NN"),
        ("the reply", "DT NN"),
        ("a used car", "DT JJ NN"),
        ("the ghostly house", "DT JJ NN"),
        ("slowly the house", "RB DT NN"),
        ("they like the town", "PRP VB DT NN"),
        ("they plan the town", "PRP VBP DT NN"),
        ("run", "NN"),
        ("", ""),
    ],
)
def test_tags_by_context(spark, text, tags):
    from phraseloom import ContextTagger
    from phraseloom.functions.words import tokenize

    got = spark.createDataFrame([(text,)], "t string").select(ContextTagger().tags(tokenize(F.col("t"))).alias("x"))
    assert " ".join(got.first().x) == tags


def test_phrases_by_context(spark):
    from phraseloom import ContextTagger
    from phraseloom.operators.phrases import candidate_phrases, phrase_runs, tagged_tokens

    docs = spark.createDataFrame(
        [(1, "The Ghostly house fell. They near the town."), (2, None), (3, " ")], "doc_id int, text string"
    )
    got = candidate_phrases(docs, ContextTagger()).orderBy("n").collect()
    assert [(r.doc_id, r.phrase) for r in got] == [(1, "ghostly house fell"), (1, "near"), (1, "town")]
    runs = phrase_runs(tagged_tokens(docs, ContextTagger()), tagger=ContextTagger())
    assert [r.phrase for r in runs.orderBy("run").collect()] == ["ghostly house fell", "near", "town"]


def test_shaped_tokens_are_the_tokens_or_empty(spark):
    texts = [" ".join(ODD), "".join(ODD), "The nation's bill DOESN'T", "a-b 12-ab ab12 x²", "l’eau n't 's", "", " \n", None, "日本 ٣٤٥a ½"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    tokens, shaped = words.tokenize(F.col("t")), words.shaped_tokens(F.col("t"))
    fits = F.transform(tokens, lambda w: F.when(words.is_letters_or_digits(w) & ~w.rlike(r"^\p{Nd}+$"), w).otherwise(""))
    assert df.where(~fits.eqNullSafe(shaped)).collect() == []


@pytest.mark.parametrize("least", [0, 1, 2, 3])
def test_phrases_of_texts_are_those_of_token_rows(spark, least):
    p = replace(DEFAULTS, min_token_length=least)
    texts = [" ".join(ODD) + " .", "".join(ODD) + ".", "Nation's data don't l’eau | x² the men's analyses.", "big dogs - 12 cats; 1990s ties only.", ""]
    rows = [(i, lang, t) for i, (t, lang) in enumerate((t, lang) for t in texts for lang in [*LEXICONS, None])]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    tagger = LanguageTagger()
    by_row = candidate_phrases(docs, tagger, p).groupBy("doc_id").agg(F.collect_list("phrase").alias("x"))
    runs = phrase_runs(tagged_tokens(docs, tagger), p, tagger=tagger).orderBy("doc_id", "run").collect()
    expected = {}
    for r in runs:
        expected.setdefault(r.doc_id, []).append(r.phrase)
    assert {r.doc_id: r.x for r in by_row.collect()} == expected
