from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from phraseloom.functions.text import html_to_text, is_summary_sentence, title, word_count
from phraseloom.operators import ranking
from phraseloom.operators import summary as sm
from phraseloom.operators.phrases import phrase_bags
from phraseloom.params import DEFAULTS
from tests import brute

VOCAB = "array<struct<phrase:string,bm25:double>>"


def summaries(spark, cases, p=DEFAULTS):
    df = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(cases)], f"doc_id int, text string, keyphrases {VOCAB}")
    docs = df.withColumn("vocab", sm.vocabulary(F.col("keyphrases"), p))
    got = {r.doc_id: r.summary for r in sm.document_summaries(docs, p).collect()}
    return [got[i] for i in range(len(cases))]


@pytest.mark.parametrize(
    "text, count",
    [
        ("", 0), (" ", 1), ("a", 1), (" a", 2), ("a ", 1), ("a b", 2), (" a b  c\n", 4),
        ("\n\t\tThe United States", 4), (" x y", 3), ("x y", 2),
    ],
)
def test_word_count(spark, text, count):
    df = spark.createDataFrame([(text,)], "x string")
    assert brute.word_count(text) == count
    assert df.select(word_count(F.col("x")).alias("n")).first().n == count
    assert df.select(is_summary_sentence(F.col("x"), -1, 3).alias("b")).first().b == (count >= 3)


LONG = " this sentence number {} tells about {} and more"


def test_best_three_in_text_order(spark):
    text = ".".join(LONG.format(i, w) for i, w in enumerate(["aaa", "bbb", "ccc", "ddd", "eee"])) + "!"
    vocab = [("ddd", 9.0), ("bbb", 8.0), ("eee", 7.0), ("aaa", 6.0), ("ccc", 5.5)]
    pieces = text.replace("!", ".").split(".")
    assert summaries(spark, [(text, vocab)]) == [[pieces[1], pieces[3], pieces[4]]]


def test_ties_keep_the_earlier_sentence(spark):
    text = ".".join(LONG.format(i, "aaa") for i in range(5))
    assert summaries(spark, [(text, [("aaa", 6.0)])]) == [text.split(".")[:3]]


def test_eligibility(spark):
    twenty = "drug a b c d e f ghi"
    assert len(twenty) == 20
    two_words = "pharmaceuticals drugstores"
    cases = [
        ("first. " + twenty[:-1], [("drug", 6.0)]),  # a blank and 19 characters
        ("first. " + twenty, [("drug", 6.0)]),  # a blank and 20
        (two_words + ". x", [("drug", 6.0)]),
        (" " + two_words + ". x", [("drug", 6.0)]),
    ]
    assert summaries(spark, cases) == [["first", "first"], [" " + twenty], [two_words] * 2, [" " + two_words]]
    # at the start of a text the second case and the fallback look alike
    p = replace(DEFAULTS, fallback="lead")
    assert summaries(spark, cases, p)[2:] == [[two_words, " x"], [" " + two_words]]


def test_contains_is_by_characters(spark):
    text = "Nothing here. It became a very long sentence. End"
    assert summaries(spark, [(text, [("came", 6.0)])]) == [[" It became a very long sentence"]]


def test_fallback(spark):
    text = "One. Two. Three. Four"
    assert summaries(spark, [(text, []), ("no end mark", [])]) == [["One"] * 3, ["no end mark"]]
    p = replace(DEFAULTS, fallback="lead")
    assert summaries(spark, [(text, []), ("no end mark", [])], p) == [["One", " Two", " Three"], ["no end mark"]]
    with pytest.raises(ValueError):
        replace(DEFAULTS, fallback="none")


def test_only_ten_phrases_add_up(spark):
    names = [f"word{c}" for c in "abcdefghijkl"]
    vocab = [(w, 20.0 - i) for i, w in enumerate(names)]
    text = LONG.format(1, names[10] + " " + names[11]) + "." + LONG.format(2, names[9])
    assert summaries(spark, [(text, vocab)]) == [[text.split(".")[1]]]


def test_random_texts(spark):
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "Beta", "xbetax", "of", "the", "a"]
    cases = []
    for _ in range(60):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", "! ", "?", "  ", "\n"]) for _ in range(rng.randint(0, 80)))
        vocab = [(w, rng.uniform(5, 9)) for w in rng.sample(["alpha", "beta", "gamma", "delta beta"], rng.randint(0, 4))]
        cases.append((text, vocab))
    assert summaries(spark, cases) == [brute.summary(t, v) for t, v in cases]


def test_rows_and_arrays_score_alike(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn(
        "vocab", F.array(*[F.struct(F.lit(w).alias("phrase"), F.lit(s).alias("bm25")) for w, s in [("th", 7.5), ("le", 5.25), ("er", 6.125)]])
    )
    by_rows = sm.sentence_hits(docs).groupBy("doc_id", "sentence").agg(F.sum("bm25").alias("total"))
    by_array = sm.sentence_scores(docs)
    assert by_rows.count() == by_array.count() > 0
    assert by_rows.exceptAll(by_array).count() == 0


def test_key_phrases_are_cut_at_thirty_and_ties_go_by_phrase(spark):
    rows = [(1, f"p{i:02}", float(100 - i)) for i in range(40)] + [(2, "b", 7.0), (2, "a", 7.0 + 1e-9), (2, "c", 7.1)]
    matches = spark.createDataFrame(rows, "doc_id int, phrase string, bm25 double")
    lists = {r.doc_id: [x.phrase for x in r.keyphrases] for r in ranking.keyphrase_lists(ranking.document_keyphrases(matches)).collect()}
    assert lists == {1: [f"p{i:02}" for i in range(30)], 2: ["c", "a", "b"]}


def test_titles(spark):
    df = spark.createDataFrame([("a/b/c.txt.txt",), ("x.txt",), ("dir/",), ("n.TXT",)], "x string")
    assert [r.t for r in df.select(title(F.col("x")).alias("t")).collect()] == ["c", "x", "", "n.TXT"]


def test_html(spark):
    page = (
        "<html><head><style>p{}</style><script>var t='</p>';</script></head><!-- <p>no</p> -->"
        "<p>Fish &amp; chips &lt;b&gt;</p>\n\n <br/>  Caf&eacute; &amp;lt;<b>bold</b>"
    )
    df = spark.createDataFrame([(page,), ("",), (None,)], "x string")
    got = [r.t for r in df.select(html_to_text(F.col("x")).alias("t")).collect()]
    assert got == ["Fish & chips <b>\nCafé &lt;bold", "", None]


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>a</p><script>b </p> c", "a"),
        ("<p>a</p><!-- b <p>c</p>", "a"),
        ("<script src='x'>b</script >a<STYLE>c</STYLE>d", "a d"),
        ("<scripted>a</scripted> < b", "a < b"),
        ("1 < 2 and <b>3</b> > 2", "1 < 2 and 3 > 2"),
    ],
)
def test_html_that_is_not_closed(spark, page, text):
    df = spark.createDataFrame([(page,)], "x string")
    assert df.select(html_to_text(F.col("x")).alias("t")).first().t == text


N = 200_000
HARD = ["a-" * N, "foo-bar'" * N, "word " * N, "x" * N, "| " * N, " " * N + "x", "." * N, "it's " * N, "the word. " * N]
HARD_PAGES = ["<!--" * N, "<script>" * N, "<script " * N, "<" * N, "<br " * N, "<script>a" + "</script" * N, "a" + " \n" * N + "b"]


def test_hard_texts_are_read_in_one_pass(spark):
    """Each took minutes, or the stack of the JVM, with less careful patterns."""
    texts = spark.createDataFrame(list(enumerate(HARD)), "doc_id int, text string")
    lengths = {r.doc_id: r.dl for r in phrase_bags(texts).collect()}
    assert lengths == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: N}
    vocab = texts.withColumn("vocab", F.expr("array(named_struct('phrase', 'word', 'bm25', 5d))"))
    assert sm.document_summaries(vocab).where(F.size("summary") > 0).count() == len(HARD)
    assert texts.select(word_count(F.col("text")).alias("n")).where("n > 0").count() == len(HARD)
    pages = spark.createDataFrame([(p,) for p in HARD_PAGES], "x string")
    assert pages.select(html_to_text(F.col("x")).alias("t")).where("t is not null").count() == len(HARD_PAGES)
