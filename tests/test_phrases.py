from __future__ import annotations

import random
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from phraseloom.operators import phrases as ph
from phraseloom.operators.tagging import PandasTagger, RuleTagger, content_marks
from phraseloom.params import DEFAULTS


def tagged_column(spark, text):
    """'a/NN b/JJ' as array<struct<token,tag>>."""
    pairs = [tuple(t.rsplit("/", 1)) for t in text.split()]
    return spark.createDataFrame([(1, pairs)], "doc_id int, t array<struct<token:string,tag:string>>")


@pytest.mark.parametrize(
    "tagged, phrases",
    [
        ("primary/JJ care/NN ./.", ["primary care"]),
        ("health/NN care/NN", []),
        ("drug/NN ./. Old/JJ", ["drug"]),
        ("drug/NN old/JJ ./.", ["drug old"]),
        ("huge/JJ ./.", ["huge"]),
        ("US/NNP drug/NN ,/,", ["drug"]),
        ("co-author/NN study/NN ./.", ["study"]),
        ("Other/JJ Nations/NNS ./.", ["other nation"]),
        ("drug/NN ./. drug/NN ./.", ["drug", "drug"]),
        ("were/VBD used/VBN ,/,", ["were used"]),
        ("./. ,/,", []),
    ],
)
def test_chunking(spark, tagged, phrases):
    df = tagged_column(spark, tagged).select("doc_id", "t")
    got = df.select(ph.phrases_of_marks(content_marks(F.col("t"), DEFAULTS)).alias("p")).first().p
    assert got == phrases
    rows = df.select("doc_id", F.posexplode("t").alias("pos", "x")).select("doc_id", "pos", "x.token", "x.tag")
    assert [r.phrase for r in ph.phrase_runs(rows).orderBy("run").collect()] == phrases


def test_flush_trailing_keeps_the_open_phrase(spark):
    df = spark.createDataFrame([(1, "the old drug of rare disease")], "doc_id int, text string")
    flush = replace(DEFAULTS, flush_trailing=True)
    assert [r.phrase for r in ph.candidate_phrases(df).collect()] == ["old drug"]
    assert [r.phrase for r in ph.candidate_phrases(df, p=flush).collect()] == ["old drug", "rare disease"]
    assert [r.phrase for r in ph.phrase_runs(ph.tagged_tokens(df), flush).orderBy("run").collect()] == [
        "old drug",
        "rare disease",
    ]


def test_phrases_cross_sentence_text_and_line_ends_only_at_marks(spark):
    df = spark.createDataFrame([(1, "Rare\n  Diseases  studied.\nOther nations!")], "doc_id int, text string")
    assert [r.phrase for r in ph.candidate_phrases(df).collect()] == ["rare disease studied", "other nation"]


@pytest.mark.parametrize(
    "text, phrases",
    [
        ("The nation's health care bill is huge.", ["nation", "health care bill", "huge"]),
        ("It doesn't wash, and we need to better understand it.", ["does", "wash", "need", "understand"]),
        ("She said it in much more detail a few years later, though.", ["said", "more detail", "few year"]),
        ("The co-author pays $1,443 for 17.8 percent.", ["pay", "percent"]),
        ("Only people suffering from it were helped in 2018.", ["person suffering", "were helped"]),
        ("Don’t use the systems of the United States of America.", ["use", "system", "united state", "america"]),
    ],
)
def test_plain_english(spark, text, phrases):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert [r.phrase for r in ph.candidate_phrases(df).orderBy("n").collect()] == phrases


def test_texts_without_phrases(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "of the"), (4, "drug")], "doc_id int, text string")
    bags = {r.doc_id: (r.dl, r.phrases) for r in ph.phrase_bags(df).collect()}
    assert bags == {1: (0, []), 2: (None, []), 3: (0, []), 4: (0, [])}
    assert ph.doc_phrases(ph.phrase_bags(df)).collect() == []
    assert ph.candidate_phrases(df).collect() == []


def test_counting_inside_the_row(spark):
    rng = random.Random(7)
    lists = [[], ["a"], ["a", "a"], ["b", "a", "b"]] + [
        [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))] for _ in range(40)
    ]
    df = spark.createDataFrame(list(enumerate(lists)), "doc_id int, c array<string>")
    for r in df.select("doc_id", ph.count_phrases(F.col("c")).alias("n")).collect():
        assert {x.phrase: x.tf for x in r.n} == Counter(lists[r.doc_id])


def test_array_form_and_window_form_agree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a = ph.candidate_phrases(docs).select("doc_id", "phrase")
    b = ph.phrase_runs(ph.tagged_tokens(docs)).select("doc_id", "phrase")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_python_tagger_with_the_same_rules_gives_the_same_bags(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en'")
    content = {"NN", "JJ", "VB"}
    tokens = ph.tagged_tokens(docs).select("token", "tag").distinct().collect()
    table = {r.token: r.tag if any(c in r.tag for c in content) else "DT" for r in tokens}
    tagger = PandasTagger(lambda ts: [table[t] for t in ts])
    a, b = ph.doc_phrases(ph.phrase_bags(docs, tagger)), ph.doc_phrases(ph.phrase_bags(docs, RuleTagger()))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_bag_lengths_are_sums_and_order_of_rows_does_not_matter(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bags = ph.phrase_bags(docs)
    total = F.aggregate("phrases", F.lit(0).cast("long"), lambda a, x: a + x["tf"])
    assert bags.where(total != F.col("dl")).count() == 0
    shuffled = ph.phrase_bags(docs.orderBy(F.rand(3)).repartition(5))
    assert ph.doc_phrases(bags).exceptAll(ph.doc_phrases(shuffled)).count() == 0


def test_title_is_part_of_the_text(spark):
    df = spark.createDataFrame([(1, "a/b/rare disease.txt.txt", "the end")], "doc_id int, file string, text string")
    assert [x.phrase for x in ph.phrase_bags(df, title_col="file").first().phrases] == ["rare disease"]
    assert ph.phrase_bags(df).first().phrases == []


def test_ranked_phrases(spark):
    df = spark.createDataFrame([(1, "drug. drug. aid. zoo. zoo. zoo.")], "doc_id int, text string")
    got = [(r.rank, r.phrase, r.tf) for r in ph.ranked_phrases(ph.phrase_bags(df)).orderBy("rank").collect()]
    assert got == [(1, "zoo", 3), (2, "drug", 2), (3, "aid", 1)]


def test_phrases_of_a_text_are_kept_once_and_scored_without_the_title(spark):
    rows = [
        (1, "a/rare disease.txt", "Rare disease. Old drug. Rare disease. Drug 12."),
        (2, "a/old drug.txt", "The end."),
        (3, "a/old drug.txt", None),
        (4, None, "Old drug. Old drug. Aid."),  # no path, no title: not in the corpus, but scored
        (5, "a/it.txt", "Old drug, old drugs."),
        (6, "a/aid. aid.txt", "Zoo. Aid. Bed12. 12bed."),
    ]
    df = spark.createDataFrame(rows, "doc_id int, file string, text string")
    titled, plain = ph.phrase_bags(df, title_col="file").cache(), ph.phrase_bags(df)
    assert titled.select("doc_id", "dl", "phrases").collect()[3].dl is None
    got, alone = ph.text_bags(titled), plain
    assert {r.doc_id: r.dl for r in got.collect()} == {r.doc_id: r.dl for r in alone.collect()}
    assert sorted(ph.doc_phrases(got).collect()) == sorted(ph.doc_phrases(alone).collect())
    corpus = {r.doc_id: {x.phrase: x.tf for x in r.phrases} for r in titled.collect()}
    assert corpus[1] == {"rare disease": 3, "old drug": 1, "drug": 1} and corpus[4] == {} and corpus[6]["aid"] == 3
    # a second list of the phrases is there only where title or text is missing
    assert {r.doc_id for r in titled.where("text_phrases is not null").collect()} == {3, 4}


def test_phrases_are_split_at_a_character(spark):
    marks = [["a", "b", "|", "|", "c1", "|", "d"], ["|", "|"], [], ["1x1", "|"], ["a"], None]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(marks)], "doc_id int, m array<string>")
    got = df.select(ph.phrases_of_marks(F.col("m")).alias("p"))
    assert [r.p for r in got.collect()] == [["a b", "c1"], [], [], ["1x1"], [], None]
    assert r"split(array_join(m#" in (plan := got._jdf.queryExecution().toString()) and r" *\|" not in plan
