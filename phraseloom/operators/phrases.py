"""From text to phrase counts, one row per document and no shuffle.

``doc_id`` identifies a document: one input row, one bag of phrases. Counting
inside the row saves the shuffle of every (document, phrase) pair of the
corpus, by far the largest one a relational count would need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phraseloom.functions import words
from phraseloom.functions.columns import BAR, fold, let
from phraseloom.functions.text import titled_text
from phraseloom.operators.tagging import LanguageTagger, RuleTagger, Tagger
from phraseloom.params import DEFAULTS, Params


def document_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    return docs.select(id_col, *more, F.posexplode(words.tokenize(F.col(text_col))).alias("pos", "token"))


def tagged_tokens(
    docs: DataFrame, tagger: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, [lang column,] pos, token, tag). The tags leave the generator with
    the tokens: a tag that is a column expression would be computed again in
    every condition on it, by code too long for the JVM to compile."""
    tagger = tagger or RuleTagger()
    more = tagger.columns if isinstance(tagger, LanguageTagger) else []

    def pairs(tokens: Column, tags: Column) -> Column:
        return F.arrays_zip(tokens.alias("token"), tags.alias("tag"))

    if isinstance(tagger, RuleTagger | LanguageTagger):
        tagged = let(words.tokenize(F.col(text_col)), lambda t: pairs(t, tagger.tags(t)))
        rows = docs.select(id_col, *more, F.posexplode(tagged).alias("pos", "t"))
    else:  # any function of columns, such as one in Python, needs a column of tokens
        rows = docs.select(id_col, words.tokenize(F.col(text_col)).alias("tokens"))
        rows = rows.select(id_col, "tokens", tagger.tags(F.col("tokens")).alias("tags"))
        rows = rows.select(id_col, F.posexplode(pairs(F.col("tokens"), F.col("tags"))).alias("pos", "t"))
    return rows.select(id_col, *more, "pos", "t.token", "t.tag")


def content_tokens(tagged: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    return tagged.where(words.is_content(F.col("token"), F.col("tag"), p.min_token_length))


def singular_tokens(content: DataFrame) -> DataFrame:
    return content.withColumn("singular", words.singular(fold(F.col("token"))))


def phrases_of_marks(marks: Column, p: Params = DEFAULTS) -> Column:
    """Join the words, split at the bars. What follows the last bar was never
    closed; it is lost unless ``flush_trailing``. Java splits at one character
    without a search for a pattern."""
    pieces = F.split(F.array_join(marks, " "), r"\|", -1)
    if not p.flush_trailing:
        pieces = let(pieces, lambda all: F.slice(all, 1, F.size(all) - 1))
    return F.array_remove(F.transform(pieces, lambda piece: F.btrim(piece)), "")


def candidates(text: Column, tagger: Tagger | None = None, p: Params = DEFAULTS) -> Column:
    """array<string>: candidate phrases in text order, repeats included."""
    return phrases_of_marks((tagger or RuleTagger()).marked_words(text, p), p)


def candidate_phrases(
    docs: DataFrame,
    tagger: Tagger | None = None,
    p: Params = DEFAULTS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    return docs.select(
        id_col, F.posexplode_outer(candidates(F.col(text_col), tagger, p)).alias("n", "phrase")
    ).where(F.col("phrase").isNotNull())


def phrase_runs(
    tagged: DataFrame, p: Params = DEFAULTS, id_col: str = "doc_id", tagger: RuleTagger | LanguageTagger | None = None
) -> DataFrame:
    """(doc_id, run, phrase): candidate phrases from token rows, for tokens that
    arrive as a table; gives what ``candidates`` gives. The marks of a document
    are gathered in order; ``run`` counts the bars before a phrase, so what
    stands between two bars is one run."""
    closes = ~words.is_content(F.col("token"), F.col("tag"), p.min_token_length)
    word = (tagger or RuleTagger()).word(F.col("token"))
    marks = tagged.select(id_col, "pos", F.when(closes, BAR).when(~closes, word).alias("mark"))
    in_order = F.array_sort(F.collect_list(F.struct("pos", "mark")))
    lines = marks.groupBy(id_col).agg(F.array_join(in_order["mark"], " ").alias("line"))
    pieces = F.split("line", r"\|", -1)
    if not p.flush_trailing:
        pieces = let(pieces, lambda all: F.slice(all, 1, F.size(all) - 1))
    runs = lines.select(id_col, F.posexplode_outer(pieces).alias("run", "piece"))
    phrase = F.btrim("piece").alias("phrase")
    return runs.select(id_col, F.col("run").cast("long").alias("run"), phrase).where(F.col("phrase") != "")


def count_phrases(phrases: Column) -> Column:
    """array<struct<phrase,tf>> in phrase order: sort, then measure the runs."""

    def measure(ordered: Column) -> Column:
        n = F.size(ordered)
        starts = F.filter(
            F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))
        )
        return F.when(
            n > 0,
            let(
                starts,
                lambda at: F.transform(
                    at,
                    lambda start, j: F.struct(
                        F.get(ordered, start).alias("phrase"),
                        (F.coalesce(F.get(at, j + 1), n) - start).cast("long").alias("tf"),
                    ),
                ),
            ),
        ).otherwise(F.expr("cast(array() as array<struct<phrase:string,tf:bigint>>)"))

    return let(F.sort_array(phrases), measure)


def phrase_bags(
    docs: DataFrame,
    tagger: Tagger | None = None,
    p: Params = DEFAULTS,
    id_col: str = "doc_id",
    text_col: str = "text",
    title_col: str | None = None,
) -> DataFrame:
    """(doc_id, dl, phrases array<struct<phrase,tf>>), one row per document.
    ``dl`` counts every candidate, also those the corpus later drops.

    With a title, ``dl`` and ``phrases`` are those of title and text, for a
    corpus; ``text_dl`` is that of the text alone, for scoring, and
    ``title_phrases``, an array<string> with repeats, what ``text_bags`` takes
    out again, so the phrases of a text are counted and kept once. A text
    without a title is not in a corpus: it has no ``phrases`` but
    ``text_phrases``, NULL elsewhere. The title ends in a full stop, which
    closes its last phrase, so its candidates come before those of the text.

    A ``LanguageTagger`` adds the document's ``lang``.
    """
    lang = [tagger.language().alias("lang")] if isinstance(tagger, LanguageTagger) else []

    def counted(c: Column) -> list[Column]:
        return [F.size(c).cast("long").alias("dl"), count_phrases(c).alias("phrases")]

    found = candidates(F.col(text_col), tagger, p)
    if title_col:
        of_title = candidates(titled_text(F.col(title_col), F.lit("")), tagger, p)
        both = F.when(F.col(text_col).isNotNull(), F.struct(of_title.alias("title"), found.alias("text")))
        def titled(c: Column) -> Column:
            alone = F.when(c["title"].isNull(), count_phrases(c["text"]))
            text_dl = F.size(c["text"]).cast("long")
            return F.struct(
                *counted(F.concat(c["title"], c["text"])),
                text_dl.alias("text_dl"),
                alone.alias("text_phrases"),
                c["title"].alias("title_phrases"),
            )

        bag = let(both, titled)
    else:
        bag = let(found, lambda c: F.struct(*counted(c)))
    found = docs.select(F.col(id_col).alias("doc_id"), *lang, bag.alias("bag"))
    return found.select("doc_id", *(["lang"] if lang else []), "bag.*")


def language_columns(df: DataFrame) -> list[str]:
    return [c for c in ("lang",) if c in df.columns]


def text_bags(bags: DataFrame) -> DataFrame:
    """The bags to score with: of texts without their titles. What a title
    added stands in ``left_out`` until ``doc_phrases`` makes rows, where
    compiled code takes it out; in the array every phrase would cost a lambda."""
    if "title_phrases" not in bags.columns:
        return bags
    return bags.select(
        "doc_id",
        *language_columns(bags),
        F.col("text_dl").alias("dl"),
        F.coalesce("text_phrases", "phrases").alias("phrases"),
        F.coalesce("title_phrases", F.array().cast("array<string>")).alias("left_out"),
    )


def doc_phrases(bags: DataFrame) -> DataFrame:
    """(doc_id, [lang,] dl, phrase, tf): one row per phrase of a document. The outer
    form keeps the optimizer from adding a filter that would compute the bag
    twice."""
    names = ["doc_id", *language_columns(bags), "dl"]
    if "left_out" not in bags.columns:
        return bags.select(*names, F.inline_outer("phrases")).where(F.col("phrase").isNotNull())
    rows = bags.select(*names, "left_out", F.inline_outer("phrases")).where(F.col("phrase").isNotNull())
    times = F.size("left_out") - F.size(F.array_remove("left_out", F.col("phrase")))
    found = F.array_contains("left_out", F.col("phrase"))
    kept = rows.where(~found | (F.col("tf") > times))
    return kept.select(*names, "phrase", F.when(found, F.col("tf") - times).otherwise(F.col("tf")).alias("tf"))


def ranked_phrases(bags: DataFrame) -> DataFrame:
    """(doc_id, rank, phrase, tf): a document's phrases, most frequent first,
    ranked inside the row."""
    by_count = F.sort_array(F.transform("phrases", lambda x: F.struct((-x["tf"]).alias("minus_tf"), x["phrase"].alias("phrase"))))
    return (
        bags.select("doc_id", F.posexplode_outer(by_count).alias("pos", "x"))
        .where(F.col("x").isNotNull())
        .select("doc_id", (F.col("pos") + 1).alias("rank"), "x.phrase", (-F.col("x.minus_tf")).alias("tf"))
    )
