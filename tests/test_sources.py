from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from phraseloom import build_model, enrich
from phraseloom.operators.corpus import phrase_counts
from phraseloom.operators.enrich import facet, term_facets
from phraseloom.operators.phrases import doc_phrases, phrase_bags
from phraseloom.operators.selection import sampled_documents, split_rejects, spread
from phraseloom.params import Params
from phraseloom.schemas import ENRICHED
from phraseloom.sources import files, tables
from phraseloom.staging import Workspace, scratch_path, staging_dir


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "store"
    for name, content in {
        "a.txt": b"Rare disease.",
        "sub/b.txt.txt": b"Old drug.\nNew drug.",
        "sub/deep/c.html": b"<p>Other nations</p><script>x</script>",
        "sub/deep/d.pdf": b"%PDF",
        "sub/e.txt": b"\xff\xfe broken",
        "f.txt": b" \n",
        "nothing.txt": b"",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return str(root)


def names(df):
    return sorted(r.file.rsplit("/", 1)[1] for r in df.collect())


def test_list_files(spark, tree):
    everything = files.list_files(spark, tree)
    assert names(everything) == ["a.txt", "b.txt.txt", "c.html", "d.pdf", "e.txt", "f.txt"]
    assert names(files.list_files(spark, tree, folder="sub/deep")) == ["c.html", "d.pdf"]
    assert names(files.list_files(spark, tree, glob="*.html")) == ["c.html"]
    inside = everything.select(F.regexp_replace("file", "^.*/store/", "").alias("file"))
    assert names(files.with_prefix(inside, "sub/")) == ["b.txt.txt", "c.html", "d.pdf", "e.txt"]


def test_a_listing_that_fails_fails_the_job(spark, tree):
    with pytest.raises(Exception):
        files.list_files(spark, tree + "/nowhere").collect()


def test_fetch_sets_bad_files_aside(spark, tree):
    documents, rejects = files.fetch_documents(spark, tree)
    assert {r.file.rsplit("/", 1)[1]: r.text for r in documents.collect()} == {
        "a.txt": "Rare disease.", "b.txt.txt": "Old drug.\nNew drug.", "c.html": "Other nations",
    }
    assert {r.file.rsplit("/", 1)[1]: r.reason for r in rejects.collect()} == {
        "d.pdf": "unsupported file type: pdf", "e.txt": "not valid UTF-8", "f.txt": "file is blank",
    }
    bags = phrase_bags(documents, title_col="file")
    got = {r.doc_id.rsplit("/", 1)[1]: [x.phrase for x in r.phrases] for r in bags.collect()}
    assert got == {"a.txt": ["rare disease"], "b.txt.txt": ["new drug", "old drug"], "c.html": ["html"]}


def test_text_folder(spark, tree):
    docs = files.read_text_folder(spark, tree + "/sub")
    assert {r.file.rsplit("/", 1)[1] for r in docs.collect()} == {"b.txt.txt", "e.txt"}
    assert docs.where(F.col("doc_id").endswith("b.txt.txt")).first().text == "Old drug.\nNew drug."


def test_rows_without_text_are_rejected_with_a_reason(spark):
    docs = spark.createDataFrame([(1, "x"), (2, None), (3, "  ")], "doc_id int, text string")
    good, bad = split_rejects(docs)
    assert [r.doc_id for r in good.collect()] == [1]
    assert {r.doc_id: r.reason for r in bad.collect()} == {2: "text is missing", 3: "text is blank"}


def test_only_lines_of_three_fields_are_read(spark, tmp_path):
    (tmp_path / "p.txt").write_text('a\tb c\t2\na\tb\na\tb\tc\t1\n\n"q\tx"y\t7\nz\tw\tmany\n')
    got = [tuple(r) for r in tables.read_delimited(spark, str(tmp_path)).collect()]
    assert got == [("a", "b c", 2), ('"q', 'x"y', 7), ("z", "w", None)]


def test_delimited_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("f/1", 'say "x"', 3), ("f,2", "ein größerer", 1)], "file string, phrase string, tf long")
    tables.write_delimited(rows, str(tmp_path / "d"))
    assert tables.read_delimited(spark, str(tmp_path / "d")).exceptAll(rows).count() == 0


def test_append_and_model_tables(spark, tmp_path):
    rows = spark.createDataFrame([("d1", "x", 1)], "doc_id string, phrase string, tf long")
    for _ in range(2):
        tables.append_phrases(rows, str(tmp_path / "phrases"))
    assert phrase_counts(spark.read.parquet(str(tmp_path / "phrases"))).first().cf == 2
    for score in (5.0, 6.0):  # a rebuild replaces
        model = spark.createDataFrame([("x", score), ("a", score)], "phrase string, bm25 double")
        tables.write_model(model, str(tmp_path / "model"))
    assert [r.bm25 for r in tables.read_model(spark, str(tmp_path / "model")).collect()] == [6.0, 6.0]


def test_sample_is_the_smallest_digests(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    p = Params(max_documents=200, sample_seed="s")
    got = {r.doc_id for r in sampled_documents(docs, p).collect()}
    plain = docs.orderBy(F.md5(F.concat(F.lit("s:"), F.col("doc_id").cast("string")))).limit(200)
    assert got == {r.doc_id for r in plain.collect()}
    assert sampled_documents(docs, p).count() == 200
    assert got != {r.doc_id for r in sampled_documents(docs, Params(max_documents=200)).collect()}
    assert sampled_documents(docs, Params(max_documents=9999)).count() == 5000
    assert sampled_documents(docs.limit(0), p).count() == 0


def test_model_of_a_sample(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    p = Params(max_documents=60, min_bm25=1.0)
    chosen = sampled_documents(docs, p)
    assert build_model(docs, p=p, sample=True).count() == build_model(chosen, p=p).count() > 0


def test_spread(spark, sf_dir):
    scan = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert spread(scan).rdd.getNumPartitions() == 8
    wide = scan.repartition(20)
    assert spread(wide) is wide


def test_staging_folder_is_the_session_setting(spark):
    folder = staging_dir(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir")
    with Workspace(spark) as ws:
        staged = ws.stage(spark.range(3).toDF("n"), "numbers")
        assert ws.paths[0].startswith(folder) and staged.count() == 3
        path = ws.paths[0]
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_enriched_corpus_of_files(spark, tree, tmp_path):
    documents, _ = files.fetch_documents(spark, tree)
    model = spark.createDataFrame([("rare disease", 9.0), ("old drug", 6.0)], "phrase string, bm25 double")
    rows = enrich(documents, model=model, created=F.col("modified"))
    assert [(f.name, f.dataType) for f in rows.schema] == [(f.name, f.dataType) for f in ENRICHED]
    got = {r.filename: r for r in rows.collect()}
    assert got["a.txt"].terms == ["rare disease"] and got["a.txt"].creation_ts is not None
    assert got["c.html"].terms == [] and got["c.html"].summary == ["Other nations"]
    assert {r.filetype: r.docs for r in facet(rows, "filetype").collect()} == {"txt": 2, "html": 1}
    assert {r.term: r.docs for r in term_facets(rows).collect()} == {"rare disease": 1, "old drug": 1}
    tables.write_enriched(rows, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.where("filetype = 'html'").count() == 1
    tables.write_enriched(rows.withColumn("filetype", F.lit("")), str(tmp_path / "plain"))
    assert spark.read.parquet(str(tmp_path / "plain")).where("filetype = 'none'").count() == rows.count()


def test_phrases_of_documents_with_any_id_type(spark):
    docs = spark.createDataFrame([("x/1", "Rare disease.")], "doc_id string, text string")
    assert [tuple(r) for r in doc_phrases(phrase_bags(docs)).collect()] == [("x/1", 1, "rare disease", 1)]


def test_listed_files_are_answers_or_rejects_whatever_happens(spark, tree, monkeypatch):
    """A file that is gone when it is read, one that cannot be opened and one
    that is too large are rejects; nothing fails."""
    from pathlib import Path

    def stage_and_lose(df, name, workspace=None):
        found = files_stage(df, name, workspace)
        if name == "listing":
            Path(tree, "a.txt").unlink()  # vanishes
            Path(tree, "sub/deep/c.html").unlink()
            Path(tree, "sub/deep/c.html").mkdir()  # no longer a file
            Path(tree, "new.txt").write_text("Late file.")
        return found

    files_stage = files.stage
    monkeypatch.setattr(files, "stage", stage_and_lose)
    listed = {r.file for r in files.list_files(spark, tree).collect()}
    Path(tree, "sub/large.txt").write_text("Large file. " * 20)
    listed |= {next(iter(listed)).rsplit("/store/", 1)[0] + "/store/sub/large.txt"}
    documents, rejects = files.fetch_documents(spark, tree, max_bytes=100)
    good = [r.file for r in documents.collect()]
    bad = {r.file: r.reason for r in rejects.collect()}
    assert len(good) + rejects.count() == len(listed) and set(good) | set(bad) == listed
    assert {k.rsplit("/", 1)[1]: v for k, v in bad.items()} == {
        "a.txt": "could not be read", "c.html": "could not be read", "large.txt": "larger than 100 bytes",
        "d.pdf": "unsupported file type: pdf", "e.txt": "not valid UTF-8", "f.txt": "file is blank",
    }


def test_text_of_an_expression_is_evaluated_once(spark, sf_dir):
    from phraseloom.functions.text import html_to_text

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", html_to_text(F.col("html")).alias("text"))
    good, bad = split_rejects(pages)
    for part in (good, bad):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert plan.count("<!--") == 1, plan
    assert good.columns == ["page_id", "text", "reason"][:2] and bad.columns == ["page_id", "text", "reason"]


def test_facets_of_a_written_tree(spark, tree):
    import os

    from phraseloom.operators.enrich import facets

    for name, when in (("a.txt", "2021-03-05"), ("sub/b.txt.txt", "2021-03-20"), ("sub/deep/c.html", "2022-01-01")):
        stamp = __import__("datetime").datetime.fromisoformat(when + "T12:00:00+00:00").timestamp()
        os.utime(f"{tree}/{name}", (stamp, stamp))
    documents, _ = files.fetch_documents(spark, tree)
    known = spark.createDataFrame([("rare disease", 9.0), ("old drug", 6.0)], "phrase string, bm25 double")
    rows = enrich(documents, model=known, created=F.col("modified"))
    got = {(r.field, r.value, r.docs, r.rank) for r in facets(rows).collect()}
    assert got == {
        ("filetype", "txt", 2, 1), ("filetype", "html", 1, 2),
        ("creation_ts", "2021-03-01", 2, 1), ("creation_ts", "2022-01-01", 1, 2),
        ("terms", "old drug", 1, 1), ("terms", "rare disease", 1, 2),
    }
    assert {r.value for r in facets(rows, "year", 1).where("field = 'creation_ts'").collect()} == {"2021-01-01"}


REFERENCES = {
    "caf&#233; &#8217;x&#x27; &#X2122;&trade;": "café ’x' ™™",
    "a &amp; b &amp;#39; &amp;amp;": "a & b &#39; &amp;",
    "&unknown; & &; &#; &#x; &#0; &#xD800; &#1114112; &#9999999;": "&unknown; & &; &#; &#x; &#0; &#xD800; &#1114112; &#9999999;",
    "&lt;p&gt; &nbsp;&eacute;&apos;&quot;": "<p> é'\"",
    "&#128512;&#x1F600;": "😀😀",
    "&": "&", "": "", "no reference; here": "no reference; here", "&amp": "&amp", "tail &lt;": "tail <",
}


def test_character_references_are_decoded_once(spark):
    import duckdb

    import oracle
    from phraseloom.functions.text import html_to_text

    rows = spark.createDataFrame([(k, v) for k, v in REFERENCES.items()], "html string, want string")
    got = rows.select("html", "want", html_to_text(F.col("html")).alias("text")).collect()
    assert {r.html: r.text for r in got} == REFERENCES
    con = duckdb.connect()
    for html, want in REFERENCES.items():
        assert con.execute(f"SELECT {oracle.page_text_sql('x')} FROM (SELECT ? AS x)", [html]).fetchone()[0] == want
    assert spark.range(1).select(html_to_text(F.lit(None).cast("string")).alias("t")).first().t is None
