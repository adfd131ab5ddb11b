
from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import oracle
from phraseloom.functions import text as tx
from phraseloom.functions.columns import base64_decode, base64_encode
from phraseloom.operators import corpus, enrich, model, phrases, ranking, records, selection, summary
from phraseloom.operators.tagging import ContextTagger, LanguageTagger
from phraseloom.params import DEFAULTS
from phraseloom.plans import incremental, pipelines
from phraseloom.sources import files, tables
from phraseloom.staging import scratch_path, stage
from phraseloom.streaming.scoring import score_stream

# the training-data operators are an optional part
if find_spec("corpus_pipeline") and find_spec("phraseloom.llm"):
    import corpus_pipeline
    from phraseloom.llm import oracle as llm_oracle
    from phraseloom.llm import queries as llm_queries
else:
    corpus_pipeline = llm_oracle = llm_queries = None

# documents of four languages; one that is missing or unknown counts as English
BY_LANGUAGE = LanguageTagger()
Query = Callable[[SparkSession, str], DataFrame]


# --- inputs -------------------------------------------------------------------
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return selection.spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table with a file path per row; file names hold words of
    the text, as titles do."""
    word = "[A-Za-z]{3,}"
    # up to the fourth word; what follows it need not be read
    head = F.regexp_extract("text", rf"(?s)\A(?:.*?{word}+){{0,4}}", 0)
    words = F.array_join(F.regexp_extract_all(head, F.lit(word), F.lit(0)), " ")
    path = F.concat("source", F.lit("/"), words, F.lit(" "), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").withColumn("file", path)


def corpus_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus of the model, in all its languages."""
    return documents(spark, sf_dir).select("doc_id", "lang", "file", "text")


def bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.corpus_bags(corpus_docs(spark, sf_dir), BY_LANGUAGE, title_col="file")


def doc_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.doc_phrases(bags(spark, sf_dir))


def staged_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For queries that read the phrases more than once."""
    return phrases.doc_phrases(stage(bags(spark, sf_dir), "bags"))


def corpus_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.build_model(corpus_docs(spark, sf_dir), BY_LANGUAGE, title_col="file")


def published_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "model")
    tables.write_model(corpus_model(spark, sf_dir), path)
    return tables.read_model(spark, path)


def scored_corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(bags of the texts, model of titles and texts) of the corpus; its
    phrases are extracted once."""
    kept = stage(bags(spark, sf_dir), "bags")
    return phrases.text_bags(kept), stage(model.phrase_model(phrases.doc_phrases(kept)), "model")


def ranked_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, m = scored_corpus(spark, sf_dir)
    return pipelines.ranked_documents(corpus_docs(spark, sf_dir), m, bags=kept)


def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per conversation turn: its text, and a record for every
    way in which content can be wrong."""
    turns = table(spark, sf_dir, "conversations").withColumn(
        "request_id", F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    )

    def record(suffix: str, data) -> F.Column:
        return F.to_json(F.struct(F.concat("request_id", F.lit(suffix)).alias("recordId"), data.alias("data")))

    body = F.concat(
        F.lit('{"values":['),
        F.concat_ws(
            ",",
            record("", F.struct(F.col("text").alias("content"))),
            record("-n", F.struct(F.col("turn").alias("content"))),
            record("-m", F.struct(F.col("role").alias("role"))),
            F.concat(F.lit('{"recordId":"'), F.col("request_id"), F.lit('-z","data":{"content":null}}')),
        ),
        F.lit("]}"),
    )
    return turns.select("request_id", "role", "text", body.alias("body"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def flat_answers(df: DataFrame) -> DataFrame:
    r = F.col("record")
    return df.select(
        "request_id",
        "pos",
        r["recordId"].alias("recordId"),
        r["data"]["keyphrases"].alias("keyphrases"),
        r["data"]["summaries"].alias("summaries"),
        F.get(r["errors"], F.lit(0)).alias("error"),
    )


# --- queries of more than one expression ----------------------------------------
def q_bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    dp = staged_phrases(spark, sf_dir)
    return rounded(model.bm25_scores(dp, corpus.phrase_counts(dp), corpus.corpus_stats(dp)), "bm25")


def q_scoring_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    dp = staged_phrases(spark, sf_dir)
    return model.scoring_inputs(dp, corpus.phrase_counts(dp))


def q_kept_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    dp = staged_phrases(spark, sf_dir)
    return corpus.drop_rare(dp, corpus.phrase_counts(dp)).select("doc_id", "phrase", "tf")


def q_phrase_model_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without titles: all languages by one read of the corpus."""
    return rounded(pipelines.build_model(corpus_docs(spark, sf_dir), BY_LANGUAGE), "bm25")


def two_batches(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All documents, as they would come in two batches."""
    late = F.crc32("source") % 2 == 1
    return docs.where(~late), docs.where(late)


def q_model_after_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model of all documents, the second half of them added to the counts
    of the first."""
    path = scratch_path(spark, "profile")
    for name, docs in zip(("first", "second"), two_batches(corpus_docs(spark, sf_dir)), strict=True):
        incremental.add_documents(docs, path, name, BY_LANGUAGE, title_col="file")
    return rounded(incremental.grown_model(spark, path), "bm25")


def q_model_after_withdrawal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model of the first batch, after all came and the second went."""
    path = scratch_path(spark, "profile")
    docs = corpus_docs(spark, sf_dir)
    incremental.add_documents(docs, path, "all", BY_LANGUAGE, title_col="file")
    incremental.withdraw_documents(two_batches(docs)[1], path, "gone", BY_LANGUAGE, title_col="file")
    return rounded(incremental.grown_model(spark, path), "bm25")


def q_model_of_phrase_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model from files of phrase counts, written per language and id."""
    path = scratch_path(spark, "delimited")
    rows = doc_phrases(spark, sf_dir)
    tables.write_delimited(rows.withColumn("file", F.concat_ws("/", "lang", F.col("doc_id").cast("string"))), path)
    counted = tables.phrases_of_files(tables.read_delimited(spark, path))
    counted = counted.withColumn("lang", F.substring_index("doc_id", "/", 1))
    return rounded(model.phrase_model(counted), "bm25")


def q_page_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = files.html_pages(table(spark, sf_dir, "pages"))
    return rounded(pipelines.build_model(pages, title_col="file"), "bm25")


def q_document_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, m = scored_corpus(spark, sf_dir)
    return rounded(ranking.document_matches(phrases.doc_phrases(kept), m), "bm25")


def q_document_keyphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, m = scored_corpus(spark, sf_dir)
    return rounded(pipelines.rank_bags(kept, m), "bm25")


def q_benchmark_keyphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New documents under the model of another corpus."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    m = published_model(spark, sf_dir)
    return rounded(pipelines.extract_keyphrases(items, m), "bm25")


def q_document_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, m = scored_corpus(spark, sf_dir)
    done = pipelines.summarize(corpus_docs(spark, sf_dir), m, bags=kept)
    return done.select("doc_id", F.to_json("summary").alias("summary"))


def q_summary_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tx.sentences(F.col("text"))
    return documents(spark, sf_dir).select(
        "doc_id",
        F.to_json(summary.fallback(pieces)).alias("repeated"),
        F.to_json(summary.fallback(pieces, replace(DEFAULTS, fallback="lead"))).alias("lead"),
    )


def q_sampled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return selection.sampled_documents(docs, replace(DEFAULTS, max_documents=250))


def q_encoded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = documents(spark, sf_dir).select("doc_id", base64_encode(F.col("file")).alias("id"))
    return coded.withColumn("decoded", base64_decode(F.col("id")))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.enrich(corpus_docs(spark, sf_dir), BY_LANGUAGE)


def q_enriched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the tables hold no time of creation
    rows = enriched(spark, sf_dir).drop("creation_ts")
    return rows.withColumns({c: F.to_json(c) for c in ("summary", "terms")})


def q_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facets at once; a document's day is made from its id."""
    docs = corpus_docs(spark, sf_dir)
    created = F.timestamp_seconds(F.lit(1_600_000_000) + F.col("doc_id") * 86_400)
    rows = pipelines.enrich(docs, BY_LANGUAGE, created=created)
    return enrich.facets(rows, "month", 12)


def q_filetype_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus of text and HTML files, enriched under the documents' model;
    pages name no language."""
    notes = documents(spark, sf_dir).select(F.col("file").alias("doc_id"), "lang", "file", "text")
    path = F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html"))
    pages = table(spark, sf_dir, "pages").select(
        path.alias("doc_id"), F.lit(None).cast("string").alias("lang"), path.alias("file"), tx.html_to_text(F.col("html")).alias("text")
    )
    rows = pipelines.enrich(notes.unionByName(pages), model=published_model(spark, sf_dir))
    with_terms = F.sum((F.size("terms") > 0).cast("long")).alias("with_terms")
    return enrich.facet(rows, "filetype", with_terms)


def q_request_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text sent where a request was expected, next to good requests."""
    body = F.when(F.col("role") == "user", F.col("text")).otherwise(F.col("body"))
    return records.request_rejects(request_bodies(spark, sf_dir).withColumn("body", body))


def q_response_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = published_model(spark, sf_dir)
    return flat_answers(pipelines.analyze_records(request_bodies(spark, sf_dir), m))


def mixed_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests, and per turn of an assistant one without records, per
    first turn one that is no request."""
    good = request_bodies(spark, sf_dir).select("request_id", "role", "body")
    empty = good.where("role = 'assistant'").select(F.concat("request_id", F.lit("-e")).alias("request_id"), F.lit('{"values":[]}').alias("body"))
    bad = good.where("request_id like '%-0'").select(F.concat("request_id", F.lit("-b")).alias("request_id"), F.substring("body", 1, 9).alias("body"))
    return good.drop("role").unionByName(empty).unionByName(bad)


def q_response_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.analyze(mixed_bodies(spark, sf_dir), published_model(spark, sf_dir))


def q_stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream could not answer, beside what it did."""
    inbox, outbox, state = (scratch_path(spark, n) for n in ("inbox", "outbox", "state"))
    bodies = mixed_bodies(spark, sf_dir)
    bodies.write.parquet(inbox)
    model_path = scratch_path(spark, "model")
    tables.write_model(corpus_model(spark, sf_dir), model_path)
    arriving = spark.readStream.schema(bodies.schema).parquet(inbox)
    score_stream(arriving, model_path, outbox, state).awaitTermination()
    return spark.read.parquet(f"{outbox}-rejects").drop("batch")


def q_document_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a text, where every file of one source is blank and
    of another missing."""
    text = F.when(F.col("source") == "src1", F.lit(" \n")).when(F.col("source") != "src2", F.col("text"))
    _, rejects = selection.split_rejects(documents(spark, sf_dir).withColumn("text", text))
    return rejects.select("doc_id", "reason")


def q_stream_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests as a stream of Parquet files, scored batch by batch."""
    model_path, inbox, outbox, state = (scratch_path(spark, n) for n in ("model", "inbox", "outbox", "state"))
    tables.write_model(corpus_model(spark, sf_dir), model_path)
    bodies = request_bodies(spark, sf_dir).select("request_id", "body")
    bodies.write.parquet(inbox)
    arriving = spark.readStream.schema(bodies.schema).parquet(inbox)
    score_stream(arriving, model_path, outbox, state).awaitTermination()
    return flat_answers(spark.read.parquet(outbox))


def q_phrase_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "delimited")
    tables.write_delimited(doc_phrases(spark, sf_dir).withColumnRenamed("doc_id", "file"), path)
    return tables.read_delimited(spark, path).select(F.col("file").cast("long").alias("doc_id"), "phrase", "tf")


# --- the contract -----------------------------------------------------------------
def entry(spark: SparkSession) -> DataFrame:
    """Build the model of a corpus, then score, summarize and enrich it."""
    return enriched(spark, "/root/testdata/sf0.001")


def training_data_queries() -> dict[str, Query]:
    if llm_queries is None:
        return {}
    return llm_queries.queries() | {"pipeline": corpus_pipeline.run}


def queries() -> dict[str, Query]:
    return training_data_queries() | {
        # sources and text
        "page_text": lambda s, d: table(s, d, "pages").select(
            "page_id", tx.html_to_text(F.col("html")).alias("text")
        ),
        "titled_text": lambda s, d: documents(s, d).select(
            "doc_id", tx.titled_text(F.col("file"), F.col("text")).alias("titled")
        ),
        "document_sentences": lambda s, d: summary.document_sentences(documents(s, d)),
        "word_counts": lambda s, d: documents(s, d).select("doc_id", tx.word_count(F.col("text")).alias("words")),
        "encoded_ids": q_encoded_ids,
        "sampled_documents": q_sampled_documents,
        # tokens to phrases
        "document_tokens": lambda s, d: phrases.document_tokens(documents(s, d)),
        "tagged_tokens": lambda s, d: phrases.tagged_tokens(documents(s, d)),
        "content_tokens": lambda s, d: phrases.content_tokens(phrases.tagged_tokens(documents(s, d))),
        "singular_tokens": lambda s, d: phrases.singular_tokens(
            phrases.content_tokens(phrases.tagged_tokens(documents(s, d)))
        ).drop("tag"),
        "context_tags": lambda s, d: phrases.tagged_tokens(documents(s, d), ContextTagger()),
        "context_phrases": lambda s, d: phrases.candidate_phrases(documents(s, d), ContextTagger()),
        "candidate_phrases": lambda s, d: phrases.candidate_phrases(corpus_docs(s, d), BY_LANGUAGE),
        "phrase_runs": lambda s, d: phrases.phrase_runs(
            phrases.tagged_tokens(corpus_docs(s, d), BY_LANGUAGE), tagger=BY_LANGUAGE
        ).drop("run"),
        "doc_phrase_counts": lambda s, d: doc_phrases(s, d).select("doc_id", "phrase", "tf"),
        "top_phrases_per_document": lambda s, d: phrases.ranked_phrases(bags(s, d)),
        # corpus
        "document_lengths": lambda s, d: corpus.document_lengths(bags(s, d)),
        "phrase_counts": lambda s, d: corpus.phrase_counts(doc_phrases(s, d)),
        "repeated_phrases": lambda s, d: corpus.repeated_phrases(corpus.phrase_counts(doc_phrases(s, d))),
        "kept_phrases": q_kept_phrases,
        "corpus_stats": lambda s, d: corpus.corpus_stats(doc_phrases(s, d)),
        # scores and model
        "scoring_inputs": q_scoring_inputs,
        "bm25_scores": q_bm25_scores,
        "doc_keyphrases": lambda s, d: rounded(
            pipelines.score_corpus(corpus_docs(s, d), BY_LANGUAGE, title_col="file"), "bm25"
        ),
        "phrase_model": lambda s, d: rounded(corpus_model(s, d), "bm25"),
        "phrase_model_of_three": lambda s, d: rounded(
            pipelines.build_model(
                corpus_docs(s, d), BY_LANGUAGE, replace(DEFAULTS, min_corpus_count=3), title_col="file"
            ),
            "bm25",
        ),
        "published_model": lambda s, d: rounded(published_model(s, d), "bm25"),
        "phrase_model_by_language": q_phrase_model_by_language,
        "model_after_append": q_model_after_append,
        "model_after_withdrawal": q_model_after_withdrawal,
        "model_of_phrase_files": q_model_of_phrase_files,
        "page_model": q_page_model,
        "phrase_file_roundtrip": q_phrase_file_roundtrip,
        # documents under a model
        "document_matches": q_document_matches,
        "document_keyphrases": q_document_keyphrases,
        "benchmark_keyphrases": q_benchmark_keyphrases,
        "sentence_hits": lambda s, d: rounded(summary.sentence_hits(ranked_corpus(s, d)), "bm25"),
        "sentence_scores": lambda s, d: rounded(summary.sentence_scores(ranked_corpus(s, d)), "total"),
        "document_summaries": q_document_summaries,
        "summary_fallback": q_summary_fallback,
        # enriched documents
        "enriched_documents": q_enriched_documents,
        "filetype_facets": q_filetype_facets,
        "facets": q_facets,
        "term_facets": lambda s, d: enrich.term_facets(enriched(s, d)),
        # requests
        "stream_rejects": q_stream_rejects,
        "document_rejects": q_document_rejects,
        "request_records": lambda s, d: records.request_records(request_bodies(s, d)),
        "request_rejects": q_request_rejects,
        "response_records": q_response_records,
        "response_bodies": q_response_bodies,
        "stream_scoring": q_stream_scoring,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql() | (llm_oracle.oracle_sql() if llm_oracle else {})
