"""Command line: build a model, answer requests, enrich a corpus.

    python -m phraseloom build   --input DOCS --model MODEL
    python -m phraseloom analyze --requests DIR --model MODEL --output DIR
    python -m phraseloom stream  --requests DIR --model MODEL --output DIR --state DIR
    python -m phraseloom enrich  --input DOCS --output DIR [--model MODEL]

``DOCS`` is a folder of text and HTML files, or with ``--format parquet`` a
table with ``doc_id`` and ``text``, with ``--format phrases`` (build only) a
folder of ``file TAB phrase TAB count`` lines, or with ``--format table`` a catalog table,
bucketed by ``doc_id`` if text should not be shuffled. Partition sizes are set
from the input; all else comes from spark-submit.
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseloom import session
from phraseloom.functions.lexicon import LEXICONS
from phraseloom.operators.selection import split_rejects
from phraseloom.operators.tagging import LanguageTagger, RuleTagger
from phraseloom.params import DEFAULTS, Params
from phraseloom.operators.model import phrase_model
from phraseloom.plans import incremental, pipelines
from phraseloom.sources import files, requests, tables
from phraseloom.staging import Workspace
from phraseloom.streaming.scoring import score_stream


def load(spark: SparkSession, args: argparse.Namespace, workspace: Workspace) -> DataFrame:
    """Documents with doc_id, file, text and, where known, modified. Rejects
    are always written."""
    if args.format == "files":
        documents, unread = files.fetch_documents(spark, args.input, args.folder, workspace=workspace)
    elif args.format == "text":
        documents, unread = files.read_text_folder(spark, args.input), None
    else:
        documents = spark.table(args.input) if args.format == "table" else spark.read.parquet(args.input)
        unread = None
        if "file" not in documents.columns:
            documents = documents.withColumn("file", F.col("doc_id").cast("string"))
    documents, blank = split_rejects(documents)
    path = args.rejects or f"{(getattr(args, 'output', None) or args.model).rstrip('/')}-rejects"
    columns = [F.col(c).cast("string").alias(c) for c in ("file", "reason")]
    refused = blank.select(*columns)
    refused = refused if unread is None else refused.unionByName(unread.select(*columns))
    refused.write.mode("overwrite").parquet(path)
    return documents


def by_language(docs: DataFrame) -> LanguageTagger | None:
    """Documents that name their language are read by it."""
    return LanguageTagger() if "lang" in docs.columns else None


def grow(spark: SparkSession, docs: DataFrame, tagger, p: Params, args: argparse.Namespace) -> None:
    """Add or withdraw the documents as one segment, and derive the model."""
    change = incremental.withdraw_documents if args.withdraw else incremental.add_documents
    change(docs, args.profile, args.segment, tagger, p, title_col="file")
    tables.write_model(incremental.grown_model(spark, args.profile, p), args.model)


def params(args: argparse.Namespace) -> Params:
    given = {k: getattr(args, k) for k in ("min_bm25", "max_documents", "fallback") if getattr(args, k, None) is not None}
    return replace(DEFAULTS, **given)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    p, tagger = params(args), RuleTagger(LEXICONS[args.lang]) if args.lang else None
    source = getattr(args, "input", None) or args.requests
    if getattr(args, "format", "") != "table":
        session.apply(spark, session.input_bytes(spark, source))
    if args.job == "build":
        if args.format == "phrases":
            counts = tables.phrases_of_files(tables.read_delimited(spark, args.input))
            tables.write_model(phrase_model(counts, p), args.model)
            return
        with Workspace(spark) as workspace:
            docs = load(spark, args, workspace)
            if args.profile:
                grow(spark, docs, tagger or by_language(docs), p, args)
                return
            sample = args.max_documents is not None
            model = pipelines.build_model(docs, tagger or by_language(docs), p, title_col="file", sample=sample)
            tables.write_model(model, args.model)
    elif args.job == "stream":
        score_stream(
            requests.stream_requests(spark, args.requests), args.model, args.output, args.state, tagger, p, args.rejects
        ).awaitTermination()
    else:
        with Workspace(spark) as workspace:
            model = tables.read_model(spark, args.model) if args.model else None
            if args.job == "analyze":
                bodies = requests.read_requests(spark, args.requests)
                answers, refused = pipelines.analyze_with_rejects(bodies, model, tagger, p, workspace)
                requests.write_responses(answers, args.output)
                refused.write.mode("overwrite").parquet(args.rejects or args.output.rstrip("/") + "-rejects")
            else:
                docs = load(spark, args, workspace)
                tagger = tagger or (by_language(docs) if model is None else None)
                created = F.col("modified") if "modified" in docs.columns else None
                rows = pipelines.enrich(docs, tagger, p, created=created, model=model, workspace=workspace)
                tables.write_enriched(rows, args.output)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="phraseloom")
    jobs = top.add_subparsers(dest="job", required=True)
    build, analyze, stream, enrich = (jobs.add_parser(j) for j in ("build", "analyze", "stream", "enrich"))
    for job, extra in ((build, ("phrases",)), (enrich, ())):
        job.add_argument("--input", required=True)
        job.add_argument("--format", choices=("files", "text", "parquet", "table", *extra), default="files")
        job.add_argument("--folder", default="", help="start in a sub-folder of the input")
        job.add_argument("--min-bm25", type=float)
    build.add_argument("--model", required=True)
    build.add_argument("--profile", help="a table of phrase counts that grows: the input is added to it, and all of it counts")
    build.add_argument("--segment", default="first", help="name of this input in the profile; a name used before is replaced")
    build.add_argument("--withdraw", action="store_true", help="take the input out of the profile")
    build.add_argument("--sample", dest="max_documents", type=int, help="use so many documents, at random")
    enrich.add_argument("--model", help="score against this model instead of the corpus's own")
    enrich.add_argument("--output", required=True)
    for job in (analyze, stream):
        job.add_argument("--requests", required=True)
        job.add_argument("--model", required=True)
        job.add_argument("--output", required=True)
    stream.add_argument("--state", required=True)
    for job in (analyze, stream, enrich):
        job.add_argument("--fallback", choices=("repeat", "lead"))
    for job in (build, analyze, stream, enrich):
        job.add_argument("--rejects", help="where to write what could not be used; by default OUTPUT-rejects or MODEL-rejects")
        job.add_argument("--lang", choices=sorted(LEXICONS), help="of all documents; by default what their column lang says, else English")
    return top


def main(argv: list[str] | None = None) -> None:
    run(SparkSession.builder.appName("phraseloom").getOrCreate(), parser().parse_args(argv))


if __name__ == "__main__":
    main()
