"""File trees as DataFrames of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseloom.functions.columns import file_type
from phraseloom.functions.patterns import BLANK
from phraseloom.functions.text import html_to_text
from phraseloom.staging import Workspace, stage

TEXT_TYPES = ("txt", "text", "md", "csv", "log")
HTML_TYPES = ("html", "htm", "xhtml")


# A larger content does not fit into a column.
MAX_BYTES = (1 << 31) - 1


def _binary(spark: SparkSession, root: str, folder: str, glob: str | None, skip: bool = False) -> DataFrame:
    """``skip``: files that vanish or fail while they are read give no row."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if skip:
        reader = reader.option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(f"{root.rstrip('/')}/{folder.strip('/')}" if folder else root)


def list_files(spark: SparkSession, root: str, folder: str = "", glob: str | None = None) -> DataFrame:
    """(file, length, modified) of everything below ``root/folder``. Contents
    are not read. A listing that fails fails the job. Files of length zero are
    not listed: Spark's file scan skips them."""
    return _binary(spark, root, folder, glob, skip=False).select(
        F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified")
    )


def with_prefix(files: DataFrame, prefix: str, path_col: str = "file") -> DataFrame:
    return files.where(F.col(path_col).startswith(prefix))


def fetch_documents(
    spark: SparkSession,
    root: str,
    folder: str = "",
    glob: str | None = None,
    max_bytes: int = MAX_BYTES,
    workspace: Workspace | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects): text of plain and HTML files. A file that cannot
    be read, or not as text, is set aside with a reason; the others go on.

    Files are listed first, without their contents. What then cannot be opened
    or read to its end is skipped by its task, and is found again as what the
    listing holds and the written table of contents does not. Every listed file
    is a document or a reject, once. Text is extracted once, when it is
    written.
    """
    listing = stage(list_files(spark, root, folder, glob), "listing", workspace)
    kind = F.col("filetype")
    supported = kind.isin(*TEXT_TYPES, *HTML_TYPES)
    files = listing.withColumn("filetype", file_type(F.col("file")))
    unread = (
        F.when(~supported, F.concat(F.lit("unsupported file type: "), kind))
        .when(F.col("length") > max_bytes, F.concat(F.lit("larger than "), F.lit(max_bytes), F.lit(" bytes")))
        .otherwise("could not be read")
    )

    # the limits are tested by the scan, before it opens a file
    raw = _binary(spark, root, folder, glob, skip=True).where(F.col("length") <= max_bytes)
    raw = raw.select(F.col("path").alias("file"), file_type(F.col("path")).alias("filetype"), "content")
    raw = raw.where(supported).withColumn("content", F.col("content").cast("string"))
    text = F.when(kind.isin(*HTML_TYPES), html_to_text(F.col("content"))).otherwise(F.col("content"))
    reason = F.when(~F.is_valid_utf8("content"), "not valid UTF-8").when(
        ~F.col("content").rlike(f"[^{BLANK}]"), "file is blank"
    )
    contents = raw.select("file", reason.alias("reason"), F.when(reason.isNull(), text).alias("text"))
    contents = stage(contents, "contents", workspace)

    # a file that appeared after the listing is left to the next run
    known = files.select("file", "filetype", "modified")
    documents = contents.where("reason is null").join(known, "file")
    documents = documents.select(F.col("file").alias("doc_id"), "file", "filetype", "modified", "text")
    judged = contents.where("reason is not null").select("file", "reason").join(known.select("file"), "file", "left_semi")
    rest = files.join(contents.select("file"), "file", "left_anti").select("file", unread.alias("reason"))
    return documents, judged.unionByName(rest)


def read_text_folder(spark: SparkSession, root: str, glob: str = "*.txt") -> DataFrame:
    """(doc_id, file, text): every matching file below ``root``, whole."""
    lines = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    )
    path = F.col("_metadata.file_path")
    return lines.select(path.alias("doc_id"), path.alias("file"), F.col("value").alias("text"))


def html_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(doc_id, file, text) from a table of raw web pages."""
    return pages.select(
        F.col(id_col).alias("doc_id"), F.col("url").alias("file"), html_to_text(F.col(html_col)).alias("text")
    )
