"""Request and response envelopes, errors kept as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phraseloom.functions.columns import let
from phraseloom.operators.ranking import phrase_names
from phraseloom.operators.summary import no_phrases
from phraseloom.schemas import REQUEST_DDL

ERROR_PREFIX = "Error processing the Document: "
NO_PHRASE = "no candidate phrase found"


def request_rows(bodies: DataFrame, body_col: str = "body", id_col: str = "request_id") -> DataFrame:
    """All that bodies hold, by one parse of each: (request_id, pos, recordId,
    content, problem, corrupt_body). A row per record; one row without ``pos``
    for a request without records, and for a body that is no request, which
    then is ``corrupt_body``. ``content`` is set only where it is a JSON
    string."""

    def parts(values: Column) -> Column:
        corrupt = F.when(values.isNull(), F.coalesce(F.col(body_col), F.lit("")))
        return F.struct(values.alias("values"), corrupt.alias("corrupt_body"))

    parsed = bodies.select(
        F.col(id_col).alias("request_id"), let(F.from_json(body_col, REQUEST_DDL)["values"], parts).alias("p")
    )
    rows = parsed.select("request_id", "p.values", "p.corrupt_body")
    rows = rows.select("request_id", "corrupt_body", F.posexplode_outer("values").alias("pos", "record"))
    value = F.expr("try_variant_get(record.data, '$.content', 'variant')")
    kind = F.schema_of_variant(value)
    problem = (
        F.when(F.col("record.data").isNull() | value.isNull(), "content is missing")
        .when(kind == "VOID", "content is null")
        .when(kind != "STRING", "content is not a string")
    )
    content = F.when(kind == "STRING", F.expr("try_variant_get(record.data, '$.content', 'string')"))
    return rows.select(
        "request_id",
        "pos",
        F.col("record.recordId").alias("recordId"),
        content.alias("content"),
        F.when(F.col("pos").isNotNull(), problem).alias("problem"),
        "corrupt_body",
    )


def records_of(rows: DataFrame) -> DataFrame:
    """(request_id, pos, recordId, content, problem): one row per record."""
    return rows.where(F.col("pos").isNotNull()).drop("corrupt_body")


def rejects_of(rows: DataFrame) -> DataFrame:
    """Bodies that fail as a whole, kept with their text."""
    return rows.where(F.col("corrupt_body").isNotNull()).select("request_id", "corrupt_body")


def empty_of(rows: DataFrame) -> DataFrame:
    """(request_id) of requests without any record."""
    return rows.where(F.col("pos").isNull() & F.col("corrupt_body").isNull()).select("request_id")


def request_rejects(bodies: DataFrame, body_col: str = "body", id_col: str = "request_id") -> DataFrame:
    return rejects_of(request_rows(bodies, body_col, id_col))


def request_records(bodies: DataFrame, body_col: str = "body", id_col: str = "request_id") -> DataFrame:
    return records_of(request_rows(bodies, body_col, id_col))


def record_key() -> Column:
    """Identifies a record: a request may use one recordId twice."""
    return F.concat_ws("#", F.col("request_id").cast("string"), F.col("pos").cast("string"))


def response_record(problem: Column, keyphrases: Column, summary: Column) -> Column:
    """struct<recordId,data,errors,warnings>; needs ``recordId`` in the row.
    The two data fields are JSON text."""
    data = F.map_from_arrays(
        F.array(F.lit("keyphrases"), F.lit("summaries")),
        F.array(F.to_json(phrase_names(F.coalesce(keyphrases, no_phrases()))), F.to_json(summary)),
    )
    nothing = F.expr("cast(map() as map<string,string>)")
    none = F.expr("cast(array() as array<string>)")
    return F.struct(
        F.col("recordId"),
        F.when(problem.isNull(), data).otherwise(nothing).alias("data"),
        F.when(problem.isNull(), none).otherwise(F.array(F.concat(F.lit(ERROR_PREFIX), problem))).alias("errors"),
        none.alias("warnings"),
    )


def responses(records: DataFrame, empty: DataFrame | None = None) -> DataFrame:
    """(request_id, body): one JSON answer per request, records in order.
    A request is one row on the way in, so its records fit one row here.
    ``empty`` requests are answered with no records."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.to_json("record").alias("json"))))
    answers = records.groupBy("request_id").agg(
        F.concat(
            F.lit('{"values":['), F.array_join(F.transform(ordered, lambda x: x["json"]), ","), F.lit("]}")
        ).alias("body")
    )
    if empty is None:
        return answers
    return answers.unionByName(empty.select("request_id", F.lit('{"values":[]}').alias("body")))
