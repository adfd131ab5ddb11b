"""Schemas of the durable relations."""

from pyspark.sql import types as T

PHRASE_COUNT = T.StructType([
    T.StructField("phrase", T.StringType()),
    T.StructField("tf", T.LongType()),
])

MODEL = T.StructType([
    T.StructField("phrase", T.StringType()),
    T.StructField("bm25", T.DoubleType()),
])

DELIMITED_PHRASES = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("phrase", T.StringType()),
    T.StructField("tf", T.LongType()),
])

# `data` stays a variant: a map of strings would turn a number into text and
# hide the type error that has to be reported.
REQUEST_DDL = "values array<struct<recordId string, data variant>>"
REQUEST_COLUMN = "request_body"

RESPONSE = T.StructType([
    T.StructField("recordId", T.StringType()),
    T.StructField("data", T.MapType(T.StringType(), T.StringType())),
    T.StructField("errors", T.ArrayType(T.StringType())),
    T.StructField("warnings", T.ArrayType(T.StringType())),
])

ENRICHED = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("filetype", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("summary", T.ArrayType(T.StringType())),
    T.StructField("terms", T.ArrayType(T.StringType())),
    T.StructField("creation_ts", T.TimestampType()),
])
