"""Record shapes, ids, and how the relational tables play the roles of memory layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHANGE = T.StructType([T.StructField("time", T.StringType()), T.StructField("content", T.StringType())])
METADATA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("time", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("tag", T.ArrayType(T.StringType())),
        T.StructField("source", T.ArrayType(T.StringType())),
        T.StructField("changelog", T.ArrayType(CHANGE)),
    ]
)
MEMORY = T.StructType([T.StructField("memory", T.StringType()), T.StructField("metadata", METADATA)])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def session_number(record_id: Column) -> Column:
    """N of session_N and session_N_...; null for other ids."""
    return F.nullif(F.regexp_extract(record_id, r"^session_([0-9]+)(?:$|_)", 1), F.lit("")).try_cast("int")


def message_number(record_id: Column) -> Column:
    """M of session_N_M; null for summaries and atoms."""
    return F.nullif(F.regexp_extract(record_id, r"^session_[0-9]+_([0-9]+)$", 1), F.lit("")).try_cast("int")


def memory_record(memory: Column, kind: str | Column, record_id: Column, time: Column | None = None, role: Column | None = None, tag: Column | None = None, source: Column | None = None) -> Column:
    """The nested record that all layers share; absent lists are empty."""
    empty = F.array().cast("array<string>")
    blank = F.lit("")
    return F.struct(
        memory.alias("memory"),
        F.struct(
            record_id.alias("id"),
            (F.lit(kind) if isinstance(kind, str) else kind).alias("type"),
            (time if time is not None else blank).alias("time"),
            (role if role is not None else blank).alias("role"),
            (tag if tag is not None else empty).alias("tag"),
            (source if source is not None else empty).alias("source"),
            F.array().cast(T.ArrayType(CHANGE)).alias("changelog"),
        ).alias("metadata"),
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """The message layer: a corpus holds twenty conversations, a conversation is a session."""
    rows = table(spark, folder, "conversations")
    return rows.select(
        F.expr("conv_id div 20").alias("corpus_id"),
        F.col("conv_id").alias("session_no"),
        (F.col("turn") + 1).alias("msg_no"),
        F.format_string("session_%d_%d", "conv_id", F.col("turn") + 1).alias("id"),
        "role",
        "text",
    )
