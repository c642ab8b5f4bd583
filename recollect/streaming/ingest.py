"""Idempotent ingest as a Structured Streaming job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUEST = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("messages", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType()), T.StructField("timestamp", T.LongType())]))),
    ]
)


def requests(spark: SparkSession, folder: str, schema: T.StructType = REQUEST) -> DataFrame:
    """Requests as a stream of JSON files."""
    return spark.readStream.schema(schema).json(folder)


def once(stream: DataFrame, user: str = "user_id", request: str = "request_id") -> DataFrame:
    """Each request of a user once, for ever: the state keeps every id, as the request log does."""
    return stream.dropDuplicates([user, request])


def append_messages(stream: DataFrame, target: str, checkpoint: str):
    """Starts a run over all that has arrived; a batch that is repeated after a crash replaces its own files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("user_id", "session_id", "request_id", F.posexplode("messages").alias("msg_pos", "m")).select("user_id", "session_id", "request_id", "msg_pos", "m.*")
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return once(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_counts(events: DataFrame, time: str, width: str, late: str, *keys: str, total: str | None = None) -> DataFrame:
    """Counts (and sums of `total`) per window and key, of a stream or a table; events later than `late` are left out of a stream."""
    sums = [F.sum(total).alias("total")] if total else []
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), *sums)
