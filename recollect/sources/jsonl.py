"""JSON Lines: tolerant scans and versioned writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.replies import strict_json


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of all lines."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def parse(lines: DataFrame, schema: T.StructType, line: str = "line") -> DataFrame:
    """Adds record (null for blank and bad lines) and status: record, array, blank or bad.

    A line that holds an array of objects gives one row for each; a scalar is bad.
    """
    body = F.trim(line)
    many = F.from_json(body, T.ArrayType(schema), {"mode": "PERMISSIVE"})
    kind = F.when(body == "", "blank").when(strict_json(body).isNull(), "bad").when(body.startswith("["), "array").when(body.startswith("{"), "record").otherwise("bad")
    rows = lines.withColumn("status", kind)
    one = F.array(F.from_json(body, schema))
    records = F.when(F.col("status") == "array", many).when(F.col("status") == "record", one).otherwise(F.array(F.lit(None).cast(schema)))
    return rows.select("*", F.explode_outer(records).alias("record"))


def report(lines: DataFrame, line: str = "line", *groups: str) -> DataFrame:
    """n_records, n_bad and n_blank of lines."""
    body = F.trim(line)
    good = strict_json(body).isNotNull() & body.rlike(r"^[\[{]")
    return lines.groupBy(*groups).agg(F.count_if((body != "") & good).alias("n_records"), F.count_if((body != "") & ~good).alias("n_bad"), F.count_if(body == "").alias("n_blank"))


def write_version(rows: DataFrame, folder: str, version: str) -> str:
    """Writes a whole new version beside the others; readers follow latest_version()."""
    path = f"{folder}/version={version}"
    rows.write.mode("errorifexists").json(path)
    return path


def latest_version(spark: SparkSession, folder: str) -> str | None:
    """The greatest version that was written completely."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return None
    done = [s.getPath().getName() for s in files.listStatus(root) if files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return f"{folder}/{max(done)}" if done else None
