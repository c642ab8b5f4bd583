"""Scratch tables in the cluster's shared folder, and helpers for Arrow batches."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised kernels work on at once; a longer text forms a chunk of its own.
CHUNK_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one of our own only where none is set and the master is local."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='recollect-')}")
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


class Scratch:
    """Parquet tables that cut lineage: executors may be lost, the files stay in the shared folder."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/recollect/{label}-{uuid.uuid4().hex}"
        atexit.register(self._quietly_remove)

    def table(self, name: str, df: DataFrame, codec: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def parts(self, name: str, df: DataFrame, by: str, n: int) -> list[DataFrame]:
        """df in n tables by a hash of the column, in folders part=0 to part=n-1 below its name; rows with equal values share one."""
        if n == 1:
            return [self.table(f"{name}/part=0", df)]
        path = f"{self.root}/{name}"
        df = df.withColumn("part", F.pmod(F.xxhash64(by), F.lit(n)).cast("int"))
        df.write.mode("overwrite").option("compression", "zstd").partitionBy("part").parquet(path)
        whole = self.spark.read.schema(df.schema).parquet(path)
        return [whole.where(F.col("part") == k).drop("part") for k in range(n)]

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def drop(self, *names: str) -> None:
        """Removes tables that no later step reads, and lets Spark free the shuffles behind them."""
        for name in names:
            self._delete(self.path(name))
        self.spark.sparkContext._jvm.System.gc()

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def _quietly_remove(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.root)
        except Exception:  # the session has ended; the folder goes with the cluster's own clean-up
            pass


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name, a column name that df does not use, so that added columns never clash."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Keys that are broadcast apart from the others, at most.
HOT_KEYS = 10_000
#: Words of 64 bits in a filter of keys; its broadcast has that many rows at most.
FILTER_WORDS = 1 << 20


def join_by_share(left: DataFrame, right: DataFrame, on: list[str], count: str, how: str = "inner") -> DataFrame:
    """left JOIN right on `on` (inner or left_semi), without a task that takes all rows of a frequent key.

    right has one row for each key, and in `count` about how many rows of left have it. Keys with more than one in
    HOT_KEYS of all those rows are fewer than HOT_KEYS, so their rows of right are broadcast; only the others are
    shuffled. Both sides are read twice: pass written tables, or what is cheap to compute. `count` is not returned.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    heavy = F.col(count) > total / HOT_KEYS
    hot, cold = right.where(heavy).drop(count), right.where(~heavy).drop(count)
    often = left.join(F.broadcast(hot), on, how)
    seldom = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how)
    return often.unionByName(seldom)


#: Tasks that the rows of a frequent key are dealt to, and the share of all rows that makes a key frequent.
SALTS, FREQUENT = 64, 1000


def join_salted(left: DataFrame, keys: DataFrame, right: DataFrame, key: str, spread: str) -> DataFrame:
    """left JOIN right on key, where right has one row for each key and its rows are too large to broadcast.

    keys: a written table with a row for each row of left, at least with the column key. Keys with more than one in
    FREQUENT of its rows are fewer than FREQUENT; only these keys are broadcast. Their rows of left are dealt to SALTS
    parts by `spread`, and their rows of right go to each part.
    """
    total = keys.count()
    often = keys.groupBy(key).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > max(total / FREQUENT, SALTS)).select(key, F.lit(True).alias("_often"))
    dealt = left.join(F.broadcast(often), key, "left").withColumn("_salt", F.when(F.col("_often"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0).cast("int")).drop("_often")
    parts = F.when(F.col("_often"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = right.join(F.broadcast(often), key, "left").withColumn("_salt", F.explode(parts)).drop("_often")
    return dealt.join(copied, [key, "_salt"]).drop("_salt")


def _bit(key: Column) -> tuple[Column, Column]:
    place = F.xxhash64(key)
    return F.pmod(place, F.lit(FILTER_WORDS)).cast("int"), F.shiftrightunsigned(place, 58).cast("int")


def with_maybe(left: DataFrame, column: str, keys: DataFrame, key: str, into: str) -> DataFrame:
    """left with a boolean: true where the column is among the keys, and for a few others; one bit for each hash.

    The bits are FILTER_WORDS words of 64, whatever the number of keys; the more keys, the more rows are true. Where
    the filter is selective, rows are spared a shuffle.
    """
    word, bit = _bit(F.col(key))
    words = keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit"))).alias("_bits"))
    of, place = _bit(F.col(column))
    marked = left.withColumn("_word", of).join(F.broadcast(words), "_word", "left")
    return marked.withColumn(into, F.coalesce(F.getbit("_bits", place) == 1, F.lit(False))).drop("_word", "_bits")


def maybe_among(left: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows of left that with_maybe() marks."""
    return with_maybe(left, column, keys, key, "_maybe").where("_maybe").drop("_maybe")


def first_of_equal(rows: DataFrame, by: str, h: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows without those that repeat `by` and the hash `h`, the repeats).

    Which of equal rows stays is fixed by writing all rows that may be equal ones; the others are not moved at all.
    """
    twins = scratch.table("twins", rows.groupBy(by, h).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select(h))
    if twins.isEmpty():
        return rows, rows.where(F.lit(False))
    marked = with_maybe(rows, h, twins, h, "_maybe")
    same = scratch.table("same", marked.where("_maybe").drop("_maybe").withColumn("_no", F.monotonically_increasing_id()))
    leads = same.groupBy(by, h).agg(F.min("_no").alias("_lead")).select("_lead")
    told = scratch.table("told", same.join(leads, F.col("_no") == F.col("_lead"), "left").drop("_no"))
    one = marked.where("not _maybe").drop("_maybe").unionByName(told.where("_lead is not null").drop("_lead"))
    return one, told.where("_lead is null").drop("_lead")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as its bytes and its offsets; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes each; every row is in one of them."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b
