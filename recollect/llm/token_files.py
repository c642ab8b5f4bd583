"""Token counts by separator scan: flat files of token ids hold documents one after another, without an index.

Writing: texts are tokenised and their ids go to shard files as unsigned 16-bit little-endian integers, each
document followed by the end-of-document id. Spark's text writer makes the files, with that id as line separator,
so they land in whatever store the shared folder is in.

Reading: a file is cut into blocks; a vectorised search finds the separators of each block; a prefix scan over the
blocks of a file carries the tokens after a block's last separator to the block where their document ends.

Defined results: a null or empty text has 0 tokens; repeated rows are documents of their own; a null id is kept; a file that does
not end with a separator ends with one more document, if any tokens follow the last; an empty file holds none;
an odd last byte is an error.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, chunks, first_of_equal, flat

#: Where the public vocabularies are (only the driver reads them), the ranks used, and the free id that ends documents.
VOCABULARIES = "/opt/tokenizers"
RANKS, END = "byte_bpe_50k.tiktoken", 50256
#: Fixed value: how the vocabulary splits texts into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens in a block; text bytes behind a shard; parts of the corpus that are written, scanned and removed in turn.
BLOCK, SHARD_BYTES, WAVES = 1 << 18, 24 << 20, 2


def merge_ranks(folder: str = VOCABULARIES, ranks: str = RANKS) -> dict[bytes, int]:
    """The byte strings of a ranks file with their ranks."""
    with open(f"{folder}/{ranks}", "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encoder(merges: dict[bytes, int], pattern: str = PATTERN):
    """The byte-level tokenizer of a vocabulary."""
    import tiktoken

    return tiktoken.Encoding("recollect", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


def with_tokens(docs: DataFrame, text: str, into: str, folder: str = VOCABULARIES, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """Replaces a text column by a binary one: its ids as 16-bit little-endian integers.

    The vocabulary, of a size that its file fixes, is broadcast.
    """
    merges = docs.sparkSession.sparkContext.broadcast(merge_ranks(folder, ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(merges.value, pattern).encode_ordinary
        for batch in batches:
            rest = batch.slice(0).columns[:-1]
            _, offsets = flat(batch.column(batch.num_columns - 1))
            for a, b in chunks(offsets):
                texts = batch.column(batch.num_columns - 1).slice(a, b - a).to_pylist()
                ids = [np.asarray(encode(t), np.dtype("<u2")).tobytes() if t else b"" for t in texts]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in rest), pa.array(ids, pa.binary())], names=[*batch.schema.names[:-1], into])

    kept = [c for c in docs.columns if c != text]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(into, T.BinaryType())])
    return docs.select(*kept, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


def write_token_files(tokens: DataFrame, path: str, shard: str, order: list[str], ids: str, end: int = END) -> None:
    """One flat file for each value of shard, its documents in the given order, the separator after each."""
    separator = np.asarray([end], np.dtype("<u2")).tobytes().decode("latin-1")
    dealt = tokens.repartition(shard).sortWithinPartitions(shard, *order)
    # the cast keeps the bytes as they are
    dealt.select(shard, F.col(ids).cast("string").alias("value")).write.partitionBy(shard).option("lineSep", separator).option("encoding", "ISO-8859-1").text(path)


def _scan_blocks(end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, tails, inner = [], [], []
            for block in batch.column("ids"):
                ids = np.frombuffer(block.as_buffer(), np.dtype("<u2"))
                found = np.flatnonzero(ids == end)
                firsts.append(int(found[0]) if len(found) else None)
                tails.append(len(ids) - 1 - int(found[-1]) if len(found) else len(ids))
                inner.append(np.diff(found) - 1)
            lengths = pa.array(inner, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array(firsts, pa.int64()), pa.array(tails, pa.int64()), lengths], names=["file", "block", "first", "tail", "inner"]
            )

    return run


def count_tokens(spark: SparkSession, path: str, end: int = END, block: int = BLOCK) -> DataFrame:
    """(file, place, n_tokens): the documents of flat token files, numbered from 0 within each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    width = 2 * block
    blocks = f"transform(sequence(0L, (length - 1) div {width}), i -> struct(i as block, substring(content, cast(i * {width} + 1 as int), {width}) as ids))"
    cut = files.where("length > 0").select(F.col("path").alias("file"), F.explode(F.expr(blocks)).alias("cut")).select("file", "cut.*")
    scanned = cut.mapInArrow(_scan_blocks(end), "file string, block long, first long, tail long, inner array<long>")
    # tokens that an open document has in earlier blocks: their tails since the last block with a separator
    along = Window.partitionBy("file").orderBy("block")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    has = F.when(F.col("first").isNotNull(), 1).otherwise(0)
    n_ends = F.when(F.col("first").isNull(), 0).otherwise(F.size("inner") + 1)
    placed = scanned.withColumns({"group": F.coalesce(F.sum(has).over(along), F.lit(0)), "before": F.coalesce(F.sum(n_ends).over(earlier), F.lit(0))})
    # a block with a separator opens a group with its tail, the blocks without one that follow add theirs
    within = Window.partitionBy("file", "group").orderBy("block")
    placed = placed.withColumn("open", F.sum("tail").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumns({"carried": F.coalesce(F.lag("open").over(along), F.lit(0)), "is_last": F.lead("block").over(along).isNull()})
    ends = F.when(F.col("first").isNull(), F.array().cast("array<long>")).otherwise(F.concat(F.array(F.col("carried") + F.col("first")), "inner"))
    unfinished = F.when(F.col("is_last") & (F.col("open") > 0), F.array("open")).otherwise(F.array().cast("array<long>"))
    rows = placed.select("file", "before", F.posexplode(F.concat(ends, unfinished)).alias("at", "n_tokens"))
    return rows.select("file", (F.col("before") + F.col("at")).alias("place"), "n_tokens")


def document_token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = VOCABULARIES, ranks: str = RANKS, end: int = END, shard_bytes: int = SHARD_BYTES, waves: int = WAVES, block: int = BLOCK) -> DataFrame:
    """(key, n_tokens): texts written to flat token files, and counted again by scanning those.

    The files of one wave exist at a time. Documents are dealt to shards by id and text, so one id (or none) that very
    many have is spread; of rows with equal id and text one is written, and its count stands for all. A document's
    place in its file is its rank by id and hash among the documents of the shard.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = docs.select(F.col(key).alias("_key"), F.xxhash64(body).alias("_h"), body.alias("_text"))
    one, extra = first_of_equal(slim, "_key", "_h", scratch)
    dealt = one.select("_key", "_h", F.octet_length("_text").alias("_bytes"))
    dealt = scratch.table("dealt", dealt)
    n_bytes = dealt.agg(F.sum("_bytes")).first()[0] or 0
    shards = waves * max(1, -(-n_bytes // (shard_bytes * waves)))
    shard = F.pmod(F.xxhash64("_key", "_h"), F.lit(shards)).cast("int")
    rank = Window.partitionBy("_shard").orderBy("_key", "_h")
    places = dealt.withColumn("_shard", shard).withColumn("place", F.row_number().over(rank) - 1)
    parts = []
    for wave in range(waves):
        own = one.withColumn("_shard", shard).where(F.col("_shard") % waves == wave)
        tokens = with_tokens(own, "_text", "ids", folder, ranks)
        write_token_files(tokens, scratch.path(f"files-{wave}"), "_shard", ["_key", "_h"], "ids", end)
        counted = count_tokens(spark, scratch.path(f"files-{wave}"), end, block)
        of = F.regexp_extract("file", r"_shard=(\d+)/", 1).cast("int")
        joined = places.where(F.col("_shard") % waves == wave).join(counted.select(of.alias("_shard"), "place", "n_tokens"), ["_shard", "place"], "left")
        parts.append(scratch.table(f"counts-{wave}", joined.select("_key", "_h", "n_tokens")))
        scratch.drop(f"files-{wave}")
    counts = reduce(DataFrame.unionByName, parts)
    out = counts.select(F.col("_key").alias(key), "n_tokens")
    # the repeats of a row, which may be very many, are counted before they meet its number of tokens
    times = extra.groupBy(F.col("_key").alias("_k"), F.col("_h").alias("_g")).agg(F.count(F.lit(1)).cast("int").alias("_times"))
    again = counts.join(times, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_h") == F.col("_g")))
    return out.unionByName(again.select(F.col("_key").alias(key), "n_tokens", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(key, "n_tokens"))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of documents."""
    return document_token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
