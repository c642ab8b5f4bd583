"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are partitioned by their number of shingles (powers of two). For the class up to L, a document's
shingles in order are cut into windows of two neighbouring blocks of L, so any stretch of at most L shingles lies
within one window, and windows and items are of like size however long the document is. Minima are computed once
for the smallest blocks; those of larger blocks and of windows are minima of minima. An item that shares at least
`share` of its shingles with a window has a Jaccard similarity of 0.19 or more with it, and an item scattered over
several windows gets a chance from each; one equal minimum makes a candidate. Candidates are verified on the full
sets of document and item.

Items of fewer than FEW shingles are too small for the windows of the least class and are looked up exactly: a text
with `share` of an item's n shingles misses at most n less that many, so of any one more it has at least one. Those
are indexed, and a text that has one of them is a candidate; none is missed.

Only the index of a block of items of bounded size is broadcast; a larger benchmark is searched block by block.

Defined results: a null or empty text, and an item without words, contain nothing and are contained in nothing;
a text or item of fewer words than a shingle has its whole sequence as its only shingle; repeated rows give
repeated pairs; further columns pass through, whatever their names; an empty benchmark gives no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import chunks, flat, fresh
from .shingles import minhash_family, shingles, words

#: Words in a shingle; share of an item's shingles; hash functions; shingles of the smallest blocks.
WORDS, SHARE, HASHES, BLOCK = 5, (8, 10), 64, 16
#: Items of fewer shingles are looked up exactly.
FEW = BLOCK // 2
#: Bytes of item texts whose index is broadcast at once.
INDEX_BYTES = 16 << 20


class ItemIndex:
    """Sets, class-wise minima of a block of items, and shingles of its smallest items."""

    def __init__(self, texts: list[str | None], k: int, share: tuple[int, int] = SHARE):
        data, offsets = flat(pa.array(texts, pa.string()))
        values, at = shingles(*words(data, offsets), k)
        self.sets = [np.unique(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        a, b = self.family = minhash_family(HASHES)
        by_class: dict[int, list[int]] = {}
        keys: list[tuple[int, int]] = []
        for i, own in enumerate(self.sets):
            if 0 < len(own) < FEW:
                least = max(1, -(-share[0] * len(own) // share[1]))
                keys.extend((int(v), i) for v in own[: max(1, len(own) - least + 1)])
            elif len(own):
                by_class.setdefault(max(0, int(np.ceil(np.log2(len(own) / BLOCK)))), []).append(i)
        keys.sort()
        self.few, self.few_items = np.array([v for v, _ in keys], np.uint64), np.array([i for _, i in keys], np.int64)
        self.classes = []
        for level, items in sorted(by_class.items()):
            minima = np.array([[(self.sets[i] * x + y).min() for i in items] for x, y in zip(a, b, strict=True)])
            order = np.argsort(minima, axis=1, kind="stable")
            self.classes.append((level, np.array(items), np.take_along_axis(minima, order, axis=1), order))

    def candidates(self, values: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) for rows of shingles in order."""
        found = self._small(values, offsets)
        counts = np.diff(offsets)
        rows = np.flatnonzero(counts)
        if not len(rows) or not self.classes:
            return found
        per_row = -(-counts[rows] // BLOCK)
        first = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(per_row, out=first[1:])
        row_of = np.repeat(np.arange(len(rows)), per_row)
        starts = offsets[rows][row_of] + (np.arange(first[-1]) - first[row_of]) * BLOCK
        layouts = {0: (first, row_of)}
        for level in range(1, self.classes[-1][0] + 1):
            blocks = -(-np.diff(layouts[level - 1][0]) // 2)
            own = np.zeros(len(rows) + 1, np.int64)
            np.cumsum(blocks, out=own[1:])
            layouts[level] = own, np.repeat(np.arange(len(rows)), blocks)
        for f, (x, y) in enumerate(zip(*self.family, strict=True)):
            minima, level = np.minimum.reduceat(values * x + y, starts), 0
            for want, items, sorted_minima, order in self.classes:
                while level < want:
                    before, level = layouts[level][0], level + 1
                    own, of = layouts[level]
                    minima = np.minimum.reduceat(minima, before[of] + (np.arange(own[-1]) - own[of]) * 2)
                of = layouts[level][1]
                window = minima.copy()
                window[:-1] = np.where(of[1:] == of[:-1], np.minimum(minima[:-1], minima[1:]), minima[:-1])
                keys = sorted_minima[f]
                low = np.searchsorted(keys, window)
                hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == window)
                for h in hit:
                    j = low[h]
                    while j < len(keys) and keys[j] == window[h]:
                        found.add((int(rows[of[h]]), int(items[order[f][j]])))
                        j += 1
        return found

    def _small(self, values: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) for rows that have an indexed shingle of an item of fewer than FEW."""
        found: set[tuple[int, int]] = set()
        if not len(self.few):
            return found
        low = np.searchsorted(self.few, values)
        hit = np.flatnonzero(self.few[np.minimum(low, len(self.few) - 1)] == values)
        for row, first in set(zip((np.searchsorted(offsets, hit, "right") - 1).tolist(), low[hit].tolist(), strict=True)):
            j = first
            while j < len(self.few) and self.few[j] == self.few[first]:
                found.add((row, int(self.few_items[j])))
                j += 1
        return found


def _with_block(docs: DataFrame, text: str, index, keys: list, key_type: T.DataType, k: int, share, into: str) -> DataFrame:
    source, = fresh(docs, "leak_text")
    leak = pa.list_(pa.struct([("item", to_arrow_type(key_type)), ("n_item", pa.int64()), ("n_shared", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: ItemIndex = index.value
        for batch in batches:
            data, offsets = flat(batch.column(batch.num_columns - 1))
            leaks: list[list] = [[] for _ in range(batch.num_rows)]
            for a, b in chunks(offsets):
                values, at = shingles(*words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), k)
                sets: dict[int, np.ndarray] = {}
                for row, item in sorted(own.candidates(values, at)):
                    if row not in sets:
                        sets[row] = np.unique(values[at[row] : at[row + 1]])
                    n, shared = len(own.sets[item]), int(np.isin(own.sets[item], sets[row], assume_unique=True).sum())
                    if share[1] * shared >= share[0] * n:
                        leaks[a + row].append({"item": keys[item], "n_item": n, "n_shared": shared})
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(leaks, leak)], names=[*batch.schema.names[:-1], into])

    kind = T.ArrayType(T.StructType([T.StructField("item", key_type), T.StructField("n_item", T.LongType()), T.StructField("n_shared", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField(into, kind)])
    return docs.select("*", F.col(text).cast("string").alias(source)).mapInArrow(run, schema)


def with_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", k: int = WORDS, share=SHARE, into: str = "leaks") -> DataFrame:
    """docs with an array of the items that each text contains: (item, n_item, n_shared).

    share: the least part of an item's shingles, as numerator and denominator.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_key).alias("item"), F.col(item_text).cast("string").alias("body"))
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("body"))).first()[0] or 0) // INDEX_BYTES))
    out, parts = docs, []
    for i in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == i).collect()
        index = spark.sparkContext.broadcast(ItemIndex([r["body"] for r in own], k, share))
        name, = fresh(out, into)
        out = _with_block(out, text, index, [r["item"] for r in own], benchmark.schema[item_key].dataType, k, share, name)
        parts.append(name)
    if len(parts) == 1:
        return out
    return out.select(*docs.columns, F.concat(*parts).alias(parts[0]))


def leak_pairs(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", **options) -> DataFrame:
    """One row for each document and item that it contains: key, item_key, n_item, n_shared, containment."""
    found = with_leaks(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), benchmark, "_text", item_key, into="_leaks", **options)
    pairs = found.select("_key", F.explode("_leaks").alias("_leak"))
    leak: Column = F.col("_leak")
    return pairs.select(F.col("_key").alias(key), leak["item"].alias(item_key), leak["n_item"].alias("n_item"), leak["n_shared"].alias("n_shared"), (leak["n_shared"] / leak["n_item"]).alias("containment"))


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every benchmark item against every whole document."""
    return leak_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _shingle_sql(table: str, key: str, k: int) -> str:
    return rf"""
  SELECT DISTINCT {key}, unnest(CASE
      WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
  FROM (SELECT {key}, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM {table})"""


OP6_SQL = f"""
WITH d AS ({_shingle_sql("documents", "doc_id", WORDS)}),
b AS ({_shingle_sql("benchmark", "item_id", WORDS)}),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
s AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (shingle) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM s JOIN n USING (item_id) WHERE {SHARE[1]} * n_shared >= {SHARE[0]} * n_item
"""
