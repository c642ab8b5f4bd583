"""Repeated byte strings by difference-cover suffix sorting.

A byte goes if it is covered by a string of LENGTH bytes that also starts earlier: in a document of a smaller id,
or before in the same document. Strings never cross documents and are judged on the input.

Distribution. Every start of a LENGTH-byte string gets the least hash of the K-byte grams within the string, so
equal strings get equal values, and neighbouring starts with one value form a run. Runs whose value no other run
has, and whose least gram stands in them once, hold nothing that repeats. Runs with equal value and equal bytes are
one text: the earliest stands for it and every other is a repeat as a whole, so a group of copies is pre-aggregated to
one run. Only values with several different texts, or with one that may repeat itself, are sorted. A value that very
many texts share (a common passage in many contexts) is first cut finer by further hash functions of the same strings,
which keeps equal strings together, and what of it stays large is cut into single strings, whose 128-bit hashes are
counted. So texts are dealt to buckets of bounded size by value. The join of runs by value is done for a part of all
values at a time, and texts are cut into runs for a part of all documents at a time, so that only a part is on disk.

Sorting, in each bucket, is the difference-cover algorithm (modulo 3): sort the triples at sampled positions, name
them, recurse on the names until a name spans LENGTH bytes or names are unique, sort the remaining suffixes by a
byte and the rank of the sampled suffix after it, and merge. In the suffix order, starts of equal strings are
adjacent; comparing neighbours' prefixes gives classes, and all but the earliest start of a class are repeats.

Defined results: a null text counts as empty; rows with equal ids are ordered by their bytes, and equal rows count as
repeats of one another except the first, whichever that is; a null id comes first; columns other than those named are
ignored; texts shorter than LENGTH lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks, first_of_equal, flat, join_by_share, maybe_among, with_maybe
from .shingles import mix, prefix_hash, range_hash

#: Bytes of a string that repeats, and of the grams whose least hash finds its partners.
LENGTH, GRAM = 100, 16
#: Different texts of one value, and their mean bytes, beyond which further hash functions split it, and how many.
MANY, MEAN, SPLITS = 2048, 512, 3
#: Starts in a run at most, and bytes of text in a bucket about: its arrays should fit the processor's cache.
RUN, BUCKET_BYTES = 1 << 16, 1 << 18
#: Parts of all values whose runs are joined at a time, and parts of all documents whose texts are cut at a time.
VALUE_PARTS, DOC_PARTS = 4, 2
#: Bytes of text whose runs are found at a time; the arrays for it take about two hundred times that.
CHUNK = 1 << 19
_TABLE = np.random.default_rng(4).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OTHER = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of the GRAM bytes from each position on (by doubling; GRAM is a power of two)."""
    out, width = _TABLE[data], 1
    while width < GRAM and len(out) > width:
        out = out[:-width] * np.uint64(pow(_BASE, width, 2**64)) + out[width:]
        width *= 2
    return mix(out + np.uint64(seed * 0x632BE59BD9B4E019 % 2**64))


def window_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """Least of `width` neighbouring values from each position on."""
    out, have = hashes, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def runs_of(data: np.ndarray, offsets: np.ndarray, seeds=(0,)) -> tuple[np.ndarray, ...]:
    """(row, first start within the row, number of starts, value, body hash, periodic) of all runs of all rows.

    A run in whose bytes the least gram stands several times may repeat itself: it is marked as periodic.
    """
    nothing = *(np.zeros(0, np.int64) for _ in range(5)), np.zeros(0, bool)
    if len(data) < LENGTH:
        return nothing
    value = None
    for seed in seeds:
        grams = gram_hashes(data, seed)
        least = window_minima(grams, LENGTH - GRAM + 1)
        value = least if value is None else mix(value * np.uint64(3) + least)
    sizes = np.diff(offsets)
    own = np.maximum(sizes - (LENGTH - 1), 0)
    within = np.repeat(np.tile([True, False], len(sizes)), np.stack([own, sizes - own], 1).ravel())
    start = np.flatnonzero(within[: len(value)])
    if not len(start):
        return nothing
    value = value[start]
    change = np.ones(len(start), bool)
    change[1:] = (value[1:] != value[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(change)
    length = np.diff(np.append(at, len(start)))
    if length.max() > RUN:
        parts = -(-length // RUN)
        skip = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * RUN
        at, length = np.repeat(at, parts) + skip, np.minimum(np.repeat(length, parts) - skip, RUN)
    first = start[at]
    body = mix(range_hash(prefix_hash(_TABLE[data]), first, first + length + LENGTH - 1) + length.astype(np.uint64))
    row = np.searchsorted(offsets, first, "right") - 1
    return row, first - offsets[row], length, value[at].view(np.int64), body.view(np.int64), _times(grams, least, first, length) > 1


def _times(grams: np.ndarray, least: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How often the least gram of each run stands in it."""
    # only grams that are the least of some string can be; the greatest of the minima around a gram tells which are
    wide = LENGTH - GRAM + 1
    edge = np.zeros(wide - 1, np.uint64)
    around = ~window_minima(~np.concatenate([edge, least, edge]), wide)
    lowest = np.flatnonzero(around == grams)
    a, b = np.searchsorted(lowest, first), np.searchsorted(lowest, first + length + (wide - 1))
    ends = np.cumsum(b - a)
    those = lowest[np.arange(ends[-1]) + np.repeat(a - (ends - (b - a)), b - a)]
    return np.add.reduceat((grams[those] == np.repeat(least[first], b - a)).astype(np.int32), ends - (b - a))


# ---- difference-cover suffix sorting ----


def _names(padded: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the triples at the given positions, from 1 on (equal triples share one), and how many differ."""
    wide = int(padded.max()) + 1
    key = padded[at].astype(np.uint64) * np.uint64(wide) + padded[at + 1].astype(np.uint64)
    if wide**3 >= 2**64:
        _, key = np.unique(key, return_inverse=True)
        key = key.astype(np.uint64)
    key = key * np.uint64(wide) + padded[at + 2].astype(np.uint64)
    order = np.argsort(key)
    new = np.ones(len(key), np.int64)
    ordered = key[order]
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new)
    return rank, int(new.sum())


def suffix_order(text: np.ndarray, span: int, depth: int) -> np.ndarray:
    """All suffixes in the order of their first `depth` bytes at least; those that agree so far stand in any order.

    text: symbols from 1 on, each of which stands for `span` bytes.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(5, text.dtype)])
    # a sampled position past the end keeps the two halves apart when the first of them ends a triple
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sampled = np.concatenate([one, two])
    rank = np.zeros(n + 5, np.int64)
    if len(sampled):
        names, kinds = _names(padded, sampled)
        if kinds < len(names) and span * 3 < depth:
            order = suffix_order(names, span * 3, depth)
            names[order] = np.arange(1, len(order) + 1)
        rank[sampled] = names
    size, wide = int(rank.max()) + 1, int(padded.max()) + 1
    zero = np.arange(0, n, 3)
    rest = zero[np.argsort(padded[zero] * size + rank[zero + 1])]
    sampled = sampled[np.argsort(rank[sampled])]
    sampled = sampled[sampled < n]
    # merge: each suffix's place is the number of lesser ones in the three sorted lists
    lists = [rest, sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]]
    by_one = [padded[x] * size + rank[x + 1] for x in lists[:2]]
    by_two = [(padded[x] * wide + padded[x + 1]) * size + rank[x + 2] for x in (lists[0], lists[2])] if wide * wide * size < 2**63 else _packed(padded, rank, lists[0], lists[2])
    by_rank = [rank[x] for x in lists[1:]]
    places = [
        np.arange(len(lists[0])) + np.searchsorted(by_one[1], by_one[0]) + np.searchsorted(by_two[1], by_two[0]),
        np.arange(len(lists[1])) + np.searchsorted(by_one[0], by_one[1]) + np.searchsorted(by_rank[1], by_rank[0]),
        np.arange(len(lists[2])) + np.searchsorted(by_two[0], by_two[1]) + np.searchsorted(by_rank[0], by_rank[1]),
    ]
    return np.concatenate(lists)[np.argsort(np.concatenate(places))]


def _packed(padded: np.ndarray, rank: np.ndarray, *lists: np.ndarray) -> list[np.ndarray]:
    """Keys in the order of (symbol, symbol, rank) for lists whose symbols are too many for one integer."""
    wide, size = int(padded.max()) + 1, int(rank.max()) + 1
    pairs = [padded[x] * wide + padded[x + 1] for x in lists]
    known = np.unique(np.concatenate(pairs))
    return [np.searchsorted(known, p) * size + rank[x + 2] for p, x in zip(pairs, lists, strict=True)]


def start_classes(segments: list[bytes], starts: np.ndarray) -> np.ndarray:
    """Classes of the LENGTH-byte strings at the first starts[i] positions of each segment, one after another.

    Neighbours in the suffix order that agree on LENGTH bytes share a class.
    """
    data = np.frombuffer(b"".join(segments), np.uint8)
    order = suffix_order(data.astype(np.int64) + 1, 1, LENGTH)
    sizes = np.array([len(s) for s in segments])
    within = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    wanted = within < np.repeat(starts, sizes)
    chosen = order[wanted[order]]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(np.uint64).reshape(-1)
    alive = np.arange(1, len(chosen))
    for at in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        alive = alive[eight[chosen[alive] + at] == eight[chosen[alive - 1] + at]]
    new = np.ones(len(chosen), np.int64)
    new[alive] = 0
    out = np.empty(len(data), np.int64)
    out[chosen] = np.cumsum(new)
    return out[wanted]


# ---- the operator ----

_RUN = "_doc {key}, _h long, _at int, _starts int"
_PLACE = ("_doc", "_h", "_at")


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(_doc, _h, _text): the hash tells rows of one id apart."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).alias("_doc"), F.xxhash64(body).alias("_h"), body.alias("_text"))


def _runs_batch(ids: list[pa.Array], found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    row, at, starts, value, body, periodic = found
    take = pa.array(row)
    columns = [*(x.take(take) for x in ids), pa.array(at.astype(np.int32)), pa.array(starts.astype(np.int32)), pa.array(value), pa.array(body), pa.array(periodic)]
    return pa.RecordBatch.from_arrays(columns, names=["_doc", "_h", "_at", "_starts", "value", "body", "periodic"])


def _runs_type(rows: DataFrame) -> str:
    return f"{_RUN.format(key=rows.schema['_doc'].dataType.simpleString())}, value long, body long, periodic boolean"


def _runs(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("_text"))
            for a, b in chunks(offsets, CHUNK):
                found = runs_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield _runs_batch([batch.column(c).slice(a, b - a) for c in ("_doc", "_h")], found)

    return rows.mapInArrow(run, _runs_type(rows))


def _with_runs(rows: DataFrame, wanted: DataFrame, *also: str) -> DataFrame:
    """rows with the runs of `wanted` that lie in them, as an array of (at, starts, ...)."""
    per_doc = wanted.groupBy("_doc", "_h").agg(F.collect_list(F.struct(F.col("_at").alias("at"), F.col("_starts").alias("starts"), *also)).alias("_runs"))
    per_doc = per_doc.select(F.col("_doc").alias("_of"), F.col("_h").alias("_oh"), "_runs")
    return rows.join(per_doc, F.col("_doc").eqNullSafe(F.col("_of")) & (F.col("_h") == F.col("_oh"))).select("_doc", "_h", "_text", "_runs")


def _pieces(batch: pa.RecordBatch):
    """(rows, fields of their runs, bytes of the runs, offsets of those) for parts of a batch of bounded size."""
    data, offsets = flat(batch.column("_text"))
    for a, b in chunks(offsets, CHUNK):
        lists = batch.column("_runs").slice(a, b - a)
        fields = lists.flatten()
        row = a + np.repeat(np.arange(b - a), lists.value_lengths().to_numpy(zero_copy_only=False))
        own = {fields.type.field(i).name: column.to_numpy(zero_copy_only=False) for i, column in enumerate(fields.flatten())}
        width = own["starts"].astype(np.int64) + (LENGTH - 1)
        ends = np.zeros(len(row) + 1, np.int64)
        np.cumsum(width, out=ends[1:])
        yield row, own, data[np.arange(ends[-1]) + np.repeat(offsets[row] + own["at"] - ends[:-1], width)], ends


def _split(rows: DataFrame, wanted: DataFrame, singly: bool) -> DataFrame:
    """The runs in `wanted` cut into finer ones: by SPLITS further hash functions, or singly, each start by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, own, data, ends in _pieces(batch):
                if singly:
                    piece = np.repeat(np.arange(len(row)), own["starts"])
                    at = np.arange(len(piece)) - np.repeat(np.cumsum(own["starts"]) - own["starts"], own["starts"])
                    start = ends[piece] + at
                    value, body = (mix(range_hash(prefix_hash(table[data]), start, start + LENGTH)).view(np.int64) for table in (_TABLE, _OTHER))
                    found = (piece, at, np.ones(len(piece), np.int64), value, body, np.zeros(len(piece), bool))
                else:
                    found = runs_of(data, ends, range(1, SPLITS + 1))
                piece, at, *rest = found
                yield _runs_batch([batch.column("_doc"), batch.column("_h")], (row[piece], own["at"][piece] + at, *rest))

    # few documents have such runs: a filter of bounded size spares the texts of most others their shuffle
    return _with_runs(maybe_among(rows, "_h", wanted, "_h"), wanted).mapInArrow(run, _runs_type(rows))


def _segments(rows: DataFrame, wanted: DataFrame, buckets: int) -> DataFrame:
    """The bytes of the runs in wanted: (_doc, _h, _at, _starts, bucket, bytes), dealt to buckets by value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, own, data, ends in _pieces(batch):
                take = pa.array(row)
                bucket = (mix(own["value"].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                body = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
                columns = [batch.column("_doc").take(take), batch.column("_h").take(take), pa.array(own["at"], pa.int32()), pa.array(own["starts"], pa.int32()), pa.array(bucket), body]
                yield pa.RecordBatch.from_arrays(columns, names=["_doc", "_h", "_at", "_starts", "bucket", "bytes"])

    kind = rows.schema["_doc"].dataType.simpleString()
    return _with_runs(rows, wanted, "value").mapInArrow(run, f"{_RUN.format(key=kind)}, bucket long, bytes binary")


def _sort_bucket(group: pd.DataFrame) -> pd.DataFrame:
    """Runs of starts whose string starts earlier in the bucket's texts as well."""
    # in the order of positions, so that the first of a class is its earliest
    group = group.sort_values(["_doc", "_h", "_at"], na_position="first", kind="stable").reset_index(drop=True)
    starts = group["_starts"].to_numpy()
    classes = start_classes(list(group["bytes"]), starts)
    repeat = np.ones(len(classes), bool)
    repeat[np.unique(classes, return_index=True)[1]] = False
    row = np.repeat(np.arange(len(group)), starts)
    at = group["_at"].to_numpy()[row] + np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts)
    found = np.flatnonzero(repeat)
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1] + 1) | (row[found[1:]] != row[found[:-1]])
    first = found[new]
    n = np.diff(np.append(np.flatnonzero(new), len(found)))
    return pd.DataFrame({"_doc": group["_doc"].to_numpy()[row[first]], "_h": group["_h"].to_numpy()[row[first]], "_at": at[first].astype(np.int32), "_starts": n.astype(np.int32)})


def _shared(runs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The runs whose value several runs have, or one that may repeat itself."""
    values = runs.groupBy("value").agg(F.count(F.lit(1)).alias("c"), F.max("periodic").alias("looped"))
    several = scratch.table(f"several-{name}", values.where("c > 1 or looped"))
    scratch.drop()
    shared = scratch.table(f"shared-{name}", join_by_share(runs.drop("periodic"), several, ["value"], "c"))
    scratch.drop(f"several-{name}")
    return shared


def _same_runs(found: DataFrame, scratch: Scratch, name: str, parts: int = 1) -> tuple[DataFrame, DataFrame]:
    """(repeats, leads) of the runs in found: those with the bytes of an earlier run, and the first of each text that others share.

    leads: (value, body, _doc, _h, _at, _starts, periodic, kinds, weight) of the values that several runs have, or one
    that may repeat itself; kinds counts the value's different texts and weight their bytes.
    """
    shared = []
    for k, runs in enumerate(scratch.parts(f"runs-{name}", found, "value", parts)):
        shared.append(_shared(runs, scratch, f"{name}-{k}"))
        scratch.drop(f"runs-{name}/part={k}")
    shared = reduce(DataFrame.unionByName, shared)
    own = F.struct(*_PLACE, "_starts")
    leads = shared.groupBy("value", "body").agg(F.min(own).alias("lead"), F.max("looped").alias("periodic"), F.count(F.lit(1)).alias("c"))
    leads = scratch.table(f"leads-{name}", leads)
    copied = leads.where("c > 1").select("value", "body", "lead", "c")
    again = join_by_share(shared, copied, ["value", "body"], "c").where(~own.eqNullSafe(F.col("lead"))).select(*_PLACE, "_starts")
    again = scratch.table(f"again-{name}", again)
    scratch.drop(f"runs-{name}", *(f"shared-{name}-{k}" for k in range(parts)))
    kinds = leads.groupBy("value").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("lead._starts").cast("long") + (LENGTH - 1)).alias("weight"), F.max("periodic").alias("looped"))
    kinds = scratch.table(f"kinds-{name}", kinds.where("kinds > 1 or looped").drop("looped").withColumn("n", F.col("kinds")))
    wanted = join_by_share(leads.select("value", "lead.*"), kinds, ["value"], "n")
    return again, wanted


def repeated_runs(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(_doc, _h, _at, _starts): runs of starts whose string also starts earlier; rows has no two equal ones."""
    again, wanted = _same_runs(_runs(rows), scratch, "first", VALUE_PARTS)
    wanted = scratch.table("wanted", wanted)
    scratch.drop("leads-first", "kinds-first")
    large = (F.col("kinds") > MANY) | (F.col("weight") > MANY * MEAN)
    sorted_, found = wanted.where(~large), [again]
    for name in ("finer", "single"):
        hot = wanted.where(large)
        if hot.isEmpty():
            break
        again, leads = _same_runs(_split(rows, hot, name == "single"), scratch, name)
        found.append(again)
        if name == "single":
            # equal strings are equal texts by now: nothing is left to sort
            break
        wanted = scratch.table(f"wanted-{name}", leads)
        sorted_ = sorted_.unionByName(wanted.where(~large))
    n_bytes = sorted_.agg(F.sum(F.col("_starts").cast("long") + (LENGTH - 1))).first()[0] or 0
    segments = []
    for k in range(DOC_PARTS):
        own = F.pmod(F.xxhash64("_doc", "_h"), F.lit(DOC_PARTS)) == k
        segments.append(scratch.table(f"segments-{k}", _segments(rows.where(own), sorted_.where(own), max(1, -(-n_bytes // BUCKET_BYTES)))))
        scratch.drop()
    scratch.drop(*(f"{x}-{name}" for name in ("finer", "single") for x in ("leads", "kinds")), "wanted", "wanted-finer")
    kind = rows.schema["_doc"].dataType.simpleString()
    found.append(scratch.table("sorted", reduce(DataFrame.unionByName, segments).groupBy("bucket").applyInPandas(_sort_bucket, _RUN.format(key=kind))))
    scratch.drop(*(f"segments-{k}" for k in range(DOC_PARTS)))
    return reduce(DataFrame.unionByName, found)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept, spans): kept are the remaining bytes, spans the removed ones."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    # of rows with equal id and text, those after the first repeat as a whole
    rows, extra = first_of_equal(_identified(docs, key, text), "_doc", "_h", scratch)
    found = repeated_runs(rows, scratch).groupBy("_doc", "_h").agg(F.collect_list(F.struct(F.col("_at").alias("a"), (F.col("_at") + F.col("_starts") + (LENGTH - 1)).alias("b"))).alias("_cuts"))
    found = scratch.table("cuts", found.select(F.col("_doc").alias("_of"), F.col("_h").alias("_oh"), "_cuts"))
    scratch.drop("again-first", "again-finer", "again-single", "sorted")
    # texts without cuts need not meet any, and a filter of bounded size spares most of them their shuffle
    marked = with_maybe(rows, "_h", found, "_oh", "_maybe")
    joined = marked.where("_maybe").join(found, F.col("_doc").eqNullSafe(F.col("_of")) & (F.col("_h") == F.col("_oh")), "left").select("_doc", "_text", "_cuts", F.lit(False).alias("_extra"))
    none = F.lit(None).cast(found.schema["_cuts"].dataType).alias("_cuts")
    joined = joined.unionByName(marked.where("not _maybe").select("_doc", "_text", none, F.lit(False).alias("_extra")))
    joined = joined.unionByName(extra.select("_doc", "_text", none, F.lit(True).alias("_extra")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("_text"))
            out: list[tuple] = []
            for r, (cuts, whole) in enumerate(zip(batch.column("_cuts").to_pylist(), batch.column("_extra").to_pylist(), strict=True)):
                body = data[offsets[r] : offsets[r + 1]].tobytes()
                if whole and len(body) >= LENGTH:
                    cuts = [{"a": 0, "b": len(body)}]
                spans: list[list[int]] = []
                for a, b in sorted((x["a"], x["b"]) for x in cuts or ()):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                edges = [0, *(x for span in spans for x in span), len(body)]
                kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(body), len(body) - len(kept), len(spans), kept, [{"start": a, "end": b} for a, b in spans]))
            n, removed, count, kept, spans = zip(*out, strict=True) if out else ((),) * 5
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [batch.column("_doc"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return joined.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:bigint,end:bigint>>")


def op5_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of remove_repeats() over every whole text of documents."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
