"""Near-duplicates by MinHash: banded candidates, sequential Bayesian verification, exact confirmation.

Documents with equal shingle sets are one class; only the least of each class (by id) goes on. Representatives
that share a band of their signature are candidates. A candidate pair's signatures are compared batch by batch;
after each batch the pair is dropped once the posterior probability of the wanted similarity, given the matches
so far, is under the miss probability. Survivors are confirmed on the full shingle sets. Components of the
confirmed links are the groups.

Buckets never expand into all pairs. First each member is compared with two members of its bucket (the least and
the greatest id); then components merge what is linked, and only members of different components of a bucket
remain to be compared: pairwise in small buckets; large ones that share members are compared in blocks of about
PER_BLOCK members, where pairs stay within a task. No bucket is capped.

Defined results: texts without words have an empty set and link with nothing; equal non-empty sets always link;
rows of a null id are returned with their set size, a null component and kept; rows with equal ids are one node
of the graph; further columns pass through, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, flat, fresh, join_by_share, join_salted
from .graph import components
from .shingles import minhash, minhash_family, mix, set_digest, shingle_sets

#: Words in a shingle; least similarity as numerator and denominator.
WORDS, SIMILAR = 5, (80, 100)
#: Bands and rows of the signature: a pair of similarity 0.8 shares no band with probability 3e-6.
BANDS, ROWS = 32, 5
#: Signature values in a batch of the sequential test, and the miss probability at which it drops a pair.
BATCH, MISS = 32, 1e-6
#: Members up to which a bucket's remaining pairs are joined, and members of a block beyond that.
SMALL, PER_BLOCK = 24, 256


def least_matches(n: int, similar: float, miss: float) -> int:
    """The least number of matches among n with posterior P(similarity >= similar) of miss or more (uniform prior)."""
    total = 0.0
    for m in range(n + 1):
        # the beta posterior's upper tail as a binomial sum
        total += comb(n + 1, m) * similar**m * (1 - similar) ** (n + 1 - m)
        if total >= miss:
            return m
    return n + 1


def sequential_survivors(left: np.ndarray, right: np.ndarray, similar: float, miss: float = MISS) -> np.ndarray:
    """Indices of rows of two signature matrices that no batch drops."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int32)
    for at in range(0, left.shape[1], BATCH):
        matches = matches + (left[alive, at : at + BATCH] == right[alive, at : at + BATCH]).sum(axis=1)
        keep = matches >= least_matches(min(at + BATCH, left.shape[1]), similar, miss)
        alive, matches = alive[keep], matches[keep]
        if not len(alive):
            break
    return alive


def with_set_features(docs: DataFrame, text: str, k: int, signatures: bool = False) -> DataFrame:
    """Adds set size n and the 128-bit digest (hi, lo) of each text's shingle set, and its signature if asked for."""
    family = minhash_family(BANDS * ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(batch.num_columns - 1))
            for a, b, values, at in shingle_sets(data, offsets, k):
                hi, lo = set_digest(values, at)
                sizes = np.diff(at)
                columns = [*batch.slice(a, b - a).columns[:-1], pa.array(sizes), pa.array(hi), pa.array(lo)]
                if signatures:
                    found = iter(minhash(values, at, family))
                    columns.append(pa.array([next(found).tobytes() if n else None for n in sizes], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kept = [f for f in docs.schema.fields if f.name != text]
    names = [*(f.name for f in kept), "_n", "_hi", "_lo", *(["_sig"] if signatures else [])]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "_n long", "_hi long", "_lo long", *(["_sig binary"] if signatures else [])])
    return docs.select(*(f.name for f in kept), F.col(text).cast("string").alias(text)).mapInArrow(run, ddl)


def with_bands(signed: DataFrame) -> DataFrame:
    """One row (band, doc) for each band of each signature of (_doc, _sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            data, _ = flat(batch.column("_sig"))
            rows = data.view(np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(salt, rows.shape[:2]).copy()
            for j in range(ROWS):
                key = mix(key ^ rows[:, :, j])
            docs = np.repeat(batch.column("_doc").to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(docs)], names=["band", "doc"])

    return signed.select("_doc", "_sig").mapInArrow(run, "band long, doc long")


def _pruned(pairs: DataFrame, signed: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) that the sequential test does not drop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (flat(batch.column(c))[0].view(np.uint32).reshape(-1, BANDS * ROWS) for c in ("_left", "_right"))
            alive = pa.array(sequential_survivors(left, right, similar))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(alive), batch.column("b").take(alive)], names=["a", "b"])

    return _with_both(pairs, signed, "_sig").mapInArrow(run, "a long, b long")


def _with_both(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """(a, b, _left, _right): the column of both sides of a written table of pairs; a side may be in very many pairs."""
    with_left = join_salted(pairs, pairs, values.select(F.col("_doc").alias("a"), F.col(column).alias("_left")), "a", "b")
    both = join_salted(with_left, pairs, values.select(F.col("_doc").alias("b"), F.col(column).alias("_right")), "b", "a")
    return both.select("a", "b", "_left", "_right")


def _blocks(members: DataFrame) -> DataFrame:
    """Adds block and owner to rows of (cluster, doc, component).

    A component of more than PER_BLOCK members has blocks of its own and owns them; smaller ones share blocks.
    """
    sizes = members.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    alone = F.col("n") > PER_BLOCK
    shared = sizes.where(~alone).groupBy("cluster").agg(F.ceil(F.sum("n") / PER_BLOCK).alias("shared"))
    placed = members.join(sizes, ["cluster", "component"]).join(shared, "cluster", "left")
    own = F.xxhash64("component", F.pmod(F.xxhash64("doc"), F.ceil(F.col("n") / PER_BLOCK)))
    common = F.xxhash64("cluster", F.lit(1), F.pmod(F.xxhash64("component"), F.col("shared")))
    return placed.select("cluster", "doc", "component", F.when(alone, own).otherwise(common).alias("block"), F.when(alone, F.col("component")).alias("owner"))


def _links_in_blocks(members: DataFrame, signed: DataFrame, sets: DataFrame, similar: tuple[int, int], scratch: Scratch) -> DataFrame:
    """Links between different components of each cluster, from rows of (cluster, doc, component).

    A cluster is cut into blocks of about PER_BLOCK members; a task compares two blocks, but never two of one
    component. Pairs stay in the task: the sequential test drops most, the full sets decide the rest, and one link for
    each two components comes out.
    """
    n, level = BANDS * ROWS, similar[0] / similar[1]
    placed = scratch.table("placed", _blocks(members))
    blocks = placed.select("cluster", "block", "owner").distinct()
    side = lambda name: blocks.select("cluster", F.col("block").alias(name), F.col("owner").alias(f"{name}_owner"))
    met = side("i").join(side("j"), "cluster").where((F.col("i") <= F.col("j")) & ~F.coalesce(F.col("i_owner") == F.col("j_owner"), F.lit(False))).select("i", "j")
    met = scratch.table("met", met)
    each = met.select(F.col("i").alias("own"), "i", "j").unionByName(met.where("i <> j").select(F.col("j").alias("own"), "i", "j"))
    rows = placed.select(F.col("block").alias("own"), "doc", "component").join(each, "own")
    # a signature goes with the set of its own class
    values = signed.select(F.col("_doc").alias("doc"), "_hi", "_lo", "_sig").join(sets.withColumnRenamed("_doc", "doc"), ["doc", "_hi", "_lo"]).drop("_hi", "_lo")
    rows = rows.join(values, "doc")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        i, j = group["i"].iloc[0], group["j"].iloc[0]
        left, right = group[group["own"] == i], group[group["own"] == j]
        signatures = [np.frombuffer(b"".join(x["_sig"]), np.uint32).reshape(-1, n) for x in (left, right)]
        ids = [x["doc"].to_numpy() for x in (left, right)]
        part = [x["component"].to_numpy() for x in (left, right)]
        found: dict[tuple[int, int], tuple[int, int]] = {}
        if len(left) and len(right):
            own = [np.frombuffer(x, np.uint64) for x in left["_set"]]
            others = [np.frombuffer(x, np.uint64) for x in right["_set"]]
            known, place = np.unique(np.concatenate(others), return_inverse=True)
            sizes = np.array([len(x) for x in others])
            starts = np.cumsum(sizes) - sizes
            for r in range(len(left)):
                wanted = np.flatnonzero((part[1] != part[0][r]) & ((ids[1] > ids[0][r]) | (i != j)))
                alive = wanted[sequential_survivors(np.broadcast_to(signatures[0][r], (len(wanted), n)), signatures[1][wanted], level)] if len(wanted) else wanted
                if not len(alive):
                    continue
                # which of the other block's shingles this document has, then how many each of its documents shares
                has = np.isin(known, own[r], assume_unique=True)
                shared = np.add.reduceat(has[place].astype(np.int64), starts)[alive]
                linked = alive[similar[1] * shared >= similar[0] * (len(own[r]) + sizes[alive] - shared)]
                for x in linked:
                    found.setdefault((part[0][r], part[1][x]), (min(ids[0][r], ids[1][x]), max(ids[0][r], ids[1][x])))
        pairs = np.array(list(found.values()), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.groupBy("i", "j").applyInPandas(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (left, at), (right, to) = (flat(batch.column(c)) for c in ("_left", "_right"))
            left, right, at, to = left.view(np.uint64), right.view(np.uint64), at // 8, to // 8
            keep = []
            for r in range(batch.num_rows):
                x, y = left[at[r] : at[r + 1]], right[to[r] : to[r + 1]]
                shared = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(similar[1] * shared >= similar[0] * (len(x) + len(y) - shared))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return _with_both(pairs, sets, "_set").mapInArrow(run, "a long, b long")


def _sets_of(docs: DataFrame, key: str, text: str, wanted: DataFrame, k: int) -> DataFrame:
    """(_doc, _hi, _lo, _set): the shingle hashes of each class in `wanted` (_doc, _hi, _lo)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for a, b, values, at in shingle_sets(data, offsets, k):
                hi, lo = set_digest(values, at)
                sets = [values[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(hi), pa.array(lo), pa.array(sets, pa.binary())], names=["_doc", "_hi", "_lo", "_set"])

    own = docs.select(F.col(key).cast("long").alias("_doc"), F.col(text).cast("string").alias("_text")).join(wanted.select("_doc"), "_doc", "left_semi")
    found = own.mapInArrow(run, "_doc long, _hi long, _lo long, _set binary")
    # rows of one id may hold several texts, each with its set; dealt by id, as the joins that follow are
    return found.join(wanted, ["_doc", "_hi", "_lo"], "left_semi").repartition("_doc").dropDuplicates(["_doc", "_hi", "_lo"])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """(key, n_shingles, component_id, kept), one row for each row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    level = similar[0] / similar[1]
    slim = docs.select(F.col(key).cast("long").alias("_doc"), F.col(text).cast("string").alias("_text"))
    signed_all = scratch.table("signed-all", with_set_features(slim, "_text", k, True))
    classes = signed_all.where("_n > 0").groupBy("_hi", "_lo", "_n").agg(F.min("_doc").alias("_rep"), F.count(F.lit(1)).alias("_copies"))
    classes = scratch.table("classes", classes.where("_rep is not null"))
    one = classes.select(F.col("_rep").alias("_doc"), "_hi", "_lo")
    # an id with several texts stands for all of them; each class it represents signs for it
    signed = signed_all.join(one, ["_doc", "_hi", "_lo"], "left_semi").dropDuplicates(["_doc", "_hi", "_lo"]).select("_doc", "_hi", "_lo", "_sig")
    signed = scratch.table("signed", signed)
    members = signed_all.where("_n > 0").select("_doc", "_hi", "_lo")
    # equal sets link to their representative; so do the classes of an id that has several texts
    equal = join_by_share(members, classes.where("_copies > 1").select("_hi", "_lo", "_rep", "_copies"), ["_hi", "_lo"], "_copies")
    equal = scratch.table("equal", equal.where("_doc <> _rep").select(F.col("_doc").alias("a"), F.col("_rep").alias("b")).distinct())
    scratch.drop("classes")
    bands = with_bands(signed)
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("doc").alias("low"), F.max("doc").alias("high")).where("low <> high")
    shared = scratch.table("shared", shared.withColumn("_rows", F.col("size")))
    # members of buckets with more than one representative
    buckets = scratch.table("buckets", join_by_share(bands, shared, ["band"], "_rows"))
    star = buckets.where("doc <> low").select(F.col("low").alias("a"), F.col("doc").alias("b"))
    star = star.unionByName(buckets.where("doc <> high and doc <> low").select(F.col("doc").alias("a"), F.col("high").alias("b")))
    star = scratch.table("star-pairs", star.distinct())
    pruned = scratch.table("star", _pruned(star, signed, level))
    # every document that any pair can need has a bucket; sets are read once for all confirmations
    in_pairs = buckets.select(F.col("doc").alias("_doc")).distinct()
    wanted = signed.select("_doc", "_hi", "_lo").join(in_pairs, "_doc", "left_semi")
    sets = scratch.table("sets", _sets_of(docs, key, text, wanted, k))
    links = scratch.table("links-1", _confirmed(pruned, sets, similar))
    merged = components(links, scratch, "merged")
    labelled = buckets.join(merged.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc")).select("band", "doc", "component", "size")
    labelled = scratch.table("labelled", labelled)
    open_ = labelled.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("_rows")).where("x <> y")
    rest = scratch.table("rest", join_by_share(labelled, scratch.table("open", open_.select("band", "_rows")), ["band"], "_rows", "left_semi"))
    few = rest.where(F.col("size") <= SMALL).drop("size")
    other = few.select("band", F.col("doc").alias("b"), F.col("component").alias("other"))
    small = few.withColumnRenamed("doc", "a").join(other, "band").where("a < b and component <> other").select("a", "b").distinct()
    small = scratch.table("small", small.join(star, ["a", "b"], "left_anti"))
    more = scratch.table("more", _pruned(small, signed, level))
    # large buckets that share members form one cluster, so each of its pairs is compared once for all bands
    large = rest.where(F.col("size") > SMALL)
    lows = scratch.table("lows", large.groupBy("band").agg(F.min("doc").alias("a"), F.count(F.lit(1)).alias("_rows")))
    clusters = components(join_by_share(large, lows, ["band"], "_rows").select("a", F.col("doc").alias("b")).where("a <> b"), scratch, "clusters")
    clusters = clusters.select(F.col("node").alias("doc"), F.col("component").alias("cluster"))
    inside = large.select("doc", "component").distinct().join(clusters, "doc", "left").withColumn("cluster", F.coalesce("cluster", "doc"))
    late = _confirmed(more, sets, similar).unionByName(_links_in_blocks(inside, signed, sets, similar, scratch))
    late = scratch.table("links-2", late)
    scratch.drop("shared", "buckets", "star-pairs", "star", "sets", "labelled", "open", "rest", "small", "more", "lows", "placed", "met", "signed")
    every = equal.unionByName(links).unionByName(late)
    groups = components(every, scratch, "groups")
    scratch.drop("equal", "links-1", "links-2")
    sizes = signed_all.select("_doc", F.col("_n").alias("n_shingles"))
    out = sizes.where("_doc is not null").join(groups, F.col("_doc") == F.col("node"), "left").withColumn("component_id", F.coalesce("component", "_doc"))
    # rows without an id have no part in the join, else one task would take them all
    out = out.select("_doc", "n_shingles", "component_id").unionByName(sizes.where("_doc is null").withColumn("component_id", F.col("_doc")))
    return out.select(F.col("_doc").alias(key), "n_shingles", "component_id", F.coalesce(F.col("_doc") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the rows whose group has a smaller id; of rows with equal ids, all stay or all go."""
    gone = near_duplicates(docs, key, text, **options).where("not kept").select(F.col(key).alias("_gone")).distinct()
    name, = fresh(docs, "_gone")
    left = docs.where(F.col(key).isNotNull()).join(gone.withColumnRenamed("_gone", name), F.col(key).cast("long") == F.col(name), "left_anti")
    return left.unionByName(docs.where(F.col(key).isNull()))


def op2_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's groups: 2-word shingles, similarity of 0.8 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) WHEN len(w) = 1 THEN w ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
