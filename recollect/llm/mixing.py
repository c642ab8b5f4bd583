"""Mixing sources to target weights by entropy balancing.

Among all rates in [0, 2] whose expected words meet each source's target, the rates nearest to 1 in relative
entropy are min(2, exp(lambda_s * x)), with x the document's size over its source's mean size. The multipliers
solve the convex dual; safeguarded Newton iterations find them from a table of sizes (one row for each source and
size, so a hot source or a group of copies is pre-aggregated). Rates become copies by systematic rounding along
the sizes, a few steps then move what is left of each source's residual, and copies go to documents in the order
of a hash within salted cells.

Defined results: a null text has size 0; a null source is a source of its own, last; sources without words get
target 0 and nothing is taken of them; repeated rows are documents of their own; equal inputs give equal results;
further columns pass through, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh

#: Weights given to sources in code-point order, repeating; words of the mix over all words; most copies.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2
#: Documents that one salted cell holds about, Newton iterations at most, relative residual that ends them, repairs.
CELL, ITERATIONS, TOLERANCE, REPAIRS = 8192, 80, 1e-9, 3


def word_count(text: Column) -> Column:
    """Number of runs of characters other than 0x20 and 0x09-0x0D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(cells: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row for each source: its words, and its target after capped shares are given to the others by weight."""
    sources = cells.groupBy("_src").agg(F.sum(F.col("_n") * F.col("_size")).alias("_words"), F.sum("_n").alias("_docs"), F.min(F.when(F.col("_size") > 0, F.col("_size"))).alias("_least"))
    # one row for each source from here on: as many as there are names of sources, in one task
    by_name = Window.orderBy(F.col("_src").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    ranked = sources.withColumn("_w", weight).withColumns({"_cap": (F.col("_words") * most).cast("double"), "_all": F.sum("_words").over(everything) * F.lit(share)})
    # targets are min(cap, level * weight): in order of cap / weight, a prefix of the sources is capped
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_src").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest)
    levels = ranked.withColumn("_level", level)
    open_ = F.col("_level") * F.col("_w") <= F.col("_cap")
    final = F.min(F.when(open_, F.struct(F.col("_cap") / F.col("_w"), "_level"))).over(everything)["_level"]
    target = F.when(final.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), final * F.col("_w")))
    return levels.select("_src", "_words", "_docs", "_least", target.alias("_target"))


def _rate(most: int) -> Column:
    grown = F.col("_lambda") * F.col("_size") / F.col("_mean")
    return F.when(F.col("_size") == 0, 0.0).otherwise(F.least(F.exp(F.least(grown, F.lit(64.0))), F.lit(float(most))))


def solve_rates(cells: DataFrame, targets: DataFrame, scratch: Scratch, most: int = MOST) -> DataFrame:
    """Adds the multiplier of each source that has words and a target: _src, _target, _mean, _lambda."""
    ratio = F.col("_target") / F.col("_words")
    floor = F.col("_least") / F.col("_mean")
    state = (
        targets.where((F.col("_words") > 0) & (F.col("_target") > 0))
        .withColumn("_mean", F.col("_words") / F.col("_docs"))
        .withColumns({"_lo": F.least(F.lit(0.0), F.log(ratio)) / floor, "_hi": F.log(F.lit(float(most))) / floor, "_gap": F.lit(1.0)})
        .withColumn("_lambda", F.when(ratio >= most * (1 - 1e-12), F.col("_hi")).when(ratio < 1, F.greatest(F.col("_lo"), F.log(ratio))).otherwise(F.lit(0.0)))
        .select("_src", "_target", "_mean", "_lo", "_hi", "_lambda", "_gap")
    )
    state = scratch.table("dual-0", state)
    last = 0
    for i in range(1, ITERATIONS + 1):
        rate = _rate(most)
        mass = F.col("_n") * F.col("_size") * rate
        sums = _on_source(cells, state).groupBy("_src", "_target", "_mean", "_lo", "_hi", "_lambda").agg(
            F.sum(mass).alias("_mass"), F.sum(F.when(rate < most, mass * F.col("_size") / F.col("_mean")).otherwise(0.0)).alias("_slope")
        )
        excess = F.col("_mass") - F.col("_target")
        moved = sums.withColumns({"_lo": F.when(excess < 0, F.col("_lambda")).otherwise(F.col("_lo")), "_hi": F.when(excess >= 0, F.col("_lambda")).otherwise(F.col("_hi"))})
        newton = F.when(F.col("_slope") > 0, F.col("_lambda") - excess / F.col("_slope"))
        middle = (F.col("_lo") + F.col("_hi")) / 2
        stepped = F.when(F.abs(excess) <= F.col("_target") * TOLERANCE, F.col("_lambda")).when((newton > F.col("_lo")) & (newton < F.col("_hi")), newton).otherwise(middle)
        moved = moved.withColumns({"_next": stepped, "_gap": F.abs(excess) / F.col("_target")})
        state = scratch.table(f"dual-{i}", moved.select("_src", "_target", "_mean", "_lo", "_hi", F.col("_next").alias("_lambda"), "_gap"))
        last = i
        worst = state.agg(F.max("_gap")).first()[0]
        if worst is None or worst <= TOLERANCE:
            break
    scratch.drop(*(f"dual-{i}" for i in range(last)))
    return state.select("_src", "_target", "_mean", "_lambda")


def _on_source(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on the source, null equal to null."""
    renamed = right.withColumnRenamed("_src", "_other")
    return left.join(renamed, F.col("_src").eqNullSafe(F.col("_other"))).drop("_other")


def copies_of_cells(cells: DataFrame, rates: DataFrame, scratch: Scratch, most: int = MOST) -> DataFrame:
    """Copies that the documents of each source and size get together: _src, _size, _n, _copies."""
    rate = _rate(most)
    along = Window.partitionBy("_src").orderBy("_size").rowsBetween(Window.unboundedPreceding, 0)
    rated = _on_source(cells.where("_size > 0"), rates).withColumn("_want", F.col("_n") * rate).withColumn("_upto", F.sum("_want").over(along))
    whole = F.floor(F.col("_upto") + 0.5) - F.floor(F.col("_upto") - F.col("_want") + 0.5)
    out = rated.select("_src", "_size", "_n", "_target", F.least(F.greatest(whole, F.lit(0)), F.col("_n") * most).cast("long").alias("_copies"))
    out = scratch.table("copies-0", out)
    for i in range(1, REPAIRS + 1):
        left = out.groupBy("_src").agg((F.first("_target") - F.sum(F.col("_copies") * F.col("_size"))).alias("_left"))
        step = F.round(F.col("_left") / F.col("_size"))
        step = F.greatest(F.least(step, (F.col("_n") * most - F.col("_copies")).cast("double")), -F.col("_copies").cast("double"))
        tried = _on_source(out, left).withColumn("_step", step).withColumn("_rest", F.abs(F.col("_left") - F.col("_step") * F.col("_size")))
        best = tried.groupBy("_src").agg(F.min(F.struct("_rest", F.abs("_step").alias("_far"), F.col("_size").alias("_at"), "_step")).alias("_best"))
        best = best.select("_src", F.col("_best._at").alias("_at"), F.col("_best._step").cast("long").alias("_add"))
        moved = _on_source(out, best).withColumn("_copies", F.col("_copies") + F.when(F.col("_size") == F.col("_at"), F.col("_add")).otherwise(0))
        out = scratch.table(f"copies-{i}", moved.drop("_at", "_add"))
    scratch.drop(*(f"copies-{i}" for i in range(REPAIRS)))
    return out


def mix_sources(docs: DataFrame, source: str = "source", text: str = "text", size: str | None = None, key: str = "doc_id", weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """docs with size, source_size, target, copies and taken (copies times size) of each row.

    size: a column that holds the sizes already; else the words of text are counted.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    names = fresh(docs, "size", "source_size", "target", "copies", "taken") if size is None else [size, *fresh(docs, "source_size", "target", "copies", "taken")]
    sized = docs if size else docs.withColumn(names[0], word_count(F.col(text)))
    # rows of equal id and size are told apart by their text, so that reruns agree on which of them is taken
    tie = F.xxhash64(F.col(text)) if text in docs.columns else F.lit(0)
    keyed = sized.select(F.struct("*").alias("_row"), F.col(source).alias("_src"), F.col(names[0]).cast("long").alias("_size"), F.xxhash64(F.col(key)).alias("_h"), tie.alias("_tie"))
    counted = scratch.table("sizes", keyed.groupBy("_src", "_size", F.pmod("_h", F.lit(1 << 20)).alias("_fine")).agg(F.count(F.lit(1)).alias("_n")))
    total = counted.agg(F.sum("_n")).first()[0] or 0
    salts = max(1, -(-total // CELL))
    salt = lambda h: F.pmod(F.pmod(h, F.lit(1 << 20)), F.lit(salts))
    salted = counted.groupBy("_src", "_size", F.pmod("_fine", F.lit(salts)).alias("_salt")).agg(F.sum("_n").alias("_n"))
    cells = scratch.table("cells", salted.groupBy("_src", "_size").agg(F.sum("_n").alias("_n")))
    targets = scratch.table("targets", source_targets(cells, weights, share, most))
    copies = copies_of_cells(cells, solve_rates(cells, targets, scratch, most), scratch, most)
    # extras of a cell are dealt over its salts in proportion, exactly
    renamed = copies.select(F.col("_src").alias("_s"), F.col("_size").alias("_z"), F.col("_n").alias("_cell"), "_copies")
    parts = salted.join(renamed, F.col("_src").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z")), "left").drop("_s", "_z")
    over = Window.partitionBy("_src", "_size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, 0)
    each = F.expr("coalesce(_copies, 0) div coalesce(_cell, 1)")
    extra = F.expr("coalesce(_copies, 0) % coalesce(_cell, 1)")
    upto = F.sum("_n").over(over)
    parts = parts.withColumns({"_each": each, "_extra": extra, "_upto": upto})
    parts = parts.withColumn("_extra", F.expr("_extra * _upto div coalesce(_cell, 1) - _extra * (_upto - _n) div coalesce(_cell, 1)"))
    about = targets.select(F.col("_src").alias("_t"), "_words", "_target")
    parts = parts.join(about, F.col("_src").eqNullSafe(F.col("_t"))).select(
        F.col("_src").alias("_s"), F.col("_size").alias("_z"), F.col("_salt").alias("_b"), "_each", "_extra", "_words", "_target"
    )
    parts = scratch.table("parts", parts)
    scratch.drop("sizes", "cells")
    turn = Window.partitionBy("_src", "_size", "_salt").orderBy("_h", "_id", "_tie")
    dealt = keyed.withColumns({"_salt": salt(F.col("_h")), "_id": F.col(f"_row.`{key}`")}).withColumn("_turn", F.row_number().over(turn))
    dealt = dealt.join(parts, F.col("_src").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z")) & (F.col("_salt") == F.col("_b")))
    n = (F.col("_each") + F.when(F.col("_turn") <= F.col("_extra"), 1).otherwise(0)).cast("int")
    return dealt.withColumn("_got", n).select("_row.*", F.col("_words").alias(names[1]), F.col("_target").alias(names[2]), F.col("_got").alias(names[3]), (F.col("_got") * F.col("_size")).alias(names[4]))


def op3_source_mixing(spark, sf_dir: str) -> DataFrame:
    """The contract's columns of mix_sources() over all documents, and the copies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slim = Scratch(spark, "mixing-sizes").table("docs", docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return mix_sources(slim, size="size").select("doc_id", "size", "source_size", "target", "taken", "copies")
