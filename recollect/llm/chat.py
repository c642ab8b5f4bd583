"""Chat formatting: logs that hold a conversation again after each turn are collapsed to their longest snapshot.

Each conversation is a sequence of turns. A rolling hash over each of its prefixes says which conversations are
prefixes of longer ones; anti-joins drop those, and of equal conversations the smallest id stays. Then the rest
are rendered with a chat template.

Defined results: turns sort by number (null first), then role, then text; exact repeats of a row count once;
a null role or text is kept apart from an empty one when conversations are compared, and is rendered as
"unknown" or as nothing; rows with a null conversation id form one conversation; an empty table gives none.
Columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _turn_hash(seed: int) -> Column:
    parts = [F.lit(seed), F.col("_no"), F.col("_role").isNull(), F.col("_role"), F.col("_text").isNull(), F.col("_text")]
    return F.xxhash64(*parts)


def turn_prefixes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each turn, with the turn's place and the 128-bit rolling hash of the prefix that it ends."""
    rows = turns.select(
        F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.col(role).cast("string").alias("_role"), F.col(text).cast("string").alias("_text")
    ).distinct()
    order = Window.partitionBy("_conv").orderBy("_turn", "_role", "_text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_no", F.row_number().over(order)).withColumns({"_a": _turn_hash(11), "_b": _turn_hash(23)})
    # the place is part of each turn's hash, so xor over a prefix identifies the sequence
    return placed.withColumns({"_pa": F.bit_xor("_a").over(upto), "_pb": F.bit_xor("_b").over(upto)})


def collapse_snapshots(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Ids of the maximal conversations: conv, n_turns, n_copies (conversations equal to it, itself included)."""
    prefixes = turn_prefixes(turns, conv, turn, role, text)
    heads = prefixes.select("_conv", "_no", "_pa", "_pb")
    lengths = heads.groupBy("_conv").agg(F.max(F.struct("_no", "_pa", "_pb")).alias("_whole"))
    whole = lengths.groupBy("_whole").agg(F.min("_conv").alias("_conv"), F.count(F.lit(1)).alias("n_copies"))
    whole = whole.select("_conv", F.col("_whole._no").alias("_no"), F.col("_whole._pa").alias("_pa"), F.col("_whole._pb").alias("_pb"), "n_copies")
    # each distinct proper prefix once, so a turn that opens a third of all conversations is one row
    last = Window.partitionBy("_conv").orderBy("_no")
    proper = prefixes.withColumn("_more", F.lead("_no").over(last).isNotNull()).where("_more").select("_no", "_pa", "_pb").distinct()
    kept = whole.join(proper, ["_no", "_pa", "_pb"], "left_anti")
    return kept.select(F.col("_conv").alias(conv), F.col("_no").alias("n_turns"), "n_copies")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("unknown")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, n_turns, n_copies and the rendered chat of each maximal conversation."""
    kept = collapse_snapshots(turns, conv, turn, role, text).select(F.col(conv).alias("_id"), "n_turns", "n_copies")
    rows = turn_prefixes(turns, conv, turn, role, text).select("_conv", "_no", rendered(F.col("_role"), F.col("_text")).alias("_part"))
    chats = rows.join(kept, F.col("_conv").eqNullSafe(F.col("_id"))).groupBy("_conv", "n_turns", "n_copies")
    parts = chats.agg(F.array_sort(F.collect_list(F.struct("_no", "_part"))).alias("_parts"))
    return parts.select(F.col("_conv").alias(conv), "n_turns", "n_copies", F.array_join(F.transform("_parts", lambda p: p["_part"]), "").alias("chat"))


def op4_chat_formatting(spark, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP4_SQL = """
WITH rows AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS no,
         {'r': role, 't': text} AS part,
         '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS shown
  FROM rows),
prefixes AS (
  SELECT conv_id, no, list(part) OVER (PARTITION BY conv_id ORDER BY no) AS prefix, count(*) OVER (PARTITION BY conv_id) AS n
  FROM placed),
whole AS (
  SELECT prefix, min(conv_id) AS conv_id, any_value(n) AS n_turns, count(*) AS n_copies
  FROM prefixes WHERE no = n GROUP BY prefix),
kept AS (
  SELECT * FROM whole WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.no < p.n AND p.prefix = whole.prefix))
SELECT k.conv_id, CAST(k.n_turns AS INTEGER) AS n_turns, k.n_copies, string_agg(p.shown, '' ORDER BY p.no) AS chat
FROM kept k JOIN placed p ON p.conv_id IS NOT DISTINCT FROM k.conv_id
GROUP BY k.conv_id, k.n_turns, k.n_copies
"""
