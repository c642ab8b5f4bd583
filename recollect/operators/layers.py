"""Search over memory layers, provenance, and windows of context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Layers in order of priority.
LAYERS = {"atom": 1, "msg": 2, "summary": 3}


def keyword_search(records: DataFrame, pattern: str, text: str = "text", layer: str = "layer", pos: str = "id") -> DataFrame:
    """Records that match, ignoring case (| separates alternatives), ranked by layer and then position."""
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in LAYERS.items() for x in kv)), F.col(layer)), F.lit(len(LAYERS) + 1))
    return records.where(F.col(text).rlike(f"(?i){pattern}")).withColumn("layer_rank", rank).orderBy("layer_rank", pos)


def provenance(records: DataFrame, targets: DataFrame, key: str, source: str, target: str, text: str) -> DataFrame:
    """One hop from each cited source to the record it names; an atom's id falls back to its message's."""
    cited = records.select(key, F.posexplode(source).alias("source_pos", "source_id"))
    message = F.substring_index("source_id", "_", 3)
    known = targets.select(F.col(target).alias("_id"), F.col(text).alias("source_text"))
    direct = cited.join(known, F.col("source_id") == F.col("_id"), "left").drop("_id")
    other = known.withColumnRenamed("source_text", "_fallback")
    joined = direct.withColumn("_message", message).join(other, F.col("_message") == F.col("_id"), "left")
    return joined.select(key, "source_pos", "source_id", F.coalesce("source_text", "_fallback").alias("source_text"))


def lookback(rows: DataFrame, corpus: str, pos: list[str], session: str, columns: list[str], width: int = 5) -> DataFrame:
    """Of the 3 * width rows before each row in file order, the last `width` of its session, as an array."""
    before = Window.partitionBy(corpus).orderBy(*pos).rowsBetween(-3 * width, -1)
    window = F.collect_list(F.struct(session, *columns)).over(before)
    out = rows.withColumn("_window", window)
    own = F.filter("_window", lambda x: x[session].eqNullSafe(F.col(session)))
    return out.withColumn("context", F.slice(own, F.greatest(F.size(own) - width + 1, F.lit(1)), width)).drop("_window")


def budget_suffix(rows: DataFrame, group: str, pos: str, cost: Column, budget: int) -> DataFrame:
    """The newest rows of each group whose costs, one more each, add up to the budget at most."""
    newest = Window.partitionBy(group).orderBy(F.col(pos).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(cost + 1).over(newest)).where(F.col("used") <= budget)


def truncate_head(lines: DataFrame, group: str, pos: str, text: str, most_lines: int, most_bytes: int) -> DataFrame:
    """First lines of each group within a number of lines and of bytes, a line break counted with each."""
    along = Window.partitionBy(group).orderBy(pos)
    sized = lines.withColumns({"line_no": F.row_number().over(along), "bytes_upto": F.sum(F.octet_length(text) + 1).over(along.rowsBetween(Window.unboundedPreceding, 0))})
    return sized.where((F.col("line_no") <= most_lines) & (F.col("bytes_upto") <= most_bytes))


def top_values(tagged: DataFrame, tag: str, per_key: int = 3, most: int = 20, skip=("other", "time", "action", "sentiment", "state")) -> DataFrame:
    """key:value tags counted; of values with at most `most` rows, the most frequent of each key."""
    parts = tagged.select(F.substring_index(tag, ":", 1).alias("key"), F.regexp_replace(tag, "^[^:]*:", "").alias("value"))
    counts = parts.where(~F.col("key").isin(*skip)).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most)
    order = Window.partitionBy("key").orderBy(F.col("n").desc(), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_key)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 if a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def cosine_topk(queries: DataFrame, rows: DataFrame, k: int, query: str = "query_id", key: str = "vec_id", vector: str = "embedding", block: int = 2048) -> DataFrame:
    """The k most similar rows of each query, ties by key: a stated query set against all rows, in blocks.

    At most `block` query vectors are in the driver and in a task at once; a task hands on its k best rows of each
    query, so what is shuffled grows with the number of tasks, not with the rows.
    """
    asked = queries.select(F.col(query).alias("q"), F.col(vector).alias("v"))
    blocks = max(1, -(-asked.count() // block))
    parts = []
    for i in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).collect()
        if own:
            parts.append(rows.select(key, vector).mapInPandas(_best_rows([r["q"] for r in own], [r["v"] for r in own], k, query, key, vector), f"{query} long, {key} long, score double"))
    if not parts:
        return rows.sparkSession.createDataFrame([], f"{query} long, {key} long, score double, rank int")
    best = parts[0]
    for part in parts[1:]:
        best = best.unionByName(part)
    order = Window.partitionBy(query).orderBy(F.col("score").desc(), key)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best_rows(ids: list, vectors: list, k: int, query: str, key: str, vector: str):
    import numpy as np
    import pandas as pd

    matrix = np.array(vectors, np.float64)
    norms = np.linalg.norm(matrix, axis=1)

    def run(batches):
        scores, names = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            own = np.stack(batch[vector].to_numpy()).astype(np.float64)
            both = np.outer(norms, np.linalg.norm(own, axis=1))
            found = np.divide(matrix @ own.T, both, out=np.zeros_like(both), where=both > 0)
            scores = np.hstack([scores, found])
            names = np.hstack([names, np.broadcast_to(batch[key].to_numpy(), found.shape)])
            keep = np.lexsort((names, -scores), axis=1)[:, :k]
            scores, names = np.take_along_axis(scores, keep, axis=1), np.take_along_axis(names, keep, axis=1)
        n = scores.shape[1]
        yield pd.DataFrame({query: np.repeat(ids, n), key: names.ravel(), "score": scores.ravel()})

    return run


def interleave(first: DataFrame, second: DataFrame, rank: str = "rank") -> DataFrame:
    """a1, b1, a2, b2, ... of two ranked lists."""
    both = first.withColumn("side", F.lit(0)).unionByName(second.withColumn("side", F.lit(1)))
    return both.orderBy(rank, "side")


def speakers_in_order(rows: DataFrame, group: str, role: str, *order: str) -> DataFrame:
    """(group, speakers): the distinct roles of each group in the order of their first appearance."""
    known = rows.where(F.trim(F.coalesce(F.col(role), F.lit(""))) != "")
    firsts = known.groupBy(group, F.trim(role).alias("_role")).agg(F.min(F.struct(*order)).alias("_at"))
    listed = F.array_sort(F.collect_list(F.struct("_at", "_role")))
    return firsts.groupBy(group).agg(F.transform(listed, lambda x: x["_role"]).alias("speakers"))


def roles_by_count(rows: DataFrame, group: str, role: str, *order: str) -> DataFrame:
    """(group, roles): (role, n) of each group, most frequent first, ties by first appearance."""
    known = rows.where(F.trim(F.coalesce(F.col(role), F.lit(""))) != "")
    counts = known.groupBy(group, F.trim(role).alias("_role")).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*order)).alias("_at"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("_less"), "_at", "_role", "_n")))
    return counts.groupBy(group).agg(F.transform(listed, lambda x: F.struct(x["_role"].alias("role"), x["_n"].alias("n"))).alias("roles"))


# Fixed value: the first line of a session index.
INDEX_HEAD = "The material is split into these sessions (each has a summary in summem.jsonl):"


def session_index(roster: DataFrame, group: str, session: str, time: str) -> DataFrame:
    """(group, shown): one line for each session with the time of its first message."""
    line = F.concat(F.lit("\n  session_"), F.col(session).cast("string"), F.when(F.coalesce(F.col(time), F.lit("")) == "", "").otherwise(F.concat(F.lit("  ("), F.col(time), F.lit(")"))))
    listed = F.array_sort(F.collect_list(F.struct(F.col(session).alias("s"), line.alias("line"))))
    return roster.groupBy(group).agg(F.concat(F.lit(INDEX_HEAD), F.array_join(F.transform(listed, lambda x: x["line"]), "")).alias("shown"))


def tag_index(tagged: DataFrame, tag: str, **options) -> DataFrame:
    """(key, line): the most frequent values of each key, as a prompt shows them."""
    ranked = top_values(tagged, tag, **options)
    shown = F.concat("key", F.lit(":"), "value", F.lit("("), F.col("n").cast("string"), F.lit(")"))
    listed = F.array_sort(F.collect_list(F.struct("rank", shown.alias("shown"))))
    lines = ranked.groupBy("key").agg(F.array_join(F.transform(listed, lambda x: x["shown"]), "  ").alias("shown"))
    return lines.select("key", F.concat(F.lit("  "), F.rpad("key", 11, " "), F.lit(" "), "shown").alias("line"))


def tagged_with(records: DataFrame, tags: str, wanted: str) -> DataFrame:
    """Records that carry a tag such as activity:camping."""
    return records.where(F.array_contains(tags, wanted))


def of_session(records: DataFrame, record_id: str, session: int) -> DataFrame:
    """Records whose id is of a session: its messages, atoms and summary."""
    return records.where(F.col(record_id).startswith(f"session_{session}_"))


def paged(lines: DataFrame, group: str, pos: str, text: str, offset: int = 1, limit: int | None = None, most_lines: int = 2000, most_bytes: int = 50 * 1024) -> DataFrame:
    """Lines from number `offset` on (from 1), `limit` of them at most, then cut as truncate_head() does."""
    numbered = lines.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(pos)))
    rows = numbered.where(F.col("_n") >= offset)
    rows = rows.where(F.col("_n") < offset + limit) if limit else rows
    return truncate_head(rows.drop("_n"), group, pos, text, most_lines, most_bytes)


def truncate_tail(lines: DataFrame, group: str, pos: str, text: str, most_lines: int, most_bytes: int) -> DataFrame:
    """Last lines of each group within a number of lines and of bytes, a line break counted with each."""
    back = Window.partitionBy(group).orderBy(F.col(pos).desc())
    sized = lines.withColumns({"line_no": F.row_number().over(back), "bytes_upto": F.sum(F.octet_length(text) + 1).over(back.rowsBetween(Window.unboundedPreceding, 0))})
    return sized.where((F.col("line_no") <= most_lines) & (F.col("bytes_upto") <= most_bytes))
