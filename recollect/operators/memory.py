"""Preparing messages for extraction: packing sessions, cutting long messages, salvaging broken files, work lists."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

token_cost = X.token_cost


def packed(costs: list[int], budget: int, most: int, overlap: int) -> list[list[int]]:
    """Places of rows in groups whose costs fit the budget; a group opens with the last `overlap` rows of the one before.

    The last group that `most` allows takes all that is left; a single row over the budget is a group.
    """
    if budget <= 0 or len(costs) <= 1:
        return [list(range(len(costs)))]
    groups, first, used, at = [], 0, 0, 0
    while at < len(costs):
        if at > first and used + costs[at] > budget:
            if len(groups) + 1 == most:
                break
            groups.append(list(range(first, at)))
            first = max(0, at - overlap)
            used = sum(costs[first:at])
            if used + costs[at] > budget:
                # what is carried over never closes a group by itself
                first, used = at, 0
        used += costs[at]
        at += 1
    return [*groups, list(range(first, len(costs)))]


def pack_sessions(rows: DataFrame, session: str, pos: str, text: str, budget: int, most: int = 16, overlap: int = 1) -> DataFrame:
    """(session, group, pos): the messages of each session in groups that fit a prompt; a session is one group of rows."""
    costed = rows.select(session, pos, (X.estimate_tokens(F.col(text)) + 1).alias("cost"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(pos, kind="stable")
        groups = packed(part["cost"].tolist(), budget, most, overlap)
        places = part[pos].tolist()
        return pd.DataFrame([(part[session].iloc[0], g, places[i]) for g, members in enumerate(groups) for i in members], columns=[session, "group", pos])

    kinds = rows.schema
    return costed.groupBy(session).applyInPandas(run, f"{session} {kinds[session].dataType.simpleString()}, group int, {pos} {kinds[pos].dataType.simpleString()}")


def _pieces(line: str, budget: int) -> Iterator[str]:
    """A line cut by characters so that each piece fits, measured on the piece itself."""
    # a wide character costs 4 quarters, any other one quarter; a piece fits while its quarters do
    ends = list(accumulate((4 if wide else 1 for wide in X.wide_flags(line)), initial=0))
    at = 0
    while at < len(line):
        end = max(at + 1, bisect_right(ends, ends[at] + 4 * budget) - 1)
        while end > at + 1 and token_cost(line[at:end]) > budget:
            end -= 1
        yield line[at:end]
        at = end


def cut_message(text: str, budget: int, overlap: int = 0) -> list[str]:
    """Chunks of whole lines that fit the budget, each opened by up to two last lines of the one before.

    Lines over the budget are cut by characters; chunks of white space are left out.
    """
    if budget <= 0 or token_cost(text) <= budget:
        return [text]
    out: list[str] = []
    now: list[str] = []
    for line in text.splitlines(keepends=True):
        if token_cost(line) > budget:
            out += ["".join(now)] if now else []
            out += _pieces(line, budget)
            now = []
            continue
        if now and sum(map(token_cost, now)) + token_cost(line) > budget:
            out.append("".join(now))
            tail = now[-2:]
            while tail and sum(map(token_cost, tail)) > min(overlap, budget - token_cost(line)):
                tail.pop(0)
            now = tail
        now.append(line)
    out += ["".join(now)] if now else []
    return [x for x in out if x.strip()] or [text]


def cut_messages(rows: DataFrame, key: str, text: str, budget: int, overlap: int = 0) -> DataFrame:
    """(key, chunk_no, chunk) of every message."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(k, i, c) for k, t in zip(batch[key], batch[text], strict=True) for i, c in enumerate(cut_message(t or "", budget, overlap))]
            yield pd.DataFrame(found, columns=[key, "chunk_no", "chunk"])

    return rows.select(key, text).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, chunk_no int, chunk string")


def salvaged(text: str) -> tuple[list[str], int]:
    """Objects of a broken array as JSON, and 1 if a rest could not be read.

    An object that lacks up to two closing braces is closed; whole objects come first, so that a nested one is
    never taken for its parent.
    """
    out: list[str] = []
    at = text.find("{", text.find("[") + 1)
    decoder = json.JSONDecoder()
    while at >= 0:
        try:
            _, end = decoder.raw_decode(text, at)
            out.append(text[at:end])
        except json.JSONDecodeError:
            ends = [i + 1 for i, c in enumerate(text[at:], at) if c == "}"]
            closed = next(((e, text[at:e] + extra) for extra in ("}", "}}") for e in ends if _is_object(text[at:e] + extra)), None)
            if closed is None:
                return out, 1
            end = closed[0]
            out.append(closed[1])
        at = text.find("{", end)
    return out, 0


def _is_object(text: str) -> bool:
    try:
        return isinstance(json.loads(text), dict)
    except json.JSONDecodeError:
        return False


def salvaged_records(c: Column) -> Column:
    """(records, n_dropped) of salvaged() for each text."""
    kind = pa.struct([("records", pa.list_(pa.string())), ("n_dropped", pa.int32())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([dict(zip(("records", "n_dropped"), salvaged(x or ""), strict=True)) for x in batch.to_pylist()], kind)

    return F.arrow_udf(run, "struct<records:array<string>,n_dropped:int>")(c.cast("string"))


def uncovered(messages: DataFrame, covered: DataFrame, session: str, key: str) -> DataFrame:
    """Sessions with messages that no atom covers, and how many."""
    open_ = messages.select(session, key).join(covered.select(key), key, "left_anti")
    return open_.groupBy(session).agg(F.count(F.lit(1)).alias("n_uncovered"))


def named_entities(text: Column) -> Column:
    """Distinct capitalised words inside sentences, trimmed to letters and lower-cased."""
    sentences = F.split(X.text_or_empty(text), r"(?<=[.!?])\s+")
    inner = F.flatten(F.transform(sentences, lambda s: F.slice(F.filter(F.split(F.trim(s), r"\s+"), lambda w: w != ""), 2, 1 << 30)))
    bare = F.transform(inner, lambda w: F.regexp_replace(w, r"^[^A-Za-z]+|[^A-Za-z]+$", ""))
    return F.array_sort(F.array_distinct(F.transform(F.filter(bare, lambda w: w.rlike("^[A-Z][a-zA-Z]{2,}$")), F.lower)))


def unsupported_entities(facts: DataFrame, sources: DataFrame, vocabulary: DataFrame, key: str, text: str) -> DataFrame:
    """(key, entity): entities of facts that their sources' text lacks and that the corpus never writes in lower case.

    sources: (key, source_text); vocabulary: (word) in lower case.
    """
    entities = facts.select(key, F.explode(named_entities(F.col(text))).alias("entity"))
    cited = sources.groupBy(key).agg(F.lower(F.concat_ws(" ", F.collect_list("source_text"))).alias("_supported"))
    missing = entities.join(cited, key, "left").where(~F.coalesce(F.contains("_supported", "entity"), F.lit(False))).select(key, "entity")
    return missing.join(vocabulary.select(F.col("word").alias("entity")), "entity", "left_anti").select(key, "entity")


def retrieve(questions: DataFrame, records: DataFrame, k: int, question: str, record: str, text: str, weight: str) -> DataFrame:
    """The k records of each question with the greatest sum of idf over shared content words, times the layer's weight.

    A deterministic stand-in for a search by a language model.
    """
    asked = questions.select(question, F.explode(X.tokens(F.col(text))).alias("t"))
    terms = asked.select("t").distinct()
    held = records.select(record, weight, F.explode(X.tokens(F.col(text))).alias("t")).join(terms, "t", "left_semi")
    n = records.count()
    rarity = held.groupBy("t").agg(F.log(F.lit(float(max(n, 1))) / F.count(F.lit(1))).alias("idf"))
    # a question's words meet only the records that hold them
    scored = asked.join(rarity, "t").join(held, "t").groupBy(question, record, weight).agg(F.sum("idf").alias("_s"))
    ranked = scored.select(question, record, F.round(F.col("_s") * F.col(weight), 6).alias("score"))
    order = Window.partitionBy(question).orderBy(F.col("score").desc(), record)
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
