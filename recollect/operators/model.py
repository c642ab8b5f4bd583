"""Operators that call a language model, over any client with `complete(messages) -> str`.

A client is made within each Python worker, so it must be cheap to make and safe to make often. ScriptedClient answers
from rules and needs no network: it is what tests, examples and registered queries use. Prompts are columns; a reply
is a column; what a reply means is decided by column expressions, so one pass over the rows calls the model once each.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clip
from ..functions import records as R
from ..functions import replies as P
from ..sources import lenient
from . import store

# Waiting seconds before a call is tried again, doubled each time, and how often.
FIRST_WAIT, TRIES = 2.0, 3
# What the verifier says without evidence.
NOTHING_FOUND = '{"sufficient": false, "answer": "", "missing": ["no evidence"]}'


class ModelClient(Protocol):
    def complete(self, messages: list[dict[str, str]]) -> str: ...


class CallFailed(Exception):
    """A call that failed, with the status of the service where it gave one."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


@dataclass
class ScriptedClient:
    """Replies by the first rule whose pattern the last message holds; \\1 and the like stand for its groups."""

    rules: list[tuple[str, str]] = field(default_factory=list)
    default: str = ""

    def complete(self, messages: list[dict[str, str]]) -> str:
        asked = messages[-1]["content"]
        for pattern, reply in self.rules:
            hit = re.search(pattern, asked, re.S)
            if hit:
                return hit.expand(reply)
        return self.default


def waits(tries: int = TRIES, first: float = FIRST_WAIT) -> list[float]:
    """Seconds before each further try."""
    return [first * 2**i for i in range(tries - 1)]


def called(client: ModelClient, messages: list[dict[str, str]], tries: int = TRIES, sleep: Callable[[float], None] = time.sleep) -> tuple[str, str, int | None]:
    """(reply, error, status): a call that may pass later is tried again; one that fails for good is not."""
    pause, error, status = [*waits(tries), None], "", None
    for wait in pause:
        try:
            return client.complete(messages), "", None
        except CallFailed as failed:
            error, status = str(failed), failed.status
        if status in store.PERMANENT or wait is None:
            break
        sleep(wait)
    return "", error or "no reply", status


_REPLY = "struct<reply:string,error:string,status:int>"


def complete(prompt: Column, make_client: Callable[[], ModelClient], system: str = "", tries: int = TRIES) -> Column:
    """(reply, error, status) for each prompt; a null prompt is not sent."""
    kind = pa.struct([("reply", pa.string()), ("error", pa.string()), ("status", pa.int32())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        client = make_client()
        for batch in batches:
            rows = []
            for text in batch.to_pylist():
                if text is None:
                    rows.append(None)
                    continue
                messages = [*([{"role": "system", "content": system}] if system else []), {"role": "user", "content": text}]
                rows.append(dict(zip(("reply", "error", "status"), called(client, messages, tries), strict=True)))
            yield pa.array(rows, kind)

    return F.arrow_udf(run, _REPLY)(prompt)


def extract_atoms(messages: DataFrame, key: str, context: str, content: str, make_client, budget: int = 12_000) -> DataFrame:
    """(key, unit, pos, atom, state): a message is cut to the budget, each part is sent, and each fact of a reply is a row.

    state: done, failed (worth another try) or blocked; a part without facts has one row with a null atom.
    """
    units = messages.select(key, F.posexplode(clip.plan_units(F.col(context), F.col(content), budget)).alias("unit", "_u"))
    prompt = F.concat(F.lit("# CONTEXT\n"), F.col("_u.context"), F.lit("\n\n# MESSAGE\n"), F.col("_u.content"))
    asked = units.withColumn("_r", complete(prompt, make_client))
    failed = F.col("_r.error") != ""
    lasting = store.error_class(F.col("_r.status"), F.col("_r.error")).isin("permanent", "content_filter")
    state = F.when(failed & lasting, store.BLOCKED).when(failed, store.FAILED).otherwise(store.DONE)
    return asked.select(key, "unit", state.alias("state"), F.posexplode_outer(lenient.parsed_atoms(F.col("_r.reply"))).alias("pos", "atom"))


def summarize_sessions(messages: DataFrame, session: str, pos: str, line: str, make_client) -> DataFrame:
    """(session, part, summary, error): the lines of each part of a session, in order, and the summary of the reply.

    messages: rows with a column `part`, as pack_sessions() deals them.
    """
    parts = messages.groupBy(session, "part").agg(F.array_sort(F.collect_list(F.struct(pos, line))).alias("_lines"))
    shown = F.array_join(F.transform("_lines", lambda x: x[line]), "\n")
    asked = parts.withColumn("_r", complete(F.concat(F.lit("# MESSAGES\n"), shown), make_client))
    return asked.select(session, "part", P.summary_text(F.col("_r.reply")).alias("summary"), F.col("_r.error").alias("error"))


def verify(questions: DataFrame, question: str, evidence: str, make_client) -> DataFrame:
    """questions with a verdict; without evidence the model is not asked and nothing is sufficient.

    evidence: an array of (id, source, content).
    """
    lines = F.array_join(F.transform(evidence, lambda e: R.verifier_line(e["id"], e["source"], e["content"])), "\n")
    some = F.coalesce(F.size(evidence), F.lit(0)) > 0
    prompt = F.when(some, F.concat(F.lit("# QUESTION\n"), F.trim(question), F.lit("\n\n# MEMORY RECORDS\n"), lines))
    asked = questions.withColumn("_r", complete(prompt, make_client))
    reply = F.coalesce("_r.reply", F.lit(NOTHING_FOUND))
    return asked.withColumn("verdict", P.parsed_verdict(reply)).drop("_r")


def answer(questions: DataFrame, question: str, evidence: str, hint: str, make_client) -> DataFrame:
    """questions with the answer that a model gives from the evidence; a failed call is an unsupported answer with an error.

    evidence: an array of (time, source, content); hint: the date that stands for today.
    """
    lines = F.array_join(F.transform(evidence, lambda e: R.evidence_line(e["time"], e["content"], e["source"])), "\n")
    context = F.coalesce(F.nullif(lines, F.lit("")), F.lit(R.NO_MEMORIES))
    prompt = F.concat(F.lit("# TODAY\n"), F.col(hint).cast("string"), F.lit("\n\n# MEMORIES\n"), context, F.lit("\n\n# QUESTION\n"), F.col(question))
    asked = questions.withColumn("_r", complete(prompt, make_client))
    parsed = P.parsed_answer(F.col("_r.reply"))
    failed = F.col("_r.error") != ""
    return asked.withColumn("answer", F.when(failed, F.struct(F.lit(None).cast("string").alias("answer"), F.lit(True).alias("unsupported"), F.lit("").alias("reasoning"), F.col("_r.error").alias("error"))).otherwise(parsed)).drop("_r")


def judge(answers: DataFrame, question: str, reference: str, candidate: str, unsupported: str, make_client) -> DataFrame:
    """answers with a judgement; where dates settle the matter, the prompt says so beforehand."""
    from ..functions import dates as D

    hint = D.temporal_verdict(F.col(reference), F.col(candidate))
    prompt = F.concat(
        F.lit("# QUESTION\n"), F.col(question), F.lit("\n# REFERENCE\n"), F.col(reference), F.lit("\n# PREDICTION\n"), P.rendered_prediction(F.col(candidate), F.col(unsupported)),
        F.when(hint == "", "").otherwise(F.concat(F.lit("\n[DATES] "), hint)),
    )
    asked = answers.withColumn("_r", complete(prompt, make_client))
    return asked.withColumn("judgement", P.parsed_judgement(F.col("_r.reply"))).withColumn("judge_error", F.col("judgement.label").isNull()).drop("_r")


def embed_distinct(rows: DataFrame, text: str, embed: Callable[[DataFrame], DataFrame], known: DataFrame | None = None) -> DataFrame:
    """rows with `embedding`: each different text is embedded once, and not at all if `known` (text, embedding) has it.

    embed: takes (text) and returns (text, embedding).
    """
    texts = rows.select(F.col(text).alias("text")).where("text is not null").distinct()
    missing = texts if known is None else texts.join(known.select("text"), "text", "left_anti")
    vectors = embed(missing) if known is None else embed(missing).unionByName(known.select("text", "embedding"))
    return rows.join(vectors.withColumnRenamed("text", "_text"), F.col(text) == F.col("_text"), "left").drop("_text")


def compacted(turns: Column, keep: int, most: int) -> Column:
    """Turns (role, content) with long observations before the last `keep` turns cut to `most` characters; system turns stay."""
    n = F.size(turns)
    note = F.lit("\n… [observation shortened]")

    def one(turn: Column, i: Column) -> Column:
        old = (i < n - keep) & (turn["role"] != "system") & (F.length(turn["content"]) > most)
        return F.struct(turn["role"].alias("role"), F.when(old, F.concat(F.substring(turn["content"], 1, most), note)).otherwise(turn["content"]).alias("content"))

    return F.transform(turns, one)
