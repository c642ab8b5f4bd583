"""A user's store: numbering and replay of requests, pending writes, the ledger of extraction, and repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Statuses at which the same prompt fails again, and what messages say of a prompt that is too long or refused.
PERMANENT = (400, 401, 403, 404, 413, 422)
LENGTH_HINTS = ("context length", "context_length", "maximum context", "max context", "reduce the length", "too many tokens", "token limit", "too long")
FILTER_HINTS = ("content management policy", "content_filter", "content filter", "content policy", "safety system", "moderation", "was filtered", "flagged")
# States of a message or summary in the ledger.
DONE, FAILED, BLOCKED = "done", "failed", "blocked"


def first_requests(log: DataFrame, user: str, request: str, *order: str) -> DataFrame:
    """The first arrival of each request of a user, and how often it arrived."""
    first = F.min(F.struct(*order, *(c for c in log.columns if c not in {user, request, *order})))
    rows = log.groupBy(user, request).agg(first.alias("_first"), F.count(F.lit(1)).alias("n_received"))
    return rows.select(user, request, "_first.*", "n_received")


def number_sessions(rows: DataFrame, user: str, session: str, *order: str) -> DataFrame:
    """rows with session_no, by first appearance for each user, and msg_no, which goes on within a session.

    Only the first place of each session is numbered over the user, so a user's long sessions stay apart.
    """
    firsts = rows.groupBy(user, session).agg(F.min(F.struct(*order)).alias("_first"))
    firsts = firsts.withColumn("session_no", F.row_number().over(Window.partitionBy(user).orderBy("_first"))).drop("_first")
    numbered = rows.join(firsts, [user, session])
    return numbered.withColumn("msg_no", F.row_number().over(Window.partitionBy(user, session).orderBy(*order)))


def replay(log: DataFrame, user: str, request: str, session: str, messages: str, *order: str) -> DataFrame:
    """(user, session, session_no, msg_no, id, m): a store rebuilt from its request log, each request applied once."""
    applied = first_requests(log, user, request, *order)
    sessions = number_sessions(applied, user, session, *order).drop("msg_no")
    each = sessions.select(user, session, "session_no", *order, request, F.posexplode(messages).alias("_pos", "m"))
    no = F.row_number().over(Window.partitionBy(user, session).orderBy(*order, "_pos"))
    out = each.withColumn("msg_no", no)
    return out.select(user, session, "session_no", "msg_no", F.format_string("session_%d_%d", "session_no", "msg_no").alias("id"), "m")


def adopt_pending(stored: DataFrame, pending: DataFrame, *key: str) -> DataFrame:
    """stored with the pending records that it lacks; adopting them again changes nothing."""
    return stored.unionByName(pending.select(*stored.columns).dropDuplicates(list(key)).join(stored.select(*key), list(key), "left_anti"))


def replaced(stored: DataFrame, incoming: DataFrame, *key: str) -> DataFrame:
    """stored with the rows of incoming in place of those with their key."""
    return stored.join(incoming.select(*key).distinct(), list(key), "left_anti").unionByName(incoming.select(*stored.columns))


def kept_atoms(atoms: DataFrame, targets: DataFrame, source: str, target: str, any_source: bool = False) -> DataFrame:
    """Atoms that stay when the targets' messages are extracted again.

    An atom goes if its first source is a target; with `any_source`, if any of its sources is one.
    """
    if not any_source:
        return atoms.join(targets.select(F.col(target).alias("_t")).distinct(), F.get(source, F.lit(0)) == F.col("_t"), "left_anti")
    keyed = atoms.withColumn("_row", F.struct(*atoms.columns))
    hit = keyed.select("_row", F.explode(source).alias("_t")).join(targets.select(F.col(target).alias("_t")).distinct(), "_t", "left_semi").select("_row").distinct()
    return keyed.join(hit, "_row", "left_anti").drop("_row")


def next_suffixes(existing: DataFrame, record_id: str) -> DataFrame:
    """(source_id, last): the greatest k of the ids {source_id}_{k}."""
    parts = existing.select(F.regexp_extract(record_id, r"^(.*)_([0-9]+)$", 1).alias("source_id"), F.regexp_extract(record_id, r"^(.*)_([0-9]+)$", 2).try_cast("int").alias("k"))
    return parts.where("k is not null").groupBy("source_id").agg(F.max("k").alias("last"))


def new_atoms(raw: DataFrame, existing: DataFrame, source_id: str, pos: str, memory: str, role: str, default_role: str, record_id: str = "id") -> DataFrame:
    """raw facts with text as atoms: trimmed, with a role, and an id that goes on from the source's greatest suffix."""
    rows = raw.withColumns({memory: F.trim(F.coalesce(F.col(memory), F.lit(""))), role: F.coalesce(F.nullif(F.trim(role), F.lit("")), F.col(default_role))})
    rows = rows.where(F.col(memory) != "")
    last = next_suffixes(existing, record_id).withColumnRenamed("source_id", source_id)
    k = F.row_number().over(Window.partitionBy(source_id).orderBy(pos)) + F.coalesce("last", F.lit(0))
    return rows.join(last, source_id, "left").withColumn(record_id, F.concat(F.col(source_id).cast("string"), F.lit("_"), k.cast("string"))).drop("last")


def ledger_after(ledger: DataFrame, outcomes: DataFrame, *key: str) -> DataFrame:
    """The ledger (key, state, attempts) after a pass: an outcome replaces its state and counts as an attempt.

    A blocked message stays blocked until it succeeds; `done` stays done.
    """
    both = ledger.select(*key, "state", "attempts").join(outcomes.select(*key, F.col("state").alias("_new")), list(key), "full")
    state = F.when(F.col("state") == DONE, DONE).when((F.col("state") == BLOCKED) & (F.col("_new") == FAILED), BLOCKED).otherwise(F.coalesce("_new", "state"))
    return both.select(*key, state.alias("state"), (F.coalesce("attempts", F.lit(0)) + F.col("_new").isNotNull().cast("int")).alias("attempts"))


def audit(messages: DataFrame, ledger: DataFrame, summaries: DataFrame, session: str, record_id: str, blocked: bool = True) -> DataFrame:
    """(session, n_missing, reason): sessions that are owed work, and why.

    ledger: one row for each session that was refreshed: failed and blocked (arrays of ids; failed is null in rows of
    an older form), atoms (ids covered), summary_failed, summary_blocked. summaries: (session, text).
    """
    named = summaries.where(F.trim("text") != "").select(session, F.lit(True).alias("_summed")).distinct()
    covered = ledger.where("failed is null").select(session, F.explode("atoms").alias(record_id))
    gaps = messages.join(ledger.where("failed is null").select(session), session, "left_semi").join(covered, [session, record_id], "left_anti")
    gaps = gaps.groupBy(session).agg(F.count(F.lit(1)).alias("_gap"))
    size = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0))
    rows = ledger.join(gaps, session, "left").join(named, session, "left")
    failed, held = size("failed"), size("blocked") if blocked else F.lit(0)
    old = F.col("failed").isNull()
    gap = F.coalesce("_gap", F.lit(0))
    reason = (
        F.when(~old & (failed > 0), "failed")
        .when(~old & (held > 0), "blocked")
        .when(old & (gap > 0), "uncovered")
        .when(F.coalesce("summary_failed", F.lit(False)), "summary unfinished")
        .when(F.coalesce("summary_blocked", F.lit(False)) & F.lit(blocked), "summary blocked")
        .when(old & F.col("_summed").isNull(), "summary empty")
    )
    missing = F.when(~old & (failed > 0), failed).when(~old, held).otherwise(gap)
    return rows.select(session, missing.cast("long").alias("n_missing"), reason.alias("reason")).where("reason is not null")


def health(messages: DataFrame, atoms: DataFrame, summaries: DataFrame, user: str, session: str) -> DataFrame:
    """Messages, sessions, atoms and summaries of each user."""
    counted = messages.groupBy(user).agg(F.count(F.lit(1)).alias("n_messages"), F.countDistinct(session).alias("n_sessions"))
    parts = [rows.groupBy(user).agg(F.count(F.lit(1)).alias(name)) for rows, name in ((atoms, "n_atoms"), (summaries, "n_summaries"))]
    for part in parts:
        counted = counted.join(part, user, "left")
    return counted.fillna(0, ["n_atoms", "n_summaries"])


def shrinks(replayed: DataFrame, stored: DataFrame, user: str) -> DataFrame:
    """Users whose replay has fewer rows than their store; such a store must not be rewritten."""
    count = lambda rows, name: rows.groupBy(user).agg(F.count(F.lit(1)).alias(name))
    both = count(stored, "n_stored").join(count(replayed, "n_replayed"), user, "left").fillna(0, ["n_replayed"])
    return both.where("n_replayed < n_stored")


def error_class(status: Column, message: Column) -> Column:
    """context_length, content_filter, permanent or transient: what a failed call is worth trying again for."""
    low = F.lower(F.coalesce(message, F.lit("")))
    hinted = lambda hints: F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(low, h))
    open_ = status.isNull() | status.isin(*PERMANENT)
    return F.when(open_ & hinted(LENGTH_HINTS), "context_length").when(open_ & hinted(FILTER_HINTS), "content_filter").when(status.isin(*PERMANENT), "permanent").otherwise("transient")
