"""Queries on a user's store and on layers of memory: replay, pending writes, ledger, repair, tags, pages of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import edits, layers
from ..operators import store as S
from ..schema import messages, table
from .registry import query


def _log(spark, folder) -> DataFrame:
    """Requests that arrive twice now and then, each with one or two messages."""
    e = F.col("event_id")
    rows = table(spark, folder, "events").select("user_id", "ts", e, F.concat(F.lit("r"), F.expr("event_id div 2").cast("string")).alias("request_id"), F.col("event_type").alias("session_id"))
    one = lambda i: F.struct(F.lit("user").alias("role"), F.concat(F.lit(f"m{i} "), e.cast("string")).alias("content"))
    return rows.withColumn("messages", F.when(e % 3 == 0, F.array(one(0), one(1))).otherwise(F.array(one(0))))


_LOG = """f AS (SELECT user_id, 'r' || (event_id // 2) AS request_id, min_by(event_id, struct_pack(ts := ts, e := event_id)) AS event_id, min(struct_pack(ts := ts, e := event_id)) AS seen FROM events GROUP BY ALL),
a AS (SELECT f.*, e.event_type AS session_id FROM f JOIN events e USING (user_id, event_id)),
s AS (SELECT user_id, session_id, row_number() OVER (PARTITION BY user_id ORDER BY min(seen)) AS session_no FROM a GROUP BY user_id, session_id),
m AS (SELECT a.user_id, a.session_id, s.session_no, a.seen, n, 'm' || n || ' ' || a.event_id AS content FROM a JOIN s USING (user_id, session_id), (SELECT unnest([0, 1]) AS n) WHERE n = 0 OR a.event_id % 3 = 0)"""


@query(f"WITH {_LOG} SELECT user_id, 'session_' || session_no || '_' || row_number() OVER (PARTITION BY user_id, session_id ORDER BY seen, n) AS id, content FROM m")
def store_replay(spark, folder):
    rows = S.replay(_log(spark, folder), "user_id", "request_id", "session_id", "messages", "ts", "event_id")
    return rows.select("user_id", "id", F.col("m.content").alias("content"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'stored' ELSE 'pending' END AS origin FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0")
def pending_backfill(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id")
    side = lambda kept, origin: rows.where(kept).withColumn("origin", F.lit(origin))
    pending = side("doc_id % 2 = 0", "pending")
    once = S.adopt_pending(side("doc_id % 3 = 0", "stored"), pending.unionByName(pending), "doc_id")
    return S.adopt_pending(once, pending, "doc_id")


@query("SELECT conv_id AS session_no, CASE WHEN conv_id % 4 = 0 THEN 'new' ELSE 'old' END AS summary FROM conversations GROUP BY conv_id UNION ALL SELECT 1000000 + conv_id, 'new' FROM conversations WHERE conv_id % 4 = 0 GROUP BY conv_id")
def summary_replace(spark, folder):
    rows = messages(spark, folder).select("session_no").distinct()
    old, new = rows.withColumn("summary", F.lit("old")), rows.where("session_no % 4 = 0").withColumn("summary", F.lit("new"))
    return S.replaced(old, new.unionByName(new.withColumn("session_no", F.col("session_no") + 1_000_000)), "session_no")


@query("SELECT 'first' AS rule, doc_id FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT 'any', doc_id FROM documents WHERE doc_id % 5 <> 0 AND (doc_id + 1) % 5 <> 0")
def atom_rebuild(spark, folder):
    """Atoms that stay when each fifth message is extracted again; an atom cites two messages."""
    atoms = table(spark, folder, "documents").select("doc_id", F.array("doc_id", F.col("doc_id") + 1).alias("source"))
    targets = table(spark, folder, "documents").select(F.explode(F.array("doc_id", F.col("doc_id") + 1)).alias("t")).where("t % 5 = 0").distinct()
    rule = lambda name, any_source: S.kept_atoms(atoms, targets, "source", "t", any_source).select(F.lit(name).alias("rule"), "doc_id")
    return rule("first", False).unionByName(rule("any", True))


@query(
    """WITH r AS (SELECT conv_id, turn, role, text FROM conversations WHERE turn % 3 <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) + CASE WHEN conv_id % 2 = 0 THEN 7 ELSE 0 END AS k FROM r)
SELECT 'session_' || conv_id || '_1_' || k AS id, CASE WHEN turn % 2 = 0 THEN 'someone' ELSE role END AS role, md5('fact ' || turn) AS md5 FROM n"""
)
def atom_postprocess(spark, folder):
    rows = messages(spark, folder).select(F.format_string("session_%d_1", "session_no").alias("source_id"), (F.col("msg_no") - 1).alias("pos"), "role")
    memory = F.when(F.col("pos") % 3 == 0, "  ").otherwise(F.concat(F.lit(" fact "), F.col("pos").cast("string"), F.lit(" ")))
    raw = rows.select("source_id", "pos", memory.alias("memory"), F.when(F.col("pos") % 2 == 0, " ").otherwise(F.col("role")).alias("role"), F.lit("someone").alias("default_role"))
    sessions = messages(spark, folder).select("session_no").distinct().where("session_no % 2 = 0")
    existing = sessions.select(F.explode(F.array(F.format_string("session_%d_1_7", "session_no"), F.format_string("session_%d_1_x", "session_no"), F.format_string("session_%d_1_2", "session_no"))).alias("id"))
    return S.new_atoms(raw, existing, "source_id", "pos", "memory", "role", "default_role").select("id", "role", F.md5("memory").alias("md5"))


@query(
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'done' WHEN event_id % 3 = 2 AND event_id % 4 IN (0, 2) THEN 'blocked' WHEN event_id % 4 = 0 THEN 'failed' WHEN event_id % 4 = 1 THEN 'done' WHEN event_id % 4 = 3 THEN 'blocked'
  WHEN event_id % 3 = 1 THEN 'failed' END AS state, CASE WHEN event_id % 4 = 2 THEN 1 ELSE 2 END AS attempts FROM events"""
)
def ledger_update(spark, folder):
    e = F.col("event_id")
    rows = table(spark, folder, "events").select("event_id")
    ledger = rows.select("event_id", F.when(e % 3 == 0, "done").when(e % 3 == 1, "failed").otherwise("blocked").alias("state"), F.lit(1).alias("attempts"))
    outcomes = rows.where(e % 4 != 2).select("event_id", F.when(e % 4 == 0, "failed").when(e % 4 == 1, "done").otherwise("blocked").alias("state"))
    return S.ledger_after(ledger, outcomes, "event_id")


_AUDIT = """c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE turn > 0) AS rest FROM conversations GROUP BY conv_id),
r AS (SELECT conv_id AS session_no, CASE conv_id % 8 WHEN 0 THEN 'failed' WHEN 1 THEN 'blocked' WHEN 2 THEN CASE WHEN rest > 0 THEN 'uncovered' END WHEN 3 THEN 'summary unfinished' WHEN 4 THEN 'summary blocked' WHEN 5 THEN 'summary empty' END AS reason,
  CASE conv_id % 8 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN rest ELSE 0 END AS n_missing FROM c)"""


def _audited(spark, folder, blocked: bool) -> DataFrame:
    rows = messages(spark, folder).select("session_no", "id", "msg_no")
    sessions = rows.groupBy("session_no").agg(F.collect_set("id").alias("all_ids"), F.collect_set(F.when(F.col("msg_no") == 1, F.col("id"))).alias("first_id"))
    case, none = F.col("session_no") % 8, F.array().cast("array<string>")
    ledger = sessions.select(
        "session_no",
        F.when(case == 0, F.array(F.lit("x"))).when(~case.isin(2, 5, 6), none).alias("failed"),
        F.when(case == 1, F.array(F.lit("x"), F.lit("y"))).otherwise(none).alias("blocked"),
        F.when(case == 2, F.col("first_id")).otherwise(F.col("all_ids")).alias("atoms"),
        (case == 3).alias("summary_failed"),
        (case == 4).alias("summary_blocked"),
    )
    summaries = sessions.select("session_no", F.when(case == 5, " ").otherwise("told").alias("text"))
    return S.audit(rows, ledger, summaries, "session_no", "id", blocked)


@query(f"WITH {_AUDIT} SELECT session_no, CAST(n_missing AS BIGINT) AS n_missing, reason FROM r WHERE reason IS NOT NULL")
def store_audit(spark, folder):
    return _audited(spark, folder, True)


@query(f"WITH {_AUDIT} SELECT session_no, CAST(n_missing AS BIGINT) AS n_missing, reason FROM r WHERE reason IS NOT NULL AND reason NOT LIKE '%blocked'")
def repair_sessions(spark, folder):
    """What a repair tries again: blocked work is left alone."""
    return _audited(spark, folder, False)


@query("SELECT user_id, count(*) AS n_messages, count(DISTINCT event_type) AS n_sessions, count(*) FILTER (WHERE event_id % 2 = 0) AS n_atoms, count(*) FILTER (WHERE event_id % 10 = 0) AS n_summaries FROM events GROUP BY user_id")
def store_health(spark, folder):
    rows = table(spark, folder, "events")
    return S.health(rows, rows.where("event_id % 2 = 0"), rows.where("event_id % 10 = 0"), "user_id", "event_type")


@query("SELECT user_id, count(*) AS n_stored, count(*) FILTER (WHERE event_id % 50 <> 0) AS n_replayed FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_id % 50 = 0) > 0")
def refused_rewrites(spark, folder):
    rows = table(spark, folder, "events")
    return S.shrinks(rows.where("event_id % 50 <> 0"), rows, "user_id")


@query(
    """WITH t AS (SELECT lang AS key, source AS value, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) <= 400), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, value) AS r FROM t)
SELECT key, '  ' || rpad(key, 11, ' ') || ' ' || string_agg(key || ':' || value || '(' || n || ')', '  ' ORDER BY r) AS line FROM r WHERE r <= 3 GROUP BY key"""
)
def tag_index_lines(spark, folder):
    return layers.tag_index(table(spark, folder, "documents").select(F.concat_ws(":", "lang", "source").alias("tag")), "tag", most=400)


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id % 2 = 0 UNION ALL SELECT -conv_id * 1000 - turn FROM conversations WHERE conv_id = 5")
def tag_and_session_filters(spark, folder):
    tags = F.array(F.concat(F.lit("lang:"), F.col("lang")), F.when(F.col("doc_id") % 2 == 0, "side:even").otherwise("side:odd"))
    rows = layers.tagged_with(layers.tagged_with(table(spark, folder, "documents").select("doc_id", tags.alias("tag")), "tag", "lang:en"), "tag", "side:even")
    turns = layers.of_session(messages(spark, folder), "id", 5)
    return rows.select("doc_id").unionByName(turns.select((-F.col("session_no") * 1000 - F.col("msg_no") + 1).alias("doc_id")))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
p AS (SELECT doc_id, n, sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY n) AS upto FROM l WHERE n >= 2 AND n < 6),
b AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS back, sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY n DESC) AS upto FROM l)
SELECT 'page' AS how, doc_id, count(*) AS n_lines, CAST(max(upto) AS BIGINT) AS n_bytes FROM p WHERE upto <= 900 GROUP BY doc_id
UNION ALL SELECT 'tail', doc_id, count(*), CAST(max(upto) AS BIGINT) FROM b WHERE back <= 5 AND upto <= 1500 GROUP BY doc_id"""
)
def file_pages(spark, folder):
    lines = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    shown = lambda rows, how: rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max("bytes_upto").alias("n_bytes")).select(F.lit(how).alias("how"), "doc_id", "n_lines", "n_bytes")
    page = shown(layers.paged(lines, "doc_id", "n", "line", 2, 4, most_bytes=900), "page")
    return page.unionByName(shown(layers.truncate_tail(lines, "doc_id", "n", "line", 5, 1500), "tail"))


@query(
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'one TWO three four ' || doc_id WHEN 1 THEN 'ONE two three FOUR ' || doc_id ELSE 'one two three four ' || doc_id END AS text,
  CASE doc_id % 6 WHEN 2 THEN 'no match of edit 1' WHEN 3 THEN 'several matches of edit 1' WHEN 4 THEN 'edits overlap' WHEN 5 THEN 'nothing changed' ELSE '' END AS error FROM documents"""
)
def file_edits(spark, folder):
    files = table(spark, folder, "documents").select("doc_id", F.concat(F.lit("one two three four "), F.col("doc_id").cast("string")).alias("text"))
    case = F.col("doc_id") % 6
    edit = lambda no, old, new: F.struct(F.lit(no).alias("edit_no"), F.lit(old).alias("old"), F.lit(new).alias("new"))
    chosen = (
        F.when(case == 0, F.array(edit(1, "two", "TWO")))
        .when(case == 1, F.array(edit(1, "four", "FOUR"), edit(2, "one", "ONE")))
        .when(case == 2, F.array(edit(1, "six", "x")))
        .when(case == 3, F.array(edit(1, "o", "x")))
        .when(case == 4, F.array(edit(1, "one two", "x"), edit(2, "two three", "y")))
        .otherwise(F.array(edit(1, "two", "two")))
    )
    return edits.with_edits(files, files.select("doc_id", F.explode(chosen).alias("e")).select("doc_id", "e.*"), "doc_id", "text")


@query(
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'plain ' || doc_id WHEN 1 THEN 'a' || chr(10) || 'b ' || doc_id WHEN 2 THEN '[image: http://x/' || doc_id || ']' WHEN 3 THEN 't' || chr(10) || '[image: f.png]' WHEN 4 THEN '[image: <4 bytes>]' ELSE '[image]' END AS text FROM documents"""
)
def content_parts(spark, folder):
    shapes = [
        "plain {id}",
        '["a", {"type": "text", "text": "b {id}"}, {"type": "text", "text": ""}]',
        '[{"type": "image_url", "image_url": {"url": "http://x/{id}"}}]',
        '[{"text": "t"}, {"file_name": "f.png"}, {"type": "other"}]',
        '[{"type": "image", "data": "abcd"}]',
        '[{"type": "image"}]',
    ]
    rows = table(spark, folder, "documents").select("doc_id")
    content = F.replace(F.element_at(F.array(*map(F.lit, shapes)), (F.col("doc_id") % 6 + 1).cast("int")), F.lit("{id}"), F.col("doc_id").cast("string"))
    return rows.select("doc_id", edits.content_text(content).alias("text"))


@query()
def evidence_append(spark, folder):
    """Short facts of odd documents appended to those of even ones, unless known from the same source."""
    facts = table(spark, folder, "documents").select("doc_id", X.first_words(F.col("text"), 8).alias("fact"), F.array(F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string"))).alias("source"))
    out = edits.appended(facts.where("doc_id % 2 = 0"), facts.where("doc_id % 2 = 1"), "doc_id", "fact", "source")
    return out.select("doc_id", F.md5("fact").alias("md5"))
