"""Queries on what models replied: answers, judgements, verdicts, calls, broken files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clip
from ..functions import records as R
from ..functions import replies as P
from ..functions import text as X
from ..operators import evidence, memory, model, resolve
from ..schema import messages, table
from ..sources import lenient
from .registry import query


def chosen(case: Column, options: list[str], **values: Column) -> Column:
    """The option of a row's case, with {name} replaced by the row's values."""
    out = F.element_at(F.array(*map(F.lit, options)), (case + 1).cast("int"))
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


ANSWERS = [
    '{"answer": " A {id} ", "unsupported": false, "reasoning": " because {id}"}',
    '```json\n{"prediction": "P {id}", "reason": ["a", {id}]}\n```',
    'I think: {"final_answer": "", "explanation": null} so far',
    "<Answer>\n  T {id} </answer> trailing",
    "plain {id}",
    "`quoted {id}`",
    "   \n",
    '{"answer": {id}, "unsupported": "true"}',
    '{"answer": null, "unsupported": true}',
    '{"answer": "x" {id}',
    '{"answer": "", "unsupported": false}',
]


def _replied(spark, folder, options: list[str]) -> DataFrame:
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("id"))
    return rows.withColumn("reply", chosen(F.col("id") % len(options), options, id=F.col("id")))


@query(
    """SELECT doc_id AS id, CASE doc_id % 11 WHEN 0 THEN 'A ' || doc_id WHEN 1 THEN 'P ' || doc_id WHEN 3 THEN 'T ' || doc_id WHEN 4 THEN 'plain ' || doc_id WHEN 5 THEN 'quoted ' || doc_id
  WHEN 7 THEN CAST(doc_id AS VARCHAR) WHEN 9 THEN '{"answer": "x" ' || doc_id END AS answer, doc_id % 11 IN (2, 6, 8) AS unsupported,
  CASE doc_id % 11 WHEN 0 THEN 'because ' || doc_id WHEN 1 THEN '["a",' || doc_id || ']' WHEN 2 THEN 'null' ELSE '' END AS reasoning, CASE WHEN doc_id % 11 = 6 THEN 'empty reply' ELSE '' END AS error FROM documents"""
)
def answer_parse(spark, folder):
    return _replied(spark, folder, ANSWERS).select("id", P.parsed_answer(F.col("reply")).alias("p")).select("id", "p.*")


JUDGEMENTS = [
    '{"label": "correct", "reason": "r {id}"}',
    ' {"judgement": "WRONG", "explanation": 5} ',
    "<judgement> Incorrect </judgement>\n<reason> why {id} </reason>",
    "<JUDGEMENT>CORRECT</JUDGEMENT>",
    "That is INCORRECT, number {id}",
    "it seems correct ({id})",
    "no idea {id}",
    '{"label": "maybe"} but correct',
]


@query(
    """SELECT doc_id AS id, CASE doc_id % 8 WHEN 0 THEN 'CORRECT' WHEN 1 THEN 'INCORRECT' WHEN 2 THEN 'INCORRECT' WHEN 3 THEN 'CORRECT' WHEN 4 THEN 'INCORRECT' WHEN 5 THEN 'CORRECT' WHEN 7 THEN 'CORRECT' END AS label,
  CASE doc_id % 8 WHEN 0 THEN 'r ' || doc_id WHEN 1 THEN '5' WHEN 2 THEN 'why ' || doc_id WHEN 3 THEN '' WHEN 4 THEN 'That is INCORRECT, number ' || doc_id WHEN 5 THEN 'it seems correct (' || doc_id || ')'
    WHEN 7 THEN '{"label": "maybe"} but correct' END AS reason FROM documents"""
)
def judgement_parse(spark, folder):
    return _replied(spark, folder, JUDGEMENTS).select("id", P.parsed_judgement(F.col("reply")).alias("p")).select("id", "p.*")


VERDICTS = [
    '{"sufficient": true, "answer": " yes {id} ", "missing": []}',
    '```\n{"sufficient": false, "missing": ["a {id}", " ", 7]}\n```',
    'So {"sufficient": false, "missing": " m ", "answer": null} it is',
    '{"sufficient": "true"}',
    "not JSON {id}",
    "",
]


@query(
    """SELECT doc_id AS id, doc_id % 6 = 0 AS sufficient, CASE WHEN doc_id % 6 = 0 THEN 'yes ' || doc_id ELSE '' END AS answer, CASE doc_id % 6 WHEN 1 THEN 'a ' || doc_id || '|7' WHEN 2 THEN 'm' ELSE '' END AS missing,
  CASE doc_id % 6 WHEN 3 THEN 'verifier ''sufficient'' must be a boolean' WHEN 4 THEN 'verifier reply is not a JSON object' WHEN 5 THEN 'empty verifier reply' ELSE '' END AS error FROM documents"""
)
def verdict_parse(spark, folder):
    rows = _replied(spark, folder, VERDICTS).select("id", P.parsed_verdict(F.col("reply")).alias("p"))
    return rows.select("id", "p.sufficient", "p.answer", F.array_join("p.missing", "|").alias("missing"), "p.error")


SUMMARIES = ['{"memory": " one  two\\n{id} "}', '```json\n{"memory": "", "summary": "s {id}"}\n```', "free   text\n{id}", '{"other": 1}', "", 'x {"content": "c {id}"} y']


@query("SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN 'one two ' || doc_id WHEN 1 THEN 's ' || doc_id WHEN 2 THEN 'free text ' || doc_id WHEN 5 THEN 'c ' || doc_id ELSE '' END AS summary FROM documents")
def summary_parse(spark, folder):
    return _replied(spark, folder, SUMMARIES).select("id", P.summary_text(F.col("reply")).alias("summary"))


PAYLOADS = ['{"a": {id}}', 'Note:\n{"a": {id}}', 'Note: {"a": [1, {id}]} and more', "see [1, {id}] there", "nothing {id}", '{"a": {id}', "[{id}"]


@query(
    """SELECT doc_id AS id, CASE doc_id % 7 WHEN 0 THEN '{"a": ' || doc_id || '}' WHEN 1 THEN '{"a": ' || doc_id || '}' WHEN 2 THEN '{"a": [1, ' || doc_id || ']}' WHEN 3 THEN '[1, ' || doc_id || ']' END AS payload,
  doc_id % 7 = 0 AS whole FROM documents"""
)
def payload_parse(spark, folder):
    return _replied(spark, folder, PAYLOADS).select("id", P.embedded_payload(F.col("reply")).alias("payload"), P.looks_like_json(F.col("reply")).alias("whole"))


CALLS = [
    '{"tool": "bash", "args": {"command": "ls {id}"}}',
    '{"tool": "bash", "command": "ls {id}"} }',
    'x <tool_call>{"name": "read", "arguments": "{\\"path\\": \\"{id}\\"}"}</tool_call> <tool_call>{"name": "write", "args": {}}</tool_call>',
    '{"type": "function", "function": {"name": "grep", "arguments": {"q": {id}}}}',
    "done {id}",
    '{"content": "a record", "metadata": {}}',
]


@query(
    """SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS n_calls,
  CASE doc_id % 6 WHEN 0 THEN 'bash' WHEN 1 THEN 'bash' WHEN 2 THEN 'read write' WHEN 3 THEN 'grep' ELSE '' END AS tools,
  CASE doc_id % 6 WHEN 0 THEN 'ls ' || doc_id WHEN 1 THEN 'ls ' || doc_id END AS command FROM documents"""
)
def tool_call_parse(spark, folder):
    rows = _replied(spark, folder, CALLS).withColumn("calls", lenient.parsed_tool_calls(F.col("reply")))
    tools = F.array_join(F.transform("calls", lambda c: F.get_json_object(c, "$.tool")), " ")
    return rows.select("id", F.size("calls").alias("n_calls"), tools.alias("tools"), F.get_json_object(F.get("calls", F.lit(0)), "$.args.command").alias("command"))


ATOMS = ['[{"memory": "a {id}"}, {"memory": "b"}, 7]', '```json\n[{"memory": "a {id}"}]\n```', '{"memory": "a {id}"}', '[{"memory": "a {id}"}, {"memory": "b', '"text"', "none {id}"]


@query("SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS n_atoms, CASE WHEN doc_id % 6 < 4 THEN 'a ' || doc_id END AS first_memory FROM documents")
def atom_array_parse(spark, folder):
    rows = _replied(spark, folder, ATOMS).withColumn("atoms", lenient.parsed_atoms(F.col("reply")))
    return rows.select("id", F.size("atoms").alias("n_atoms"), F.get_json_object(F.get("atoms", F.lit(0)), "$.memory").alias("first_memory"))


FILES = [
    '{"a": {id}}\n\nbroken\n[{"a": 1}, {"a": 2}, 5]',
    '[{"a": {id}},\n{"a":\n2}]',
    '[{"a": {id}}\n{"a":\n2},]',
    '[{"a": {id}},\n {"a": {"b": 1}, "c": 2},\n {"a": 3',
    "\n\n",
    "5\nx",
    '[{"a": {id}, "m": {"s": ["x"]},\n {"a": 2, "m": {"s": ["y"]}}]',
]


@query(
    """SELECT doc_id AS id, CASE doc_id % 7 WHEN 0 THEN 'linewise' WHEN 1 THEN 'document' WHEN 2 THEN 'document' WHEN 3 THEN 'document' WHEN 4 THEN 'linewise' WHEN 5 THEN 'linewise' ELSE 'salvaged' END AS mode,
  CASE doc_id % 7 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 6 THEN 2 ELSE 0 END AS n_records, CASE doc_id % 7 WHEN 0 THEN 1 WHEN 5 THEN 2 ELSE 0 END AS n_bad, CASE doc_id % 7 WHEN 0 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS n_empty
FROM documents"""
)
def lenient_file_parse(spark, folder):
    rows = lenient.parse_files(_replied(spark, folder, FILES), "id", "reply")
    return rows.select("id", "mode", F.size("records").alias("n_records"), "n_bad", "n_empty")


@query("SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE 0 END AS n_records, CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 0 END AS n_dropped FROM documents")
def json_salvage(spark, folder):
    rows = _replied(spark, folder, ['[{"a": {"b": {id}}, "c": 2}, {"a": 1}, {"a": 3', '[{"a": {"b": {id}}, {"c": 2}]', "none {id}"])
    return rows.select("id", memory.salvaged_records(F.col("reply")).alias("s")).select("id", F.size("s.records").alias("n_records"), "s.n_dropped")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN '(no answer provided)' ELSE 'A ' || doc_id END || CASE WHEN doc_id % 2 = 0 THEN ' (model marked this answer as unsupported by the memories)' ELSE '' END AS shown FROM documents")
def prediction_render(spark, folder):
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("id"))
    answer = F.when(F.col("id") % 3 != 0, F.concat(F.lit(" A "), F.col("id").cast("string")))
    return rows.select("id", P.rendered_prediction(answer, F.col("id") % 2 == 0).alias("shown"))


_CLIPPED = "CASE WHEN text = '' OR text IS NULL THEN '' WHEN length(text) <= 800 THEN text ELSE {} END"


@query(
    f"""SELECT doc_id, md5({_CLIPPED.format("'…(truncated)…' || right(text, 784)")}) AS tail, md5({_CLIPPED.format("left(text, 784) || '…(truncated)…'")}) AS head,
  md5(CASE WHEN coalesce(length(text), 0) <= 800 THEN coalesce(text, '') ELSE left(text, CAST(floor((800 - 33) / 2) AS INTEGER)) || chr(10) || '…(middle of this part omitted)…' || chr(10) || right(text, CAST(floor((800 - 33) / 2) AS INTEGER)) END) AS middle
FROM documents"""
)
def text_clip(spark, folder):
    rows, text = table(spark, folder, "documents"), F.col("text")
    return rows.select("doc_id", F.md5(clip.clip_text(text, 200)).alias("tail"), F.md5(clip.clip_text(text, 200, "head")).alias("head"), F.md5(clip.clip_middle(text, 200)).alias("middle"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n, length(text) AS whole FROM documents WHERE text IS NOT NULL),
c AS (SELECT *, (length(line) + 3) // 4 + 1 AS cost FROM l), s AS (SELECT *, sum(cost) OVER (PARTITION BY doc_id ORDER BY n DESC) AS used, count(*) OVER (PARTITION BY doc_id) AS lines FROM c)
SELECT doc_id, CAST(count(*) FILTER (WHERE (whole + 3) // 4 <= 100 OR used <= 93 OR (n = lines AND cost <= 94)) AS INTEGER) AS n_kept FROM s WHERE lines > 1 GROUP BY doc_id"""
)
def context_clip(spark, folder):
    """Whole lines that stay of texts of several lines."""
    rows = table(spark, folder, "documents").where(F.col("text").contains("\n"))
    shown = clip.clip_context(F.col("text"), 100)
    lines = F.split(shown, "\n", -1)
    body = F.size(F.filter(lines, lambda x: (x != clip.OMITTED) & ~x.startswith(clip.CUT)))
    # a context that fits keeps all of its lines, also empty ones at its end
    return rows.select("doc_id", F.when(X.estimate_tokens(F.col("text")) <= 100, F.size(F.split("text", "\n", -1))).when(shown == "", 0).otherwise(body).alias("n_kept"))


@query(
    """WITH m AS (SELECT 'session_' || conv_id || '_' || (turn + 1) AS id, conv_id, turn, role, text FROM conversations)
SELECT id, md5('[' || id || ']' || CASE WHEN turn % 2 = 0 THEN ' (t' || turn || ')' ELSE '' END || ' ' || CASE WHEN turn % 3 = 0 THEN 'unknown' ELSE role END || ': ' || coalesce(text, '')) AS line,
  md5(CASE WHEN turn % 2 = 0 THEN '[t' || turn || '] ' ELSE '' END || coalesce(text, '') || '  (from: ' || id || ', x)') AS cited,
  md5('[' || id || '] source=[' || id || ', x]' || chr(10) || '  ' || CASE WHEN length(text) > 60 THEN left(text, 60) || '…' ELSE coalesce(text, '') END) AS checked FROM m"""
)
def record_render(spark, folder):
    rows = messages(spark, folder).withColumn("turn", F.col("msg_no") - 1)
    time = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("t"), F.col("turn").cast("string"))).otherwise("")
    source = F.array("id", F.lit("x"))
    return rows.select(
        "id",
        F.md5(R.message_line(F.col("id"), time, F.when(F.col("turn") % 3 != 0, F.col("role")), F.col("text"))).alias("line"),
        F.md5(R.evidence_line(time, F.col("text"), source)).alias("cited"),
        F.md5(R.verifier_line(F.col("id"), source, F.col("text"), 60)).alias("checked"),
    )


@query(
    """SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN 'session_' || doc_id || '_3' WHEN 1 THEN array_to_string(list_sort(['session_4_4', 'session_' || doc_id || '_1']), '|')
  WHEN 2 THEN 'session_11_' || doc_id WHEN 5 THEN 'session_1_2' ELSE '' END AS ids, CASE doc_id % 6 WHEN 0 THEN 'session_' || doc_id || '_3' WHEN 5 THEN 'session_1_2' ELSE '' END AS older FROM documents"""
)
def evidence_markers(spark, folder):
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("id"))
    marker = chosen(F.col("id") % 6, ["D{id}:3", "D{id}:1 D4:4", "D:11:{id}", "junk {id}", "", "D1:2"], id=F.col("id"))
    markers = F.when(F.col("id") % 6 == 5, F.array(marker, marker, F.lit(None).cast("string"))).otherwise(F.array(marker))
    return rows.select("id", F.array_join(R.marked_ids(markers), "|").alias("ids"), F.array_join(R.marked_ids_one_each(markers), "|").alias("older"))


@query(
    """SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'm' || doc_id ELSE '' END AS memory_id, CASE doc_id % 3 WHEN 0 THEN 'm' || doc_id WHEN 1 THEN 'x' || doc_id ELSE '' END AS message_id,
  CASE WHEN doc_id % 3 = 0 THEN 'atom' ELSE '' END AS kind, CASE WHEN doc_id % 3 = 0 THEN 'A' ELSE '' END AS role, CASE doc_id % 3 WHEN 0 THEN 't' WHEN 1 THEN 'now' ELSE '' END AS time,
  CASE doc_id % 3 WHEN 0 THEN 'mem' WHEN 1 THEN 'txt' ELSE '' END AS text, CASE doc_id % 3 WHEN 0 THEN 'con' WHEN 1 THEN 'txt' ELSE '' END AS said FROM documents"""
)
def record_fields(spark, folder):
    shapes = [
        '{"memory": "mem", "content": "con", "metadata": {"id": "m{id}", "type": "atom", "role": "A", "time": "t"}}',
        '{"msg_id": "x{id}", "text": "txt", "time": "now", "metadata": {"id": {id}, "type": "other"}}',
        '{"memory": 5, "metadata": null}',
    ]
    r = F.col("reply")
    return _replied(spark, folder, shapes).select(
        "id", R.memory_id(r).alias("memory_id"), R.message_id(r).alias("message_id"), R.memory_type(r).alias("kind"), R.memory_role(r).alias("role"), R.message_time(r).alias("time"),
        R.record_text(r).alias("text"), R.record_text(r, R.MESSAGE_TEXT).alias("said"),
    )


@query("SELECT doc_id AS id, CASE doc_id % 2 WHEN 0 THEN 'A' || doc_id ELSE 'B' || doc_id END AS answer FROM documents")
def reference_answers(spark, folder):
    rows = _replied(spark, folder, ['{"answer": "A{id}", "adversarial_answer": "x"}', '{"adversarial_answer": "B{id}"}'])
    return rows.select("id", R.reference_answer(F.col("reply")).alias("answer"))


# ---- models ----


def _scripted():
    return model.ScriptedClient(
        [
            (r"# MESSAGE\n(\S+)", r'[{"memory": "said \1"}, {"memory": "again \1"}]'),
            (r"# MESSAGES\n\[(\S+)\]", r'{"memory": "begins with \1"}'),
            (r"# MEMORY RECORDS\n\[(\S+)\]", r'{"sufficient": true, "answer": "\1", "missing": []}'),
            (r"# PREDICTION\nA1 .*SAME", r'{"label": "CORRECT", "reason": "dates"}'),
            (r"# PREDICTION\n(\S*)", r'{"label": "WRONG", "reason": "\1"}'),
            (r"# TODAY\n(\S+).*# MEMORIES\n\(no", r'{"answer": "", "reasoning": "\1"}'),
            (r"# MEMORIES\n(\S+)", r'{"answer": "\1", "unsupported": false}'),
        ]
    )


@query("SELECT 'session_' || conv_id || '_' || (turn + 1) AS id, 0 AS unit, 'done' AS state, n AS pos, CASE n WHEN 0 THEN 'said ' ELSE 'again ' END || 'm' || conv_id AS memory FROM conversations, (SELECT unnest([0, 1]) AS n)")
def atom_extraction(spark, folder):
    rows = messages(spark, folder).select("id", F.lit("").alias("context"), F.concat(F.lit("m"), F.col("session_no").cast("string"), F.lit(" "), F.coalesce("text", F.lit(""))).alias("content"))
    return model.extract_atoms(rows, "id", "context", "content", _scripted, 100_000).select("id", "unit", "state", "pos", F.get_json_object("atom", "$.memory").alias("memory"))


@query("SELECT conv_id AS session_no, 'begins with session_' || conv_id || '_' || (min(turn) + 1) AS summary, '' AS error FROM conversations GROUP BY conv_id")
def session_summaries(spark, folder):
    rows = messages(spark, folder).withColumn("part", F.lit(0)).withColumn("line", R.message_line(F.col("id"), F.lit(""), F.col("role"), F.col("text")))
    return model.summarize_sessions(rows, "session_no", "msg_no", "line", _scripted).select("session_no", "summary", "error")


def _cited(spark, folder) -> DataFrame:
    rows = table(spark, folder, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    one = F.struct(F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), F.lit("").alias("time"), F.array(F.lit("s")).alias("source"), F.concat(F.lit("e"), F.col("id").cast("string")).alias("content"))
    return rows.withColumn("evidence", F.when(F.col("id") % 3 != 0, F.array(one)))


@query("SELECT item_id AS id, item_id % 3 <> 0 AS sufficient, CASE WHEN item_id % 3 <> 0 THEN 'r' || item_id ELSE '' END AS answer, CASE WHEN item_id % 3 = 0 THEN 'no evidence' ELSE '' END AS missing FROM benchmark")
def verifier_gate(spark, folder):
    rows = model.verify(_cited(spark, folder), "question", "evidence", _scripted)
    return rows.select("id", "verdict.sufficient", "verdict.answer", F.array_join("verdict.missing", "|").alias("missing"))


@query("SELECT item_id AS id, CASE WHEN item_id % 3 <> 0 THEN 'e' || item_id END AS answer, item_id % 3 = 0 AS unsupported, CASE WHEN item_id % 3 = 0 THEN '2024-02-03' ELSE '' END AS reasoning, '' AS error FROM benchmark")
def evidence_answers(spark, folder):
    rows = _cited(spark, folder).withColumn("today", F.lit("2024-02-03"))
    return model.answer(rows, "question", "evidence", "today", _scripted).select("id", "answer.*")


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'CORRECT' ELSE 'INCORRECT' END AS label, CASE o_orderkey % 3 WHEN 0 THEN 'dates' WHEN 1 THEN 'A1' ELSE '(no' END AS reason FROM orders")
def judged_answers(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "d MMMM yyyy").alias("shown"))
    reference = F.concat(F.lit("the week before "), F.col("shown"))
    said = F.when(F.col("id") % 3 == 0, F.concat(F.lit("A1 the week before "), F.col("shown"))).when(F.col("id") % 3 == 1, "A1 nothing").otherwise("")
    rows = rows.select("id", F.lit("when?").alias("q"), reference.alias("r"), said.alias("c"), F.lit(False).alias("u"))
    return model.judge(rows, "q", "r", "c", "u", _scripted).select("id", "judgement.*")


@query("SELECT event_id, event_type = 'view' AS known, length(event_type) AS size FROM events")
def embedding_cache(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "event_type")
    known = rows.where("event_type = 'view'").select(F.col("event_type").alias("text")).distinct().withColumn("embedding", F.array(F.length("text").cast("double"), F.lit(1.0)))
    out = model.embed_distinct(rows, "event_type", lambda texts: texts.withColumn("embedding", F.array(F.length("text").cast("double"), F.lit(0.0))), known)
    return out.select("event_id", (F.col("embedding")[1] == 1).alias("known"), F.col("embedding")[0].cast("long").alias("size"))


@query(
    """WITH t AS (SELECT conv_id, turn, role, text, count(*) OVER (PARTITION BY conv_id) - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations)
SELECT conv_id AS session_no, CAST(sum(CASE WHEN after >= 2 AND role <> 'system' AND length(text) > 20 THEN 20 + 26 ELSE length(text) END) AS BIGINT) AS n_chars FROM t GROUP BY conv_id"""
)
def context_compaction(spark, folder):
    turns = messages(spark, folder).groupBy("session_no").agg(F.array_sort(F.collect_list(F.struct("msg_no", "role", F.col("text").alias("content")))).alias("turns"))
    short = model.compacted(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))), 2, 20)
    return turns.select("session_no", F.aggregate(F.transform(short, lambda t: F.length(t["content"])), F.lit(0), lambda n, x: n + x).cast("long").alias("n_chars"))


# ---- evidence and facts ----


def _evidence(spark, folder) -> DataFrame:
    rows = messages(spark, folder)
    case = F.col("msg_no") % 6
    return rows.select(
        F.col("session_no").alias("file"),
        (F.col("session_no") * 1_000_000 + F.col("msg_no")).alias("pos"),
        F.when(case == 0, "  ").when(case == 1, F.concat(F.lit("  said   "), F.col("role"))).otherwise(F.concat(F.lit("said "), F.col("id"))).alias("content"),
        F.when(case == 2, F.array().cast("array<string>")).when(case == 3, F.array("id", F.lit(" "))).otherwise(F.array("id")).alias("source"),
        F.when(case != 4, F.lit(50.0)).alias("score"),
    )


_EVIDENCE = """e AS (SELECT conv_id AS file, conv_id * 1000000 + turn + 1 AS pos, (turn + 1) % 6 AS c, role, 'session_' || conv_id || '_' || (turn + 1) AS id FROM conversations),
r AS (SELECT *, CASE c WHEN 0 THEN '  ' WHEN 1 THEN '  said   ' || role ELSE 'said ' || id END AS content, CASE c WHEN 0 THEN NULL WHEN 1 THEN 'said ' || role ELSE 'said ' || id END AS identity FROM e)"""


@query(
    f"""WITH {_EVIDENCE}, f AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY pos) AS n FROM r WHERE c IN (1, 4, 5)),
v AS (SELECT r.file, CASE WHEN r.c = 0 OR r.c IN (2, 3) OR f.n > 1 THEN 'rejected' WHEN r.c = 4 THEN 'repaired' ELSE 'valid' END AS status, coalesce(f.n > 1, false) AS again FROM r LEFT JOIN f USING (pos))
SELECT file, count(*) FILTER (WHERE status = 'valid') AS n_valid, count(*) FILTER (WHERE status = 'repaired') AS n_repaired, count(*) FILTER (WHERE status = 'rejected') AS n_rejected, count(*) FILTER (WHERE again) AS n_duplicates FROM v GROUP BY file"""
)
def evidence_validate(spark, folder):
    return evidence.evidence_report(evidence.validate(_evidence(spark, folder), "pos"), "file")


@query(
    f"""WITH {_EVIDENCE}, p AS (SELECT file, identity, min_by(content, pos) AS body, count(*) AS n FROM r WHERE identity IS NOT NULL GROUP BY ALL),
d AS (SELECT file, left(sha256(string_agg(identity || chr(0) || body || chr(1), '' ORDER BY identity, body)), 16) AS fingerprint, count(*) AS n_unique, CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM p GROUP BY file),
l AS (SELECT file, count(*) AS n_lines, CAST(sum(octet_length(encode(content)) + 1) AS BIGINT) AS n_bytes FROM r GROUP BY file)
SELECT l.file, n_lines, coalesce(n_unique, 0) AS n_unique, coalesce(n_duplicates, 0) AS n_duplicates, n_bytes, coalesce(fingerprint, '') AS fingerprint FROM l LEFT JOIN d USING (file)"""
)
def evidence_state_fingerprint(spark, folder):
    return evidence.evidence_state(_evidence(spark, folder), "file", "pos")


def _facts(spark, folder) -> DataFrame:
    """Short facts: the first eight words of each document, three documents to a source."""
    return table(spark, folder, "documents").select("doc_id", X.first_words(F.col("text"), 8).alias("fact"), F.array(F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string"))).alias("source"))


@query()
def near_dup_reject(spark, folder):
    """Facts of odd documents that no even document says from the same source."""
    rows = _facts(spark, folder)
    return resolve.not_yet_known(rows.where("doc_id % 2 = 1"), rows.where("doc_id % 2 = 0"), "doc_id", "fact", "source").select("doc_id", F.md5("fact").alias("md5"))


@query()
def greedy_fact_merge(spark, folder):
    rows = _facts(spark, folder).withColumn("corpus", (F.col("doc_id") % 5).cast("int"))
    merged = resolve.greedy_merge(rows, "corpus", "doc_id", "fact", "source")
    return merged.select("corpus", "doc_id", F.array_join("source", " ").alias("sources"), "n_merged")
