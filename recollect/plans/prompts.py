"""Queries on what goes into prompts and how runs are chosen: indexes, participants, selections, steps, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions import text as X
from ..operators import dataset, envelopes, layers, runs
from ..operators import store as S
from ..schema import messages, table
from .registry import query


@query("SELECT layer, id FROM (SELECT 'atom' AS layer, 'doc_' || doc_id AS id, text FROM documents UNION ALL SELECT 'msg', 'session_' || conv_id || '_' || (turn + 1), text FROM conversations) WHERE regexp_matches(text, '(?i)^\\D+[0-9]+\\W')")
def keyword_search_regex(spark, folder):
    """A pattern with classes whose letter case matters."""
    atoms = table(spark, folder, "documents").select(F.lit("atom").alias("layer"), F.format_string("doc_%d", "doc_id").alias("id"), "text")
    both = atoms.unionByName(messages(spark, folder).select(F.lit("msg").alias("layer"), "id", "text"))
    return layers.keyword_search(both, r"^\D+[0-9]+\W").select("layer", "id")


@query(
    """WITH f AS (SELECT conv_id // 20 AS corpus_id, role, min(conv_id * 1000000 + turn) AS seen FROM conversations WHERE coalesce(trim(role), '') <> '' GROUP BY ALL),
l AS (SELECT corpus_id, list(role ORDER BY seen) AS names FROM f GROUP BY corpus_id)
SELECT corpus_id, array_to_string(names, '|') AS speakers, CASE len(names) WHEN 1 THEN names[1] ELSE array_to_string(names[1:len(names) - 1], ', ') || ' and ' || names[len(names)] END AS phrase,
  names[1] AS a, CASE WHEN len(names) = 1 THEN 'the other participant' ELSE names[2] END AS b FROM l"""
)
def speaker_order(spark, folder):
    rows = layers.speakers_in_order(messages(spark, folder), "corpus_id", "role", "session_no", "msg_no")
    pair = R.speaker_pair(F.col("speakers"))
    return rows.select("corpus_id", F.array_join("speakers", "|").alias("speakers"), R.speakers_phrase(F.col("speakers")).alias("phrase"), pair["a"].alias("a"), pair["b"].alias("b"))


@query(
    """WITH c AS (SELECT conv_id // 20 AS corpus_id, role, count(*) AS n, min(conv_id * 1000000 + turn) AS seen FROM conversations GROUP BY ALL)
SELECT corpus_id, string_agg(role || ':' || n, ' ' ORDER BY n DESC, seen) AS roles FROM c GROUP BY corpus_id"""
)
def role_ranking(spark, folder):
    rows = layers.roles_by_count(messages(spark, folder), "corpus_id", "role", "session_no", "msg_no")
    return rows.select("corpus_id", F.array_join(F.transform("roles", lambda r: F.concat_ws(":", r["role"], r["n"].cast("string"))), " ").alias("roles"))


@query(
    """WITH s AS (SELECT conv_id // 20 AS corpus_id, conv_id, min_by(text, turn) AS t FROM conversations GROUP BY ALL)
SELECT corpus_id, md5('The material is split into these sessions (each has a summary in summem.jsonl):' || string_agg(chr(10) || '  session_' || conv_id || '  (' || left(t, 9) || ')', '' ORDER BY conv_id)) AS md5 FROM s GROUP BY corpus_id"""
)
def session_index(spark, folder):
    rows = messages(spark, folder).groupBy("corpus_id", "session_no").agg(F.substring(F.min_by("text", "msg_no"), 1, 9).alias("time"))
    return layers.session_index(rows, "corpus_id", "session_no", "time").select("corpus_id", F.md5("shown").alias("md5"))


def _questions(spark, folder) -> DataFrame:
    rows = table(spark, folder, "documents")
    return rows.select((F.col("doc_id") % 7).alias("dir"), F.expr("doc_id div 7").alias("qa_index"), F.when(F.col("doc_id") % 5 != 0, F.col("source")).otherwise(" ").alias("question"), (F.col("doc_id") % 6 + 1).alias("category"))


_QUESTIONS = "q AS (SELECT doc_id % 7 AS dir, doc_id // 7 AS qa_index, doc_id % 5 <> 0 AS asked, doc_id % 6 + 1 AS category FROM documents)"


@query(
    f"""WITH {_QUESTIONS}, f AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY qa_index) AS r FROM q),
u AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY qa_index) AS k FROM f WHERE r <= 12 AND asked AND category <> 5)
SELECT 'budget' AS how, dir, qa_index FROM u WHERE k <= 5 UNION ALL SELECT 'named', dir, qa_index FROM q WHERE qa_index IN (1, 3, 99999) AND asked AND category <> 5 UNION ALL SELECT 'all', dir, qa_index FROM q WHERE asked"""
)
def question_selection(spark, folder):
    rows, args = _questions(spark, folder), ("dir", "qa_index", "question", "category")
    picks = {
        "budget": dataset.select_questions(rows, *args, first=12, total_steps=150),
        "named": dataset.select_questions(rows, *args, wanted=dataset.parse_indices("1, 3 99999"), first=1, total_steps=1),
        "all": dataset.select_questions(rows, *args, skip_adversarial=False),
    }
    parts = [picked.select(F.lit(how).alias("how"), "dir", "qa_index") for how, picked in picks.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {_QUESTIONS} SELECT q.dir, q.qa_index, CASE WHEN q.qa_index % 2 = 0 THEN 1 ELSE 0 END AS n_evidence, q.asked AND q.qa_index % 3 = 0 AS known FROM q")
def answer_jobs(spark, folder):
    rows = _questions(spark, folder)
    searched = rows.select("dir", "qa_index", F.when(F.col("qa_index") % 2 == 0, F.array("dir")).alias("evidence"))
    jobs = dataset.answer_jobs(searched, rows.where((F.trim("question") != "") & (F.col("qa_index") % 3 == 0)).select("dir", "qa_index", "question"), "dir", "qa_index", "evidence")
    return jobs.select("dir", "qa_index", F.size("evidence").alias("n_evidence"), F.col("question").isNotNull().alias("known"))


@query("SELECT conv_id // 20 AS sample, conv_id % 20 AS session_no, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS msg_no, coalesce(role, 'unknown') AS speaker, md5(coalesce(text, '')) AS md5 FROM conversations")
def dataset_messages(spark, folder):
    """Samples as maps of session keys to messages, flattened again; other keys are none."""
    rows = table(spark, folder, "conversations").withColumn("sample", F.expr("conv_id div 20"))
    session = rows.groupBy("sample", "conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("speaker"), "text"))), lambda m: F.struct(m["speaker"].alias("speaker"), m["text"].alias("text"))).alias("m"))
    keyed = session.select("sample", F.concat(F.lit("session_"), (F.col("conv_id") % 20).cast("string")).alias("k"), "m")
    others = keyed.select("sample", F.concat("k", F.lit("_date_time")).alias("k"), "m")
    samples = keyed.unionByName(others).groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct("k", "m"))).alias("conversation"))
    flat = dataset.flat_messages(dataset.sessions(samples, "sample", "conversation"), "sample")
    return flat.select("sample", "session_no", "msg_no", "speaker", F.md5("text").alias("md5"))


def _steps(spark, folder) -> DataFrame:
    return table(spark, folder, "events").select("user_id", "event_id", "event_type", (F.col("event_id") % 3).alias("state"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type, event_id % 3 ORDER BY event_id) AS hits FROM events")
def repeat_hits(spark, folder):
    return runs.repeat_hits(_steps(spark, folder), "user_id", "event_id", "event_type", "state").select("event_id", "hits")


@query(
    """WITH m AS (SELECT conv_id, turn + 1 AS n FROM conversations)
SELECT conv_id AS session_no, n AS msg_no, CASE WHEN n % 5 = 0 AND (n - 1) % 5 = 0 THEN NULL WHEN n = 1 THEN true WHEN n % 5 = 0 THEN true WHEN n % 5 = 1 THEN true ELSE n % 5 = 4 END AS advanced FROM m"""
)
def step_progress(spark, folder):
    """Evidence that is stated again, reworded and added to in turn."""
    rows = messages(spark, folder).select("session_no", "msg_no")
    case = F.col("msg_no") % 5
    one, again, other = F.lit("Melina praises the warm garden parties there"), F.lit("Melina values the warm garden parties very much"), F.lit("Oskar bought seven wooden boats")
    facts = F.when(case == 0, F.array().cast("array<string>")).when(case == 1, F.array(one)).when(case == 2, F.array(again)).when(case == 3, F.array(one)).otherwise(F.array(again, other))
    states = rows.select("session_no", "msg_no", facts.alias("facts"), F.array(F.lit("s1")).alias("sources"))
    return runs.step_progress(states, "session_no", "msg_no", "sources", "facts").select("session_no", "msg_no", "advanced")


@query("SELECT event_id, event_id % 4 = 0 OR event_id % 4 = 2 AS writes FROM events")
def mutation_commands(spark, folder):
    case = F.col("event_id") % 4
    tool = F.when(case == 0, "edit").when(case == 3, "read").otherwise("bash")
    command = F.when(case == 1, "grep x inputs.jsonl | head").when(case == 2, "sort -u a | tee b").otherwise("echo > x")
    return table(spark, folder, "events").select("event_id", runs.is_mutation(tool, command).alias("writes"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'context_length' WHEN 1 THEN 'content_filter' WHEN 2 THEN 'permanent' WHEN 5 THEN 'context_length' ELSE 'transient' END AS class FROM events")
def error_classes(spark, folder):
    case = F.col("event_id") % 6
    status = F.when(case == 0, 400).when(case == 1, 403).when(case == 2, 404).when(case == 3, 500)
    message = F.when(case == 0, "Maximum context length is 8192").when(case == 1, "The response was filtered").when(case == 2, "no such model").when(case == 5, "too many tokens").otherwise("token limit service down" if False else "connection reset")
    return table(spark, folder, "events").select("event_id", S.error_class(status, message).alias("class"))


@query(
    """WITH i AS (SELECT doc_id % 4 + 1 AS category, doc_id % 9 = 0 AS skipped, quality, toxic, doc_id FROM labels), c AS (SELECT unnest([1, 2, 3, 4, 5]) AS category, unnest(['multi_hop', 'temporal', 'open_domain', 'single_hop', 'adversarial_skip']) AS name)
SELECT CAST(c.category AS INTEGER) AS category, name, count(doc_id) AS n, count(doc_id) FILTER (WHERE NOT skipped) AS n_scored, coalesce(round(avg(CAST(quality = 1 AS DOUBLE)) FILTER (WHERE NOT skipped), 6), 0) AS accuracy,
  coalesce(round(avg(CASE WHEN doc_id % 2 = 0 THEN CAST(toxic AS DOUBLE) ELSE 0 END) FILTER (WHERE NOT skipped), 6), 0) AS exact_match, coalesce(round(avg(doc_id % 11 / 10.0) FILTER (WHERE NOT skipped), 6), 0) AS token_f1, 0.0::DOUBLE AS evidence_recall
FROM c LEFT JOIN i ON i.category = c.category GROUP BY ALL"""
)
def legacy_summary(spark, folder):
    rows = table(spark, folder, "labels").select(
        (F.col("doc_id") % 4 + 1).alias("category"), (F.col("doc_id") % 9 == 0).alias("skipped"), (F.col("quality") == 1).alias("correct"),
        F.when(F.col("doc_id") % 2 == 0, F.col("toxic").cast("double")).alias("exact_match"), (F.col("doc_id") % 11 / F.lit(10.0)).alias("token_f1"), F.lit(None).cast("double").alias("evidence_recall"),
    )
    out = runs.legacy_summary(rows)
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


@query(
    """SELECT user_id AS dir, count(*) FILTER (WHERE event_id % 7 <> 0) AS qa_done, count(*) FILTER (WHERE event_id % 7 = 0) AS qa_error, count(*) FILTER (WHERE event_type = 'view') AS n_sufficient,
  round(count(*) FILTER (WHERE event_type = 'view') / count(*), 6) AS sufficient_rate, CAST(sum(event_id % 5) AS BIGINT) AS evidence_total, max(event_id % 5) AS evidence_max, CAST(sum(event_id % 16) AS BIGINT) AS steps_total,
  round(sum(event_id % 16) / count(*), 2) AS steps_mean, CAST(sum(event_id % 30) AS BIGINT) AS tool_calls_total, count(*) FILTER (WHERE event_id % 50 = 0) AS n_tampered FROM events GROUP BY user_id"""
)
def directory_summary(spark, folder):
    e = F.col("event_id")
    rows = table(spark, folder, "events").select(
        F.col("user_id").alias("dir"), F.when(e % 7 == 0, "failed").otherwise("").alias("error"), (F.col("event_type") == "view").alias("sufficient"), (e % 5).alias("evidence_count"),
        (e % 16).alias("steps"), (e % 30).alias("tool_calls"), (e % 50 == 0).alias("tampered"),
    )
    return runs.directory_summary(rows, "dir").withColumn("sufficient_rate", F.round("sufficient_rate", 6))


@query("SELECT o_custkey AS id, coalesce(max(CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END), DATE '2030-01-01') AS date_hint FROM orders GROUP BY o_custkey")
def max_date_hint(spark, folder):
    rows = table(spark, folder, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("on 2029-02-30 or "), day, F.lit(" they met"))).otherwise(F.concat(F.lit("about "), F.substring(day, 1, 7)))
    return runs.date_hint(rows.select(F.col("o_custkey").alias("id"), text.alias("text")), "id", "text", today=F.lit("2030-01-01").cast("date"))


@query("SELECT o_custkey AS id, coalesce(max(CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END), DATE '2030-01-01') AS day FROM orders GROUP BY o_custkey")
def conversation_date(spark, folder):
    rows = table(spark, folder, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    time = F.when(F.col("o_orderkey") % 3 == 0, F.concat(day, F.lit("T10:20:30Z"))).when(F.col("o_orderkey") % 3 == 1, day).otherwise("few minutes ago")
    return runs.conversation_date(rows.select(F.col("o_custkey").alias("id"), time.alias("time")), "id", "time", F.lit("2030-01-01").cast("date"))


@query("WITH r AS (SELECT DISTINCT 'run_' || event_type || CASE WHEN length(event_type) % 2 = 0 THEN '_full' ELSE '' END AS name FROM events) SELECT name, name = coalesce((SELECT max(name) FROM r WHERE contains(name, 'full')), (SELECT max(name) FROM r)) AS kept FROM r")
def retention_full(spark, folder):
    name = F.concat(F.lit("run_"), F.col("event_type"), F.when(F.length("event_type") % 2 == 0, "_full").otherwise(""))
    names = table(spark, folder, "events").select(name.alias("name")).distinct()
    return runs.retained_runs(names.unionByName(spark.createDataFrame([(".tmp_full",)], "name string")), "name")


@query("WITH r AS (SELECT DISTINCT lang || '_' || source AS name FROM documents) SELECT name FROM r WHERE name NOT LIKE 'en%'")
def new_runs(spark, folder):
    names = table(spark, folder, "documents").select(F.concat_ws("_", "lang", "source").alias("name")).distinct()
    return runs.new_runs(names, names.where(F.col("name").startswith("en")), "name")


@query(
    """WITH RECURSIVE l AS (SELECT conv_id, text, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS n, sum(length(text)) OVER (PARTITION BY conv_id) AS total FROM conversations),
w AS (SELECT conv_id, back, n, total, length(text) + 1 AS used, 1 AS kept FROM l WHERE back = 1
  UNION ALL SELECT l.conv_id, l.back, l.n, l.total, CASE WHEN w.used + length(l.text) + 1 > 760 THEN w.used ELSE w.used + length(l.text) + 1 END, CASE WHEN w.used + length(l.text) + 1 > 760 THEN w.kept ELSE w.kept + 1 END FROM w JOIN l ON l.conv_id = w.conv_id AND l.back = w.back + 1)
SELECT conv_id AS session_no, CAST(CASE WHEN total / 4 <= 200 THEN n ELSE kept END AS INTEGER) AS n_kept, total / 4 > 200 AND kept < n AS cut FROM w WHERE back = n"""
)
def budget_with_skips(spark, folder):
    rows = messages(spark, folder).withColumn("text", F.coalesce("text", F.lit("")))
    out = runs.budget_with_skips(rows, "session_no", "msg_no", "text", "role", 200)
    return out.select("session_no", F.size("kept").alias("n_kept"), (F.size("dropped_speakers") > 0).alias("cut"))


@query("WITH s AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) SELECT count(*) AS n, count(*) FILTER (WHERE n > 3) AS n_truncated, round(count(*) FILTER (WHERE n > 3) / count(*), 6) AS rate, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(least(n, 3)) AS BIGINT) AS n_kept FROM s")
def truncation_stats(spark, folder):
    rows = messages(spark, folder).groupBy("session_no").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.least("n", F.lit(3)))
    return runs.truncation_stats(rows, "n", "k").withColumn("rate", F.round("rate", 6))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'empty' ELSE '' END || CASE doc_id % 4 WHEN 1 THEN 'time_phrase' WHEN 2 THEN 'several_sentences' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN '|no_id|no_source' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN '|wrong_type' ELSE '' END AS problems FROM documents")
def atom_quality(spark, folder):
    i = F.col("doc_id")
    text = F.when(i % 4 == 0, " ").when(i % 4 == 1, "Anna left yesterday").when(i % 4 == 2, "Anna left. Bob came.").otherwise("Anna left")
    problems = R.quality_problems(text, F.when(i % 3 != 0, "m"), F.when(i % 3 != 0, F.array(F.lit("s"))), F.when(i % 5 != 0, "atom"), X.has_time_phrase(text), X.several_sentences(text))
    # the first problem, then the others behind bars
    first = F.filter(problems, lambda p: p.isin("empty", "time_phrase", "several_sentences"))
    rest = F.array_except(problems, first)
    return table(spark, folder, "documents").select(i.alias("id"), F.concat(F.array_join(first, "|"), F.when(F.size(rest) > 0, F.concat(F.lit("|"), F.array_join(rest, "|"))).otherwise("")).alias("problems"))


@query("SELECT doc_id, CAST(len(string_split(replace(text, chr(13), ''), chr(10))) - 1 AS INTEGER) AS n_breaks, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS INTEGER) AS n_the FROM documents WHERE text IS NOT NULL")
def line_counts(spark, folder):
    rows = table(spark, folder, "documents").where("text is not null")
    return rows.select("doc_id", R.occurrences(R.unix_lines(F.replace("text", F.lit("\n"), F.lit("\r\n"))), "\n").alias("n_breaks"), R.occurrences(F.col("text"), "the").alias("n_the"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang || '_' || source WHEN 1 THEN lang || '_' ELSE lang END AS label, lang AS a, CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END AS b FROM documents")
def directory_labels(spark, folder):
    case = F.col("doc_id") % 3
    label = F.when(case == 0, R.directory_label(F.col("lang"), F.col("source"))).when(case == 1, F.concat("lang", F.lit("_"))).otherwise(F.col("lang"))
    parts = R.label_parts(label)
    return table(spark, folder, "documents").select("doc_id", label.alias("label"), parts["a"].alias("a"), parts["b"].alias("b"))


@query("SELECT CASE conv_id % 3 WHEN 0 THEN 'dialogue' WHEN 1 THEN 'document' ELSE 'plain' END AS family, count(DISTINCT conv_id) AS n_batches, count(DISTINCT conv_id % 10) AS n_users, count(*) AS n_messages FROM conversations GROUP BY 1")
def family_census(spark, folder):
    rows = messages(spark, folder)
    case = F.col("session_no") % 3
    body = F.when(case == 0, F.concat(F.lit("Ada Quill: "), F.col("id"))).when(case == 1, F.concat(F.lit("document: page "), F.col("id"))).otherwise(F.lit("just words"))
    adapted = envelopes.adapt_messages(rows.select("session_no", "msg_no", "role", body.alias("content"), F.lit(0).alias("timestamp")), "session_no", "msg_no")
    return envelopes.family_census(adapted.withColumn("user", F.col("session_no") % 10), "session_no", "user")


@query("SELECT conv_id AS session_no, CASE WHEN turn % 2 = 0 THEN 'ada quill' ELSE 'bo' END AS prefix, count(*) AS n FROM conversations GROUP BY ALL")
def prefix_counts(spark, folder):
    rows = messages(spark, folder)
    body = F.when(F.col("msg_no") % 2 == 1, F.concat(F.lit("[ada_1][session_1] Ada Quill: "), F.col("id"))).otherwise(F.concat(F.lit("Bo: "), F.col("id")))
    return envelopes.prefix_counts(rows.select("session_no", body.alias("content")), "session_no", "content")
