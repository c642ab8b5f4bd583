"""Registered queries over the relational tables, and independent SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..operators import layers, memory, resolve, scoring, store
from ..schema import messages, table
from ..sources import jsonl
from ..streaming import ingest
from .registry import ORACLES, QUERIES, query  # noqa: F401

def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def sql_tokens(c: str) -> str:
    return f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda t: len(t) >= {X.SHORTEST_TOKEN} AND t NOT IN ({quoted(X.STOP_WORDS)}))))"


def sql_proper(c: str) -> str:
    words = f"list_filter(regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-zA-Z]+'))"
    return f"array_to_string(list_sort(list_distinct(list_filter(list_transform({words}, lambda w: lower(w)), lambda w: w NOT IN ({quoted(X.NOT_PROPER)})))), ' ')"


def sql_key(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9 ]+', ' ', 'g'))"


def sql_normal(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


SIGNATURES = f"""
sig AS (
  SELECT doc_id, {sql_tokens("text")} AS tokens, lower(regexp_extract(text, '[A-Z][a-z]+')) AS subject, {sql_proper("text")} AS proper_key FROM documents),
full_sig AS (
  SELECT *, len(list_filter(tokens, lambda t: t IN ({quoted(X.SENTIMENT_VERBS)}))) > 0 AS sentiment,
         list_filter(tokens, lambda t: t NOT IN ({quoted(X.SENTIMENT_VERBS)})) AS core FROM sig)"""


@query(f"WITH {SIGNATURES} SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n_tokens, md5(array_to_string(tokens, ' ')) AS tokens_md5, subject, md5(proper_key) AS proper_md5, sentiment, CAST(len(core) AS INTEGER) AS n_core FROM full_sig")
def fact_signature(spark: SparkSession, folder: str) -> DataFrame:
    rows = resolve.with_signature(table(spark, folder, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"), "subject", F.md5("proper_key").alias("proper_md5"), "sentiment", F.size("core").alias("n_core"))


@query(f"SELECT min(doc_id) AS doc_id, md5(k) AS key_md5, count(*) AS n_merged FROM (SELECT doc_id, CASE WHEN {sql_key('text')} = '' THEN trim(lower(text)) ELSE {sql_key('text')} END AS k FROM documents) GROUP BY k")
def exact_dedup(spark, folder):
    return resolve.exact_dedup(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", F.md5("dedup_key").alias("key_md5"), "n_merged")


@query(
    f"""WITH {SIGNATURES},
class AS (SELECT *, min(doc_id) OVER (PARTITION BY tokens, subject, proper_key) AS class_id FROM full_sig),
rep AS (SELECT * FROM class WHERE doc_id = class_id),
link AS (
  SELECT x.class_id AS a, y.class_id AS b FROM rep x JOIN rep y ON x.proper_key = y.proper_key AND x.class_id <> y.class_id
  WHERE len(x.tokens) > 0 AND len(y.tokens) > 0 AND (x.subject = '' OR y.subject = '' OR x.subject = y.subject)
    AND (len(list_intersect(x.tokens, y.tokens)) >= {X.SAME_JACCARD} * (len(x.tokens) + len(y.tokens) - len(list_intersect(x.tokens, y.tokens)))
         OR (x.sentiment AND y.sentiment AND len(list_intersect(x.core, y.core)) >= {X.SAME_CORE}
             AND len(list_intersect(x.core, y.core)) >= {X.SAME_CORE_SHARE} * (len(x.core) + len(y.core) - len(list_intersect(x.core, y.core))))))
SELECT doc_id, class_id, (SELECT count(*) FROM link WHERE a = class_id) AS n_links FROM class"""
)
def near_dup_links(spark, folder):
    return resolve.near_dups(table(spark, folder, "documents"), "doc_id", "text")


SEARCHED = "idiot|license|ration"


@query(
    f"""SELECT layer, id, CASE layer WHEN 'atom' THEN 1 ELSE 2 END AS layer_rank FROM (
  SELECT 'atom' AS layer, 'doc_' || doc_id AS id, text FROM documents
  UNION ALL SELECT 'msg', 'session_' || conv_id || '_' || (turn + 1), text FROM conversations) WHERE regexp_matches(lower(text), '{SEARCHED}')"""
)
def keyword_search_layers(spark, folder):
    atoms = table(spark, folder, "documents").select(F.lit("atom").alias("layer"), F.format_string("doc_%d", "doc_id").alias("id"), "text")
    both = atoms.unionByName(messages(spark, folder).select(F.lit("msg").alias("layer"), "id", "text"))
    return layers.keyword_search(both, SEARCHED).select("layer", "id", "layer_rank")


@query(
    """WITH t AS (SELECT lang AS key, source AS value, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) <= 20)
SELECT key, value, n, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, value) AS r FROM t) WHERE r <= 3"""
)
def tag_index_topk(spark, folder):
    return layers.top_values(table(spark, folder, "documents").select(F.concat_ws(":", "lang", "source").alias("tag")), "tag")


@query("SELECT conv_id AS session_no, count(*) AS n_messages, min_by(role, turn) AS first_role, md5(min_by(text, turn)) AS first_md5 FROM conversations GROUP BY conv_id")
def session_roster(spark, folder):
    rows = messages(spark, folder)
    return rows.groupBy("session_no").agg(F.count(F.lit(1)).alias("n_messages"), F.min_by("role", "msg_no").alias("first_role"), F.md5(F.min_by("text", "msg_no")).alias("first_md5"))


@query("SELECT conv_id // 20 AS corpus_id, role, count(*) AS n, min(conv_id * 1000000 + turn) AS first_at FROM conversations GROUP BY ALL")
def participants(spark, folder):
    rows = messages(spark, folder)
    return rows.groupBy("corpus_id", "role").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("session_no") * 1000000 + F.col("msg_no") - 1).alias("first_at"))


@query(
    """WITH m AS (SELECT conv_id // 20 AS corpus_id, conv_id AS session_no, turn + 1 AS msg_no, 'session_' || conv_id || '_' || (turn + 1) AS id FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY corpus_id ORDER BY session_no, msg_no) AS pos FROM m)
SELECT x.id, CAST(least(count(y.id), 5) AS INTEGER) AS n_context,
       coalesce(array_to_string(list(y.id ORDER BY y.pos)[-5:], ' '), '') AS context_ids
FROM p x LEFT JOIN p y ON y.corpus_id = x.corpus_id AND y.session_no = x.session_no AND y.pos BETWEEN x.pos - 15 AND x.pos - 1 GROUP BY x.id"""
)
def lookback_context(spark, folder):
    rows = layers.lookback(messages(spark, folder), "corpus_id", ["session_no", "msg_no"], "session_no", ["id"], 5)
    return rows.select("id", F.size("context").alias("n_context"), F.array_join(F.transform("context", lambda x: x["id"]), " ").alias("context_ids"))


@query(
    """SELECT 'session_' || conv_id || '_' || (turn + 1) || '_1' AS id, s AS source_pos, length(text) AS n_chars
FROM conversations, (SELECT unnest([0, 1]) AS s)"""
)
def provenance_hop(spark, folder):
    rows = messages(spark, folder)
    atoms = rows.select(F.concat("id", F.lit("_1")).alias("atom"), F.array(F.col("id"), F.concat("id", F.lit("_7"))).alias("source"))
    hop = layers.provenance(atoms, rows, "atom", "source", "id", "text")
    return hop.select(F.col("atom").alias("id"), "source_pos", F.length("source_text").cast("long").alias("n_chars"))


@query(
    """WITH e AS (SELECT conv_id, list(turn) FILTER (WHERE role = 'user') AS wanted, list(turn) FILTER (WHERE turn % 3 = 0) AS found FROM conversations GROUP BY conv_id)
SELECT conv_id AS session_no, CASE WHEN coalesce(len(wanted), 0) = 0 THEN 1.0 ELSE round(len(list_intersect(wanted, coalesce(found, []))) / len(wanted), 6) END AS recall FROM e"""
)
def provenance_recall(spark, folder):
    rows = messages(spark, folder)
    sets = rows.groupBy("session_no").agg(F.collect_set(F.when(F.col("role") == "user", F.col("id"))).alias("wanted"), F.collect_set(F.when((F.col("msg_no") - 1) % 3 == 0, F.col("id"))).alias("found"))
    return sets.select("session_no", F.round(scoring.evidence_recall(F.col("wanted"), F.col("found")), 6).alias("recall"))


def _answers(spark, folder) -> DataFrame:
    reference = table(spark, folder, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("reference"))
    return reference.join(table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("candidate")), "id")


@query(
    f"""WITH a AS (SELECT item_id AS id, b.text AS reference, d.text AS candidate FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
t AS (SELECT id, list_filter(string_split({sql_normal("reference")}, ' '), lambda x: x <> '') AS r, list_filter(string_split({sql_normal("candidate")}, ' '), lambda x: x <> '') AS c FROM a),
rt AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(r) AS w FROM t) GROUP BY ALL),
ct AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(c) AS w FROM t) GROUP BY ALL),
o AS (SELECT id, sum(least(rt.n, ct.n)) AS s FROM rt JOIN ct USING (id, w) GROUP BY id)
SELECT t.id, CASE WHEN len(r) = 0 OR len(c) = 0 THEN CASE WHEN len(r) = len(c) THEN 1.0 ELSE 0.0 END ELSE round(2.0 * coalesce(s, 0) / (len(r) + len(c)), 6) END AS f1,
       CAST({sql_normal("a.reference")} = {sql_normal("a.candidate")} AS DOUBLE) AS exact
FROM t JOIN a USING (id) LEFT JOIN o USING (id)"""
)
def answer_scores(spark, folder):
    rows = _answers(spark, folder)
    exact = rows.select("id", X.exact_match(F.col("reference"), F.col("candidate")).alias("exact"))
    return scoring.token_f1_by_row(rows, "id", "reference", "candidate").join(exact, "id").select("id", F.round("f1", 6).alias("f1"), "exact")


@query("SELECT doc_id, CAST(floor((length(text) + 3) / 4) AS BIGINT) AS n_tokens FROM documents")
def estimate_tokens(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("n_tokens"))


@query(
    """SELECT doc_id, regexp_matches(lower(text), '\\b(yesterday|today|tomorrow|ago|last|next|past|recent|recently|soon|future|now|currently|presently|before|after|since|until|during)\\b|[0-9]+\\s+(day|week|month|year)s?(\\s+ago)?') AS time_phrase,
       length(text) - length(translate(text, '.!?', '')) > 1 AS several_sentences FROM documents"""
)
def fact_quality(spark, folder):
    rows = table(spark, folder, "documents")
    return rows.select("doc_id", X.has_time_phrase(F.col("text")).alias("time_phrase"), X.several_sentences(F.col("text")).alias("several_sentences"))


PHRASES = [
    "yesterday", "the day before yesterday", "last night", "last Friday", "next Monday", "last week", "next month", "last month", "last year",
    "ten years ago", "3 weeks ago", "two days ago", "this weekend", "recently", "in 1999", "next summer",
]
_ON = "strftime(d, '%-d %B %Y')"
EXPECTED = [
    "strftime(d - 1, '%-d %B %Y')", "strftime(d - 2, '%-d %B %Y')", "strftime(d - 1, '%-d %B %Y')", f"'the Friday before ' || {_ON}",
    "strftime(d + CAST(CASE WHEN (8 - isodow(d)) % 7 = 0 THEN 7 ELSE (8 - isodow(d)) % 7 END AS INTEGER), '%Y-%m-%d')", f"'the week before ' || {_ON}",
    "strftime(date_trunc('month', d) + INTERVAL 1 MONTH, '%B %Y')", "strftime(date_trunc('month', d) - INTERVAL 1 MONTH, '%B %Y')", "CAST(year(d) - 1 AS VARCHAR)",
    "CAST(year(d) - 10 AS VARCHAR)", f"'3 weeks before ' || {_ON}", "strftime(d - 2, '%-d %B %Y')", f"'this weekend (anchor: ' || {_ON} || ')'",
    f"'recently (anchor: ' || {_ON} || ')'", "'in 1999'", f"'the summer after ' || {_ON}",
]


@query("SELECT o_orderkey AS id, CASE o_orderkey % 16 " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(EXPECTED)) + " END AS stored FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def anchored_date_resolve(spark, folder):
    rows = table(spark, folder, "orders")
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("o_orderkey") % 16 + 1).cast("int"))
    anchor = F.concat(F.lit("1:56 pm on "), F.date_format("o_orderdate", "d MMMM, yyyy"))
    return D.with_resolved_time(rows.select(F.col("o_orderkey").alias("id"), phrase.alias("phrase"), anchor.alias("anchor")), F.col("phrase"), F.col("anchor"), "stored").select("id", "stored")


#: Replies that state a date, and the date each states for a shown day d.
STATED = {
    "%s": "d",
    "It was two weeks before %s": "d - 14",
    "a week before %s": "d - 7",
    "the Friday before %s": "d - CAST((isodow(d) + 1) % 7 + 1 AS INTEGER)",
    "three Mondays before %s": "d - CAST((isodow(d) + 5) % 7 + 1 + 14 AS INTEGER)",
    "The weekend before %s": "d - CAST(isodow(d) % 7 + 1 AS INTEGER)",
    "last week (anchor: %s)": "d - 7",
    "next week (anchor: %s)": "d - 7",
    "last Tuesday (anchor: 1:56 pm on %s)": "d - CAST((isodow(d) + 4) % 7 + 1 AS INTEGER)",
    "last month (anchor: %s)": "CAST(date_trunc('month', d) - INTERVAL 1 MONTH AS DATE)",
    "next month (anchor: %s)": "CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS DATE)",
    "last night (anchor: %s)": "d - 1",
    "the day of the move (anchor: %s)": "d",
    "last year (anchor: %s)": "coalesce(TRY_CAST((year(d) - 1) || strftime(d, '-%m-%d') AS DATE), d)",
    "recently (anchor: %s)": "d",
    "nothing is known": "CAST(NULL AS DATE)",
}
#: How the day itself is shown: day first, month first, with an abbreviated month, and as ISO.
SHAPES = ["d MMMM yyyy", "MMMM d, yyyy", "d MMM yyyy", "yyyy-MM-dd"]


def _stated(spark, folder) -> DataFrame:
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"))
    shape = F.expr("cast(id div 16 % 4 as int)")
    shown = F.coalesce(*(F.when(shape == i, F.date_format("d", f)) for i, f in enumerate(SHAPES)))
    text = F.element_at(F.array(*map(F.lit, STATED)), (F.col("id") % len(STATED) + 1).cast("int"))
    return rows.withColumn("said", F.replace(text, F.lit("%s"), shown))


_STATED_SQL = "CASE id % 16 " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(STATED.values())) + " END"


@query(f"SELECT id, {_STATED_SQL} AS day FROM (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d FROM orders)")
def answer_date_resolve(spark, folder):
    return _stated(spark, folder).select("id", D.answer_date(F.col("said")).alias("day"))


@query(f"SELECT id, CASE WHEN id % 16 BETWEEN 1 AND 5 THEN {_STATED_SQL} END AS day FROM (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d FROM orders)")
def relative_before_resolve(spark, folder):
    return _stated(spark, folder).select("id", D.resolve_before(F.col("said")).alias("day"))


@query(
    f"""WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d FROM orders), s AS (SELECT id, d, {_STATED_SQL} AS said FROM o),
v AS (SELECT id, said, d - CAST(isodow(d) % 7 + 1 AS INTEGER) AS weekend, d - 14 AS weeks FROM s)
SELECT id, CASE WHEN id % 3 = 0 THEN '' WHEN said IS NULL THEN 'no date'
  WHEN abs(said - CASE id % 3 WHEN 1 THEN weekend ELSE weeks END) <= CASE id % 3 WHEN 1 THEN 1 ELSE 0 END THEN 'SAME'
  ELSE 'differ by ' || abs(said - CASE id % 3 WHEN 1 THEN weekend ELSE weeks END) END AS verdict FROM v"""
)
def temporal_verdict(spark, folder):
    rows = _stated(spark, folder)
    case, shown = F.col("id") % 3, F.date_format("d", "d MMMM yyyy")
    reference = F.when(case == 0, shown).when(case == 1, F.concat(F.lit("the weekend before "), shown)).otherwise(F.concat(F.lit("two weeks before "), shown))
    return rows.select("id", D.temporal_verdict(reference, F.col("said")).alias("verdict"))


@query("SELECT event_id, round(CASE WHEN value > 10 THEN least(value / 100, 1.0) WHEN value > 1 THEN value / 10 ELSE greatest(value, 0.0) END, 6) AS score FROM events")
def score_rescale(spark, folder):
    return table(spark, folder, "events").select("event_id", F.round(X.rescaled_score(F.col("value")), 6).alias("score"))


@query(
    """SELECT user_id, event_id, CAST(r AS INTEGER) AS rank FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS r FROM events) WHERE r <= 5"""
)
def score_topk(spark, folder):
    order = Window.partitionBy("user_id").orderBy(F.col("value").desc_nulls_last(), "event_id")
    return table(spark, folder, "events").select("user_id", "event_id", F.row_number().over(order).alias("rank")).where("rank <= 5")


def _items(spark, folder) -> DataFrame:
    labels = table(spark, folder, "labels")
    category = F.col("doc_id") % 6 + 1
    return labels.select(
        "doc_id",
        category.alias("category"),
        (category == 5).alias("skipped"),
        (F.col("doc_id") % 7 != 0).alias("judged"),
        (F.col("doc_id") % 7 == 0).alias("judge_error"),
        (F.col("quality") == 1).alias("correct"),
        (F.col("toxic") == 1).alias("unsupported"),
        F.col("quality").cast("double").alias("exact_match"),
        (F.col("doc_id") % 11 / F.lit(10.0)).alias("token_f1"),
        F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 4 / F.lit(4.0)).alias("evidence_recall"),
    )


ITEMS = """items AS (SELECT doc_id, doc_id % 6 + 1 AS category, doc_id % 6 + 1 = 5 AS skipped, doc_id % 7 <> 0 AS judged, doc_id % 7 = 0 AS judge_error, quality = 1 AS correct,
  toxic = 1 AS unsupported, CAST(quality AS DOUBLE) AS em, doc_id % 11 / 10.0 AS f1, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 4 / 4.0 END AS rec FROM labels)"""


@query(
    f"""WITH {ITEMS} SELECT coalesce(category, 0) AS category, CAST(grouping(category) AS INTEGER) AS overall, count(*) AS n, count(*) FILTER (WHERE NOT skipped) AS n_scored, count(*) FILTER (WHERE skipped) AS n_skipped,
  count(*) FILTER (WHERE NOT skipped AND judged) AS n_judged, round(avg(CAST(correct AS DOUBLE)) FILTER (WHERE NOT skipped AND judged), 6) AS accuracy,
  round(avg(em) FILTER (WHERE NOT skipped), 6) AS exact_match, round(avg(f1) FILTER (WHERE NOT skipped), 6) AS token_f1, round(avg(rec) FILTER (WHERE NOT skipped), 6) AS evidence_recall
FROM items GROUP BY ROLLUP (category)"""
)
def eval_summary_rollup(spark, folder):
    out = scoring.summarize(_items(spark, folder), "category").withColumn("category", F.coalesce("category", F.lit(0)))
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


@query(
    f"""WITH {ITEMS} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN skipped OR (judged AND correct) THEN NULL WHEN judge_error THEN 'judge_error' WHEN NOT judged THEN 'unjudged'
  WHEN unsupported THEN 'missing_evidence' ELSE 'wrong_answer' END AS reason FROM items) WHERE reason IS NOT NULL GROUP BY reason"""
)
def failure_breakdown(spark, folder):
    return scoring.failure_breakdown(_items(spark, folder))


@query(
    """SELECT user_id, count(*) AS n_runs, count(DISTINCT event_type) <= 1 AS same_verdict, count(DISTINCT nullif(props, '')) <= 1 AS same_answer FROM events GROUP BY user_id HAVING count(*) >= 2"""
)
def run_agreement(spark, folder):
    return scoring.run_agreement(table(spark, folder, "events"), "user_id", "event_type", "props")


@query(
    """SELECT count(*) FILTER (WHERE toxic > quality) AS improved, count(*) FILTER (WHERE toxic = quality) AS same, count(*) FILTER (WHERE toxic < quality) AS worse,
  count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS both_correct, count(*) FILTER (WHERE quality = 1 AND toxic <> 1) AS only_first,
  count(*) FILTER (WHERE quality <> 1 AND toxic = 1) AS only_second, count(*) FILTER (WHERE quality <> 1 AND toxic <> 1) AS both_wrong FROM labels"""
)
def recall_comparison(spark, folder):
    rows = table(spark, folder, "labels")
    run = lambda c: rows.select("doc_id", F.col(c).alias("recall"), (F.col(c) == 1).alias("correct"))
    return scoring.recall_comparison(run("quality"), run("toxic"), "doc_id")


@query("SELECT user_id, json_extract_string(props, '$.k') AS request_id, min_by(event_id, struct_pack(ts := ts, e := event_id)) AS event_id, count(*) AS n_received FROM events GROUP BY ALL")
def request_dedup(spark, folder):
    rows = table(spark, folder, "events").select("user_id", F.get_json_object("props", "$.k").alias("request_id"), "ts", "event_id")
    return store.first_requests(rows, "user_id", "request_id", "ts", "event_id").drop("ts")


@query(
    """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
s AS (SELECT *, min(pos) OVER (PARTITION BY user_id, event_type) AS first_pos FROM e)
SELECT event_id, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY first_pos) AS INTEGER) AS session_no, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY pos) AS INTEGER) AS msg_no FROM s"""
)
def session_numbering(spark, folder):
    return store.number_sessions(table(spark, folder, "events"), "user_id", "event_type", "ts", "event_id").select("event_id", "session_no", "msg_no")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark, folder):
    return table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels").select("doc_id"), "doc_id", "left_anti")


@query(
    """WITH c AS (SELECT conv_id, turn, sum(floor((length(text) + 3) / 4) + 1) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM conversations)
SELECT conv_id AS session_no, turn + 1 AS msg_no, CAST(used AS BIGINT) AS used FROM c WHERE used <= 400"""
)
def context_budget_suffix(spark, folder):
    rows = layers.budget_suffix(messages(spark, folder), "session_no", "msg_no", X.estimate_tokens(F.col("text")), 400)
    return rows.select("session_no", "msg_no", "used")


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
b AS (SELECT doc_id, n, sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY n) AS upto FROM l)
SELECT doc_id, count(*) AS n_lines, CAST(max(upto) AS BIGINT) AS n_bytes FROM b WHERE n <= 20 AND upto <= 2000 GROUP BY doc_id"""
)
def line_byte_truncate(spark, folder):
    lines = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return layers.truncate_head(lines, "doc_id", "n", "line", 20, 2000).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max("bytes_upto").alias("n_bytes"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type")
def tool_counts(spark, folder):
    return table(spark, folder, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"))


@query(
    """WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events),
r AS (SELECT user_id, event_type, island, count(*) AS n FROM e GROUP BY ALL) SELECT user_id, max(n) AS longest, count(*) AS n_runs FROM r GROUP BY user_id"""
)
def no_progress_islands(spark, folder):
    order = ["ts", "event_id"]
    rows = table(spark, folder, "events")
    island = F.row_number().over(Window.partitionBy("user_id").orderBy(*order)) - F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(*order))
    runs = rows.withColumn("island", island).groupBy("user_id", "event_type", "island").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("user_id").agg(F.max("n").alias("longest"), F.count(F.lit(1)).alias("n_runs"))


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 3")
def retention_keep_last(spark, folder):
    order = Window.partitionBy("event_type").orderBy(F.col("event_id").desc())
    return table(spark, folder, "events").withColumn("r", F.row_number().over(order)).where("r <= 3").select("event_type", "event_id")


def _vectors(spark, folder) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "embeddings")
    return rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), rows


SCORED = """s AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)"""


@query(f"WITH {SCORED} SELECT query_id, vec_id, round(score, 6) AS score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10")
def cosine_topk(spark, folder):
    return layers.cosine_topk(*_vectors(spark, folder), 10).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {SCORED}, r AS (SELECT query_id, vec_id, label % 2 AS side, row_number() OVER (PARTITION BY query_id, label % 2 ORDER BY score DESC, vec_id) AS r FROM s)
SELECT query_id, vec_id, CAST(side AS INTEGER) AS side, CAST(r AS INTEGER) AS rank FROM r WHERE r <= 5"""
)
def interleave_topk(spark, folder):
    queries, rows = _vectors(spark, folder)
    side = lambda i: layers.cosine_topk(queries, rows.where(F.col("label") % 2 == i), 5).select("query_id", "vec_id", "rank")
    return layers.interleave(side(0), side(1)).select("query_id", "vec_id", "side", "rank")


@query(
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'activity:' || source || '|other:' || lang WHEN 1 THEN 'sentiment:' || source WHEN 2 THEN 'other:' || source
  WHEN 3 THEN 'topic:career' ELSE 'relation:' || source || '|topic:x' END AS tags FROM documents"""
)
def tag_normalize(spark, folder):
    case = F.col("doc_id") % 5
    raw = (
        F.when(case == 0, F.concat(F.lit("Hobby: "), F.col("source"), F.lit(",shape:"), F.col("lang")))
        .when(case == 1, F.concat(F.lit("mood:"), F.col("source"), F.lit(" , feeling:"), F.col("source")))
        .when(case == 2, F.concat(F.lit("unheard:"), F.col("source")))
        .when(case == 3, F.lit("Career"))
        .otherwise(F.concat(F.lit("family:"), F.col("source"), F.lit("，topic:x")))
    )
    return table(spark, folder, "documents").select("doc_id", F.array_join(X.normalize_tags(X.tags_of_string(raw)), "|").alias("tags"))


@query("SELECT doc_id, 'mem_' || left(sha1(encode(text || chr(0) || array_to_string(list_sort([source, lang]), chr(0)))), 12) AS id FROM documents")
def memory_id_hash(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.memory_id(F.col("text"), F.array("source", "lang")).alias("id"))


@query("SELECT page_id, left(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), 80) || '_' || left(sha1(url), 8) AS slug FROM pages")
def user_slug(spark, folder):
    return table(spark, folder, "pages").select("page_id", X.user_slug(F.col("url")).alias("slug"))


@query(
    """SELECT event_type, count(*) AS n_lines, count(*) FILTER (WHERE event_id % 10 = 0) AS n_blank, count(*) FILTER (WHERE event_id % 10 = 1) AS n_bad, count(*) FILTER (WHERE event_id % 10 > 1) AS n_records
FROM events GROUP BY event_type"""
)
def json_lines_report(spark, folder):
    line = F.when(F.col("event_id") % 10 == 0, "  ").when(F.col("event_id") % 10 == 1, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    rows = table(spark, folder, "events").select("event_type", line.alias("line"))
    return jsonl.report(rows, "line", "event_type").withColumn("n_lines", F.col("n_records") + F.col("n_bad") + F.col("n_blank"))


@query(
    """SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"""
)
def events_tumbling(spark, folder):
    rows = ingest.tumbling_counts(table(spark, folder, "events"), "ts", "1 hour", "1 hour", "event_type", total="value")
    return rows.select(F.col("window.start").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT conv_id AS session_no, count(*) AS n_uncovered FROM conversations WHERE turn % 4 = 3 GROUP BY conv_id")
def repair_worklist(spark, folder):
    rows = messages(spark, folder)
    return memory.uncovered(rows, rows.where((F.col("msg_no") - 1) % 4 != 3), "session_no", "id")


def _asked(spark, folder) -> tuple[DataFrame, DataFrame]:
    questions = table(spark, folder, "benchmark").select("item_id", "text")
    atoms = table(spark, folder, "documents").select(F.format_string("doc_%d", "doc_id").alias("id"), "text", F.lit(1.5).cast("double").alias("weight"))
    return questions, atoms.unionByName(messages(spark, folder).select("id", "text", F.lit(1.0).cast("double").alias("weight")))


@query(
    f"""WITH q AS (SELECT item_id, unnest({sql_tokens("text")}) AS t FROM benchmark),
r AS (SELECT 'doc_' || doc_id AS id, text, 1.5 AS weight FROM documents UNION ALL SELECT 'session_' || conv_id || '_' || (turn + 1), text, 1.0 FROM conversations),
h AS (SELECT id, weight, unnest({sql_tokens("text")}) AS t FROM r),
i AS (SELECT t, ln((SELECT count(*) FROM r) / count(*)) AS idf FROM h GROUP BY t),
s AS (SELECT item_id, id, round(sum(idf) * any_value(weight), 6) AS score FROM q JOIN i USING (t) JOIN h USING (t) GROUP BY item_id, id)
SELECT item_id, id, score, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS n FROM s) WHERE n <= 5"""
)
def retrieve_evidence(spark, folder):
    return memory.retrieve(*_asked(spark, folder), 5, "item_id", "id", "text", "weight")


@query()
def message_chunking(spark, folder):
    return memory.cut_messages(messages(spark, folder), "id", "text", 120, 30).select("id", "chunk_no", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("md5"))


@query()
def session_packing(spark, folder):
    return memory.pack_sessions(messages(spark, folder), "session_no", "msg_no", "text", 600)


@query(
    """WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])[ \\t\\r\\n\\f\\v]+', '\\1' || chr(1), 'g'), chr(1))) AS sentence FROM documents),
w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(trim(sentence, ' ' || chr(9) || chr(10) || chr(13)), '[ \\t\\r\\n\\f\\v]+'), lambda x: x <> '')[2:]) AS word FROM s),
e AS (SELECT DISTINCT doc_id, lower(regexp_replace(word, '^[^A-Za-z]+|[^A-Za-z]+$', '', 'g')) AS entity FROM w WHERE regexp_full_match(regexp_replace(word, '^[^A-Za-z]+|[^A-Za-z]+$', '', 'g'), '[A-Z][a-zA-Z]{2,}')),
v AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+')) AS entity FROM conversations),
c AS (SELECT conv_id AS doc_id, lower(string_agg(text, ' ')) AS cited FROM conversations GROUP BY conv_id)
SELECT e.doc_id, entity FROM e LEFT JOIN c USING (doc_id) WHERE NOT coalesce(contains(cited, entity), false) AND entity NOT IN (SELECT entity FROM v)"""
)
def entity_audit(spark, folder):
    facts = table(spark, folder, "documents").select("doc_id", "text")
    turns = table(spark, folder, "conversations")
    words = turns.select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    # a document cites the conversation of its number
    return memory.unsupported_entities(facts, turns.select(F.col("conv_id").alias("doc_id"), F.col("text").alias("source_text")), words, "doc_id", "text")


@query(
    """WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT id, strftime(d, '%-d %B %Y') AS said, strftime(d - CASE id % 5 WHEN 0 THEN 1 ELSE 2 END, '%-d %B %Y') AS corrected FROM o WHERE id % 5 IN (0, 1)"""
)
def copied_anchor_audit(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"))
    case = F.col("id") % 5
    message = F.when(case == 0, "I came back yesterday").when(case == 1, "It was two days ago").when(case == 2, "Yesterday it rained").otherwise("It is fine")
    said = F.when(case == 2, F.date_sub("d", 1)).otherwise(F.col("d"))
    body = F.concat(F.lit("It happened on "), F.date_format(said, D.SHOWN))
    anchor = F.concat(F.lit("1:56 pm on "), F.date_format("d", "d MMMM, yyyy"))
    found = D.with_copied_anchor(rows.select("id", body.alias("body"), message.alias("message"), anchor.alias("anchor")), "body", "message", "anchor", "x")
    return found.where("x is not null").select("id", "x.said", "x.corrected")
