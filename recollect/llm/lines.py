"""Line dedup by log templates: a fixed-depth tree over lines, and templates that recur across documents go.

A line's tokens are its runs of characters other than 0x20 and 0x09-0x0D; a token with a digit is a variable
field from the start. The tree's path to a leaf is the number of tokens and the first tokens. Within a leaf, a
token that fewer than `min_docs` documents have at its place is a variable field as well, if the line has enough
tokens and enough of them stay constant. Lines with equal constants share a template. A template in at least
`min_docs` documents recurs: its first line (smallest document, then place) stays, its others are dropped. A masked
line in at least `exact_docs` documents recurs as well, by itself: its first stays, its others are dropped. With
`spare_own`, a document that would lose every line loses none, unless each of its raw lines stands in an earlier one.

All of it is column expressions, equi-joins and partial aggregates; a template that a third of all lines have is
one row after the map side, and joins on leaves, templates and forms deal frequent keys apart from the others. Lines
are masked once and travel as 128-bit hashes, as text only from leaves with several forms.

Defined results: null text stays null, empty text stays empty, lines without tokens stay; repeats of a line within
one document count as one document; rows with equal id and text are one document and give equal results; a null
id sorts first; further columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, join_by_share, maybe_among

#: Documents that make a template recur; leading tokens in the path; tokens and constant share for generalising.
MIN_DOCS, DEPTH, MIN_TOKENS, CONSTANT = 3, 2, 5, 0.7
#: Documents that make a masked line recur by itself.
EXACT_DOCS = 2
FIELD = "<*>"
GAP = r"[\x20\x09-\x0D]+"


def _plain(line: Column) -> Column:
    """Tokens without digits, single spaces between them: such a line is its own mask.

    Told by what it must not have: one class of characters and three comparisons of bytes cost a fifth of a pattern
    for the whole line.
    """
    return ~(line.rlike(r"[0-9\x09-\x0D]") | line.contains("  ") | line.startswith(" ") | line.endswith(" "))


def masked_line(line: Column) -> Column:
    """Tokens joined by single spaces, those with a digit as FIELD."""
    spaced = F.trim(F.regexp_replace(line, GAP, " "))
    return F.when(_plain(line), line).otherwise(F.regexp_replace(spaced, "[^ 0-9]*+[0-9][^ ]*+", FIELD))


def _n_tokens(masked: Column) -> Column:
    # in bytes, which need no counting
    return F.octet_length(masked) - F.octet_length(F.replace(masked, F.lit(" "), F.lit(""))) + 1


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each line: document, place and masked line; empty where the line has no tokens."""
    rows = docs.select(F.col(key).alias("_doc"), F.xxhash64(text).alias("_body"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("_place", "_line"))
    # a filter on the masked line would compute it twice; this one spares most empty lines
    return rows.where(F.col("_line") != "").withColumn("_mask", masked_line(F.col("_line"))).drop("_line")


def _placed(lines: DataFrame, depth: int) -> DataFrame:
    n = _n_tokens(F.col("_mask"))
    return lines.withColumns({"_n": n, "_a": F.xxhash64("_mask"), "_b": F.xxhash64(F.lit(7), F.col("_mask")), "_leaf": F.xxhash64(n, F.substring_index("_mask", " ", depth))})


#: A line's form, and what a template is known by; _kind is 0 where a form stands for itself, 1 where it is generalised.
_FORM, _TEMPLATE = ["_leaf", "_a", "_b"], ["_leaf", "_kind", "_ta", "_tb"]


def _lost(placed: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """(_doc, _body, _lost): places of each template without its first; one that is generalised needs `least` documents."""
    each = placed.groupBy(*_TEMPLATE, "_doc", "_body").agg(F.min(F.array_min("_places")).alias("_place"))
    first = each.groupBy(*_TEMPLATE).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_doc", "_body", "_place")).alias("_first"))
    first = scratch.table("first", first.where((F.col("_n") >= least) | (F.col("_kind") == 0)))
    own = F.col("_doc").eqNullSafe(F.col("_first._doc")) & (F.col("_body") == F.col("_first._body"))
    joined = join_by_share(placed, first, _TEMPLATE, "_n")
    lost = joined.withColumn("_lost", F.when(own, F.array_except("_places", F.array("_first._place"))).otherwise(F.col("_places")))
    return lost.where(F.size("_lost") > 0).select("_doc", "_body", "_lost")


def _emptied_with_own(docs: DataFrame, key: str, text: str, seen: DataFrame, lost: DataFrame) -> DataFrame:
    """(_doc, _body) of the documents that lose all lines though some raw line of theirs stands in no earlier document."""
    totals = seen.groupBy("_doc", "_body").agg(F.sum(F.size("_places")).alias("_all")).select(F.col("_doc").alias("_of"), F.col("_body").alias("_hash"), "_all")
    emptied = lost.join(totals, F.col("_doc").eqNullSafe(F.col("_of")) & (F.col("_body") == F.col("_hash")))
    emptied = emptied.where(F.size("_dropped") == F.col("_all")).select("_doc", "_body")
    rows = docs.select(F.col(key).alias("_doc"), F.xxhash64(text).alias("_body"), F.explode(F.split(F.col(text), "\n", -1)).alias("_line"))
    rows = rows.where(F.col("_line").rlike(r"[^\x20\x09-\x0D]"))
    raw = rows.select("_doc", "_body", F.xxhash64("_line").alias("_r"), F.xxhash64(F.lit(7), F.col("_line")).alias("_s"))
    # a document has a line of its own if it is the first for some line
    firsts = raw.groupBy("_r", "_s").agg(F.min(F.struct("_doc", "_body")).alias("_first")).select(F.col("_first._doc").alias("_of"), F.col("_first._body").alias("_hash")).distinct()
    return emptied.join(firsts, F.col("_doc").eqNullSafe(F.col("_of")) & (F.col("_body") == F.col("_hash")), "left_semi")


def _general_forms(lines: DataFrame, support: DataFrame, scratch: Scratch, min_docs: int, depth: int, min_tokens: int, constant: float) -> DataFrame:
    """(_leaf, _a, _ta, _tb): the forms that are generalised, and the hashes of what they become."""
    # leaves in which something can be generalised: several forms, and documents enough to hold a token constant
    several = support.where(F.col("_n") >= min_tokens).groupBy("_leaf").agg(F.count(F.lit(1)).alias("_kinds"), F.sum("_docs").alias("_all"))
    several = several.where((F.col("_kinds") > 1) & (F.col("_all") >= min_docs))
    # lines of other leaves do no harm, so a filter of bounded size is enough to spare most lines their shuffle
    texts = maybe_among(lines.where(F.col("_n") >= min_tokens).select(*_FORM, "_mask"), "_leaf", several, "_leaf")
    texts = scratch.table("texts", texts.groupBy(*_FORM).agg(F.first("_mask").alias("_mask")).join(support.select(*_FORM, "_docs"), _FORM))
    # Lines that share a template differ at the same places, at most (1 - constant) of them, none of which leads the
    # line. So of one block more than that, one is equal in all of them; lines without such a block keep to themselves.
    split = texts.withColumn("_tokens", F.split("_mask", " ")).withColumn("_blocks", F.floor(F.size("_tokens") * (1 - constant) + 1e-9).cast("int") + 1)
    rest = F.size("_tokens") - depth
    edge = lambda i: (i * rest / F.col("_blocks")).cast("int") + depth + 1
    block = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda i: F.xxhash64("_leaf", i, F.slice("_tokens", edge(i), edge(i + 1) - edge(i))))
    blocks = split.where(rest > 0).select("_leaf", "_a", "_docs", F.explode(F.array_distinct(block)).alias("_block"))
    blocks = scratch.table("blocks", blocks)
    shared = blocks.groupBy("_block").agg(F.count(F.lit(1)).alias("_lines"), F.sum("_docs").alias("_all")).where((F.col("_lines") > 1) & (F.col("_all") >= min_docs))
    shared = scratch.table("shared", shared.select("_block", "_lines"))
    alike = scratch.table("alike", join_by_share(blocks, shared, ["_block"], "_lines", "left_semi").select("_leaf", "_a").distinct())
    # a token at a place of a leaf is one 64-bit key; all lines of the leaf count, only alike ones are joined back
    in_leaves = maybe_among(texts, "_leaf", alike, "_leaf")
    key = F.xxhash64("_leaf", "_at", "_token")
    exploded = lambda rows, *kept: rows.select("_leaf", *kept, F.posexplode(F.split("_mask", " ")).alias("_at", "_token"))
    common = exploded(in_leaves, "_docs").select(key.alias("_key"), "_docs").groupBy("_key").agg(F.sum("_docs").alias("_held"), F.count(F.lit(1)).alias("_lines"))
    common = scratch.table("common", common.where(F.col("_held") >= min_docs).select("_key", "_lines"))
    own = texts.join(alike, ["_leaf", "_a"], "left_semi").withColumn("_tokens", F.split("_mask", " "))
    tokens = own.select("_leaf", "_a", F.size("_tokens").alias("_size"), F.posexplode("_tokens").alias("_at", "_token"))
    keyed = scratch.table("keyed", tokens.where(F.col("_token") != FIELD).select("_leaf", "_a", "_size", key.alias("_key")))
    # within a leaf, a template is the set of its constants; their hashes without order tell it from others
    seeded = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), F.col("_key")))
    constants = join_by_share(keyed, common, ["_key"], "_lines", "left_semi").groupBy("_leaf", "_a", "_size").agg(F.count(F.lit(1)).alias("_fixed"), seeded(3).alias("_ta"), seeded(5).alias("_tb"))
    return constants.where(F.col("_fixed") / F.col("_size") >= constant).select("_leaf", "_a", "_ta", "_tb")


def recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, constant: float = CONSTANT, exact_docs: int | None = EXACT_DOCS, spare_own: bool = False) -> DataFrame:
    """(_doc, _body, _dropped): for each document that loses lines, their places."""
    scratch = Scratch(docs.sparkSession, "lines")
    # lines are split and masked once; what follows reads this table, mostly only its hashes
    lines = _placed(_lines(docs, key, text), depth)
    lines = scratch.table("lines", lines.withColumn("_empty", F.col("_mask") == "").withColumn("_mask", F.when(F.col("_n") >= min_tokens, F.col("_mask"))), "snappy")
    lines = lines.where("not _empty").drop("_empty")
    # one row for each document and distinct masked line, with all its places
    seen = lines.groupBy("_doc", "_body", "_n", *_FORM).agg(F.collect_list("_place").alias("_places"))
    seen = scratch.table("seen", seen)
    support = scratch.table("support", seen.groupBy("_n", *_FORM).agg(F.count(F.lit(1)).alias("_docs")))
    general = _general_forms(lines, support, scratch, min_docs, depth, min_tokens, constant)
    general = scratch.table("general", support.join(general, ["_leaf", "_a"]).select(*_FORM, "_docs", F.lit(1).alias("_kind"), "_ta", "_tb"))
    scratch.drop("lines", "texts", "blocks", "shared", "alike", "common", "keyed")
    # only templates whose forms have documents enough together have their documents counted
    many = general.groupBy(*_TEMPLATE).agg(F.count(F.lit(1)).alias("_forms"), F.sum("_docs").alias("_most")).where(F.col("_most") >= min_docs).drop("_most")
    least = min(exact_docs or min_docs, min_docs)
    alone = support.where(F.col("_docs") >= least).select(*_FORM, "_docs", F.lit(0).alias("_kind"), F.col("_a").alias("_ta"), F.col("_b").alias("_tb"))
    wanted = scratch.table("wanted", join_by_share(general, many, _TEMPLATE, "_forms", "left_semi").select(*alone.columns).unionByName(alone))
    placed = join_by_share(maybe_among(seen, "_a", wanted, "_a"), wanted, _FORM, "_docs")
    placed = scratch.table("placed", placed.select(*_TEMPLATE, "_doc", "_body", "_places"))
    lost = _lost(placed, min_docs, scratch)
    lost = lost.groupBy("_doc", "_body").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_lost")))).alias("_dropped"))
    if spare_own:
        lost = scratch.table("all-lost", lost)
        spared = _emptied_with_own(docs, key, text, seen, lost).select(F.col("_doc").alias("_of"), F.col("_body").alias("_hash"))
        lost = lost.join(spared, F.col("_doc").eqNullSafe(F.col("_of")) & (F.col("_body") == F.col("_hash")), "left_anti")
    out = scratch.table("lost", lost)
    scratch.drop("seen", "support", "general", "wanted", "placed", "first", "all-lost")
    return out


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """docs with the kept lines as text, and columns n_lines and dropped_lines (places from 0)."""
    n_lines, dropped = fresh(docs, "n_lines", "dropped_lines")
    lost = recurring_lines(docs, key, text, **parameters).withColumnRenamed("_doc", "_of")
    rows = docs.select(F.struct("*").alias("_row"), F.col(key).alias("_doc"), F.xxhash64(text).alias("_hash"))
    joined = rows.join(lost, F.col("_doc").eqNullSafe(F.col("_of")) & (F.col("_hash") == F.col("_body")), "left")
    body = F.col(f"_row.`{text}`")
    # columns of their own: a text is split once, and its lines are picked by place
    split = joined.select("_row", "_dropped", F.split(body, "\n", -1).alias("_parts"))
    split = split.withColumn("_left", F.when(F.col("_dropped").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), F.col("_dropped"))))
    kept = F.when(F.col("_left").isNull(), body).otherwise(F.array_join(F.transform("_left", lambda i: F.get("_parts", i)), "\n"))
    columns = [kept.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return split.select(*columns, F.coalesce(F.when(body.isNotNull(), F.size("_parts")), F.lit(0)).cast("long").alias(n_lines), F.coalesce("_dropped", F.array().cast("array<int>")).alias(dropped))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """For every document: its lines, those dropped, and the hash of what is kept."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", F.size("dropped_lines").cast("long").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP1_SQL = rf"""
WITH split_docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS place FROM split_docs),
masked AS (
  SELECT doc_id, place,
         list_transform(list_filter(regexp_split_to_array(line, '[\x09-\x0D\x20]+'), lambda x: x <> ''),
                        lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{FIELD}' ELSE x END) AS tokens
  FROM lines),
leaves AS (SELECT doc_id, place, tokens, {{'n': len(tokens), 'lead': tokens[1:{DEPTH}]}} AS leaf FROM masked WHERE len(tokens) > 0),
support AS (SELECT leaf, tokens, count(DISTINCT doc_id) AS docs FROM leaves GROUP BY ALL),
spread AS (SELECT leaf, tokens, docs, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM support WHERE len(tokens) >= {MIN_TOKENS}),
held AS (SELECT leaf, pos, token, sum(docs) AS held FROM spread GROUP BY ALL),
general AS (
  SELECT s.leaf, s.tokens, list(CASE WHEN held >= {MIN_DOCS} THEN token ELSE '{FIELD}' END ORDER BY pos) AS template,
         avg(CASE WHEN held >= {MIN_DOCS} AND token <> '{FIELD}' THEN 1.0 ELSE 0.0 END) AS share
  FROM spread s JOIN held h USING (leaf, pos, token) GROUP BY s.leaf, s.tokens),
several AS (SELECT leaf FROM general GROUP BY leaf HAVING count(*) > 1),
placed AS (
  SELECT l.doc_id, l.place, l.leaf, CASE WHEN g.share >= {CONSTANT} AND l.leaf IN (SELECT leaf FROM several) THEN g.template ELSE l.tokens END AS template
  FROM leaves l LEFT JOIN general g ON g.leaf = l.leaf AND g.tokens = l.tokens),
recurring AS (SELECT leaf, template, min({{'d': doc_id, 'p': place}}) AS first_line FROM placed GROUP BY ALL HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
exact AS (SELECT leaf, tokens, min({{'d': doc_id, 'p': place}}) AS first_line FROM leaves GROUP BY ALL HAVING count(DISTINCT doc_id) >= {EXACT_DOCS}),
lost AS (
  SELECT p.doc_id, p.place FROM placed p JOIN recurring r ON r.leaf = p.leaf AND r.template = p.template
  WHERE NOT (p.doc_id = r.first_line.d AND p.place = r.first_line.p)
  UNION SELECT l.doc_id, l.place FROM leaves l JOIN exact x ON x.leaf = l.leaf AND x.tokens = l.tokens
  WHERE NOT (l.doc_id = x.first_line.d AND l.place = x.first_line.p)),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.place) AS text
  FROM lines l LEFT JOIN lost x ON x.doc_id = l.doc_id AND x.place = l.place WHERE x.doc_id IS NULL GROUP BY l.doc_id),
n_lost AS (SELECT doc_id, count(*) AS n FROM lost GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.parts), 0) AS BIGINT) AS n_lines, coalesce(n_lost.n, 0) AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split_docs d LEFT JOIN kept USING (doc_id) LEFT JOIN n_lost USING (doc_id)
"""
