"""Edits of text files and evidence: exact replacements, appends that add something, normalised rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import unix_lines
from ..sources import jsonl
from . import resolve


def with_edits(files: DataFrame, edits: DataFrame, key: str, text: str, edit_no: str = "edit_no", old: str = "old", new: str = "new") -> DataFrame:
    """(key, text, error): each file with all of its edits applied, or unchanged with the reason.

    edits: (key, edit_no, old, new), a handful for each file. An old text must stand exactly once, edits must not
    overlap, and together they must change something.
    """
    body = unix_lines(F.coalesce(F.col(text), F.lit("")))
    each = F.array_sort(F.collect_list(F.struct(F.col(edit_no).alias("no"), unix_lines(F.col(old)).alias("old"), unix_lines(F.col(new)).alias("new"))))
    rows = files.select(key, body.alias("_body")).join(edits.groupBy(key).agg(each.alias("_edits")), key, "left")
    place = lambda e: F.position(e["old"], F.col("_body"))
    rest = lambda e: F.substring(F.col("_body"), place(e) + 1, F.length("_body"))
    problem = lambda e: (
        F.when(e["old"] == "", F.concat(F.lit("empty old text in edit "), e["no"].cast("string")))
        .when(place(e) == 0, F.concat(F.lit("no match of edit "), e["no"].cast("string")))
        .when(F.position(e["old"], rest(e)) > 0, F.concat(F.lit("several matches of edit "), e["no"].cast("string")))
    )
    spans = F.array_sort(F.transform("_edits", lambda e: F.struct(place(e).alias("at"), (place(e) + F.length(e["old"])).alias("end"), e["new"].alias("new"))))
    rows = rows.withColumns({"_problem": F.get(F.filter(F.transform("_edits", problem), lambda p: p.isNotNull()), F.lit(0)), "_spans": spans})
    overlap = F.exists(F.sequence(F.lit(1), F.size("_spans")), lambda i: F.get("_spans", i)["at"] < F.get("_spans", i - 1)["end"])
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda acc, s: F.struct(F.concat(acc["out"], F.substring(F.col("_body"), acc["at"], s["at"] - acc["at"]), s["new"]).alias("out"), s["end"].alias("at"))
    made = F.aggregate("_spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("_body"), acc["at"], F.length("_body"))))
    rows = rows.withColumn("_made", made)
    error = (
        F.when(F.coalesce(F.size("_edits"), F.lit(0)) <= 0, "")
        .when(F.col("_problem").isNotNull(), F.col("_problem"))
        .when((F.size("_spans") > 1) & overlap, "edits overlap")
        .when(F.col("_made") == F.col("_body"), "nothing changed")
        .otherwise("")
    )
    return rows.select(key, F.when((error == "") & (F.coalesce(F.size("_edits"), F.lit(0)) > 0), F.col("_made")).otherwise(F.col("_body")).alias(text), error.alias("error"))


def appended(stored: DataFrame, incoming: DataFrame, key: str, text: str, sources: str) -> DataFrame:
    """stored with the incoming records that say something new, or something known from a new source; empty ones never."""
    worth = incoming.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    return stored.unionByName(resolve.not_yet_known(worth, stored, key, text, sources).select(*stored.columns))


def write_normalized(validated: DataFrame, folder: str, version: str, status: str = "status") -> str | None:
    """Writes the valid rows as a version, and the rejected ones beside it; nothing where no row was rejected or repaired."""
    if validated.where(F.col(status) != "valid").isEmpty():
        return None
    jsonl.write_version(validated.where(F.col(status) == "rejected"), f"{folder}/rejected", version)
    return jsonl.write_version(validated.where(F.col(status) != "rejected"), folder, version)


def write_summary(summary: DataFrame, folder: str, version: str) -> str:
    """A run's metrics as one JSON file of a version."""
    return jsonl.write_version(summary.coalesce(1), folder, version)


def guarded_rewrite(replayed: DataFrame, stored: DataFrame, user: str, folder: str, version: str) -> str:
    """Writes a replay as a new version, beside the old ones; refuses where a user would lose rows."""
    from . import store

    lost = store.shrinks(replayed, stored, user).limit(5).collect()
    if lost:
        raise ValueError(f"the replay has fewer rows than the store: {[tuple(r) for r in lost]}")
    return jsonl.write_version(replayed, folder, version)


def part_text(part: Column) -> Column:
    """The text of one part of a message's content, as JSON: text, a plain string, or a mark for an image."""
    at = lambda path: F.try_variant_get(F.try_parse_json(part), path, "variant")
    string = lambda path: F.when(F.schema_of_variant(at(path)) == "STRING", F.try_variant_get(F.try_parse_json(part), path, "string"))
    kind = F.lower(F.coalesce(string("$.type"), F.lit("")))
    filled = lambda c: F.nullif(c, F.lit(""))
    paths = ("$.image_url.url", "$.image_url", "$.url", "$.file_name", "$.filename", "$.path", "$.name", "$.source.url", "$.source.data", "$.source")
    size = F.when(string("$.data").isNotNull(), F.concat(F.lit("<"), F.length(string("$.data")).cast("string"), F.lit(" bytes>")))
    ref = F.coalesce(*(filled(string(p)) for p in paths), size)
    image = F.when(ref.isNotNull(), F.concat(F.lit("[image: "), ref, F.lit("]"))).when(kind.startswith("image"), "[image]").otherwise("")
    return F.when(F.schema_of_variant(at("$")) == "STRING", string("$")).otherwise(F.coalesce(string("$.text"), image))


def content_text(content: Column) -> Column:
    """A message's content as text: a string as it is, a JSON array of parts joined by line breaks, empty parts left out."""
    parts = F.transform(F.from_json(content, "array<variant>"), lambda v: part_text(F.to_json(v)))
    listed = F.array_join(F.filter(parts, lambda t: F.coalesce(t, F.lit("")) != ""), "\n")
    return F.when(content.startswith("["), F.coalesce(listed, content)).otherwise(F.coalesce(content, F.lit("")))
