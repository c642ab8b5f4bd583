"""Accessors of memory records, evidence markers, and how records are shown in prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text_or_empty

# Fields that may hold a record's text, in order; for messages, and for evidence.
MEMORY_TEXT, MESSAGE_TEXT = ("memory", "text", "content"), ("content", "memory", "text")
MEMORY_TYPES = ("msg", "summary", "atom")
# What prompts say where there is nothing to show.
NO_MEMORIES, NO_RECORDS, NOBODY = "(no memories provided)", "(no records were provided)", "a user and an assistant (the protocol did not name them)"
DEFAULT_PAIR, OTHER_PARTY = ("user", "assistant"), "the other participant"


def _string_at(record: Column, path: str) -> Column:
    """The field of a JSON record if it is a string, else null."""
    value = F.try_variant_get(F.try_parse_json(record), path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.get_json_object(record, path))


def memory_id(record: Column) -> Column:
    return F.coalesce(_string_at(record, "$.metadata.id"), F.lit(""))


def message_id(record: Column) -> Column:
    """msg_id, else the id of the metadata."""
    return F.coalesce(F.nullif(_string_at(record, "$.msg_id"), F.lit("")), memory_id(record))


def memory_type(record: Column) -> Column:
    kind = _string_at(record, "$.metadata.type")
    return F.when(kind.isin(*MEMORY_TYPES), kind).otherwise("")


def memory_role(record: Column) -> Column:
    return F.coalesce(_string_at(record, "$.metadata.role"), F.lit(""))


def memory_time(record: Column) -> Column:
    return F.coalesce(_string_at(record, "$.metadata.time"), F.lit(""))


def message_time(record: Column) -> Column:
    return F.coalesce(_string_at(record, "$.time"), memory_time(record))


def record_text(record: Column, names: tuple[str, ...] = MEMORY_TEXT) -> Column:
    """The first of the fields that is a string; empty if none is."""
    return F.coalesce(*(_string_at(record, f"$.{n}") for n in names), F.lit(""))


def reference_answer(qa: Column) -> Column:
    """answer, or adversarial_answer where a question has only that; an error where it has neither."""
    keys = F.json_object_keys(qa)
    return (
        F.when(F.array_contains(keys, "answer"), F.get_json_object(qa, "$.answer"))
        .when(F.array_contains(keys, "adversarial_answer"), F.get_json_object(qa, "$.adversarial_answer"))
        .otherwise(F.raise_error(F.lit("QA item has neither answer nor adversarial_answer")))
    )


def _message_id_of(session: Column, message: Column) -> Column:
    return F.concat(F.lit("session_"), session.try_cast("int").cast("string"), F.lit("_"), message.try_cast("int").cast("string"))


def marked_ids(markers: Column) -> Column:
    """Message ids of evidence markers such as "D1:3" or "D9:1 D4:4"; "D:11:26" has lost its letter's number; sorted."""
    tokens = F.filter(F.flatten(F.transform(F.filter(markers, lambda m: m.isNotNull()), lambda m: F.split(m, r"\s+"))), lambda t: t != "")

    def one(token: Column) -> Column:
        two, three = r"^D?\s*([+-]?[0-9]+):([+-]?[0-9]+)$", r"^D?:([+-]?[0-9]+):([+-]?[0-9]+)$"
        pattern = lambda p: _message_id_of(F.regexp_extract(token, p, 1), F.regexp_extract(token, p, 2))
        return F.when(token.rlike(two), pattern(two)).when(token.rlike(three), pattern(three))

    return F.array_sort(F.array_distinct(F.filter(F.transform(tokens, one), lambda i: i.isNotNull())))


def marked_ids_one_each(markers: Column) -> Column:
    """As marked_ids, in the older way: a marker for each item, with two parts."""
    pattern = r"^D?\s*([0-9]+)\s*:\s*([0-9]+)\s*$"
    one = lambda m: F.when(m.rlike(pattern), _message_id_of(F.regexp_extract(m, pattern, 1), F.regexp_extract(m, pattern, 2)))
    return F.array_sort(F.array_distinct(F.filter(F.transform(markers, one), lambda i: i.isNotNull())))


def message_line(record_id: Column, time: Column, role: Column, text: Column) -> Column:
    """[id] (time) role: text, as a summary's prompt shows a message."""
    stamp = F.when(text_or_empty(time) == "", "").otherwise(F.concat(F.lit(" ("), time, F.lit(")")))
    return F.concat(F.lit("["), text_or_empty(record_id), F.lit("]"), stamp, F.lit(" "), F.coalesce(F.nullif(role, F.lit("")), F.lit("unknown")), F.lit(": "), text_or_empty(text))


def _cited(source: Column, before: str, after: str) -> Column:
    shown = F.array_join(source, ", ")
    return F.when(F.coalesce(shown, F.lit("")) == "", "").otherwise(F.concat(F.lit(before), shown, F.lit(after)))


def evidence_line(time: Column, text: Column, source: Column) -> Column:
    """[time] text  (from: ids), as the answer's prompt shows evidence."""
    when = F.trim(text_or_empty(time))
    return F.concat(F.when(when == "", "").otherwise(F.concat(F.lit("["), when, F.lit("] "))), text_or_empty(text), _cited(source, "  (from: ", ")"))


def verifier_line(record_id: Column, source: Column, text: Column, most: int = 600) -> Column:
    """[id] source=[ids] and the text, cut at `most` characters, as the verifier's prompt shows evidence."""
    body = text_or_empty(text)
    cut = F.when(F.length(body) > most, F.concat(F.substring(body, 1, most), F.lit("…"))).otherwise(body)
    return F.concat(F.lit("["), text_or_empty(record_id), F.lit("]"), _cited(source, " source=[", "]"), F.lit("\n  "), cut)


def speakers_phrase(names: Column, most: int = 24) -> Column:
    """Who takes part, in words."""
    known = F.filter(names, lambda n: n.isNotNull() & (n != ""))
    n = F.size(known)
    all_but_last = F.array_join(F.slice(known, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return (
        F.when(F.coalesce(n, F.lit(0)) <= 0, NOBODY)
        .when(n == 1, known[0])
        .when(n <= most, F.concat(all_but_last, F.lit(" and "), F.element_at(known, -1)))
        .otherwise(F.concat(F.array_join(F.slice(known, 1, most), ", "), F.lit(", ... ("), n.cast("string"), F.lit(" distinct speakers in this session)")))
    )


def speaker_pair(names: Column) -> Column:
    """The first two names; protocol names or the other participant where there are fewer."""
    n = F.coalesce(F.size(names), F.lit(0))
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    return F.when(n <= 0, pair(*map(F.lit, DEFAULT_PAIR))).when(n == 1, pair(names[0], F.lit(OTHER_PARTY))).otherwise(pair(names[0], names[1]))


def directory_label(a: Column, b: Column) -> Column:
    return F.concat_ws("_", a, b)


def label_parts(label: Column) -> Column:
    """The two names of a label: what stands before and after its first underscore."""
    return F.struct(F.substring_index(label, "_", 1).alias("a"), F.when(F.instr(label, "_") > 0, F.regexp_replace(label, "^[^_]*_", "")).otherwise("").alias("b"))


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def occurrences(c: Column, part: str) -> Column:
    """How often a part stands in a text without overlap."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


def quality_problems(text: Column, record_id: Column, source: Column, kind: Column, time_phrase: Column, several: Column) -> Column:
    """Names of the checks that an atom fails."""
    return F.array_compact(
        F.array(
            F.when(F.trim(text_or_empty(text)) == "", "empty"),
            F.when(time_phrase, "time_phrase"),
            F.when(several, "several_sentences"),
            F.when(text_or_empty(record_id) == "", "no_id"),
            F.when(F.coalesce(F.size(source), F.lit(0)) <= 0, "no_source"),
            F.when(F.coalesce(kind, F.lit("")) != "atom", "wrong_type"),
        )
    )
