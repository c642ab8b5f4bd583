"""What a model replied, read as column expressions: answers, judgements, verdicts, summaries and embedded JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What may stand around a reply, the tags of older prompts, and names that a field may have.
FENCE = r"^```[a-zA-Z]*\s*|\s*```$"
LABELLED_FENCE = r"^```[a-zA-Z0-9_-]*\s*|\s*```$"
ANSWER_TAG, JUDGEMENT_TAG, REASON_TAG = r"(?is)<answer>\s*(.*?)\s*</answer>", r"(?i)<judgement>\s*(CORRECT|INCORRECT)\s*</judgement>", r"(?is)<reason>\s*(.+?)\s*</reason>"
ANSWER_NAMES, REASONING_NAMES = ("answer", "prediction", "final_answer"), ("reasoning", "reason", "explanation")
LABEL_NAMES, REASON_NAMES = ("label", "judgement", "judgment"), ("reason", "explanation")
SUMMARY_NAMES = ("memory", "summary", "text", "content")
NO_ANSWER = "(no answer provided)"
NOT_SUPPORTED = " (model marked this answer as unsupported by the memories)"


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


END = "\u0001end"


def strict_json(c: Column) -> Column:
    """The text itself if all of it is one JSON value, else null.

    The parser reads one value and ignores what follows, so the text is read as the first of two items of an array.
    """
    both = F.try_parse_json(F.concat(F.lit("["), c, F.lit(',"\\u0001end"]')))
    return F.when((F.try_variant_get(both, "$[1]", "string") == END) & F.try_variant_get(both, "$[0]", "variant").isNotNull(), c)


def json_object(c: Column) -> Column:
    """The text itself if it is one JSON object, else null."""
    return F.when(c.startswith("{") & c.endswith("}"), strict_json(c))


def outermost(c: Column, opening: str = r"\{", closing: str = r"\}") -> Column:
    """From the first opening to the last closing bracket; empty if there is none."""
    return F.regexp_extract(c, rf"(?s)({opening}.*{closing})", 1)


def reply_object(c: Column, fence: str = FENCE) -> Column:
    """The object that a reply is, holds in a code fence, or holds between its outermost braces; null if none."""
    body = stripped(F.coalesce(c, F.lit("")))
    return F.coalesce(json_object(body), json_object(stripped(F.regexp_replace(body, fence, ""))), json_object(outermost(body)))


def kind_of(obj: Column, name: str) -> Column:
    """The JSON type of a field (STRING, BOOLEAN, VOID for null, ...); null if the object lacks it."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(obj), f"$.{name}", "variant"))


def first_present(obj: Column, names: tuple[str, ...], make) -> Column:
    """make(name) of the first of the names that the object has."""
    keys = F.json_object_keys(obj)
    out = F.when(F.lit(False), make(names[0]))
    for name in names:
        out = out.when(F.array_contains(keys, name), make(name))
    return out


def text_of(obj: Column, name: str) -> Column:
    """A field as text: strings as they are, other values as JSON, null as "null"."""
    return F.coalesce(F.get_json_object(obj, f"$.{name}"), F.lit("null"))


def parsed_answer(reply: Column) -> Column:
    """(answer, unsupported, reasoning, error) of a reply: JSON, else an answer tag, else the text without its fence.

    An explicit `unsupported` holds; where it is missing, a reply without an answer is unsupported.
    """
    raw = F.coalesce(reply, F.lit(""))
    obj = reply_object(raw)
    said = F.nullif(stripped(first_present(obj, ANSWER_NAMES, lambda n: F.get_json_object(obj, f"$.{n}"))), F.lit(""))
    explicit = F.when(kind_of(obj, "unsupported") == "BOOLEAN", F.get_json_object(obj, "$.unsupported") == "true")
    reasoning = F.coalesce(stripped(first_present(obj, REASONING_NAMES, lambda n: text_of(obj, n))), F.lit(""))
    tagged = F.nullif(F.regexp_extract(raw, ANSWER_TAG, 1), F.lit(""))
    plain = F.nullif(stripped(F.regexp_replace(stripped(F.regexp_replace(stripped(raw), FENCE, "")), "^`+|`+$", "")), F.lit(""))
    empty, has_tag = stripped(raw) == "", raw.rlike(ANSWER_TAG)
    answer = F.when(empty, None).when(obj.isNotNull(), said).when(has_tag, tagged).otherwise(plain)
    unsupported = F.when(empty, True).when(obj.isNotNull(), F.coalesce(explicit, said.isNull())).otherwise(False)
    return F.struct(answer.alias("answer"), unsupported.alias("unsupported"), F.when(obj.isNotNull(), reasoning).otherwise("").alias("reasoning"), F.when(empty, "empty reply").otherwise("").alias("error"))


def parsed_judgement(reply: Column) -> Column:
    """(label, reason): CORRECT or INCORRECT from JSON, else from tags, else from a mention; a null label if there is none."""
    raw = F.coalesce(reply, F.lit(""))
    obj = json_object(stripped(raw))
    named = F.upper(stripped(first_present(obj, LABEL_NAMES, lambda n: F.when(kind_of(obj, n) == "STRING", F.get_json_object(obj, f"$.{n}")))))
    label = F.when(named == "WRONG", "INCORRECT").when(named.isin("CORRECT", "INCORRECT"), named)
    why = F.coalesce(first_present(obj, REASON_NAMES, lambda n: text_of(obj, n)), F.lit(""))
    tag = F.upper(F.regexp_extract(raw, JUDGEMENT_TAG, 1))
    loose = F.when(F.upper(raw).contains("INCORRECT"), "INCORRECT").when(F.upper(raw).contains("CORRECT"), "CORRECT")
    reason = F.when(label.isNotNull(), why).when(tag != "", stripped(F.regexp_extract(raw, REASON_TAG, 1))).when(loose.isNotNull(), stripped(raw))
    return F.struct(F.coalesce(label, F.nullif(tag, F.lit("")), loose).alias("label"), reason.alias("reason"))


def parsed_verdict(reply: Column) -> Column:
    """(sufficient, answer, missing, error) of a verifier's reply; whatever cannot be read is not sufficient."""
    raw = F.coalesce(reply, F.lit(""))
    obj = reply_object(raw)
    readable = kind_of(obj, "sufficient") == "BOOLEAN"
    error = (
        F.when(stripped(raw) == "", "empty verifier reply")
        .when(obj.isNull(), "verifier reply is not a JSON object")
        .when(~F.coalesce(readable, F.lit(False)), "verifier 'sufficient' must be a boolean")
        .otherwise("")
    )
    items = F.from_json(F.when(kind_of(obj, "missing").startswith("ARRAY"), F.get_json_object(obj, "$.missing")), "array<string>")
    one = F.when(kind_of(obj, "missing") == "STRING", F.array(F.get_json_object(obj, "$.missing")))
    missing = F.filter(F.transform(F.coalesce(items, one, F.array().cast("array<string>")), stripped), lambda x: x.isNotNull() & (x != ""))
    good = error == ""
    answer = F.when(good, stripped(F.coalesce(F.get_json_object(obj, "$.answer"), F.lit("")))).otherwise("")
    nothing = F.array().cast("array<string>")
    return F.struct((good & (F.get_json_object(obj, "$.sufficient") == "true")).alias("sufficient"), answer.alias("answer"), F.when(good, missing).otherwise(nothing).alias("missing"), error.alias("error"))


def summary_text(reply: Column) -> Column:
    """The summary that a reply holds as a field, else the reply itself, with white space collapsed; an object without one: empty."""
    raw = F.coalesce(reply, F.lit(""))
    obj = reply_object(raw, LABELLED_FENCE)
    fields = [F.when((kind_of(obj, n) == "STRING") & (stripped(F.get_json_object(obj, f"$.{n}")) != ""), F.get_json_object(obj, f"$.{n}")) for n in SUMMARY_NAMES]
    return stripped(F.regexp_replace(F.when(obj.isNull(), raw).otherwise(F.coalesce(*fields, F.lit(""))), r"\s+", " "))


def rendered_prediction(candidate: Column, unsupported: Column) -> Column:
    """An answer as the judge sees it."""
    shown = F.coalesce(F.nullif(stripped(candidate), F.lit("")), F.lit(NO_ANSWER))
    return F.when(unsupported, F.concat(shown, F.lit(NOT_SUPPORTED))).otherwise(shown)


def looks_like_json(c: Column) -> Column:
    """Whether a text begins and ends like an object or an array."""
    return stripped(F.coalesce(c, F.lit(""))).rlike(r"(?s)^[{\[](.*[}\]])$")


def embedded_payload(c: Column) -> Column:
    """The JSON that follows an introduction: the whole text, else from the first brace or bracket to the end or its last closer."""
    body = stripped(F.coalesce(c, F.lit("")))
    valid = lambda x: F.when(x != "", strict_json(x))
    tails = [F.regexp_extract(body, rf"(?s)({opening}.*)$", 1) for opening in (r"\{", r"\[")]
    cuts = [outermost(body), outermost(body, r"\[", r"\]")]
    return F.coalesce(valid(F.when(looks_like_json(body), body)), valid(tails[0]), valid(cuts[0]), valid(tails[1]), valid(cuts[1]))
