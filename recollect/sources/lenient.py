"""JSON that models wrote: files in three tiers of leniency, syntax repair, tool calls and arrays of atoms.

Whole files are read as one text each; only files without a single good line go through the later tiers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.memory import salvaged

# Repairs of punctuation, in order.
REPAIRS = [(r"}\s*\{", "},{"), (r"\]\s*\[", "],["), (r"}\s*\]\s*\]}\s*$", "}}]}"), (r"\]\s*\]\s*}", "]}"), (r",\s*([}\]])", r"\1")]
# Names of a call's arguments, and the tag that may hold a call.
ARGUMENT_NAMES = ("arguments", "args")
CALL_TAG = re.compile(r"(?s)<tool_call>\s*(.*?)\s*</tool_call>")
_PIECES = re.compile(r'"(?:\\.|[^"\\])*(?:"|$)|[\[\]{}]', re.S)
_CLOSER = {"{": "}", "[": "]"}
_OTHER_CONTROLS = {i: " " for i in range(32) if chr(i) not in "\n\t"}


def balanced(text: str) -> str:
    """Closing brackets added where another one closes first or the text ends; strings are left alone."""
    out, open_, at = [], [], 0
    for piece in _PIECES.finditer(text):
        mark = piece[0]
        out.append(text[at : piece.start()])
        at = piece.end()
        if mark in _CLOSER:
            open_.append(_CLOSER[mark])
        elif mark in ("}", "]"):
            while open_ and open_[-1] != mark:
                out.append(open_.pop())
            if open_:
                open_.pop()
        out.append(mark)
    return "".join([*out, text[at:], *reversed(open_)])


def repaired(text: str) -> str:
    """Missing and trailing commas, doubled closers and brackets mended; control characters become spaces."""
    for pattern, by in REPAIRS:
        text = re.sub(pattern, by, text)
    return balanced(text).translate(_OTHER_CONTROLS)


def _loaded(text: str):
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return None


def _objects(value) -> list[dict]:
    return [x for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict)]


def whole_document(text: str) -> list | None:
    """The items of a text that is one JSON array or object."""
    body = text.strip()
    value = _loaded(body) if body[:1] in ("[", "{") else None
    return None if value is None else value if isinstance(value, list) else [value]


def parsed_text(text: str) -> tuple[str, list[dict], int, int, int]:
    """(mode, records, bad lines, empty lines, dropped fragments) of a file's text."""
    lines = [x.strip() for x in text.splitlines()]
    values = [_loaded(x) for x in lines if x]
    good = [v for v in values if isinstance(v, (dict, list))]
    records, bad, empty = [r for v in good for r in _objects(v)], len(values) - len(good), lines.count("")
    if records or not bad:
        return "linewise", records, bad, empty, 0
    for body in (text, repaired(text)):
        items = whole_document(body)
        if items is not None:
            return "document", _objects(items), 0, empty, 0
    for body in (text, repaired(text)):
        found, dropped = salvaged(body)
        if found:
            return "salvaged", [json.loads(x) for x in found], 0, empty, dropped
    return "linewise", [], bad, empty, 0


def parse_files(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, mode, records as JSON, n_bad, n_empty, n_dropped) of whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *parsed_text(t or "")) for k, t in zip(batch[key], batch[text], strict=True)]
            rows = [(k, mode, [json.dumps(r, ensure_ascii=False) for r in records], *rest) for k, mode, records, *rest in rows]
            yield pd.DataFrame(rows, columns=[key, "mode", "records", "n_bad", "n_empty", "n_dropped"])

    return texts.select(key, text).mapInPandas(run, f"{key} {texts.schema[key].dataType.simpleString()}, mode string, records array<string>, n_bad int, n_empty int, n_dropped int")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): whole files, one row each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, modified, digest): what tells one state of the inputs from another."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("digest"))


def first_object(text: str) -> dict | None:
    """The first object that stands whole in a text, whatever follows it."""
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            value, _ = decoder.raw_decode(text, at)
            if isinstance(value, dict):
                return value
        except json.JSONDecodeError:
            pass
        at = text.find("{", at + 1)
    return None


def _arguments(value) -> dict | None:
    """A call's arguments, which may be JSON in a string."""
    value = _loaded(value) if isinstance(value, str) else value
    return value if isinstance(value, dict) else None


def tool_call(value) -> dict | None:
    """{"tool", "args"} of a call: a tool with args (or its other fields as such), else a name with arguments, which may stand under "function"."""
    if not isinstance(value, dict):
        return None
    named = lambda x: x.strip() if isinstance(x, str) else ""
    if named(value.get("tool")):
        args = value.get("args")
        return {"tool": named(value["tool"]), "args": args if isinstance(args, dict) else {k: v for k, v in value.items() if k not in ("tool", "args")}}
    inner = value.get("function")
    tries = [(inner.get("name"), inner.get("arguments"))] if isinstance(inner, dict) else []
    tries += [(value.get("name"), value[n]) for n in ARGUMENT_NAMES if n in value]
    return next(({"tool": named(name), "args": args} for name, given in tries if named(name) and (args := _arguments(given)) is not None), None)


def tool_calls(text: str) -> list[dict]:
    """Calls in a reply: all tagged ones, else that of the first object."""
    tagged = [c for c in (tool_call(first_object(x)) for x in CALL_TAG.findall(text)) if c]
    return tagged or [c for c in [tool_call(first_object(text))] if c]


def atom_array(text: str) -> list[dict]:
    """Facts of an extraction's reply: an array or one object, fenced or not, else the whole objects of a broken one."""
    body = re.sub(r"```json\s*|```\s*$", "", text).strip()
    value = _loaded(body)
    return _objects(value) if value is not None else [json.loads(x) for x in salvaged(body)[0]]


def _json_column(make, c: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([[json.dumps(v, ensure_ascii=False) for v in make(x or "")] for x in batch.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(c.cast("string"))


def parsed_tool_calls(reply: Column) -> Column:
    """tool_calls() as an array of JSON."""
    return _json_column(tool_calls, reply)


def parsed_atoms(reply: Column) -> Column:
    """atom_array() as an array of JSON."""
    return _json_column(atom_array, reply)
