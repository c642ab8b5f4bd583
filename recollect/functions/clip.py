"""Texts within a budget of tokens: heads, tails, middles left out, and the newest lines of a context."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

# What stands for a part that is left out, and the shares of a budget.
CUT, OMITTED, MIDDLE = "…(truncated)…", "…(earlier context omitted)…", "\n…(middle of this part omitted)…\n"
CONTEXT_SHARE, LEAST_CONTENT, OVERLAP = 0.35, 64, 0.1
CONTINUED = "(continued -- this is the next part of the SAME message)"


def _reach(costs: list[int], allowed: int) -> int:
    """How many of the characters, from the first, cost `allowed` tokens at most: a wide one 1, four others 1."""
    wide = list(accumulate(costs, initial=0))
    low, high = 0, len(costs)
    while low < high:
        at = (low + high + 1) // 2
        low, high = (at, high) if wide[at] + (at - wide[at] + 3) // 4 <= allowed else (low, at - 1)
    return low


def clipped(text: str, budget: int, keep: str = "tail") -> str:
    """The head or tail that fits the budget together with the mark of the cut; empty if not even that fits."""
    if not text or budget <= 0:
        return ""
    if X.token_cost(text) <= budget:
        return text
    allowed = budget - X.token_cost(CUT)
    if allowed <= 0:
        return ""
    costs = X.wide_flags(text)
    n = _reach(costs[::-1] if keep == "tail" else costs, allowed)
    return CUT + text[len(text) - n :] if keep == "tail" else text[:n] + CUT


def clipped_middle(text: str, budget: int) -> str:
    """Head and tail of equal length that fit the budget with the mark between them."""
    if budget <= 0 or X.token_cost(text) <= budget:
        return text
    flags = X.wide_flags(text)
    half = len(text) // 2
    # characters in the order in which they join from both ends, the mark first
    both = X.wide_flags(MIDDLE) + [f for pair in zip(flags[:half], flags[::-1][:half], strict=True) for f in pair]
    n = max(0, (_reach(both, budget) - len(MIDDLE)) // 2)
    return text[:n] + MIDDLE + text[len(text) - n :]


def clipped_context(context: str, budget: int) -> str:
    """The newest lines that fit, a token more each, behind a mark; of a last line that is too long, its tail."""
    if not context or budget <= 0:
        return ""
    if X.token_cost(context) <= budget:
        return context
    lines, kept = context.splitlines(), []
    left = max(0, budget - X.token_cost(OMITTED))
    for line in reversed(lines):
        cost = X.token_cost(line) + 1
        if cost > left:
            kept += [] if kept else [clipped(line, left)]
            break
        kept.append(line)
        left -= cost
    return "\n".join([*([OMITTED] if len(kept) < len(lines) else []), *reversed(kept)])


def _column(make, c: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array((make(x.as_py() or "") for x in batch), pa.string(), size=len(batch))

    return F.arrow_udf(run, "string")(c.cast("string"))


def clip_text(c: Column, budget: int, keep: str = "tail") -> Column:
    return _column(lambda t: clipped(t, budget, keep), c)


def clip_middle(c: Column, budget: int) -> Column:
    return _column(lambda t: clipped_middle(t, budget), c)


def clip_context(c: Column, budget: int) -> Column:
    return _column(lambda t: clipped_context(t, budget), c)


def planned_units(context: str, content: str, budget: int) -> list[tuple[str, str]]:
    """(context, content) of each call: the clipped context opens the first part of a message, a note the others."""
    from ..operators.memory import cut_message

    if budget <= 0:
        return [(context, content)]
    for_context = int(budget * CONTEXT_SHARE)
    for_content = max(LEAST_CONTENT, budget - for_context)
    parts = cut_message(content, for_content, int(for_content * OVERLAP))
    return [(clipped_context(context, for_context) if i == 0 else CONTINUED, part) for i, part in enumerate(parts)]


def plan_units(context: Column, content: Column, budget: int) -> Column:
    """planned_units as an array of (context, content)."""
    kind = pa.list_(pa.struct([("context", pa.string()), ("content", pa.string())]))

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            units = [planned_units(a or "", b or "", budget) for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True)]
            yield pa.array([[{"context": a, "content": b} for a, b in own] for own in units], kind)

    return F.arrow_udf(run, "array<struct<context:string,content:string>>")(context.cast("string"), content.cast("string"))
