"""Dates in words, anchored at the time a message was sent, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
WEEKDAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
NUMBERS = "one two three four five six seven eight nine ten".split()
# Weekdays and spans that "last", "next" and "this" lead.
WEEKDAY = r"\b(last|next|this)\s+(monday|mon|tuesday|tues|tue|wednesday|weds|wed|thursday|thurs|thur|thu|friday|fri|saturday|sat|sunday|sun)\b"
TURN = r"^(last|next|this)\s+(weekend|week|month|summer|winter|spring|autumn|fall)\b"
SHOWN = "d MMMM yyyy"
# Forms of absolute dates, in the order in which they are tried.
ISO = r"([0-9]{4}-[0-9]{2}-[0-9]{2})"
DAY_FIRST = r"([0-9]{1,2})\s+([A-Za-z]{3,})\.?,?\s+([0-9]{4})"
MONTH_FIRST = r"([A-Za-z]{3,})\.?\s+([0-9]{1,2}),?\s+([0-9]{4})"
MONTH_YEAR = r"([A-Za-z]{3,})\.?\s+([0-9]{4})"
# Numbers in words before a unit ("a" is one), and forms that are relative to a date.
COUNTS = "one two three four five six".split()
_NUMBER = rf"(?i)(?:the\s+)?(?:(a|{'|'.join(COUNTS)}|[0-9]+)\s+)?\b"
WEEKDAYS_BEFORE = rf"{_NUMBER}({'|'.join(WEEKDAYS)})s?\b\s+before\s+(.+)"
UNITS_BEFORE = rf"{_NUMBER}(day|week|weekend)s?\b\s+before\s+(.+)"
ANCHORED = r"(?is)^\s*(.+?)\s*\(anchor:\s*(.+?)\)\s*$"
ANY_WEEKDAY = r"\b(monday|mon|tuesday|tues|tue|wednesday|wed|thursday|thurs|thur|thu|friday|fri|saturday|sat|sunday|sun)\b"


def bound(value: Column, body) -> Column:
    """body(x) with x standing for value, which is computed once however often the body names it.

    The body must not bind again: Spark does not find nested lambdas in the arguments of a Python function.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def anchor_text(anchor: Column) -> Column:
    """The date part of a time such as "1:56 pm on 8 May, 2023"; null if there is none."""
    after_on = F.nullif(F.regexp_extract(anchor, r"on\s+(.+)$", 1), F.lit(""))
    named = F.nullif(F.regexp_extract(anchor, r"([0-9]{1,2}\s+[A-Za-z]+,?\s+[0-9]{4})", 1), F.lit(""))
    iso = F.nullif(F.regexp_extract(anchor, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit(""))
    return F.coalesce(F.trim(F.replace(after_on, F.lit(","), F.lit(""))), F.replace(named, F.lit(","), F.lit("")), iso)


def _month_number(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(name, 1, 3)))


def parsed_date(text: Column) -> Column:
    """ISO, else day, month name and year; null if neither or no such day."""
    iso = F.regexp_extract(text, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    part = lambda i: F.regexp_extract(text, r"([0-9]{1,2})\s+([A-Za-z]{3,})\.?,?\s+([0-9]{4})", i)
    named = F.try_to_date(F.concat_ws("-", part(3), _month_number(part(2)).cast("string"), part(1)), "yyyy-M-d")
    return F.when(iso != "", F.try_to_date(iso, "yyyy-MM-dd")).otherwise(named)


def weekday_near(day: Column, weekday: Column, before: Column) -> Column:
    """The nearest such weekday (Monday: 0) strictly before or after a day."""
    gap = F.when(before, F.pmod(F.weekday(day) - weekday, F.lit(7))).otherwise(F.pmod(weekday - F.weekday(day), F.lit(7)))
    gap = F.when(gap == 0, 7).otherwise(gap).cast("int")
    return F.when(before, F.date_sub(day, gap)).otherwise(F.date_add(day, gap))


_AGO = rf"\b({'|'.join(NUMBERS)})\s+((?:day|week|month|year)s?)\s+ago\b"


def _counted(expression: Column) -> Column:
    """The number word before "days ago" and the like as digits."""
    word = F.regexp_extract(expression, _AGO, 1)
    number = F.array_position(F.array(*map(F.lit, NUMBERS)), word).cast("string")
    return F.when(expression.endswith("ago") | expression.contains(" ago"), F.when(word != "", F.regexp_replace(expression, F.lit(_AGO), F.concat(number, F.lit(" $2 ago")))).otherwise(expression)).otherwise(expression)


def with_resolved_time(rows: DataFrame, expression: Column, anchor: Column, into: str) -> DataFrame:
    """Adds what is stored for a relative time said at an anchor.

    Single days become dates and months become month and year; weeks, weekends, seasons and last weekdays stay
    relative to the anchor's date; years become years; anything else keeps the expression and the anchor.
    """
    # parts that many branches need are columns of their own, so that each is computed once
    parts = {"_said": F.coalesce(expression, F.lit("")), "_when": F.coalesce(anchor, F.lit(""))}
    staged = rows.withColumns(parts).withColumns({"_expr": _counted(F.lower(F.trim("_said"))), "_shown": anchor_text(F.col("_when"))})
    staged = staged.withColumns({"_day": parsed_date(F.col("_shown")), "_unit": F.regexp_replace(F.regexp_extract("_expr", TURN, 2), "^fall$", "autumn")})
    said, when, expr, shown, day, unit = map(F.col, ("_said", "_when", "_expr", "_shown", "_day", "_unit"))
    both = F.concat(said, F.lit(" (anchor: "), shown, F.lit(")"))
    has_year = expr.rlike("[0-9]{4}")
    days_ago = F.regexp_extract(expr, r"\b([0-9]+)\s+days?\s+ago\b", 1).try_cast("int")
    offset = (
        F.when(expr.rlike(r"\b(last|this)\s+night\b"), -1)
        .when(expr.rlike(r"\bthe day before yesterday\b"), -2)
        .when(expr.rlike(r"\bthe day after tomorrow\b"), 2)
        .when(expr.rlike(r"\byesterday\b"), -1)
        .when(expr.rlike(r"\btoday\b"), 0)
        .when(expr.rlike(r"\btomorrow\b"), 1)
        .otherwise(-days_ago)
    )
    direction, name = F.regexp_extract(expr, WEEKDAY, 1), F.regexp_extract(expr, WEEKDAY, 2)
    index = F.array_position(F.array(*(F.lit(w[:3].lower()) for w in WEEKDAYS)), F.substring(name, 1, 3)) - 1
    full = F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.greatest(index + 1, F.lit(1)).cast("int"))
    turn = F.regexp_extract(expr, TURN, 1)
    shift = F.when(turn == "last", -1).when(turn == "next", 1).otherwise(0)
    spans = F.regexp_extract(expr, r"^([0-9]+\s+(?:weeks?|months?))\s+ago$", 1)
    years = F.when(expr.rlike(r"^last\s+year$"), -1).when(expr.rlike(r"^next\s+year$"), 1).otherwise(-F.regexp_extract(expr, r"^([0-9]+)\s+years?\s+ago$", 1).try_cast("int"))
    anchor_year = F.regexp_extract(shown, "([0-9]{4})", 1).try_cast("int")
    stored = (
        F.when(F.trim(said) == "", "")
        .when(F.trim(when) == "", said)
        .when(shown.isNull(), F.when(has_year, said).otherwise(F.concat(said, F.lit(" (anchor: "), when, F.lit(")"))))
        .when(offset.isNotNull() & day.isNotNull(), F.date_format(F.date_add(day, offset), SHOWN))
        .when((name != "") & (direction == "last"), F.concat(F.lit("the "), full, F.lit(" before "), shown))
        .when((name != "") & day.isNotNull(), weekday_near(day, index, F.lit(False)).cast("string"))
        .when(unit == "month", F.coalesce(F.date_format(F.add_months(F.trunc(day, "MM"), shift), "MMMM yyyy"), shown))
        .when((turn == "last") & (unit != ""), F.concat(F.lit("the "), unit, F.lit(" before "), shown))
        .when((turn == "next") & (unit != ""), F.concat(F.lit("the "), unit, F.lit(" after "), shown))
        .when((turn == "this") & (unit != ""), both)
        .when(spans != "", F.concat(spans, F.lit(" before "), shown))
        .when(years.isNotNull() & anchor_year.isNotNull(), (anchor_year + years).cast("string"))
        .when(has_year, said)
        .otherwise(both)
    )
    return staged.withColumn(into, stored).drop("_said", "_when", "_expr", "_shown", "_day", "_unit")


def absolute_date(text: Column) -> Column:
    """ISO, day first, month first, else month and year (its first day); null if none, or if the first that fits is no day."""
    iso = F.regexp_extract(text, ISO, 1)
    part = lambda pattern, i: F.regexp_extract(text, pattern, i)
    day = lambda pattern, y, m, d: F.try_to_date(F.concat_ws("-", part(pattern, y), _month_number(part(pattern, m)).cast("string"), d), "yyyy-M-d")
    named = lambda pattern, m: _month_number(part(pattern, m)) > 0
    return (
        F.when(~text.rlike("[0-9]{4}"), None)
        .when(iso != "", F.try_to_date(iso, "yyyy-MM-dd"))
        .when(named(DAY_FIRST, 2), day(DAY_FIRST, 3, 2, part(DAY_FIRST, 1)))
        .when(named(MONTH_FIRST, 1), day(MONTH_FIRST, 3, 1, part(MONTH_FIRST, 2)))
        .when(named(MONTH_YEAR, 1), day(MONTH_YEAR, 2, 1, F.lit("1")))
    )


def _weekday_index(name: Column) -> Column:
    """Monday: 0; from the first three letters."""
    return F.array_position(F.array(*(F.lit(w[:3].lower()) for w in WEEKDAYS)), F.lower(F.substring(name, 1, 3))) - 1


def resolve_before(text: Column) -> Column:
    """The date of "N <weekday>s before X" or "N days, weeks or weekends before X" anywhere in a text; null if neither."""
    count = lambda word: F.coalesce(word.try_cast("int"), F.nullif(F.array_position(F.array(*map(F.lit, COUNTS)), word), F.lit(0)).cast("int"), F.lit(1))
    day_of = lambda pattern: absolute_date(F.regexp_extract(text, pattern, 3))
    part = lambda pattern, i: F.lower(F.regexp_extract(text, pattern, i))
    weeks = lambda n: ((n - 1) * 7).cast("int")
    # a weekday first: its last letters are a unit as well
    name, n = part(WEEKDAYS_BEFORE, 2), count(part(WEEKDAYS_BEFORE, 1))
    weekday = bound(day_of(WEEKDAYS_BEFORE), lambda day: F.date_sub(weekday_near(day, F.greatest(_weekday_index(name), F.lit(0)), F.lit(True)), weeks(n)))

    def of_unit(x: Column) -> Column:
        base, m = x["base"], x["m"]
        weekend = F.date_sub(weekday_near(base, F.lit(5), F.lit(True)), weeks(m))
        return F.when(x["unit"] == "day", F.date_sub(base, m)).when(x["unit"] == "week", F.date_sub(base, (m * 7).cast("int"))).when(x["unit"] == "weekend", weekend)

    units = F.struct(part(UNITS_BEFORE, 2).alias("unit"), count(part(UNITS_BEFORE, 1)).alias("m"), day_of(UNITS_BEFORE).alias("base"))
    return F.when(~F.lower(text).contains("before"), None).when(name != "", weekday).otherwise(bound(units, of_unit))


def resolve_anchored(text: Column) -> Column:
    """The date of "<relative> (anchor: <date>)", as relative times are stored; null for other texts.

    A week, weekend, weekday or night is always the one before the anchor, also after "next".
    """

    def resolved(x: Column) -> Column:
        said, anchor = x["said"], x["anchor"]
        name = F.regexp_extract(said, ANY_WEEKDAY, 1)
        turn = F.when(said.startswith("last"), -1).when(said.startswith("next"), 1).otherwise(0)
        # 29 February has no counterpart in the years beside it
        year = F.try_to_date(F.concat_ws("-", (F.year(anchor) + turn).cast("string"), F.month(anchor).cast("string"), F.dayofmonth(anchor).cast("string")), "yyyy-M-d")
        return (
            F.when(name != "", weekday_near(anchor, F.greatest(_weekday_index(name), F.lit(0)), F.lit(True)))
            .when(said.contains("weekend"), weekday_near(anchor, F.lit(5), F.lit(True)))
            .when(said.contains("week"), F.date_sub(anchor, 7))
            .when(said.contains("night"), F.date_sub(anchor, 1))
            .when(said.contains("month"), F.add_months(F.trunc(anchor, "MM"), turn))
            .when(said.contains("year"), year)
            .when(said.contains("day"), anchor)
        )

    parts = F.struct(F.lower(F.trim(F.regexp_extract(text, ANCHORED, 1))).alias("said"), absolute_date(F.regexp_extract(text, ANCHORED, 2)).alias("anchor"))
    return F.when(F.lower(text).contains("(anchor:"), bound(parts, lambda x: F.when(x["said"] != "", resolved(x))))


def answer_date(text: Column) -> Column:
    """The date that an answer states: stored with an anchor, relative to a date, or absolute."""
    return F.coalesce(resolve_anchored(text), resolve_before(text), absolute_date(text))


def temporal_verdict(reference: Column, candidate: Column) -> Column:
    """Of a reference that is relative to a date: no date, SAME (a day's tolerance for weekends), or the days apart; else empty."""
    loose = F.when(F.lower(reference).contains("weekend"), 1).otherwise(0)

    def verdict(x: Column) -> Column:
        apart = F.abs(F.datediff(x["a"], x["b"]))
        return F.when(x["a"].isNull(), "").when(x["b"].isNull(), "no date").when(apart <= loose, "SAME").otherwise(F.concat(F.lit("differ by "), apart.cast("string")))

    return bound(F.struct(resolve_before(reference).alias("a"), answer_date(candidate).alias("b")), verdict)


def iso_of_millis(ms: Column) -> Column:
    return F.coalesce(F.date_format(F.timestamp_millis(ms.try_cast("long")), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def exact_offset(text: Column) -> Column:
    """Days that "yesterday", "two days ago" and the like shift a message's date by; null if it says none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    number = F.regexp_extract(low, rf"\b([0-9]+|{'|'.join(NUMBERS)})\s+days?\s+ago\b", 1)
    named = F.nullif(F.array_position(F.array(*map(F.lit, NUMBERS)), number), F.lit(0)).cast("int")
    days_ago = F.coalesce(number.try_cast("int"), named)
    return (
        F.when(low.rlike(r"\bthe day before yesterday\b"), -2)
        .when(low.rlike(r"\bthe day after tomorrow\b"), 2)
        .when(low.rlike(r"\byesterday\b"), -1)
        .when(low.rlike(r"\btomorrow\b"), 1)
        .when(low.rlike(r"\b(last|this)\s+night\b"), -1)
        .otherwise(-days_ago)
    )


def _says(body: Column, day: Column) -> Column:
    low = F.lower(body)
    return low.contains(F.lower(F.date_format(day, SHOWN))) | low.contains(F.lower(F.date_format(day, "dd MMMM yyyy"))) | low.contains(F.date_format(day, "yyyy-MM-dd"))


def with_copied_anchor(rows: DataFrame, body: str, message: str, anchor: str, into: str) -> DataFrame:
    """Adds (said, corrected) where a record gives a message's own date for what the message places days away."""
    staged = rows.withColumns({"_day": parsed_date(anchor_text(F.col(anchor))), "_offset": exact_offset(F.col(message))})
    staged = staged.withColumn("_right", F.date_add("_day", F.col("_offset")))
    wrong = (F.col("_offset") != 0) & F.col("_day").isNotNull() & _says(F.col(body), F.col("_day")) & ~_says(F.col(body), F.col("_right"))
    found = F.when(wrong, F.struct(F.date_format("_day", SHOWN).alias("said"), F.date_format("_right", SHOWN).alias("corrected")))
    return staged.withColumn(into, found).drop("_day", "_offset", "_right")
