"""Secret scans: three base patterns, and a battery of randomness tests over long runs of key characters.

For each run of 20 or more characters of A-Z a-z 0-9 + / _ - that no base span holds, the encoding is inferred
(hexadecimal, base 32 or base 64; digits alone are none). The null hypothesis is structured text: a departure
from a uniform alphabet, from the expected number of runs and from zero serial correlation of at least the
margins below. Each test asks whether the departure is smaller; the three are combined (Stouffer), so a longer
string gives more evidence. Within each encoding and length class, Benjamini-Hochberg over all documents picks
the strings that count as secrets. p-values are rounded up to a fixed grid, so the procedure needs only counts
for each grid cell, whatever the number of candidates.

All of it is column expressions. Positions are code points, ends exclusive.

Defined results: null and empty texts have no spans; each row gives its own result, so repeats are equal, and
each repeat counts as a candidate of its own; further columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh

#: The base patterns, the group whose length counts, and that length.
BASE = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: A longer pattern that a text must hold before its spans are looked for.
WORTH = {"assign": BASE["assign"][0], "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
KINDS = (*BASE, "random")
RUN, LEAST = r"[A-Za-z0-9+/_-]+", 20
#: Matches of a text that are placed together.
CHUNK = 256
#: Characters of each encoding in the order of their codes.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Least departures of structured text: chi-squared per character, runs and serial correlation per root of length.
MARGIN_CHI, MARGIN_RUNS, MARGIN_SERIAL = {"hex": 0.6, "base32": 1.0, "base64": 1.2}, 0.35, 0.35
#: Share of false discoveries; grid cells for a factor of ten of p, and the last cell.
ALPHA, GRID, LAST_CELL = 0.05, 64, 64 * 20


EMPTY = "array<struct<s:int,e:int,v:string>>"


def spans_of(text: Column, pattern: str, group: int = 0, least: int = 1) -> Column:
    r"""Spans of the leftmost non-overlapping matches, as an array of (s, e, v): start, end and the match.

    \G ties each search to the end of the last, so a text is gone over once; a piece is a gap and its match.
    """
    pieces = F.regexp_extract_all(text, F.lit(rf"\G[\s\S]*?(?:{pattern})"), F.lit(0))
    parts = F.transform(
        pieces,
        lambda p: F.struct(F.length(p).alias("n"), F.regexp_extract(p, pattern, 0).alias("v"), F.length(F.regexp_extract(p, pattern, group)).alias("k")),
    )
    empty = F.array().cast(EMPTY)

    def within(chunk: Column) -> Column:
        """Spans from the start of a chunk of pieces, and the length of the chunk."""
        return F.aggregate(
            chunk,
            F.struct(F.lit(0).alias("at"), empty.alias("out")),
            lambda acc, p: F.struct(
                (acc["at"] + p["n"]).alias("at"),
                F.when(p["k"] >= least, F.concat(acc["out"], F.array(F.struct((acc["at"] + p["n"] - F.length(p["v"])).alias("s"), (acc["at"] + p["n"]).alias("e"), p["v"].alias("v"))))).otherwise(acc["out"]).alias("out"),
            ),
        )

    # arrays grow within chunks only, so the cost is far from the square of the number of spans
    def chunked(x: Column) -> Column:
        last = F.floor((F.size(x["parts"]) - 1) / CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda c: within(F.slice(x["parts"], c * CHUNK + 1, F.lit(CHUNK))))

    def begun(x: Column) -> Column:
        starts = F.aggregate(x["chunks"], F.array(F.lit(0)), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + c["at"])))
        return F.struct(x["chunks"].alias("chunks"), starts.alias("starts"))

    def joined(x: Column) -> Column:
        moved = lambda m, by: F.struct((m["s"] + by).alias("s"), (m["e"] + by).alias("e"), m["v"].alias("v"))
        return F.flatten(F.transform(x["chunks"], lambda c, i: F.transform(c["out"], lambda m: moved(m, F.get(x["starts"], i)))))

    # each step's value has a name, so that none is computed twice
    named = lambda value, name, body: F.transform(F.array(F.struct(value.alias(name))), body)[0]
    return named(parts, "parts", lambda x: named(chunked(x), "chunks", lambda y: F.transform(F.array(begun(y)), joined)[0]))


def base_spans(text: Column) -> dict[str, Column]:
    return {kind: F.when(text.rlike(WORTH[kind]), spans_of(text, *BASE[kind])).otherwise(F.array().cast(EMPTY)) for kind in BASE}


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 26.2.17, within 7.5e-8; beyond 8 the tail's bound by the density."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) * F.lit(0.3989422804014327) * poly
    return F.when(z > 0, F.lit(1.0) - tail).otherwise(tail)


def encoding_of(run: Column) -> Column:
    return (
        F.when(run.rlike("^[0-9]+$"), F.lit(None).cast("string"))
        .when(run.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(run.rlike("^[A-Z2-7]+$"), "base32")
        .otherwise("base64")
    )


def _battery(candidate: DataFrame) -> DataFrame:
    """Adds p, the combined p-value, to rows of (v, enc)."""
    per = lambda values: F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), F.col("enc"))
    size = {k: float(len(v)) for k, v in ALPHABETS.items()}
    plain = F.when(F.col("enc") == "hex", F.lower("v")).otherwise(F.translate("v", "-_", "+/"))
    rows = candidate.withColumns({"chars": F.split(plain, ""), "n": F.length("v").cast("double"), "k": per(size), "alphabet": per(ALPHABETS), "margin": per(MARGIN_CHI)})
    rows = rows.withColumn("codes", F.transform("chars", lambda c: (F.instr(F.col("alphabet"), c) - 1).cast("double")))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    squares = total(F.transform(F.array_distinct("chars"), lambda d: F.pow(F.size(F.filter("chars", lambda c: c == d)).cast("double"), F.lit(2.0))))
    rows = rows.withColumns({"chi": squares * F.col("k") / F.col("n") - F.col("n"), "mean": total(F.col("codes")) / F.col("n"), "upper": F.transform("codes", lambda c: c >= F.col("k") / 2)})
    pairs = lambda xs: F.zip_with(F.slice(xs, F.lit(1), F.size(xs) - 1), F.slice(xs, F.lit(2), F.size(xs) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = rows.withColumns(
        {
            "high": F.size(F.filter("upper", lambda b: b)).cast("double"),
            "runs": F.lit(1.0) + F.size(F.filter(pairs(F.col("upper")), lambda p: p["a"] != p["b"])),
            "var": total(F.transform("codes", lambda c: F.pow(c - F.col("mean"), F.lit(2.0)))),
            "cov": total(F.transform(pairs(F.col("codes")), lambda p: (p["a"] - F.col("mean")) * (p["b"] - F.col("mean")))),
        }
    )
    both = 2 * F.col("high") * (F.col("n") - F.col("high"))
    expected = both / F.col("n") + 1
    spread = F.sqrt(F.greatest(both * (both - F.col("n")) / (F.col("n") * F.col("n") * (F.col("n") - 1)), F.lit(0.0)))
    root = F.sqrt("n")
    # a run on one side only, or of one character, is as structured as can be
    z_runs = F.when(spread > 0, F.abs(F.col("runs") - expected) / spread).otherwise(root)
    z_serial = F.when(F.col("var") > 0, F.abs(F.col("cov") / F.col("var")) * root).otherwise(root)
    shift = F.col("n") * F.col("margin")
    z_chi = (F.col("chi") - (F.col("k") - 1) - shift) / F.sqrt(2 * (F.col("k") - 1) + 4 * shift)
    z = (z_chi + (z_runs - root * MARGIN_RUNS) + (z_serial - root * MARGIN_SERIAL)) / F.sqrt(F.lit(3.0))
    return rows.withColumn("p", normal_cdf(z))


def _strata(rows: DataFrame) -> DataFrame:
    """Adds the class (encoding and length to a factor of two) and the grid cell of p, rounded up."""
    length_class = F.least(F.floor(F.log2("n")), F.lit(12))
    cell = F.when(F.col("p") <= 0, F.lit(LAST_CELL)).otherwise(F.least(F.floor(-F.log10("p") * GRID), F.lit(LAST_CELL)))
    return rows.withColumns({"stratum": F.concat_ws(":", "enc", length_class.cast("string")), "cell": F.greatest(cell, F.lit(0)).cast("int")})


def discovery_limits(cells: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """For each stratum, the least cell whose strings are discoveries; cells: one row for each candidate."""
    counts = cells.groupBy("stratum", "cell").agg(F.count(F.lit(1)).alias("m"))
    above = Window.partitionBy("stratum").orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"found": F.sum("m").over(above), "all": F.sum("m").over(Window.partitionBy("stratum"))})
    passing = ranked.where(F.pow(F.lit(10.0), -F.col("cell") / GRID) <= alpha * F.col("found") / F.col("all"))
    return passing.groupBy("stratum").agg(F.min("cell").alias("limit"))


def scan_secrets(docs: DataFrame, text: str = "text", alpha: float = ALPHA) -> DataFrame:
    """docs without text, with `spans`: all spans as (kind, s, e) in order of start and kind."""
    scratch = Scratch(docs.sparkSession, "secrets")
    into, = fresh(docs, "spans")
    body = F.coalesce(F.col("_text"), F.lit(""))
    rest = [c for c in docs.columns if c != text]
    row = F.struct(*(F.col(c) for c in rest)) if rest else F.struct(F.lit(None).alias("_"))
    rows = docs.select(row.alias("_row"), F.col(text).cast("string").alias("_text"))
    runs = F.when(body.rlike(rf"[A-Za-z0-9+/_-]{{{LEAST}}}"), spans_of(body, RUN, 0, LEAST)).otherwise(F.array().cast(EMPTY))
    found = rows.select("_row", *(c.alias(k) for k, c in base_spans(body).items()), runs.alias("runs"))
    keyed = lambda kind: F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    found = found.withColumn("base", F.concat(*(keyed(k) for k in BASE)))
    inside = lambda r: F.exists("base", lambda b: (b["s"] <= r["s"]) & (b["e"] >= r["e"]))
    own = F.filter("runs", lambda r: ~inside(r) & encoding_of(r["v"]).isNotNull())
    found = scratch.table("found", found.select("_row", "base", own.alias("runs"), F.expr("uuid()").alias("_id")))
    candidates = found.where(F.size("runs") > 0).select("_id", F.explode("runs").alias("r")).select("_id", "r.*").withColumn("enc", encoding_of(F.col("v")))
    tested = scratch.table("tested", _strata(_battery(candidates)).select("_id", "s", "e", "stratum", "cell"))
    limits = discovery_limits(tested, alpha)
    added = tested.join(limits, "stratum").where("cell >= limit").groupBy("_id").agg(F.collect_list(F.struct(F.lit("random").alias("kind"), "s", "e")).alias("added"))
    kind_type = "array<struct<kind:string,s:int,e:int>>"
    every = F.concat(F.col("base").cast(kind_type), F.coalesce(F.col("added").cast(kind_type), F.array().cast(kind_type)))
    ranked = F.transform(every, lambda x: F.struct(x["s"].alias("s"), F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("r"), x["kind"].alias("kind"), x["e"].alias("e")))
    ordered = F.transform(F.array_sort(ranked), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return found.join(added, "_id", "left").select("_row.*", ordered.alias(into))


def op9_secret_scans(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of scan_secrets() over every whole text of documents."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    shown = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] != "random")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(shown(base), 256).alias("base_sha256"), shown("spans").alias("spans"))
