"""What runs leave behind: steps, evidence between steps, summaries, versions and their retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Categories of the older summary, tools that write, and parts of a command that may write.
CATEGORIES = {1: "multi_hop", 2: "temporal", 3: "open_domain", 4: "single_hop", 5: "adversarial_skip"}
WRITING_TOOLS, WRITING_PARTS = ("write", "edit"), (">", "tee ", "mv ", "cp ", "rm ", "sed -i", "truncate ")


def is_mutation(tool: Column, command: Column) -> Column:
    """Whether a call may change files: a tool that writes, or a shell command with a part that may."""
    may = [F.contains(F.coalesce(command, F.lit("")), F.lit(part)) for part in WRITING_PARTS]
    shell = may[0]
    for part in may[1:]:
        shell = shell | part
    return tool.isin(*WRITING_TOOLS) | ((tool == "bash") & shell)


def repeat_hits(steps: DataFrame, run: str, step: str, call: str, state: str, into: str = "hits") -> DataFrame:
    """How often a run made the same call while its evidence stood the same, this time included."""
    return steps.withColumn(into, F.count(F.lit(1)).over(Window.partitionBy(run, call, state).orderBy(step)))


def step_progress(states: DataFrame, run: str, step: str, sources: str, facts: str, into: str = "advanced") -> DataFrame:
    """Whether a step got further than the one before: a new source, fewer facts, or a fact that says something new.

    facts: an array of texts. Null where neither step has any.
    """
    signed = F.transform(F.col(facts), lambda t: F.struct(*(c.alias(n) for n, c in X.signature(t).items())))
    along = Window.partitionBy(run).orderBy(step)
    rows = states.withColumn("_now", signed)
    rows = rows.withColumns({"_old": F.lag("_now").over(along), "_before": F.lag(sources).over(along)})
    old = F.coalesce(F.col("_old"), F.array().cast(rows.schema["_old"].dataType))
    cited = F.size(F.array_except(sources, F.coalesce("_before", F.array().cast("array<string>")))) > 0
    told = F.exists("_now", lambda x: ~F.exists(old, lambda y: X.same_signature(x, y)))
    advanced = F.when((F.size(old) == 0) & (F.size("_now") == 0), None).otherwise(cited | (F.size("_now") < F.size(old)) | told)
    return rows.withColumn(into, advanced).drop("_now", "_old", "_before")


def legacy_summary(items: DataFrame, category: str = "category") -> DataFrame:
    """One row for each category, also those without items; a metric that is missing counts as 0."""
    scored = ~F.coalesce(F.col("skipped"), F.lit(False))
    mean = lambda c: F.coalesce(F.avg(F.when(scored, F.coalesce(c.cast("double"), F.lit(0.0)))), F.lit(0.0))
    sums = items.groupBy(category).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(scored).alias("n_scored"),
        mean(F.col("correct")).alias("accuracy"),
        *(mean(F.col(c)).alias(c) for c in ("exact_match", "token_f1", "evidence_recall")),
    )
    names = items.sparkSession.createDataFrame(list(CATEGORIES.items()), f"{category} int, name string")
    out = F.broadcast(names).join(sums.withColumn(category, F.col(category).cast("int")), category, "left")
    return out.fillna(0, ["n", "n_scored"]).fillna(0.0)


def directory_summary(records: DataFrame, group: str) -> DataFrame:
    """Of each directory's question records: done, errors, sufficient, evidence, steps, calls and tampered ones."""
    n = F.count(F.lit(1))
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    return records.groupBy(group).agg(
        F.count_if(~failed).alias("qa_done"),
        F.count_if(failed).alias("qa_error"),
        F.count_if("sufficient").alias("n_sufficient"),
        (F.count_if("sufficient") / n).alias("sufficient_rate"),
        F.sum("evidence_count").alias("evidence_total"),
        F.max("evidence_count").alias("evidence_max"),
        F.sum("steps").alias("steps_total"),
        F.round(F.sum("steps") / n, 2).alias("steps_mean"),
        F.sum("tool_calls").alias("tool_calls_total"),
        F.count_if("tampered").alias("n_tampered"),
    )


def date_hint(records: DataFrame, group: str, *texts: str, today: Column | None = None) -> DataFrame:
    """The latest valid date that each group's texts write as yyyy-MM-dd; `today` where none does."""
    found = F.flatten(F.array(*(F.regexp_extract_all(X.text_or_empty(F.col(t)), F.lit(r"[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.lit(0)) for t in texts)))
    latest = F.array_max(F.transform(found, lambda d: F.try_to_date(d, "yyyy-MM-dd")))
    return records.groupBy(group).agg(F.coalesce(F.max(latest), today if today is not None else F.current_date()).alias("date_hint"))


def conversation_date(records: DataFrame, group: str, time: str, today: Column | None = None) -> DataFrame:
    """The day of the latest ISO time with a time part; `today` where there is none."""
    moment = F.when(F.contains(F.col(time), F.lit("T")), F.try_to_timestamp(F.replace(F.col(time), F.lit("Z"), F.lit("+00:00"))))
    return records.groupBy(group).agg(F.coalesce(F.to_date(F.max(moment)), today if today is not None else F.current_date()).alias("day"))


def retained_runs(runs: DataFrame, name: str, keep_last: int = 0) -> DataFrame:
    """runs with `kept`: the last by name, else the last whose name holds "full", else the last; hidden ones are left out."""
    rows = runs.where(~F.col(name).startswith("."))
    if keep_last > 0:
        last = rows.orderBy(F.col(name).desc()).limit(keep_last).select(F.col(name).alias("_keep"))
    else:
        # two names at most
        best = rows.agg(F.max(F.when(F.contains(F.col(name), F.lit("full")), F.col(name))).alias("full"), F.max(name).alias("any"))
        last = best.select(F.coalesce("full", "any").alias("_keep"))
    return rows.join(F.broadcast(last), F.col(name) == F.col("_keep"), "left").withColumn("kept", F.col("_keep").isNotNull()).drop("_keep")


def new_runs(after: DataFrame, before: DataFrame, name: str) -> DataFrame:
    """Names that were not there before."""
    return after.select(name).exceptAll(before.select(name))


def budget_with_skips(rows: DataFrame, group: str, pos: str, line: str, speaker: str, most_tokens: int) -> DataFrame:
    """(group, kept, dropped_speakers): lines that fit from the newest back, going on to older ones after one that does not.

    A group whose lines fit together keeps all. Lines of one prompt; the greedy choice depends on their order.
    """
    target = int(most_tokens * 4 * 0.95)
    lines = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.length(line).alias("n"), F.coalesce(F.col(speaker), F.lit("")).alias("s")))).alias("_all"))
    total = F.aggregate("_all", F.lit(0), lambda n, x: n + x["n"])
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("kept"))
    chosen = F.aggregate(
        F.reverse(F.transform("_all", lambda x, i: F.struct(x["n"].alias("n"), i.alias("i")))),
        start,
        lambda acc, x: F.when((acc["used"] + x["n"] + 1 > target) & (F.size(acc["kept"]) > 0), acc).otherwise(
            F.struct((acc["used"] + x["n"] + 1).alias("used"), F.concat(F.array(x["i"]), acc["kept"]).alias("kept"))
        ),
    )["kept"]
    fits = total / 4 <= most_tokens
    kept = F.when(fits, F.transform("_all", lambda x, i: i)).otherwise(chosen)
    out = lines.withColumn("_kept", kept)
    # the speakers of lines that went, and of the first ones, as many as went
    gone = F.array_except(F.transform("_all", lambda x, i: i), "_kept")
    first = F.transform(F.slice("_all", F.lit(1), F.size("_all") - F.size("_kept")), lambda x: x["s"])
    speakers = F.array_sort(F.array_distinct(F.filter(F.concat(F.transform(gone, lambda i: F.col("_all")[i]["s"]), first), lambda s: s != "")))
    return out.select(group, F.transform("_kept", lambda i: F.col("_all")[i]["p"]).alias("kept"), F.when(F.size("_kept") == F.size("_all"), F.array().cast("array<string>")).otherwise(speakers).alias("dropped_speakers"))


def truncation_stats(lists: DataFrame, total: str, kept: str) -> DataFrame:
    """How many prompts were cut, at what rate, and what share of lines stayed."""
    cut = F.col(kept) < F.col(total)
    return lists.agg(F.count(F.lit(1)).alias("n"), F.count_if(cut).alias("n_truncated"), F.coalesce(F.count_if(cut) / F.count(F.lit(1)), F.lit(0.0)).alias("rate"), F.sum(total).alias("n_lines"), F.sum(kept).alias("n_kept"))
