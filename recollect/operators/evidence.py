"""Evidence records: validation, state of a file, and rows for the interface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def rejection(content: Column, source: Column) -> Column:
    """Why a record is rejected; null if it is valid. A record without a source is never repaired."""
    blank = F.exists(source, lambda s: s.isNull() | (F.trim(s) == ""))
    return (
        F.when(F.trim(F.coalesce(content, F.lit(""))) == "", "content must be a non-empty string")
        .when(F.coalesce(F.size(source), F.lit(0)) <= 0, "metadata.source must be a non-empty array")
        .when(blank, "metadata.source contains empty entries")
    )


def identity(record_id: Column, content: Column, memory: Column) -> Column:
    """The id, else the content with white space collapsed, else the memory."""
    squeezed = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    return F.coalesce(F.nullif(F.trim(record_id), F.lit("")), squeezed(content), squeezed(memory))


def validate(records: DataFrame, pos: str, content: str = "content", source: str = "source", score: str = "score", record_id: str | None = None) -> DataFrame:
    """records with status (valid, repaired or rejected), reason, score and identity; of equal identities the first stays."""
    own = identity(F.col(record_id) if record_id else F.lit(None).cast("string"), F.col(content), F.lit(None).cast("string"))
    rows = records.withColumns({"reason": rejection(F.col(content), F.col(source)), "identity": own})
    # only valid rows compete for an identity; those that do not stay out of the groups
    competes = F.col("reason").isNull() & F.col("identity").isNotNull()
    first = rows.where(competes).groupBy("identity").agg(F.min(pos).alias("_first"))
    marked = rows.join(first, "identity", "left")
    marked = marked.withColumn("reason", F.coalesce("reason", F.when(competes & (F.col(pos) > F.col("_first")), "duplicate"))).drop("_first")
    status = F.when(F.col("reason").isNotNull(), "rejected").when(F.col(score).isNull(), "repaired").otherwise("valid")
    return marked.withColumns({"status": status, score: F.bround(X.rescaled_score(F.col(score)), 4)}).select(*records.columns, "reason", "identity", "status")


def evidence_report(validated: DataFrame, *groups: str) -> DataFrame:
    """Rows of validate() counted by status."""
    return validated.groupBy(*groups).agg(*(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("valid", "repaired", "rejected")), F.count_if(F.col("reason") == "duplicate").alias("n_duplicates"))


def evidence_state(records: DataFrame, group: str, pos: str, content: str = "content", record_id: str | None = None) -> DataFrame:
    """Lines, distinct identities, duplicates, bytes, and a fingerprint of each evidence file.

    The fingerprint is sixteen digits of the SHA-256 of the distinct (identity, first body) pairs in order; a body that
    changes changes it. A file is the evidence of one question, so its pairs are few.
    """
    own = identity(F.col(record_id) if record_id else F.lit(None).cast("string"), F.col(content), F.lit(None).cast("string"))
    rows = records.select(F.col(group), F.col(pos).alias("_pos"), F.col(content).alias("_body"), own.alias("_i"))
    lines = rows.groupBy(group, "_i").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("_body") + 1).alias("bytes"), F.coalesce(F.min_by("_body", "_pos"), F.lit("")).alias("body"))
    known = F.col("_i").isNotNull()
    pairs = F.array_sort(F.collect_list(F.when(known, F.struct("_i", "body"))))
    joined = F.array_join(F.transform(pairs, lambda p: F.concat(p["_i"], F.lit("\u0000"), p["body"], F.lit("\u0001"))), "")
    digest = F.when(F.count_if(known) == 0, "").otherwise(F.substring(F.sha2(joined.cast("binary"), 256), 1, 16))
    return lines.groupBy(group).agg(
        F.sum("n").alias("n_lines"),
        F.count_if(known).alias("n_unique"),
        F.coalesce(F.sum(F.when(known, F.col("n") - 1)), F.lit(0)).alias("n_duplicates"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("n_bytes"),
        digest.alias("fingerprint"),
    )


def response_rows(records: DataFrame, pos: str, top_k: int | None = None, content: str = "content", source: str = "source", score: str = "score") -> DataFrame:
    """Non-empty records by score (missing last, then position), with stable ids; no limit without a positive top_k."""
    rows = records.where(F.trim(content) != "").select(X.memory_id(F.col(content), F.coalesce(F.col(source), F.array().cast("array<string>"))).alias("id"), content, score, pos)
    ordered = rows.orderBy(F.col(score).desc_nulls_last(), pos)
    return ordered.limit(top_k) if top_k and top_k > 0 else ordered
