"""The corpus pipeline: five operators, each working on all documents that its predecessor kept.

toxicity rejects documents that score THRESHOLD or more. line dedup drops lines whose template recurs in MIN_DOCS
documents or whose masked text stands in EXACT_DOCS. A document that would lose its last words by it is rejected if each
of its raw lines stands in an earlier document; else it has numbers or words of its own and stays whole. Near-dedup
keeps the least id of each group. Decontamination drops documents that contain a benchmark item. Mixing gives the
copies that each document gets and drops those that get none; it returns the columns of documents and
`copies`, `taken`, `source_size`, `target` and `size`.

Each stage keeps rows with null ids and null texts unless its decision says otherwise; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import contamination, lines, mixing, neardup, toxicity
from recollect.llm.common import Scratch


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored, _ = toxicity.score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where(F.col(scored.columns[-1]) < toxicity.THRESHOLD).select(*docs.columns)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(docs, spare_own=True)
    emptied = (F.size(out.columns[-1]) > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.where(~F.coalesce(emptied, F.lit(False))).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = contamination.with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size(found.columns[-1]) == 0).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(docs)
    copies = mixed.columns[-2]  # named otherwise where documents have such a column
    return mixed.where(F.col(copies) > 0)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_recurring_lines),
    ("MinHash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources to target weights", mix),
]
#: Label models, Newton iterations and signatures have no SQL twin; tests hold the stages and run() against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(str(k), stage(spark, docs, sf_dir))
        if k:
            scratch.drop(str(k - 1))
    return docs
