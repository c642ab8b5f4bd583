"""Question-answering samples: sessions, messages, questions, and the jobs that answer them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField("speaker", T.StringType()), T.StructField("text", T.StringType())])
#: Of the category that scores leave out.
ADVERSARIAL = 5


def load_samples(spark: SparkSession, path: str) -> DataFrame:
    """(sample_no, sample): the samples of a JSON array as JSON; a missing file is an error, not an empty dataset."""
    whole = spark.read.text(path, wholetext=True)
    parsed = whole.select(F.from_json("value", "array<variant>").alias("samples"))
    return parsed.select(F.posexplode("samples").alias("sample_no", "_v")).select("sample_no", F.to_json("_v").alias("sample"))


def sessions(samples: DataFrame, sample: str, conversation: str) -> DataFrame:
    """(sample, session_no, messages) in order of number: the keys session_N of a map of message arrays."""
    keyed = samples.select(sample, F.explode(conversation).alias("_key", "messages"))
    number = F.regexp_extract("_key", r"^session_([0-9]+)$", 1).try_cast("int")
    return keyed.select(sample, number.alias("session_no"), "messages").where("session_no is not null").orderBy(sample, "session_no")


def flat_messages(session_rows: DataFrame, sample: str) -> DataFrame:
    """(sample, session_no, msg_no, id, speaker, text): messages numbered from 1 within their session."""
    rows = session_rows.select(sample, "session_no", F.posexplode("messages").alias("_pos", "_m"))
    no = F.col("_pos") + 1
    return rows.select(sample, "session_no", no.alias("msg_no"), F.format_string("session_%d_%d", "session_no", no).alias("id"), F.coalesce("_m.speaker", F.lit("unknown")).alias("speaker"), F.coalesce("_m.text", F.lit("")).alias("text"))


def parse_indices(text: str) -> list[int]:
    """Question numbers separated by commas or spaces; anything else is an error."""
    return [int(part) for part in text.replace(",", " ").split()]


def select_questions(questions: DataFrame, group: str, index: str, question: str, category: str, wanted: list[int] | None = None, first: int = 0, skip_adversarial: bool = True, total_steps: int = 0, steps_each: int = 30) -> DataFrame:
    """The questions of each group that a run takes.

    Numbers that are named beat every limit. Else the first `first` are taken before empty and adversarial ones go,
    and what a budget of steps allows after that, one question at least.
    """
    rows = questions
    by_index = Window.partitionBy(group).orderBy(index)
    if wanted:
        rows = rows.where(F.col(index).isin(wanted))
    elif first:
        rows = rows.withColumn("_r", F.row_number().over(by_index)).where(F.col("_r") <= first).drop("_r")
    rows = rows.where(F.trim(F.coalesce(F.col(question), F.lit(""))) != "")
    if skip_adversarial:
        rows = rows.where(~F.col(category).eqNullSafe(F.lit(ADVERSARIAL)))
    if not wanted and total_steps > 0:
        allowed = max(1, total_steps // max(1, steps_each))
        rows = rows.withColumn("_r", F.row_number().over(by_index)).where(F.col("_r") <= allowed).drop("_r")
    return rows


def answer_jobs(searched: DataFrame, questions: DataFrame, group: str, index: str, evidence: str) -> DataFrame:
    """Searched questions with their text and evidence; a search without evidence is answered from none."""
    empty = F.array().cast(searched.schema[evidence].dataType)
    return searched.withColumn(evidence, F.coalesce(evidence, empty)).join(questions, [group, index], "left")
