import pytest
from pyspark.sql import functions as F

from recollect.functions import dates as D
from recollect.functions import text as X


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "said, anchor, stored",
    [
        ("last Wednesday", "3 March, 2021", "the Wednesday before 3 March 2021"),
        ("last week", "30 January, 2022", "the week before 30 January 2022"),
        ("yesterday", "1 March, 2024", "29 February 2024"),
        ("yesterday evening", "1 January, 2022", "31 December 2021"),
        ("the day before yesterday", "2 May, 2020", "30 April 2020"),
        ("the day after tomorrow", "30 December, 2020", "1 January 2021"),
        ("last night", "1 June, 2021", "31 May 2021"),
        ("last year", "17 April, 2019", "2018"),
        ("next month", "31 January, 2021", "February 2021"),
        ("this month", "9 September, 2020", "September 2020"),
        ("last month", "31 March, 2021", "February 2021"),
        ("seven years ago", "4:05 am on 12 June, 2020", "2013"),
        ("3 weeks ago", "12 June, 2020", "3 weeks before 12 June 2020"),
        ("recently", "4:05 am on 12 June, 2020", "recently (anchor: 12 June 2020)"),
        ("next Sunday", "12 June, 2020", "2020-06-14"),
        ("", "12 June, 2020", ""),
        ("yesterday", "", "yesterday"),
        ("yesterday", "no date", "yesterday (anchor: no date)"),
    ],
)
def test_relative_times(spark, said, anchor, stored):
    rows = spark.createDataFrame([(said, anchor)], "said string, anchor string")
    assert D.with_resolved_time(rows, F.col("said"), F.col("anchor"), "x").first()["x"] == stored


def test_fact_keys_and_signatures(spark):
    assert one(spark, X.dedup_key(F.col("t")), t="A, b.") == "a  b"
    assert one(spark, X.dedup_key(F.col("t")), t="船员") == ""
    assert one(spark, X.kept_dedup_key(F.col("t")), t="船员") == "船员"
    assert one(spark, X.tokens(F.col("t")), t="The cat and a dog, the CAT") == ["cat", "dog"]
    assert one(spark, X.subject(F.col("t")), t="in Paris Anna met") == "paris"
    assert one(spark, X.proper_nouns(F.col("t")), t="The Étoile met Anna and Bob2") == ["anna"]


def same(spark, a, b):
    rows = spark.createDataFrame([(a, b)], "p string, q string")
    signed = rows.select(*(v.alias("x_" + k) for k, v in X.signature(F.col("p")).items()), *(v.alias("y_" + k) for k, v in X.signature(F.col("q")).items()))
    return signed.select(X.same_fact("x_", "y_").alias("s")).first()["s"]


def test_same_fact(spark):
    assert same(spark, "Tamsin keeps a grey heron near water", "Tamsin keeps one grey heron near water")
    assert not same(spark, "Tamsin rows a boat called Gull", "Tamsin rows a boat called Petrel")
    assert not same(spark, "Ruben passed the pilot licence test", "Ruben failed a pilot course")
    assert same(spark, "Ruben values the quiet harbour choir evenings", "Ruben admires quiet choir evenings there often")
    assert not same(spark, "", "")


def test_scores(spark):
    for raw, want in ((87.0, 0.87), (5.0, 0.5), (0.3, 0.3), (-1.0, 0.0), (None, 0.5)):
        assert abs(one(spark, X.rescaled_score(F.col("v").cast("double")), v=raw) - want) < 1e-9
    assert one(spark, X.token_f1(F.col("a"), F.col("b")), a="the cat sat", b="the cat") == pytest.approx(0.8)
    assert one(spark, X.token_f1(F.col("a"), F.col("b")), a="", b="") == 1.0
    assert one(spark, X.exact_match(F.col("a"), F.col("b")), a="9 June, 2020!", b="9 june 2020") == 1.0
    assert one(spark, X.estimate_tokens(F.col("t")), t="abcde") == 2


def test_tags_and_ids(spark):
    tags = one(spark, X.normalize_tags(X.tags_of_string(F.col("t"))), t="Hobby: chess, art, zzz, mood:calm, odd:thing")
    assert tags == ["activity:chess", "activity:art", "other:zzz", "sentiment:calm", "other:thing"]
    a, b = (one(spark, X.user_slug(F.col("u")), u=u) for u in ("eval:run1:x", "eval/run1/x"))
    assert a != b and a.startswith("eval_run1_x_")
    assert one(spark, D.iso_of_millis(F.col("m")), m="1683561600000") == "2023-05-08T16:00:00Z"
    assert one(spark, D.iso_of_millis(F.col("m")), m="nope") == ""


def test_dates_of_answers(spark):
    verdict = lambda a, b: one(spark, D.temporal_verdict(F.col("a"), F.col("b")), a=a, b=b)
    assert verdict("the Sunday before 9 June 2020", "7 June 2020") == "SAME"
    assert verdict("two weeks before 21 June 2020", "7 June 2020") == "SAME"
    assert verdict("the weekend before 9 June 2020", "June 7, 2020") == "SAME"
    assert verdict("the week before 9 June 2020", "9 June 2020") == "differ by 7"
    assert verdict("the week before 9 June 2020", "unknown") == "no date" and verdict("7 June 2020", "7 June 2020") == ""
    assert one(spark, D.parsed_date(F.col("t")), t="30 February 2023") is None


@pytest.mark.parametrize(
    "text, day",
    [
        ("last week (anchor: 9 June 2020)", "2020-06-02"),
        ("next week (anchor: 9 June 2020)", "2020-06-02"),
        ("Last Friday (anchor: 2020-06-12)", "2020-06-05"),
        ("last month (anchor: 13 January 2020)", "2019-12-01"),
        ("last year (anchor: 29 February 2020)", "2020-02-29"),
        ("It was a week before 21 June 2020", "2020-06-14"),
        ("two weekends before 13 June 2020", "2020-05-30"),
        ("June 8, 2020", "2020-06-08"),
        ("in June 2020", "2020-06-01"),
        ("on 8 Jun. 2020 or so", "2020-06-08"),
        ("2020-13-01 and 8 June 2020", None),
        ("31 April 2020", None),
        ("8 of these 2020", None),
        ("", None),
    ],
)
def test_answer_dates(spark, text, day):
    got = one(spark, D.answer_date(F.col("t")), t=text)
    assert (str(got) if got else None) == day
