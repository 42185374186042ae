"""One rule for who answered, equal option ids of different questions, numbers in text, open markup."""

import time

from pyspark.sql import functions as F

from surveyframe.operators import audit, clean, segments, shift, tally
from tests.conftest import rows

NULLS = "respondent_id long, question_id string, option_id string"


def answers(spark):
    return spark.createDataFrame([(1, "q", "a"), (2, "q", "b"), (3, "q", None), (4, "q", " "), (5, "r", "a")], NULLS)


def test_no_base_counts_people_without_an_answer(spark):
    df = answers(spark)
    assert rows(tally.distribution(df.filter("question_id = 'q'")), "option_id", "n", "d") == {("a", 1, 2), ("b", 1, 2)}
    assert rows(tally.multi_distribution(df, "q", ["a", "b"]), "option_id", "n", "d") == {("a", 1, 2), ("b", 1, 2)}
    assert segments.any_of(df, "q", ["a"]).count() == 2
    people = spark.createDataFrame([(i, "s") for i in range(1, 6)], "respondent_id long, segment string")
    asked = spark.createDataFrame([("q", "s")], "question_id string, segment string")
    assert rows(clean.base_of(df, people, asked), "asked", "d") == {(5, 2)}
    pooled = clean.pool_writeins(df, spark.createDataFrame([("q", "a")], "question_id string, option_id string"))
    assert rows(tally.distribution(pooled), "question_id", "option_id", "n") == {("q", "a", 1), ("q", "Other", 1), ("r", "Other", 1)}


def test_both_waves_need_an_answer(spark):
    df = spark.createDataFrame([(1, "q", "a", "x"), (1, "q", "b", "y"), (2, "q", None, "x"), (2, "q", "a", "y")], NULLS + ", wave string")
    assert rows(shift.shift(df, "q", "x", "y", ["a", "b"]), "option_id", "n_then", "n_now", "d") == {("a", 1, 0, 1), ("b", 0, 1, 1)}


def test_equal_ids_of_two_questions_are_two_picks(spark):
    df = answers(spark)
    assert rows(tally.union_respondents(df, [("q", "a")]), "respondent_id") == {(1,)}
    assert rows(tally.union_respondents(df, [("q", "a"), ("r", "a")]), "respondent_id") == {(1,), (5,)}
    assert rows(tally.except_respondents(df, [("q", "a"), ("q", "b")], [("r", "a")]), "respondent_id") == {(1,), (2,)}


def test_what_declared_lists_leave_out(spark):
    options = spark.createDataFrame([("q", "a"), ("r", "a")], "question_id string, option_id string")
    people = spark.createDataFrame([(1, "s"), (2, None), (3, "t")], "respondent_id long, segment string")
    assert rows(tally.undeclared(answers(spark), options, people, ["s"]), "question_id", "name", "n") == {("q", "b", 1), (None, None, 1), (None, "t", 1)}


def test_a_segment_without_cells_keeps_its_base(spark):
    cells = spark.createDataFrame([("s", "a", 3)], "segment string, option_id string, n long")
    bases = spark.createDataFrame([("s", 4), ("t", 26)], "segment string, d long")
    assert rows(tally.dense_grid(["s", "t"], ["a"], cells, bases), "segment", "n", "d", "pct") == {("s", 3, 4, 0.75), ("t", 0, 26, 0.0)}


def test_numbers_in_groups_and_full_width_signs(spark):
    df = spark.createDataFrame([(1, "1,200% (12/1), 38％（1,800／4,700） and 5 % (1/20)")], "doc_id long, text string")
    found = rows(audit.extract_claims(df), "pct", "n", "d")
    assert found == {(1200.0, 12, 1), (38.0, 1800, 4700), (5.0, 1, 20)}


def test_phone_numbers_of_several_forms(spark):
    text = "0912-345-678, +886 2 1234 5678; 555-123-4567 (04) 2345-6789 on 2024-01-30 from 192.168.100.200 x (555) 123-4567"
    masked = clean.redact_identifiers(spark.createDataFrame([(text,)], "t string"), text=["t"]).first().t
    assert masked == "[phone], [phone]; [phone] [phone] on 2024-01-30 from 192.168.100.200 x [phone]"


def test_open_markup_is_read_once(spark):
    pages = [("<!--" * 100_000 + "5%",), ("<script" * 100_000 + "5%",), ("<script>" * 100_000,), ("<" * 100_000,), ("a<b>5%</b><!-- 7% --><style>9%</style>c",)]
    start = time.perf_counter()
    got = [r.x for r in spark.createDataFrame(pages, "html string").select(audit.strip_tags(F.col("html")).alias("x")).collect()]
    assert time.perf_counter() - start < 10
    assert got[-1].split() == ["a", "5%", "c"]


def test_a_second_cell_is_hidden_where_one_could_be_subtracted(spark):
    df = spark.createDataFrame([("x", "a", 3, 0.1), ("x", "b", 9, 0.3), ("x", "c", 18, 0.6), ("y", "a", 0, 0.0), ("y", "b", 9, 1.0)], "q string, o string, n long, pct double")
    hidden = audit.suppress(df, 5, within=["q"], order=["o"])
    assert rows(hidden, "q", "o", "n", "suppressed") == {("x", "a", None, True), ("x", "b", None, True), ("x", "c", 18, False), ("y", "a", 0, False), ("y", "b", 9, False)}


def test_waves_reach_the_scan(spark, sf):
    from surveyframe.plans import views

    plan = views.answers_waves(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-01" in plan.replace(" ", "")


def test_all_catalogue_questions_in_one_pass(spark, sf):
    from surveyframe.plans import views

    catalogue = {"q": [f"o{i}" for i in range(130)], "r": ["a", "b"], "s": ["x"]}
    df = spark.range(4000).select(
        (F.col("id") % 700).alias("respondent_id"),
        F.when(F.col("id") % 3 == 0, "r").otherwise("q").alias("question_id"),
        F.when(F.col("id") % 3 == 0, "b").when(F.col("id") % 11 != 0, F.concat(F.lit("o"), F.col("id") % 130)).alias("option_id"),
    )
    got = rows(tally.tally_catalogue(df, catalogue), "question_id", "option_id", "ord", "n", "d")
    for q, options in catalogue.items():
        assert {x[1:] for x in got if x[0] == q} == rows(tally.multi_distribution(df, q, options), "option_id", "ord", "n", "d")
    answers = views.answers(spark, sf)
    plans = [
        tally.tally_catalogue(answers, dict(list(c.items())))._jdf.queryExecution().executedPlan().toString()
        for c in ({"sector": ["BUILDING"]}, {"sector": ["BUILDING"], "home": ["1", "2"], "priority": ["5-LOW"]})
    ]
    assert [p.count("FileScan") for p in plans] == [1, 2] or [p.count("FileScan") for p in plans] == [2, 2]
    assert all(p.count("Exchange hashpartitioning(question_id") <= 2 for p in plans)
