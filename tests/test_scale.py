"""Plans and skew: what must hold when the tables are a thousand times larger."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from surveyframe.functions import joins
from surveyframe.operators import order, segments, tally
from surveyframe.plans import views as v
from tests.conftest import rows


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def nothing_is_small(spark):
    """Plan as if no table could be broadcast by its estimated size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# the longest chain of anchors and the cheapest pairing of a gap are searched in Python, by document and gap
OWN = [name for name in entry_points.queries() if not re.match(r"op[0-9]+_|pipeline$|aud6_align_translation$", name)]


@pytest.mark.parametrize("name", OWN)
def test_no_cross_join_python_step_or_unpartitioned_window(spark, sf, nothing_is_small, name):
    plan = plan_of(entry_points.queries()[name](spark, sf))
    for step in ("CartesianProduct", "NestedLoop", "Python", "MapInPandas"):
        assert step not in plan
    for spec in re.findall(r"Window \[.*?\], \[(.*?)\]", plan):
        assert spec, "window without a partition"


def test_scans_read_only_what_is_needed(spark, sf):
    plan = plan_of(v.answers_multi(spark, sf))
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string,o_orderpriority:string>" in plan
    boxed = plan_of(entry_points.queries()["agg7_top_box"](spark, sf))
    assert "ReadSchema: struct<l_linenumber:int,l_quantity:double>" in boxed
    valid = entry_points.queries()["cln1_valid_sample"](spark, sf)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    pushed = re.search(r"PushedFilters: \[(.*)\]", valid).group(1)
    assert "LessThan(o_orderdate,2000-07-20T00:00)" in pushed and "GreaterThanOrEqual(o_totalprice,1000.0)" in pushed


def test_ballots_need_one_shuffle_of_the_answers(spark, sf):
    cells = tally.multi_distribution(v.answers_multi(spark, sf), "priority", v.PRIORITIES)
    exchanges = re.findall(r"Exchange (\w+)", plan_of(cells))
    # One on the respondent, then the already counted single row.
    assert exchanges == ["SinglePartition", "hashpartitioning"]


def test_crosstab_joins_respondents_without_shuffling_answers_again(spark, nothing_is_small):
    answers = spark.range(1000).select(
        F.col("id").alias("respondent_id"), F.lit("q").alias("question_id"), F.lit("a").alias("option_id")
    )
    people = spark.range(1000).select(F.col("id").alias("respondent_id"), F.lit("s").alias("segment"))
    votes = tally.ballots(answers, "q", {"a": ["a"]})
    plan = plan_of(votes.join(people, "respondent_id"))
    assert len(re.findall(r"Exchange hashpartitioning\(respondent_id", plan)) == 2


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_large_dimensions_are_salted_with_the_same_result(spark, how):
    # A third of the rows share key 0.
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 != 0, F.col("id"))
    fact = spark.range(3000).select("id", key.alias("k"))
    dim = spark.range(0, 2000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    plain = fact.join(dim, "k", how)
    salted = joins.dimension_join(fact, dim, ["k"], how, max_rows=10)
    assert "_salt" in salted._jdf.queryExecution().toString()
    cols = plain.columns
    assert sorted(map(tuple, salted.select(*cols).collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_salting_spreads_hot_and_missing_keys(spark):
    fact = spark.range(10_000).select("id", F.when(F.col("id") % 2 == 0, 0).alias("k").cast("bigint"))
    dim = spark.range(500).select(F.col("id").alias("k"))
    assert rows(joins.hot_keys(fact.filter("k is not null"), ["k"]), "k", "_salts") == {(0, 1000)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = joins.salted_join(fact, dim, ["k"]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(joined) >= 6 and max(r["count"] for r in joined) < 4_000


def test_outer_joins_that_keep_dimension_rows_are_refused(spark):
    with pytest.raises(ValueError, match="cannot salt"):
        joins.salted_join(spark.range(2), spark.range(2), ["id"], "full_outer")


def test_size_check_counts_rows_and_bytes(spark):
    dim = spark.range(100)
    assert joins.fits_broadcast(dim, max_rows=100)
    assert not joins.fits_broadcast(dim, max_rows=99)
    assert not joins.fits_broadcast(dim.withColumn("t", F.repeat(F.lit("x"), 1000)), max_bytes=50_000)
    assert joins.fits_broadcast(dim.limit(0))
    nested = dim.select(F.array(F.repeat(F.lit("x"), 1000)).alias("a"), F.lit(None).cast("string").alias("s"))
    assert joins.fits_broadcast(nested) and not joins.fits_broadcast(nested, max_bytes=50_000)


def test_one_respondent_with_a_third_of_all_rows(spark):
    n = 30_000
    answers = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("respondent_id"),
        F.lit("q").alias("question_id"),
        F.concat(F.lit("o"), F.pmod("id", F.lit(5))).alias("option_id"),
    )
    options = [f"o{i}" for i in range(5)]
    got = rows(tally.multi_distribution(answers, "q", options), "option_id", "n", "d")
    plain = tally.distribution(answers)
    assert got == rows(plain, "option_id", "n", "d")
    assert {d for _, _, d in got} == {2 * n // 3 + 1}
    # Partial aggregation leaves at most one row per task for the hot respondent.
    flags = segments.respondent_flags(answers, {"x": F.col("option_id") == "o1"})
    assert "partial_bit_or" in plan_of(flags)


def test_open_option_ranks_equal_window_ranks(spark):
    picks = spark.range(20_000).select(
        F.col("id").alias("respondent_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("question_id"),
        (F.col("id") % 997 * F.col("id") % 1009).cast("string").alias("option_id"),
    )
    cells = tally.distribution(picks)
    want = rows(order.rank_options(cells), "question_id", "option_id", "rank")
    assert rows(order.rank_open_options(cells), "question_id", "option_id", "rank") == want


def test_top_k_keeps_k_rows_before_ranking(spark, sf):
    assert plan_of(entry_points.queries()["ord7_top_k"](spark, sf)).count("WindowGroupLimit") >= 1
