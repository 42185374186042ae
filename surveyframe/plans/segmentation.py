"""Registered queries: segments and derived variables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyframe.model import dimension
from surveyframe.operators import segments
from surveyframe.plans import views as v
from surveyframe.plans.registry import query


@query("seg1_assign_layer", f"WITH {v.SQL_LAYER} SELECT respondent_id, segment FROM layer")
def seg1(spark: SparkSession, sf: str) -> DataFrame:
    return v.respondents(spark, sf).select("respondent_id", "segment")


@query(
    "seg2_rollup_layer",
    f"""WITH {v.SQL_LAYER}
        SELECT CASE WHEN segment = 'never' THEN 'never' ELSE 'had contact' END AS segment_group, count(*) AS n
        FROM layer GROUP BY 1""",
)
def seg2(spark: SparkSession, sf: str) -> DataFrame:
    mapping = dimension(spark, segment=["aware", "done"], segment_group=["had contact"] * 2)
    rolled = segments.rollup_layer(v.respondents(spark, sf), mapping)
    return rolled.groupBy("segment_group").agg(F.count(F.lit(1)).alias("n"))


@query(
    "seg3_bands",
    """SELECT CASE WHEN c_acctbal <= 0 THEN 'none' WHEN c_acctbal <= 5000 THEN 'middle' ELSE 'high' END AS band,
              count(*) AS n FROM customer GROUP BY 1""",
)
def seg3(spark: SparkSession, sf: str) -> DataFrame:
    banded = segments.band(v.customers(spark, sf), "balance", [0.0, 5000.0], ["none", "middle", "high"])
    return banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query(
    "seg4_any_of",
    f"""WITH {v.SQL_PICKS}
        SELECT respondent_id, bool_or(option_id IN ('1-URGENT', '2-HIGH')) AS holds FROM picks GROUP BY 1""",
)
def seg4(spark: SparkSession, sf: str) -> DataFrame:
    return segments.any_of(v.answers_multi(spark, sf), "priority", ["1-URGENT", "2-HIGH"])


@query(
    "seg5_role_groups",
    f"""WITH {v.SQL_PICKS},
        m AS (SELECT respondent_id, bool_or(option_id = '1-URGENT') AS a, bool_or(option_id = '2-HIGH') AS b
              FROM picks GROUP BY 1)
        SELECT c_custkey AS respondent_id, CASE WHEN a THEN 'started' WHEN b THEN 'joined' ELSE 'none' END AS role
        FROM customer LEFT JOIN m ON respondent_id = c_custkey""",
)
def seg5(spark: SparkSession, sf: str) -> DataFrame:
    rules = [("started", F.col("option_id") == "1-URGENT"), ("joined", F.col("option_id") == "2-HIGH")]
    grouped = segments.assign_role_group(v.customers(spark, sf), v.answers_multi(spark, sf), rules, "none")
    return grouped.select("respondent_id", "role")


@query(
    "seg6_recency_bands",
    """WITH r AS (SELECT c_custkey, max(o_orderdate)::DATE AS last_contact
                  FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate::DATE <= DATE '2001-03-31'
                  GROUP BY 1)
       SELECT CASE WHEN last_contact IS NULL THEN 'never'
                   WHEN last_contact >= DATE '2001-02-28' THEN 'within 1 month'
                   WHEN last_contact >= DATE '2000-09-30' THEN '1 to 6 months'
                   WHEN last_contact >= DATE '2000-03-31' THEN '7 to 12 months'
                   ELSE 'over 12 months' END AS recency, count(*) AS n
       FROM r GROUP BY 1""",
)
def seg6(spark: SparkSession, sf: str) -> DataFrame:
    banded = segments.recency_band(v.customers(spark, sf), v.contacts(spark, sf), "day", dt.date(2001, 3, 31))
    return banded.groupBy("recency").agg(F.count(F.lit(1)).alias("n"))


@query(
    "idx1_depth_index",
    f"""WITH {v.SQL_LAYER}, {v.SQL_PICKS},
        depth AS (SELECT respondent_id, max(CASE WHEN option_id <> '4-NOT SPECIFIED' THEN left(option_id, 1)::INT END) AS depth
                  FROM picks GROUP BY 1)
        SELECT segment, count(depth) AS d, count(*) AS answered, sum(depth) / count(depth) AS mean_depth
        FROM depth JOIN layer USING (respondent_id) GROUP BY 1""",
)
def idx1(spark: SparkSession, sf: str) -> DataFrame:
    options = dimension(
        spark, option_id=v.PRIORITIES, ord=[1, 2, 3, 4, 5], is_escape=[o == v.ESCAPE for o in v.PRIORITIES]
    )
    depths = segments.depth_index(v.answers(spark, sf), "priority", options)
    return segments.mean_depth(depths, v.respondents(spark, sf))
