"""Registered queries: distributions, crosstabs, set operations, shifts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyframe.model import dimension
from surveyframe.operators import membership, segments, shift, tally
from surveyframe.plans import views as v
from surveyframe.plans.registry import query
from surveyframe.session import scratch_path


@query("agg1_distribution", v.distribution_sql())
def agg1(spark: SparkSession, sf: str) -> DataFrame:
    return tally.distribution(v.answers(spark, sf))


@query(
    "agg2_multi_distribution",
    f"""WITH {v.SQL_PICKS}, {v.SQL_PRIORITIES}
        SELECT 'priority' AS question_id, option_id, ord, count(respondent_id) AS n,
               (SELECT count(DISTINCT respondent_id) FROM picks) AS d,
               count(respondent_id) / (SELECT count(DISTINCT respondent_id) FROM picks) AS pct
        FROM opts LEFT JOIN picks USING (option_id) GROUP BY ALL""",
)
def agg2(spark: SparkSession, sf: str) -> DataFrame:
    return tally.multi_distribution(v.answers_multi(spark, sf), "priority", v.PRIORITIES)


_REACH = {"pressing": ["1-URGENT", "2-HIGH"], "rest": ["3-MEDIUM", "5-LOW"], "unstated": [v.ESCAPE]}


@query(
    "agg3_net_reach",
    f"""WITH {v.SQL_PICKS}, g(ord, group_id, option_id) AS (
          VALUES (1, 'pressing', '1-URGENT'), (1, 'pressing', '2-HIGH'), (2, 'rest', '3-MEDIUM'), (2, 'rest', '5-LOW'),
                 (3, 'unstated', '4-NOT SPECIFIED'))
        SELECT 'priority' AS question_id, group_id, ord, count(DISTINCT respondent_id) AS n,
               (SELECT count(DISTINCT respondent_id) FROM picks) AS d,
               count(DISTINCT respondent_id) / (SELECT count(DISTINCT respondent_id) FROM picks) AS pct
        FROM g LEFT JOIN picks USING (option_id) GROUP BY ALL""",
)
def agg3(spark: SparkSession, sf: str) -> DataFrame:
    return tally.net_reach(v.answers_multi(spark, sf), "priority", _REACH)


@query("agg4_crosstab", f"WITH {v.SQL_CROSSTAB} SELECT * FROM crosstab")
def agg4(spark: SparkSession, sf: str) -> DataFrame:
    return tally.crosstab(
        v.answers_multi(spark, sf), v.respondents(spark, sf), "priority", v.PRIORITIES, v.SEGMENTS
    )


@query(
    "agg5_distribution_with_total",
    f"""WITH {v.SQL_LAYER}, {v.SQL_SECTORS}
        SELECT CASE WHEN grouping(segment) = 1 THEN 'all' ELSE segment END AS segment, o.option_id, ord,
               count(*) FILTER (WHERE sector = o.option_id) AS n, count(*) AS d,
               count(*) FILTER (WHERE sector = o.option_id) / count(*) AS pct
        FROM layer CROSS JOIN opts o GROUP BY GROUPING SETS ((segment, o.option_id, ord), (o.option_id, ord))""",
)
def agg5(spark: SparkSession, sf: str) -> DataFrame:
    votes = tally.ballots(v.answers_single(spark, sf), "sector", {s: [s] for s in v.SECTORS})
    people = v.respondents(spark, sf).select("respondent_id", "segment")
    return tally.distribution_with_total(votes.join(people, "respondent_id"), v.SECTORS)


@query(
    "agg16_nested_share",
    f"""WITH {v.SQL_PICKS}, f AS (
          SELECT respondent_id, bool_or(option_id IN ('1-URGENT', '2-HIGH')) AS a, bool_or(option_id = '5-LOW') AS b
          FROM picks GROUP BY 1)
        SELECT 1 AS step, count(*) FILTER (WHERE a) AS n, count(*) AS d, count(*) FILTER (WHERE a) / count(*) AS pct FROM f
        UNION ALL
        SELECT 2, count(*) FILTER (WHERE a AND NOT b), count(*) FILTER (WHERE a),
               count(*) FILTER (WHERE a AND NOT b) / count(*) FILTER (WHERE a) FROM f""",
)
def agg16(spark: SparkSession, sf: str) -> DataFrame:
    return tally.nested_share(v.answers_multi(spark, sf), "priority", ["1-URGENT", "2-HIGH"], ["5-LOW"])


@query(
    "agg17_overlap",
    f"""WITH {v.SQL_LAYER}, {v.SQL_PICKS}, m AS (
          SELECT l.respondent_id, balance > 5000 AS a, coalesce(bool_or(option_id = '1-URGENT'), false) AS b
          FROM layer l LEFT JOIN picks USING (respondent_id) GROUP BY 1, 2)
        SELECT count(*) FILTER (WHERE a AND b) AS n, count(*) FILTER (WHERE a) AS d_left, count(*) FILTER (WHERE b) AS d_right,
               count(*) FILTER (WHERE a AND b) / count(*) FILTER (WHERE a) AS pct_left,
               count(*) FILTER (WHERE a AND b) / count(*) FILTER (WHERE b) AS pct_right FROM m""",
)
def agg17(spark: SparkSession, sf: str) -> DataFrame:
    urgent = segments.any_of(v.answers_multi(spark, sf), "priority", ["1-URGENT"])
    members = v.customers(spark, sf).select("respondent_id", "balance").join(urgent, "respondent_id", "left")
    return tally.overlap(members, F.col("balance") > 5000, F.col("holds"))


@query(
    "agg20_sample_meta",
    f"""WITH {v.SQL_LAYER}
        SELECT count(*) AS n_total, count(*) FILTER (WHERE segment = 'never') AS n_never,
               count(*) FILTER (WHERE segment = 'aware') AS n_aware, count(*) FILTER (WHERE segment = 'done') AS n_done
        FROM layer""",
)
def agg20(spark: SparkSession, sf: str) -> DataFrame:
    return tally.sample_meta(v.respondents(spark, sf), v.SEGMENTS)


_SHIFT_SQL = f"""WITH e AS (
  SELECT DISTINCT user_id, event_type AS option_id, strftime(ts, '%Y-%m-%d') AS wave FROM events
  WHERE strftime(ts, '%Y-%m-%d') IN ('{v.THEN}', '{v.NOW}') AND value >= {v.NO_ANSWER_BELOW}),
both_waves AS (SELECT user_id FROM e GROUP BY 1 HAVING count(DISTINCT wave) = 2),
opts(ord, option_id) AS (VALUES (1, 'view'), (2, 'click'), (3, 'purchase'), (4, 'signup'), (5, 'error')),
c AS (SELECT option_id, ord, count(*) FILTER (WHERE wave = '{v.THEN}' AND user_id IN (FROM both_waves)) AS n_then,
             count(*) FILTER (WHERE wave = '{v.NOW}' AND user_id IN (FROM both_waves)) AS n_now,
             (SELECT count(*) FROM both_waves) AS d
      FROM opts LEFT JOIN e USING (option_id) GROUP BY ALL),
shift AS (SELECT 'activity' AS question_id, *, n_then / nullif(d, 0) AS pct_then, n_now / nullif(d, 0) AS pct_now,
                 n_now - n_then AS change,
                 CASE WHEN n_now > n_then THEN 'up' WHEN n_now < n_then THEN 'down' ELSE 'same' END AS direction FROM c)"""


@query("agg15_shift", f"{_SHIFT_SQL} SELECT * FROM shift")
def agg15(spark: SparkSession, sf: str) -> DataFrame:
    return shift.shift(v.answers_waves(spark, sf), "activity", v.THEN, v.NOW, v.EVENT_TYPES)


@query("win5_largest_drop", f"{_SHIFT_SQL} SELECT * FROM shift WHERE change < 0 AND change = (SELECT min(change) FROM shift)")
def win5(spark: SparkSession, sf: str) -> DataFrame:
    return shift.largest_drop(agg15(spark, sf))


@query(
    "joi1_dense_grid",
    f"""WITH {v.SQL_CROSSTAB}, big AS (SELECT * FROM crosstab WHERE pct >= 0.5 AND segment <> 'aware')
        SELECT c.segment, c.segment_ord, c.option_id, c.ord, coalesce(b.n, 0) AS n, c.d, coalesce(b.n, 0) / nullif(c.d, 0) AS pct
        FROM crosstab c LEFT JOIN big b ON b.segment = c.segment AND b.option_id = c.option_id""",
)
def joi1(spark: SparkSession, sf: str) -> DataFrame:
    """The majority cells of two segments; the third has none and keeps its base."""
    cells = agg4(spark, sf)
    majority = cells.filter((F.col("pct") >= 0.5) & (F.col("segment") != "aware"))
    bases = cells.groupBy("segment").agg(F.max("d").alias("d"))
    return tally.dense_grid(v.SEGMENTS, v.PRIORITIES, majority, bases)


@query(
    "set1_stack",
    f"""WITH {v.SQL_ANSWERS}, b AS (SELECT question_id, count(DISTINCT respondent_id) AS d FROM answers GROUP BY 1)
        SELECT question_id, option_id,
               row_number() OVER (PARTITION BY question_id ORDER BY option_id)::INT AS ord, count(*) AS n,
               any_value(d) AS d, count(*) / any_value(d) AS pct
        FROM answers JOIN b USING (question_id) WHERE question_id <> 'home' GROUP BY 1, 2""",
)
def set1(spark: SparkSession, sf: str) -> DataFrame:
    answers = v.answers(spark, sf)
    catalogue = {"sector": v.SECTORS, "priority": v.PRIORITIES}
    return tally.tally_catalogue(answers, catalogue)


@query(
    "set1_catalogue_by_segment",
    f"""WITH {v.SQL_ANSWERS}, {v.SQL_LAYER}, {v.SQL_SEGMENTS.split("(", 1)[0]}(segment) AS (VALUES ('never'), ('aware'), ('done'), ('elsewhere')),
        q(question_id, option_id, ord) AS (VALUES {", ".join(f"('{q}', '{o}', {i + 1})" for q, ids in (("sector", v.SECTORS), ("priority", v.PRIORITIES), ("unasked", ("x",))) for i, o in enumerate(ids))}),
        a AS (SELECT * FROM answers JOIN layer USING (respondent_id)),
        b AS (SELECT question_id, segment, count(DISTINCT respondent_id) AS d FROM a GROUP BY 1, 2)
        SELECT q.question_id, s.segment, q.option_id, q.ord, count(a.respondent_id) AS n, coalesce(any_value(b.d), 0) AS d,
               count(a.respondent_id) / nullif(any_value(b.d), 0) AS pct
        FROM q CROSS JOIN segs s LEFT JOIN b ON b.question_id = q.question_id AND b.segment = s.segment
        LEFT JOIN a ON a.question_id = q.question_id AND a.segment = s.segment AND a.option_id = q.option_id GROUP BY 1, 2, 3, 4""",
)
def set1_by(spark: SparkSession, sf: str) -> DataFrame:
    """A question nobody was asked and a segment without people keep their cells."""
    catalogue = {"sector": v.SECTORS, "priority": v.PRIORITIES, "unasked": ["x"]}
    return tally.tally_catalogue(v.answers(spark, sf), catalogue, v.respondents(spark, sf), {"segment": [*v.SEGMENTS, "elsewhere"]})


_PRESSING = [("priority", "1-URGENT"), ("priority", "2-HIGH")]
_LINE_OR_HOME = [("line", "7"), ("home", "7")]
# Homes and line numbers share their option ids.
_SETS = f"""{v.SQL_PICKS}, held AS (SELECT respondent_id, 'priority' AS question_id, option_id FROM picks
  UNION ALL SELECT DISTINCT o_custkey, 'line', l_linenumber::VARCHAR FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  UNION ALL SELECT c_custkey, 'home', c_nationkey::VARCHAR FROM customer)"""
_IN_A = "question_id = 'priority' AND option_id IN ('1-URGENT', '2-HIGH')"
_IN_B = "(question_id IN ('line', 'home') AND option_id = '7')"


def _held(spark: SparkSession, sf: str) -> DataFrame:
    lines = v.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("string").alias("option_id")
    )
    buyers = v.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("respondent_id"))
    large = lines.join(buyers, "o_orderkey").select("respondent_id", F.lit("line").alias("question_id"), "option_id")
    homes = v.customers(spark, sf).select("respondent_id", F.lit("home").alias("question_id"), F.col("home").cast("string").alias("option_id"))
    return v.answers_multi(spark, sf).unionByName(large).unionByName(homes)


@query("set2_union_respondents", f"WITH {_SETS} SELECT DISTINCT respondent_id FROM held WHERE {_IN_B}")
def set2(spark: SparkSession, sf: str) -> DataFrame:
    return tally.union_respondents(_held(spark, sf), _LINE_OR_HOME)


@query(
    "set3_except_respondents",
    f"WITH {_SETS} SELECT respondent_id FROM held WHERE {_IN_A} EXCEPT SELECT respondent_id FROM held WHERE {_IN_B}",
)
def set3(spark: SparkSession, sf: str) -> DataFrame:
    return tally.except_respondents(_held(spark, sf), _PRESSING, _LINE_OR_HOME)


@query(
    "set4_parity",
    """WITH a AS (SELECT o_custkey AS respondent_id, o_orderstatus AS option_id, count(*) AS n FROM orders GROUP BY 1, 2),
            b AS (SELECT o_custkey AS respondent_id, o_orderstatus AS option_id, count(*) AS n FROM orders
                  WHERE o_totalprice >= 2000 GROUP BY 1, 2)
       SELECT *, 'left' AS side, 1::BIGINT AS copies FROM (FROM a EXCEPT FROM b)
       UNION ALL SELECT *, 'right', 1 FROM (FROM b EXCEPT FROM a)""",
)
def set4(spark: SparkSession, sf: str) -> DataFrame:
    contacts = v.contacts(spark, sf).withColumnRenamed("status", "option_id")

    def counted(rows: DataFrame) -> DataFrame:
        return rows.groupBy("respondent_id", "option_id").agg(F.count(F.lit(1)).alias("n"))

    return tally.parity(counted(contacts), counted(contacts.filter(F.col("price") >= 2000)))


@query(
    "set5_intersect_respondents",
    f"WITH {_SETS} SELECT respondent_id FROM held WHERE {_IN_A} INTERSECT SELECT respondent_id FROM held WHERE {_IN_B}",
)
def set5(spark: SparkSession, sf: str) -> DataFrame:
    return tally.intersect_respondents(_held(spark, sf), _PRESSING, _LINE_OR_HOME)


_DECLARED = {"priority": v.PRIORITIES[:3], "sector": v.SECTORS[:4]}


@query(
    "set5_undeclared",
    f"""WITH {v.SQL_ANSWERS}, {v.SQL_LAYER}
        SELECT question_id, option_id AS name, count(*) AS n FROM answers
        WHERE NOT ({" OR ".join(f"(question_id = '{q}' AND option_id IN {ids})" for q, ids in _DECLARED.items())}) GROUP BY 1, 2
        UNION ALL SELECT NULL, segment, count(*) FROM layer WHERE segment = 'never' GROUP BY 2""",
)
def undeclared(spark: SparkSession, sf: str) -> DataFrame:
    """Options and a segment that the declared lists do not name."""
    pairs = [(q, o) for q, ids in _DECLARED.items() for o in ids]
    options = dimension(spark, question_id=[q for q, _ in pairs], option_id=[o for _, o in pairs])
    return tally.undeclared(v.answers(spark, sf), options, v.respondents(spark, sf), ["aware", "done"])


@query(
    "set5_sets_from_index",
    f"""WITH {_SETS}, a AS (SELECT DISTINCT respondent_id FROM held WHERE {_IN_A}), b AS (SELECT DISTINCT respondent_id FROM held WHERE {_IN_B}),
        x AS (SELECT a.respondent_id IS NOT NULL AS a, b.respondent_id IS NOT NULL AS b FROM a FULL JOIN b ON a.respondent_id = b.respondent_id)
        SELECT name, n FROM (SELECT count(*) AS "either", count(*) FILTER (a AND b) AS "both", count(*) FILTER (a AND NOT b) AS "pressing only",
          count(*) FILTER (b AND NOT a) AS "line or home only",
          (SELECT count(DISTINCT respondent_id) FROM held WHERE question_id = 'priority') AS "asked" FROM x)
        UNPIVOT (n FOR name IN ("either", "both", "pressing only", "line or home only", "asked"))""",
)
def set5_index(spark: SparkSession, sf: str) -> DataFrame:
    """Five set questions from one stored index, read once."""
    path = scratch_path(spark, "membership")
    membership.write_index(membership.membership_index(_held(spark, sf)), path)
    index = membership.read_index(spark, path)
    sets = {"a": _PRESSING, "b": _LINE_OR_HOME, "asked": [("priority", membership.ANYTHING)]}
    asked = {
        "either": membership.either("a", "b"),
        "both": membership.both("a", "b"),
        "pressing only": membership.without("a", "b"),
        "line or home only": membership.without("b", "a"),
        "asked": F.col("asked"),
    }
    return membership.count_sets(membership.members_of(index, sets), asked)


@query(
    "set3_except_from_index",
    f"WITH {_SETS} SELECT respondent_id FROM held WHERE {_IN_A} EXCEPT SELECT respondent_id FROM held WHERE {_IN_B}",
)
def set3_index(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "membership")
    membership.write_index(membership.membership_index(_held(spark, sf)), path)
    members = membership.members_of(membership.read_index(spark, path), {"a": _PRESSING, "b": _LINE_OR_HOME})
    return membership.list_set(members, membership.without("a", "b"))
