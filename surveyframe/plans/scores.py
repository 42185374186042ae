"""Registered queries: ratings, gaps, Kano, and the orders of their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyframe.functions import expressions as fx
from surveyframe.operators import kano, order, ratings, segments, tally
from surveyframe.plans import views as v
from surveyframe.plans.registry import query
from surveyframe.plans.tallies import agg4

_COUNTS = ", ".join(f"count(*) FILTER (WHERE value = {i}) AS c{i}" for i in range(1, 6))
_BOXES = """count(*) FILTER (WHERE value >= 3) AS n3plus, count(*) FILTER (WHERE value >= 3) / count(*) AS pct3plus,
  count(*) FILTER (WHERE value >= 4) AS n4plus, count(*) FILTER (WHERE value >= 4) / count(*) AS pct4plus"""


@query("agg6_rating_counts", f"WITH {v.SQL_RATINGS} SELECT item, {_COUNTS}, count(*) AS d FROM ratings GROUP BY 1")
def agg6(spark: SparkSession, sf: str) -> DataFrame:
    return ratings.rating_counts(v.ratings(spark, sf))


@query("agg7_top_box", f"WITH {v.SQL_RATINGS} SELECT item, count(*) AS d, {_BOXES} FROM ratings GROUP BY 1")
def agg7(spark: SparkSession, sf: str) -> DataFrame:
    return ratings.top_box(v.ratings(spark, sf))


@query(
    "agg8_top_box_by_group",
    f"""WITH {v.SQL_RATINGS}
        SELECT item, o_orderpriority AS priority, count(*) FILTER (WHERE value >= 3) AS n, count(*) AS d,
               count(*) FILTER (WHERE value >= 3) / count(*) AS pct
        FROM ratings JOIN orders ON o_orderkey = respondent_id GROUP BY 1, 2""",
)
def agg8(spark: SparkSession, sf: str) -> DataFrame:
    people = v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("respondent_id"), F.col("o_orderpriority").alias("priority")
    )
    return ratings.top_box_by(v.ratings(spark, sf), people, "priority")


_BAND = "CASE WHEN balance <= 0 THEN 'none' WHEN balance <= 5000 THEN 'middle' ELSE 'high' END"
_GAPS_SQL = f"""WITH {v.SQL_LAYER}, {v.SQL_PICKS}, {v.SQL_PRIORITIES},
p AS (SELECT respondent_id, option_id, {_BAND} AS band FROM picks JOIN layer USING (respondent_id)),
b AS (SELECT band, count(DISTINCT respondent_id) AS d FROM p GROUP BY 1),
g AS (SELECT b.band, o.option_id, ord, count(p.respondent_id) AS n, any_value(b.d) AS d, count(p.respondent_id) / any_value(b.d) AS group_pct
      FROM b CROSS JOIN opts o LEFT JOIN p ON p.band = b.band AND p.option_id = o.option_id GROUP BY 1, 2, 3),
t AS (SELECT *, sum(n) OVER (PARTITION BY option_id) / sum(d) OVER (PARTITION BY option_id) AS base_pct FROM g),
gaps AS (SELECT *, floor((group_pct - base_pct) * 100 * 100 + 0.5) / 100 AS diff_pts FROM t)"""


@query("agg9_gap_vs_overall", f"{_GAPS_SQL} SELECT * FROM gaps")
def agg9(spark: SparkSession, sf: str) -> DataFrame:
    people = segments.band(v.customers(spark, sf), "balance", [0.0, 5000.0], ["none", "middle", "high"])
    return ratings.gap_vs_overall(v.answers_multi(spark, sf), people, "priority", v.PRIORITIES, "band")


@query(
    "agg10_gap_direction",
    f"""{_GAPS_SQL} SELECT band, count(*) FILTER (WHERE diff_pts > 0) AS n_up,
        count(*) - count(*) FILTER (WHERE diff_pts > 0) AS n_down FROM gaps GROUP BY 1""",
)
def agg10(spark: SparkSession, sf: str) -> DataFrame:
    return ratings.gap_direction(agg9(spark, sf), "band")


@query(
    "ord6_order_by_gap",
    f"{_GAPS_SQL} SELECT *, row_number() OVER (PARTITION BY band ORDER BY diff_pts DESC, ord)::INT AS position FROM gaps",
)
def ord6(spark: SparkSession, sf: str) -> DataFrame:
    return order.order_by_gap(agg9(spark, sf), "band")


@query(
    "agg11_kano_class",
    f"""WITH {v.SQL_KANO}, {v.SQL_KANO_CLASS},
        pairs AS (SELECT respondent_id, topic, max(f) AS f, max(g) AS g FROM lines GROUP BY 1, 2)
        SELECT topic, {v.SQL_KANO_COUNTS} FROM pairs LEFT JOIN kinds USING (f, g) GROUP BY 1""",
)
def agg11(spark: SparkSession, sf: str) -> DataFrame:
    halves = F.array(
        *[F.struct(F.lit(h).alias("half"), F.col(h).alias("value")) for h in ("functional", "dysfunctional")]
    )
    answers = v.kano_lines(spark, sf).select("respondent_id", "topic", F.inline(halves))
    return kano.class_counts(kano.kano_pairs(answers), ["topic"])


_COEFF = "(n_a + n_o) / nullif(valid, 0) AS si, -(n_o + n_m) / nullif(valid, 0) AS dsi"
_QUADRANT = """CASE WHEN si >= 0.5 AND dsi <= -0.5 THEN 'Performance (O)' WHEN si >= 0.5 THEN 'Attractive (A)'
  WHEN dsi <= -0.5 THEN 'Must-be (M)' WHEN si IS NOT NULL THEN 'Indifferent (I)' END AS quadrant"""


def _kano_sql(group: str, names: str) -> str:
    return f"""WITH {v.SQL_KANO}, {v.SQL_KANO_CLASS},
c AS (SELECT {names}, {v.SQL_KANO_COUNTS} FROM lines LEFT JOIN kinds USING (f, g) GROUP BY {group}),
k AS (SELECT *, {_COEFF} FROM c)"""


@query("agg12_kano_coefficients", _kano_sql("topic", "topic") + " SELECT * FROM k")
def agg12(spark: SparkSession, sf: str) -> DataFrame:
    return kano.kano_coefficients(kano.class_counts(v.kano_lines(spark, sf), ["topic"]))


@query("agg13_kano_quadrant", _kano_sql("topic, segment", "topic, segment") + f" SELECT *, {_QUADRANT} FROM k")
def agg13(spark: SparkSession, sf: str) -> DataFrame:
    counts = kano.class_counts(v.kano_lines(spark, sf), ["topic", "segment"])
    return kano.kano_quadrant(kano.kano_coefficients(counts))


@query(
    "agg14_kano_by_segment",
    _kano_sql(
        "GROUPING SETS ((topic, segment), (topic))",
        "topic, CASE WHEN grouping(segment) = 1 THEN 'all' ELSE segment END AS segment",
    )
    + f" SELECT *, {_QUADRANT} FROM k",
)
def agg14(spark: SparkSession, sf: str) -> DataFrame:
    return kano.kano_by(v.kano_lines(spark, sf), "topic", "segment")


# --- windows and orders over counted cells ------------------------------------

_CELLS = f"WITH {v.SQL_SECTOR_CELLS}"
_PART = "OVER (PARTITION BY question_id)"


@query("win1_scale_to_max", f"{_CELLS} SELECT *, pct / CASE WHEN max(pct) {_PART} = 0 THEN 1 ELSE max(pct) {_PART} END AS scaled FROM cells")
def win1(spark: SparkSession, sf: str) -> DataFrame:
    return order.scale_to_max(v.sector_cells(spark, sf))


_RUNNING = "sum(n) OVER (PARTITION BY question_id ORDER BY ord ROWS UNBOUNDED PRECEDING)"


@query(
    "win2_cumulative_share",
    f"{_CELLS} SELECT *, ({_RUNNING} - n) / sum(n) {_PART} AS start_share, {_RUNNING} / sum(n) {_PART} AS end_share FROM cells",
)
def win2(spark: SparkSession, sf: str) -> DataFrame:
    return order.cumulative_share(v.sector_cells(spark, sf))


@query(
    "win3_running_offset",
    f"""WITH {v.SQL_RATINGS}, scores(score) AS (VALUES (1), (2), (3), (4), (5)),
        c AS (SELECT part AS item, count(*) AS d FROM ratings GROUP BY 1),
        s AS (SELECT c.item, d, score, count(value) AS n FROM c CROSS JOIN scores
              LEFT JOIN ratings r ON r.part = c.item AND r.value = score GROUP BY ALL)
        SELECT item, d, score, n, (sum(n) OVER (PARTITION BY item ORDER BY score ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS start_n
        FROM s""",
)
def win3(spark: SparkSession, sf: str) -> DataFrame:
    return order.running_offset(ratings.rating_counts(v.ratings(spark, sf, "l_partkey")))


@query("win4_rank_options", f"{_CELLS} SELECT *, rank() OVER (PARTITION BY question_id ORDER BY n DESC)::INT AS rank FROM cells")
def win4(spark: SparkSession, sf: str) -> DataFrame:
    return order.rank_options(v.sector_cells(spark, sf))


@query(
    "win4_rank_open_options",
    """WITH c AS (SELECT l_returnflag AS question_id, l_partkey AS option_id, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1, 2),
            b AS (SELECT l_returnflag AS question_id, count(DISTINCT l_orderkey) AS d FROM lineitem GROUP BY 1)
       SELECT question_id, option_id, n, d, n / d AS pct, rank() OVER (PARTITION BY question_id ORDER BY n DESC) AS rank
       FROM c JOIN b USING (question_id)""",
)
def win4_open(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as an open option list of each return flag."""
    picks = v.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("respondent_id"),
        F.col("l_returnflag").alias("question_id"),
        F.col("l_partkey").alias("option_id"),
    )
    return order.rank_open_options(tally.distribution(picks))


@query(
    "win2_open_cumulative_share",
    """WITH c AS (SELECT l_returnflag AS question_id, l_partkey AS option_id, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1, 2),
            b AS (SELECT l_returnflag AS question_id, count(DISTINCT l_orderkey) AS d FROM lineitem GROUP BY 1),
            r AS (SELECT question_id, option_id, n, d, n / d AS pct, row_number() OVER w AS position, sum(n) OVER w AS reached, sum(n) OVER (PARTITION BY question_id) AS total
                  FROM c JOIN b USING (question_id) WINDOW w AS (PARTITION BY question_id ORDER BY n DESC, option_id ROWS UNBOUNDED PRECEDING))
       SELECT question_id, option_id, n, d, pct, position, (reached - n) / total AS start_share, reached / total AS end_share FROM r""",
)
def win2_open(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as an open option list of each return flag, in order and with their slices."""
    picks = v.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("respondent_id"),
        F.col("l_returnflag").alias("question_id"),
        F.col("l_partkey").alias("option_id"),
    )
    return order.order_open_options(tally.distribution(picks))


def _position_sql(by: str, table: str = "cells") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY {by})::INT AS position FROM {table}"


@query("ord1_order_by_share", f"{_CELLS} {_position_sql('n DESC, ord')}")
def ord1(spark: SparkSession, sf: str) -> DataFrame:
    return order.order_by_share(v.sector_cells(spark, sf))


@query(
    "ord2_order_by_total",
    f"""WITH {v.SQL_CROSSTAB}, t AS (SELECT *, (sum(n) OVER (PARTITION BY option_id))::BIGINT AS n_total FROM crosstab)
        SELECT *, dense_rank() OVER (ORDER BY n_total DESC, ord)::INT AS position FROM t""",
)
def ord2(spark: SparkSession, sf: str) -> DataFrame:
    return order.order_by_total(agg4(spark, sf))


@query(
    "ord3_order_by_segment",
    f"""WITH {v.SQL_CROSSTAB}, t AS (
          SELECT question_id, option_id, ord, coalesce(max(pct) FILTER (WHERE segment = 'done'), 0) AS segment_pct
          FROM crosstab GROUP BY 1, 2, 3)
        {_position_sql('segment_pct DESC, ord', 't')}""",
)
def ord3(spark: SparkSession, sf: str) -> DataFrame:
    return order.order_by_segment(agg4(spark, sf), "done")


@query("ord4_order_fixed", f"{_CELLS} {_position_sql('ord')}")
def ord4(spark: SparkSession, sf: str) -> DataFrame:
    return order.order_fixed(v.sector_cells(spark, sf))


@query(
    "ord5_order_by_topbox",
    f"""WITH {v.SQL_RATINGS}, t AS (
          SELECT grp AS question_id, item AS ord, count(*) AS d, {_BOXES} FROM ratings GROUP BY 1, 2)
        {_position_sql('n3plus DESC, ord', 't')}""",
)
def ord5(spark: SparkSession, sf: str) -> DataFrame:
    boxes = ratings.top_box(v.ratings(spark, sf), by=["grp", "item"])
    return order.order_by_topbox(boxes.withColumnsRenamed({"grp": "question_id", "item": "ord"}))


@query("ord7_top_k", f"{_CELLS} SELECT * FROM ({_position_sql('n DESC, ord')}) WHERE position <= 3")
def ord7(spark: SparkSession, sf: str) -> DataFrame:
    return order.top_k(v.sector_cells(spark, sf), 3)


@query("ord8_only_segment", f"WITH {v.SQL_CROSSTAB} SELECT * FROM crosstab WHERE segment = 'aware'")
def ord8(spark: SparkSession, sf: str) -> DataFrame:
    return order.only_segment(agg4(spark, sf), "aware")


# --- printed forms ------------------------------------------------------------

_SHARES = f"WITH {v.SQL_CUSTOMER_RESULTS}, s AS (SELECT respondent_id, n_done AS n, d, n_done / d AS p FROM customer_results)"


def _shares(spark: SparkSession, sf: str) -> DataFrame:
    counted = v.customer_results(spark, sf).select("respondent_id", F.col("n_done").alias("n"), "d")
    return counted.withColumn("p", F.col("n") / F.col("d"))


@query("fn1_whole_percent", f"{_SHARES} SELECT respondent_id, floor(p * 100 + 0.5)::BIGINT AS pct0, floor(p * 100 + 0.5)::BIGINT || '%' AS printed FROM s")
def fn1(spark: SparkSession, sf: str) -> DataFrame:
    return _shares(spark, sf).select("respondent_id", fx.whole_percent(F.col("p")).alias("pct0"), fx.whole_percent_text(F.col("p")).alias("printed"))


@query(
    "fn2_one_decimal",
    f"""{_SHARES} SELECT respondent_id, floor(p * 1000 + 0.5) / 10 AS pct1,
        (floor(p * 1000 + 0.5)::BIGINT // 10) || '.' || (floor(p * 1000 + 0.5)::BIGINT % 10) || '%' AS printed FROM s""",
)
def fn2(spark: SparkSession, sf: str) -> DataFrame:
    return _shares(spark, sf).select("respondent_id", fx.one_decimal(F.col("p")).alias("pct1"), fx.one_decimal_text(F.col("p")).alias("printed"))


@query("fn3_share_with_evidence", f"{_SHARES} SELECT respondent_id, floor(p * 100 + 0.5)::BIGINT || '% (' || n || '/' || d || ')' AS printed FROM s")
def fn3(spark: SparkSession, sf: str) -> DataFrame:
    return _shares(spark, sf).select("respondent_id", fx.evidence_text(F.col("n"), F.col("d")).alias("printed"))


@query(
    "fn4_fixed_decimals",
    f"{_SHARES} SELECT respondent_id, "
    + ", ".join(f"floor(p * 1e{k} + 0.5) / 1e{k} AS p{k}" for k in (2, 3, 4, 6))
    + " FROM s",
)
def fn4(spark: SparkSession, sf: str) -> DataFrame:
    return _shares(spark, sf).select("respondent_id", *[fx.fixed(F.col("p"), k).alias(f"p{k}") for k in (2, 3, 4, 6)])
