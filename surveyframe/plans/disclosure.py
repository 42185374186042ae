"""Registered queries: disclosure control over linked margins and combinations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyframe.operators import disclosure
from surveyframe.plans import views as v
from surveyframe.plans.registry import query

DIMS = ["home", "sector", "segment"]
ROUNDS, BOUND_ROUNDS = 16, 40  # more than it takes on the given tables; rounds at the end change nothing

_MEMBERS = """SELECT *, axis = 0 AND level & 1 > 0 OR axis = 1 AND level & 2 > 0 OR axis = 2 AND level & 4 > 0 AS total,
    CASE WHEN axis <> 0 THEN home END AS l0, CASE WHEN axis <> 1 THEN sector END AS l1, CASE WHEN axis <> 2 THEN segment END AS l2,
    level & (7 - (1 << axis)) AS rest FROM (SELECT *, unnest([0, 1, 2]) AS axis FROM {state})"""
_LINE = "PARTITION BY axis, rest, l0, l1, l2"
_START = f"""WITH {v.SQL_LAYER}, s0 AS MATERIALIZED (
  SELECT home, sector, segment, grouping(home) + 2 * grouping(sector) + 4 * grouping(segment) AS level, count(*) AS n, count(*) < 5 AS hidden
  FROM layer GROUP BY CUBE (home, sector, segment) HAVING count(*) > 0)"""


def _rounds(n: int) -> str:
    steps = []
    for i in range(n):
        steps.append(f"""s{i + 1} AS MATERIALIZED (
  WITH m AS ({_MEMBERS.format(state=f"s{i}")}),
  w AS (SELECT *, count(*) FILTER (WHERE hidden) OVER ({_LINE}) AS gone, bool_or(total) OVER ({_LINE}) AND NOT bool_and(total) OVER ({_LINE}) AS whole,
    row_number() OVER ({_LINE} ORDER BY hidden, total, n, home NULLS FIRST, sector NULLS FIRST, segment NULLS FIRST, level) AS place FROM m)
  SELECT home, sector, segment, level, any_value(n) AS n, bool_or(hidden OR gone = 1 AND whole AND place = 1) AS hidden FROM w GROUP BY 1, 2, 3, 4)""")
    return ", ".join([_START, *steps])


def _bounds(n: int, state: str) -> str:
    steps = [f"b0 AS MATERIALIZED (SELECT *, CASE WHEN hidden THEN 1 ELSE n END AS lo, CASE WHEN NOT hidden THEN n END AS hi FROM {state})"]
    for i in range(n):
        steps.append(f"""b{i + 1} AS MATERIALIZED (
  WITH m AS ({_MEMBERS.format(state=f"b{i}")}),
  w AS (SELECT *, max(CASE WHEN total THEN lo END) OVER ({_LINE}) AS t_lo, max(CASE WHEN total THEN hi END) OVER ({_LINE}) AS t_hi,
    sum(CASE WHEN NOT total THEN lo END) OVER ({_LINE}) AS p_lo, coalesce(sum(CASE WHEN NOT total THEN hi END) OVER ({_LINE}), 0) AS p_hi,
    count(*) FILTER (WHERE NOT total AND hi IS NULL) OVER ({_LINE}) AS unknown FROM m),
  c AS (SELECT *, CASE WHEN total THEN p_lo WHEN unknown - CASE WHEN hi IS NULL THEN 1 ELSE 0 END = 0 THEN t_lo - p_hi + coalesce(hi, 0) END AS c_lo,
    CASE WHEN total THEN CASE WHEN unknown = 0 THEN p_hi END ELSE t_hi - p_lo + lo END AS c_hi FROM w)
  SELECT home, sector, segment, level, any_value(n) AS n, any_value(hidden) AS hidden,
    CASE WHEN any_value(hidden) THEN greatest(any_value(lo), max(c_lo)) ELSE any_value(lo) END AS lo,
    CASE WHEN any_value(hidden) THEN least(any_value(hi), min(c_hi)) ELSE any_value(hi) END AS hi FROM c GROUP BY 1, 2, 3, 4)""")
    return ", ".join(steps)


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return v.respondents(spark, sf).groupBy(*DIMS).agg(F.count(F.lit(1)).alias("n"))


@query("aud10_protect_margins", f"{_rounds(ROUNDS)} SELECT home, sector, segment, level::INT AS level, CASE WHEN NOT hidden THEN n END AS n, hidden AS suppressed FROM s{ROUNDS}")
def aud10_margins(spark: SparkSession, sf: str) -> DataFrame:
    """Nation, sector and segment with all their totals, no line of which has a lone hidden cell."""
    return disclosure.published(disclosure.protect_margins(_cells(spark, sf), DIMS, 5))


@query(
    "aud10_attack",
    f"""{_rounds(ROUNDS)}, {_bounds(BOUND_ROUNDS, f"s{ROUNDS}")}
        SELECT home, sector, segment, level::INT AS level, lo::BIGINT AS lo, hi::BIGINT AS hi, hi IS NOT NULL AND lo = hi AS exact FROM b{BOUND_ROUNDS} WHERE hidden""",
)
def aud10_attack(spark: SparkSession, sf: str) -> DataFrame:
    """What the published cells of that table still tell about each hidden one."""
    told = disclosure.attack(disclosure.protect_margins(_cells(spark, sf), DIMS, 5), DIMS).where("hidden")
    exact = F.coalesce(F.col("lo") == F.col("hi"), F.lit(False))
    return told.select("cell.*", "lo", "hi", exact.alias("exact"))


# hides and attacks by turns until nothing is told exactly, which SQL has no loop for
@query("aud10_withstand_attack")
def aud10_safe(spark: SparkSession, sf: str) -> DataFrame:
    """The bounds of every hidden cell of a table protected against them."""
    table = disclosure.protect_margins(_cells(spark, sf), DIMS, 5, against_bounds=True)
    return disclosure.attack(table, DIMS).where("hidden").select("cell.*", "lo", "hi")


ATTRIBUTES = ["home", "sector", "segment", "band"]
_NAMED = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), ',')".format(
    ", ".join(f"CASE WHEN g{i} = 0 THEN '{a}' END" for i, a in enumerate(ATTRIBUTES))
)
_SHOWN = "list_concat({}, {}, {}, {})".format(*(f"CASE WHEN g{i} = 0 THEN [{a}::VARCHAR] ELSE [] END" for i, a in enumerate(ATTRIBUTES)))
_PARENT = " OR ".join(
    "(" + " AND ".join([f"u.g{i} = 0 AND p.g{i} = 1"] + [f"p.g{j} = u.g{j} AND p.{b} IS NOT DISTINCT FROM u.{b}" for j, b in enumerate(ATTRIBUTES) if j != i]) + ")"
    for i in range(4)
)


@query(
    "aud9_unsafe_combinations",
    f"""WITH {v.SQL_LAYER}, p AS (SELECT *, floor(balance / 1000)::INT AS band FROM layer),
        c AS (SELECT {", ".join(ATTRIBUTES)}, {", ".join(f"grouping({a}) AS g{i}" for i, a in enumerate(ATTRIBUTES))}, count(*) AS n
              FROM p GROUP BY CUBE ({", ".join(ATTRIBUTES)})),
        u AS (SELECT * FROM c WHERE n < 3 AND g0 + g1 + g2 + g3 < 4)
        SELECT {_NAMED} AS attributes, array_to_string(list_transform({_SHOWN}, lambda x: coalesce(x, '(null)')), ' | ') AS "values", n FROM u
        WHERE NOT EXISTS (SELECT 1 FROM u AS p WHERE {_PARENT})""",
)
def aud9_lattice(spark: SparkSession, sf: str) -> DataFrame:
    """The smallest combinations of four attributes that fewer than three people share."""
    people = v.respondents(spark, sf).withColumn("band", F.floor(F.col("balance") / 1000).cast("int"))
    found = disclosure.unsafe_combinations(people, ATTRIBUTES, 3)
    return found.withColumn("values", F.array_join("values", " | ", "(null)"))
