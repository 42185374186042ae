"""The given star schema, events and texts seen as a survey.

Every view is a lazy projection or aggregation over whole tables. The SQL
fragments say the same for the comparison queries.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyframe.functions.expressions import one_decimal_text, share, whole_percent
from surveyframe.operators.segments import assign_layer
from surveyframe.operators.tally import ballots, tally_ballots

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
ESCAPE = "4-NOT SPECIFIED"
SECTORS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
EVENT_TYPES = ("view", "click", "purchase", "signup", "error")
SEGMENTS = ("never", "aware", "done")
CONTACT_FROM = dt.datetime(2000, 7, 1)
THEN, NOW = "2024-01-01", "2024-01-30"
NO_ANSWER_BELOW = 5.0
CODEBOOK = (
    ("contact", ["@", "555-"]),
    ("license", ["license", "licence", "copyright"]),
    ("secret", ["token", "secret"]),
    ("number", r"[0-9]{16}"),
    ("noise", ["%%%", "$$$", "###"]),
)


# The given tables, declared so that reading one needs no job to look into its files.
TABLES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf}/{name}.parquet")


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("respondent_id"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("home"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("sector"),
    )


def contacts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("respondent_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderdate").alias("day"),
        F.col("o_totalprice").alias("price"),
    )


def respondents(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with their layer from contacts since mid-2000."""
    recent = contacts(spark, sf).filter(F.col("day") >= F.lit(str(CONTACT_FROM)).cast("timestamp_ntz"))
    rules = [("aware", F.col("status").isNotNull()), ("done", F.col("status") == "F")]
    return assign_layer(customers(spark, sf), recent.select("respondent_id", "status"), rules, "never")


def answers_multi(spark: SparkSession, sf: str) -> DataFrame:
    """Multi-answer question: priorities a customer's finished orders had.

    Other orders are rows without an answer: the question was put, no option given.
    """
    return contacts(spark, sf).select(
        "respondent_id",
        F.lit("priority").alias("question_id"),
        F.when(F.col("status") == "F", F.col("priority")).alias("option_id"),
    )


def answers_single(spark: SparkSession, sf: str) -> DataFrame:
    """Single-answer question: the customer's sector."""
    return customers(spark, sf).select(
        "respondent_id", F.lit("sector").alias("question_id"), F.col("sector").alias("option_id")
    )


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """The whole long answer table: sector and home of each customer, priorities of finished orders."""
    single = F.array(
        F.struct(F.lit("sector").alias("question_id"), F.col("sector").alias("option_id")),
        F.struct(F.lit("home").alias("question_id"), F.col("home").cast("string").alias("option_id")),
    )
    return customers(spark, sf).select("respondent_id", F.inline(single)).unionByName(answers_multi(spark, sf))


def answers_waves(spark: SparkSession, sf: str) -> DataFrame:
    """Event types per user and day; the day is the wave."""
    return wave_rows(table(spark, sf, "events"), [THEN, NOW])


def wave_rows(events: DataFrame, days: Sequence[str]) -> DataFrame:
    """Rows of the named days only: ranges of the time itself, which reach the scan, come before the day's name.

    An event without a positive value is a contact that left no answer.
    """
    day = [dt.date.fromisoformat(d) for d in days]
    at = lambda d: F.lit(f"{d} 00:00:00").cast("timestamp_ntz")
    inside = [(F.col("ts") >= at(d)) & (F.col("ts") < at(d + dt.timedelta(days=1))) for d in day]
    return events.filter(reduce(Column.__or__, inside)).select(
        F.col("user_id").alias("respondent_id"),
        F.lit("activity").alias("question_id"),
        F.when(F.col("value") >= NO_ANSWER_BELOW, F.col("event_type")).alias("option_id"),
        F.to_date("ts").cast("string").alias("wave"),
    )


def ratings(spark: SparkSession, sf: str, item: str = "l_linenumber") -> DataFrame:
    """Scores 1 to 5 from order quantities; one line is one rating."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("respondent_id"),
        F.col(item).alias("item"),
        F.ceil(F.col("l_quantity") / 10).cast("int").alias("value"),
        F.col("l_returnflag").alias("grp"),
    )


def kano_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Answer pairs, skewed by topic and segment; one line is one pair."""
    k = F.round(F.col("l_discount") * 100).cast("int")
    limit = F.when(F.col("l_returnflag") == "A", 3).when(F.col("l_returnflag") == "N", 6).otherwise(9)
    functional = F.ceil((F.col("l_quantity") - 5 * F.col("l_linenumber")) / 6)
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("respondent_id"),
        F.col("l_linenumber").alias("topic"),
        F.col("l_returnflag").alias("segment"),
        F.least(F.lit(5), F.greatest(F.lit(1), functional)).cast("int").alias("functional"),
        F.when(k >= limit, 5).otherwise(k % 4 + 1).alias("dysfunctional"),
    )


def sector_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Sector distribution of each nation; the nation is the question."""
    answers = answers_single(spark, sf)
    votes = ballots(answers, "sector", {s: [s] for s in SECTORS}).join(
        customers(spark, sf).select("respondent_id", "home"), "respondent_id"
    )
    return tally_ballots(votes, SECTORS, ["home"]).withColumnRenamed("home", "question_id")


def customer_results(spark: SparkSession, sf: str) -> DataFrame:
    """Per customer: orders finished, and urgent orders, over all orders."""
    done, urgent = F.count_if(F.col("status") == "F"), F.count_if(F.col("priority") == "1-URGENT")
    return (
        contacts(spark, sf)
        .groupBy("respondent_id")
        .agg(F.count(F.lit(1)).alias("d"), done.alias("n_done"), urgent.alias("n_urgent"))
    )


def results_long(spark: SparkSession, sf: str) -> DataFrame:
    """The same as result rows, one per customer and question."""
    rows = F.array(
        F.struct(F.lit("finished").alias("question_id"), F.col("n_done").alias("n")),
        F.struct(F.lit("urgent").alias("question_id"), F.col("n_urgent").alias("n")),
    )
    return customer_results(spark, sf).select(
        F.col("respondent_id").cast("string").alias("option_id"), "d", F.inline(rows)
    )


def report(spark: SparkSession, sf: str) -> DataFrame:
    """One report paragraph per customer quoting two shares.

    Where urgent orders outnumber finished ones, the first share is misprinted
    one point too high.
    """
    d = F.col("d")
    finished = share("n_done", "d")
    misprint = F.when(F.col("n_urgent") > F.col("n_done"), 1).otherwise(0)
    first = F.concat((whole_percent(finished) + misprint).cast("string"), F.lit("%"))
    return customer_results(spark, sf).select(
        F.col("respondent_id").alias("doc_id"),
        F.concat(
            F.lit("Finished: "),
            first,
            F.concat(F.lit(" ("), F.col("n_done").cast("string"), F.lit("/"), d.cast("string"), F.lit("); urgent: ")),
            one_decimal_text(share("n_urgent", "d")),
            F.concat(F.lit("（"), F.col("n_urgent").cast("string"), F.lit(" / "), d.cast("string"), F.lit("）.")),
        ).alias("text"),
    )


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("respondent_id"), "text", "lang")


# --- the same views in SQL, as common table expressions -----------------------

SQL_LAYER = """layer AS (
  SELECT c_custkey AS respondent_id, c_nationkey AS home, c_acctbal AS balance, c_mktsegment AS sector,
         CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') > 0 THEN 'done'
              WHEN count(o_orderkey) > 0 THEN 'aware' ELSE 'never' END AS segment
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-07-01'
  GROUP BY ALL)"""
SQL_PICKS = """picks AS (
  SELECT DISTINCT o_custkey AS respondent_id, o_orderpriority AS option_id FROM orders WHERE o_orderstatus = 'F')"""
SQL_ANSWERS = """answers AS (
  SELECT c_custkey AS respondent_id, 'sector' AS question_id, c_mktsegment AS option_id FROM customer
  UNION ALL SELECT c_custkey, 'home', c_nationkey::VARCHAR FROM customer
  UNION ALL SELECT DISTINCT o_custkey, 'priority', o_orderpriority FROM orders WHERE o_orderstatus = 'F')"""
SQL_PRIORITIES = """opts(ord, option_id) AS (
  VALUES (1, '1-URGENT'), (2, '2-HIGH'), (3, '3-MEDIUM'), (4, '4-NOT SPECIFIED'), (5, '5-LOW'))"""
SQL_SECTORS = """opts(ord, option_id) AS (
  VALUES (1, 'AUTOMOBILE'), (2, 'BUILDING'), (3, 'FURNITURE'), (4, 'HOUSEHOLD'), (5, 'MACHINERY'))"""
SQL_SEGMENTS = "segs(segment_ord, segment) AS (VALUES (1, 'never'), (2, 'aware'), (3, 'done'))"
SQL_CROSSTAB = f"""{SQL_LAYER}, {SQL_PICKS}, {SQL_PRIORITIES}, {SQL_SEGMENTS},
crosstab AS (
  SELECT 'priority' AS question_id, s.segment, s.segment_ord, o.option_id, o.ord,
         count(p.respondent_id) AS n, any_value(b.d) AS d, count(p.respondent_id) / nullif(any_value(b.d), 0) AS pct
  FROM segs s CROSS JOIN opts o
  LEFT JOIN (SELECT segment, count(DISTINCT respondent_id) AS d FROM picks JOIN layer USING (respondent_id) GROUP BY 1) b
    ON b.segment = s.segment
  LEFT JOIN (SELECT * FROM picks JOIN layer USING (respondent_id)) p
    ON p.segment = s.segment AND p.option_id = o.option_id
  GROUP BY 1, 2, 3, 4, 5)"""
SQL_SECTOR_CELLS = f"""{SQL_SECTORS}, cells AS (
  SELECT question_id, option_id, ord, count(c.c_custkey) AS n, any_value(d) AS d,
         count(c.c_custkey) / any_value(d) AS pct
  FROM (SELECT c_nationkey AS question_id, count(*) AS d FROM customer GROUP BY 1) b CROSS JOIN opts o
  LEFT JOIN customer c ON c.c_nationkey = b.question_id AND c.c_mktsegment = o.option_id
  GROUP BY 1, 2, 3)"""
SQL_RATINGS = """ratings AS (
  SELECT l_orderkey AS respondent_id, l_linenumber AS item, l_partkey AS part, l_returnflag AS grp,
         ceil(l_quantity / 10)::INT AS value FROM lineitem)"""
SQL_KANO = """lines AS (
  SELECT l_orderkey AS respondent_id, l_linenumber AS topic, l_returnflag AS segment,
         least(5, greatest(1, ceil((l_quantity - 5 * l_linenumber) / 6)))::INT AS f,
         CASE WHEN round(l_discount * 100)::INT >= CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 6 ELSE 9 END
              THEN 5 ELSE round(l_discount * 100)::INT % 4 + 1 END AS g
  FROM lineitem)"""
SQL_KANO_CLASS = """kinds(f, g, kind) AS (
  VALUES (1,1,'Q'),(1,2,'A'),(1,3,'A'),(1,4,'A'),(1,5,'O'),(2,1,'R'),(2,2,'I'),(2,3,'I'),(2,4,'I'),(2,5,'M'),
         (3,1,'R'),(3,2,'I'),(3,3,'I'),(3,4,'I'),(3,5,'M'),(4,1,'R'),(4,2,'I'),(4,3,'I'),(4,4,'I'),(4,5,'M'),
         (5,1,'R'),(5,2,'R'),(5,3,'R'),(5,4,'R'),(5,5,'Q'))"""
SQL_KANO_COUNTS = """count(*) FILTER (WHERE kind = 'A') AS n_a, count(*) FILTER (WHERE kind = 'O') AS n_o,
  count(*) FILTER (WHERE kind = 'M') AS n_m, count(*) FILTER (WHERE kind = 'I') AS n_i,
  count(*) FILTER (WHERE kind = 'R') AS n_r, count(*) FILTER (WHERE kind = 'Q') AS n_q,
  count(kind) AS answered, count(*) FILTER (WHERE kind IN ('A', 'O', 'M', 'I')) AS valid"""
SQL_CUSTOMER_RESULTS = """customer_results AS (
  SELECT o_custkey AS respondent_id, count(*) AS d, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_done,
         count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent
  FROM orders GROUP BY 1)"""
SQL_RESULTS_LONG = f"""{SQL_CUSTOMER_RESULTS}, results AS (
  SELECT respondent_id::VARCHAR AS option_id, d, 'finished' AS question_id, n_done AS n FROM customer_results
  UNION ALL SELECT respondent_id::VARCHAR, d, 'urgent', n_urgent FROM customer_results)"""
SQL_REPORT = f"""{SQL_CUSTOMER_RESULTS}, report AS (
  SELECT respondent_id AS doc_id, 'Finished: '
    || (floor(n_done / d * 100 + 0.5)::BIGINT + CASE WHEN n_urgent > n_done THEN 1 ELSE 0 END)::VARCHAR || '% ('
    || n_done || '/' || d || '); urgent: '
    || (floor(n_urgent / d * 1000 + 0.5)::BIGINT // 10)::VARCHAR || '.'
    || (floor(n_urgent / d * 1000 + 0.5)::BIGINT % 10)::VARCHAR || '%（' || n_urgent || ' / ' || d || '）.' AS text
  FROM customer_results)"""
CLAIM_SQL = "([0-9]+(?:\\.[0-9]+)?)\\s*%\\s*[(（]\\s*([0-9]+)\\s*/\\s*([0-9]+)\\s*[)）]"
SQL_CLAIMS = f"""{SQL_REPORT}, found AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '{CLAIM_SQL}')) AS claim,
         generate_subscripts(regexp_extract_all(text, '{CLAIM_SQL}'), 1) AS pos
  FROM report),
claims AS (
  SELECT doc_id, pos::INT AS pos, claim, regexp_extract(claim, '{CLAIM_SQL}', 1)::DOUBLE AS pct,
         length(regexp_extract(claim, '^[0-9]+\\.([0-9]+)', 1))::INT AS decimals,
         regexp_extract(claim, '{CLAIM_SQL}', 2)::BIGINT AS n, regexp_extract(claim, '{CLAIM_SQL}', 3)::BIGINT AS d
  FROM found)"""


def distribution_sql(option: str = "option_id", extra: str = "") -> str:
    """Distribution of every question after mapping each option to ``option``."""
    return f"""WITH {SQL_ANSWERS}{extra},
a AS (SELECT DISTINCT respondent_id, question_id, {option} AS option_id FROM answers)
SELECT question_id, option_id, count(*) AS n, any_value(d) AS d, count(*) / any_value(d) AS pct
FROM a JOIN (SELECT question_id, count(DISTINCT respondent_id) AS d FROM a GROUP BY 1) USING (question_id) GROUP BY 1, 2"""


def paragraphs_sql(expr: str = "text", name: str = "paras") -> str:
    lines = f"list_filter(list_transform(string_split({expr}, chr(10)), lambda x: trim(x, chr(9) || chr(13) || ' ')), lambda x: x <> '')"
    return f"""{name} AS (
  SELECT doc_id, unnest({lines}) AS text, generate_subscripts({lines}, 1) AS para_no FROM documents)"""
