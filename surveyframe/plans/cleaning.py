"""Registered queries: cleaning."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyframe.model import dimension
from surveyframe.operators import clean, tally
from surveyframe.plans import views as v
from surveyframe.plans.registry import query


@query(
    "cln1_valid_sample",
    """SELECT o_orderkey AS response_id, o_custkey AS respondent_id FROM orders
       WHERE o_orderdate < TIMESTAMP '2000-07-20' AND o_totalprice >= 1000 AND o_orderstatus <> 'P'""",
)
def cln1(spark: SparkSession, sf: str) -> DataFrame:
    responses = v.table(spark, sf, "orders").withColumnsRenamed({"o_orderkey": "response_id", "o_custkey": "respondent_id"})
    rule = (F.col("o_totalprice") >= 1000) & (F.col("o_orderstatus") != "P")
    kept = clean.valid_sample(responses, "o_orderdate", dt.datetime(2000, 7, 20), rule)
    return kept.select("response_id", "respondent_id")


@query(
    "cln2_redact_identifiers",
    """SELECT doc_id, md5(clean) AS text_md5, length(clean)::INT AS n_chars_left,
              (length(clean) - length(replace(clean, '[email]', ''))) // 7 AS n_emails,
              (length(clean) - length(replace(clean, '[phone]', ''))) // 7 AS n_phones
       FROM (SELECT doc_id, regexp_replace(regexp_replace(text,
                 '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+', '[email]', 'g'),
                 '(\\+[0-9]{1,3}[- ]?)?([0-9]{1,3} )?\\([0-9]{2,4}\\) ?[0-9]{3,4}[- ][0-9]{3,4}|\\+[0-9]{1,3}([- .][0-9]{1,4}){2,4}|\\b[0-9]{3,4}-[0-9]{3}-[0-9]{3,4}\\b', '[phone]', 'g') AS clean
             FROM documents)""",
)
def cln2(spark: SparkSession, sf: str) -> DataFrame:
    docs = clean.redact_identifiers(v.table(spark, sf, "documents"), drop=["source"], text=["text"])

    def marks(mark: str) -> Column:
        lost = F.length("text") - F.length(F.replace("text", F.lit(mark), F.lit("")))
        return F.floor(lost / len(mark))

    return docs.select(
        "doc_id",
        F.md5("text").alias("text_md5"),
        F.length("text").alias("n_chars_left"),
        marks("[email]").alias("n_emails"),
        marks("[phone]").alias("n_phones"),
    )


_PUT_TO = [("sector", "never"), ("sector", "aware"), ("sector", "done"), ("home", "done"), ("priority", "aware"), ("priority", "done")]


@query(
    "cln3_question_base",
    f"""WITH {v.SQL_LAYER}, {v.SQL_ANSWERS}, q(question_id, segment) AS (VALUES {", ".join(map(str, _PUT_TO))})
        SELECT q.question_id, count(DISTINCT l.respondent_id) AS asked, count(DISTINCT a.respondent_id) AS d
        FROM q JOIN layer l USING (segment)
        LEFT JOIN answers a ON a.respondent_id = l.respondent_id AND a.question_id = q.question_id GROUP BY 1""",
)
def cln3(spark: SparkSession, sf: str) -> DataFrame:
    questions = dimension(spark, question_id=[q for q, _ in _PUT_TO], segment=[s for _, s in _PUT_TO])
    return clean.base_of(v.answers(spark, sf), v.respondents(spark, sf), questions)


@query(
    "cln4_collapse_options",
    v.distribution_sql(
        "coalesce((SELECT group_id FROM groups g WHERE g.option_id = answers.option_id AND question_id = 'home'), option_id)",
        """, groups AS (SELECT n_nationkey::VARCHAR AS option_id,
          CASE WHEN n_nationkey >= 10 THEN 'Other ' || r_name ELSE n_name END AS group_id
          FROM nation JOIN region ON n_regionkey = r_regionkey)""",
    ),
)
def cln4(spark: SparkSession, sf: str) -> DataFrame:
    regions = v.table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    group = F.when(F.col("n_nationkey") >= 10, F.concat(F.lit("Other "), "r_name")).otherwise(F.col("n_name"))
    mapping = (
        v.table(spark, sf, "nation")
        .join(regions, "n_regionkey")
        .select(F.lit("home").alias("question_id"), F.col("n_nationkey").cast("string").alias("option_id"), group.alias("group_id"))
    )
    return tally.distribution(clean.collapse(v.answers(spark, sf), mapping))


_KNOWN = {"priority": v.PRIORITIES[:3], "sector": v.SECTORS[:4]}
_IS_KNOWN = " OR ".join(f"(question_id = '{q}' AND option_id IN {options})" for q, options in _KNOWN.items())


def _catalogue(spark: SparkSession) -> DataFrame:
    pairs = [(q, o) for q, options in _KNOWN.items() for o in options]
    return dimension(spark, question_id=[q for q, _ in pairs], option_id=[o for _, o in pairs])


@query("cln5_pool_writeins", v.distribution_sql(f"CASE WHEN {_IS_KNOWN} THEN option_id ELSE 'Other' END"))
def cln5_pool(spark: SparkSession, sf: str) -> DataFrame:
    return tally.distribution(clean.pool_writeins(v.answers(spark, sf), _catalogue(spark)))


@query(
    "cln5_keep_writeins",
    f"""WITH {v.SQL_ANSWERS}
        SELECT question_id, option_id, NOT ({_IS_KNOWN}) AS is_writein, count(*) AS n FROM answers GROUP BY 1, 2, 3""",
)
def cln5_keep(spark: SparkSession, sf: str) -> DataFrame:
    kept = clean.pool_writeins(v.answers(spark, sf), _catalogue(spark), keep=True)
    kept = kept.filter(F.col("option_id").isNotNull())
    return kept.groupBy("question_id", "option_id", "is_writein").agg(F.count_distinct("respondent_id").alias("n"))


@query(
    "cln6_split_multi",
    """WITH p AS (SELECT o_orderkey, unnest([o_orderpriority, o_orderstatus]) AS option_id FROM orders)
       SELECT option_id, count(*) AS n, count(DISTINCT o_orderkey) AS n_cells FROM p GROUP BY 1""",
)
def cln6(spark: SparkSession, sf: str) -> DataFrame:
    cells = v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("respondent_id"),
        F.concat_ws(" ; ", "o_orderpriority", "o_orderstatus", "o_orderpriority", F.lit("")).alias("cell"),
    )
    return (
        clean.split_multi(cells, "cell", ";")
        .groupBy("option_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("respondent_id").alias("n_cells"))
    )


@query(
    "cln7_cap_violations",
    f"""WITH {v.SQL_PICKS}
        SELECT 'priority' AS question_id, respondent_id, count(*) AS n_picks, 3::BIGINT AS max_choices
        FROM picks GROUP BY 2 HAVING count(*) > 3""",
)
def cln7(spark: SparkSession, sf: str) -> DataFrame:
    caps = dimension(spark, question_id=["priority", "sector", "home"], max_choices=[3, 1, 1])
    return clean.cap_violations(v.answers(spark, sf), caps)


@query(
    "cln6_long_answers",
    """WITH w AS (SELECT *, CASE WHEN o_totalprice >= 1000 THEN least(5, ceil(o_totalprice / 100000))::INT END AS score FROM orders),
            a AS (SELECT o_orderkey AS r, 'o_orderstatus' AS question_id, o_orderstatus AS option_id, NULL::INT AS value FROM w
                  UNION ALL SELECT o_orderkey, 'tags', unnest([o_orderpriority, o_orderstatus]), NULL FROM w
                  UNION ALL SELECT o_orderkey, 'score', NULL, score FROM w WHERE score IS NOT NULL)
       SELECT question_id, option_id, value, count(*) AS n, count(DISTINCT r) AS people FROM a GROUP BY 1, 2, 3""",
)
def cln6_long(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice")
    wide = v.table(spark, sf, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        F.concat_ws(";", "o_orderpriority", "o_orderstatus", "o_orderpriority").alias("tags"),
        F.when(price >= 1000, F.least(F.lit(5), F.ceil(price / 100000))).alias("score"),
    )
    answers = clean.long_answers(wide, "o_orderkey", single=["o_orderstatus"], multi=["tags"], ratings=["score"])
    return answers.groupBy("question_id", "option_id", "value").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("respondent_id").alias("people")
    )


@query(
    "cln7_cap_breaches",
    f"""WITH {v.SQL_LAYER}, {v.SQL_ANSWERS}
        SELECT question_id, l.home, segment, count(*) AS n_picks, count(DISTINCT respondent_id) AS d, 2::BIGINT AS max_choices
        FROM answers JOIN layer l USING (respondent_id) WHERE question_id <> 'home'
        GROUP BY ALL HAVING count(*) > 2 * count(DISTINCT respondent_id)""",
)
def cln7_breaches(spark: SparkSession, sf: str) -> DataFrame:
    """Result tables per nation and segment held against a cap of 2; the single-answer question cannot breach it."""
    answers = v.answers(spark, sf)
    people = v.respondents(spark, sf).select("respondent_id", "home", "segment")
    catalogue = {"priority": v.PRIORITIES, "sector": v.SECTORS}
    stacked = tally.tally_catalogue(answers, catalogue, people, ["home", "segment"])
    caps = dimension(spark, question_id=["priority", "sector"], max_choices=[2, 2])
    return clean.cap_breaches(stacked, caps, ["question_id", "home", "segment"])
