"""Registered queries: sources and sinks, as round trips through the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyframe.functions.expressions import share
from surveyframe.model import CATALOGUE_SCHEMA, RESPONSES_SCHEMA, RESULT_SCHEMA
from surveyframe.operators import kano, ratings, tally
from surveyframe.plans import views as v
from surveyframe.plans.registry import query
from surveyframe.session import scratch_path
from surveyframe.sources import nested, readers, writers


@query(
    "src1_read_responses",
    "SELECT c_custkey AS respondent_id, c_name AS name, c_nationkey AS home, c_acctbal AS balance, c_mktsegment AS sector FROM customer",
)
def src1(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "responses")
    v.customers(spark, sf).write.option("header", True).csv(path)
    return readers.read_responses(spark, path, RESPONSES_SCHEMA)


def _result_rows(spark: SparkSession, sf: str) -> DataFrame:
    return v.results_long(spark, sf).select("question_id", "option_id", "n", "d", share("n", "d").alias("pct"))


_GRADED = f"""WITH {v.SQL_RESULTS_LONG}, graded AS (
  SELECT question_id, option_id, n, d, n / d AS pct,
    CASE WHEN d >= 100 THEN 'high' WHEN d >= 30 THEN 'medium' ELSE 'low' END AS reliability,
    CASE WHEN d >= 100 THEN 'usable' WHEN d >= 30 THEN 'direction only' ELSE 'verify first' END AS decision_use,
    CASE WHEN d >= 100 THEN 'Stable for this sample' WHEN d >= 30 THEN 'Small base, read as a direction'
         ELSE 'Very small base, check again before use' END AS reading_note
  FROM results)"""


@query("src2_read_results", f"{_GRADED} SELECT question_id AS table_name, * FROM graded")
def src2(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "results")
    rows = _result_rows(spark, sf)
    for name in ("finished", "urgent"):
        writers.write_result(rows.filter(F.col("question_id") == name), f"{path}/{name}")
    return readers.read_results(spark, f"{path}/*")


@query("snk1_write_result", f"{_GRADED} SELECT * FROM graded")
def snk1(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "result")
    writers.write_result(_result_rows(spark, sf), path)
    return spark.read.schema(RESULT_SCHEMA).option("header", True).csv(path)


def _customer_figures(spark: SparkSession, sf: str) -> DataFrame:
    """A bar figure per customer with the two shares of their orders."""
    cells = v.results_long(spark, sf).select(
        F.concat(F.lit("fig"), "option_id").alias("figure_id"),
        F.when(F.col("question_id") == "finished", 1).otherwise(2).cast("bigint").alias("ord"),
        F.col("question_id").alias("label"),
        "n",
        "d",
        share("n", "d").alias("pct"),
        F.lit("hbar").alias("type"),
    )
    return writers.nest_items(cells, ["figure_id", "type"], ["label", "n", "d", "pct"])


_FLAT = f"""WITH {v.SQL_RESULTS_LONG}
  SELECT 'fig' || option_id AS figure_id, CASE question_id WHEN 'finished' THEN 1 ELSE 2 END AS pos,
         question_id AS label, n / d AS pct, n, d FROM results"""


@query("snk2_write_catalogue", _FLAT)
def snk2(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "catalogue")
    writers.write_catalogue(_customer_figures(spark, sf), path)
    return writers.flatten_figure(spark.read.schema(CATALOGUE_SCHEMA).json(path), "hbar")


@query("src3_read_catalogue", _FLAT)
def src3(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "assignments")
    writers.write_catalogue(_customer_figures(spark, sf), path, assign="window.FIGURES")
    return writers.flatten_figure(readers.read_catalogue(spark, path, CATALOGUE_SCHEMA), "hbar")


@query("src3_read_split_catalogue", _FLAT)
def src3_split(spark: SparkSession, sf: str) -> DataFrame:
    """From indented files, whose records span many lines."""
    path = scratch_path(spark, "indented")
    nested.write_pretty_catalogue(_customer_figures(spark, sf), path, "window.FIGURES", files=4)
    return writers.flatten_figure(nested.read_split_catalogue(spark, path, CATALOGUE_SCHEMA), "hbar")


@query(
    "src4_read_paragraphs",
    f"""WITH {v.paragraphs_sql()}
        SELECT doc_id::VARCHAR AS doc, para_no::INT AS para_no, md5(text) AS text_md5 FROM paras""",
)
def src4(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "reports")
    docs = v.table(spark, sf, "documents")
    docs.select(F.concat_ws("\n", F.col("doc_id").cast("string"), "text")).write.option("lineSep", "\x1e").text(path)
    rows = readers.read_paragraphs(spark, path, record_sep="\x1e")
    return rows.select("doc", "para_no", F.md5("text").alias("text_md5"))


@query("snk3_flatten_items", _FLAT)
def snk3_items(spark: SparkSession, sf: str) -> DataFrame:
    return writers.flatten_figure(_customer_figures(spark, sf), "hbar")


@query(
    "snk3_flatten_ratings",
    f"""WITH {v.SQL_RATINGS}
        SELECT 'rating ' || part AS figure_id, row_number() OVER (PARTITION BY part ORDER BY grp)::INT AS pos, grp AS label,
               count(*) FILTER (WHERE value >= 3) AS n3plus, count(*) FILTER (WHERE value >= 3) / count(*) AS pct3plus,
               count(*) FILTER (WHERE value >= 4) AS n4plus, count(*) FILTER (WHERE value >= 4) / count(*) AS pct4plus,
               count(*) AS d FROM ratings GROUP BY part, grp""",
)
def snk3_ratings(spark: SparkSession, sf: str) -> DataFrame:
    boxes = ratings.top_box(v.ratings(spark, sf, "l_partkey"), by=["item", "grp"])
    cells = boxes.select(
        F.concat(F.lit("rating "), "item").alias("figure_id"),
        F.lit("stacked-hbar").alias("type"),
        F.ascii("grp").cast("bigint").alias("ord"),
        F.col("grp").alias("label"),
        "n3plus",
        "pct3plus",
        "n4plus",
        "pct4plus",
        "d",
    )
    nested = writers.nest_items(cells, ["figure_id", "type"], ["label", "n3plus", "pct3plus", "n4plus", "pct4plus", "d"])
    return writers.flatten_figure(nested, "stacked-hbar")


@query(
    "snk3_flatten_segments",
    f"""WITH {v.SQL_LAYER}, {v.SQL_SEGMENTS}, {v.SQL_SECTORS}, b AS (SELECT home, segment, count(*) AS d FROM layer GROUP BY 1, 2)
        SELECT 'home ' || b.home AS figure_id, ord AS pos, option_id AS label, segment_ord, b.segment,
               count(l.respondent_id) AS n, any_value(d) AS d, count(l.respondent_id) / any_value(d) AS pct
        FROM b JOIN segs ON segs.segment = b.segment CROSS JOIN opts
        LEFT JOIN layer l ON l.home = b.home AND l.segment = b.segment AND l.sector = option_id GROUP BY 1, 2, 3, 4, 5""",
)
def snk3_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Sectors by segment, one figure per nation; a segment nobody there belongs to has no cells."""
    votes = tally.ballots(v.answers(spark, sf), "sector", {s: [s] for s in v.SECTORS})
    people = v.respondents(spark, sf).select("respondent_id", "home", "segment")
    cells = tally.tally_ballots(votes.join(people, "respondent_id"), v.SECTORS, ["home", "segment"])
    named = cells.select(
        F.concat(F.lit("home "), "home").alias("figure_id"),
        F.lit("grouped-hbar-layers").alias("type"),
        *["segment", "option_id", "ord", "n", "d", "pct"],
    )
    nested = writers.nest_segment_cells(named, ["figure_id", "type"])
    return writers.flatten_figure(nested, "grouped-hbar-layers", v.SEGMENTS)


@query(
    "snk3_flatten_gap_panels",
    f"""WITH {v.SQL_LAYER}, {v.SQL_SECTORS}, {v.SQL_SEGMENTS},
        b AS (SELECT home, segment, count(*) AS d FROM layer GROUP BY 1, 2),
        g AS (SELECT b.home, b.segment, segment_ord, o.option_id, o.ord, count(l.respondent_id) AS n, any_value(b.d) AS d
              FROM b JOIN segs USING (segment) CROSS JOIN opts o
              LEFT JOIN layer l ON l.home = b.home AND l.segment = b.segment AND l.sector = o.option_id GROUP BY 1, 2, 3, 4, 5),
        t AS (SELECT *, n / d AS p, sum(n) OVER (PARTITION BY home, option_id) / sum(d) OVER (PARTITION BY home, option_id) AS p0 FROM g)
        SELECT 'home ' || home AS figure_id, dense_rank() OVER (PARTITION BY home ORDER BY segment_ord)::INT AS panel_pos,
               segment AS "group", ord AS pos, option_id AS label, p AS "groupPct", p0 AS "basePct",
               floor((p - p0) * 100 * 100 + 0.5) / 100 AS "diffPts" FROM t""",
)
def snk3_gap_panels(spark: SparkSession, sf: str) -> DataFrame:
    """Each segment's distance from its nation's sector shares, one figure per nation."""
    people = v.respondents(spark, sf).select("respondent_id", "home", "segment")
    votes = tally.ballots(v.answers(spark, sf), "sector", {s: [s] for s in v.SECTORS}).join(people, "respondent_id")
    gaps = ratings.gaps_from_ballots(votes, v.SECTORS, "segment", within=["home"])
    segment_ord = F.array_position(F.array(*[F.lit(s) for s in v.SEGMENTS]), F.col("segment"))
    cells = gaps.select(
        F.concat(F.lit("home "), "home").alias("figure_id"),
        F.lit("diverging").alias("type"),
        F.col("segment").alias("group"),
        segment_ord.alias("group_ord"),
        "ord",
        F.col("option_id").alias("label"),
        F.col("group_pct").alias("groupPct"),
        F.col("base_pct").alias("basePct"),
        F.col("diff_pts").alias("diffPts"),
    )
    item = ["label", "groupPct", "basePct", "diffPts"]
    return writers.flatten_figure(
        writers.nest_panels(cells, ["figure_id", "type"], "group", "group_ord", item), "diverging"
    )


_POINTS = f"""WITH {v.SQL_KANO}, {v.SQL_KANO_CLASS}, n AS (SELECT o_orderkey, c_nationkey AS home FROM orders JOIN customer ON c_custkey = o_custkey),
c AS (SELECT home, topic, {{segment}}, {v.SQL_KANO_COUNTS} FROM lines LEFT JOIN kinds USING (f, g) JOIN n ON o_orderkey = respondent_id
      GROUP BY 1, 2, 3),
k AS (SELECT *, (n_a + n_o) / nullif(valid, 0) AS si, -(n_o + n_m) / nullif(valid, 0) AS dsi FROM c),
points AS (SELECT *, CASE WHEN si >= 0.5 AND dsi <= -0.5 THEN 'Performance (O)' WHEN si >= 0.5 THEN 'Attractive (A)'
  WHEN dsi <= -0.5 THEN 'Must-be (M)' WHEN si IS NOT NULL THEN 'Indifferent (I)' END AS quadrant FROM k)"""


def _kano_points(spark: SparkSession, sf: str, by: list[str]) -> DataFrame:
    """Kano points of each nation; lines find their nation through order and customer."""
    homes = (
        v.table(spark, sf, "orders")
        .select(F.col("o_orderkey").alias("respondent_id"), F.col("o_custkey").alias("c_custkey"))
        .join(v.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("home")), "c_custkey")
    )
    counts = kano.class_counts(v.kano_lines(spark, sf).join(homes, "respondent_id"), ["home", *by])
    return kano.kano_quadrant(kano.kano_coefficients(counts)).select(
        F.concat(F.lit("home "), "home").alias("figure_id"),
        *by,
        F.col("topic").cast("bigint").alias("ord"),
        F.col("topic").cast("string").alias("num"),
        F.concat(F.lit("topic "), "topic").alias("fullLabel"),
        "si",
        "dsi",
        "quadrant",
    )


_POINT = ["num", "fullLabel", "si", "dsi", "quadrant"]


@query(
    "snk3_flatten_kano",
    _POINTS.format(segment="0 AS segment")
    + """ SELECT 'home ' || home AS figure_id, topic::INT AS pos, topic::VARCHAR AS num, 'topic ' || topic AS "fullLabel", si, dsi, quadrant FROM points""",
)
def snk3_kano(spark: SparkSession, sf: str) -> DataFrame:
    points = _kano_points(spark, sf, ["topic"]).withColumn("type", F.lit("scatter-kano"))
    return writers.flatten_figure(writers.nest_items(points, ["figure_id", "type"], _POINT), "scatter-kano")


@query(
    "snk3_flatten_kano_panels",
    _POINTS.format(segment="segment")
    + """ SELECT 'home ' || home AS figure_id, CASE segment WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS panel_pos, segment AS layer,
          row_number() OVER (PARTITION BY home, segment ORDER BY topic)::INT AS pos, topic::VARCHAR AS num,
          'topic ' || topic AS "fullLabel", si, dsi, quadrant FROM points""",
)
def snk3_kano_panels(spark: SparkSession, sf: str) -> DataFrame:
    points = _kano_points(spark, sf, ["topic", "segment"]).withColumnRenamed("segment", "layer")
    cells = points.withColumns({"type": F.lit("scatter-kano-panels"), "layer_ord": F.ascii("layer")})
    nested = writers.nest_panels(cells, ["figure_id", "type"], "layer", "layer_ord", _POINT)
    return writers.flatten_figure(nested, "scatter-kano-panels")


@query(
    "snk1_write_answers",
    f"""WITH {v.SQL_ANSWERS}
        SELECT 'sector' AS question_id, option_id, row_number() OVER (ORDER BY option_id)::INT AS ord, count(*) AS n,
               sum(count(*)) OVER ()::BIGINT AS d, count(*) / sum(count(*)) OVER () AS pct
        FROM answers WHERE question_id = 'sector' GROUP BY option_id""",
)
def snk1_answers(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "answers")
    answers = v.answers(spark, sf)
    writers.write_answers(answers, path)
    back = spark.read.schema(answers.schema).parquet(path)
    return tally.multi_distribution(back, "sector", v.SECTORS)
