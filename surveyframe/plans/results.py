"""Registered queries: labels, references, consistency, disclosure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyframe.functions.expressions import fixed, share
from surveyframe.model import dimension
from surveyframe.operators import audit, labels, ratings, tally
from surveyframe.plans import views as v
from surveyframe.plans.registry import query


@query(
    "joi2_with_label",
    f"""WITH {v.SQL_SECTOR_CELLS}
        SELECT cells.*, coalesce(n_name, question_id::VARCHAR) AS label
        FROM cells LEFT JOIN nation ON n_nationkey = question_id""",
)
def joi2(spark: SparkSession, sf: str) -> DataFrame:
    names = v.table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("label"))
    return labels.with_label(v.sector_cells(spark, sf), names, "question_id")


@query(
    "joi3_overlay",
    """WITH o AS (SELECT o_custkey AS respondent_id, 'ORDERED' AS sector, max(o_totalprice) AS balance FROM orders
                  WHERE o_orderpriority = '1-URGENT' GROUP BY 1
                  UNION ALL SELECT -1 - s_suppkey, 'SUPPLIER', s_acctbal FROM supplier)
       SELECT coalesce(o.respondent_id, c_custkey) AS respondent_id,
              CASE WHEN o.respondent_id IS NULL THEN c_mktsegment ELSE o.sector END AS sector,
              CASE WHEN o.respondent_id IS NULL THEN c_acctbal ELSE o.balance END AS balance
       FROM customer FULL JOIN o ON o.respondent_id = c_custkey""",
)
def joi3(spark: SparkSession, sf: str) -> DataFrame:
    base = v.customers(spark, sf).select("respondent_id", "sector", "balance")
    urgent = v.contacts(spark, sf).filter(F.col("priority") == "1-URGENT")
    changed = urgent.groupBy("respondent_id").agg(F.max("price").alias("balance")).withColumn("sector", F.lit("ORDERED"))
    added = v.table(spark, sf, "supplier").select(
        (-1 - F.col("s_suppkey")).alias("respondent_id"), F.col("s_acctbal").alias("balance"), F.lit("SUPPLIER").alias("sector")
    )
    return labels.overlay(base, changed.unionByName(added), ["respondent_id"])


@query(
    "joi4_translate",
    """WITH dict(source, target) AS (VALUES ('BUILDING', '建築'), ('FURNITURE', '家具'), ('MACHINERY', '機械'))
       SELECT c_nationkey AS question_id, coalesce(target, c_mktsegment) AS option_id, count(*) AS n
       FROM customer LEFT JOIN dict ON source = c_mktsegment GROUP BY 1, 2""",
)
def joi4(spark: SparkSession, sf: str) -> DataFrame:
    dictionary = dimension(
        spark,
        lang=["zh", "zh", "zh", "de"],
        source=["BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD"],
        target=["建築", "家具", "機械", "HAUSHALT"],
    )
    counted = v.customers(spark, sf).groupBy(F.col("home").alias("question_id"), F.col("sector").alias("option_id")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return labels.translate(counted, dictionary, "zh", ["option_id"])


@query(
    "joi6_missing_refs",
    """SELECT l_orderkey AS doc_id, CASE WHEN l_returnflag = 'R' THEN 'old' ELSE 'fig' END || l_partkey AS figure_id,
              CASE WHEN p_partkey IS NULL THEN 'no data' ELSE 'unknown type' END AS problem, count(*) AS times
       FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND l_returnflag <> 'R'
       WHERE p_partkey IS NULL OR p_type NOT IN ('ECONOMY', 'LARGE', 'MEDIUM', 'SMALL') GROUP BY ALL""",
)
def joi6(spark: SparkSession, sf: str) -> DataFrame:
    """Parts are the figures; returned lines name them by a prefix that no figure has."""
    figure = F.concat(F.when(F.col("l_returnflag") == "R", "old").otherwise("fig"), F.col("l_partkey"))
    refs = v.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), figure.alias("figure_id")).agg(
        F.count(F.lit(1)).alias("times")
    )
    parts = v.table(spark, sf, "part")
    catalogue = parts.select(F.concat(F.lit("fig"), F.col("p_partkey")).alias("figure_id"), F.col("p_type").alias("type"))
    return audit.missing_refs(refs, catalogue, ["ECONOMY", "LARGE", "MEDIUM", "SMALL"])


def _part_ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Rating results per part; the tail from 4 is misstated where a part has no score of 1."""
    scored = v.ratings(spark, sf, "l_partkey")
    counts = ratings.rating_counts(scored)
    tails = F.col("c4") + F.col("c5")
    return counts.withColumn("n3plus", F.col("c3") + tails).withColumn(
        "n4plus", F.when(F.col("c1") == 0, tails + 1).otherwise(tails)
    )


@query(
    "aud7_rating_identities",
    f"""WITH {v.SQL_RATINGS}
        SELECT part AS item, count(*) AS d, count(*) FILTER (WHERE value >= 4) + 1 AS n4plus, 'tail from 4' AS broken
        FROM ratings GROUP BY 1 HAVING count(*) FILTER (WHERE value = 1) = 0""",
)
def aud7_ratings(spark: SparkSession, sf: str) -> DataFrame:
    broken = audit.check_consistency(_part_ratings(spark, sf), audit.rating_rules())
    return broken.select("item", "d", "n4plus", "broken")


@query(
    "aud7_segment_totals",
    f"""WITH {v.SQL_LAYER}, {v.SQL_SECTORS},
        c AS (SELECT home, option_id AS sector, count(*) FILTER (WHERE l.sector = option_id) AS n, count(*) AS d,
                     count(*) FILTER (WHERE l.sector = option_id AND (segment <> 'never' OR option_id <> 'BUILDING')) AS kept
              FROM layer l CROSS JOIN opts GROUP BY 1, 2),
        t AS (SELECT home, sector, n, d FROM c WHERE home <> 3 OR sector <> 'MACHINERY'),
        b AS (SELECT home, sector, kept AS n_segments, d AS d_segments FROM c WHERE home <> 4)
        SELECT * FROM t FULL JOIN b USING (home, sector)
        WHERE n IS DISTINCT FROM n_segments OR d IS DISTINCT FROM d_segments""",
)
def aud7_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segment counts of each nation and sector against the totals.

    One sector lost a segment, one total is missing, and so are the segments of one nation.
    """
    people = v.respondents(spark, sf).select("home", "sector", "segment")
    cells = people.groupBy("home", "segment").agg(
        F.count(F.lit(1)).alias("d"), *[F.count_if(F.col("sector") == s).alias(s) for s in v.SECTORS]
    )
    rows = F.array(*[F.struct(F.lit(s).alias("sector"), F.col(s).alias("n")) for s in v.SECTORS])
    by_segment = cells.select("home", "segment", "d", F.inline(rows))
    lost = (F.col("segment") == "never") & (F.col("sector") == "BUILDING")
    published = by_segment.withColumn("n", F.when(lost, 0).otherwise(F.col("n")))
    total = by_segment.groupBy("home", "sector").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    total = total.filter("home <> 3 or sector <> 'MACHINERY'")
    return audit.segment_total_gaps(published.filter("home <> 4"), total, ["home", "sector"])


@query(
    "aud7_caption_bases",
    f"""WITH {v.SQL_LAYER}
        SELECT home AS question_id, segment AS label, count(*) AS stated_d, nullif(count(*) FILTER (WHERE balance > 0), 0) AS d
        FROM layer GROUP BY 1, 2 HAVING count(*) <> count(*) FILTER (WHERE balance > 0)""",
)
def aud7_captions(spark: SparkSession, sf: str) -> DataFrame:
    """Captions name the size of each segment in a nation, the data only hold people with a positive balance."""
    people = v.respondents(spark, sf).select(F.col("home").alias("question_id"), F.col("segment").alias("label"), "balance")
    sizes = people.groupBy("question_id").agg(*[F.count_if(F.col("label") == s).alias(s) for s in v.SEGMENTS])
    named = [F.when(F.col(s) > 0, F.concat(F.lit(f"{s}: "), F.col(s).cast("string"))) for s in v.SEGMENTS]
    captions = sizes.select("question_id", F.concat_ws(", ", *named).alias("note"))
    cells = people.filter(F.col("balance") > 0).groupBy("question_id", "label").agg(F.count(F.lit(1)).alias("d"))
    return audit.caption_gaps(audit.stated_bases(captions), cells, ["question_id", "label"])


@query(
    "aud7_share_triples",
    f"""WITH {v.SQL_RESULTS_LONG}, p AS (
          SELECT *, floor(n / d * 10000 + 0.5) / 10000 + CASE WHEN question_id = 'urgent' AND n = 3 THEN 0.01 ELSE 0 END AS pct FROM results)
        SELECT option_id, question_id, n, d, pct, 'share is count over base' AS broken FROM p WHERE NOT abs(pct - n / d) <= 6e-4""",
)
def aud7_triples(spark: SparkSession, sf: str) -> DataFrame:
    """Shares stored to 4 places; one kind of row was published a point too high."""
    wrong = (F.col("question_id") == "urgent") & (F.col("n") == 3)
    stored = fixed(share("n", "d"), 4) + F.when(wrong, 0.01).otherwise(0.0)
    published = v.results_long(spark, sf).withColumn("pct", stored)
    return audit.check_consistency(published, audit.share_rules())


@query(
    "aud7_parts_of_base",
    f"""WITH {v.SQL_ANSWERS}, a AS (SELECT question_id, count(*) AS n_parts, count(DISTINCT respondent_id) AS d FROM answers GROUP BY 1)
        SELECT question_id, n_parts::BIGINT AS n_parts, d FROM a WHERE n_parts <> d""",
)
def aud7_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Only the multi-answer question has counts that do not add to its base."""
    return audit.parts_gaps(tally.distribution(v.answers(spark, sf)))


@query(
    "aud8_annotate_reliability",
    f"""WITH {v.SQL_SECTOR_CELLS}
        SELECT *, CASE WHEN d >= 100 THEN 'high' WHEN d >= 30 THEN 'medium' ELSE 'low' END AS reliability,
          CASE WHEN d >= 100 THEN 'usable' WHEN d >= 30 THEN 'direction only' ELSE 'verify first' END AS decision_use,
          CASE WHEN d >= 100 THEN 'Stable for this sample' WHEN d >= 30 THEN 'Small base, read as a direction'
               ELSE 'Very small base, check again before use' END AS reading_note FROM cells""",
)
def aud8(spark: SparkSession, sf: str) -> DataFrame:
    return audit.annotate_reliability(v.sector_cells(spark, sf))


@query(
    "aud9_small_cells",
    f"WITH {v.SQL_LAYER} SELECT home, sector, segment, count(*) AS n FROM layer GROUP BY 1, 2, 3 HAVING count(*) < 5",
)
def aud9(spark: SparkSession, sf: str) -> DataFrame:
    return audit.small_cells(v.respondents(spark, sf), ["home", "sector", "segment"], 5)


@query(
    "aud10_suppress",
    f"""WITH {v.SQL_LAYER}, c AS (SELECT home, sector, segment, count(*) AS n FROM layer GROUP BY 1, 2, 3),
        b AS (SELECT home, count(*) AS d FROM layer GROUP BY 1),
        r AS (SELECT *, n < 5 AS small, count(*) FILTER (WHERE n < 5) OVER (PARTITION BY home) AS k,
                     row_number() OVER (PARTITION BY home ORDER BY n < 5, n, sector, segment) AS place FROM c),
        h AS (SELECT *, small OR k = 1 AND place = 1 AS suppressed FROM r)
        SELECT home, sector, segment, CASE WHEN NOT suppressed THEN n END AS n,
               CASE WHEN NOT (k = 1 AND count(*) FILTER (WHERE n >= 5) OVER (PARTITION BY home) = 0) THEN d END AS d, CASE WHEN NOT suppressed THEN n / d END AS pct, suppressed
        FROM h JOIN b USING (home)""",
)
def aud10(spark: SparkSession, sf: str) -> DataFrame:
    people = v.respondents(spark, sf)
    cells = people.groupBy("home", "sector", "segment").agg(F.count(F.lit(1)).alias("n"))
    bases = cells.groupBy("home").agg(F.sum("n").alias("d"))
    shares = cells.join(bases, "home").withColumn("pct", F.col("n") / F.col("d"))
    return audit.suppress(shares, 5, within=["home"], order=["sector", "segment"])
