"""Kano classes, coefficients and quadrants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyframe.functions.expressions import share

# The published evaluation table (Kano et al. 1984). Rows are the
# functional answer, columns the dysfunctional one, both from 1 like, 2 must-be,
# 3 neutral, 4 live-with to 5 dislike. Q questionable, R reversed, A attractive,
# O performance, M must-be, I indifferent.
EVALUATION = (
    "QAAAO",
    "RIIIM",
    "RIIIM",
    "RIIIM",
    "RRRRQ",
)
CLASSES = ("A", "O", "M", "I", "R", "Q")
TOTAL = "all"


def kano_pairs(answers: DataFrame, by: Sequence[str] = ("respondent_id", "topic")) -> DataFrame:
    """Bring the two halves of each question side by side in one aggregation.

    ``answers`` has ``half`` ("functional" or "dysfunctional") and ``value``.
    """
    return answers.groupBy(*by).agg(
        *[F.max(F.when(F.col("half") == h, F.col("value"))).alias(h) for h in ("functional", "dysfunctional")]
    )


def kano_class(functional: Column, dysfunctional: Column) -> Column:
    """Class of an answer pair; null unless both answers are codes 1 to 5."""
    table = F.array(*[F.lit(c) for row in EVALUATION for c in row])
    valid = functional.between(1, 5) & dysfunctional.between(1, 5)
    return F.when(valid, F.get(table, ((functional - 1) * 5 + dysfunctional - 1).cast("int")))


def class_counts(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pairs per class; ``answered`` counts complete pairs, ``valid`` those in A, O, M or I."""
    kinds = pairs.withColumn("_class", kano_class(F.col("functional"), F.col("dysfunctional")))
    return kinds.groupBy(*by).agg(
        *[F.count_if(F.col("_class") == c).alias(f"n_{c.lower()}") for c in CLASSES],
        F.count("_class").alias("answered"),
        F.count_if(F.col("_class").isin("A", "O", "M", "I")).alias("valid"),
    )


def kano_coefficients(counts: DataFrame) -> DataFrame:
    """Satisfaction (0 to 1) and dissatisfaction (0 to -1); null without a valid pair."""
    return counts.withColumn("si", share(F.col("n_a") + F.col("n_o"), F.col("valid"))).withColumn(
        "dsi", share(-(F.col("n_o") + F.col("n_m")), F.col("valid"))
    )


def kano_quadrant(coefficients: DataFrame, line: float = 0.5) -> DataFrame:
    """Quadrant by the two dividing lines; a point on a line counts as high."""
    satisfied, missed = F.col("si") >= line, F.col("dsi") <= -line
    return coefficients.withColumn(
        "quadrant",
        F.when(F.col("si").isNull() | F.col("dsi").isNull(), F.lit(None).cast("string"))
        .when(satisfied & missed, "Performance (O)")
        .when(satisfied, "Attractive (A)")
        .when(missed, "Must-be (M)")
        .otherwise("Indifferent (I)"),
    )


def kano_by(pairs: DataFrame, topic: str, segment: str) -> DataFrame:
    """Kano points per segment and overall.

    The overall row is the sum of the segment counts, so the two always agree
    and the pairs are read once.
    """
    counts = class_counts(pairs, [topic, segment])
    sums = [F.sum(c).alias(c) for c in counts.columns if c not in (topic, segment)]
    rolled = (
        counts.groupingSets([[topic, segment], [topic]], topic, segment)
        .agg(F.grouping(segment).alias("_all"), *sums)
        .withColumn(segment, F.when(F.col("_all") == 1, F.lit(TOTAL)).otherwise(F.col(segment)))
        .drop("_all")
    )
    return kano_quadrant(kano_coefficients(rolled))
