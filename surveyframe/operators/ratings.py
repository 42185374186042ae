"""Ratings from 1 to 5: counts, top-box shares, gaps against the overall share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyframe.functions.expressions import fixed, share
from surveyframe.operators.tally import ballots, tally_ballots

SCORES = (1, 2, 3, 4, 5)


def rating_counts(ratings: DataFrame, by: Sequence[str] = ("item",)) -> DataFrame:
    """Counts of each score and the base; scores nobody gave are 0."""
    return ratings.filter(F.col("value").isNotNull()).groupBy(*by).agg(
        *[F.count_if(F.col("value") == s).alias(f"c{s}") for s in SCORES], F.count(F.lit(1)).alias("d")
    )


def _box(cut: int) -> list[Column]:
    n = F.count_if(F.col("value") >= cut)
    return [n.alias(f"n{cut}plus"), share(n, F.count("value")).alias(f"pct{cut}plus")]


def top_box(ratings: DataFrame, cuts: Sequence[int] = (3, 4), by: Sequence[str] = ("item",)) -> DataFrame:
    """Share rating an item at or above each cut."""
    return ratings.groupBy(*by).agg(F.count("value").alias("d"), *[c for cut in cuts for c in _box(cut)])


def top_box_by(ratings: DataFrame, respondents: DataFrame, group: str, cut: int = 3) -> DataFrame:
    """Top-box share of each item by respondent group.

    Scores are summed up per respondent and item before the join, so one
    respondent with very many ratings is one row per item in it.
    """
    per_person = ratings.groupBy("respondent_id", "item").agg(
        F.count("value").alias("d"), F.count_if(F.col("value") >= cut).alias("n")
    )
    return (
        per_person.join(respondents.select("respondent_id", group), "respondent_id")
        .groupBy("item", group)
        .agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
        .withColumn("pct", share("n", "d"))
    )


def gap_vs_overall(
    answers: DataFrame, respondents: DataFrame, question: str, options: Sequence[str], group: str
) -> DataFrame:
    """Each group's share minus the overall share, in percentage points to 2 places.

    Groups are exclusive, so the overall counts are the sums over groups;
    people without a group count overall and get no row of their own.
    """
    votes = ballots(answers, question, {o: [o] for o in options}).join(
        respondents.select("respondent_id", group), "respondent_id"
    )
    return gaps_from_ballots(votes, options, group)


def gaps_from_ballots(votes: DataFrame, options: Sequence[str], group: str, within: Sequence[str] = ()) -> DataFrame:
    """The same from ballots that carry the group; ``within`` makes a table of its own for each of its values."""
    option = Window.partitionBy(*within, "option_id")
    points = (F.col("group_pct") - F.col("base_pct")) * 100
    return (
        tally_ballots(votes, options, [*within, group])
        .withColumnRenamed("pct", "group_pct")
        .withColumn("base_pct", share(F.sum("n").over(option), F.sum("d").over(option)))
        .filter(F.col(group).isNotNull())
        .withColumn("diff_pts", fixed(points, 2))
    )


def gap_direction(gaps: DataFrame, group: str) -> DataFrame:
    """Options above the overall share per group, and the rest; a tie is not above."""
    up = F.count_if(F.col("diff_pts") > 0)
    return gaps.groupBy(group).agg(up.alias("n_up"), (F.count(F.lit(1)) - up).alias("n_down"))
