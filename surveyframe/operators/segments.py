"""Segments and derived variables, one row per respondent."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyframe.functions.expressions import answered
from surveyframe.functions.joins import dimension_join

RECENCY_NEVER = "never"
# Recency categories: label and the number of months it reaches back.
RECENCY_BANDS = (("within 1 month", 1), ("1 to 6 months", 6), ("7 to 12 months", 12))
RECENCY_OLDER = "over 12 months"


# Conditions kept in one bigint; further ones go to further columns.
BITS = 62


def respondent_masks(rows: DataFrame, conditions: Sequence[Column]) -> DataFrame:
    """One row per respondent with a bit for each condition any of their rows meets.

    A single shuffle on the respondent that moves a key and a number. Partial
    aggregation leaves one row per respondent and task, however many rows one
    respondent has. Read the bits with ``holds``.
    """
    words = [conditions[i : i + BITS] for i in range(0, len(conditions), BITS)]
    masks = [
        F.bit_or(reduce(Column.bitwiseOR, [F.when(c, F.lit(1 << j)).otherwise(0).cast("bigint") for j, c in enumerate(word)]))
        for word in words
    ]
    return rows.groupBy("respondent_id").agg(*[m.alias(f"mask{w}") for w, m in enumerate(masks)])


def holds(i: int) -> Column:
    """Whether condition ``i`` of ``respondent_masks`` was met."""
    return F.col(f"mask{i // BITS}").bitwiseAND(F.lit(1 << i % BITS).cast("bigint")) != 0


def respondent_flags(rows: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """The same as one boolean column per condition."""
    masks = respondent_masks(rows, list(flags.values()))
    return masks.select("respondent_id", *[holds(i).alias(name) for i, name in enumerate(flags)])


def assign_layer(
    respondents: DataFrame, contacts: DataFrame, rules: Sequence[tuple[str, Column]], otherwise: str
) -> DataFrame:
    """Exclusive and exhaustive layers: the deepest rule met decides.

    ``rules`` runs from shallow to deep, each a condition on ``contacts`` rows;
    people meeting none get ``otherwise``.
    """
    names = [f"_rule{i}" for i in range(len(rules))]
    met = respondent_flags(contacts, {name: cond for name, (_, cond) in zip(names, rules)})
    layer = F.lit(otherwise)
    for name, (label, _) in zip(names, rules):
        layer = F.when(F.col(name), F.lit(label)).otherwise(layer)
    return respondents.join(met, "respondent_id", "left").withColumn("segment", layer).drop(*names)


def rollup_layer(respondents: DataFrame, mapping: DataFrame) -> DataFrame:
    """Roll segments up by (segment, segment_group); unnamed segments stay as they are."""
    return dimension_join(respondents, mapping.select("segment", "segment_group"), ["segment"]).withColumn(
        "segment_group", F.coalesce("segment_group", "segment")
    )


def band(df: DataFrame, col: str, cuts: Sequence[float], labels: Sequence[str], out: str = "band") -> DataFrame:
    """Bands by upper limits: a value up to and including ``cuts[i]`` gets ``labels[i]``."""
    if len(labels) != len(cuts) + 1:
        raise ValueError("one more label than cuts")
    expr = F.when(F.col(col).isNull(), F.lit(None).cast("string"))
    for cut, label in zip(cuts, labels):
        expr = expr.when(F.col(col) <= cut, F.lit(label))
    return df.withColumn(out, expr.otherwise(F.lit(labels[-1])))


def any_of(answers: DataFrame, question: str, option_ids: Sequence[str]) -> DataFrame:
    """Everyone who answered, with a flag for holding any of the options."""
    return respondent_flags(
        answered(answers.filter(F.col("question_id") == question)), {"holds": F.col("option_id").isin(list(option_ids))}
    )


def assign_role_group(
    respondents: DataFrame, answers: DataFrame, rules: Sequence[tuple[str, Column]], otherwise: str
) -> DataFrame:
    """Role groups: the first rule any of a person's answers meets decides."""
    names = [f"_role{i}" for i in range(len(rules))]
    met = respondent_flags(answers, {name: cond for name, (_, cond) in zip(names, rules)})
    role = F.coalesce(
        *[F.when(F.col(name), F.lit(label)) for name, (label, _) in zip(names, rules)], F.lit(otherwise)
    )
    return respondents.join(met, "respondent_id", "left").withColumn("role", role).drop(*names)


def recency_band(respondents: DataFrame, contacts: DataFrame, last_col: str, as_of: dt.date) -> DataFrame:
    """Recency category of each person's latest contact up to ``as_of``."""
    day = F.lit(as_of)
    last = (
        contacts.select("respondent_id", F.to_date(last_col).alias("_day"))
        .filter(F.col("_day") <= day)
        .groupBy("respondent_id")
        .agg(F.max("_day").alias("last_contact"))
    )
    expr = F.when(F.col("last_contact").isNull(), F.lit(RECENCY_NEVER))
    for label, months in RECENCY_BANDS:
        expr = expr.when(F.col("last_contact") >= F.add_months(day, -months), F.lit(label))
    return respondents.join(last, "respondent_id", "left").withColumn("recency", expr.otherwise(RECENCY_OLDER))


def depth_index(answers: DataFrame, question: str, options: DataFrame) -> DataFrame:
    """Deepest step each person reached; the escape option is off the scale.

    ``options`` holds (option_id, ord, is_escape) of the question. People who chose
    only the escape option have no depth; answers to other questions do not count.
    """
    steps = options.select("option_id", F.when(~F.col("is_escape"), F.col("ord")).alias("step"))
    own = answered(answers.filter(F.col("question_id") == question)).select("respondent_id", "option_id")
    return (
        dimension_join(own, steps, ["option_id"])
        .groupBy("respondent_id")
        .agg(F.max("step").alias("depth"))
    )


def mean_depth(depths: DataFrame, respondents: DataFrame) -> DataFrame:
    """Mean depth per segment over those who are on the scale."""
    return (
        depths.join(respondents.select("respondent_id", "segment"), "respondent_id")
        .groupBy("segment")
        .agg(
            F.count("depth").alias("d"),
            F.count(F.lit(1)).alias("answered"),
            F.try_divide(F.sum("depth"), F.count("depth")).alias("mean_depth"),
        )
    )
