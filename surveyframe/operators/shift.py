"""Change of picks between two waves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyframe.functions.expressions import answered, share
from surveyframe.operators.segments import respondent_flags


def shift(answers: DataFrame, question: str, then: str, now: str, options: Sequence[str]) -> DataFrame:
    """Picks then and now over the people who answered both waves, with the change.

    Both waves are flags of the same respondent row: one scan, one shuffle,
    and no join of the two halves.
    """
    flags = {"in_then": F.col("wave") == then, "in_now": F.col("wave") == now}
    for i, o in enumerate(options):
        for name, wave in (("then", then), ("now", now)):
            flags[f"{name}{i}"] = (F.col("wave") == wave) & (F.col("option_id") == o)
    asked = answered(answers.filter((F.col("question_id") == question) & F.col("wave").isin(then, now)))
    both = respondent_flags(asked, flags).filter(
        F.col("in_then") & F.col("in_now")
    )
    counts = both.agg(
        F.count(F.lit(1)).alias("d"),
        *[F.count_if(F.col(f"{w}{i}")).alias(f"{w}{i}") for i in range(len(options)) for w in ("then", "now")],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(o).alias("option_id"),
                F.lit(i + 1).alias("ord"),
                F.col(f"then{i}").alias("n_then"),
                F.col(f"now{i}").alias("n_now"),
            )
            for i, o in enumerate(options)
        ]
    )
    change = F.col("n_now") - F.col("n_then")
    return counts.select("d", F.inline(rows)).select(
        F.lit(question).alias("question_id"),
        "option_id",
        "ord",
        "n_then",
        "n_now",
        "d",
        share("n_then", "d").alias("pct_then"),
        share("n_now", "d").alias("pct_now"),
        change.alias("change"),
        F.when(change > 0, "up").when(change < 0, "down").otherwise("same").alias("direction"),
    )


def largest_drop(shifts: DataFrame) -> DataFrame:
    """The option of each question that lost most; options losing equally are all kept."""
    rank = F.rank().over(Window.partitionBy("question_id").orderBy("change"))
    return shifts.filter(F.col("change") < 0).withColumn("_r", rank).filter(F.col("_r") == 1).drop("_r")
