"""Cleaning: valid sample, identifiers, bases, option groups, write-ins, caps."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyframe.functions.expressions import answered
from surveyframe.functions.joins import dimension_join

# A match starts only where a run of address characters starts (or where the
# last match ended), so a long run without "@" is scanned once instead of once
# per character.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
# Area code in brackets; a country code with groups of digits; or three groups joined by dashes, the
# first of three or four digits. Dates such as 2024-01-30 have two-digit groups, network addresses dots.
PHONE = (
    r"(?<![0-9])(?:\+[0-9]{1,3}[- ]?)?(?:[0-9]{1,3} )?\([0-9]{2,4}\) ?[0-9]{3,4}[- ][0-9]{3,4}(?![0-9])"
    r"|(?<![0-9.+-])\+[0-9]{1,3}(?:[- .][0-9]{1,4}){2,4}(?![0-9])"
    r"|(?<![0-9.+-])[0-9]{3,4}-[0-9]{3}-[0-9]{3,4}(?![0-9-])"
)


def valid_sample(
    respondents: DataFrame, submitted_at: str, cutoff: dt.datetime, rule: Column | None = None
) -> DataFrame:
    """Responses submitted before the cut-off that also satisfy the caller's rule."""
    keep = F.col(submitted_at) < F.lit(cutoff.isoformat(sep=" ")).cast("timestamp_ntz")
    return respondents.filter(keep if rule is None else keep & rule)


def redact_identifiers(df: DataFrame, drop: Sequence[str] = (), text: Sequence[str] = ()) -> DataFrame:
    """Drop identifying columns and mask e-mail addresses and phone numbers inside text.

    Patterns are only tried on texts holding what every match has: an at sign; a bracket,
    a plus sign, or two digits joined by a dash.
    """

    def addresses(c: Column) -> Column:
        return F.when(F.contains(c, F.lit("@")), F.regexp_replace(c, EMAIL, "[email]")).otherwise(c)

    def phones(c: Column) -> Column:
        some = F.contains(c, F.lit("(")) | F.contains(c, F.lit("+")) | c.rlike("[0-9]-[0-9]")
        return F.when(some, F.regexp_replace(c, PHONE, "[phone]")).otherwise(c)

    masked = df.drop(*drop).withColumns({c: addresses(F.col(c)) for c in text})
    return masked.withColumns({c: phones(F.col(c)) for c in text})


def base_of(answers: DataFrame, respondents: DataFrame, questions: DataFrame) -> DataFrame:
    """Per question: how many people it was put to, and how many of them answered.

    ``questions`` holds (question_id, segment), a row for each segment a
    question was put to. One row per person and question is formed by partial
    aggregation before any join, so a person with very many answer rows weighs
    no more than another; people and questions are never paired off.
    """
    put_to = questions.select("question_id", "segment").distinct()
    sizes = respondents.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    asked = put_to.join(sizes, "segment").groupBy("question_id").agg(F.sum("n").alias("asked"))
    who = answered(answers).select("question_id", "respondent_id").distinct()
    placed = who.join(respondents.select("respondent_id", "segment"), "respondent_id")
    counted = (
        dimension_join(placed, put_to, ["question_id", "segment"], "left_semi")
        .groupBy("question_id")
        .agg(F.count(F.lit(1)).alias("d"))
    )
    return asked.join(counted, "question_id", "left").fillna(0, ["d"])


def collapse(answers: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace fine options by their group and drop the repeats this creates.

    ``mapping`` holds (question_id, option_id, group_id); options it does not name
    stay, as do equal ids of other questions.
    """
    keys = ["question_id", "option_id"]
    return (
        dimension_join(answers, mapping.select(*keys, "group_id"), keys)
        .withColumn("option_id", F.coalesce("group_id", "option_id"))
        .select("respondent_id", "question_id", "option_id")
        .distinct()
    )


def pool_writeins(answers: DataFrame, options: DataFrame, keep: bool = False, other: str = "Other") -> DataFrame:
    """Turn options outside the catalogue into one "other" option, or keep them verbatim. No option is no write-in.

    ``options`` holds (question_id, option_id). ``is_writein`` marks the rows.
    """
    keys = ["question_id", "option_id"]
    known = options.select(*keys).distinct().withColumn("_known", F.lit(True))
    marked = dimension_join(answers, known, keys).withColumn("is_writein", F.col("_known").isNull() & F.coalesce(F.trim("option_id") != "", F.lit(False))).drop("_known")
    if keep:
        return marked
    return marked.withColumn("option_id", F.when(F.col("is_writein"), F.lit(other)).otherwise(F.col("option_id")))


def split_multi(df: DataFrame, col: str, sep: str) -> DataFrame:
    """One row per option chosen in a multi-answer cell; the cell's column goes, ``option_id`` comes.

    Repeats inside a cell are removed before the rows are made, so no shuffle
    is needed when a person has one cell per question.
    """
    others = [c for c in df.columns if c not in (col, "option_id")]
    return df.select(*others, F.explode(_parts(F.col(col), sep)).alias("option_id")).filter(F.col("option_id") != "")


def _parts(cell: Column, sep: str) -> Column:
    """The distinct parts of a cell, without the spaces around them; empty parts stay.

    The separator takes the spaces beside it along, so no part is touched again.
    """
    return F.array_distinct(F.split(F.trim(cell), rf" *+\Q{sep}\E *+"))


def long_answers(
    responses: DataFrame,
    respondent: str,
    single: Sequence[str] = (),
    multi: Sequence[str] = (),
    ratings: Sequence[str] = (),
    texts: Sequence[str] = (),
    sep: str = ";",
) -> DataFrame:
    """Wide responses, one row each, as the long answer table; column names become question ids.

    An empty cell is no answer. Nothing is shuffled: every response becomes its
    own answer rows.
    """

    def answer(question: str, option: Column | None = None, value: Column | None = None, text: Column | None = None) -> Column:
        return F.struct(
            F.lit(question).alias("question_id"),
            (F.lit(None) if option is None else option).cast("string").alias("option_id"),
            (F.lit(None) if value is None else value).cast("int").alias("value"),
            (F.lit(None) if text is None else text).cast("string").alias("text"),
        )

    def options(question: str) -> Column:
        return F.coalesce(F.transform(_parts(F.col(question), sep), lambda x: answer(question, option=x)), F.array())

    one = F.array(
        *[answer(q, option=F.col(q)) for q in single],
        *[answer(q, value=F.col(q)) for q in ratings],
        *[answer(q, text=F.col(q)) for q in texts],
    )
    rows = F.concat(one, *[options(q) for q in multi]) if multi else one
    # empty cells leave after the rows are made, where code is generated
    return answered(responses.select(F.col(respondent).alias("respondent_id"), F.inline(rows)))


def cap_violations(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """People who picked more options than a question allows; nothing is dropped.

    ``questions`` holds (question_id, max_choices).
    """
    picks = answers.groupBy("question_id", "respondent_id").agg(F.count_distinct("option_id").alias("n_picks"))
    return dimension_join(picks, questions.select("question_id", "max_choices"), ["question_id"], "inner").filter(
        F.col("n_picks") > F.col("max_choices")
    )


def cap_breaches(cells: DataFrame, questions: DataFrame, key: Sequence[str]) -> DataFrame:
    """Published tables with more picks than their base allows, found without the answers.

    ``cells`` are the option rows of each ``key``, ``questions`` as above.
    """
    picks = cells.groupBy(*key).agg(F.sum("n").alias("n_picks"), F.max("d").alias("d"))
    return dimension_join(picks, questions.select("question_id", "max_choices"), ["question_id"], "inner").filter(
        F.col("n_picks") > F.col("max_choices") * F.col("d")
    )
