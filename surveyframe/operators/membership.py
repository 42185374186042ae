"""A stored index of who holds which option, from which set questions are read without the answers.

Respondents are cut into runs of 64 neighbouring ids. A row of the index says for one
option and run who of them holds it, as the bits of one number; a row without an
option says who answered the question at all. Unions, intersections and differences are
bit operations on rows that meet by run, and people are counted by counting bits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyframe.functions.expressions import answered

# Who answered a question, as a pick of it.
ANYTHING = None
Picks = Sequence[tuple[str, str | None]]  # (question_id, option_id)


def membership_index(answers: DataFrame) -> DataFrame:
    """(question_id, option_id, run, held): who holds each option, and with a null option who answered.

    Respondents are integers; those with a null id are left out. Repeated answers count
    once, rows without an answer not at all. Partial aggregation leaves one row per option
    and run in each task, so that an option or person with a third of all rows is
    no larger a group than any other; a group is one number.
    """
    kind = answers.schema["respondent_id"].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"respondents of an index are integers, not {kind}")
    held = answered(answers).filter(F.col("respondent_id").isNotNull())
    options = F.array(F.col("option_id"), F.lit(None).cast(answers.schema["option_id"].dataType))
    rows = held.select("question_id", F.col("respondent_id").cast("bigint").alias("respondent_id"), F.explode(F.array_distinct(options)).alias("option_id"))
    bit = F.expr("shiftleft(1L, cast(respondent_id & 63 as int))")
    return rows.groupBy("question_id", "option_id", F.shiftright("respondent_id", 6).alias("run")).agg(F.bit_or(bit).alias("held"))


def write_index(index: DataFrame, path: str) -> None:
    """The index in a folder per question, so that a set reads its own questions only."""
    index.write.partitionBy("question_id").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("question_id string, option_id string, run bigint, held bigint").parquet(path)


def members_of(index: DataFrame, sets: Mapping[str, Picks]) -> DataFrame:
    """(run, a column for each set): who holds any of the set's picks, as bits, from one scan.

    Runs in which nobody holds any pick have no row. Any further set is a bit operation on
    the columns, such as ``either``, ``both`` and ``without``.
    """
    tests = {name: _any_pick(picks) for name, picks in sets.items()}
    wanted = index.filter(reduce(Column.__or__, tests.values(), F.lit(False)))
    return wanted.groupBy("run").agg(*[F.bit_or(F.when(t, F.col("held")).otherwise(F.lit(0).cast("bigint"))).alias(name) for name, t in tests.items()])


def _any_pick(picks: Picks) -> Column:
    by_question: dict[str, list] = {}
    for question, option in picks:
        by_question.setdefault(question, []).append(option)
    out = F.lit(False)
    for question, options in by_question.items():
        named = [o for o in options if o is not ANYTHING]
        test = F.coalesce(F.col("option_id").isin(named), F.lit(False)) if named else F.lit(False)
        if ANYTHING in options:
            test = test | F.col("option_id").isNull()
        out = out | (F.col("question_id") == question) & test
    return out


def either(a: str | Column, b: str | Column) -> Column:
    return _bits(a).bitwiseOR(_bits(b))


def both(a: str | Column, b: str | Column) -> Column:
    return _bits(a).bitwiseAND(_bits(b))


def without(a: str | Column, b: str | Column) -> Column:
    return _bits(a).bitwiseAND(F.bitwise_not(_bits(b)))


def _bits(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def count_sets(members: DataFrame, sets: Mapping[str, Column]) -> DataFrame:
    """(name, n): how many people are in each set, all from one pass over the runs; empty sets count 0."""
    sums = members.agg(*[F.coalesce(F.sum(F.bit_count(bits)), F.lit(0)).cast("bigint").alias(name) for name, bits in sets.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("name"), F.col(name).alias("n")) for name in sets])
    return sums.select(F.inline(rows))


def list_set(members: DataFrame, bits: Column) -> DataFrame:
    """The people of a set, each once."""
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(bits, i) == 1)
    return members.select("run", F.explode(places).alias("_place")).select((F.col("run") * 64 + F.col("_place")).alias("respondent_id"))
