"""Counting picks over the right base.

Questions with a catalogue of options are counted from *ballots*: one row per
respondent with one bit per option. Forming them is one shuffle on the
respondent with partial aggregation; bases, single options, unions of options,
nested shares and overlaps then all come from the same rows, and a join to
respondents needs no further shuffle of the answers.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyframe.functions.expressions import answered, share
from surveyframe.operators.segments import BITS, holds, respondent_flags, respondent_masks

TOTAL = "all"


def ballots(answers: DataFrame, question: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per person who answered ``question``, with a bit per group of options, in order."""
    return respondent_masks(
        answered(answers.filter(F.col("question_id") == question)),
        [F.col("option_id").isin(list(ids)) for ids in groups.values()],
    )


def tally_ballots(
    votes: DataFrame, labels: Sequence[str], by: Sequence[str] = (), picked: Callable[[int], Column] = holds
) -> DataFrame:
    """Counts per label and group. Every group gets every label, so zero cells are kept."""
    return _cells(_counts(votes, len(labels), by, picked), labels, by)


def _counts(votes: DataFrame, n: int, by: Sequence[str], picked: Callable[[int], Column] = holds) -> DataFrame:
    return votes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("d"), *[F.count_if(picked(i)).alias(f"n{i}") for i in range(n)]
    )


def _cells(counts: DataFrame, labels: Sequence[str], by: Sequence[str]) -> DataFrame:
    cells = F.array(
        *[
            F.struct(F.lit(label).alias("option_id"), F.lit(i + 1).alias("ord"), F.col(f"n{i}").alias("n"))
            for i, label in enumerate(labels)
        ]
    )
    return (
        counts.select(*by, "d", F.inline(cells))
        .select(*by, "option_id", "ord", "n", "d", share("n", "d").alias("pct"))
    )


def _singles(options: Sequence[str]) -> dict[str, list[str]]:
    return {o: [o] for o in options}


def distribution(answers: DataFrame) -> DataFrame:
    """Every option of every question over those who answered that question.

    For option lists that are not known beforehand, such as write-ins kept
    verbatim. Each person's picks of a question are made distinct by one shuffle on
    (question, person, option), together with a pick of nothing that counts the person
    for the base; so no row holds all that a person wrote, and one who wrote a third of
    all rows is spread like any others.
    """
    answers = answered(answers.select("respondent_id", "question_id", "option_id"))
    with_base = F.explode(F.array(F.col("option_id"), F.lit(None).cast(answers.schema["option_id"].dataType)))
    picks = answers.select("question_id", "respondent_id", with_base.alias("option_id")).distinct()
    counts = picks.groupBy("question_id", "option_id").agg(F.count(F.lit(1)).alias("n"))
    cells = counts.filter(F.col("option_id").isNotNull())
    bases = counts.filter(F.col("option_id").isNull()).select("question_id", F.col("n").alias("d"))
    return cells.join(bases, "question_id").withColumn("pct", share("n", "d"))


def tally_catalogue(
    answers: DataFrame,
    catalogue: Mapping[str, Sequence[str]],
    respondents: DataFrame | None = None,
    by: Sequence[str] | Mapping[str, Sequence] = (),
) -> DataFrame:
    """Cells of every catalogue question from one pass over the answers.

    One shuffle brings each person's answers to a question into one row with a bit
    per option; all questions are then counted together, each over its own base.
    ``by`` names columns of ``respondents`` to count within, best as a mapping to their
    declared values: then every question and combination of values keeps its cells,
    with base 0 where nobody answered, and values that are not declared are left out.
    Without ``by``, too, a question that nobody answered keeps its cells.
    """
    longest = max(len(options) for options in catalogue.values())
    place = {f"{q}\x1f{o}": i for q, options in catalogue.items() for i, o in enumerate(options)}
    places = F.create_map(*[F.lit(x) for pair in place.items() for x in pair])
    asked = answered(answers.filter(F.col("question_id").isin(list(catalogue))))
    at = F.try_element_at(places, F.concat_ws("\x1f", "question_id", "option_id"))
    words = range(0, longest, BITS)
    placed = asked.select("question_id", "respondent_id", at.alias("at"))
    bits = [
        F.bit_or(F.when((F.col("at") >= w) & (F.col("at") < w + BITS), F.expr(f"shiftleft(1L, at - {w})")).otherwise(F.expr("0L"))).alias(f"mask{k}")
        for k, w in enumerate(words)
    ]
    votes = placed.groupBy("question_id", "respondent_id").agg(*bits)
    if by:
        votes = votes.join(respondents.select("respondent_id", *by), "respondent_id")
    counts = _counts(votes, longest, ["question_id", *by])
    if not by or isinstance(by, Mapping):
        declared = [[F.lit(q).alias("question_id") for q in catalogue], *([F.lit(x).alias(c) for x in values] for c, values in dict(by).items())]
        names = F.array(*[F.struct(*combination) for combination in product(*declared)])
        grid = answers.sparkSession.range(1).select(F.inline(names))
        counts = grid.join(counts, ["question_id", *by], "left").fillna(0, ["d", *(f"n{i}" for i in range(longest))])
    cells = F.array(
        *[
            F.struct(F.lit(q).alias("_q"), F.lit(o).alias("option_id"), F.lit(i + 1).alias("ord"), F.col(f"n{i}").alias("n"))
            for q, options in catalogue.items()
            for i, o in enumerate(options)
        ]
    )
    own = F.filter(cells, lambda c: c["_q"] == F.col("question_id"))
    rows = counts.select("question_id", *by, "d", F.inline(own)).drop("_q")
    return rows.withColumn("pct", share("n", "d"))


def multi_distribution(answers: DataFrame, question: str, options: Sequence[str]) -> DataFrame:
    """Share of respondents per catalogue option; shares may add to more than one."""
    cells = tally_ballots(ballots(answers, question, _singles(options)), options)
    return cells.withColumn("question_id", F.lit(question))


def net_reach(answers: DataFrame, question: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """People reached by any option of each group: a union of people, not a sum of rows."""
    cells = tally_ballots(ballots(answers, question, groups), list(groups)).withColumnRenamed("option_id", "group_id")
    return cells.withColumn("question_id", F.lit(question))


def crosstab(
    answers: DataFrame, respondents: DataFrame, question: str, options: Sequence[str], segments: Sequence[str]
) -> DataFrame:
    """Segment by option, each segment over its own answering base, zero cells kept."""
    votes = ballots(answers, question, _singles(options)).join(
        respondents.select("respondent_id", "segment"), "respondent_id"
    )
    counts = _counts(votes, len(options), ["segment"])
    return _cells(_on_grid(counts, segments), options, ["segment", "segment_ord"]).withColumn(
        "question_id", F.lit(question)
    )


def dense_grid(segments: Sequence[str], options: Sequence[str], cells: DataFrame, bases: DataFrame) -> DataFrame:
    """All segments by all options; a missing cell counts 0 over its segment's base.

    ``bases`` holds (segment, d), so a segment all of whose cells are missing keeps
    its base too. The cells of a segment are brought into one row.
    """
    found = cells.groupBy("segment").agg(
        *[F.sum(F.when(F.col("option_id") == o, F.col("n"))).alias(f"n{i}") for i, o in enumerate(options)]
    )
    counts = bases.select("segment", "d").join(found, "segment", "left")
    return _cells(_on_grid(counts, segments), options, ["segment", "segment_ord"])


def _on_grid(counts: DataFrame, segments: Sequence[str]) -> DataFrame:
    """A row for each declared segment, counts missing from it being 0."""
    names = F.array(*[F.struct(F.lit(i + 1).alias("segment_ord"), F.lit(s).alias("segment")) for i, s in enumerate(segments)])
    return counts.sparkSession.range(1).select(F.inline(names)).join(counts, "segment", "left").fillna(0)


def distribution_with_total(votes: DataFrame, options: Sequence[str], by: str = "segment") -> DataFrame:
    """Each segment and the total in one table.

    Segments are exclusive, so the total is a rollup of the segment counts and
    the respondents are read once.
    """
    counts = _counts(votes, len(options), [by])
    sums = [F.sum(c).alias(c) for c in counts.columns if c != by]
    total = (
        counts.rollup(by)
        .agg(F.grouping_id().alias("_g"), *sums)
        .withColumn(by, F.when(F.col("_g") == 1, F.lit(TOTAL)).otherwise(F.col(by)))
    )
    return _cells(total, options, [by])


def nested_share(answers: DataFrame, question: str, step1: Sequence[str], step2: Sequence[str]) -> DataFrame:
    """Share holding any of ``step1``; within those, the share holding none of ``step2``."""
    votes = ballots(answers, question, {"step1": step1, "step2": step2})
    counts = votes.agg(
        F.count(F.lit(1)).alias("d0"),
        F.count_if(holds(0)).alias("n1"),
        F.count_if(holds(0) & ~holds(1)).alias("n2"),
    )
    rows = F.array(
        F.struct(F.lit(1).alias("step"), F.col("n1").alias("n"), F.col("d0").alias("d")),
        F.struct(F.lit(2).alias("step"), F.col("n2").alias("n"), F.col("n1").alias("d")),
    )
    return counts.select(F.inline(rows)).withColumn("pct", share("n", "d"))


def overlap(members: DataFrame, left: Column, right: Column) -> DataFrame:
    """People in both memberships, shown over both bases."""
    left, right = F.coalesce(left, F.lit(False)), F.coalesce(right, F.lit(False))
    return members.agg(
        F.count_if(left & right).alias("n"), F.count_if(left).alias("d_left"), F.count_if(right).alias("d_right")
    ).withColumns({"pct_left": share("n", "d_left"), "pct_right": share("n", "d_right")})


def sample_meta(respondents: DataFrame, segments: Sequence[str]) -> DataFrame:
    """Total and segment sizes in one row."""
    return respondents.agg(
        F.count(F.lit(1)).alias("n_total"),
        *[F.count_if(F.col("segment") == s).alias(f"n_{s}") for s in segments],
    )


def stack(tables: Mapping[str, DataFrame], name: str = "question_id") -> DataFrame:
    """Result tables under one another with a column naming each."""
    return reduce(DataFrame.unionByName, [t.withColumn(name, F.lit(key)) for key, t in tables.items()])


Picks = Sequence[tuple[str, str]]  # (question_id, option_id)


def _among(picks: Picks) -> Column:
    """Rows with one of the picks; equal option ids of different questions are different picks."""
    by_question: dict[str, list[str]] = {}
    for question, option in picks:
        by_question.setdefault(question, []).append(option)
    tests = [(F.col("question_id") == q) & F.col("option_id").isin(ids) for q, ids in by_question.items()]
    return reduce(Column.__or__, tests, F.lit(False))


def union_respondents(answers: DataFrame, picks: Picks) -> DataFrame:
    """People holding any of the picks, each once."""
    return answers.filter(_among(picks)).select("respondent_id").distinct()


def _both(answers: DataFrame, a: Picks, b: Picks) -> DataFrame:
    wanted = answers.filter(_among([*a, *b]))
    return respondent_flags(wanted, {"in_a": _among(a), "in_b": _among(b)})


def except_respondents(answers: DataFrame, a: Picks, b: Picks) -> DataFrame:
    """People holding any of ``a`` but none of ``b``, from one scan."""
    return _both(answers, a, b).filter(F.col("in_a") & ~F.col("in_b")).select("respondent_id")


def intersect_respondents(answers: DataFrame, a: Picks, b: Picks) -> DataFrame:
    """People holding any of ``a`` and any of ``b``, from one scan."""
    return _both(answers, a, b).filter(F.col("in_a") & F.col("in_b")).select("respondent_id")


def undeclared(
    answers: DataFrame, options: DataFrame, respondents: DataFrame | None = None, segments: Sequence[str] = ()
) -> DataFrame:
    """What tables over declared lists leave out: options and segments that are not declared, with people.

    ``options`` holds (question_id, option_id). Rows: question_id (null for
    segments), name (null for a missing segment) and n.
    """
    keys = ["question_id", "option_id"]
    known = options.select(*keys).distinct().withColumn("_known", F.lit(True))
    counted = answered(answers).groupBy(*keys).agg(F.count_distinct("respondent_id").alias("n"))
    lost = counted.join(known, keys, "left").filter(F.col("_known").isNull())
    out = lost.select("question_id", F.col("option_id").alias("name"), "n")
    if respondents is None:
        return out
    outside = F.col("segment").isNull() | ~F.col("segment").isin(list(segments))
    people = respondents.filter(outside).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(people.select(F.lit(None).cast("string").alias("question_id"), F.col("segment").alias("name"), "n"))


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows found more often in one table than in the other, with side and number of extra copies.

    One signed count over both tables instead of two set differences.
    """
    signed = a.withColumn("_s", F.lit(1)).unionByName(b.withColumn("_s", F.lit(-1)))
    return (
        signed.groupBy(*a.columns)
        .agg(F.sum("_s").alias("_s"))
        .filter(F.col("_s") != 0)
        .withColumn("side", F.when(F.col("_s") > 0, F.lit("left")).otherwise(F.lit("right")))
        .withColumn("copies", F.abs("_s"))
        .drop("_s")
    )
