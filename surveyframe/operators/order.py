"""Scaling, running shares, ranks and orders of result cells.

Windows here run over counted cells of catalogue questions, so a partition has
as many rows as its question has declared options. ``rank_open_options`` and
``order_open_options`` are for option lists without such a bound. Orders are given as a position column,
because a DataFrame has no row order of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyframe.functions.expressions import share
from surveyframe.session import settled


def scale_to_max(cells: DataFrame, by: Sequence[str] = ("question_id",), value: str = "pct") -> DataFrame:
    """Each share relative to the largest of its question; a largest share of 0 counts as 1."""
    top = F.max(value).over(Window.partitionBy(*by))
    return cells.withColumn("scaled", F.col(value) / F.when(top == 0, F.lit(1.0)).otherwise(top))


def cumulative_share(cells: DataFrame, by: Sequence[str] = ("question_id",)) -> DataFrame:
    """Where each option's slice starts and ends in its question's whole, in fixed order."""
    running = Window.partitionBy(*by).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy(*by))
    end = F.sum("n").over(running)
    return cells.withColumns({"start_share": share(end - F.col("n"), total), "end_share": share(end, total)})


def running_offset(counts: DataFrame, scores: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    """Where each score's segment begins along an item's bar of rating counts.

    The five counts of an item share a row, so the running sum needs no window.
    """
    parts, offset = [], F.lit(0).cast("bigint")
    for s in scores:
        parts.append(F.struct(F.lit(s).alias("score"), F.col(f"c{s}").alias("n"), offset.alias("start_n")))
        offset = offset + F.col(f"c{s}")
    keep = [c for c in counts.columns if c not in {f"c{s}" for s in scores}]
    return counts.select(*keep, F.inline(F.array(*parts)))


def rank_options(cells: DataFrame, by: Sequence[str] = ("question_id",)) -> DataFrame:
    """Rank by count; equal counts share a rank."""
    return cells.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(F.desc("n"))))


def rank_open_options(cells: DataFrame, by: Sequence[str] = ("question_id",)) -> DataFrame:
    """The same rank for option lists of any length, such as write-ins kept verbatim.

    Ranks come from how many options share each count. A question has few
    different counts however many options it has, since N picks allow fewer
    than the root of 2N, so no task receives a question's whole option list.
    """
    same = cells.groupBy(*by, "n").agg(F.count(F.lit(1)).alias("_same"))
    ahead = Window.partitionBy(*by).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = same.select(*by, "n", (F.coalesce(F.sum("_same").over(ahead), F.lit(0)) + 1).alias("rank"))
    return cells.join(ranks, [*by, "n"])


#: Rows of an open list that one task numbers.
BLOCK_ROWS = 200_000


def _running(cells: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``cells`` with ``position`` and ``reached``, the sum of ``n`` up to the row, in order within ``by``.

    Rows are put in order over ranges of the whole table, numbered and added up within
    each range, and what earlier ranges of a question hold is joined back: a question's
    list may be of any length, and no task receives it whole.
    """
    blocks = max(1, -(-cells.count() // BLOCK_ROWS))
    rows = cells.repartitionByRange(blocks, *by, *order).withColumn("_block", F.spark_partition_id())
    rows = settled(rows, "ordered")
    sums = rows.groupBy(*by, "_block").agg(F.count(F.lit(1)).alias("_rows"), F.sum("n").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("_rows", "_n")]
    own = Window.partitionBy(*by, "_block").orderBy(*order)
    placed = rows.withColumns({"_at": F.row_number().over(own), "_sum": F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, 0))})
    joined = placed.join(sums.select(*by, "_block", *before), [*by, "_block"])
    numbered = joined.withColumns({"position": F.col("_at") + F.col("_rows_before"), "reached": F.col("_sum") + F.col("_n_before")})
    return numbered.drop("_block", "_at", "_sum", "_rows_before", "_n_before")


def order_open_options(cells: DataFrame, by: Sequence[str] = ("question_id",), option: str = "option_id") -> DataFrame:
    """Position by share, and where the option's slice starts and ends in that order, for lists of any length.

    Write-ins have no place in the questionnaire: equal counts are ordered by the option.
    """
    totals = cells.groupBy(*by).agg(F.sum("n").alias("_total"))
    placed = _running(cells, by, [F.desc("n"), F.asc(option)]).join(totals, list(by))
    shares = {"start_share": share(F.col("reached") - F.col("n"), F.col("_total")), "end_share": share(F.col("reached"), F.col("_total"))}
    return placed.withColumns(shares).drop("reached", "_total")


def _position(cells: DataFrame, by: Sequence[str], *order: Column) -> DataFrame:
    return cells.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def order_by_share(cells: DataFrame, by: Sequence[str] = ("question_id",)) -> DataFrame:
    """Largest share first, questionnaire order between equals."""
    return _position(cells, by, F.desc("n"), F.asc("ord"))


def order_by_total(crosstab: DataFrame, by: Sequence[str] = ("question_id",)) -> DataFrame:
    """Options by picks over all segments, largest first."""
    summed = crosstab.withColumn("n_total", F.sum("n").over(Window.partitionBy(*by, "option_id")))
    order = Window.partitionBy(*by).orderBy(F.desc("n_total"), F.asc("ord"))
    return summed.withColumn("position", F.dense_rank().over(order))


def order_by_segment(crosstab: DataFrame, segment: str, by: Sequence[str] = ("question_id",)) -> DataFrame:
    """Options by one segment's share; an option without a cell there counts as 0."""
    shares = F.coalesce(F.max(F.when(F.col("segment") == segment, F.col("pct"))), F.lit(0.0))
    options = crosstab.groupBy(*by, "option_id").agg(F.min("ord").alias("ord"), shares.alias("segment_pct"))
    return _position(options, by, F.desc("segment_pct"), F.asc("ord"))


def order_fixed(cells: DataFrame, by: Sequence[str] = ("question_id",)) -> DataFrame:
    """Questionnaire order, shallow to deep."""
    return _position(cells, by, F.asc("ord"))


def order_by_topbox(items: DataFrame, by: Sequence[str] = ("question_id",), count: str = "n3plus") -> DataFrame:
    """Items by top-box count, questionnaire order between equals."""
    return _position(items, by, F.desc(count), F.asc("ord"))


def order_by_gap(gaps: DataFrame, group: str) -> DataFrame:
    """Options of each group from furthest above to furthest below the overall share."""
    return _position(gaps, [group], F.desc("diff_pts"), F.asc("ord"))


def top_k(cells: DataFrame, k: int, by: Sequence[str] = ("question_id",)) -> DataFrame:
    """The ``k`` largest options of each question; each task keeps ``k`` before the shuffle."""
    return order_by_share(cells, by).filter(F.col("position") <= k)


def only_segment(crosstab: DataFrame, segment: str) -> DataFrame:
    return crosstab.filter(F.col("segment") == segment)
