"""Writing result tables, nested figure catalogues, and flattening them again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyframe.operators.audit import annotate_reliability


def write_answers(answers: DataFrame, path: str) -> None:
    """The long answer table in one folder per question, so that counting a question reads only its folder.

    Rebalancing brings a question's rows together for the write, and splits a
    question with very many rows over several tasks and files.
    """
    answers.hint("rebalance", F.col("question_id")).write.partitionBy("question_id").parquet(path)


def write_result(df: DataFrame, path: str) -> None:
    """One result table as CSV with its reliability, decision use and reading note."""
    annotate_reliability(df).write.option("header", True).csv(path)


def nest_items(
    cells: DataFrame, figure: Sequence[str], item: Sequence[str]
) -> DataFrame:
    """Figure records with their items as an array in questionnaire order, each with its ``ord``.

    For items of declared lists. Open lists, such as write-ins, are stored as the
    long rows they are (``write_result``).
    """
    return cells.groupBy(*figure).agg(
        F.sort_array(F.collect_list(F.struct("ord", *item))).alias("items")
    )


def nest_panels(
    cells: DataFrame, figure: Sequence[str], panel: str, panel_ord: str, item: Sequence[str]
) -> DataFrame:
    """Figure records with an array of panels, each with its items in order.

    For panels and items of declared lists: groups of respondents, and options
    or topics.
    """
    items = cells.groupBy(*figure, panel, panel_ord).agg(
        F.sort_array(F.collect_list(F.struct("ord", *item))).alias("items")
    )
    return items.groupBy(*figure).agg(F.sort_array(F.collect_list(F.struct(panel_ord, panel, "items"))).alias("panels"))


def nest_segment_cells(crosstab: DataFrame, figure: Sequence[str]) -> DataFrame:
    """Figure records of a crosstab: options in order, each a map of segment to its cell, and the segment bases."""
    by_option = crosstab.groupBy(*figure, "ord", F.col("option_id").alias("label")).agg(
        F.map_from_entries(F.collect_list(F.struct("segment", F.struct("n", "d", "pct")))).alias("byLayer"),
        F.collect_list(F.struct("segment", "d")).alias("_bases"),
    )
    options = F.collect_list(F.struct("ord", "label", "byLayer"))
    return by_option.groupBy(*figure).agg(
        # Maps cannot be compared, so the order is given by the questionnaire position alone.
        F.array_sort(options, lambda a, b: (a["ord"] - b["ord"]).cast("int")).alias("options"),
        F.map_from_entries(F.array_distinct(F.flatten(F.collect_list("_bases")))).alias("layerDenoms"),
    )


def write_catalogue(records: DataFrame, path: str, assign: str | None = None, field: str = "figures") -> None:
    """Figure records as JSON lines, or as a script when ``assign`` names a variable.

    Every line of the script adds its own record, so the files of all tasks, loaded
    in any order, make one catalogue.
    """
    if assign is None:
        records.write.json(path)
        return
    # the key printed as JSON: from {"a":"key"} without its frame
    key = F.to_json(F.struct(F.col("figure_id").alias("a")))
    key = F.substring(key, F.lit(6), F.length(key) - 6)
    start = F.lit(f"{assign} = {assign} || {{}}; ({assign}.{field} = {assign}.{field} || {{}})[")
    line = F.concat(start, key, F.lit("] = "), F.to_json(F.struct(*records.columns)), F.lit(";"))
    records.select(line.alias("value")).write.text(path)


def flatten_figure(figures: DataFrame, kind: str, order: Sequence[str] = ()) -> DataFrame:
    """Long data table of nested figures of one ``kind``.

    ``order`` lists the segments for segment cells; a segment an option has no
    cell for is left out.
    """
    chosen = figures.filter(F.col("type") == kind)
    if kind in ("hbar", "donut"):
        return _items(chosen, "label", "pct", "n", "d")
    if kind == "stacked-hbar":
        return _items(chosen, "label", "n3plus", "pct3plus", "n4plus", "pct4plus", "d")
    if kind == "scatter-kano":
        return _items(chosen, "num", "fullLabel", "si", "dsi", "quadrant")
    if kind == "diverging":
        return _panels(chosen, "group", "label", "groupPct", "basePct", "diffPts")
    if kind == "scatter-kano-panels":
        return _panels(chosen, "layer", "num", "fullLabel", "si", "dsi", "quadrant")
    if kind == "grouped-hbar-layers":
        options = chosen.select("figure_id", F.posexplode("options").alias("pos", "option"))
        cells = F.array(
            *[
                F.struct(F.lit(i + 1).alias("segment_ord"), F.lit(s).alias("segment"), F.col("option.byLayer")[s].alias("cell"))
                for i, s in enumerate(order)
            ]
        )
        rows = options.select("figure_id", (F.col("pos") + 1).alias("pos"), "option.label", F.inline(cells))
        return rows.filter(F.col("cell").isNotNull()).select(
            "figure_id", "pos", "label", "segment_ord", "segment", "cell.n", "cell.d", "cell.pct"
        )
    raise ValueError(f"unknown figure type: {kind}")


def _fields(struct: str, names: Sequence[str]) -> list[Column]:
    return [F.col(f"{struct}.{name}").alias(name) for name in names]


def _items(figures: DataFrame, *names: str) -> DataFrame:
    """Items with their place in the record, which holds all of a figure's items in order."""
    rows = figures.select("figure_id", F.posexplode("items").alias("pos", "item"))
    return rows.select("figure_id", (F.col("pos") + 1).alias("pos"), *_fields("item", names))


def _panels(figures: DataFrame, panel: str, *names: str) -> DataFrame:
    panels = figures.select("figure_id", F.posexplode("panels").alias("panel_pos", "panel"))
    rows = panels.select("figure_id", "panel_pos", f"panel.{panel}", F.posexplode("panel.items").alias("pos", "item"))
    return rows.select(
        "figure_id", (F.col("panel_pos") + 1).alias("panel_pos"), panel, (F.col("pos") + 1).alias("pos"), *_fields("item", names)
    )
