"""Disclosure control over several attributes: linked margins, attacks on them, unsafe combinations.

A table over some attributes is published with all its totals. A *cell* is a combination
of values or totals; a *line* is what varies along one attribute while the others stay,
its parts adding up to its total. A cell can be had by subtraction when it is the only
hidden one of a line, so hiding goes on until no line has a lone hidden cell. The attack
test then bounds every hidden cell by all lines together.

Cells without people are not in the table: they reveal nobody and are never hidden.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyframe.session import settled


def with_totals(cells: DataFrame, dims: Sequence[str], within: Sequence[str] = (), n: str = "n") -> DataFrame:
    """(cell, n) for every combination of values and totals of ``dims``, by the columns ``within``.

    ``cell`` is a struct of ``within``, ``dims`` and ``level``, whose bit i is set where
    ``dims[i]`` is a total; so a null value is a value of its own. Rows are added up
    before they are copied to the totals.
    """
    base = cells.groupBy(*within, *dims).agg(F.sum(n).cast("long").alias("n"))
    sets = [[*within, *kept] for size in range(len(dims) + 1) for kept in combinations(dims, size)]
    level = F.lit(0)
    for i, d in enumerate(dims):
        level = level + F.shiftleft(F.grouping(d).cast("int"), i)
    rows = base.groupingSets(sets, *within, *dims).agg(F.sum("n").alias("n"), level.cast("int").alias("level"))
    return rows.where("n > 0").select(F.struct(*within, *dims, "level").alias("cell"), "n")


def _lines(table: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Each cell once for each line it is in: ``line``, and whether it is the line's ``total``."""
    kinds = {f.name: f.dataType for f in table.schema["cell"].dataType.fields}
    own = []
    for i, d in enumerate(dims):
        others = [F.lit(None).cast(kinds[c]).alias(c) if c == d else F.col(f"cell.{c}").alias(c) for c in kinds if c != "level"]
        bit = F.lit(1 << i)
        line = F.struct(F.lit(i).alias("axis"), F.col("cell.level").bitwiseAND(F.lit(~(1 << i))).alias("rest"), *others)
        own.append(F.struct(line.alias("line"), (F.col("cell.level").bitwiseAND(bit) != 0).alias("total")))
    return table.select("*", F.inline(F.array(*own)))


def _hide(table: DataFrame, picks: DataFrame) -> DataFrame:
    marked = table.join(picks.select("cell", F.lit(True).alias("pick")), "cell", "left")
    return settled(marked.withColumn("hidden", F.col("hidden") | F.col("pick").isNotNull()).drop("pick"), "cells")


def _cheapest() -> Column:
    """The visible cell with fewest people, parts before totals, ties by the values."""
    return F.min(F.when(~F.col("hidden"), F.struct("total", "n", "cell")))


def _cover_lone(table: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Hide a partner for every lone hidden cell of a line, over all lines at once, until none is left."""
    while True:
        lines = _lines(table, dims).groupBy("line").agg(
            F.count_if("hidden").alias("gone"), F.max("total").alias("with_total"), F.min("total").alias("no_part"), _cheapest().alias("partner")
        )
        lone = lines.where("gone = 1 and with_total and not no_part and partner is not null")
        picks = settled(lone.select("partner.cell").distinct(), "picks")
        if picks.isEmpty():
            return table
        table = _hide(table, picks)


def attack(table: DataFrame, dims: Sequence[str]) -> DataFrame:
    """``table`` (cell, n, hidden) with ``lo`` and ``hi``, what the published cells tell about each cell.

    A hidden cell holds one person at least, since empty cells are not hidden. Bounds
    are passed along all lines until none gets narrower; ``hi`` is null where nothing
    bounds a cell from above.
    """
    own = F.when(~F.col("hidden"), F.col("n"))
    table = settled(table.withColumns({"lo": F.coalesce(own, F.lit(1).cast("long")), "hi": own}), "bounds")
    part = lambda c: F.when(~F.col("total"), F.col(c))
    while True:
        members = _lines(table, dims)
        lines = members.groupBy("line").agg(
            F.count_if("hidden").alias("gone"),
            F.max(F.when(F.col("total"), F.struct("lo", "hi"))).alias("whole"),
            F.sum(part("lo")).alias("parts_lo"),
            F.sum(part("hi")).alias("parts_hi"),
            F.count_if(~F.col("total") & F.col("hi").isNull()).alias("open"),
        )
        lines = lines.where("gone > 0 and whole is not null and parts_lo is not null")
        seen = members.where("hidden").join(lines.drop("gone"), "line")
        others_open = F.col("open") - F.col("hi").isNull().cast("int")
        lo = F.when(F.col("total"), F.col("parts_lo")).otherwise(
            F.when(others_open == 0, F.col("whole.lo") - F.coalesce("parts_hi", F.lit(0)) + F.coalesce("hi", F.lit(0)))
        )
        hi = F.when(F.col("total"), F.when(F.col("open") == 0, F.col("parts_hi"))).otherwise(F.col("whole.hi") - F.col("parts_lo") + F.col("lo"))
        found = seen.groupBy("cell").agg(F.max(lo).alias("new_lo"), F.min(hi).alias("new_hi"))
        nearer = table.join(found, "cell", "left").withColumns(
            {"new_lo": F.greatest("lo", "new_lo"), "new_hi": F.least("hi", "new_hi")}
        )
        nearer = settled(nearer.withColumn("moved", (F.col("new_lo") > F.col("lo")) | ~F.col("new_hi").eqNullSafe(F.col("hi"))), "bounds")
        table = nearer.select("cell", "n", "hidden", F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"))
        if nearer.where("moved").isEmpty():
            return table


def protect_margins(cells: DataFrame, dims: Sequence[str], k: int, within: Sequence[str] = (), n: str = "n", against_bounds: bool = False) -> DataFrame:
    """(cell, n, hidden): which cells of the table with all its totals must not be published.

    Cells and totals of fewer than ``k`` people are hidden. Then, until no line has a
    lone hidden cell, its cheapest visible partner goes too: the smallest part, or the
    total where no part is left (so a lone cell beside empty ones is not had from its
    base). With ``against_bounds`` cells that ``attack`` still tells exactly get a
    partner as well, until it tells none, or all that could be hidden is.
    """
    table = settled(with_totals(cells, dims, within, n).withColumn("hidden", F.col("n") < k), "cells")
    while True:
        table = _cover_lone(table, dims)
        if not against_bounds:
            return table
        told = attack(table, dims).where("hidden and lo = hi").select("cell", F.lit(True).alias("told"))
        members = _lines(table.join(settled(told, "told"), "cell", "left"), dims)
        lines = members.groupBy("line").agg(F.count("told").alias("told"), _cheapest().alias("partner")).where("told > 0 and partner is not null")
        partners = members.where("told").select(F.col("cell").alias("of"), "line").join(lines, "line")
        picks = settled(partners.groupBy("of").agg(F.min("partner").alias("partner")).select("partner.cell").distinct(), "picks")
        if picks.isEmpty():
            return table
        table = _hide(table, picks)


def published(table: DataFrame) -> DataFrame:
    """The cells as columns, with the count of those that are not hidden."""
    return table.select("cell.*", F.when(~F.col("hidden"), F.col("n")).alias("n"), F.col("hidden").alias("suppressed"))


def unsafe_combinations(people: DataFrame, attributes: Sequence[str], k: int, most: int | None = None) -> DataFrame:
    """The smallest combinations of attributes that fewer than ``k`` people share: (attributes, values, n).

    A combination is listed when no part of it is unsafe by itself. Levels of one, two and
    more attributes (up to ``most``) are searched one after another over the distinct
    rows of all attributes; a row is not copied for sets that hold one found unsafe for
    it, so work goes down as combinations are found. Null is a value like others, shown
    as null. An unsafe combination is held by fewer than ``k`` rows, so what is joined
    back is small. ``values`` is an array of strings in the order of the attributes.
    """
    size = len(attributes)
    base = people.groupBy(*attributes).agg(F.count(F.lit(1)).alias("w"))
    base = settled(base.select(F.struct(*attributes).alias("row"), "w", F.array().cast("array<int>").alias("found")), "rows")
    kinds = {f.name: f.dataType for f in base.schema["row"].dataType.fields}
    out = None
    for level in range(1, min(size, most or size) + 1):
        sets = []
        for kept in combinations(range(size), level):
            mask = sum(1 << i for i in kept)
            part = F.struct(*(F.col(f"row.{a}").alias(a) if i in kept else F.lit(None).cast(kinds[a]).alias(a) for i, a in enumerate(attributes)))
            sets.append(F.struct(F.lit(mask).alias("mask"), part.alias("part")))
        copies = base.select("row", "w", "found", F.inline(F.array(*sets)))
        copies = copies.where(~F.exists("found", lambda m: m.bitwiseAND(F.col("mask")) == m))
        unsafe = copies.groupBy("mask", "part").agg(F.sum("w").alias("n")).where(F.col("n") < k)
        unsafe = settled(unsafe, "unsafe")
        out = unsafe if out is None else out.unionByName(unsafe)
        if level < size:
            again = copies.select("row", F.struct("mask", "part").alias("key")).join(unsafe.select(F.struct("mask", "part").alias("key")), "key")
            masks = again.groupBy("row").agg(F.collect_set("key.mask").alias("more"))  # at most one for each set
            base = base.join(masks, "row", "left").select("row", "w", F.concat("found", F.coalesce("more", F.array().cast("array<int>"))).alias("found"))
            base = settled(base, "rows")
    held = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
    named = F.filter(F.array(*(F.when(held(i), F.lit(a)) for i, a in enumerate(attributes))), lambda x: x.isNotNull())
    shown = F.filter(F.array(*(F.struct(held(i).alias("own"), F.col(f"part.{a}").cast("string").alias("v")) for i, a in enumerate(attributes))), lambda x: x.own)
    return out.select(F.array_join(named, ",").alias("attributes"), F.transform(shown, lambda x: x.v).alias("values"), F.col("n").cast("long").alias("n"))
