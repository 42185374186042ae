"""Paragraphs of a text and its translation laid side by side, also where one of them was edited.

Paragraphs are compared by the numbers in them. Those whose numbers occur once on either
side of a document are anchors; the longest chain of anchors in the order of both sides
parts the document into gaps, and within a gap paragraphs are paired at the least cost.
Documents with the same numbers in the same order are settled before, by one digest.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyframe.operators.audit import NUMBER
from surveyframe.session import settled

#: Paragraphs on one side of a gap up to which all pairings are tried; beyond, those near its diagonal.
BAND = 200


def numbers_in(text: Column) -> Column:
    """The sorted numbers of a text as numbers: without grouping commas, leading zeros or trailing decimal zeros."""

    def plain(x: Column) -> Column:
        x = F.regexp_replace(F.replace(x, F.lit(","), F.lit("")), r"^0+(?=[0-9])", "")
        return F.when(x.contains("."), F.regexp_replace(x, r"\.?0+$", "")).otherwise(x)

    return F.sort_array(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), plain))


def _chain(anchors: pd.DataFrame) -> pd.DataFrame:
    """The longest chain of anchors rising on both sides, of those the one whose places are smallest."""
    rows = anchors.sort_values("source_no", ignore_index=True)
    ends, at, before = [], [], []
    for k, y in enumerate(rows["target_no"].tolist()):
        i = bisect_left(ends, y)
        before.append(at[i - 1] if i else -1)
        ends[i : i + 1] = [y]
        at[i : i + 1] = [k]
    kept, k = [], at[-1] if at else -1
    while k >= 0:
        kept.append(k)
        k = before[k]
    return rows.iloc[kept[::-1]][["doc", "h", "source_no", "target_no"]]


def _cost(a: Counter, b: Counter) -> float:
    """0 for the same numbers; a changed pair costs less than a deletion and an insertion, the less the more is shared."""
    if a == b:
        return 0.0
    shared, most = sum((a & b).values()), max(sum(a.values()), sum(b.values()))
    return 1.0 + 0.9 * (1 - shared / most) if shared else 1.95


def pair_up(source: list[list[str]], target: list[list[str]], band: int = BAND) -> list[tuple[int | None, int | None]]:
    """Places paired at the least cost, in order; None where a paragraph stands alone (cost 1).

    Pairs farther than ``band`` places from the gap's diagonal are not tried.
    """
    a, b = [Counter(x) for x in source], [Counter(x) for x in target]
    n, m = len(a), len(b)
    reach = band + abs(n - m)
    lo = [max(0, i * m // max(n, 1) - reach) for i in range(n + 1)]
    hi = [min(m, i * m // max(n, 1) + reach) for i in range(n + 1)]
    far = float("inf")
    cost = [float(j) for j in range(hi[0] + 1)]
    steps: list[bytearray] = [bytearray(b"\2" * (hi[0] + 1))]
    prior_lo, prior = 0, cost
    for i in range(1, n + 1):
        row, step = [], bytearray()
        for j in range(lo[i], hi[i] + 1):
            up = prior[j - prior_lo] + 1 if prior_lo <= j < prior_lo + len(prior) else far
            left = row[-1] + 1 if row else far
            both = prior[j - 1 - prior_lo] + _cost(a[i - 1], b[j - 1]) if j and prior_lo <= j - 1 < prior_lo + len(prior) else far
            best = min(both, up, left)
            row.append(best)
            step.append(0 if best == both else 1 if best == up else 2)
        steps.append(step)
        prior_lo, prior = lo[i], row
    i, j, out = n, m, []
    while i or j:
        way = steps[i][j - lo[i]]
        out.append((i - 1 if way != 2 else None, j - 1 if way != 1 else None))
        i, j = i - (way != 2), j - (way != 1)
    return out[::-1]


def _pair_gap(rows: pd.DataFrame) -> pd.DataFrame:
    """One gap's paragraphs of both sides: those that don't have a partner with the same numbers."""
    side = {s: rows[rows["side"] == s].sort_values(["no", "h"]) for s in (0, 1)}
    numbers = {s: [list(x) for x in side[s]["numbers"]] for s in side}
    places = {s: side[s]["no"].tolist() for s in side}
    out = []
    for i, j in pair_up(numbers[0], numbers[1]):
        x, y = (numbers[0][i] if i is not None else None), (numbers[1][j] if j is not None else None)
        if x != y:
            kind = "changed" if x is not None and y is not None else "only in source" if y is None else "only in target"
            out.append((rows["doc"].iloc[0], *(places[s][k] if k is not None else None for s, k in ((0, i), (1, j))), " ".join(x or []), " ".join(y or []), kind))
    got = pd.DataFrame(out, columns=["doc", "source_no", "target_no", "numbers_source", "numbers_target", "kind"])
    return got.astype({"source_no": "Int64", "target_no": "Int64"})


def align_translation(source: DataFrame, target: DataFrame, *, doc: str = "doc_id", no: str = "para_no", text: str = "text") -> DataFrame:
    """Where the numbers of a text and its translation part: (doc, source_no, target_no, numbers_source, numbers_target, kind).

    One row for each paragraph with numbers that has no partner with the same numbers:
    ``changed`` for a pair that differs, else ``only in source`` or ``only in target``;
    so an inserted paragraph is one row, and those after it are none. Numbers are
    compared as numbers (1,200 is 1200). Paragraphs without any are left out. A document
    on one side only has all its paragraphs there. Rows with a null document or place are
    left out; of paragraphs with one place, all count, in some fixed order.

    A document's anchors (two places each) meet in one task; its paragraphs only gap by
    gap. Gaps are paired within a band of some hundred places.
    """

    def told(paragraphs: DataFrame, side: int) -> DataFrame:
        rows = paragraphs.where(F.col(doc).isNotNull() & F.col(no).isNotNull() & F.col(text).rlike("[0-9]"))
        rows = rows.select(F.col(doc).alias("doc"), F.col(no).cast("long").alias("no"), F.lit(side).alias("side"), numbers_in(F.col(text)).alias("numbers"))
        return rows.where(F.size("numbers") > 0)

    rows = told(source, 0).unionByName(told(target, 1))
    rows = settled(rows.withColumn("h", F.xxhash64("numbers")), "paragraphs")
    # documents alike: the same numbers at the same places, or all moved by as much
    sign = F.when(F.col("side") == 0, 1).otherwise(-1)
    first = F.min(F.when(F.col("side") == 0, F.col("no"))), F.min(F.when(F.col("side") == 1, F.col("no")))
    starts = rows.groupBy("doc").agg(first[0].alias("first_0"), first[1].alias("first_1"), F.sum(sign).alias("more"))
    starts = starts.where("more = 0 and first_0 is not null")
    placed = rows.join(starts.select("doc", "first_0", "first_1"), "doc")
    at = F.col("no") - F.when(F.col("side") == 0, F.col("first_0")).otherwise(F.col("first_1"))
    digest = [F.sum(F.pmod(F.xxhash64(F.lit(k), at, "numbers"), F.lit(1 << 40))).alias(f"x{k}") for k in (0, 1, 2)]
    alike = placed.groupBy("doc", "side").agg(*digest).groupBy("doc", "x0", "x1", "x2").agg(F.count("*").alias("sides")).where("sides = 2")
    rows = settled(rows.join(alike.select("doc"), "doc", "left_anti"), "paragraphs")

    single = rows.groupBy("doc", "numbers", "h").agg(
        F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"),
        F.max(F.when(F.col("side") == 0, F.col("no"))).alias("source_no"), F.max(F.when(F.col("side") == 1, F.col("no"))).alias("target_no"),
    ).where("n0 = 1 and n1 = 1")
    kind = rows.schema["doc"].dataType.simpleString()
    chain = single.groupBy("doc").applyInPandas(_chain, f"doc {kind}, h long, source_no long, target_no long")
    chain = settled(chain, "anchors")
    marks = chain.select("doc", "h", F.col("source_no").alias("no"), F.lit(0).alias("side")).unionByName(
        chain.select("doc", "h", F.col("target_no").alias("no"), F.lit(1).alias("side"))
    )
    # an anchor opens the gap after it; a gap is known by how many anchors come before
    marked = rows.join(marks.withColumn("mark", F.lit(1)), ["doc", "no", "side", "h"], "left")
    so_far = Window.partitionBy("doc", "side").orderBy("no").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    gaps = marked.withColumn("gap", F.coalesce(F.sum("mark").over(so_far), F.lit(0)))
    place = Window.partitionBy("doc", "gap", "side").orderBy("no", "h")
    inside = gaps.where("mark is null").select("doc", "gap", "side", "no", "numbers", "h", F.row_number().over(place).alias("at"))
    inside = settled(inside, "gaps")
    here = lambda side, x: F.when(F.col("side") == side, x)
    n = [F.count(here(k, F.lit(1))).alias(f"n{k}") for k in (0, 1)]
    same = [
        (F.sum(here(0, x)) == F.sum(here(1, x))) for x in (F.pmod(F.xxhash64(F.lit(k), "at", "numbers"), F.lit(1 << 40)) for k in (0, 1, 2))
    ]
    kinds = inside.groupBy("doc", "gap").agg(*n, F.coalesce(same[0] & same[1] & same[2], F.lit(False)).alias("same")).where("not same or n0 <> n1")
    held = inside.join(kinds, ["doc", "gap"])
    # gaps on one side only, or of one paragraph each, need no search
    pair = held.where("n0 <= 1 and n1 <= 1 or n0 = 0 or n1 = 0")
    own = lambda side, c: F.max(here(side, F.col(c)))
    easy = pair.groupBy("doc", "gap", "at").agg(
        own(0, "no").alias("source_no"), own(1, "no").alias("target_no"), own(0, "numbers").alias("x"), own(1, "numbers").alias("y")
    )
    shown = lambda c: F.coalesce(F.array_join(c, " "), F.lit(""))
    kind_of = F.when(F.col("x").isNull(), "only in target").when(F.col("y").isNull(), "only in source").otherwise("changed")
    easy = easy.select("doc", "source_no", "target_no", shown("x").alias("numbers_source"), shown("y").alias("numbers_target"), kind_of.alias("kind"))
    inside = held.where("n0 > 0 and n1 > 0 and (n0 > 1 or n1 > 1)").select("doc", "gap", "side", "no", "numbers", "h")
    fields = f"doc {kind}, source_no long, target_no long, numbers_source string, numbers_target string, kind string"
    return inside.groupBy("doc", "gap").applyInPandas(_pair_gap, fields).unionByName(easy).withColumnRenamed("doc", doc)
