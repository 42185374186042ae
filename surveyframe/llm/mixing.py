"""Mixing sources to target weights by hierarchical budgets.

A token budget is passed down a tree (domain, language, source). Siblings share
their parent's budget by their weights, but none gets more than its subtree holds
in ``max_epochs`` epochs; what one falls short of goes to its siblings by their
weights. A subtree's limit counts all its leaves, so a shortage is made up for as
near as can be: by siblings first, and by an ancestor's siblings only when the
whole family is used up. All of this is done on one row per leaf.

A leaf's budget is spent on whole epochs first. The rest is a prefix of one more
epoch, whose order is that of a seeded hash: hash buckets below the border bucket
are taken whole, and only the border bucket's rows are summed up one by one. So no
task ever sees a leaf as a whole, however large it is.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyframe.llm.common import attach, settled

#: Hex digits of the hash that name a bucket: at most 16**4 buckets a leaf.
DIGITS = 4
#: Leaves up to which their table is broadcast; beyond, only that of the heaviest is.
LEAVES = 50_000

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of runs without ASCII white space."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def epoch_key(seed: int, epoch: Column, id_: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), id_.cast("string")).cast("binary"))


def with_leaf(df: DataFrame, leaves: DataFrame, weight: str) -> DataFrame:
    """Join rows to their leaf's row, also where one leaf holds most rows."""
    if leaves.limit(LEAVES + 1).count() <= LEAVES:
        return df.join(F.broadcast(leaves.drop(weight)), "leaf")
    return attach(df, leaves, "leaf", weight)


def _weight(level: str, weights: Mapping[str, Mapping[str, float]]) -> Column:
    given = weights.get(level, {})
    value = F.lit(1.0)
    for name, w in given.items():
        value = F.when(F.col(level) == name, F.lit(float(w))).otherwise(value)
    return value


def share(rows: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Split each parent's ``budget`` among its children by ``weight``, none above its ``cap``.

    Children are filled in the order of cap by weight: as long as the next one's cap
    is below its share of what is left, it gets all it can take.
    """
    order = Window.partitionBy(*parent).orderBy(F.expr("if(weight > 0, cap / weight, 0)"), child)
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    caps = F.sum(F.expr("if(weight > 0, cap, 0)"))
    left = F.col("budget") - F.coalesce(caps.over(before), F.lit(0.0))
    level = F.expr("if(weight_left > 0, greatest(left, 0D) / weight_left, 0D)")
    rows = rows.withColumn("left", left).withColumn("weight_left", F.sum("weight").over(rest)).withColumn("level", level)
    full = F.expr("weight > 0 and cap <= weight * level")
    # one level holds for all that are not full: the first one's
    first = F.min(F.when(~full & (F.col("weight") > 0), F.struct(F.expr("cap / weight").alias("o"), F.col(child), F.col("level"))))
    rows = rows.withColumn("first", first.over(Window.partitionBy(*parent)))
    got = F.expr("case when weight <= 0 then 0D when first is null then cap else least(cap, weight * first.level) end")
    return rows.withColumn("budget", got).drop("left", "weight_left", "level", "first")


def budgets(leaves: DataFrame, levels: list[str], weights: Mapping[str, Mapping[str, float]], budget: float, max_epochs: int) -> DataFrame:
    """leaves (levels, tokens, rows) with each one's budget in tokens, rounded down."""
    caps = leaves.withColumn("cap", F.col("tokens") * F.lit(float(max_epochs)))
    above = None
    for depth, level in enumerate(levels):
        path = levels[: depth + 1]
        nodes = caps.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(level, weights))
        if above is None:
            nodes = nodes.withColumn("budget", F.lit(float(budget))).withColumn("root", F.lit(0))
            above = share(nodes, ["root"], level).drop("root")
        else:
            nodes = nodes.join(above.select(*levels[:depth], "budget"), levels[:depth])
            above = share(nodes, levels[:depth], level)
    return leaves.join(above.select(*levels, "budget"), levels).withColumn("budget", F.floor(F.col("budget") + F.lit(1e-6)))


def mix(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[str, Mapping[str, float]],
    *,
    fraction: float,
    max_epochs: int = 1,
    seed: int = 0,
    tokens: Column | None = None,
    id_col: str = "doc_id",
    keep: list[str] | None = None,
) -> DataFrame:
    """Rows of ``docs`` to train on: (keep columns, tokens, epoch), a row for each time a document is used.

    ``levels`` names the tree's levels from the root, each a column of ``docs``;
    ``weights`` has the weights of names at a level, 1 where none is given, 0 to leave
    one out. The budget is ``fraction`` of all tokens, rounded down. A null level is a
    child of its own called ``(null)``. Documents without tokens cost nothing: they are
    in every epoch that is whole, and at the place of their hash in the last one. The
    prefix ends before the first document that would exceed the leaf's budget;
    documents of one hash (repeated rows or ids) are all taken or all left. Null ids
    hash like an id of that kind. Other columns are ignored unless kept; an empty table
    gives an empty result.
    """
    keep = [id_col] if keep is None else keep
    measure = words(F.col("text")) if tokens is None else tokens
    names = [f"level{k}" for k in range(len(levels))]
    weights = {n: weights.get(level, {}) for n, level in zip(names, levels, strict=True)}
    path = [F.coalesce(c.cast("string"), F.lit("(null)")) for c in levels.values()]
    rows = docs.select(
        F.struct(*keep).alias("kept"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("(null)")).alias("id"),
        F.coalesce(measure, F.lit(0)).cast("long").alias("tokens"),
        F.struct(*(c.alias(n) for n, c in zip(names, path, strict=True))).alias("leaf"),
    )
    rows = settled(rows, "rows")
    leaves = rows.groupBy("leaf").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    leaves = settled(leaves.select("leaf.*", "tokens", "rows"), "leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    planned = budgets(leaves, names, weights, int(total * fraction), max_epochs)
    whole = F.expr("if(tokens > 0, budget div tokens, 0L)")
    planned = planned.select(
        F.struct(*names).alias("leaf"), whole.alias("epochs"), F.expr("if(tokens > 0, budget % tokens, 0L)").alias("rest"), F.col("rows").alias("w")
    )
    planned = settled(planned, "planned")

    seated = with_leaf(rows, planned, "w").withColumn("h", epoch_key(seed, F.col("epochs") + 1, F.col("id")))
    seated = seated.withColumn("bucket", F.substring("h", 1, DIGITS))
    last = seated.where("rest > 0")
    buckets = last.groupBy("leaf", "bucket", "rest").agg(F.sum("tokens").alias("n"))
    order = Window.partitionBy("leaf").orderBy("bucket")
    buckets = buckets.withColumn("through", F.sum("n").over(order))
    # the border: the first bucket that goes beyond the budget, always there since rest < tokens
    border = buckets.where("through > rest").groupBy("leaf").agg(
        F.min("bucket").alias("border"), F.min(F.struct("bucket", (F.col("through") - F.col("n")).alias("before")))["before"].alias("before"), F.min("rest").alias("r")
    )
    border = settled(border.select("leaf", "border", "before", "r"), "border")
    inside = with_leaf(last.drop("rest"), border.withColumn("w", F.lit(1)), "w")
    below = inside.where("bucket < border")
    within = inside.where("bucket = border")
    hashes = within.groupBy("leaf", "h", "before", "r").agg(F.sum("tokens").alias("n"))
    hashes = hashes.withColumn("through", F.col("before") + F.sum("n").over(Window.partitionBy("leaf").orderBy("h")))
    taken = hashes.where("through <= r").select("leaf", "h")
    partial = below.unionByName(within.join(taken, ["leaf", "h"], "left_semi"))
    copies = seated.where("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("epochs"))))
    out = copies.select("kept", "tokens", "epoch").unionByName(partial.select("kept", "tokens", (F.col("epochs") + 1).alias("epoch")))
    return out.select("kept.*", "tokens", "epoch")


def mix_sql(levels: Mapping[str, str], weights: Mapping[str, Mapping[str, float]], *, fraction: float, max_epochs: int = 1, seed: int = 0, source: str = "documents", keep: str = "doc_id") -> str:
    """The same in DuckDB SQL; ``levels`` has SQL expressions."""
    names = [f"level{k}" for k in range(len(levels))]
    path = ", ".join(f"coalesce(cast({e} as varchar), '(null)') as {n}" for n, e in zip(names, levels.values(), strict=True))
    n_words = f"len(regexp_extract_all(coalesce(text, ''), '{WORD}'))"
    parts = [
        f"rows_ as (select {keep}, coalesce(cast(doc_id as varchar), '(null)') as id_, {n_words} as tokens, {path} from {source})",
        f"leaves as (select {', '.join(names)}, sum(tokens) as tokens from rows_ group by all)",
        f"b as (select floor(coalesce(sum(tokens), 0) * {fraction!r}) as budget from leaves)",
    ]
    for depth, (n, level) in enumerate(zip(names, levels, strict=True)):
        given = " ".join(f"when '{k}' then {float(w)!r}" for k, w in weights.get(level, {}).items())
        weight = f"case {n} {given} else 1.0 end" if given else "1.0"
        own, up = ", ".join(names[: depth + 1]), ", ".join(names[:depth])
        join = f"join n{depth - 1} using ({up})" if up else "cross join b"
        budget = f"any_value(n{depth - 1}.got)" if up else "any_value(b.budget)"
        by = f"partition by {up} " if up else ""
        parts += [
            f"c{depth} as (select {own}, cast(sum(tokens) * {float(max_epochs)!r} as double) as cap, cast({weight} as double) as weight, cast({budget} as double) as budget from leaves {join} group by {own})",
            f"l{depth} as (select *, greatest(budget - coalesce(sum(case when weight > 0 then cap else 0 end) over (w rows between unbounded preceding and 1 preceding), 0), 0)"
            f" / nullif(sum(weight) over (w rows between current row and unbounded following), 0) as level_"
            f" from c{depth} window w as ({by}order by case when weight > 0 then cap / weight else 0 end, {n}))",
            # the level of the first child that is not full holds for all
            f"f{depth} as (select *, min(case when weight > 0 and cap > weight * level_ then struct_pack(o := cap / weight, c := {n}, l := level_) end) over ({by}) as first_ from l{depth})",
            f"n{depth} as (select {own}, case when weight <= 0 then 0 when first_ is null then cap else least(cap, weight * first_.l) end as got from f{depth})",
        ]
    last, own = len(names) - 1, ", ".join(names)
    parts += [
        f"planned as (select {own}, case when tokens > 0 then cast(floor(got + 1e-6) as bigint) // tokens else 0 end as epochs, case when tokens > 0 then cast(floor(got + 1e-6) as bigint) % tokens else 0 end as rest from leaves join n{last} using ({own}))",
        f"hashed as (select *, md5('{seed}:' || cast(epochs + 1 as varchar) || ':' || id_) as h from rows_ join planned using ({own}))",
        f"partial as (select *, sum(tokens) over (partition by {own} order by h range between unbounded preceding and current row) as through from hashed where rest > 0)",
        f"out_ as (select {keep}, tokens, epochs + 1 as epoch from partial where through <= rest union all select {keep}, tokens, unnest(range(1, cast(epochs as bigint) + 1)) as epoch from hashed where epochs > 0)",
    ]
    return "with " + ",\n".join(parts) + f"\nselect {keep}, cast(tokens as bigint) as tokens, cast(epoch as bigint) as epoch from out_"
