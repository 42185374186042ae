"""Joins of a large table to a dimension whose size is checked first."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A dimension is broadcast only when it has at most this many rows and bytes.
MAX_BROADCAST_ROWS = 50_000
MAX_BROADCAST_BYTES = 32 * 1024 * 1024
# A key is hot when it holds more than one row in this many.
HOT_SHARE = 1_000


def _width(field: T.StructField) -> Column:
    """Bytes of a column's value, without the row's own overhead."""
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(field.name), F.lit(0))
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.octet_length(F.to_json(F.struct(field.name)))
    return F.lit(8)


def fits_broadcast(dim: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Measure a dimension by one count over all its rows, done where they are."""
    width = reduce(Column.__add__, [_width(f) for f in dim.schema])
    size = dim.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return size["n"] <= max_rows and size["bytes"] <= max_bytes


def hot_keys(fact: DataFrame, on: Sequence[str], share: int = HOT_SHARE) -> DataFrame:
    """Keys holding more than one row in ``share``, at most ``share`` of them, with as many salts as it takes
    for each to hold one row in ``share`` again."""
    total = fact.count()
    counts = fact.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    salts = F.ceil(F.col("_rows") * share / max(1, total)).cast("int")
    return counts.filter(F.col("_rows") * share > total).select(*on, salts.alias("_salts"))


def salted_join(
    fact: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "left"
) -> DataFrame:
    """Shuffle join that spreads each hot key over as many tasks as its weight asks for.

    Only the hot keys of the dimension are copied. The salt is a hash of the
    row, so a task run again after a lost executor sends its rows to the same
    place. Rows with a missing key match nothing and are not shuffled at all. Sides
    that must keep unmatched dimension rows cannot be salted this way.
    """
    _check_kind(how)
    on = list(on)
    no_key = reduce(Column.__or__, [F.col(k).isNull() for k in on])
    keyed = fact.filter(~no_key)
    hot = F.broadcast(hot_keys(keyed, on))
    # Maps have no hash.
    hashed = [f.name for f in fact.schema if "map<" not in f.dataType.simpleString()]
    spread = F.pmod(F.xxhash64(*hashed), F.col("_salts")).cast("int")
    left = keyed.join(hot, on, "left").withColumn("_salt", F.coalesce(spread, F.lit(0)))
    copies = F.coalesce(F.sequence(F.lit(0), F.col("_salts") - 1), F.array(F.lit(0)))
    right = dim.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    # The dimension was measured as too large, whatever its files suggest.
    joined = left.drop("_salts").join(right.hint("merge"), [*on, "_salt"], how).drop("_salt")
    if how in ("inner", "left_semi"):
        return joined
    return joined.unionByName(fact.filter(no_key), allowMissingColumns=True)


def _check_kind(how: str) -> None:
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"cannot salt a {how} join")


def dimension_join(
    fact: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "left",
    max_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Join a large table to a dimension: broadcast if it measures small, else salted."""
    _check_kind(how)
    if fits_broadcast(dim, max_rows):
        return fact.join(F.broadcast(dim), list(on), how)
    return salted_join(fact, dim, on, how)
