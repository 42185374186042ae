"""Column expressions for shares and their printed forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def answered(answers: DataFrame) -> DataFrame:
    """The rows of an answer table that hold an answer: an option, a value or a text that is not blank.

    Every base counts these rows only, so that operators agree on who answered.
    """
    present = F.lit(False)
    for column, kind in answers.dtypes:
        if column in ("option_id", "value", "text"):
            filled = F.trim(column) != "" if kind == "string" else F.col(column).isNotNull()
            present = present | F.coalesce(filled, F.lit(False))
    return answers.filter(present)


def share(n: Column | str, d: Column | str) -> Column:
    """n over d as a fraction; null when the base is empty."""
    return F.try_divide(F.col(n) if isinstance(n, str) else n, F.col(d) if isinstance(d, str) else d)


def whole_percent(p: Column) -> Column:
    """Whole percent, halves up."""
    return F.floor(p * 100 + F.lit(0.5))


def _tenths(p: Column) -> Column:
    return F.floor(p * 1000 + F.lit(0.5))


def one_decimal(p: Column) -> Column:
    """Percent to one decimal, halves up."""
    return _tenths(p) / 10


def whole_percent_text(p: Column) -> Column:
    return F.concat(whole_percent(p).cast("string"), F.lit("%"))


def one_decimal_text(p: Column) -> Column:
    tenths = _tenths(p)
    # Built from the integer so that 6 prints as 0.6% in every engine.
    return F.concat(
        F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit("%")
    )


def evidence_text(n: Column, d: Column) -> Column:
    """Share with its evidence, e.g. ``38% (18/47)``."""
    return F.concat(
        whole_percent_text(share(n, d)), F.lit(" ("), n.cast("string"), F.lit("/"), d.cast("string"), F.lit(")")
    )


def fixed(x: Column, places: int) -> Column:
    """Stored rounding to a fixed number of decimals, halves up."""
    unit = float(10**places)
    return F.floor(x * unit + F.lit(0.5)) / F.lit(unit)
