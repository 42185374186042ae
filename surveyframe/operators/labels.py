"""Labels: lookup, override and translation of result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyframe.functions.joins import dimension_join


def with_label(df: DataFrame, labels: DataFrame, key: str, out: str = "label") -> DataFrame:
    """Look a label up by key; a key without a label is its own label. ``labels`` holds (key, label)."""
    dim = labels.select(F.col("key").alias(key), F.col("label").alias("_label"))
    return dimension_join(df, dim, [key]).withColumn(out, F.coalesce(F.col("_label"), F.col(key).cast("string"))).drop("_label")


def overlay(defaults: DataFrame, overrides: DataFrame, key: Sequence[str]) -> DataFrame:
    """A keyed table with some rows replaced and new keys added; a replacement is taken whole."""
    values = [c for c in defaults.columns if c not in key]
    new = overrides.select(*key, F.struct(*values).alias("_new"))
    old = defaults.select(*key, F.struct(*values).alias("_old"))
    row = F.coalesce("_new", "_old")
    return old.join(new, list(key), "full_outer").select(*key, *[row[v].alias(v) for v in values])


def translate(results: DataFrame, dictionary: DataFrame, lang: str, columns: Sequence[str]) -> DataFrame:
    """Replace label text by its translation; numbers stay as they are.

    ``dictionary`` holds (lang, source, target). Text without an entry stays.
    """
    entries = dictionary.filter(F.col("lang") == lang)
    for c in columns:
        dim = entries.select(F.col("source").alias(c), F.col("target").alias("_target"))
        results = dimension_join(results, dim, [c]).withColumn(c, F.coalesce("_target", c)).drop("_target")
    return results
