"""Table shapes shared by every operator.

``answers`` is the long table everything is counted from: one row per pick.
Operators only need the columns they use, so a projection is enough.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RESPONDENT = "respondent_id"
QUESTION = "question_id"
OPTION = "option_id"

RESPONSES_SCHEMA = T.StructType(
    [
        T.StructField("respondent_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("home", T.IntegerType()),
        T.StructField("balance", T.DoubleType()),
        T.StructField("sector", T.StringType()),
    ]
)

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("question_id", T.StringType()),
        T.StructField("option_id", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("d", T.LongType()),
        T.StructField("pct", T.DoubleType()),
        T.StructField("reliability", T.StringType()),
        T.StructField("decision_use", T.StringType()),
        T.StructField("reading_note", T.StringType()),
    ]
)

CATALOGUE_SCHEMA = T.StructType(
    [
        T.StructField("figure_id", T.StringType()),
        T.StructField("part", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField(
            "items",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("ord", T.LongType()),
                        T.StructField("label", T.StringType()),
                        T.StructField("n", T.LongType()),
                        T.StructField("d", T.LongType()),
                        T.StructField("pct", T.DoubleType()),
                    ]
                )
            ),
        ),
    ]
)

# The seven figure types a catalogue may hold.
FIGURE_TYPES = (
    "hbar",
    "stacked-hbar",
    "donut",
    "diverging",
    "scatter-kano",
    "scatter-kano-panels",
    "grouped-hbar-layers",
)


def dimension(spark: SparkSession, **columns: Sequence) -> DataFrame:
    """A declared dimension (options, questions, labels) as a local relation.

    Built through Arrow, so Catalyst knows its exact size and can decide by
    itself whether to broadcast it.
    """
    return spark.createDataFrame(pa.table({name: list(values) for name, values in columns.items()}))
