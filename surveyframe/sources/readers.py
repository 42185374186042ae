"""Reading responses, result folders, figure catalogues and report text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyframe.model import RESULT_SCHEMA


def read_responses(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False) -> DataFrame:
    """Cleaned response table from CSV, with its declared schema.

    A header that differs and a cell that is not of its column's type are errors.

    ``multiline`` allows line breaks inside quoted answers, and then reads each
    file in one task, so split such exports into many files.
    """
    return _csv(spark, schema, multiline).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def _csv(spark: SparkSession, schema: T.StructType, multiline: bool) -> DataFrameReader:
    return spark.read.schema(schema).option("header", True).option("multiLine", multiline)


def read_results(
    spark: SparkSession, glob: str, schema: T.StructType = RESULT_SCHEMA, multiline: bool = False
) -> DataFrame:
    """Every aggregate CSV under a glob, with the name of the table folder it came from.

    A header that differs from the schema, by name or order, and a cell that is not
    of its column's type are errors, since audits are made on what is read.
    """
    rows = _csv(spark, schema, multiline).option("enforceSchema", False).option("mode", "FAILFAST").csv(glob)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("table_name"), "*")


def read_catalogue(
    spark: SparkSession, path: str, schema: T.StructType, field: str = "figures", whole: bool = False
) -> DataFrame:
    """Figures stored as JSON behind script assignments.

    Either ``window.DATA = {...};`` with ``field`` as the map of figure id to record,
    or one line for each record, as ``write_catalogue`` makes them. ``whole`` reads a
    pretty-printed file as one document; otherwise large files are split between tasks.
    Blank lines and comments are passed over; any other line that cannot be read is an
    error, and so is JSON that does not fit.
    """
    value = F.col("value")
    raw = spark.read.text(path, wholetext=whole).filter(~value.rlike(r"^\s*(?://.*)?$"))
    one = F.regexp_extract(value, rf"(?s)\.{field} *\|\| *\{{\}}\)\[(\"(?:[^\"\\]|\\.)*+\")\] = (\{{.*\}});\s*$", 1)
    record = F.regexp_extract(value, rf"(?s)\.{field} *\|\| *\{{\}}\)\[(\"(?:[^\"\\]|\\.)*+\")\] = (\{{.*\}});\s*$", 2)
    all_of = F.regexp_extract(value, r"(?s)=\s*(\{.*\})\s*;?\s*$", 1)
    body = F.when(one != "", F.concat(F.lit(f'{{"{field}":{{'), one, F.lit(":"), record, F.lit("}}"))).when(all_of != "", all_of)
    unread = F.raise_error(F.concat(F.lit("not a figure assignment: "), F.substring(value, 1, 80))).cast("string")
    document = T.StructType([T.StructField(field, T.MapType(T.StringType(), schema))])
    parsed = raw.select(F.from_json(F.coalesce(body, unread), document, {"mode": "FAILFAST"}).alias("doc"))
    return parsed.select(F.explode(F.col("doc")[field]).alias("figure_key", "record")).select("figure_key", "record.*")


def read_tables(spark: SparkSession, path: str, schema: T.StructType, name: str) -> DataFrame:
    """A side table of a catalogue file: ``name`` is the path below the root, such as ``tables.extra`` or ``meta``.

    A list gives a row per record, a single record one row. The file is one document.
    """
    body = F.regexp_extract("value", r"(?s)=\s*(\{.*\})\s*;?\s*$", 1)
    found = F.get_json_object(body, "$." + name)
    listed = F.when(found.startswith("["), found).otherwise(F.concat(F.lit("["), found, F.lit("]")))
    rows = spark.read.text(path, wholetext=True).select(F.from_json(listed, T.ArrayType(schema), {"mode": "FAILFAST"}).alias("rows"))
    return rows.select(F.inline("rows"))


def paragraphs(documents: DataFrame, text: str = "text") -> DataFrame:
    """One row per non-empty line of a text, numbered from 1 within its document."""
    keys = [c for c in documents.columns if c != text]
    return documents.select(*keys, F.posexplode(_lines(F.col(text))).alias("para_no", "text")).withColumn(
        "para_no", F.col("para_no") + 1
    )


def _lines(text: Column) -> Column:
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    return F.filter(trimmed, lambda x: x != "")


def read_paragraphs(spark: SparkSession, path: str, record_sep: str | None = None) -> DataFrame:
    """Markdown or HTML report text as numbered paragraphs per file.

    With ``record_sep`` one file may hold many documents, and files are split
    between tasks at the separator; documents are then told apart by their
    first line.
    """
    if record_sep is None:
        docs = spark.read.text(path, wholetext=True).select(
            F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("doc"), F.col("value").alias("text")
        )
        return paragraphs(docs)
    records = spark.read.text(path, lineSep=record_sep)
    cut = F.instr("value", "\n")
    docs = records.filter(cut > 0).select(
        F.expr("substring(value, 1, instr(value, '\n') - 1)").alias("doc"),
        F.expr("substring(value, instr(value, '\n') + 1)").alias("text"),
    )
    return paragraphs(docs)
