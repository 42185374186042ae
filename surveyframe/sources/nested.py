"""Pretty-printed catalogues read by many tasks: records are cut out by the depth of their braces."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyframe.session import settled

# The depths at which a field of the document and a record of the field begin.
FIELD, RECORD = 1, 2


def _depth_change(line: Column) -> Column:
    """Braces and brackets opened less those closed; what stands in strings does not count."""
    bare = F.regexp_replace(line, r'"(?:[^"\\]|\\.)*+"', "")
    opened = F.length(F.regexp_replace(bare, r"[^{\[]+", ""))
    return (opened - F.length(F.regexp_replace(bare, r"[^}\]]+", ""))).cast("bigint")


def _carried(lines: DataFrame, out: str, value: Column, running, total, before) -> DataFrame:
    """A running value over all lines of a file, without a file in one task.

    ``running`` folds within a block, ``total`` over a whole block, and ``before`` joins
    both. Only the blocks' totals, one row for each, are put in order by file.
    """
    block = Window.partitionBy("file", "block").orderBy("at")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(total(value).alias("_total"))
    blocks = blocks.select("file", "block", running(F.col("_total")).over(earlier).alias("_before"))
    within = lines.withColumn("_within", running(value).over(block.rowsBetween(Window.unboundedPreceding, 0)))
    return within.join(blocks, ["file", "block"]).withColumn(out, before(F.col("_before"), F.col("_within"))).drop("_before", "_within")


def read_split_catalogue(spark: SparkSession, path: str, schema: T.StructType, field: str = "figures") -> DataFrame:
    """Figures of pretty-printed ``window.DATA = {...};`` files, each read by as many tasks as it has splits.

    Equal to ``read_catalogue(..., whole=True)`` without a file in one task. Lines keep their
    split and place, the depth of braces at each line is a sum over its split and the
    splits before, and the lines of a record meet by the place of its first line. Strings
    may hold any braces; a file may hold several assignments; commas after a last record
    are passed over, as are blank lines and lines of comment. ``field`` has to open on a
    line of its own, and so does its first record; a line that ends the field together with a
    record, or opens another field, is an error, and so is JSON that does not fit. A file without the
    field, or with an empty one, gives no rows.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    # read back, so that lines keep their places whatever is done again
    raw = settled(raw, "lines")
    lines = raw.filter(~F.col("value").rlike(r"^\s*(?://.*)?$")).withColumn("change", _depth_change(F.col("value")))
    after = _carried(lines, "after", F.col("change"), F.sum, F.sum, lambda b, w: F.coalesce(b, F.lit(0)) + w)
    deep = after.withColumn("depth", F.col("after") - F.col("change"))
    place = F.struct("block", "at")
    # the field a line is in, and the record: the latest line that begins one, the line itself included
    opens = F.regexp_extract("value", r'^\s*("(?:[^"\\]|\\.)*+")\s*:', 1)
    head = F.when(F.col("depth") <= FIELD, F.struct(place.alias("place"), F.col("depth"), opens.alias("key")))
    head = F.struct(head.alias("field"), F.when(F.col("depth") <= RECORD, place).alias("record"))

    def latest(x: Column) -> Column:
        return F.struct(F.max(x["field"]).alias("field"), F.max(x["record"]).alias("record"))

    def windowed(x: Column):
        return _Pair(F.max(x["field"]), F.max(x["record"]))

    def either(b: Column, w: Column) -> Column:
        return F.struct(F.greatest(b["field"], w["field"]).alias("field"), F.greatest(b["record"], w["record"]).alias("record"))

    found = _carried(deep, "head", head, windowed, latest, either)
    named = F.lit(json.dumps(field, ensure_ascii=False))
    inside = (F.col("head.field.depth") == FIELD) & (F.col("head.field.key") == named)
    told = F.col("value")
    opening = F.col("depth") == FIELD
    plain = told.rlike(r":\s*\{\s*$") | told.rlike(r":\s*\{\s*\}\s*,?\s*$")
    closing = (F.col("depth") == RECORD) & told.rlike(r"^\s*\}")
    unread = F.when(opening, ~plain).when(closing, F.col("after") >= RECORD).otherwise(F.col("after") < RECORD)
    error = F.raise_error(F.concat(F.lit("not a pretty-printed catalogue: "), F.substring(told, 1, 80))).cast("boolean")
    # one condition, so that lines of other fields are never tried
    body = found.filter(F.when(inside, F.when(unread, error).otherwise(~opening & ~closing)).otherwise(False))
    records = body.groupBy("file", F.col("head.record").alias("record")).agg(F.sort_array(F.collect_list(F.struct("block", "at", "value"))).alias("lines"))
    text = F.array_join(F.col("lines.value"), "\n")
    text = F.concat(F.lit("{"), F.regexp_replace(text, r",\s*$", ""), F.lit("}"))
    parsed = records.select(F.from_json(text, T.MapType(T.StringType(), schema), {"mode": "FAILFAST"}).alias("figures"))
    return parsed.select(F.explode("figures").alias("figure_key", "record")).select("figure_key", "record.*")


class _Pair:
    """Two running values side by side."""

    def __init__(self, field: Column, record: Column):
        self.field, self.record = field, record

    def over(self, window) -> Column:
        return F.struct(self.field.over(window).alias("field"), self.record.over(window).alias("record"))


def write_pretty_catalogue(records: DataFrame, path: str, assign: str, files: int, field: str = "figures") -> None:
    """Figure records as indented scripts, ``files`` of them, each a document with some of the records by key."""
    key = F.to_json(F.struct(F.col("figure_id").alias("a")))
    key = F.substring(key, F.lit(6), F.length(key) - 6)
    line = F.concat(key, F.lit(": "), F.to_json(F.struct(*records.columns), {"pretty": "true"}), F.lit(","))
    rows = records.select(F.pmod(F.xxhash64("figure_id"), F.lit(files)).alias("part"), F.lit(1).alias("kind"), line.alias("value"))
    for kind, value in ((0, f'{assign} = {{\n "{field}": {{'), (2, " }\n};")):
        rows = rows.unionByName(records.sparkSession.range(files).select(F.col("id").alias("part"), F.lit(kind).alias("kind"), F.lit(value).alias("value")))
    rows.repartition(files, "part").sortWithinPartitions("part", "kind").select("value").write.text(path)
