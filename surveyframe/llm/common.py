"""Helpers shared by the operators: slabs of text, id filters, joins of hot keys, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import io
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyframe import session
from surveyframe.session import scratch_path

__all__ = ["attach", "components", "delete_tables", "done_with", "id_bits", "keep_bits", "may_be_listed", "open_store", "prepare", "read", "release", "release_driver", "scratch_path", "scratch_tables", "settled", "slabs", "small_batches", "split_by_bits", "tidy", "total_of"]

#: Bytes of text that one step of a task works on.
SLAB = 1 << 20
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


_sent: set[str] = set()


def small_batches(spark: SparkSession, rows: int, size: int) -> None:
    """Lower the session's Arrow batches to at most so many rows and bytes; smaller settings stay."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        now = int(re.sub("[^0-9-]", "", spark.conf.get(f"spark.sql.execution.arrow.{name}")))
        if now <= 0 or now > most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def prepare(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, as ``--py-files`` would.

    Also bounds what is passed to Python at a time, since texts are long.
    """
    small_batches(spark, BATCH_ROWS, BATCH_BYTES)
    if spark.sparkContext.applicationId in _sent:
        return
    package, packed = Path(__file__).resolve().parent.parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    to = f"{scratch_path(spark, 'package')}.zip"
    store, path = open_store(to)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path, compression=None) as out:
        out.write(packed.getvalue())
    spark.sparkContext.addPyFile(to)
    _sent.add(spark.sparkContext.applicationId)


def release_driver(spark: SparkSession) -> None:
    """Let the driver give back what it no longer uses, and Spark delete shuffle files of tables that are written out by now.

    Its heap, too, shrinks at a full collection only, and what its threads have freed
    stays with them until it is trimmed; JVMs that cannot trim keep it.
    """
    gc.collect()
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    with contextlib.suppress(Py4JError):
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer().invoke(command, "systemTrimNativeHeap", None, None)
    tidy()


def settled(df: DataFrame, name: str) -> DataFrame:
    """As ``session.settled``; the driver, which sees many jobs, keeps little of each."""
    table = session.settled(df, name)
    release_driver(df.sparkSession)
    return table


def release(spark: SparkSession) -> None:
    """The driver and the executors give unused memory back, and Spark may delete shuffle files of tables that are written out by now.

    An executor's heap grows with the garbage of each job and shrinks at a full collection only.
    """
    release_driver(spark)
    if not spark.sparkContext._jsc.sc().isLocal():
        tasks = spark.sparkContext.defaultParallelism
        collected = spark.range(0, tasks, 1, tasks).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("none"))
        collected.write.format("noop").mode("overwrite").save()


def scratch_tables(spark: SparkSession) -> set[str]:
    """The tables in the shared scratch folder."""
    root = scratch_path(spark, "x").rpartition("/")[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return {x.getPath().toString() for x in store.listStatus(path)} if store.exists(path) else set()


def delete_tables(spark: SparkSession, paths: set[str]) -> None:
    for p in sorted(paths):
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def done_with(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more: what was made from them is a settled table itself."""
    for t in tables:
        delete_tables(t.sparkSession, {f.rpartition("/")[0] for f in t.inputFiles()})
    release(tables[0].sparkSession)


def total_of(df: DataFrame, column: str) -> int:
    return df.agg(F.sum(column)).first()[0] or 0


def tidy() -> None:
    """Hand freed memory back to the system: Python workers outlive their tasks, and share a node's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slabs(batch: pa.RecordBatch, name: str = "text", limit: int = SLAB) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a batch with the bytes of their texts (null: empty) and each text's bounds.

    A slab holds whole texts: many short ones, or a single long one.
    """
    tidy()
    col = pc.fill_null(batch.column(name).cast(pa.large_binary()), b"")
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
    tidy()


def attach(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join to a table with one row per key, where a key may hold any share of the left rows.

    ``weight`` is a column of the right side that bounds or counts the key's left
    rows. Keys above a thousandth of their sum are at most a thousand: they are
    broadcast; the rows of all others are shuffled. The weight is dropped.
    """
    total = total_of(right, weight)
    hot = F.col(weight) * 1000 > F.lit(total)
    cold_side = right.where(~hot).drop(weight)
    hot_side = right.where(hot).drop(weight).withColumn("_hot", F.lit(True))
    tried = left.join(F.broadcast(hot_side), key, "left")
    done = tried.where("_hot").drop("_hot")
    names = [c for c in right.columns if c not in (key, weight)]
    rest = tried.where(F.col("_hot").isNull()).drop("_hot", *names).join(cold_side, key, "left")
    return done.unionByName(rest)


def id_bits(hashes: DataFrame, column: str, bits: int = 22) -> np.ndarray:
    """A bit map of hashed ids, at most 2**bits bits whatever the number of ids.

    It only ever spares work: an id that is in the table always passes, and an exact
    join follows.
    """
    at = F.pmod(F.col(column), F.lit(1 << bits))
    words = (
        hashes.select(F.shiftright(at, 5).alias("w"), F.expr("1L").alias("one"), at.bitwiseAND(F.lit(31)).cast("int").alias("b"))
        .groupBy("w")
        .agg(F.bit_or(F.expr("shiftleft(one, b)")).alias("v"))
    )
    table = np.zeros(1 << (bits - 5), np.uint32)
    got = words.toPandas()
    table[got["w"].to_numpy(np.int64)] = got["v"].to_numpy(np.int64).astype(np.uint32)
    return table


def keep_bits(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of the 64-bit hashes may be in the table of ``id_bits``."""
    at = hashes & (len(table) * 32 - 1)
    return (table[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1


def split_by_bits(df: DataFrame, hash_column: str, bits, listed: bool) -> DataFrame:
    """Rows whose hash may be in the bit map (broadcast), or those whose is surely not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep_bits(batch.column(hash_column).to_numpy(), bits.value) == listed))

    return df.mapInArrow(run, df.schema)


def may_be_listed(hashes: Column, bits) -> Column:
    """Whether a hash may be in the bit map (broadcast); only the hashes pass through Python, not their rows."""

    def told(values: pa.Array) -> pa.Array:
        return pa.array(keep_bits(values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False), bits.value))

    return F.arrow_udf(told, "boolean")(hashes)


def _towards_smallest(pairs: DataFrame) -> DataFrame:
    """(v, u) -> (v, u, m) with m the smallest u of v. Both sides are shuffled, so heavy keys can be split at run time."""
    return pairs.join(pairs.groupBy("v").agg(F.min("u").alias("m")), "v")


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a node that has none itself."""
    ends = edges.select(F.col("v").alias("x"), F.lit(1).alias("below")).unionByName(edges.select(F.col("u").alias("x"), F.lit(0).alias("below")))
    found = ends.groupBy("x").agg(F.sum("below").alias("below"), F.min("below").alias("top"))
    return found.where("below > 1 or below = 1 and top = 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): the smallest node it is connected to.

    Large-star and small-star steps by turns until only stars are left; every round is
    written to the shared folder, so a lost executor costs one round. Nodes that
    are only linked with themselves are left out.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    e = settled(e, "edges")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        large = _towards_smallest(both).where("u > v").select(F.col("u").alias("v"), F.least("v", "m").alias("u")).distinct()
        small = _towards_smallest(settled(large, "edges"))
        small = small.select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").unionByName(small.select("v", F.col("m").alias("u")))
        e = settled(small.distinct(), "edges")
    tops = e.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct()
    return e.select(F.col("v").alias("node"), F.col("u").alias("label")).unionByName(tops)
