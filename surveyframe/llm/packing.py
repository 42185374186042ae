"""Packing token sequences by harmonic classes.

A document's ids are cut into pieces. A piece of length x is in class ``j = capacity
// x``: j pieces of the class fit into one sequence, each in its slot of ``capacity
// j``. So every sequence of class j takes j pieces, whichever they are, and workers
fill sequences without knowing of each other: a piece's place follows from its rank
in its class, which is its rank within its task plus the counts of earlier tasks.

Whole capacities are cut off first. A rest whose slot would stay emptier than
``slack`` gives off a piece that fills the next smaller slot, and so on; so little
is padded and few cuts are made. Only the last sequence of each class may be short;
those (fewer pieces than the sum of all j, whatever the corpus) share sequences by
first fit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyframe.llm.common import prepare, settled, slabs
from surveyframe.llm.encoding import word_chunks, word_encoder


def cut(tokens: int, capacity: int, slack: int) -> list[int]:
    """Lengths of a document's pieces; a slot may be padded by one part in ``slack``."""
    out, rest = [capacity] * (tokens // capacity), tokens % capacity
    while rest:
        j = capacity // rest
        slot = capacity // j
        if (slot - rest) * slack <= slot:
            out.append(rest)
            break
        out.append(capacity // (j + 1))
        rest -= out[-1]
    return out


def _pieces(path: str, capacity: int, end_id: int, slack: int, ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, used = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at, _, buf, bounds in slabs(batch):
                e = word_encoder(path)
                start, stop = word_chunks(buf, bounds)
                rows = e.rows(buf, start, stop)
                flat = e.flat(rows)
                ends = np.concatenate(([0], np.cumsum(e.counts(rows), dtype=np.int64)))[np.searchsorted(start, bounds)]
                doc, first, length, crc, total, own = [], [], [], [], [], []
                for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                    x, lo = np.append(flat[a:b], np.uint32(end_id)).astype("<u4"), 0
                    for n in cut(len(x), capacity, slack):
                        doc.append(at + k)
                        first.append(lo)
                        length.append(n)
                        crc.append(zlib.crc32(x[lo : lo + n]))
                        total.append(len(x))
                        if ids:
                            own.append(x[lo : lo + n].astype(np.int32))
                        lo += n
                kind = capacity // np.array(length)
                order = np.argsort(kind, kind="stable")  # rank within the class and task
                k = kind[order]
                new = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
                size = np.diff(np.append(new, len(k)))
                rank = np.empty(len(k), np.int64)
                rank[order] = np.arange(len(k)) - np.repeat(new, size) + used[k]
                used[k[new]] += size
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(doc, pa.int64())),
                        *(pa.array(c, pa.int64()) for c in (first, length, crc, total, kind, np.full(len(k), task), rank)),
                        *([pa.array(own, pa.list_(pa.int32()))] if ids else []),
                    ],
                    names=["id", "start", "length", "ids_crc32", "doc_tokens", "class", "task", "rank", *(["ids"] if ids else [])],
                )

    return run


def _first_fit(capacity: int):
    """Places for the pieces of the classes' last sequences, largest first."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "class", "task", "rank"], ascending=[False, True, True, True], ignore_index=True)
        room: list[int] = []
        bins, offsets = [], []
        for n in rows["length"].tolist():
            b = next((i for i, left in enumerate(room) if left >= n), len(room))
            if b == len(room):
                room.append(capacity)
            bins.append(b)
            offsets.append(capacity - room[b])
            room[b] -= n
        return rows.assign(bin=bins, offset=offsets)[["class", "task", "rank", "bin", "offset"]]

    return run


def pack(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, slack: int = 32, ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) for every piece.

    ``path`` names the file of a public tokenizer that drops white space and splits at it. A document's
    ids are those of its whole text without special tokens, then ``end_id``; so null,
    empty and blank texts have one id. Every id is in exactly one piece. The pieces of
    a sequence lie from offset 0 without gaps and hold ``capacity`` ids at most.
    Repeated rows and ids are packed each for itself, null ids too; other columns are
    ignored. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    fields = "start long, length long, ids_crc32 long, doc_tokens long, class long, task long, rank long"
    pieces = settled(docs.mapInArrow(_pieces(path, capacity, end_id, slack, ids), f"id {kind}, {fields}" + ", ids array<int>" * ids), "pieces")

    # a row per class and task: where the task's ranks begin within the class
    counts = pieces.groupBy("class", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("task")
    counts = counts.withColumn("skip", F.sum("n").over(before) - F.col("n"))
    # at most as many rows as the capacity: full sequences of each class, and their first number
    classes = counts.groupBy("class").agg((F.floor(F.sum("n") / F.col("class"))).alias("full"))
    base = F.sum("full").over(Window.orderBy("class")) - F.col("full")
    classes = classes.withColumn("base", base)
    full = classes.agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0]
    starts = counts.join(F.broadcast(classes), "class").select("class", "task", "skip", "full", "base")

    ranked = pieces.join(starts, ["class", "task"]).withColumn("at", F.col("skip") + F.col("rank"))
    seated = ranked.withColumn("slot", F.floor(F.col("at") / F.col("class")))
    inside = seated.where("slot < full").withColumn("sequence_id", F.col("base") + F.col("slot"))
    single = inside.where("class = 1").withColumn("offset", F.lit(0).cast("long"))
    earlier = Window.partitionBy("sequence_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    several = inside.where("class > 1").withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)))
    last = settled(seated.where("slot >= full").drop("slot", "full", "base", "skip", "at"), "last")
    fitted = last.select("class", "task", "rank", "length", F.lit("all").alias("one")).groupBy("one").applyInPandas(
        _first_fit(capacity), "class long, task long, rank long, bin long, offset long"
    )
    rest = last.join(fitted, ["class", "task", "rank"]).withColumn("sequence_id", F.col("bin") + F.lit(full))
    columns = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if ids else [])]
    out = single.select(columns).unionByName(several.select(columns)).unionByName(rest.select(columns))
    return out.withColumnRenamed("id", id_col)
