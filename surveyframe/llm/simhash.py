"""Near copies by fingerprints of word shingles, joined over a grid of bit counts.

A fingerprint's 64 bits are 32 segments of two bits. The bits set in each segment make
a point of whole numbers, and one differing bit moves the point by one step: the
Manhattan distance of two points is at most the number of bits in which their
fingerprints differ. So fingerprints within ``bits`` of each other lie within ``bits``
steps, and in one of the two halves of the grid within half of that. Each half is a
grid whose cells have a side of one: a point is stored in its own cell and asks in its
own and in those one step up (who lies one step down asks itself). Cells that hold more
than ``CELL`` points are parted by the quarters of the other half in the same way. Pairs
that meet in a cell are compared bit by bit.

Fingerprints one bit apart are linked first. The join at full distance then leaves out
pairs that are connected already, so that dense groups send few links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyframe.llm.common import SLAB, attach, components, prepare, release, settled, slabs
from surveyframe.llm.texthash import SPACE

#: Points of a cell beyond which the other half parts it further.
CELL = 1_000
#: Seed of the shingles' hashes.
SEED = 42
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ODD_BITS = 0x55555555


def _words(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a slab begin and end; none spans two texts."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[bounds] = True
    start = np.flatnonzero(~space & (edge[:-1] | np.concatenate(([True], space[:-1]))))
    end = np.flatnonzero(~space & (edge[1:] | np.concatenate((space[1:], [True])))) + 1
    return start, end


def _hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """XXH64 of the words ``first`` to ``last``, lower-cased and joined by one space each."""
    lo, hi = int(first[0]), int(last[-1])
    size = end[lo : hi + 1] - start[lo : hi + 1]
    to = np.cumsum(size + 1)  # the space after a word
    at = to - size - 1
    joined = np.full(int(to[-1]), 0x20, np.uint8)
    shift = np.repeat(at - (np.cumsum(size) - size), size)
    own = np.repeat(start[lo : hi + 1] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    joined[shift + np.arange(len(shift))] = LOWER[buf[own]]
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    spans = zip(at[first - lo].tolist(), (to[last - lo] - 1).tolist(), strict=True)
    return np.fromiter((digest(raw[a:b], SEED) for a, b in spans), np.uint64, len(first))


def fingerprints(buf: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """The fingerprint of each text of a slab, as signed 64-bit numbers."""
    start, end = _words(buf, bounds)
    cuts = np.searchsorted(start, bounds)
    n = np.diff(cuts)
    shingles = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    votes = np.zeros((len(n), 64), np.int64)
    text = np.repeat(np.arange(len(n)), shingles)
    first = np.repeat(cuts[:-1] - (np.cumsum(shingles) - shingles), shingles) + np.arange(len(text))
    last = np.minimum(first + size, cuts[1:][text]) - 1
    at = 0
    while at < len(text):  # in steps, since a single text may be very long
        to = max(at + 1, int(np.searchsorted(start[first], start[first[at]] + SLAB, "right")))
        h = _hashes(buf, start, end, first[at:to], last[at:to])
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = text[at:to]
        new = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(own)], strict=True):
            votes[own[a]] += bits[a:b].sum(axis=0, dtype=np.int64)
        at = to
    ones = 2 * votes > shingles[:, None]
    return np.packbits(ones, axis=1, bitorder="little").view(np.int64).ravel()


def _print(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprints(buf, bounds, size) for _, _, buf, bounds in slabs(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(found) if found else [], pa.int64())], names=["id", "fp"])

    return run


def _half(fp: Column, half: int) -> Column:
    """Sixteen bit counts of two bits each."""
    own = F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
    return own.bitwiseAND(F.lit(ODD_BITS)) + F.shiftrightunsigned(own, 1).bitwiseAND(F.lit(ODD_BITS))


def _quarter(fp: Column, half: int, quarter: int) -> Column:
    return F.shiftrightunsigned(_half(fp, half), 16 * quarter).bitwiseAND(F.lit(0xFFFF))


def _at(cell: Column, side: int, fields: int, steps: int = 0) -> list[Column]:
    """The cell of a side, and with one step the cells above it in each field, as (steps, cell)."""
    base = F.lit(side << 2 * fields) + cell
    ups = [base + F.lit(1 << 2 * i) for i in range(fields if steps else 0)]
    return [F.struct(F.lit(int(k > 0)).alias("steps"), c.alias("cell")) for k, c in enumerate([base, *ups])]


def _is_cell(cell: Column) -> Column:
    """No field counts three bits of two."""
    return F.shiftrightunsigned(cell, 1).bitwiseAND(cell).bitwiseAND(F.lit(ODD_BITS)) == 0


def _parted(rows: DataFrame, bits: int) -> DataFrame:
    """Rows of full cells by the quarters of the other half; ``bits`` 0 for those that are asked."""
    fp, out = F.col("fp"), []
    for half in (0, 1):
        for steps in (0, 1) if bits else (0,):
            sides = [c for q in (0, 1) for c in _at(_quarter(fp, 1 - half, q), q, 8, (bits - steps) // 2)]
            own = rows.where((F.shiftrightunsigned("cell", 32) == half) & (F.col("steps") == steps))
            out.append(own.select("fp", "label", "steps", "cell", F.explode(F.array(*sides)).alias("sub")))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    every = every.select("fp", "label", "cell", F.col("sub.cell").alias("sub"), (F.col("steps") + F.col("sub.steps")).alias("steps"))
    return every.where(_is_cell(F.col("sub")))


def _meet(asked: DataFrame, asking: DataFrame, on: list[str], bits: int) -> DataFrame:
    """Labels of the fingerprints that meet in a cell and differ in at most ``bits`` bits."""
    left = asked.select(*on, F.col("fp").alias("fp_a"), F.col("label").alias("a"))
    right = asking.select(*on, F.col("fp").alias("fp_b"), F.col("label").alias("b"), "steps")
    close = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= bits
    once = (F.col("steps") > 0) | (F.col("fp_a") < F.col("fp_b"))
    both = left.withColumnsRenamed({c: f"{c}_a" for c in on}).join(right, [F.col(f"{c}_a") == F.col(c) for c in on] + [once, F.col("a") != F.col("b"), close])
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _links(points: DataFrame, bits: int) -> DataFrame:
    """(a, b): labels of all points (fp, label) that differ in at most ``bits`` bits, up to two, and not in label."""
    fp = F.col("fp")

    def cells(steps: int) -> DataFrame:
        every = F.array(*(c for half in (0, 1) for c in _at(_half(fp, half), half, 16, steps)))
        told = points.select("fp", "label", F.explode(every).alias("c")).select("fp", "label", "c.cell", "c.steps")
        return told.where(_is_cell(F.col("cell")))

    asked, asking = cells(0), cells(bits // 2)
    full = settled(asked.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL).select("cell", F.lit(True).alias("full")), "cells")
    if full.isEmpty():
        return _meet(asked, asking, ["cell"], bits).distinct()
    asked, asking = asked.join(full, "cell", "left"), asking.join(full, "cell", "left")
    rest = _meet(asked.where("full is null"), asking.where("full is null"), ["cell"], bits)
    parts = _meet(_parted(asked.where("full"), 0), _parted(asking.where("full"), bits), ["cell", "sub"], bits)
    return rest.unionByName(parts).distinct()


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3, bits: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``.

    Words are runs without ASCII white space, A-Z lower-cased. A bit of the fingerprint
    is set if it is in over half of the hashes of all ``size``-word shingles, repeats
    included; fewer words are one shingle. Texts without words, empty and null texts
    have the fingerprint zero and are linked like any others. Fingerprints link when
    they differ in at most ``bits`` bits (0 to 2); ``component_id`` is the smallest id
    reachable. Repeated rows and ids are kept each; rows with a null id count as links
    but not as smallest id, and a component of such rows alone has a null one. Other
    columns are ignored. An empty table gives an empty result.
    """
    if not 0 <= bits <= 2:
        raise ValueError("bits must be 0 to 2")
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    rows = settled(docs.mapInArrow(_print(size), f"id {kind}, fp long"), "fingerprints")
    nodes = settled(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies")), "nodes")
    placed = nodes.withColumn("label", F.col("fp"))
    for radius in sorted({min(1, bits), bits} - {0}):
        roots = components(settled(_links(placed.select("fp", "label"), radius), "links")).select(F.col("node").alias("label"), F.col("label").alias("root"))
        placed = placed.join(roots, "label", "left").withColumn("label", F.coalesce("root", "label")).drop("root")
        placed = settled(placed, "labels")
        release(spark)
    least = placed.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("w"))
    of_print = attach(placed.select("fp", "label", "copies"), settled(least, "least"), "label", "w").select("fp", "component_id", "copies")
    done = attach(rows, settled(of_print, "components"), "fp", "copies")
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return done.select(F.col("id").alias(id_col), shown.alias("fingerprint"), "component_id")
