"""Exact top-k by inner product with an impact-ordered index.

Vectors are dealt to blocks. In a block every dimension has two posting lists, one
for queries that are positive there and one for negative ones. A posting's impact
is its component's distance from the end of the block's range that the query likes
least, so all impacts are non-negative and a score is a constant plus the sum of
weight times impact. Lists are cut into segments of equal quantised impact and kept
by descending impact.

Queries go through the segments score at a time, by descending impact, a batch of
queries at once: a round takes all segments down to a level and adds weight times
quantised impact to the accumulators. What has been added up is a lower bound of each
candidate's score; the impacts not reached yet and the quantising bound what may be
missing. A query stops only when that proves that all but a few candidates are below
the k-th lower bound, or when no segment is left. The possible members are scored
exactly, in integers; accumulators are exact too, below 2**53. Blocks do not know of each other; the
blocks' lists are merged by score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyframe.llm.common import prepare, settled

#: Candidates and queries of a block, and queries that are accumulated together.
BLOCK = 8192
QUERIES = 256
BATCH = 64
#: Levels of the quantised impact, and the lowest level of each round.
LEVELS = 256
ROUNDS = (176, 144, 120, 100, 80, 60, 40, 20, 0)
#: Possible members that end the rounds, for each of the k.
ENOUGH = 12


def valid(vector: str = "embedding"):
    """Vectors that are not null and hold neither null nor non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


class Index:
    """Posting lists of one block, each sorted by descending impact, with the bounds of its segments.

    List 2 d is for queries that are positive in dimension d, list 2 d + 1 for negative ones.
    """

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        n, d = vectors.shape
        low, high = vectors.min(0), vectors.max(0)
        impact = np.empty((2 * d, n), np.int64)
        impact[0::2], impact[1::2] = (vectors - low).T, (high - vectors).T
        self.width = np.repeat(np.maximum(1, -(-(high - low + 1) // LEVELS)), 2)
        level = impact // self.width[:, None]
        self.order = np.argsort(-level, axis=1, kind="stable")
        self.level = np.take_along_axis(level, self.order, 1)

    def segments(self, top: int, low: int) -> np.ndarray:
        """Quantised impacts of the postings with a level from ``low`` to below ``top``, by list and vector."""
        out = np.zeros(self.order.shape)
        for k, level in enumerate(self.level):
            a, b = np.searchsorted(-level, [1 - top, 1 - low])  # descending: levels below top, down to low
            out[k, self.order[k, a:b]] = level[a:b] * self.width[k]
        return out

    def top(self, queries: np.ndarray, k: int, own: np.ndarray) -> list[np.ndarray]:
        """For each query, positions of the vectors that may be among its k best, ``own`` (or -1) excepted."""
        n = len(self.vectors)
        weight = np.zeros((len(queries), 2 * queries.shape[1]))
        weight[:, 0::2], weight[:, 1::2] = np.maximum(queries, 0), np.maximum(-queries, 0)
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
        got, open_, top = np.zeros((len(queries), n)), np.arange(len(queries)), LEVELS
        for low in ROUNDS:
            got[open_] += weight[open_] @ self.segments(top, low)
            top = low
            # what may be missing: of postings not reached all below the bound, of others what quantising cut off
            missing = weight[open_] @ np.maximum(low * self.width, self.width - 1.0)
            some = got[open_]
            has = own[open_] >= 0
            some[np.flatnonzero(has), own[open_][has]] = -np.inf
            if n > k:
                floor = np.partition(some, n - k, axis=1)[:, n - k]  # the k-th lower bound
            else:
                floor = np.full(len(some), -np.inf)
            possible = (some + missing[:, None] >= floor[:, None]) & np.isfinite(some)
            done = (possible.sum(1) <= ENOUGH * k) | (low == 0)
            for q in np.flatnonzero(done):
                out[open_[q]] = np.flatnonzero(possible[q])
            open_ = open_[~done]
            if not len(open_):
                break
        return out


def _search(k: int):
    def run(key: tuple, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(block):
            block = block.sort_values("vec_id", ignore_index=True)
            ids = block["vec_id"].to_numpy()
            index = Index(np.stack([np.frombuffer(x, np.int64) for x in block["vector"]]))
            asked = queries["vec_id"].to_numpy()
            q = np.stack([np.frombuffer(x, np.int64) for x in queries["vector"]])
            at = np.minimum(np.searchsorted(ids, asked), len(ids) - 1)
            own = np.where(ids[at] == asked, at, -1)
            for a in range(0, len(asked), BATCH):
                found = index.top(q[a : a + BATCH], k, own[a : a + BATCH])
                for qid, v, some in zip(asked[a : a + BATCH].tolist(), q[a : a + BATCH], found, strict=True):
                    score = index.vectors[some] @ v
                    best = np.lexsort((ids[some], -score))[:k]
                    out += [(qid, i, s) for i, s in zip(ids[some[best]].tolist(), score[best].tolist(), strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def _packed(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.floor(np.asarray(x, np.float64) * scale).astype(np.int64).tobytes() for x in batch.column("vector").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(vectors, pa.binary())], names=["vec_id", "vector"])

    return run


def top_k(vectors: DataFrame, *, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows, ties to the smaller id.

    Components become ``floor(scale * x)``; scores are integer inner products. Queries
    are the rows whose id is divisible by ``every``. Null ids and vectors that are null
    or hold null or non-finite components take no part, nor do vectors of another
    length than the table's smallest id has. Rows of one id are one row: that with the
    least vector. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & valid("vector")).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    size = rows.agg(F.min_by(F.size("vector"), "vec_id"), F.count("*")).first()
    rows = settled(rows.where(F.size("vector") == (size[0] or 0)).mapInArrow(_packed(scale), "vec_id long, vector binary"), "vectors")
    blocks, asks = max(1, -(-size[1] // BLOCK)), max(1, -(-size[1] // (QUERIES * every)))
    queries = rows.where(F.col("vec_id") % every == 0).select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(asks)).cast("int").alias("ask"),
        F.col("vec_id").alias("vec_id"),
        F.col("vector").alias("vector"),
    )
    members = rows.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(asks - 1))).alias("ask"),
        F.col("vec_id").alias("vec_id"),
        F.col("vector").alias("vector"),
    )
    found = queries.groupBy("block", "ask").cogroup(members.groupBy("block", "ask")).applyInPandas(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = """
with v as (select vec_id, min([cast(floor(1024 * cast(x as double)) as bigint) for x in embedding]) as v
  from embeddings where vec_id is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0 group by vec_id),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum([q.v[i] * c.v[i] for i in range(1, len(c.v) + 1)]) as bigint) as score
  from v q, v c where q.vec_id % 100 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from s qualify rank <= 10
"""
