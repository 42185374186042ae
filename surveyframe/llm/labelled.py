"""Bounded samples of labelled documents, and an optimiser."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(id_.cast("string").cast("binary")) % modulus


def rows_with_text(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(row, text) with the kept columns as a struct; a text that is kept is passed once, in the struct."""
    own = [] if "text" in keep else [F.col("text").alias("text")]
    return docs.select(F.struct(*keep).alias("row"), *own)


def texts_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    if "text" in batch.schema.names:
        return batch.select(["text"])
    return pa.RecordBatch.from_arrays([batch.column("row").field("text")], names=["text"])


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int) -> DataFrame:
    """(text, label) of at most ``most`` labelled documents of each class for which ``learn`` holds.

    Those with the smallest hash of their id are taken, so the sample depends on neither
    order nor partitions. Ids and labels that are null are left out; an id with several
    labels has the largest; one text is taken per id.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    own = own.where(learn).withColumn("h", F.md5(F.col("doc_id").cast("string").cast("binary")))
    few = own.where("y = 1").orderBy("h").limit(most).unionByName(own.where("y = 0").orderBy("h").limit(most))
    texts = docs.select(F.col("doc_id").alias("i"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(few), F.col("i") == F.col("doc_id"))  # 2 * most rows are broadcast
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"), F.first("h").alias("h"))


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
            self.weights[k] -= (rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(self.weights[k].dtype)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5
