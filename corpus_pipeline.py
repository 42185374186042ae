"""The corpus pipeline: stages over documents, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyframe.llm.common import delete_tables, read, release, scratch_tables, settled, small_batches, tidy
from surveyframe.llm.jaccard import one_of_each
from surveyframe.llm.mixing import mix
from surveyframe.llm.packing import pack
from surveyframe.llm.quality import held_out, keep_good
from surveyframe.llm.queries import WEIGHTS, tree
from surveyframe.llm.suffix import remove_repeats


# All stages: null texts count as empty; rows with a null id stay unless named below; repeated
# rows are rows of their own; extra columns of any name go through; an empty table gives an
# empty one. Ties are told for each.


# Stages follow one another in the same workers, so each begins with little held by the last one.
BATCH_ROWS, BATCH_BYTES = 500, 2 << 20


_scratch: dict[str, set[str]] = {}


def _light(stage: Callable) -> Callable:
    """A stage that passes little to Python at a time and leaves little behind.

    What the stage before has written on its way is deleted when the next one begins: its
    result is a table of its own by then, and is all that the next one reads. Other
    tables, such as those of queries and of ``run``, are not touched: only those made
    while the stage's function ran, in this application, and none that ``docs`` reads.
    """

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark, BATCH_ROWS, BATCH_BYTES)
        read_now = {f.rpartition("/")[0].removeprefix("file:").lstrip("/") for f in docs.inputFiles()}
        gone = _scratch.pop(spark.sparkContext.applicationId, set())
        delete_tables(spark, {p for p in gone if p.removeprefix("file:").lstrip("/") not in read_now})
        release(spark)
        tidy()
        before = scratch_tables(spark)
        out = stage(spark, docs, sf_dir)
        made = {p for p in scratch_tables(spark) - before if "/package-" not in p}
        _scratch[spark.sparkContext.applicationId] = made
        return out

    return run_stage


@_light
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; labels as in its query.

    A score of exactly 0.5 is kept; equal texts have equal scores. Empty texts are scored
    like any others.
    """
    return keep_good(docs, read(spark, sf_dir, "labels"), ~held_out(3, 1))


@_light
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8: the smallest id.

    Texts without words are linked with nothing. Rows without an id stay, as do repeated
    rows of the id that stays.
    """
    return one_of_each(docs, size=5, percent=80)


@_light
def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 400 bytes or of 51 words that are found elsewhere too; lengths are told anew.

    Every occurrence goes, the first one too. Null texts stay null, with a null length.
    """
    return remove_repeats(docs, length=400, words=51).withColumn("n_chars", F.length("text").cast("long"))


@_light
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the budgets of the mix, each used once at most.

    Documents of one id are all taken or all left; null languages and sources are
    leaves of their own; documents without words cost nothing.
    """
    own = docs.select("doc_id", "text", "lang", "source", F.struct(*docs.columns).alias("document"))
    return mix(own, tree(), WEIGHTS, fraction=0.9, max_epochs=1, seed=7, keep=["document"]).select("document.*")


@_light
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2,048 tokens; a document without text is its end token."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeat_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

# a trained classifier and a tokenizer are not SQL; tests/llm holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), name)
    return docs
