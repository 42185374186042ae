"""The registered queries of the operators, each with its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyframe.llm.alignment import align_tokens
from surveyframe.llm.ann import nearest
from surveyframe.llm.common import read
from surveyframe.llm.jaccard import jaccard_join, jaccard_sql
from surveyframe.llm.mixing import mix, mix_sql
from surveyframe.llm.packing import pack
from surveyframe.llm.prefix_trie import TRIE_SQL, prefix_trie
from surveyframe.llm.quality import quality
from surveyframe.llm.simhash import near_copies
from surveyframe.llm.suffix import repeated_bytes_and_words, repeats_sql
from surveyframe.llm.token_counts import count_tokens
from surveyframe.llm.topk import TOP_K_SQL, top_k
from surveyframe.llm.toxicity import toxicity
from surveyframe.llm.warc import archive_round_trip
from surveyframe.plans.registry import query


@query("op7_ngram_jaccard_join", jaccard_sql(4, 85))
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents"), size=4, percent=85)


@query("op8_suffix_dedup", repeats_sql(400, 51))
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes_and_words(read(spark, sf_dir, "documents"), length=400, words=51)


@query("op9_harmonic_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def some_edits(n: int) -> Column:
    """n edits of a row's text, by a rule: places by the hash of its id, what is put in from elsewhere in the text."""
    size = F.length("text")
    pick = lambda k, m: F.pmod(F.xxhash64("doc_id", F.lit(k)), m)
    return F.array(
        *(
            F.struct(
                pick(3 * k, size + 1).alias("at"),
                pick(3 * k + 1, F.lit(60)).alias("remove"),
                F.substring("text", pick(3 * k + 2, size + 1).cast("int"), F.lit(80)).alias("insert"),
            )
            for k in range(n)
        )
    )


@query("op10_edit_aware_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(read(spark, sf_dir, "documents"), some_edits(3), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.drop("text")


OP4_SQL = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
f as (select hex, min(page_id) as first_id from p group by hex),
parts as (select p.*, f.first_id, [cast('0x' || substr(p.hex, 1 + 10 * i, 10) as bigint) for i in range(4)] as v from p join f using (hex))
select page_id, cast(strlen(html) as bigint) as payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((v[k // 8 + 1] >> (35 - 5 * (k % 8))) & 31 as integer) + 1, 1) for k in range(32)], '') as payload_digest,
  case when page_id > first_id then 'revisit' else 'response' end as record_type,
  case when page_id > first_id then first_id end as refers_to
from parts
"""

@query("op4_warc_capture_index", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(read(spark, sf_dir, "pages"))


#: Target weights by level; names without one have weight 1.
WEIGHTS = {"domain": {"d0": 2, "d1": 3, "d2": 3, "d3": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}
LEVELS_SQL = {"domain": "'d' || (cast(regexp_extract(source, '[0-9]+') as integer) % 4)", "lang": "lang", "source": "source"}


def tree() -> dict[str, Column]:
    """The tree of the mix; a domain is a group of sources, by the source's number."""
    number = F.regexp_extract("source", "[0-9]+", 0).try_cast("int")
    return {"domain": F.concat(F.lit("d"), (number % 4).cast("string")), "lang": F.col("lang"), "source": F.col("source")}


@query("op6_hierarchical_mixing", mix_sql(LEVELS_SQL, WEIGHTS, fraction=0.75, max_epochs=3, seed=7))
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"), tree(), WEIGHTS, fraction=0.75, max_epochs=3, seed=7)


@query("op2_impact_ordered_top_k", TOP_K_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), k=10, every=100)


@query("op1_nn_descent")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), k=20, every=20)


@query("op3_toxicity_gru")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op5_quality_mil")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op12_simhash_popcount_grid")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(read(spark, sf_dir, "documents"), size=3, bits=2)


@query("op13_conversation_prefix_trie", TRIE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))


@query("op11_exact_text_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align_tokens(read(spark, sf_dir, "documents"), *paths)[0]
