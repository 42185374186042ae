"""Counts after edits against counting the whole edited text."""

import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from surveyframe.llm.token_counts import EDITS, count_tokens
from tests.conftest import SF_DIR

PATH = public_tokenizers.path("byte_bpe_50k.json")


def apply(text, edits):
    text = text or ""
    for at, remove, insert in edits:
        text = text[:at] + (insert or "") + text[at + (remove or 0) :]
    return text


def check(spark, rows):
    tokenizer = Tokenizer.from_file(PATH)
    size = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    df = spark.createDataFrame(rows, f"doc_id long, text string, edits {EDITS}, n_edits string")
    got = {r.doc_id: r for r in count_tokens(df, F.col("edits"), PATH).collect()}
    for i, text, edits, _ in rows:
        want = apply(text, edits)
        assert (got[i].text, got[i].tokens_before, got[i].tokens) == (want, size(text), size(want)), (text, edits)
        assert got[i].n_bytes == len(want.encode())
    return got


def test_random_edits(spark):
    rng = random.Random(3)
    parts = ["word", " ", "  ", "\n", "é", "ñandú", "don't", "'s", "!!", "42", " 的", " ", "x y", "<|endoftext|>", "a b c d e f g"]
    make = lambda n: "".join(rng.choice(parts) for _ in range(n))
    rows = []
    for i in range(400):
        text = make(rng.choice([0, 1, 3, 50, 2000])) if i % 7 else " ".join(["plain"] * rng.randint(0, 900))
        edits = [(rng.randint(0, len(text) + 3), rng.choice([0, 1, 2, 40, 10**6]), make(rng.choice([0, 1, 2, 30]))) for _ in range(rng.randint(0, 6))]
        rows.append((i, text, edits, "clash"))
    check(spark, rows)


def test_a_small_edit_of_a_long_text_encodes_little(spark):
    got = check(spark, [(1, "some plain words here " * 50_000, [(400_000, 5, "new")], "")])
    assert got[1].bytes_encoded < 3_000


def test_nulls_and_an_empty_table(spark):
    rows = [(None, None, None), (1, "a b", [None, (None, 1, "x"), (-1, 1, "x"), (1, None, None)]), (1, "a b", [])]
    df = spark.createDataFrame(rows, f"doc_id long, text string, edits {EDITS}")
    got = [(r.doc_id, r.tokens_before, r.tokens, r.n_edits) for r in count_tokens(df, F.col("edits"), PATH).collect()]
    assert sorted(got, key=str) == [(1, 2, 2, 0), (1, 2, 2, 1), (None, 0, 0, 0)]
    assert count_tokens(df.limit(0), F.col("edits"), PATH).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(60).collect()
    check(spark, [(r.doc_id, r.text, [(10, 30, "new words "), (r.n_chars // 2, 9, "")], r.lang) for r in docs])
