"""Repeated bytes against a brute-force count of all windows."""

import hashlib
import random
from collections import Counter

import pytest

from surveyframe.llm.suffix import repeated_bytes
from tests.conftest import SF_DIR


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, length):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in repeated_bytes(df, length=length).collect())
    assert got == [(i, *x) for i, x in enumerate(brute(texts, length))]


@pytest.mark.parametrize("length", [8, 40])
def test_random_texts_share_parts_of_all_kinds(spark, length):
    rng = random.Random(length)
    word = lambda n: "".join(rng.choice("abcé \n") for _ in range(n))
    shared = [word(rng.randint(length // 2, 6 * length)) for _ in range(12)]
    texts = [None, "", "ab" * length, "ab" * length + "x", "é" * 3 * length, "q" * (4 * length), "q" * (2 * length), word(length), word(length - 1)]
    for _ in range(60):
        parts = [word(rng.randint(0, 4 * length)), rng.choice(shared), word(rng.randint(0, 30)), rng.choice(shared)[rng.randint(0, 9) :]]
        texts.append("".join(parts))
    base = word(20 * length)
    for _ in range(20):  # near copies: one change each
        i = rng.randrange(len(base))
        texts.append(base[:i] + "Z" + base[i + 1 :])
    check(spark, texts + texts[20:23], length)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id")
    rows = docs.select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in repeated_bytes(docs).collect())
    assert got == [(r.doc_id, *x) for r, x in zip(rows, brute([r.text for r in rows], 400), strict=True)]
    assert any(r[2] for r in got)


def test_a_very_long_text_beside_an_empty_table(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3_000_000))
    df = spark.createDataFrame([(1, long, "x"), (2, long[1_000_000:1_001_000], "y"), (None, "a", "z")], "doc_id long, text string, key string")
    got = {r.doc_id: r for r in repeated_bytes(df, spans=True).collect()}
    assert (got[1].n_removed, got[1].spans) == (1000, [[1_000_000, 1_001_000]])
    assert (got[2].n_removed, got[None].n_removed) == (1000, 0)
    assert repeated_bytes(df.limit(0)).count() == 0
