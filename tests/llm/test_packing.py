"""Packing: an exact round trip of all ids, and little padding."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from surveyframe.llm.packing import cut, pack
from tests.conftest import SF_DIR

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", "  \n\t", "don't <|endoftext|> <|STARTOFTEXT|>x", "１２ ３ é a b c", "word " * 30_000, "x", "x", "Σίσυφος ΣΑΣ"]


def whole(spark, df, texts, capacity=2048):
    tokenizer = Tokenizer.from_file(PATH)
    got = pack(df, PATH, capacity=capacity, ids=True).collect()
    docs, bins = defaultdict(list), defaultdict(list)
    for r in got:
        docs[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4"))
    assert set(docs) == set(texts)
    for i, t in texts.items():
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        rows = sorted(docs[i], key=lambda r: r.start)
        assert [x for r in rows for x in r.ids] == want and {r.doc_tokens for r in rows} == {len(want)}
        assert [r.start for r in rows] == list(np.cumsum([0, *(r.length for r in rows)])[:-1])
    for rows in bins.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == list(np.cumsum([0, *(r.length for r in rows)])[:-1])
        assert rows[-1].offset + rows[-1].length <= capacity
    return sum(r.length for r in got), len(bins)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    tokens, bins = whole(spark, docs.repartition(5), {r.doc_id: r.text for r in docs.collect()})
    assert tokens / (bins * 2048) > 0.96


@pytest.mark.parametrize("capacity", [16, 2048])
def test_odd_texts(spark, capacity):
    df = spark.createDataFrame([(i, t, -1) for i, t in enumerate(ODD)], "doc_id long, text string, rank int")
    whole(spark, df, dict(enumerate(ODD)), capacity)
    assert pack(df.limit(0), PATH).count() == 0


def test_cuts_use_every_token_and_pad_little():
    for n in range(1, 7000):
        parts = cut(n, 2048, 32)
        assert sum(parts) == n
        assert all((s := 2048 // (2048 // x)) - x <= s / 32 for x in parts)
