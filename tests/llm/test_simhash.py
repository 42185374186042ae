"""Fingerprints and components against plain loops over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from surveyframe.llm import simhash
from tests.conftest import SF_DIR

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_print(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(w[k : k + size]) for k in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, bits):
    """rows of (id, fingerprint): the smallest id reachable, by comparing all pairs."""
    prints = np.array([f for _, f in rows], np.uint64)
    label = np.arange(len(rows))
    for k in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[k]) <= bits):
            if label[j] != label[k]:
                label[label == label[j]] = label[k]
    least = {}
    for (i, _), c in zip(rows, label, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return [least.get(c) for c in label]


def check(spark, rows, size=3, bits=2):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, label long, fp string")
    got = [tuple(r) for r in simhash.near_copies(df, size=size, bits=bits).collect()]
    prints = [(i, plain_print(t, size)) for i, t in rows]
    want = [(i, f"{f:016x}", c) for (i, f), c in zip(prints, plain_components(prints, bits), strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_near_copies_and_odd_texts(spark, bits):
    rng = random.Random(bits)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 12)))
    texts = [None, "", " \n\t", "one two", "One  TWO", "one", "x " * 5_000, "ÀB c", "àB c", "\x00a b\x00 c", "wide space here too"]
    for _ in range(8):
        base = [word() for _ in range(rng.randint(3, 400))]
        for _ in range(rng.choice([1, 3, 25])):
            near = list(base)
            near[rng.randrange(len(near))] = word()
            texts.append(rng.choice([" ", "\n "]).join(near))
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts)] + [(3, texts[14]), (3, texts[14]), (40, texts[3])]
    check(spark, rows, bits=bits)


def test_long_texts_are_read_in_steps(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLAB", 50)
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(300))
    buf = np.frombuffer(text.encode() + b"one two" + b"", np.uint8)
    got = simhash.fingerprints(buf, np.array([0, len(text), len(text) + 7, len(text) + 7]), 3)
    assert [int(x) & (2**64 - 1) for x in got] == [plain_print(text, 3), plain_print("one two", 3), 0]


@pytest.mark.parametrize("cell", [10_000, 3, 0])
@pytest.mark.parametrize("bits", [1, 2])
def test_links_of_dense_groups(spark, monkeypatch, cell, bits):
    """All links between different labels, however full the cells are."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(9)
    prints = {0, 1, 2**64 - 1, 2**63, 2**63 + 2**62, 2**32, 2**31 + 2**30}
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(60):
            prints.add(base ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 3))}))
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(s, s // 3) for s in signed], "fp long, label long")
    got = {tuple(r) for r in simhash._links(df, bits).collect()}
    want = {
        tuple(sorted((signed[i] // 3, signed[j] // 3)))
        for i in range(len(prints))
        for j in range(i)
        if (prints[i] ^ prints[j]).bit_count() <= bits and signed[i] // 3 != signed[j] // 3
    }
    assert got == want


def test_given_documents_and_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in docs.collect()])
    assert simhash.near_copies(docs.limit(0)).count() == 0
