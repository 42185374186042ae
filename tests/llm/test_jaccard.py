"""The join against comparing every pair."""

import random
import re

import pytest

from surveyframe.llm import jaccard
from tests.conftest import SF_DIR

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, size, percent):
    sets = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        grams = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
        sets.append((i, grams))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    holders = {}
    for k, (_, g) in enumerate(sets):
        for t in g:
            holders.setdefault(t, []).append(k)
    tried = set()
    for ks in holders.values():
        for a in ks:
            for b in ks:
                if a < b and (a, b) not in tried:
                    tried.add((a, b))
                    x, y = sets[a][1], sets[b][1]
                    if 100 * len(x & y) >= percent * len(x | y):
                        parent[find(a)] = find(b)
    least = {}
    for k, (i, g) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(g), least.get(find(k))) for k, (i, g) in enumerate(sets)]


def check(spark, rows, size, percent):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, node long, component_id string")
    got = sorted((tuple(r) for r in jaccard.jaccard_join(df, size=size, percent=percent).collect()), key=str)
    assert got == sorted(brute(rows, size, percent), key=str)


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80), (1, 50), (2, 100)])
def test_near_copies_and_odd_texts(spark, monkeypatch, size, percent):
    monkeypatch.setattr(jaccard, "GROUP", 8)
    rng = random.Random(size)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 3)))
    texts = [None, "", " \n\t", "one two", "One  TWO", "one two", "x " * 5_000, "ÀB c", "àB c"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(3, 120))]
        for _ in range(rng.choice([1, 3, 25])):
            near = list(base)
            for _ in range(rng.randint(0, 4)):
                near[rng.randrange(len(near))] = word()
            texts.append(rng.choice([" ", "\n "]).join(near))
    common = [word() for _ in range(40)]
    texts += [" ".join(common + [word() for _ in range(rng.randint(0, 12))]) for _ in range(60)]
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts)] + [(3, texts[9]), (3, texts[40])]
    check(spark, rows, size, percent)


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    check(spark, rows, 4, 85)


def test_an_empty_table_and_one_of_each(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (None, "a b c d e f", "z"), (3, "", "x"), (4, "", "x")], "doc_id long, text string, goes string")
    assert jaccard.jaccard_join(df.limit(0)).count() == 0
    assert sorted((r.doc_id or 0, r.goes) for r in jaccard.one_of_each(df).collect()) == [(0, "z"), (1, "x"), (3, "x"), (4, "x")]


def test_the_driver_gets_packed_counts_and_keeps_nothing_of_a_settled_table(spark):
    import zlib

    import numpy as np
    import pandas as pd

    from surveyframe.llm import common, jaccard

    counters = (1 << jaccard.SKETCH_BITS) // jaccard.SLICES
    some, many = np.zeros(counters, np.uint8), np.zeros(counters, np.uint32)
    some[::50], many[::100] = 3, 70_000
    got = jaccard._add_counts((5,), pd.DataFrame({"counts": [some.tobytes(), many.tobytes(), some.tobytes()]}))
    assert got["slice"][0] == 5 and len(got["counts"][0]) < counters / 2
    want = np.minimum(2 * some.astype(np.int64) + many, 2**16 - 1)
    assert (np.frombuffer(zlib.decompress(got["counts"][0]), np.uint16) == want).all()
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = whole()
    assert common.settled(spark.range(5), "few").count() == 5
    assert whole() > before
