"""Recall of the graph search where the lengths of vectors differ."""

import numpy as np
import pandas as pd
import pytest

from surveyframe.llm import ann


def recall(spark, v, k, every):
    """The share of each query's true inner products that its results reach, so that ties are no loss."""
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, k=k, every=every).collect():
        assert r.vec_id != r.query_id and r.score == pytest.approx(float(v[r.query_id] @ v[r.vec_id]), rel=1e-9, abs=1e-12)
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for i in range(0, len(v), every):
        s = np.delete(v @ v[i], i)
        least = np.sort(s)[-k]
        rows = sorted(got[i])
        assert [r for r, _, _ in rows] == list(range(1, k + 1)) and len({j for _, j, _ in rows}) == k
        hits += sum(x >= least - 1e-9 * abs(least) for _, _, x in rows)
        total += k
    return hits / total


def clustered(rng, n, dim, per=30):
    v = rng.normal(size=(n // per, dim))[rng.integers(0, n // per, n)] + 0.5 * rng.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1)[:, None]


@pytest.mark.parametrize("sigma", [0.5, 1.0])
def test_spread_lengths(spark, monkeypatch, sigma):
    monkeypatch.setattr(ann, "PART", 600)
    rng = np.random.default_rng(5)
    v = clustered(rng, 6_000, 32) * rng.lognormal(0, sigma, 6_000)[:, None]
    got = recall(spark, v, 20, 20)
    print("recall", sigma, got)
    assert got > 0.95


@pytest.mark.parametrize("lengths", ["equal", "unequal"])
def test_copies(spark, monkeypatch, lengths):
    monkeypatch.setattr(ann, "PART", 300)
    rng = np.random.default_rng(7)
    v = rng.normal(size=(1_500, 24))
    v /= np.linalg.norm(v, axis=1)[:, None]
    if lengths == "unequal":
        v *= rng.uniform(0.5, 1.5, len(v))[:, None]
        v[0] /= 2 * np.linalg.norm(v[0])
    v[:500] = v[0]
    got = recall(spark, v, 10, 20)
    print("recall copies", lengths, got)
    assert got > 0.9


def test_one_long_vector_leaves_the_others_their_lengths():
    v = np.random.default_rng(2).normal(size=(50, 8))
    v[0] *= 20_000
    true = np.linalg.norm(v, axis=1)
    (packed,) = ann._scaled(true.max())([pd.DataFrame({"vec_id": range(50), "vector": list(v)})])
    held = ann._lengths(np.stack([np.frombuffer(x, np.float16) for x in packed["vector"]]))
    assert held * true.max() == pytest.approx(true, rel=1e-6)


def test_recall_beside_one_long_vector(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART", 600)
    rng = np.random.default_rng(6)
    v = clustered(rng, 3_000, 32) * rng.uniform(0.5, 1.5, 3_000)[:, None]
    v[7] *= 20_000
    got = recall(spark, v, 20, 20)
    print("recall outlier", got)
    assert got > 0.95
