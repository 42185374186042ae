"""Exact top-k against scoring every candidate."""

import numpy as np
import pytest

from surveyframe.llm import topk


def brute(rows, k, every, scale):
    ok = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            ok[i] = min(ok.get(i, v), v)
    size = len(ok[min(ok)]) if ok else 0
    ids = sorted(i for i in ok if len(ok[i]) == size)
    m = np.array([np.floor(np.array(ok[i], float) * scale) for i in ids]).astype(np.int64)
    out = []
    for a, i in enumerate(ids):
        if i % every == 0:
            s = m @ m[a]
            best = sorted((-int(x), j) for j, x in zip(ids, s, strict=True) if j != i)[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("case", ["normal", "ties", "skewed"])
def test_top_k(spark, monkeypatch, case):
    rng = np.random.default_rng(4)
    n = 3_000
    v = rng.normal(size=(n, 12)) * 0.2
    if case == "ties":
        v = np.round(v * 4) / 8
    if case == "skewed":
        v[:, 0] += 3 * (rng.random(n) < 0.01)
        v[: n // 3] = v[0]
    rows = [(i, x.tolist(), "x") for i, x in enumerate(v)]
    rows += [(None, [0.1] * 12, "x"), (n, None, "x"), (n + 1, [None] * 12, "x"), (n + 2, [float("nan")] * 12, "x"), (n + 3, [0.5], "x"), (20, [9.0] * 12, "x"), (40, v[40].tolist(), "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = topk.top_k(df, k=7, every=20).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 7, 20, 1024)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df).collect()] == [(0, 1, 1, 2048 * 1024)]
    assert topk.top_k(df.limit(0)).count() == 0


def test_rounds_stop_before_the_end_of_the_lists():
    rng = np.random.default_rng(0)
    v = np.floor(rng.normal(size=(4_000, 16)) ** 3 * 100).astype(np.int64)
    index = topk.Index(v)
    queries = v[:20]
    for q, some in enumerate(index.top(queries, 10, np.arange(20))):
        s = v @ v[q]
        s[q] = -(2**60)
        assert set(np.argsort(-s, kind="stable")[:10]) <= set(some.tolist()) and q not in some
        assert len(some) < 400
