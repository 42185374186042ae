"""Recall of the graph search against brute force, exact scores, and odd rows."""

import numpy as np
import pytest

from surveyframe.llm import ann


def recall(spark, ids, v, k, every, **more):
    df = spark.createDataFrame([(int(i), x.tolist(), 1, "x") for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>, rank int, part string")
    got = ann.nearest(df, k=k, every=every, **more).collect()
    found = {}
    place = {i: a for a, i in enumerate(ids)}
    for r in got:
        found.setdefault(r.query_id, []).append(r)
        assert r.score == pytest.approx(float(v[place[r.query_id]] @ v[place[r.vec_id]]), abs=1e-12) and r.vec_id != r.query_id
    hits = total = 0
    for i in ids[ids % every == 0]:
        s = v @ v[place[i]]
        best = sorted((-x, j) for x, j in zip(s, ids.tolist(), strict=True) if j != i)[:k]
        rows = sorted(found[i], key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, len(best) + 1))
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        hits += len({j for _, j in best} & {r.vec_id for r in rows})
        total += len(best)
    return hits / total


@pytest.mark.parametrize("case", ["unit", "norms", "copies"])
def test_recall(spark, monkeypatch, case):
    monkeypatch.setattr(ann, "PART", 300)
    rng = np.random.default_rng(7)
    v = rng.normal(size=(1_500, 24))
    v /= np.linalg.norm(v, axis=1)[:, None]
    if case == "norms":
        v *= rng.uniform(0.5, 1.5, len(v))[:, None]
    if case == "copies":
        v[:500] = v[0]
    ids = np.arange(len(v)) * 3 - 600
    got = recall(spark, ids, v, 10, 60)
    assert got > (0.9 if case != "copies" else 0.6)


def test_few_rows_and_rows_that_take_no_part(spark):
    good = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (21, [-1.0, 0.0]), (21, [-1.0, 0.0])]
    odd = [(None, [1.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [float("inf"), 1.0]), (5, [float("nan"), 1.0]), (6, [1.0])]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df).collect())
    assert got == [(0, 1, 20, 0.5), (0, 2, 21, -1.0), (20, 1, 0, 0.5), (20, 2, 21, -0.5)]
    assert ann.nearest(df.limit(0)).count() == 0
