"""Quality and toxicity: accuracy on labels that were held out, gradients, and odd rows."""

import zlib

import numpy as np
import pytest

from surveyframe.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    pos = y.sum()
    return (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))


@pytest.mark.parametrize("score,label,modulus,rest", [(quality.quality, "quality", 3, 1), (toxicity.toxicity, "toxic", 5, 0)])
def test_held_out_labels(spark, score, label, modulus, rest):
    """On 400 labels; of the words that mark the other class of toxic texts, few are seen twice there."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in score(docs.repartition(3), labels).collect()}
    assert len(got) == docs.count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % modulus == rest)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    known = [(got[r.doc_id].score, r[label]) for r in labels.collect() if got[r.doc_id].held_out]
    s, y = (np.array(x) for x in zip(*known, strict=True))
    assert auc(s, y) > (0.97 if label == "quality" else 0.88)


@pytest.mark.parametrize("score,label", [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_odd_rows(spark, score, label):
    texts = [None, "", " \n", "!!!", "fine words here. " * 3, "x " * 400_000, "bad bad word", "fine words here. " * 3, "é ñ"]
    docs = spark.createDataFrame([(i if i != 3 else None, t, 0.5, "x") for i, t in enumerate(texts)] + [(4, texts[4], 0.1, "y")], "doc_id long, text string, score double, row string")
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 1), (6, None, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    got = score(docs, labels).collect()
    assert len(got) == len(texts) + 1 and all(0 <= r.score <= 1 for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert len(by_id[4]) == 1 and by_id[4] == by_id[7] and by_id[0] == by_id[1]
    assert score(docs.limit(0), labels).count() == 0
    assert len(score(docs, labels.limit(0)).collect()) == len(texts) + 1


def test_gradients_of_the_recurrent_network():
    rng = np.random.default_rng(1)
    w = {k: v.astype(np.float64) for k, v in toxicity.learn([b"a b c", b"d e f"], np.array([0, 0]), 0.1).items()}
    for k in ("o", "a", "Wf", "Wb", "Rf", "Rb"):
        w[k] = rng.normal(0, 0.4, w[k].shape)
    x = rng.normal(0, 1, (7, toxicity.WORD_DIM + toxicity.CHAR_DIM))
    code, first, size = rng.integers(0, 7, 60), np.array([0, 20, 41]), np.array([20, 9, 1])
    d = np.array([0.3, -1.0, 0.7])
    logits, cache = toxicity.forward(w, x, code, first, size, keep=True)
    grads, dx = toxicity.gradients(w, x, code, first, size, d, cache)
    for k in ("o", "a", "Wf", "Wb", "Rf", "Rb", "bf"):
        i = tuple(rng.integers(0, n) for n in w[k].shape)
        step = 1e-3
        w[k][i] += step
        up = toxicity.forward(w, x, code, first, size)[0] @ d
        w[k][i] -= 2 * step
        down = toxicity.forward(w, x, code, first, size)[0] @ d
        w[k][i] += step
        assert grads[k][i] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-3)


def test_gradients_of_the_attention():
    rng = np.random.default_rng(2)
    bags = [rng.normal(size=(n, quality.FEATURES)) for n in (3, 1, 5)]
    w = {k: v.astype(np.float64) for k, v in quality.learn([b.astype(np.float32) for b in bags[:2]], np.array([0.0, 1.0], np.float32), 0.5).items()}
    x, owner, d = np.concatenate(bags), np.repeat([0, 1, 2], [3, 1, 5]), np.array([0.5, -0.2, 1.0])
    grads = quality._backward(w, quality.forward(w, x, owner, 3)[1], owner, d)
    for k in ("W", "V", "U", "u", "o", "b"):
        i = tuple(rng.integers(0, n) for n in w[k].shape)
        w[k][i] += 1e-5
        up = quality.forward(w, x, owner, 3)[0] @ d
        w[k][i] -= 2e-5
        down = quality.forward(w, x, owner, 3)[0] @ d
        w[k][i] += 1e-5
        assert grads[k][i] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)


def test_windows_cover_every_word():
    for words in (0, 1, 16, 17, 32, 33, 48, 49, 1000):
        text, first, size = toxicity.windows(np.array([0, words]))
        seen = np.zeros(words, int)
        for a, n in zip(first, size, strict=True):
            seen[a : a + n] += 1
        assert (seen >= 1).all() and (size <= toxicity.WINDOW).all() and (words == 0) == (len(text) == 0)
