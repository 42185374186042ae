"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is read as letter runs, lower-cased. Every word is given by a word embedding
(hashed) and a character input, the mean of its character trigrams' embeddings
(hashed too). All overlapping windows of ``WINDOW`` words, ``STRIDE`` apart, are
scored: a recurrent layer with update and reset gates runs over a window in both
directions, attention weighs its positions, and the weighted state is scored. A
document scores like its worst window.

Training is in numpy, by back-propagation through time. Labels are of documents, so
windows are chosen by turns: the model names each document's worst window, and is
then trained on those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyframe.llm.common import prepare, slabs
from surveyframe.llm.labelled import Adam, remainder, rows_with_text, sample, sigmoid, texts_of
from surveyframe.llm.texthash import LOWER, U, mix, span, sums

WINDOW, STRIDE = 32, 16
HIDDEN = 8
WORDS, TRIGRAMS = 1 << 15, 1 << 13
WORD_DIM, CHAR_DIM = 8, 8
#: Labelled documents of each class to learn from, by their whole texts.
DOCUMENTS = 1_500
TURNS, EPOCHS, BATCH = 4, 3, 128
#: Windows of a document of label 0 that a turn trains on.
HARD = 3

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True
FOLD = np.arange(256, dtype=np.int64)
FOLD[65:91] += 32


class Vocabulary:
    """The distinct words of a slab: hashed word and trigram places."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray):
        n = len(buf)
        letter = LETTER[buf]
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        start = np.flatnonzero(letter & (edge[:-1] | ~np.concatenate(([False], letter[:-1])))) if n else np.zeros(0, np.int64)
        end = np.flatnonzero(letter & (edge[1:] | ~np.concatenate((letter[1:], [False])))) + 1 if n else np.zeros(0, np.int64)
        h = span(sums(buf, LOWER), start, end)
        u, first, self.code = np.unique(h, return_index=True, return_inverse=True)
        self.at = np.searchsorted(start, bounds)
        self.word = (u >> U(64 - 15)).astype(np.int64)
        # trigrams of the distinct words, with a mark on either side
        a, b = start[first], end[first]
        count = b - a
        self.cut = np.cumsum(count) - count
        i = np.repeat(a - self.cut, count) + np.arange(int(count.sum()))
        own = np.repeat(np.arange(len(u)), count)
        c = FOLD[buf[i]] if len(i) else i
        before = np.where(i > a[own], FOLD[buf[np.maximum(i - 1, 0)]], 0) if len(i) else i
        after = np.where(i < b[own] - 1, FOLD[buf[np.minimum(i + 1, n - 1)]], 0) if len(i) else i
        self.trigram = (mix((before << 16 | c << 8 | after).astype(np.uint64)) >> U(64 - 13)).astype(np.int64)
        self.count = count

    def inputs(self, w: dict[str, np.ndarray]) -> np.ndarray:
        if not len(self.word):
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        chars = np.add.reduceat(w["C"][self.trigram], self.cut, axis=0) / self.count[:, None]
        return np.hstack((w["E"][self.word], chars)).astype(np.float32)


def windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of all windows; a text without words has none."""
    words = np.diff(at)
    count = np.where(words > 0, np.maximum(1, -(-(words - (WINDOW - STRIDE)) // STRIDE)), 0)
    text = np.repeat(np.arange(len(words)), count)
    first = at[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return text, first, np.minimum(WINDOW, at[1:][text] - first)


def _gru(gates: np.ndarray, rows: np.ndarray, size: np.ndarray, R: np.ndarray, keep: bool):
    """States of one direction, [step, window, H]; windows are sorted by size, longest first."""
    n = len(size)
    states = np.zeros((WINDOW, n, HIDDEN), np.float32)
    h, trace = np.zeros((n, HIDDEN), np.float32), []
    for t in range(int(size[0]) if n else 0):
        k = int(np.searchsorted(-size, -t, "left"))  # windows with more than t words
        g = gates[rows[t, :k]]
        old = h[:k]
        zr = 0.5 * np.tanh(0.5 * (g[:, : 2 * HIDDEN] + old @ R[:, : 2 * HIDDEN])) + 0.5
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        ro = r * old
        c = np.tanh(g[:, 2 * HIDDEN :] + ro @ R[:, 2 * HIDDEN :])
        new = old + z * (c - old)
        if keep:
            trace.append((old.copy(), z, r, ro, c))
        h[:k] = new
        states[t, :k] = new
    return states, trace


def _rows(code: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word codes by step, forwards and backwards."""
    t = np.arange(WINDOW)[:, None]
    top = max(0, len(code) - 1)
    return code[np.minimum(first + t, top)], code[np.clip(first + size - 1 - t, 0, top)]


def forward(w: dict[str, np.ndarray], x: np.ndarray, code: np.ndarray, first: np.ndarray, size: np.ndarray, keep: bool = False):
    """Logits of windows sorted by size, longest first."""
    ahead, back = _rows(code, first, size)
    hf, tf = _gru(x @ w["Wf"] + w["bf"], ahead, size, w["Rf"], keep)
    hb, tb = _gru(x @ w["Wb"] + w["bb"], back, size, w["Rb"], keep)
    t = np.arange(WINDOW)[:, None]
    flip = np.where(t < size, size - 1 - t, 0)
    hb = np.take_along_axis(hb, flip[:, :, None], 0)  # by position, like the forward states
    h = np.concatenate((hf, hb), 2)
    e = h @ w["a"]
    e = np.where(t < size, e, -np.inf)
    p = np.exp(e - e.max(0))
    p /= p.sum(0)
    pooled = np.einsum("tn,tnh->nh", p, h)
    return pooled @ w["o"] + w["c"][0], (ahead, back, tf, tb, flip, h, p, pooled)


def _back_gru(grad: np.ndarray, rows: np.ndarray, size: np.ndarray, trace: list, R: np.ndarray, words: int):
    dgates, dR, dh = np.zeros((words, 3 * HIDDEN), np.float32), np.zeros_like(R), np.zeros((len(size), HIDDEN), np.float32)
    for t in range(len(trace) - 1, -1, -1):
        old, z, r, ro, c = trace[t]
        k = len(old)
        d = dh[:k] + grad[t, :k]
        dc = d * z * (1 - c * c)
        dro = dc @ R[:, 2 * HIDDEN :].T
        dzr = np.hstack((d * (c - old) * z * (1 - z), dro * old * r * (1 - r)))
        dR[:, 2 * HIDDEN :] += ro.T @ dc
        dR[:, : 2 * HIDDEN] += old.T @ dzr
        dh[:k] = d * (1 - z) + dro * r + dzr @ R[:, : 2 * HIDDEN].T
        np.add.at(dgates, rows[t, :k], np.hstack((dzr, dc)))
    return dgates, dR


def gradients(w, x, code, first, size, d, cache) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the weights and of the words' inputs, for the logits' gradients d."""
    ahead, back, tf, tb, flip, h, p, pooled = cache
    dpool = d[:, None] * w["o"]
    de = p * (np.einsum("tnh,nh->tn", h, dpool) - (pooled * dpool).sum(1))
    dh = p[:, :, None] * dpool + de[:, :, None] * w["a"]
    t = np.arange(WINDOW)[:, None]
    dh *= (t < size)[:, :, None]
    dback = np.take_along_axis(dh[:, :, HIDDEN:], flip[:, :, None], 0) * (t < size)[:, :, None]
    gf, dRf = _back_gru(dh[:, :, :HIDDEN], ahead, size, tf, w["Rf"], len(x))
    gb, dRb = _back_gru(dback, back, size, tb, w["Rb"], len(x))
    grads = {"o": pooled.T @ d, "c": np.array([d.sum()]), "a": np.einsum("tn,tnh->h", de, h), "Rf": dRf, "Rb": dRb, "Wf": x.T @ gf, "Wb": x.T @ gb, "bf": gf.sum(0), "bb": gb.sum(0)}
    return grads, gf @ w["Wf"].T + gb @ w["Wb"].T


def document_logits(w: dict[str, np.ndarray], buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The largest logit of each text's windows; without words, that of a state of zeros."""
    v = Vocabulary(buf, bounds)
    text, first, size = windows(v.at)
    out = np.full(len(bounds) - 1, -np.inf, np.float32)
    x = v.inputs(w)
    order = np.argsort(-size, kind="stable")
    for a in range(0, len(order), 4096):
        some = order[a : a + 4096]
        np.maximum.at(out, text[some], forward(w, x, v.code, first[some], size[some])[0])
    return np.where(np.isfinite(out), out, w["c"][0])


def learn(texts: list[bytes], y: np.ndarray, share: float, seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    norm = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b)).astype(np.float32)
    d = WORD_DIM + CHAR_DIM
    w = {
        "E": rng.normal(0, 0.1, (WORDS, WORD_DIM)).astype(np.float32), "C": rng.normal(0, 0.1, (TRIGRAMS, CHAR_DIM)).astype(np.float32),
        "Wf": norm(d, 3 * HIDDEN), "Wb": norm(d, 3 * HIDDEN), "Rf": norm(HIDDEN, 3 * HIDDEN), "Rb": norm(HIDDEN, 3 * HIDDEN), "bf": np.zeros(3 * HIDDEN, np.float32), "bb": np.zeros(3 * HIDDEN, np.float32),
        "a": norm(2 * HIDDEN, 1)[:, 0], "o": norm(2 * HIDDEN, 1)[:, 0], "c": np.full(1, -1.0, np.float32),
    }
    if not len(texts) or len(set(y.tolist())) < 2:
        w["o"][:] = 0
        w["c"][:] = np.log(max(1e-3, share) / max(1e-3, 1 - share))
        return w
    buf = np.frombuffer(b"".join(texts), np.uint8)
    v = Vocabulary(buf, np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
    text, first, size = windows(v.at)
    # words begin with how much likelier they are in documents of label 1
    owner = np.repeat(np.arange(len(texts)), np.diff(v.at))
    pairs = np.unique(owner * WORDS + v.word[v.code])
    seen = [np.bincount(pairs[y[pairs // WORDS] == k] % WORDS, minlength=WORDS) for k in (0, 1)]
    odds = np.log((seen[1] + 0.5) / (y.sum() + 1)) - np.log((seen[0] + 0.5) / ((1 - y).sum() + 1))
    odds = np.where(seen[0] + seen[1] > 3, np.clip(odds, -3, 6), 0)
    w["E"][:, 0] = odds / 3
    evidence = np.concatenate(([0.0], np.cumsum(np.maximum(odds[v.word[v.code]], 0))))
    logit = evidence[first + size] - evidence[first]  # names the first windows
    adam = Adam(w, 0.01)
    for turn in range(TURNS):
        # each document's worst window, more of them of label 0, and as many of those at random
        order = np.lexsort((-logit, text))
        rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        worst = order[rank < np.where(y[text[order]] == 1, 1, HARD)]
        easy = rng.choice(np.flatnonzero(y[text] == 0), len(worst))
        chosen = np.concatenate((worst, easy))
        for epoch in range(EPOCHS):
            adam.rate = 0.01 * (1 - (turn * EPOCHS + epoch) / (TURNS * EPOCHS))
            chosen = rng.permutation(chosen)
            for a in range(0, len(chosen), BATCH):
                some = chosen[a : a + BATCH]
                some = some[np.argsort(-size[some], kind="stable")]
                t = np.arange(WINDOW)[:, None]
                used, code = np.unique(v.code[np.minimum(first[some] + t, len(v.code) - 1)], return_inverse=True)
                sub = _Part(v, used)
                x = sub.inputs(w)
                flat = code.reshape(WINDOW, -1).T.ravel()
                begin = np.arange(len(some)) * WINDOW
                got, cache = forward(w, x, flat, begin, size[some], keep=True)
                dl = ((sigmoid(got) - y[text[some]]) / len(some)).astype(np.float32)
                grads, dx = gradients(w, x, flat, begin, size[some], dl, cache)
                grads["E"] = np.zeros_like(w["E"])
                np.add.at(grads["E"], sub.word, dx[:, :WORD_DIM])
                grads["C"] = np.zeros_like(w["C"])
                np.add.at(grads["C"], sub.trigram, np.repeat(dx[:, WORD_DIM:] / sub.count[:, None], sub.count, 0))
                adam.step(grads)
        logit = np.empty(len(first), np.float32)
        x = v.inputs(w)
        order = np.argsort(-size, kind="stable")
        for a in range(0, len(order), 4096):
            some = order[a : a + 4096]
            logit[some] = forward(w, x, v.code, first[some], size[some])[0]
    top = np.full(len(texts), w["c"][0], np.float64)
    np.maximum.at(top, text, logit)
    return _calibrated(w, top, y, share)


def _calibrated(w: dict[str, np.ndarray], top: np.ndarray, y: np.ndarray, share: float) -> dict[str, np.ndarray]:
    """Scale and shift the logits to fit documents' labels at their true share, by Newton's method."""
    part, beta = y.mean(), np.array([1.0, 0.0])
    weight = np.where(y == 1, share / part, (1 - share) / (1 - part))
    f = np.column_stack((top, np.ones(len(top))))
    for _ in range(30):
        p = sigmoid(f @ beta)
        slope = f.T @ ((p - y) * weight) + 1e-3 * len(y) * (beta - [1.0, 0.0])
        beta -= np.linalg.solve((f * (weight * p * (1 - p))[:, None]).T @ f + 1e-3 * len(y) * np.eye(2), slope)
    beta[0] = max(beta[0], 0.1)
    w["o"] = (w["o"] * beta[0]).astype(np.float32)
    w["c"] = (w["c"] * beta[0] + beta[1]).astype(np.float32)
    return w


class _Part(Vocabulary):
    """Some of a vocabulary's words."""

    def __init__(self, v: Vocabulary, used: np.ndarray):
        self.word, self.count = v.word[used], v.count[used]
        self.cut = np.cumsum(self.count) - self.count
        self.trigram = v.trigram[np.repeat(v.cut[used] - self.cut, self.count) + np.arange(int(self.count.sum()))]


def _score(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [document_logits(weights.value, buf, bounds) for _, _, buf, bounds in slabs(texts_of(batch), limit=1 << 20)]
            score = sigmoid(np.concatenate(out).astype(np.float64)) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score)], names=["row", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, learn_from: Column, *, label: str = "toxic", keep: list[str] | None = None) -> DataFrame:
    """(keep columns, score) for every row of ``docs``: the higher, the likelier its label is 1.

    ``learn_from`` is a condition on ``doc_id`` that says whose labels may be learned;
    at most ``DOCUMENTS`` of each class are, by the smallest hash of the id, with all
    windows of their texts. Whole texts are scored. Null texts count as empty, and texts
    without letters score like a state of zeros. Without any label, or with one class
    only, all scores are that class's share. Ids may be null or repeated; equal texts
    have equal scores; other columns are ignored unless kept. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    keep = ["doc_id"] if keep is None else keep
    rows = sorted(sample(docs, labels, label, learn_from, DOCUMENTS).collect(), key=lambda r: r.h)  # 2 * DOCUMENTS rows
    share = labels.where(learn_from).agg(F.avg(F.col(label).cast("double"))).first()[0]
    y = np.array([r.y for r in rows], np.int64)
    weights = spark.sparkContext.broadcast(learn([r.text.encode() for r in rows], y, 0.0 if share is None else float(share)))
    rows = rows_with_text(docs, keep)
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_score(weights), f"row {kind}, score double").select("row.*", "score")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): labels are learned where crc32 of the id modulo 5 is not 0."""
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    scored = score_toxicity(docs, labels, ~held)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
