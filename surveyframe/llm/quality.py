"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words, all of them encoded: how often
bytes of each class follow each other (letters by case, digits, marks, white space),
how long words are, how many differ and how many repeat the one before. A layer maps
these to a representation; gated attention, tanh times sigmoid, weighs the passages;
the weighted sum is scored. All weights are learned from document labels alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyframe.llm.common import prepare, slabs
from surveyframe.llm.encoding import word_chunks
from surveyframe.llm.labelled import Adam, remainder, rows_with_text, sample, sigmoid, texts_of
from surveyframe.llm.texthash import LOWER, span, sums

PASSAGE = 64
HIDDEN, GATE = 24, 12
#: Labelled documents of each class to learn from, by all of their passages.
DOCUMENTS = 2_000
EPOCHS, BATCH = 12, 64
#: Steps at least, for small samples.
STEPS = 400

CLASSES = 12
KIND = np.full(256, 10, np.uint8)  # other marks
KIND[ord("a") : ord("z") + 1] = 0
KIND[ord("A") : ord("Z") + 1] = 1
KIND[ord("0") : ord("9") + 1] = 2
KIND[[0x20, 0x09]] = 3
KIND[[0x0A, 0x0B, 0x0C, 0x0D]] = 4
KIND[ord(".")] = 5
KIND[ord(",")] = 6
KIND[[ord("!"), ord("?")]] = 7
KIND[[ord(c) for c in "'\"()-:;"]] = 8
KIND[0x80:] = 9
KIND[[*range(0x09), *range(0x0E, 0x20), 0x7F]] = 11
FEATURES = CLASSES * CLASSES + 5


def encode(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, each text's bounds among them); every text has one passage at least."""
    start, end = word_chunks(buf, bounds)
    at = np.searchsorted(start, bounds)
    words = np.diff(at)
    count = np.maximum(1, -(-words // PASSAGE))
    ends = np.concatenate(([0], np.cumsum(count)))
    n = int(ends[-1])
    text = np.repeat(np.arange(len(words)), count)
    first = at[:-1][text] + (np.arange(n) - ends[:-1][text]) * PASSAGE  # first word
    last = np.minimum(first + PASSAGE, at[1:][text])
    # bytes from a passage's first word to the next one's belong to it
    begin = np.where(np.arange(n) == ends[:-1][text], bounds[:-1][text], start[np.minimum(first, len(start) - 1)] if len(start) else 0)
    stop = np.append(begin[1:], len(buf))
    x = np.zeros((n, FEATURES), np.float32)
    if len(buf):
        kind = KIND[buf]
        pair = kind.astype(np.int64) * CLASSES
        pair[:-1] += kind[1:]
        owner = np.repeat(np.arange(n), stop - begin)
        pair[stop[stop > begin] - 1] = kind[stop[stop > begin] - 1].astype(np.int64) * CLASSES + 4  # a passage ends like a line
        x[:, : CLASSES * CLASSES] = np.bincount(owner * CLASSES * CLASSES + pair, minlength=n * CLASSES * CLASSES).reshape(n, -1)
        x[:, : CLASSES * CLASSES] /= np.maximum(1, stop - begin)[:, None]
        x = np.sqrt(x)
    if len(start):
        h = span(sums(buf, LOWER), start, end)
        owner = np.repeat(np.arange(n), last - first)
        same = np.concatenate(([False], (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])))
        order = np.lexsort((h, owner))
        o, hs = owner[order], h[order]
        new = np.concatenate(([True], (o[1:] != o[:-1]) | (hs[1:] != hs[:-1])))
        size = np.maximum(1, last - first)
        length = np.minimum(end - start, 40)
        mean = np.bincount(owner, length, n) / size
        x[:, -5] = np.bincount(owner, same, n) / size
        x[:, -4] = np.bincount(o, new, n) / size
        x[:, -3] = mean / 10
        x[:, -2] = np.sqrt(np.maximum(0, np.bincount(owner, length**2, n) / size - mean**2)) / 10
        x[:, -1] = np.log1p(last - first) / 4
    return x, ends


def forward(w: dict[str, np.ndarray], x: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, tuple]:
    """Logits of n bags whose passages are in order of their owner."""
    f = (x - w["mean"]) / w["scale"]
    z = np.tanh(f @ w["W"] + w["b"])
    t, g = np.tanh(z @ w["V"] + w["bv"]), sigmoid(z @ w["U"] + w["bu"])
    a = (t * g) @ w["u"]
    cut = np.searchsorted(owner, np.arange(n))
    e = np.exp(a - np.maximum.reduceat(a, cut)[owner])
    p = e / np.add.reduceat(e, cut)[owner]
    bag = np.add.reduceat(p[:, None] * z, cut, axis=0)
    return bag @ w["o"] + w["c"][0], (f, z, t, g, p, bag)


def _backward(w, cache, owner, d) -> dict[str, np.ndarray]:
    f, z, t, g, p, bag = cache
    dbag = d[:, None] * w["o"]
    dz = p[:, None] * dbag[owner]
    da = p * ((z * dbag[owner]).sum(1) - (bag * dbag).sum(1)[owner])
    dt, dg = da[:, None] * w["u"] * g * (1 - t * t), da[:, None] * w["u"] * t * g * (1 - g)
    dz += dt @ w["V"].T + dg @ w["U"].T
    dz *= 1 - z * z
    return {
        "o": bag.T @ d, "c": np.array([d.sum()]), "u": (t * g).T @ da, "V": z.T @ dt, "bv": dt.sum(0), "U": z.T @ dg, "bu": dg.sum(0), "W": f.T @ dz, "b": dz.sum(0),
    }


def learn(bags: list[np.ndarray], y: np.ndarray, share: float, seed: int = 0) -> dict[str, np.ndarray]:
    """Fit to bags of passages; ``share`` of all labels being 1 sets the classes' weights."""
    rng = np.random.default_rng(seed)
    norm = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b)).astype(np.float32)
    every = np.concatenate(bags) if bags else np.zeros((1, FEATURES), np.float32)
    w = {
        "W": norm(FEATURES, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": norm(HIDDEN, GATE), "bv": np.zeros(GATE, np.float32), "U": norm(HIDDEN, GATE), "bu": np.zeros(GATE, np.float32),
        "u": norm(GATE, 1)[:, 0], "o": norm(HIDDEN, 1)[:, 0], "c": np.zeros(1, np.float32), "mean": every.mean(0), "scale": every.std(0) + 0.05,
    }
    fixed = {k: w[k] for k in ("mean", "scale")}
    trained = {k: v for k, v in w.items() if k not in fixed}
    adam = Adam(trained, 0.003)
    part = max(1e-3, min(1 - 1e-3, float(y.mean()))) if len(y) else 0.5
    weight = np.where(y == 1, share / part, (1 - share) / (1 - part))
    epochs = max(EPOCHS, -(-STEPS // max(1, -(-len(bags) // BATCH)))) if bags else 0
    for epoch in range(epochs):
        adam.rate = 0.003 * (1 - epoch / epochs)
        order = rng.permutation(len(bags))
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            owner = np.repeat(np.arange(len(some)), [len(bags[i]) for i in some])
            logit, cache = forward(trained | fixed, np.concatenate([bags[i] for i in some]), owner, len(some))
            grads = _backward(trained, cache, owner, (sigmoid(logit) - y[some]) * weight[some] / len(some))
            for k in ("W", "V", "U"):
                grads[k] += 1e-4 * trained[k]
            adam.step(grads)
    return trained | fixed


def _score(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            out = []
            for at, end, buf, bounds in slabs(texts_of(batch), limit=1 << 20):
                x, ends = encode(buf, bounds)
                out.append(sigmoid(forward(w, x, np.repeat(np.arange(end - at), np.diff(ends)), end - at)[0]))
            score = np.concatenate(out).astype(np.float64) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score)], names=["row", "score"])

    return run


def _sampled(rows: list) -> tuple[list[np.ndarray], np.ndarray]:
    bags, y = [], []
    for r in sorted(rows, key=lambda r: r.h):
        raw = np.frombuffer(r.text.encode(), np.uint8)
        bags.append(encode(raw, np.array([0, len(raw)]))[0])
        y.append(r.y)
    return bags, np.array(y, np.float32)


def _fitted(docs: DataFrame, labels: DataFrame, learn_from: Column, label: str):
    """The model's weights, broadcast, learned from at most 2 * DOCUMENTS rows."""
    spark = docs.sparkSession
    prepare(spark)
    bags, y = _sampled(sample(docs, labels, label, learn_from, DOCUMENTS).collect())
    share = labels.where(learn_from).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return spark.sparkContext.broadcast(learn(bags, y, 0.5 if share is None else float(share)))


def keep_good(docs: DataFrame, labels: DataFrame, learn_from: Column, *, label: str = "quality", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more, as ``score_quality`` tells it.

    Only texts pass through Python, and only scores come back: rows are neither copied
    nor shuffled, and columns of any name stay as they are.
    """
    weights = _fitted(docs, labels, learn_from, label)

    def scores(text: pa.Array) -> pa.Array:
        return next(_score(weights)(iter([pa.RecordBatch.from_arrays([text, text], names=["row", "text"])])))["score"]

    told = F.arrow_udf(scores, "double")
    return docs.where(told(F.coalesce(F.col("text"), F.lit(""))) >= least)


def score_quality(docs: DataFrame, labels: DataFrame, learn_from: Column, *, label: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """(keep columns, score) for every row of ``docs``: the higher, the likelier its label is 1.

    ``learn_from`` is a condition on ``doc_id`` that says whose labels may be learned;
    at most ``DOCUMENTS`` of each class are, by the smallest hash of the id. Whole texts
    are scored, null ones as empty, which have one passage without words. Without any
    label, or with one class only, scores lie about that class's share. Ids may be null
    or repeated; equal texts have equal scores; other columns are ignored unless kept.
    An empty table gives an empty result.
    """
    keep = ["doc_id"] if keep is None else keep
    weights = _fitted(docs, labels, learn_from, label)
    rows = rows_with_text(docs, keep)
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_score(weights), f"row {kind}, score double").select("row.*", "score")


def held_out(modulus: int, rest: int) -> Column:
    """Whether the label of a document is held out; false for a null id."""
    return F.coalesce(remainder(F.col("doc_id"), modulus) == rest, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): labels are learned where crc32 of the id modulo 3 is not 1."""
    scored = score_quality(docs, labels, ~held_out(3, 1))
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
