"""Repeated passages of short words, which a length in bytes does not reach."""

import random

import corpus_pipeline
from surveyframe.llm.suffix import repeated_bytes
from tests.conftest import SF_DIR


def gone_words(texts, size):
    """For each text, which of its words some repeated string of ``size`` words covers."""
    words = [t.split() for t in texts]
    seen = {}
    for w in words:
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append(gone)
    return out


def test_planted_passages_of_short_words(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    some = lambda n: [word() for _ in range(n)]
    texts, whole = [], []
    for n in (50, 51, 52, 55, 60):
        passage = some(n)
        assert len(" ".join(passage)) < 400
        for _ in range(3):
            a, b = some(rng.randint(0, 200)), some(rng.randint(1, 200))
            texts.append(" ".join([*a, "\n".join(passage), *b]) if rng.random() < 0.5 else " ".join([*a, *passage, *b]))
            whole.append([*a, *(passage if n < 51 else []), *b])
    long = "é" * 500  # few words, many bytes
    texts += [f"x {long} y", f"z {long} u"]
    whole += [["xy"], ["zu"]]  # the spaces beside it are repeated too
    df = spark.createDataFrame([(i, t, "en", "s0", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.repeat_stage(spark, df, SF_DIR).collect()}
    assert [got[i].text.split() for i in range(len(texts))] == whole
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_words_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = {r.doc_id: r for r in repeated_bytes(docs, length=51, words=True, spans=True).collect()}
    split = lambda t: t.encode().split()
    want = gone_words([t.encode() for _, t in rows], 51)
    for (i, text), gone in zip(rows, want, strict=True):
        raw = text.encode()
        keep = bytearray(raw)
        for lo, hi in got[i].spans or []:
            keep[lo:hi] = b" " * (hi - lo)
        assert bytes(keep).split() == [w for w, g in zip(split(text), gone, strict=True) if not g]
    assert any(any(g) for g in want)
