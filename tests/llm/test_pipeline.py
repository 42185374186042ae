"""The stages of the pipeline, each against a plain version on the same input."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from surveyframe.llm.common import scratch_tables
from surveyframe.session import settled
from tests.conftest import SF_DIR
from tests.llm.test_jaccard import brute as components


def without_repeats(texts, length, size):
    """Texts without the characters of which every byte is in a repeated string of bytes or of words."""
    raw = [(t or "").encode() for t in texts]
    words = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", x)] for x in raw]
    grams = [[tuple(x[a:b] for a, b in w[k : k + size]) for k in range(len(w) - size + 1)] for x, w in zip(raw, words, strict=True)]
    seen = Counter(x[k : k + length] for x in raw for k in range(len(x) - length + 1))
    met = Counter(g for own in grams for g in own)
    out = []
    for text, x, w, own in zip(texts, raw, words, grams, strict=True):
        gone = bytearray(len(x))
        for k in range(len(x) - length + 1):
            if seen[x[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        for k, g in enumerate(own):
            if met[g] > 1:
                a, b = w[k][0], w[k + size - 1][1]
                gone[a:b] = b"\1" * (b - a)
        kept, at = [], 0
        for c in text or "":
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        out.append("".join(kept))
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names, kept, held = [], [docs], []
    before = scratch_tables(spark)
    for name, stage in corpus_pipeline.STAGES:
        names.append(name)
        kept.append(settled(stage(spark, kept[-1], SF_DIR), name))
        held.append(len(scratch_tables(spark) - before))
    # what a stage wrote on its way goes with the next; results stay
    assert len(scratch_tables(spark) - before) < sum(held) and max(held) < 150
    rows = [{r.doc_id: r for r in d.collect()} for d in kept[:5]]
    assert [d.columns for d in kept[:5]] == [docs.columns] * 5 and names[0] == "quality" and names[-1] == "packing"

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    good = [i for i, y in labels.items() if y == 1]
    assert sum(i in rows[1] for i in good) >= 0.98 * len(good)
    bad = [i for i, y in labels.items() if y == 0]
    assert sum(i in rows[1] for i in bad) <= 0.1 * len(bad)
    assert all(rows[1][i] == rows[0][i] for i in rows[1])

    want = components([(i, r.text) for i, r in sorted(rows[1].items())], 5, 80)
    assert set(rows[2]) == {i for i, _, c in want if i == c}

    texts = [r.text for _, r in sorted(rows[2].items())]
    assert set(rows[3]) == set(rows[2])
    for (_, r), want in zip(sorted(rows[3].items()), without_repeats(texts, 400, 51), strict=True):
        assert r.text == want and r.n_chars == len(want)
    assert any(r.text != before for (_, r), before in zip(sorted(rows[3].items()), texts, strict=True))

    assert set(rows[4]) <= set(rows[3]) and all(rows[4][i] == rows[3][i] for i in rows[4])
    size = Counter()
    for r in kept[5].collect():
        size[r.doc_id] += r.length
    assert set(size) == set(rows[4])


FIELDS = "doc_id long, text string, lang string, source string, n_chars long, score double, tokens long, epoch long, row string, text_key string"
ODD = [(i, t, g, s, 0, 0.5, 1, 2, "r", "k") for i, t, g, s in [
    (1, "plain words of some length here", "en", "src1"), (1, "plain words of some length here", "en", "src1"), (None, "no id at all", None, None),
    (2, None, "en", "src1"), (3, "", "de", "src2"), (4, " \n", "xx", "other"), (5, "word " * 3_000, "en", "src1"), (6, "word " * 3_000, "en", "src1")]]


@pytest.mark.parametrize("k", range(5))
def test_each_stage_takes_odd_rows(spark, k):
    """Null and empty texts, repeated rows, ties, extra columns with names that operators use, and no rows at all."""
    name, stage = corpus_pipeline.STAGES[k]
    docs = spark.createDataFrame(ODD, FIELDS)
    got = [r.asDict() for r in stage(spark, docs, SF_DIR).collect()]
    assert stage(spark, docs.limit(0), SF_DIR).count() == 0
    if name == "packing":
        assert sorted((r["doc_id"] or 0, r["doc_tokens"]) for r in got if r["start"] == 0)[:3] == [(0, 5), (1, 7), (1, 7)]
        return
    assert all(list(r) == docs.columns and (r["score"], r["tokens"], r["epoch"], r["row"], r["text_key"]) == (0.5, 1, 2, "r", "k") for r in got)
    ids = sorted(r["doc_id"] or 0 for r in got)
    if name == "near_duplicates":
        assert ids == [0, 1, 1, 2, 3, 4, 5]
    elif name == "repeats":
        assert ids == [0, 1, 1, 2, 3, 4, 5, 6] and {r["text"] for r in got if r["doc_id"] in (5, 6)} <= {"", " "} and [r["text"] for r in got if r["doc_id"] == 2] == [None]
    elif name == "mixing":
        assert set(ids) <= {0, 1, 2, 3, 4, 5, 6} and ids.count(1) in (0, 2)
    else:
        assert ids.count(1) in (0, 2) and (5 in ids) == (6 in ids)
