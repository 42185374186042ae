"""Budgets against a plain recursive filling, and the documents taken."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from surveyframe.llm.mixing import mix

COLS = "doc_id long, text string, domain string, lang string, source string, tokens long, leaf string"


def fill(budget, kids):
    """kids: name -> (weight, cap)"""
    got, open_ = dict.fromkeys(kids, 0.0), {k for k, (w, c) in kids.items() if w > 0}
    left = budget
    while open_:
        level = left / sum(kids[k][0] for k in open_)
        full = {k for k in open_ if kids[k][1] <= kids[k][0] * level}
        if not full:
            for k in open_:
                got[k] = kids[k][0] * level
            break
        for k in full:
            got[k] = kids[k][1]
            left -= kids[k][1]
        open_ -= full
    return got


def want(rows, weights, fraction, epochs):
    tokens = defaultdict(int)
    for r in rows:
        tokens[tuple(x or "(null)" for x in r[2:5])] += len((r[1] or "").split())
    plan = {(): float(int(sum(tokens.values()) * fraction))}
    for depth, level in enumerate(("domain", "lang", "source")):
        kids = defaultdict(lambda: defaultdict(float))
        for path, n in tokens.items():
            kids[path[:depth]][path[depth]] += n * epochs
        plan = {(*p, k): g for p, b in plan.items() for k, g in fill(b, {k: (weights.get(level, {}).get(k, 1.0), c) for k, c in kids[p].items()}).items()}
    return {p: (int(b + 1e-6), tokens[p]) for p, b in plan.items()}


@pytest.mark.parametrize("fraction,epochs", [(0.3, 1), (0.9, 1), (2.5, 4), (9.0, 2)])
def test_budgets_and_prefixes(spark, fraction, epochs):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        text = rng.choice([None, "", "a b c", "x " * rng.randint(1, 80)])
        source = "s0" if rng.random() < 0.4 else f"s{rng.randint(1, 9)}"
        rows.append((i if i % 50 else None, text, rng.choice(["d0", "d1", "d1", None]), rng.choice(["en", "en", "en", "de", None]), source, -1, "clash"))
    weights = {"domain": {"d0": 5.0, "(null)": 0.5}, "lang": {"de": 3.0, "en": 1.0}, "source": {"s3": 0.0}}
    df = spark.createDataFrame(rows, COLS)
    levels = {c: F.col(c) for c in ("domain", "lang", "source")}
    got = mix(df, levels, weights, fraction=fraction, max_epochs=epochs, seed=3, keep=["doc_id", "text", "domain", "lang", "source"], tokens=None)
    used, largest = defaultdict(int), 80
    seen = defaultdict(list)
    for r in got.collect():
        path = tuple(x or "(null)" for x in (r.domain, r.lang, r.source))
        used[path] += r["tokens"]
        seen[(path, r.epoch)].append(r.doc_id)
        assert r["tokens"] == len((r.text or "").split())
    for path, (budget, tokens) in want(rows, weights, fraction, epochs).items():
        assert used[path] <= budget
        # null ids are one hash: they are taken together
        nulls = sum(len((r[1] or "").split()) for r in rows if r[0] is None and tuple(x or "(null)" for x in r[2:5]) == path)
        assert used[path] > budget - largest - nulls or used[path] == budget
        for e in range(1, budget // tokens + 1 if tokens else 1):
            assert len(seen[(path, e)]) == sum(tuple(x or "(null)" for x in r[2:5]) == path for r in rows)
    again = mix(df, levels, weights, fraction=fraction, max_epochs=epochs, seed=3, keep=["doc_id", "text", "domain", "lang", "source"])
    assert sorted(map(repr, again.collect())) == sorted(map(repr, got.collect()))


def test_an_empty_table(spark):
    df = spark.createDataFrame([], COLS)
    assert mix(df, {"lang": F.col("lang")}, {}, fraction=0.5).count() == 0
