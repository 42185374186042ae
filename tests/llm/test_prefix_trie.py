"""The trie against plain dictionaries, and subtree sums against walking every tree."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from surveyframe.llm import prefix_trie as trie
from tests.conftest import SF_DIR

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in sorted(built.items()):
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids[p])
        ends = ",".join(str(c) for c in members[p] if len(built[c]) == len(p))
        up = members[p[:-1]][0] if p else None
        out.append((members[p][0], len(p), up, len(members[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth long, key string")
    got = trie.prefix_trie(df)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(rows), key=str)


@pytest.mark.parametrize("block", [100_000, 7])
def test_odd_rows(spark, monkeypatch, block):
    """Nulls, ties, repeated rows, a long conversation, missing ones to begin from, and many that are equal."""
    monkeypatch.setattr(trie, "BLOCK_ROWS", block)
    monkeypatch.setattr(trie, "CHUNK", 10)
    rng = random.Random(3)
    rows = [(None, 0, "user", "lost"), (7, None, None, None), (7, None, "user", ""), (7, 1, "user", "a b"), (7, 1, "user", "a b"), (7, 1, "a", "z")]
    rows += [(40, t, "user", rng.choice(["one", "two\tthree", " ", "é x"])) for t in range(70)]
    rows += [(c, t, "user" if t % 2 else "assistant", f"common {t}") for c in range(100, 160) for t in range(3)]
    rows += [(c, t, "user", f"{rng.choice('ab')} {t}") for c in range(200, 230) for t in range(rng.randint(1, 6))]
    rows += [(c, 0, "user", "short") for c in (301, 302, 303, 304, 305, 306)]
    rng.shuffle(rows)
    check(spark, rows)


def test_given_conversations_and_an_empty_table(spark):
    df = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    check(spark, [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert trie.prefix_trie(df.limit(0)).count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "broom", "random", "caterpillar", "alone"])
def test_contraction_of_any_tree(spark, shape):
    rng = random.Random(shape)
    n = 1 if shape == "alone" else 120
    up = {0: None}
    for k in range(1, n):
        up[k] = {"chain": k - 1, "star": 0, "broom": k - 1 if k < 60 else 59, "random": rng.randrange(max(0, k - 12), k), "caterpillar": k - 1 if k % 2 else max(0, k - 2), "alone": 0}[shape]
    depth = {0: 0}
    for k in range(1, n):
        depth[k] = depth[up[k]] + 1
    value = {k: rng.randrange(100) for k in up}
    want = dict(value)
    for k in range(n - 1, 0, -1):
        want[up[k]] += want[k]
    rows = [(k, depth[k], p, None if p is None else depth[p], value[k], 1) for k, p in up.items()]
    df = spark.createDataFrame(rows, "conv long, depth long, up_conv long, up_depth long, s long, one long")
    got = trie.subtree_sums(df, ["s", "one"]).collect()
    assert len(got) == n and {r.conv: r.s for r in got} == want
