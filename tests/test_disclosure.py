"""Hidden cells against all tables that agree with what is published, and unsafe combinations against all sets."""

from collections import Counter
from itertools import combinations, product

import pytest

from surveyframe.operators import disclosure


def cube(cells, size):
    out = Counter()
    for key, n in cells.items():
        for mask in range(1 << size):
            out[tuple(None if mask >> i & 1 else x for i, x in enumerate(key)), mask] += n
    return {c: n for c, n in out.items() if n}


def lines(table, size):
    """Each line as (total, parts)."""
    found = {}
    for (key, mask), _ in table.items():
        for i in range(size):
            line = (i, mask & ~(1 << i), key[:i] + key[i + 1 :])
            whole, parts = found.setdefault(line, ([], []))
            (whole if mask >> i & 1 else parts).append((key, mask))
    return [(w[0], p) for w, p in found.values() if w and p]


def frame(spark, cells, names):
    return spark.createDataFrame([(*key, n) for key, n in cells.items()], ", ".join(f"{c} string" for c in names) + ", n long")


def told(df, names):
    return {(tuple(r.cell[c] for c in names), r.cell["level"]): r for r in df.collect()}


# the second has a lone small cell beside empty ones; the third two people in two cells under a published total
CASES = [
    {("a", "x"): 3, ("a", "y"): 20, ("a", "z"): 30, ("b", "x"): 25, ("b", "y"): 22, ("b", "z"): 40, ("c", "x"): 9, ("c", "y"): 8, ("c", "z"): 7},
    {("a", "x"): 3, ("b", "x"): 30, ("b", "y"): 20, ("c", "y"): 11, ("c", "x"): 12},
    {("a", "x"): 1, ("a", "y"): 1, ("a", "z"): 9, ("b", "x"): 1, ("b", "y"): 1, ("b", "z"): 9, ("c", "x"): 9, ("c", "y"): 9, ("c", "z"): 9},
    {("a", None): 2, (None, "x"): 30, (None, None): 10, ("a", "x"): 20},
]


@pytest.mark.parametrize("cells", CASES)
def test_no_line_has_a_lone_hidden_cell(spark, cells):
    got = told(disclosure.protect_margins(frame(spark, cells, "pq"), ["p", "q"], 5), "pq")
    want = cube(cells, 2)
    assert {c: r.n for c, r in got.items()} == want
    assert all(r.hidden for c, r in got.items() if r.n < 5)
    for whole, parts in lines(want, 2):
        assert sum(got[c].hidden for c in [whole, *parts]) != 1


@pytest.mark.parametrize("cells", CASES[:3])
def test_bounds_hold_for_all_tables_that_agree_and_none_is_exact(spark, cells):
    dims = ["p", "q"]
    table = disclosure.protect_margins(frame(spark, cells, "pq"), dims, 5, against_bounds=True)
    got = told(disclosure.attack(table, dims), "pq")
    want, hidden = cube(cells, 2), [c for c, r in got.items() if r.hidden]
    assert all((r.lo, r.hi) == (r.n, r.n) for r in got.values() if not r.hidden)
    assert not any(got[c].lo == got[c].hi for c in hidden)
    inner = [c for c in hidden if c[1] == 0]
    # every filling of the hidden inner cells that gives the published totals
    fixed = {c: n for c, n in want.items() if c[1] == 0 and c not in inner}
    ranges = [range(1, min(got[c].hi or 12, 12) + 1) for c in inner]
    seen = {c: set() for c in hidden}
    if 0 < len(inner) <= 5:
        for filling in product(*ranges):
            other = cube({k[0]: n for k, n in fixed.items()} | {c[0]: n for c, n in zip(inner, filling, strict=True)}, 2)
            if all(other[c] == n for c, n in want.items() if c not in hidden):
                for c in hidden:
                    seen[c].add(other[c])
        for c in hidden:
            assert want[c] in seen[c] and len(seen[c]) > 1
            assert all(got[c].lo <= x and (got[c].hi is None or x <= got[c].hi) for x in seen[c])


def test_attack_finds_what_lines_alone_give_away(spark):
    """Two cells of one person each under a published total of two."""
    rows = [(("a", "x"), 0, 1, True), (("a", "y"), 0, 1, True), (("a", None), 2, 2, False), (("b", "x"), 0, 8, True), (("b", "y"), 0, 9, True), (("b", None), 2, 17, False)]
    rows += [((None, "x"), 1, 9, False), ((None, "y"), 1, 10, False), ((None, None), 3, 19, False)]
    df = spark.createDataFrame([((*key, level), n, h) for key, level, n, h in rows], "cell struct<p string, q string, level int>, n long, hidden boolean")
    got = told(disclosure.attack(df, ["p", "q"]), "pq")
    assert {(r.lo, r.hi) for c, r in got.items() if r.hidden} == {(1, 1), (8, 8), (9, 9)}


def test_within_and_an_empty_table(spark):
    df = spark.createDataFrame([("g", "a", 2), ("g", "b", 10), ("h", "a", 10), ("h", "b", 10)], "g string, p string, n long")
    got = {(r.g, r.p): r.n for r in disclosure.published(disclosure.protect_margins(df, ["p"], 5, within=["g"])).collect()}
    assert got == {("g", "a"): None, ("g", "b"): None, ("g", None): 12, ("h", "a"): 10, ("h", "b"): 10, ("h", None): 20}
    assert disclosure.protect_margins(df.limit(0), ["p"], 5).count() == 0


@pytest.mark.parametrize("k,most", [(2, None), (4, None), (3, 2)])
def test_smallest_unsafe_combinations(spark, k, most):
    names = ["a", "b", "c", "d"]
    rows = [(i % 7 if i % 11 else None, "xyz"[i * i % 3], i % 5, "m" if i < 3 else "n") for i in range(150)]
    rows += [rows[4]] * 60  # one combination holds many
    df = spark.createDataFrame(rows, "a long, b string, c int, d string")
    unsafe = {}
    for size in range(1, (most or 4) + 1):
        for kept in combinations(range(4), size):
            for value, n in Counter(tuple(r[i] for i in kept) for r in rows).items():
                parts = (unsafe.get((kept[:j] + kept[j + 1 :], value[:j] + value[j + 1 :])) for j in range(size))
                if n < k:
                    unsafe[kept, value] = (n, not any(p is not None for p in parts))
    want = {(",".join(names[i] for i in kept), tuple(None if x is None else str(x) for x in value), n) for (kept, value), (n, least) in unsafe.items() if least}
    got = [(r.attributes, tuple(r["values"]), r.n) for r in disclosure.unsafe_combinations(df, names, k, most).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert disclosure.unsafe_combinations(df.limit(0), names, k).count() == 0
