"""Alignment of paragraphs against all pairings, and edits whose rows are known."""

import random
from functools import lru_cache

import pytest

from surveyframe.operators import alignment
from tests.conftest import rows

COLUMNS = ["doc_id", "source_no", "target_no", "numbers_source", "numbers_target", "kind"]


def align(spark, source, target):
    frame = lambda side: spark.createDataFrame([(*r, 1) for r in side], "doc_id long, para_no int, text string, gap long")
    got = alignment.align_translation(frame(source), frame(target))
    assert got.columns == COLUMNS
    return rows(got, *COLUMNS)


def test_one_edit_is_one_row(spark):
    text = [(1, k, f"Base {k * 10} of {k}") for k in range(1, 9)]
    moved = [(1, 1, "Neu: 777"), *((1, k + 1, t) for _, k, t in text)]
    assert align(spark, text, moved) == {(1, None, 1, "", "777", "only in target")}
    assert align(spark, moved, text) == {(1, 1, None, "777", "", "only in source")}
    wrong = [(1, k, t.replace("of 3", "of 4")) for _, k, t in moved]
    assert align(spark, text, wrong) == {(1, None, 1, "", "777", "only in target"), (1, 3, 4, "3 30", "30 4", "changed")}
    assert align(spark, text, text) == set()


def test_forms_of_numbers_and_odd_rows(spark):
    source = [(1, 1, "1,200 people"), (1, 2, "0.50 and 007"), (1, 3, "no numbers"), (1, 4, None), (None, 1, "5"), (2, 1, "9"), (3, None, "8"), (4, 1, "3"), (4, 1, "3"), (4, 1, "2")]
    target = [(1, 2, "1200 人"), (1, 5, "7 und 0.5"), (None, 1, "6"), (3, 1, ""), (4, 1, "2"), (4, 1, "3")]
    got = align(spark, source, target)
    assert {r for r in got if r[0] == 1} == set()
    assert {r for r in got if r[0] == 2} == {(2, 1, None, "9", "", "only in source")}
    assert [r[3:] for r in got if r[0] == 4] == [("3", "", "only in source")] and {r[0] for r in got} == {2, 4}
    assert align(spark, [], []) == set()


@pytest.mark.parametrize("seed", range(4))
def test_pairs_cost_least(seed):
    rng = random.Random(seed)
    side = lambda: [[str(rng.randint(1, 4)) for _ in range(rng.randint(1, 2))] for _ in range(rng.randint(0, 7))]
    for _ in range(60):
        a, b = side(), side()
        x, y = [alignment.Counter(k) for k in a], [alignment.Counter(k) for k in b]

        @lru_cache(None)
        def least(i, j, x=x, y=y):
            if i == len(x) or j == len(y):
                return float(len(x) - i + len(y) - j)
            return min(least(i + 1, j) + 1, least(i, j + 1) + 1, least(i + 1, j + 1) + alignment._cost(x[i], y[j]))  # noqa: B023

        got = alignment.pair_up(a, b)
        assert [i for i, _ in got if i is not None] == list(range(len(a))) and [j for _, j in got if j is not None] == list(range(len(b)))
        cost = sum(1 if i is None or j is None else alignment._cost(x[i], y[j]) for i, j in got)
        assert cost == pytest.approx(least(0, 0))


def test_a_band_holds_long_gaps(spark):
    text = [["1"], ["2"]] * 400
    got = alignment.pair_up(text, text[:100] + [["9"]] + text[100:], band=5)
    assert [p for p in got if None in p] == [(None, 100)] and len(got) == 801


def test_many_edits_are_found_where_they_are(spark):
    rng = random.Random(1)
    source, target, want = [], [], set()
    for doc in range(30):
        s, t, kind = 0, 0, "same"
        for k in range(rng.randint(20, 60)):
            number = f"{doc * 1000 + k}" if k % 5 else "12"
            kind = rng.choice(["same"] * 9 + ["gone", "new"]) if k % 5 and kind == "same" else "same"
            if kind != "new":
                s += 1
                source.append((doc, s, f"a {number}"))
            if kind != "gone":
                t += 1
                target.append((doc, t, f"b {number}"))
            if kind == "gone":
                want.add((doc, s, None, number.lstrip("0") or "0", "", "only in source"))
            if kind == "new":
                want.add((doc, None, t, "", number.lstrip("0") or "0", "only in target"))
    got = align(spark, source, target)
    assert got == want
