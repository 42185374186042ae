"""Random small surveys against plain Python counts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from surveyframe.operators import clean, segments, shift, tally
from tests.conftest import rows

OPTIONS = ["a", "b", "c", "d"]
SEGMENTS = ["s0", "s1", "s2"]


@pytest.fixture(scope="module", params=[1, 2])
def survey(spark, request):
    rng = random.Random(request.param)
    people = {i: rng.choice(SEGMENTS[: 2 + request.param % 2]) for i in range(60)}
    picks = [(rng.randrange(60), "q", rng.choice(OPTIONS), rng.choice(["w1", "w2"])) for _ in range(150)]
    answers = spark.createDataFrame(picks, "respondent_id long, question_id string, option_id string, wave string")
    respondents = spark.createDataFrame(list(people.items()), "respondent_id long, segment string")
    return answers, respondents, picks, people


def held(picks, option, wave=None):
    return {r for r, _, o, w in picks if o == option and wave in (None, w)}


def test_crosstab(survey):
    answers, respondents, picks, people = survey
    base = {r for r, *_ in picks}
    want = set()
    for s in SEGMENTS:
        d = sum(people[r] == s for r in base)
        for o in OPTIONS:
            want.add((s, o, sum(people[r] == s for r in held(picks, o)), d))
    got = tally.crosstab(answers, respondents, "q", OPTIONS, SEGMENTS)
    assert rows(got, "segment", "option_id", "n", "d") == want


def test_reach_lies_between_largest_option_and_sum(survey):
    answers, _, picks, _ = survey
    groups = {"ab": ["a", "b"], "bcd": ["b", "c", "d"], "none": []}
    got = {r.group_id: r.n for r in tally.net_reach(answers, "q", groups).collect()}
    for g, ids in groups.items():
        parts = [held(picks, o) for o in ids]
        assert got[g] == len(set().union(*parts))
        assert max(map(len, parts), default=0) <= got[g] <= sum(map(len, parts))


def test_segments_add_to_the_total(survey):
    answers, respondents, picks, _ = survey
    votes = tally.ballots(answers, "q", {o: [o] for o in OPTIONS}).join(respondents, "respondent_id")
    table = tally.distribution_with_total(votes, OPTIONS)
    per = table.groupBy("option_id", F.col("segment") == "all").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).collect()
    total, parts = ({r[0]: (r.n, r.d) for r in per if r[1] is flag} for flag in (True, False))
    assert total == parts
    assert all(total[o][0] == len(held(picks, o)) for o in OPTIONS)


def test_shift_over_people_in_both_waves(survey):
    answers, _, picks, _ = survey
    both = {r for r, _, _, w in picks if w == "w1"} & {r for r, _, _, w in picks if w == "w2"}
    want = {(o, len(held(picks, o, "w1") & both), len(held(picks, o, "w2") & both), len(both)) for o in OPTIONS}
    moved = shift.shift(answers, "q", "w1", "w2", OPTIONS)
    assert rows(moved, "option_id", "n_then", "n_now", "d") == want
    least = min(now - then for _, then, now, _ in want)
    if least < 0:
        assert rows(shift.largest_drop(moved), "option_id") == {(o,) for o, then, now, _ in want if now - then == least}


def test_parity_counts_copies(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (4, "z")], "k int, v string")
    assert rows(tally.parity(a, b), "k", "v", "side", "copies") == {(1, "x", "left", 1), (3, "z", "left", 1), (4, "z", "right", 1)}
    assert tally.parity(a, a).count() == 0


def test_bands_include_their_upper_limit(spark):
    ages = spark.createDataFrame([(30,), (31,), (40,), (41,), (None,)], "age int")
    banded = segments.band(ages, "age", [30, 40], ["30 and under", "31 to 40", "41 and over"])
    assert rows(banded, "age", "band") == {
        (30, "30 and under"), (31, "31 to 40"), (40, "31 to 40"), (41, "41 and over"), (None, None),
    }
    with pytest.raises(ValueError, match="one more label"):
        segments.band(ages, "age", [30, 40], ["a", "b"])


def test_more_options_than_bits_in_one_number(spark):
    answers = spark.range(4000).select(
        (F.col("id") % 11).alias("respondent_id"), F.lit("q").alias("question_id"), (F.col("id") % 130).cast("string").alias("option_id")
    )
    options = [str(i) for i in range(130)]
    want = {(str(o), len({i % 11 for i in range(4000) if i % 130 == o}), 11) for o in range(130)}
    assert rows(tally.multi_distribution(answers, "q", options), "option_id", "n", "d") == want
    halves = tally.net_reach(answers.filter("respondent_id < 3"), "q", {"all": options, "none": ["x"]})
    assert rows(halves, "group_id", "n", "d") == {("all", 3, 3), ("none", 0, 3)}


def test_cells_are_split_at_the_literal_separator(spark):
    cells = spark.createDataFrame([(1, "a | b|a||"), (2, ""), (3, None), (4, "c.d")], "respondent_id int, cell string")
    want = {(1, "a"), (1, "b"), (4, "c.d")}
    assert rows(clean.split_multi(cells, "cell", "|"), "respondent_id", "option_id") == want
    renamed = clean.split_multi(cells.withColumnRenamed("cell", "option_id"), "option_id", "|")
    assert rows(renamed, "respondent_id", "option_id") == want


def test_writeins_are_pooled_or_kept_per_question(spark):
    answers = spark.createDataFrame(
        [(1, "q", "a"), (2, "q", "gardener"), (3, "q", "gardener"), (3, "r", "a")],
        "respondent_id long, question_id string, option_id string",
    )
    options = spark.createDataFrame([("q", "a"), ("r", "b")], "question_id string, option_id string")
    pooled = tally.distribution(clean.pool_writeins(answers, options))
    assert rows(pooled, "question_id", "option_id", "n", "d") == {("q", "a", 1, 3), ("q", "Other", 2, 3), ("r", "Other", 1, 1)}
    kept = tally.distribution(clean.pool_writeins(answers, options, keep=True))
    assert rows(kept, "question_id", "option_id", "n") == {("q", "a", 1), ("q", "gardener", 2), ("r", "a", 1)}


def test_collapsed_options_count_a_person_once(spark):
    answers = spark.createDataFrame(
        [(1, "q", "keelung"), (1, "q", "hsinchu"), (2, "q", "taipei")], "respondent_id long, question_id string, option_id string"
    )
    answers = answers.unionByName(spark.createDataFrame([(1, "r", "keelung"), (2, "r", None)], answers.schema))
    mapping = spark.createDataFrame([("q", "keelung", "other north"), ("q", "hsinchu", "other north")], "question_id string, option_id string, group_id string")
    collapsed = rows(tally.distribution(clean.collapse(answers, mapping)), "question_id", "option_id", "n", "d")
    assert collapsed == {("q", "other north", 1, 2), ("q", "taipei", 1, 2), ("r", "keelung", 1, 1)}


def test_depth_ignores_the_escape_option(spark):
    answers = spark.createDataFrame(
        [(1, "q", "follow"), (1, "q", "start"), (2, "q", "none fits"), (3, "q", "none fits"), (3, "q", "follow"), (4, "q", None), (5, "r", "start")],
        "respondent_id long, question_id string, option_id string",
    )
    options = spark.createDataFrame(
        [("follow", 1, False), ("start", 5, False), ("none fits", 6, True)], "option_id string, ord int, is_escape boolean"
    )
    depths = segments.depth_index(answers, "q", options)
    assert rows(depths, "respondent_id", "depth") == {(1, 5), (2, None), (3, 1)}
    people = spark.createDataFrame([(1, "s"), (2, "s"), (3, "s")], "respondent_id long, segment string")
    assert rows(segments.mean_depth(depths, people), "d", "answered", "mean_depth") == {(2, 3, 3.0)}


def test_recency_limits(spark):
    people = spark.createDataFrame([(i,) for i in range(6)], "respondent_id long")
    days = [(1, "2026-06-30"), (2, "2026-06-29"), (3, "2026-01-30"), (4, "2025-07-29"), (5, "2026-08-01")]
    contacts = spark.createDataFrame(days, "respondent_id long, day string")
    banded = segments.recency_band(people, contacts, "day", dt.date(2026, 7, 30))
    assert rows(banded, "respondent_id", "recency") == {
        (0, "never"), (1, "within 1 month"), (2, "1 to 6 months"), (3, "1 to 6 months"), (4, "over 12 months"), (5, "never"),
    }


def test_wide_responses_become_long_answers(spark):
    wide = spark.createDataFrame(
        [(1, "x", "a; b;a", 4, "some text"), (2, None, "", None, "  "), (3, "", None, 1, None)],
        "id long, job string, roles string, trouble int, story string",
    )
    long = clean.long_answers(wide, "id", single=["job"], multi=["roles"], ratings=["trouble"], texts=["story"])
    assert rows(long, "respondent_id", "question_id", "option_id", "value", "text") == {
        (1, "job", "x", None, None),
        (1, "roles", "a", None, None),
        (1, "roles", "b", None, None),
        (1, "trouble", None, 4, None),
        (1, "story", None, None, "some text"),
        (3, "trouble", None, 1, None),
    }
