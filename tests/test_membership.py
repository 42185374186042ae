"""Set questions from the stored index, against the same questions on the answers."""

import random

import pytest
from pyspark.sql import functions as F

from surveyframe.operators import membership, tally
from tests.conftest import rows

A, B = [("q", "a"), ("1", "a")], [("q", "b")]


@pytest.fixture(scope="module")
def answers(spark):
    draw = random.Random(3)
    # one person and one option hold a third of all rows; ids below zero, at the ends of runs, and missing
    people = [-130, -65, -64, -1, 0, 63, 64, 127, 128, 2**40, None]
    data = [(draw.choice([7, *people, *range(200)]), draw.choice(["q", "1", "other"]), draw.choice(["a", "a", "b", "c", None, " "])) for _ in range(1_500)]
    return spark.createDataFrame(data + [(7, "q", "c")] * 700, "respondent_id long, question_id string, option_id string")


def stored(spark, answers, folder):
    membership.write_index(membership.membership_index(answers), str(folder))
    return membership.read_index(spark, str(folder))


def test_sets_are_those_of_the_answers(spark, answers, tmp_path):
    index = stored(spark, answers, tmp_path / "index")
    members = membership.members_of(index, {"a": A, "b": B, "asked": [("q", membership.ANYTHING)]})
    known = answers.filter("respondent_id is not null")
    want = {
        "either": (membership.either("a", "b"), tally.union_respondents(known, [*A, *B])),
        "both": (membership.both("a", "b"), tally.intersect_respondents(known, A, B)),
        "without": (membership.without("a", "b"), tally.except_respondents(known, A, B)),
        "asked": (F.col("asked"), known.filter("question_id = 'q' and trim(option_id) <> ''").select("respondent_id").distinct()),
        "none of both": (membership.without(membership.both("a", "b"), "a"), known.filter("false").select("respondent_id")),
    }
    counts = rows(membership.count_sets(members, {name: bits for name, (bits, _) in want.items()}), "name", "n")
    for name, (bits, plain) in want.items():
        people = [r.respondent_id for r in membership.list_set(members, bits).collect()]
        assert sorted(people) == sorted(r.respondent_id for r in plain.collect()), name
        assert (name, len(people)) in counts


def test_one_scan_of_the_named_questions(spark, answers, tmp_path):
    index = stored(spark, answers, tmp_path / "index")
    members = membership.members_of(index, {"a": A, "b": B})
    plan = membership.count_sets(members, {"x": membership.both("a", "b"), "y": membership.either("a", "b")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_no_answers_and_ids_that_are_no_integers(spark, answers, tmp_path):
    none = stored(spark, answers.filter("false"), tmp_path / "none")
    members = membership.members_of(none, {"a": A})
    assert rows(membership.count_sets(members, {"a": F.col("a")}), "name", "n") == {("a", 0)}
    assert membership.list_set(members, F.col("a")).count() == 0
    assert membership.members_of(none, {"a": []}).count() == 0
    with pytest.raises(ValueError, match="integers"):
        membership.membership_index(answers.withColumn("respondent_id", F.col("respondent_id").cast("string")))
