"""Published counts turned into answer rows must give the published shares back."""

import pytest
from pyspark.sql import functions as F

from surveyframe.functions import expressions as fx
from surveyframe.model import dimension
from surveyframe.operators import audit, clean, kano, order, ratings, segments, tally
from tests.conftest import rows


def expand(spark, groups, question="q"):
    """Answer rows from (segment, base, {option: count}); the first ``count`` people of a segment hold an option."""
    answers, people, start = [], [], 0
    for segment, base, counts in groups:
        for i in range(base):
            people.append((start + i, segment))
            answers.append((start + i, question, "(none of these)"))
        for option, n in counts.items():
            answers += [(start + i, question, option) for i in range(n)]
        start += base
    a = spark.createDataFrame(answers, "respondent_id long, question_id string, option_id string")
    return a, spark.createDataFrame(people, "respondent_id long, segment string")


def test_crosstab_keeps_zero_cells_on_own_bases(spark):
    groups = [("never", 26, {"a": 12, "b": 0}), ("aware", 54, {"a": 32, "b": 0}), ("done", 47, {"a": 29, "b": 2})]
    answers, people = expand(spark, groups)
    cells = tally.crosstab(answers, people, "q", ["a", "b"], ["never", "aware", "done"])
    assert rows(cells, "segment", "option_id", "n", "d", "pct") == {
        ("never", "a", 12, 26, 12 / 26),
        ("never", "b", 0, 26, 0.0),
        ("aware", "a", 32, 54, 32 / 54),
        ("aware", "b", 0, 54, 0.0),
        ("done", "a", 29, 47, 29 / 47),
        ("done", "b", 2, 47, 2 / 47),
    }


def test_base_is_those_who_answered(spark):
    answers, people = expand(spark, [("aware", 53, {"a": 31})])
    silent = spark.createDataFrame([(999, "aware"), (1000, "never")], "respondent_id long, segment string")
    everyone = people.unionByName(silent)
    put_to = dimension(spark, question_id=["q", "r"], segment=["aware", "never"])
    assert rows(clean.base_of(answers, everyone, put_to), "question_id", "asked", "d") == {("q", 54, 53), ("r", 1, 0)}
    cells = tally.crosstab(answers, people, "q", ["a"], ["aware", "never"])
    assert rows(cells, "segment", "n", "d", "pct") == {("aware", 31, 53, 31 / 53), ("never", 0, 0, None)}


def test_answers_of_people_never_asked_do_not_count(spark):
    answers, people = expand(spark, [("x", 10, {"a": 10}), ("y", 3, {"a": 3})])
    put_to = dimension(spark, question_id=["q"], segment=["y"])
    assert rows(clean.base_of(answers, people, put_to), "asked", "d") == {(3, 3)}


def test_union_of_two_options_is_people_not_rows(spark):
    picks = [(i, "q", "taipei") for i in range(41)] + [(i, "q", "new taipei") for i in range(40, 79)]
    picks += [(i, "q", "elsewhere") for i in range(79, 127)]
    answers = spark.createDataFrame(picks, "respondent_id long, question_id string, option_id string")
    groups = {"both cities": ["taipei", "new taipei"], "taipei": ["taipei"], "new taipei": ["new taipei"]}
    assert rows(tally.net_reach(answers, "q", groups), "group_id", "n", "d") == {
        ("both cities", 79, 127),
        ("taipei", 41, 127),
        ("new taipei", 39, 127),
    }
    assert tally.union_respondents(answers, [("q", "taipei"), ("q", "new taipei")]).count() == 79


@pytest.mark.parametrize("counts, n3, n4", [((13, 16, 12, 3, 3), 18, 6), ((28, 11, 8, 0, 0), 8, 0), ((33, 11, 3, 0, 0), 3, 0)])
def test_rating_tails(spark, counts, n3, n4):
    scores = [("item", s + 1) for s, n in enumerate(counts) for _ in range(n)]
    df = spark.createDataFrame(scores, "item string, value int")
    assert rows(ratings.rating_counts(df), "c1", "c2", "c3", "c4", "c5", "d") == {(*counts, 47)}
    assert rows(ratings.top_box(df), "n3plus", "pct3plus", "n4plus", "pct4plus", "d") == {(n3, n3 / 47, n4, n4 / 47, 47)}


def test_running_offset_of_a_rating_bar(spark):
    df = spark.createDataFrame([("item", 13, 16, 12, 3, 3, 47)], "item string, c1 long, c2 long, c3 long, c4 long, c5 long, d long")
    assert rows(order.running_offset(df), "score", "start_n") == {(1, 0), (2, 13), (3, 29), (4, 41), (5, 44)}


def test_gaps_against_overall(spark):
    groups = [
        ("30 and under", 10, {"portfolio": 4, "community": 5, "fun": 5}),
        ("31 to 40", 19, {"portfolio": 2, "community": 9, "fun": 8}),
        ("41 and over", 18, {"portfolio": 3, "community": 3, "fun": 2}),
    ]
    answers, people = expand(spark, groups)
    gaps = ratings.gap_vs_overall(answers, people.withColumnRenamed("segment", "age"), "q", ["portfolio", "community", "fun"], "age")
    assert rows(gaps.filter("option_id = 'portfolio'"), "age", "n", "d", "diff_pts") == {
        ("30 and under", 4, 10, 20.85),
        ("31 to 40", 2, 19, -8.62),
        ("41 and over", 3, 18, -2.48),
    }
    assert rows(gaps.filter("age = '41 and over'"), "option_id", "diff_pts") == {
        ("portfolio", -2.48),
        ("community", -19.5),
        ("fun", -20.8),
    }
    assert rows(ratings.gap_direction(gaps, "age"), "age", "n_up", "n_down") == {
        ("30 and under", 3, 0),
        ("31 to 40", 2, 1),
        ("41 and over", 0, 3),
    }


def test_a_tie_with_overall_counts_as_below(spark):
    answers, people = expand(spark, [("x", 10, {"a": 5}), ("y", 10, {"a": 5})])
    gaps = ratings.gap_vs_overall(answers, people, "q", ["a"], "segment")
    assert rows(ratings.gap_direction(gaps, "segment"), "n_up", "n_down") == {(0, 1)}


def pairs_of(spark, **kinds):
    """Answer pairs giving each class the wanted number of times."""
    code = {"A": (1, 3), "O": (1, 5), "M": (3, 5), "I": (3, 3), "R": (5, 1), "Q": (1, 1)}
    data = [("t", *code[k]) for k, n in kinds.items() for _ in range(n)]
    return spark.createDataFrame(data, "topic string, functional int, dysfunctional int")


def test_kano_point_of_25_valid_pairs(spark):
    points = kano.kano_quadrant(kano.kano_coefficients(kano.class_counts(pairs_of(spark, A=9, O=3, M=1, I=12, R=1), ["topic"])))
    assert rows(points, "si", "dsi", "valid", "answered", "quadrant") == {(0.48, -0.16, 25, 26, "Indifferent (I)")}


def test_kano_segments_add_to_the_total(spark):
    # The published first topic: three segments, 24 + 48 + 45 valid pairs.
    shape = {"never": (14, 11, 24), "aware": (33, 14, 48), "done": (23, 12, 45)}
    frames = []
    for segment, (satisfied, dissatisfied, valid) in shape.items():
        o = min(satisfied, dissatisfied) // 2
        kinds = dict(O=o, A=satisfied - o, M=dissatisfied - o, I=valid - satisfied - dissatisfied + o)
        frames.append(pairs_of(spark, **kinds).withColumn("segment", F.lit(segment)))
    points = kano.kano_by(frames[0].unionByName(frames[1]).unionByName(frames[2]), "topic", "segment")
    rounded = points.select("segment", "valid", fx.fixed(F.col("si"), 3).alias("si"), fx.fixed(F.col("dsi"), 3).alias("dsi"), "quadrant")
    assert rows(rounded, "segment", "valid", "si", "dsi", "quadrant") == {
        ("never", 24, 0.583, -0.458, "Attractive (A)"),
        ("aware", 48, 0.688, -0.292, "Attractive (A)"),
        ("done", 45, 0.511, -0.267, "Attractive (A)"),
        ("all", 117, 0.598, -0.316, "Attractive (A)"),
    }


def test_kano_without_valid_pairs_is_null_and_lines_count_as_high(spark):
    empty = kano.kano_quadrant(kano.kano_coefficients(kano.class_counts(pairs_of(spark, R=2, Q=1), ["topic"])))
    assert rows(empty, "si", "dsi", "quadrant") == {(None, None, None)}
    on_line = kano.kano_quadrant(kano.kano_coefficients(kano.class_counts(pairs_of(spark, O=1, I=1), ["topic"])))
    assert rows(on_line, "si", "dsi", "quadrant") == {(0.5, -0.5, "Performance (O)")}


def test_kano_table_covers_all_pairs(spark):
    grid = spark.createDataFrame([(f, d) for f in range(1, 6) for d in range(1, 6)], "f int, d int")
    got = {(r.f, r.d): r.k for r in grid.select("f", "d", kano.kano_class(F.col("f"), F.col("d")).alias("k")).collect()}
    assert got[(1, 5)] == "O" and got[(1, 1)] == "Q" and got[(5, 5)] == "Q"
    assert all(got[(1, d)] == "A" for d in (2, 3, 4)) and all(got[(f, 5)] == "M" for f in (2, 3, 4))
    assert all(got[(f, d)] == "I" for f in (2, 3, 4) for d in (2, 3, 4))
    assert all(got[(f, 1)] == "R" for f in (2, 3, 4, 5)) and all(got[(5, d)] == "R" for d in (1, 2, 3, 4))
    odd = spark.createDataFrame([(0, 3), (6, 1), (None, 2), (3, None)], "f int, d int")
    assert rows(odd.select(kano.kano_class(F.col("f"), F.col("d")).alias("k")), "k") == {(None,)}


def test_nested_base(spark):
    # 38 of 101 made something; 7 of those 38 never used a tool.
    picks = [(i, "q", "make") for i in range(20)] + [(i, "q", "start") for i in range(15, 38)]
    picks += [(i, "q", "use") for i in range(7, 101)]
    answers = spark.createDataFrame(picks, "respondent_id long, question_id string, option_id string")
    nested = tally.nested_share(answers, "q", ["make", "start"], ["use"])
    assert rows(nested, "step", "n", "d") == {(1, 38, 101), (2, 7, 38)}
    made, used = [("q", "make"), ("q", "start")], [("q", "use")]
    assert tally.except_respondents(answers, made, used).count() == 7
    assert tally.intersect_respondents(answers, made, used).count() == 31


def test_cap_breach_is_reported_and_kept(spark):
    # 26 people, two choices allowed, 53 picks: at least one has three.
    picks = [(i, "q", o) for i in range(26) for o in ("a", "b")] + [(0, "q", "c"), (0, "q", "c")]
    answers = spark.createDataFrame(picks, "respondent_id long, question_id string, option_id string")
    caps = dimension(spark, question_id=["q"], max_choices=[2])
    assert rows(clean.cap_violations(answers, caps), "respondent_id", "n_picks") == {(0, 3)}
    assert rows(tally.multi_distribution(answers, "q", ["a", "b", "c"]), "option_id", "n") == {("a", 26), ("b", 26), ("c", 1)}


def test_breaches_show_in_published_tables(spark):
    events = [("never", n, 26) for n in (12, 14, 18, 9, 0)] + [("aware", n, 54) for n in (32, 28, 27, 16, 0)]
    cells = spark.createDataFrame(events, "segment string, n long, d long").withColumn("question_id", F.lit("events"))
    caps = dimension(spark, question_id=["events"], max_choices=[2])
    broken = clean.cap_breaches(cells, caps, ["question_id", "segment"])
    assert rows(broken, "segment", "n_picks", "d") == {("never", 53, 26)}


def test_rows_adding_to_more_than_the_base(spark):
    region = [("region", n, 127) for n in (41, 39, 11, 9, 7, 6, 5, 4, 3, 2, 2)] + [("gender", n, 127) for n in (64, 52, 11)]
    cells = spark.createDataFrame(region, "question_id string, n long, d long")
    assert rows(audit.parts_gaps(cells), "question_id", "n_parts", "d") == {("region", 129, 127)}


def test_caption_base_that_is_not_the_data_base(spark):
    notes = dimension(spark, question_id=["tools", "domains"], note=["The Curious: 26, the Users: 54, the Builders: 47"] * 2)
    data = [("The Curious", 26), ("the Users", 53), ("the Builders", 47)]
    cells = spark.createDataFrame(
        [("tools", s, d) for s, d in data] + [("domains", s, d + (d == 53)) for s, d in data],
        "question_id string, label string, d long",
    )
    wrong = audit.caption_gaps(audit.stated_bases(notes), cells, ["question_id", "label"])
    assert rows(wrong, "question_id", "label", "stated_d", "d") == {("tools", "the Users", 54, 53)}


def test_published_triples(spark):
    triples = [("both cities", 79, 127, 0.622), ("men", 64, 127, 0.5039), ("typo", 52, 127, 0.4194), ("over", 5, 4, 1.25)]
    df = spark.createDataFrame(triples, "label string, n long, d long, pct double")
    assert rows(audit.check_consistency(df, audit.share_rules()), "label", "broken") == {
        ("typo", "share is count over base"),
        ("over", "count within base"),
    }


def test_segments_against_the_total(spark):
    cells = spark.createDataFrame([("a", "x", 1, 10), ("a", "y", 2, 19), ("b", "x", 3, 10), ("b", "y", 3, 19)], "o string, s string, n long, d long")
    total = spark.createDataFrame([("a", 3, 29), ("b", 7, 29), ("c", 1, 29)], "o string, n long, d long")
    assert rows(audit.segment_total_gaps(cells, total, ["o"]), "o", "n", "n_segments") == {("b", 7, 6), ("c", 1, None)}


def test_printed_shares(spark):
    df = spark.createDataFrame([(18, 47), (1, 8), (1, 200), (0, 26), (7, 7)], "n long, d long")
    p = fx.share("n", "d")
    got = df.select(
        fx.whole_percent_text(p).alias("w"), fx.one_decimal_text(p).alias("t"), fx.evidence_text(F.col("n"), F.col("d")).alias("e")
    )
    assert rows(got, "w", "t", "e") == {
        ("38%", "38.3%", "38% (18/47)"),
        ("13%", "12.5%", "13% (1/8)"),
        ("1%", "0.5%", "1% (1/200)"),
        ("0%", "0.0%", "0% (0/26)"),
        ("100%", "100.0%", "100% (7/7)"),
    }


def test_layers_and_ranks(spark):
    people = dimension(spark, respondent_id=[1, 2, 3])
    contacts = spark.createDataFrame([(2, "O"), (3, "O"), (3, "F"), (3, "O")], "respondent_id long, status string")
    rules = [("aware", F.col("status").isNotNull()), ("done", F.col("status") == "F")]
    layered = segments.assign_layer(people, contacts, rules, "never")
    assert rows(layered, "respondent_id", "segment") == {(1, "never"), (2, "aware"), (3, "done")}
    assert rows(tally.sample_meta(layered, ["never", "aware", "done"]), "n_total", "n_never", "n_aware", "n_done") == {(3, 1, 1, 1)}
    cells = spark.createDataFrame([("q", "friends", 51), ("q", "social", 51), ("q", "slack", 29)], "question_id string, option_id string, n long")
    want = {("friends", 1), ("social", 1), ("slack", 3)}
    assert rows(order.rank_options(cells), "option_id", "rank") == want
    assert rows(order.rank_open_options(cells), "option_id", "rank") == want
