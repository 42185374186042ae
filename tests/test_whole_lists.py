"""Open lists, codebooks of any size, traced percentages, and faults that the tables do not show."""

import random

import pytest
from pyspark.sql import functions as F

from surveyframe.operators import audit, order, tally, themes
from surveyframe.sources import readers
from tests.conftest import rows
from tests.test_scale import plan_of


def test_long_lists_are_ordered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(order, "BLOCK_ROWS", 50)
    rng = random.Random(2)
    cells = [("long", f"o{k}", rng.randint(0, 9)) for k in range(400)] + [("short", "a", 3), ("short", "b", 3), ("none", "c", 0)]
    got = order.order_open_options(spark.createDataFrame(cells, "question_id string, option_id string, n long"))
    want = set()
    for q in ("long", "short", "none"):
        own = sorted((c for c in cells if c[0] == q), key=lambda c: (-c[2], c[1]))
        total, at = sum(c[2] for c in own), 0
        for k, (_, o, n) in enumerate(own):
            want.add((q, o, n, k + 1, at / total if total else None, (at + n) / total if total else None))
            at += n
    assert rows(got, "question_id", "option_id", "n", "position", "start_share", "end_share") == want
    windows = plan_of(got).split("Window [")[1:]
    assert windows and all("_block" in w.split("\n")[0] for w in windows)


def test_distribution_holds_no_set_of_a_person(spark):
    wide = spark.range(20_000).select(F.lit(1).alias("respondent_id"), F.lit("q").alias("question_id"), (F.col("id") % 9_000).cast("string").alias("option_id"))
    few = spark.createDataFrame([(2, "q", "7"), (2, "q", "7"), (3, "q", None), (4, "r", "7")], "respondent_id int, question_id string, option_id string")
    got = tally.distribution(wide.unionByName(few))
    assert "collect_set" not in plan_of(got) and "collect_list" not in plan_of(got)
    assert got.filter("question_id = 'q'").count() == 9_000
    assert rows(got.filter("option_id = '7'"), "question_id", "n", "d") == {("q", 2, 2), ("r", 1, 1)}


@pytest.mark.parametrize("multi", [True, False])
def test_index_gives_what_trying_every_keyword_gives(spark, multi):
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("abcdeÄé ") for _ in range(n))
    book = [(f"t{k}", [w for w in (some(rng.choice([1, 2, 3, 4, 5, 9])) for _ in range(2)) if w.strip()] or ["zz"]) for k in range(40)]
    texts = [(k, some(rng.randint(1, 40)).upper() if k % 3 else some(400)) for k in range(60)] + [(60, None), (61, "  "), (62, "%%%"), (62, "%%%")]
    df = spark.createDataFrame(texts, "respondent_id long, text string")
    words = spark.createDataFrame([(t, k, w) for k, (t, ws) in enumerate(book) for w in [*ws, "", None]], "theme string, ord int, word string")
    want = []
    for i, text in texts:
        if (text or "").strip(" "):
            hits = [t for t, ws in book if any(w.lower() in text.lower() for w in ws)]
            want += [(i, t) for t in (hits if multi else hits[:1]) or [themes.UNCODED]]
    got = [(r.respondent_id, r.theme) for r in themes.code_by_index(df, words, multi).collect()]
    assert sorted(got) == sorted(want)
    assert themes.code_by_index(df, words.limit(0)).select("theme").distinct().collect() == [(themes.UNCODED,)]


def test_a_codebook_of_thousands_runs_without_python(spark):
    words = spark.range(20_000).select(F.concat(F.lit("t"), F.col("id") % 50).alias("theme"), (F.col("id") % 50).alias("ord"), F.concat(F.lit("key"), F.col("id")).alias("word"))
    texts = spark.createDataFrame([(1, "Key19999 and nothing"), (2, "key77"), (3, "ke y7")], "respondent_id long, text string")
    coded = themes.code_by_index(texts, words)
    assert rows(coded, "respondent_id", "theme") == {(1, "t1"), (1, "t19"), (1, "t49"), (2, "t7"), (2, "t27"), (3, themes.UNCODED)}
    plan = plan_of(coded)
    assert not any(step in plan for step in ("Python", "NestedLoop", "Cartesian"))


def test_percentages_without_fractions_are_traced(spark):
    pages = [(1, "<p>38% and 38.3% and 12,3%</p>"), (1, "<p>38％</p>"), (2, "50.0000000%"), (2, "-50% of 050%"), (3, None), (4, "0% 100% 0.5%")]
    results = [("a", "x", 18, 47), ("a", "y", 36, 94), ("b", "x", 1, 2), ("b", "y", 0, 9), ("b", "z", 1, 200), ("c", "x", 5, 0), ("c", "y", None, 3), ("c", "z", 9, 9)]
    traced = audit.trace_percents(
        spark.createDataFrame(pages, "page_id int, html string"), spark.createDataFrame(results, "question_id string, option_id string, n long, d long")
    )
    assert rows(traced, "page_id", "printed", "times", "n_sources", "n_shares", "source") == {
        (1, "38%", 2, 2, 2, "a | x"), (1, "38.3%", 1, 2, 2, "a | x"), (2, "50.0000000%", 1, 0, 0, None), (2, "50%", 1, 1, 1, "b | x"),
        (2, "050%", 1, 1, 1, "b | x"), (4, "0%", 1, 1, 1, "b | y"), (4, "100%", 1, 1, 1, "c | z"), (4, "0.5%", 1, 1, 1, "b | z"),
    }
    assert not any(step in plan_of(traced) for step in ("Python", "NestedLoop", "Cartesian"))


def test_signs_groups_and_full_width_colons(spark):
    texts = spark.createDataFrame([(1, "fell −5% (1/20), was 3-5% (1/20) and -1.5% (3/200)")], "doc_id int, text string")
    claims = audit.check_claims(audit.extract_claims(texts))
    assert rows(claims, "pos", "pct", "decimals", "ok") == {(1, -5.0, 0, False), (2, 5.0, 0, True), (3, -1.5, 1, False)}
    notes = spark.createDataFrame([(1, "Users: 1,270, others：47; all: 12")], "question_id int, note string")
    assert rows(audit.stated_bases(notes), "label", "stated_d") == {("Users", 1270), ("others", 47), ("all", 12)}


def test_a_lone_cell_beside_empty_ones_hides_its_base(spark):
    cells = [("x", "a", 3, 3), ("x", "b", 0, 3), ("y", "a", 3, 12), ("y", "b", 9, 12)]
    df = spark.createDataFrame(cells, "q string, o string, n long, d long").withColumn("pct", F.col("n") / F.col("d"))
    got = audit.suppress(df, 5, within=["q"], order=["o"])
    assert rows(got, "q", "o", "n", "d", "suppressed") == {("x", "a", None, None, True), ("x", "b", 0, None, False), ("y", "a", None, 12, True), ("y", "b", None, 12, True)}


def test_a_cell_of_another_type_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("respondent_id,age\n1,30\n2,zz\n")
    from pyspark.sql import types as T

    schema = T.StructType().add("respondent_id", T.IntegerType()).add("age", T.IntegerType())
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        readers.read_responses(spark, str(tmp_path / "a.csv"), schema).collect()


def test_keywords_that_begin_alike_meet_only_texts_that_hold_them(spark, monkeypatch):
    words = spark.range(3_000).select(F.format_string("t%d", "id").alias("theme"), F.col("id").cast("int").alias("ord"), F.format_string("all of them begin alike %05d", "id").alias("word"))
    texts = [(k, ("x" * k + "All of them begin alike and end %d " % k) * 40 + "all of them begin alike %05d" % k) for k in range(30)] + [(99, "𝄞é" * 70 + "ALL OF THEM BEGIN ALIKE 00001")]
    tables, settled = {}, themes.settled
    monkeypatch.setattr(themes, "settled", lambda df, name: tables.setdefault(name, settled(df, name)))
    read, read_at = [], themes._read_at
    monkeypatch.setattr(themes, "_read_at", lambda text, spots: read.append(spots) or read_at(text, spots))
    coded = themes.code_by_index(spark.createDataFrame(texts, "respondent_id long, text string"), words)
    assert rows(coded, "respondent_id", "theme") == {(k, f"t{k}") for k in range(30)} | {(99, "t1")}
    # strings that are looked up follow the texts, not texts times keywords (3,000 keywords share what 31 texts hold)
    assert read and tables["spots"].agg(F.sum(F.size("_spots"))).first()[0] < sum(len(t) for _, t in texts)
