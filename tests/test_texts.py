"""Claims, pages, translations, themes and redaction on small known texts."""

import pytest
from pyspark.sql import functions as F

from surveyframe.operators import audit, clean, themes
from surveyframe.sources.readers import paragraphs
from tests.conftest import rows


def report(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id int, text string")


def test_claims_in_both_bracket_styles(spark):
    claims = audit.extract_claims(report(spark, "About 38% (18/47) and 12.8%（6 / 47）, but 5% alone is none.", "nothing"))
    assert rows(claims, "doc_id", "pos", "pct", "decimals", "n", "d") == {(1, 1, 38.0, 0, 18, 47), (1, 2, 12.8, 1, 6, 47)}


def test_wrong_claims_are_listed_or_stop_the_job(spark):
    claims = audit.extract_claims(report(spark, "38% (18/47)", "39% (18/47)", "38.3% (18/47)", "38.4% (18/47)", "1% (1/0)"))
    wrong = audit.check_claims(claims).filter(~F.col("ok"))
    assert rows(wrong, "claim") == {("39% (18/47)",), ("38.4% (18/47)",), ("1% (1/0)",)}
    with pytest.raises(Exception, match="claim does not add up"):
        audit.check_claims(claims, fail=True).collect()
    good = audit.extract_claims(report(spark, "38% (18/47)"))
    assert audit.check_claims(good, fail=True).count() == 1


def test_claims_with_numbers_beyond_bigint_are_wrong_not_fatal(spark):
    claims = audit.extract_claims(report(spark, "1% (99999999999999999999/47)"))
    assert rows(audit.check_claims(claims), "n", "ok") == {(None, False)}


def test_each_claim_keeps_one_row_however_many_sources(spark):
    results = spark.createDataFrame(
        [("q1", "a", 18, 47), ("q2", "b", 18, 47), ("q3", "c", 6, 47)], "question_id string, option_id string, n long, d long"
    )
    claims = audit.extract_claims(report(spark, "38% (18/47)", "13% (6/47)", "2% (1/47)"))
    asked = spark.createDataFrame([("q1", "47 builders")], "question_id string, base_rule string")
    audited = audit.source_audit(claims, results, asked)
    assert rows(audited, "doc_id", "n_sources", "source", "base_rule", "status") == {
        (1, 2, "q1 | a", "47 builders", "ambiguous"),
        (2, 1, "q3 | c", None, "matched"),
        (3, 0, None, None, "unmatched"),
    }


def test_page_numbers_without_source(spark):
    pages = spark.createDataFrame(
        [(1, "<style>p{width:77%}</style><p>38<b>%</b> 38% and 38.3%<!-- 55% --></p>"), (2, "<p>39% 39%</p><script>x='66%'</script>")],
        "page_id int, html string",
    )
    results = spark.createDataFrame([(1, "q", "a", 18, 47), (3, "q", "a", 39, 100)], "page_id int, question_id string, option_id string, n long, d long")
    assert rows(audit.check_pages(pages, results), "page_id", "printed", "times") == {(2, "39%", 2)}


def test_translated_paragraphs_with_other_numbers(spark):
    zh = paragraphs(report(spark, "共 127 人，47 人做過\n\n沒有數字\n佔 38.3%"))
    en = paragraphs(report(spark, "47 of 127 people\r\nno numbers\r\n38.4% of them\n12 more"))
    assert rows(audit.translation_check(zh, en), "para_no", "numbers_source", "numbers_target") == {
        (3, "38.3", "38.4"),
        (4, "", "12"),
    }


CODEBOOK = (("help", ["Helped", "mentor"]), ("docs", r"(?i)\bdocs?\b"))


def test_theme_tallies_over_those_who_answered(spark):
    texts = spark.createDataFrame(
        [(1, "A MENTOR wrote docs"), (2, "doc only"), (3, "documents"), (4, "  "), (5, None)], "respondent_id long, text string"
    )
    several = themes.theme_tally(texts, CODEBOOK)
    assert rows(several, "theme", "n", "d") == {("help", 1, 3), ("docs", 2, 3), ("Not specified", 1, 3)}
    single = themes.theme_tally(texts, CODEBOOK, multi=False)
    assert rows(single, "theme", "n", "d") == {("help", 1, 3), ("docs", 1, 3), ("Not specified", 1, 3)}


def test_theme_by_membership_counts_silent_members(spark):
    texts = spark.createDataFrame([(1, "mentor"), (1, "a mentor"), (2, "mentor"), (3, "docs"), (3, "no theme")], "respondent_id long, text string")
    members = spark.createDataFrame(
        [(1, True), (2, False), (3, True), (4, True), (5, False)], "respondent_id long, is_member boolean"
    )
    assert rows(themes.theme_by(texts, members, CODEBOOK), "theme", "n", "d", "n_member", "d_member") == {
        ("help", 2, 3, 1, 3),
        ("docs", 1, 3, 1, 3),
        ("Not specified", 0, 3, 0, 3),
    }


def test_redaction_of_whole_texts(spark):
    long_run = "a" * 200_000
    df = spark.createDataFrame(
        [
            (1, "x", "mail a.b@c.org, or a@b@c.com; call +1 (555) 123-4567."),
            (2, "y", f"{long_run} (no) end@x.yz_tail@q.com"),
            (3, "z", None),
        ],
        "id int, email string, text string",
    )
    clean_df = clean.redact_identifiers(df, drop=["email"], text=["text"])
    assert clean_df.columns == ["id", "text"]
    assert rows(clean_df, "id", "text") == {
        (1, "mail [email], or a@[email]; call [phone]."),
        (2, f"{long_run} (no) [email][email]"),
        (3, None),
    }


def test_long_runs_of_digits_and_spaces_are_read_once(spark):
    run = "7" * 300_000 + " " * 300_000
    claims = audit.extract_claims(report(spark, f"{run}x 5% (1/20) {run}% 1.2.38% (18/47)"))
    assert rows(claims, "claim") == {("5% (1/20)",), ("2.38% (18/47)",)}
