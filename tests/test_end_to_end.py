"""From a CSV of wide responses to figures in two languages and an audited report."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyframe.model import dimension
from surveyframe.operators import audit, clean, labels, order, segments, tally
from surveyframe.sources import readers, writers
from tests.conftest import rows

SEGMENTS = ["never", "aware", "done"]
TOPICS = ["cases", "pitching", "government"]
RESPONSES = """id,submitted,contact,project,topics,story
1,2026-07-01,no,no,cases; pitching,
2,2026-07-02,yes,no,government,no time
3,2026-07-03,yes,yes,cases;government,mentor helped
4,2026-07-20,yes,yes,cases,write me at a@b.org
5,2026-07-21,yes,yes,cases,too late
6,2026-07-04,yes,no,,
7,2026-07-05,no,no,cases;cases,
"""
FIGURE = (
    "figure_id string, type string, layerDenoms map<string,bigint>,"
    "options array<struct<ord:bigint,label:string,byLayer:map<string,struct<n:bigint,d:bigint,pct:double>>>>"
)


def test_the_whole_way(spark, tmp_path):
    (tmp_path / "responses.csv").write_text(RESPONSES, encoding="utf-8")
    schema = T.StructType.fromDDL("id bigint, submitted timestamp_ntz, contact string, project string, topics string, story string")
    responses = clean.valid_sample(
        readers.read_responses(spark, str(tmp_path / "responses.csv"), schema), "submitted", dt.datetime(2026, 7, 21)
    )
    responses = clean.redact_identifiers(responses, text=["story"])
    answers = clean.long_answers(responses, "id", single=["contact", "project"], multi=["topics"], texts=["story"])
    writers.write_answers(answers, str(tmp_path / "answers"))
    answers = spark.read.schema(answers.schema).parquet(str(tmp_path / "answers"))

    yes = F.col("option_id") == "yes"
    people = segments.assign_layer(
        responses.select(F.col("id").alias("respondent_id")),
        answers,
        [("aware", (F.col("question_id") == "contact") & yes), ("done", (F.col("question_id") == "project") & yes)],
        "never",
    )
    assert rows(tally.sample_meta(people, SEGMENTS), "n_total", "n_never", "n_aware", "n_done") == {(6, 2, 2, 2)}
    assert rows(answers.filter("question_id = 'story'"), "text") == {("no time",), ("mentor helped",), ("write me at [email]",)}

    table = tally.crosstab(answers, people, "topics", TOPICS, SEGMENTS)
    assert rows(table, "segment", "option_id", "n", "d") == {
        ("never", "cases", 2, 2), ("never", "pitching", 1, 2), ("never", "government", 0, 2),
        ("aware", "cases", 0, 1), ("aware", "pitching", 0, 1), ("aware", "government", 1, 1),
        ("done", "cases", 2, 2), ("done", "pitching", 0, 2), ("done", "government", 1, 2),
    }
    ranked = order.order_by_total(table)
    assert rows(ranked, "option_id", "position") == {("cases", 1), ("government", 2), ("pitching", 3)}

    figures = ranked.withColumn("ord", F.col("position").cast("bigint")).withColumns(
        {"figure_id": F.lit("fig_topics"), "type": F.lit("grouped-hbar-layers")}
    )
    words = dimension(spark, lang=["zh", "zh"], source=["cases", "pitching"], target=["實例", "提案"])
    flat = {}
    for lang, cells in {"en": figures, "zh": labels.translate(figures, words, "zh", ["option_id"])}.items():
        path = str(tmp_path / f"figures_{lang}")
        writers.write_catalogue(writers.nest_segment_cells(cells, ["figure_id", "type"]), path, assign="window.FIGDATA")
        back = readers.read_catalogue(spark, path, T.StructType.fromDDL(FIGURE))
        assert back.first().layerDenoms == {"never": 2, "aware": 1, "done": 2}
        flat[lang] = writers.flatten_figure(back, "grouped-hbar-layers", SEGMENTS)
    assert rows(flat["zh"], "label") == {("實例",), ("government",), ("提案",)}
    assert tally.parity(flat["en"].drop("label"), flat["zh"].drop("label")).count() == 0

    report = dimension(spark, doc_id=[1], text=["Of those who never took part, 100% (2/2) chose cases and 51% (1/2) pitching; 100% (1/1)."])
    claims = audit.check_claims(audit.match_claims(audit.extract_claims(report), table))
    assert rows(claims, "claim", "ok", "n_sources") == {
        ("100% (2/2)", True, 2), ("51% (1/2)", False, 2), ("100% (1/1)", True, 1),
    }
