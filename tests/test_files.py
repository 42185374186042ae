"""Files in and out: catalogues, result folders, report text, and the six figure shapes."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyframe.model import CATALOGUE_SCHEMA, RESULT_SCHEMA, FIGURE_TYPES
from surveyframe.operators import audit, labels, tally
from surveyframe.session import scratch_path
from surveyframe.sources import readers, writers
from tests.conftest import rows

ITEM = "struct<label:string,n:bigint,d:bigint,pct:double,n3plus:bigint,pct3plus:double,n4plus:bigint,pct4plus:double," \
       "num:string,fullLabel:string,si:double,dsi:double,quadrant:string,groupPct:double,basePct:double,diffPts:double>"
FIGURE = (
    f"type string, items array<{ITEM}>, panels array<struct<`group`:string,layer:string,items:array<{ITEM}>>>,"
    "options array<struct<label:string,byLayer:map<string,struct<n:bigint,d:bigint,pct:double>>>>"
)
FIGURES = {
    "f1": {"type": "donut", "items": [{"label": "a", "n": 1, "d": 2, "pct": 0.5}, {"label": "b", "n": 1, "d": 2, "pct": 0.5}]},
    "f2": {"type": "stacked-hbar", "items": [{"label": "a", "n3plus": 2, "pct3plus": 0.4, "n4plus": 1, "pct4plus": 0.2, "d": 5}]},
    "f3": {"type": "scatter-kano", "items": [{"num": "①", "fullLabel": "x", "si": 0.6, "dsi": -0.2, "quadrant": "Attractive (A)"}]},
    "f4": {"type": "scatter-kano-panels", "panels": [
        {"layer": "s1", "items": [{"num": "①", "fullLabel": "x", "si": 0.6, "dsi": -0.2, "quadrant": "Attractive (A)"}]},
        {"layer": "s2", "items": [{"num": "①", "fullLabel": "x", "si": 0.4, "dsi": -0.2, "quadrant": "Indifferent (I)"}]}]},
    "f5": {"type": "diverging", "panels": [{"group": "g", "items": [{"label": "a", "groupPct": 0.5, "basePct": 0.4, "diffPts": 10.0}]}]},
    "f6": {"type": "grouped-hbar-layers", "options": [
        {"label": "a", "byLayer": {"s2": {"n": 1, "d": 4, "pct": 0.25}, "s1": {"n": 0, "d": 3, "pct": 0.0}}},
        {"label": "b", "byLayer": {"s2": {"n": 2, "d": 4, "pct": 0.5}}}]},
}


@pytest.fixture(scope="module")
def figures(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("catalogue")
    body = json.dumps({"meta": {"n_total": 2}, "figures": FIGURES}, ensure_ascii=False, indent=2)
    (path / "figures.js").write_text(f"// generated\nwindow.DATA = {body};\n", encoding="utf-8")
    read = readers.read_catalogue(spark, str(path), T.StructType.fromDDL(FIGURE), whole=True)
    return read.withColumnRenamed("figure_key", "figure_id")


def test_pretty_printed_catalogue_is_one_document(figures):
    assert rows(figures, "figure_id", "type") == {(k, f["type"]) for k, f in FIGURES.items()}
    assert {f["type"] for f in FIGURES.values()} < set(FIGURE_TYPES)


def test_the_six_shapes(figures):
    assert rows(writers.flatten_figure(figures, "donut"), "pos", "label", "n", "d") == {(1, "a", 1, 2), (2, "b", 1, 2)}
    assert rows(writers.flatten_figure(figures, "stacked-hbar"), "label", "n3plus", "n4plus", "d") == {("a", 2, 1, 5)}
    assert rows(writers.flatten_figure(figures, "scatter-kano"), "num", "si", "quadrant") == {("①", 0.6, "Attractive (A)")}
    panels = writers.flatten_figure(figures, "scatter-kano-panels")
    assert rows(panels, "panel_pos", "layer", "si") == {(1, "s1", 0.6), (2, "s2", 0.4)}
    assert rows(writers.flatten_figure(figures, "diverging"), "group", "label", "diffPts") == {("g", "a", 10.0)}
    cells = writers.flatten_figure(figures, "grouped-hbar-layers", ["s1", "s2"])
    assert rows(cells, "label", "segment", "n", "d") == {("a", "s1", 0, 3), ("a", "s2", 1, 4), ("b", "s2", 2, 4)}
    with pytest.raises(ValueError, match="unknown figure type"):
        writers.flatten_figure(figures, "pie")


def test_missing_and_unknown_figures(spark, figures):
    refs = spark.createDataFrame([("f1",), ("f5",), ("f9",)], "figure_id string")
    gaps = audit.missing_refs(refs, figures, ["donut"])
    assert rows(gaps, "figure_id", "problem") == {("f5", "unknown type"), ("f9", "no data")}


def test_long_figures_number_all_their_items(spark):
    cells = spark.range(1, 2_501).select(
        F.lit('fig "one"').alias("figure_id"), F.lit("hbar").alias("type"), F.col("id").alias("ord"),
        F.concat(F.lit("o"), "id").alias("label"), F.lit(1).cast("bigint").alias("n"), F.lit(2).cast("bigint").alias("d"), F.lit(0.5).alias("pct"),
    )
    records = writers.nest_items(cells, ["figure_id", "type"], ["label", "n", "d", "pct"])
    assert rows(writers.flatten_figure(records, "hbar"), "pos", "label") == {(i, f"o{i}") for i in range(1, 2_501)}


def test_a_script_of_many_lines_is_one_catalogue(spark, tmp_path):
    cells = spark.createDataFrame([(f"f{i}", "hbar", 1, "a", 1, 2, 0.5) for i in range(3)], "figure_id string, type string, ord long, label string, n long, d long, pct double")
    writers.write_catalogue(writers.nest_items(cells, ["figure_id", "type"], ["label", "n", "d", "pct"]), str(tmp_path / "js"), assign="window.F")
    lines = [x.value for x in spark.read.text(str(tmp_path / "js")).collect()]
    assert all(x.startswith("window.F = window.F || {}; (window.F.figures = window.F.figures || {})[") for x in lines) and len(lines) == 3
    back = readers.read_catalogue(spark, str(tmp_path / "js"), CATALOGUE_SCHEMA)
    assert rows(back, "figure_key") == {("f0",), ("f1",), ("f2",)}
    (tmp_path / "bad.js").write_text(lines[0] + "\n// a comment\n\n" + lines[1][:-2] + "\n")
    with pytest.raises(Exception, match="not a figure assignment"):
        readers.read_catalogue(spark, str(tmp_path / "bad.js"), CATALOGUE_SCHEMA).collect()


def test_header_and_side_tables(spark, tmp_path):
    (tmp_path / "data.js").write_text('window.D = {"meta": {"n_total": 127}, "tables": {"a": [{"label": "x", "n": 1}, {"label": "y", "n": 2}]}};')
    path = str(tmp_path / "data.js")
    assert rows(readers.read_tables(spark, path, T.StructType.fromDDL("n_total int"), "meta"), "n_total") == {(127,)}
    assert rows(readers.read_tables(spark, path, T.StructType.fromDDL("label string, n int"), "tables.a"), "label", "n") == {("x", 1), ("y", 2)}


def test_results_with_other_columns_or_bad_cells_are_errors(spark, tmp_path):
    (tmp_path / "t").mkdir()
    names = [f.name for f in RESULT_SCHEMA]
    good = {"question_id": "q", "option_id": "a", "n": "40", "d": "127", "pct": "0.3"}
    line = lambda cols, cells: ",".join(cells.get(c, "x") for c in cols)
    swapped = [{"n": "d", "d": "n"}.get(c, c) for c in names]
    for cols, cells in ((swapped, good), (names, good | {"n": "forty"})):
        (tmp_path / "t" / "one.csv").write_text(",".join(cols) + "\n" + line(cols, cells) + "\n")
        with pytest.raises(Exception, match="(?i)header|malformed|column"):
            readers.read_results(spark, str(tmp_path / "t")).collect()


def test_assignments_round_trip_with_awkward_names(spark, tmp_path):
    cells = spark.createDataFrame([('fig "one" {x}', "hbar", 1, "a", 1, 2, 0.5)], "figure_id string, type string, ord long, label string, n long, d long, pct double")
    records = writers.nest_items(cells, ["figure_id", "type"], ["label", "n", "d", "pct"])
    writers.write_catalogue(records, str(tmp_path / "js"), assign="window.F")
    back = readers.read_catalogue(spark, str(tmp_path / "js"), CATALOGUE_SCHEMA)
    assert rows(back, "figure_key", "figure_id", "type") == {('fig "one" {x}', 'fig "one" {x}', "hbar")}


def test_result_folder_with_caution_columns(spark, tmp_path):
    cells = spark.createDataFrame(
        [("q", "a", 40, 127, 40 / 127), ("q", "b", 10, 47, 10 / 47), ("q", "c, \"quoted\"", 3, 10, 0.3)],
        "question_id string, option_id string, n long, d long, pct double",
    )
    writers.write_result(cells, str(tmp_path / "one"))
    writers.write_result(cells.limit(1), str(tmp_path / "two"))
    back = readers.read_results(spark, str(tmp_path / "*"))
    assert rows(back.filter("table_name = 'one'"), "option_id", "n", "d", "reliability") == {
        ("a", 40, 127, "high"), ("b", 10, 47, "medium"), ("c, \"quoted\"", 3, 10, "low"),
    }
    assert rows(back.groupBy("table_name").count(), "table_name", "count") == {("one", 3), ("two", 1)}


def test_report_files_are_numbered_by_paragraph(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title\n\nFirst 38%.\n  \nSecond.\n", encoding="utf-8")
    (tmp_path / "b.md").write_text("Only", encoding="utf-8")
    got = readers.read_paragraphs(spark, str(tmp_path))
    assert rows(got, "doc", "para_no", "text") == {
        ("a.md", 1, "# Title"), ("a.md", 2, "First 38%."), ("a.md", 3, "Second."), ("b.md", 1, "Only"),
    }


def test_overlay_replaces_whole_rows(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "B", None), (3, "c", "z")], "k int, v string, w string")
    assert rows(labels.overlay(base, new, ["k"]), "k", "v", "w") == {(1, "a", "x"), (2, "B", None), (3, "c", "z")}


def test_labels_fall_back_to_the_key(spark):
    df = spark.createDataFrame([("never",), ("done",)], "segment string")
    names = spark.createDataFrame([("never", "The Curious")], "key string, label string")
    assert rows(labels.with_label(df, names, "segment"), "segment", "label") == {("never", "The Curious"), ("done", "done")}


def test_answers_with_line_breaks(spark, tmp_path):
    (tmp_path / "r.csv").write_text('id,answer\n1,"first\nsecond"\n2,"a ""b"""\n', encoding="utf-8")
    schema = T.StructType.fromDDL("id int, answer string")
    got = readers.read_responses(spark, str(tmp_path / "r.csv"), schema, multiline=True)
    assert [r.id for r in got.orderBy("id").collect()] == [1, 2]
    assert got.filter("id = 1").first().answer == "first\nsecond"
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_responses(spark, str(tmp_path / "r.csv"), T.StructType.fromDDL("id int, other string")).collect()


def test_answers_are_stored_by_question_and_pruned(spark, tmp_path):
    answers = spark.range(1000).select(
        F.col("id").alias("respondent_id"), F.concat(F.lit("q"), F.col("id") % 3).alias("question_id"), F.lit("a").alias("option_id")
    )
    writers.write_answers(answers, str(tmp_path / "a"))
    back = spark.read.schema(answers.schema).parquet(str(tmp_path / "a"))
    cells = tally.multi_distribution(back, "q0", ["a"])
    assert rows(cells, "n", "d") == {(334, 334)}
    assert "PartitionFilters: [isnotnull(question_id" in cells._jdf.queryExecution().executedPlan().toString()


def test_scratch_folder_comes_from_the_session():
    class Session:
        def __init__(self, folder, master):
            named = {"spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": "file:/warehouse"}
            self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: named[key])})
            self.sparkContext = type("Context", (), {"master": master})

    assert scratch_path(Session("hdfs://shared/x/", "yarn"), "t").startswith("hdfs://shared/x/surveyframe/t-")
    assert scratch_path(Session(None, "local[2]"), "t").startswith("file:/warehouse/surveyframe/t-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(Session(None, "yarn"), "t")
