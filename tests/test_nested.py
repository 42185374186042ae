"""Indented catalogues by many tasks, against reading each file as one document."""

import json
import random

import pytest

from surveyframe.model import CATALOGUE_SCHEMA
from surveyframe.sources import nested, readers


def items(df):
    return sorted((r.figure_key, r.figure_id, r.type, str(r["items"])) for r in df.collect())


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def catalogue(n, seed=1):
    draw = random.Random(seed)
    odd = ["plain", 'a "quoted" }', "{[", "back\\slash\\", "// no comment", "line\nbreak", "展開 }{", "ends with \\\""]
    figures = {
        f"fig {i} {draw.choice(odd)}": {"figure_id": f"f{i}", "type": draw.choice(["hbar", "donut"]), "items": [{"ord": k, "label": draw.choice(odd), "n": k, "d": 9} for k in range(draw.randrange(4))]}
        for i in range(n)
    }
    return {"meta": {"n": 1, "note": "{"}, "palette": {"a": {"b": 1}}, "figures": figures, "tables": {"figures": {"x": {"figure_id": "no"}}}}


def script(document, indent=1):
    return "// made by hand {{\nwindow.D = " + json.dumps(document, indent=indent, ensure_ascii=False) + ";\n"


def test_many_tasks_read_what_one_reads(spark, tmp_path, small_splits):
    for k, n in enumerate((60, 1, 0)):
        (tmp_path / f"{k}.js").write_text(script(catalogue(n, k), indent=k + 1), encoding="utf-8")
    assert spark.read.text(str(tmp_path / "0.js")).rdd.getNumPartitions() > 5
    got = items(nested.read_split_catalogue(spark, str(tmp_path), CATALOGUE_SCHEMA))
    want = items(readers.read_catalogue(spark, str(tmp_path / "0.js"), CATALOGUE_SCHEMA, whole=True)) + items(
        readers.read_catalogue(spark, str(tmp_path / "1.js"), CATALOGUE_SCHEMA, whole=True)
    )
    assert len(got) == 61 and got == sorted(want)


def test_several_documents_in_a_file_and_none(spark, tmp_path, small_splits):
    (tmp_path / "two.js").write_text(script(catalogue(3)) + "\n" + script(catalogue(5)))
    (tmp_path / "no.js").write_text("\n\n")
    (tmp_path / "other.js").write_text('window.D = {\n "meta": {\n  "a": 1\n }\n};\n')
    assert nested.read_split_catalogue(spark, str(tmp_path), CATALOGUE_SCHEMA).count() == 8
    assert nested.read_split_catalogue(spark, str(tmp_path / "two.js"), CATALOGUE_SCHEMA, "absent").count() == 0


@pytest.mark.parametrize(
    "text",
    [
        'window.D = {\n "figures": {"a": {\n  "figure_id": "x"\n }}\n};',  # first record on the field's line
        'window.D = {\n "figures": {\n  "a": {\n  "figure_id": "x" }}\n};',  # ends record and field at once
        'window.D = {\n "figures": {\n  "a": {"figure_id": "x"}\n }, "tables": {\n  "b": {}\n }\n};',  # opens another field
        'window.D = {\n "figures": {\n  "a": {"figure_id": x}\n }\n};',  # no JSON
    ],
)
def test_what_cannot_be_cut_is_an_error(spark, tmp_path, text):
    (tmp_path / "bad.js").write_text(text)
    with pytest.raises(Exception, match="(?i)pretty-printed|malformed"):
        nested.read_split_catalogue(spark, str(tmp_path), CATALOGUE_SCHEMA).collect()


def test_records_that_share_lines(spark, tmp_path):
    (tmp_path / "x.js").write_text('window.D = {\n "figures": {\n  "a": {"figure_id": "1"}, "b": {"figure_id": "2"},\n  "c": {\n   "figure_id": "3"}, "d": {\n   "figure_id": "4"\n  }\n }\n};')
    assert {r.figure_id for r in nested.read_split_catalogue(spark, str(tmp_path), CATALOGUE_SCHEMA).collect()} == {"1", "2", "3", "4"}
