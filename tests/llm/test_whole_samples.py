"""What the models learn from: whole texts of the sampled rows."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from surveyframe.llm import quality, toxicity

LONG = " ".join(f"w{i}" for i in range(20_000))


def test_quality_learns_from_all_passages():
    (bag,), _ = quality._sampled([SimpleNamespace(h=0, text=LONG, y=1)])
    assert len(bag) == -(-20_000 // quality.PASSAGE)


def test_toxicity_learns_from_whole_texts(spark, monkeypatch):
    seen = []

    def learn(texts, y, share, seed=0):
        seen.extend(texts)
        raise InterruptedError

    monkeypatch.setattr(toxicity, "learn", learn)
    docs = spark.createDataFrame([(1, LONG), (2, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    with pytest.raises(InterruptedError):
        toxicity.score_toxicity(docs, labels, F.lit(True))
    assert sorted(seen) == sorted([LONG.encode(), b"a b"])
