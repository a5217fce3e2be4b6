import zlib

import pytest
from parley.llm.learning import sample_by_label
from parley.llm.toxicity import score_toxicity, train_toxicity

ROOT = "/root/testdata"


def load(spark, sf):
    return spark.read.parquet(f"{ROOT}/{sf}/documents.parquet"), spark.read.parquet(f"{ROOT}/{sf}/labels.parquet")


def held_out(spark, model):
    """(recall, share of clean texts called toxic) on the labels of sf0.1 that no training sees."""
    docs, labels = load(spark, "sf0.1")
    labels = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    got = [(labels[r.doc_id], r.predicted) for r in score_toxicity(docs, model).collect() if r.doc_id in labels]
    return tuple(sum(p for y, p in got if y == side) / sum(y == side for y, _ in got) for side in (1, 0))


@pytest.mark.parametrize("sf, least", [("sf0.001", 0.25), ("sf0.01", 0.5)])
def test_few_labels_teach_something(spark, sf, least):
    recall, wrong = held_out(spark, train_toxicity(*load(spark, sf)))
    assert recall >= least and wrong < 0.01


def test_rare_label(spark):
    docs, labels = load(spark, "sf0.1")
    rows = sorted((r.doc_id, r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5)
    rows = [r for r in rows if r[1] == 1][:25] + [r for r in rows if r[1] == 0]
    rare = spark.createDataFrame(rows, "doc_id long, toxic int")
    sample, weights = sample_by_label(docs, rare, "toxic", 1000)
    count = dict(sample.select("id", "label").distinct().groupBy("label").count().collect())
    assert count == {0: 975, 1: 25} and weights[1] == 1 and weights[0] == (len(rows) - 25) / 975
    recall, wrong = held_out(spark, train_toxicity(docs, rare, sample_rows=1000))
    assert recall >= 0.3 and wrong < 0.01


def test_nothing_learned_is_said(spark):
    df = spark.createDataFrame([(i, f"w{i} v{i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 6)) for i in range(40)], "doc_id long, toxic int")
    with pytest.warns(UserWarning, match="nothing is learned"):
        train_toxicity(df, labels, chance=0.01)
