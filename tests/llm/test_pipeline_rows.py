import pytest

import corpus_pipeline
from parley.llm.decontamination import build_index, decontaminate, read_items
from parley.llm.toxicity import score_toxicity, train_toxicity

SF = "/root/testdata/sf0.01"
COLUMNS = "doc_id long, text string, lang string"
CLEAN = "the river runs past a quiet mill and seven tall poplars"


def texts(rows):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in rows)


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark")]


def test_toxic_rows_go_whatever_their_id(spark, tables):
    docs, labels, _ = tables
    docs = docs.select("doc_id", "text", "lang")
    bad = score_toxicity(docs, train_toxicity(docs, labels)).where("predicted = 1").first().doc_id
    bad = docs.where(docs.doc_id == bad).first().text
    more = spark.createDataFrame([(None, bad, "en"), (-5, bad, "en"), (-5, CLEAN, "en"), (None, CLEAN, "en"), (None, None, "en")], COLUMNS)
    out = corpus_pipeline.toxicity(spark, docs.unionByName(more), SF)
    assert out.columns == docs.columns
    out = out.collect()
    assert bad not in [r.text for r in out]
    assert sorted(str(r.doc_id) for r in out if r.text == CLEAN) == ["-5", "None"] and None in [r.text for r in out]


def test_toxic_rows_go_without_a_shuffle_of_texts(spark):
    """Whole rows pass the model; names that the operator uses itself are theirs."""
    from pyspark.sql import Row
    kind = "score double, text string, row struct<text:string>, `a.b` array<int>, doc_id long, predicted string, c0 int"
    rows = [(0.5, CLEAN, Row(text="x"), [1, None], 3, "p", 7), (0.5, CLEAN, Row(text="x"), [1, None], 3, "p", 7),
            (None, None, None, None, None, None, None), (float("nan"), "", Row(text=None), [], 4, "1", 0)]
    df = spark.createDataFrame(rows, kind)
    out = corpus_pipeline.toxicity(spark, df, SF)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Join" not in plan
    assert out.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(repr, out.collect())) == sorted(map(repr, df.collect()))
    assert corpus_pipeline.toxicity(spark, df.limit(0), SF).collect() == []


def test_contaminated_rows_go_whatever_their_id(spark, tables):
    passage = max((r.text for r in tables[2].collect()), key=len)
    df = spark.createDataFrame([(None, passage, "en"), (5, passage, "en"), (5, CLEAN, "en"), (None, CLEAN, "en")], COLUMNS)
    found = decontaminate(build_index(df), read_items(tables[2]))
    assert found.where("contaminated").count() == 2
    assert texts(corpus_pipeline.decontamination(spark, df, SF).collect()) == [(-1, CLEAN), (5, CLEAN)]


def test_different_texts_of_one_id_stay(spark):
    other, third = "alpha beta gamma delta epsilon zeta eta", "one two three four five six seven eight"
    rows = [(3, CLEAN, "en"), (3, other, "en"), (3, other, "de"), (3, "", "en"), (3, "", "en"), (3, "...", "en"), (9, CLEAN, "en"),
            (None, third, "en"), (None, third, "en"), (None, CLEAN, "en"), (7, None, "en"), (7, None, "en"), (None, "", "en"), (None, "", "en")]
    want = None
    for parts in (1, 4):
        out = corpus_pipeline.near_duplicate(spark, spark.createDataFrame(rows, COLUMNS).repartition(parts), SF).collect()
        got = sorted(map(str, out))
        assert want in (None, got)
        want = got
    words = [x for x in texts(out) if x[1] in (CLEAN, other, third)]
    assert words == [(-1, third), (3, other), (3, CLEAN)]
    assert sorted(x for x in texts(out) if x not in words)[:2] == [(-1, ""), (-1, "")]
    assert [x for x in texts(out) if x[0] == 7] == [(7, "")] and texts(out).count((3, "")) == 1


def test_pii_stage_takes_a_column_of_its_own_name(spark):
    import corpus_pipeline
    docs = spark.createDataFrame([(1, "call (555) 123-4567", 19, "x"), (2, None, 0, "y")], "doc_id long, text string, n_chars int, __found string")
    out = corpus_pipeline.pii(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["n_chars"], r["__found"]) for r in out.collect()) == [(1, 19, "x"), (2, 0, "y")]
