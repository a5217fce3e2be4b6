import math
import re
import zlib

import numpy as np

from parley.llm.toxicity import ToxicityModel, score_toxicity, sentence_words, train_toxicity

BITS = 18


def brute(text, model):
    """Score of one text, sentence by sentence."""
    import pyarrow as pa
    clean = 1.0
    for sentence in re.split(r"(?<=[.!?\n])", text or ""):
        buckets, first, *_ = sentence_words(pa.array([re.sub(r"[.!?\n]", " ", sentence)]), BITS)
        if len(first) == 2:
            clean *= 1 - 1 / (1 + math.exp(-min(max(model.weights[buckets].sum() + model.bias, -40), 40)))
    return 1 - clean


def test_scores_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    model = ToxicityModel(rng.normal(0, 1, 1 << BITS), -4.0)
    rows = [(1, None, 0.5), (2, "", 0.5), (3, "... \n!", 0.5), (None, "Good day. You FOOL!", 0.5), (5, "é à", 0.5), (5, "é à", 0.5),
            (6, "word one, two\nthree. " * 9000, 0.5), (7, "x" * 40000, 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = score_toxicity(df, model).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(next(t for i, t, _ in rows if i == r.doc_id), model)
        assert abs(r.score - want) < 1e-6 and r.predicted == int(r.score >= 0.5)
    assert [r.score for r in got if r.doc_id in (1, 2, 3)] == [0.0] * 3
    assert score_toxicity(df.limit(0), model).collect() == []


def test_equal_texts_score_alike_wherever_they_stand(spark):
    """Also where a task's rows are cut into slices; the whole row comes back beside the verdict."""
    rng = np.random.default_rng(2)
    model = ToxicityModel(rng.normal(0, 1, 1 << BITS), -4.0)
    text = "Good day, my friend. You are late again! What a morning."
    rows = [(i, text if i % 3 else " ".join(map(str, rng.integers(0, 9999, 2000))) + ".", "x") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    got = score_toxicity(df, model, row_col="whole").collect()
    assert len({r.score for r in got if r.doc_id % 3}) == 1
    assert sorted(tuple(r.whole) for r in got) == rows and all(r.whole.doc_id == r.doc_id for r in got)


def test_a_task_gives_back_what_arrow_keeps(monkeypatch):
    """Also to later stages: the worker lives on."""
    import pyarrow as pa

    from parley.llm import arrays
    calls = []

    class Pool:
        def release_unused(self):
            calls.append(len(given))

    monkeypatch.setattr(arrays.pa, "default_memory_pool", Pool)
    given = []
    batches = [pa.record_batch({"x": [i]}) for i in range(3)]
    for batch in arrays.released(lambda them: (b.slice(0) for b in them))(iter(batches)):
        given.append(batch)
    assert given == batches and calls == [3]


def test_offending_sentences_are_located(spark):
    texts = [("all is well here. " if i % 2 else "fine day. You utter blockhead! é ende. ") * (1 + i % 3) + f"w{i}" for i in range(600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(600)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = train_toxicity(df, labels, least_z=3)
    got = {r.doc_id: r for r in score_toxicity(df, model).collect()}
    for i in (0, 2, 4, 11, 13):
        r = got[i]
        assert r.predicted == 1 - i % 2
        found = [s.text for s in r.offending]
        assert all("blockhead" in x for x in found) and len(found) == (0 if i % 2 else 1 + i % 3)
        assert all(texts[i].encode()[s.start:s.stop].decode() == s.text for s in r.offending)


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "a b."), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in score_toxicity(df, train_toxicity(df, labels)).collect()] == [0, 0]


def test_query_on_held_out_labels(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in E.queries()["op2_toxicity"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()
    assert sorted(got) == sorted(r.doc_id for r in docs)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    right = sum(got[i].predicted == y for i, y in labels)
    assert right / len(labels) > 0.97
    assert sum(got[i].predicted for i, y in labels if y == 0) / len(labels) < 0.01


def test_fitting_copies_only_words_that_tell():
    """The driver holds the sample's words once; of the rest it keeps counts."""
    import tracemalloc

    from parley.llm.toxicity import fit_sentences
    rnd = np.random.default_rng(4)
    label = (np.arange(400) % 4 == 0).astype(float)
    words = [rnd.integers(8, 1 << 12, 3000).astype(np.int32) for _ in label]
    for w, y in zip(words, label, strict=True):
        w[5:5 + int(y)] = 7
    sizes = [np.full(10, 300, np.int32) for _ in label]
    tracemalloc.start()
    model = fit_sentences(words, sizes, label, bits=12, steps=20, rate=0.2, l2=0.1, leak=0.05, chance=0.01)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < sum(w.nbytes for w in words)
    assert model.weights[7] > 0 and (model.weights != 0).sum() == 1
