import public_tokenizers as P
import tiktoken

import corpus_pipeline
import test_byte_bpe
import test_decontamination
import test_near_duplicates
import test_pseudonyms
from parley.llm.queries import PSEUDONYM_KEY

SF = "/root/testdata/sf0.01"


def test_each_stage_equals_brute_force(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    monkeypatch.setattr(test_pseudonyms, "KEY", PSEUDONYM_KEY)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=test_byte_bpe.RANKS, special_tokens={})
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        if name == "byte_bpe":
            last = sorted(map(tuple, out.collect()))
            assert last == sorted((i, *test_byte_bpe.expected(library, r.text)) for i, r in before.items())
            continue
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r for r in docs.collect()}
        texts = [(i, r.text) for i, r in before.items()]
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            gone = set(before) - set(after)
            assert 20 < len(gone) < 120 and sum(labels.get(i) == 0 for i in gone) <= 2
        if name == "near_duplicates":
            assert set(after) == {i for i, _, _, kept in test_near_duplicates.brute(texts, 5, 80) if kept}
        if name == "decontamination":
            assert set(after) == {i for i, _, _, _, bad in test_decontamination.brute(texts, items) if not bad}
        if name == "pii":
            assert {i: r.text for i, r in after.items()} == {i: test_pseudonyms.brute(t)[0] for i, t in texts}
            assert all(r.n_chars == before[i].n_chars or before[i].text != r.text for i, r in after.items())
        else:
            assert all(after[i] == before[i] for i in after)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == last


def test_nulls_repeated_rows_and_empty_tables(spark):
    rows = [(1, None, "en", 0), (2, "", "en", 0), (None, "one two three four five six", "en", 27), (4, "z y x w v u t", "en", 13),
            (4, "z y x w v u t", "en", 13), (5, "z y x w v u t", "en", 13), (6, "call +1 (017) 555-7713", None, 22)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        n = stage(spark, df, "/root/testdata/sf0.001").count()
        assert n == (5 if name == "near_duplicates" else 7), name
        assert stage(spark, df.limit(0), "/root/testdata/sf0.001").count() == 0
