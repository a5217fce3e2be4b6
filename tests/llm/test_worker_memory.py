"""What Python workers hold while a task runs, and keep when it has ended."""

import random
import re
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm import arrays
from parley.llm.near_duplicates import unpacked


def _resident() -> int:
    return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) << 10


@pytest.mark.skipif(arrays._trim is None, reason="the C library cannot return memory")
def test_a_task_gives_back_what_the_c_library_keeps():
    above = []

    def run(batches):
        for batch in batches:
            held = [np.ones(8000) for _ in range(3000)]   # 192 MB in small pieces
            above.append(np.ones(8000))                   # the heap cannot shrink below this one
            del held
            yield batch

    before = _resident()
    assert len(list(arrays.released(run)(iter([pa.record_batch({"x": [1]})])))) == 1
    assert _resident() - before < 60e6


def test_hashing_keeps_no_tables_of_the_data():
    n = (4 << 20) + 77
    data = np.random.default_rng(1).integers(0, 256, n).astype(np.uint8)
    starts = np.arange(0, n - 50, 50)
    tracemalloc.start()
    hashes = arrays.span_hashes(data, starts, starts + 30)
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept < hashes.nbytes + 1e6
    assert peak < 20 * n


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 4097, 8192, 12345])
def test_a_hash_is_the_polynomial_of_the_span(n):
    rnd = random.Random(n)
    data = np.array([rnd.randrange(256) for _ in range(n)], np.uint8)
    spans = [(0, n), (n, n), *((a, min(n, a + rnd.randrange(60))) for a in (rnd.randrange(n + 1) for _ in range(200)))]
    spans += [(a, min(n, a + 9)) for a in (4090, 4095, 4096, 8190, 8192) if a <= n]

    def whole(a, b):
        base, value = 0x9E3779B97F4A7C15, 0
        for x in data[a:b][::-1].tolist():
            value = value * base + x + 1
        return (value ^ ((b - a) * 0xD6E8FEB86659FD93)) % (1 << 64) if b > a else 0

    starts, ends = (np.array(x) for x in zip(*spans, strict=True))
    mixed = arrays.mix(np.array([(whole(a, b)) for a, b in spans], np.uint64))
    assert arrays.span_hashes(data, starts, ends).tolist() == mixed.tolist()


def test_frames_are_unpacked_half_a_megabyte_at_a_time():
    texts = [f"{i} ".encode() * (1 << 14) for i in range(10, 80)]
    pack = zstandard.ZstdCompressor().compress
    parts = list(unpacked(pa.record_batch({"id": list(range(70)), "frame": [pack(x) for x in texts]})))
    assert [x for p in parts for x in p.column("text").to_pylist()] == texts
    assert [x for p in parts for x in p.column("id").to_pylist()] == list(range(70))
    assert max(sum(map(len, p.column("text").to_pylist())) for p in parts) <= (1 << 19) + max(map(len, texts))


@pytest.mark.parametrize("stage", ["toxicity", "near_duplicates"])
@pytest.mark.parametrize("asked", [None, "1m"])
def test_a_stage_sends_no_more_than_four_megabytes_at_once(spark, tmp_path, stage, asked):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.createDataFrame([(0, 0), (5, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(0, "a b c"), (5, "d e f")], "doc_id long, text string")
    long = spark.range(0, 10000, 1, 1).select("id", F.repeat(F.lit("abcdefgh"), 250).alias("text"))     # 20 MB in one task

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    spark.conf.unset(key)
    try:
        if asked:
            spark.conf.set(key, asked)
        dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path)).collect()
        got = long.mapInArrow(sizes, "rows long, bytes long").collect()
    finally:
        spark.conf.unset(key)
    assert sum(r.rows for r in got) == 10000
    assert max(r.bytes for r in got) < (1.1e6 if asked else 4.3e6)
