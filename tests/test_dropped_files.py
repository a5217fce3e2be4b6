import glob

from pyspark.sql import functions as F

from parley.plans import queries_streaming as Q


def _events(spark, tmp_path, n=6000):
    sf = str(tmp_path / "sf")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(100).crossJoin(spark.range(n // 100).toDF("k")).withColumn(
        "event_id", (F.col("event_id") + F.col("k") * 100_000).cast("bigint")).drop("k").coalesce(1).write.parquet(f"{sf}/events.parquet")
    return sf


def _dropped(monkeypatch, tmp_path):
    """The folders that a query drops its files into, and the files of each."""
    real, places = Q.scratch_path, []

    def path(spark, name):
        at = real(spark, name)
        if name == "drop":
            places.append(at)
        return at
    monkeypatch.setattr(Q, "scratch_path", path)
    return lambda: [sorted(glob.glob(f"{p.removeprefix('file:')}/**/part-*", recursive=True)) for p in places]


def test_redelivered_files_do_not_grow(spark, tmp_path, monkeypatch):
    sf, files = _events(spark, tmp_path), _dropped(monkeypatch, tmp_path)
    monkeypatch.setattr(Q, "PAYLOAD_ROWS", 500)
    rows = Q.redelivered_files(spark, sf)
    ok = spark.read.parquet(f"{sf}/events.parquet").where("event_id % 13 NOT BETWEEN 1 AND 4").count()
    assert rows.count() == ok
    assert len(files()[0]) == 12 and all(sum(1 for _ in open(f)) <= 700 for f in files()[0])


def test_hourly_files_do_not_grow(spark, tmp_path, monkeypatch):
    sf, files = _events(spark, tmp_path, 40_000), _dropped(monkeypatch, tmp_path)
    Q.stream_hourly(spark, sf)
    monkeypatch.setattr(Q, "_files_each", lambda rows, parts, file_rows: 3)
    monkeypatch.setattr(Q, "ARRIVAL", "CAST(pmod(event_id, 3) AS INT)")
    Q.stream_hourly(spark, sf)
    assert len(files()[0]) == 3 and len(files()[1]) == 9


def test_measures_are_dealt_over_three_batches(spark, tmp_path, monkeypatch):
    sf, files = _events(spark, tmp_path), _dropped(monkeypatch, tmp_path)
    monkeypatch.setattr(Q, "PAYLOAD_ROWS", 500)
    _, _, log = Q._run_ingest(spark, sf, with_partials=True, parts=3)
    assert len(files()[0]) == 12
    batches = glob.glob(f"{log.removeprefix('file:')}/run=*/batch_id=*")
    assert sorted(b.rsplit("=", 1)[1] for b in batches) == ["0", "1", "2"]
