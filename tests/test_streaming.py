from pyspark.sql import functions as F

from arborlake import streaming


def test_windows_agree_on_batch_and_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    batch = streaming.windowed_metrics(events)
    stream = streaming.windowed_metrics(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    key = lambda d: sorted((r.start, r.event_type, r.n) for r in d.collect())
    assert key(spark.table("windows")) == key(batch)


def test_files_are_seen_once(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.py").write_text("x")
    seen = []
    for extra in ("b.py", None):
        q = streaming.watch_files(spark, str(tmp_path / "f"), lambda df, n: seen.extend(r.path for r in df.select(F.element_at(F.split("path", "/"), -1).alias("path")).collect()), str(tmp_path / "c"))
        q.awaitTermination(60)
        if extra:
            (tmp_path / "f" / extra).write_text("y")
    assert sorted(seen) == ["a.py", "b.py"]
