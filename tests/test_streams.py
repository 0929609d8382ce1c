"""Streams over several batches: late rows, replaced results, repeated keys."""

import os

from claimforge.streaming import streams as T
from pyspark.sql import functions as F


def batches(spark, folder, schema, *parts):
    """A stream with a batch for each list of rows."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        for f in os.listdir(folder):
            if f.endswith(".parquet") and not f.startswith("batch"):
                os.rename(f"{folder}/{f}", f"{folder}/batch{i}.parquet")
                os.utime(f"{folder}/batch{i}.parquet", (1_700_000_000 + 100 * i,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_late_rows_are_dropped_and_the_last_state_of_a_window_wins(spark, tmp_path):
    stream = batches(spark, tmp_path / "in", "ts string, kind string", [("2024-01-10 01:00:00", "a")], [("2024-01-10 02:00:00", "a"), ("2024-01-09 05:00:00", "a")], [("2024-01-20 00:00:00", "b")], [("2024-01-21 00:00:00", "b")], [("2024-01-10 03:00:00", "a"), ("2024-01-19 00:00:00", "b")])
    counts = T.tumbling(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["kind"], "1 day", "2 days")
    got = {(r.window.start.day, r.kind): r.n for r in T.latest(counts, ["window", "kind"], "late").collect()}
    assert got == {(10, "a"): 2, (9, "a"): 1, (20, "b"): 1, (21, "b"): 1, (19, "b"): 1}


def test_append_mode_writes_closed_windows_once(spark, tmp_path):
    stream = batches(spark, tmp_path / "in", "ts string, kind string", [("2024-01-10 01:00:00", "a")], [("2024-01-10 02:00:00", "a")], [("2024-01-20 00:00:00", "b")])
    counts = T.tumbling(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["kind"], "1 day", "2 days")
    assert [(r.window.start.day, r.kind, r.n) for r in T.closed(counts, "closed").collect()] == [(10, "a", 2)]


def test_ingest_keeps_the_first_row_of_a_key_over_batches(spark, tmp_path):
    stream = batches(spark, tmp_path / "in", "key string, id long", [("a", 3), ("a", 2), ("b", 9)], [("a", 1), ("b", 9), ("c", 5)])
    assert sorted((r.key, r.id) for r in T.ingest(stream, "ingest", "id").collect()) == [("a", 2), ("b", 9), ("c", 5)]
