"""Keyed state on streams: repeated and late rows, over several batches of one checkpoint."""

from datetime import datetime

from pyspark.sql import functions as F

from tessella.operators.store import ChunkStore
from tessella.streaming import ingest

SCHEMA = "id string, file_name string, value int, ts timestamp"
#: A batch a file; the watermark lies an hour behind the newest row of the batches before.
BATCHES = [
    [("a", "f", 1, "2024-01-01T10:00:00"), ("a", "f", 2, "2024-01-01T10:05:00"), ("b", "f", 1, "2024-01-01T10:10:00"), (None, "f", 9, "2024-01-01T10:11:00"), ("n", "f", 1, None)],
    [("a", "f", 3, "2024-01-01T09:30:00"), ("b", "f", 4, "2024-01-01T10:30:00"), ("b", "f", 2, "2024-01-01T10:30:00"), ("c", "f", None, "2024-01-01T13:00:00")],
    [("a", "f", 7, "2024-01-01T10:20:00"), ("c", "f", 5, "2024-01-01T13:00:00"), ("d", "f", 6, "2024-01-01T11:00:00")],  # before the watermark of 12:00: a and d
    [("b", "f", 8, "2024-01-01T18:00:00")],
    [("b", "f", 0, "2024-01-01T17:30:00"), ("a", "f", 1, "2024-01-01T19:00:00")],
]


def stream_of(spark, folder):
    for n, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, "id string, file_name string, value int, ts string").coalesce(1).write.json(f"file://{folder}/{n}")
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(f"file://{folder}")


def test_last_values_of_a_stream(spark, tmp_path):
    got = []
    stream = ingest.last_value(stream_of(spark, tmp_path / "in"), "id", "value", "ts")
    query = stream.writeStream.outputMode("update").foreachBatch(lambda batch, n: got.extend((r["id"], r["value"], r["ts"]) for r in batch.collect())).option("checkpointLocation", f"file://{tmp_path}/marks").trigger(availableNow=True).start()
    query.awaitTermination()
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    assert sorted(got, key=str) == sorted([("a", 2, at(10, 5)), ("b", 1, at(10, 10)), ("b", 4, at(10, 30)), ("c", None, at(13)), ("c", 5, at(13)), ("b", 8, at(18)), ("a", 1, at(19))], key=str)


def test_first_keys_of_a_stream(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/store")
    ingest.ingest(stream_of(spark, tmp_path / "in"), store, f"file://{tmp_path}/marks", time="ts").awaitTermination()
    held = {r["id"]: r["value"] for r in store.read().where("id in ('a', 'b', 'c')").collect()}
    assert held.keys() == {"a", "b", "c"} and held["b"] == 1 and held["a"] in (1, 2) and held["c"] is None
    assert [r["value"] for r in store.read().where("id = 'd'").collect()] == [6]  # late, but the first of its key


def test_first_keys_of_a_table(spark):
    rows = spark.createDataFrame([r for b in BATCHES for r in b], "id string, file_name string, value int, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert {r["id"]: r["value"] for r in ingest.first_per_key(rows, "id", "ts").where("id is not null").collect()}.items() >= {"a": 3, "b": 1, "d": 6, "n": 1}.items()
    assert ingest.first_per_key(rows, "id", "ts").count() == 6
