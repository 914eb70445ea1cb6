"""The store's layout: which files inserts and lookups open, rows that are the same, names on all sides."""

import pytest
from pyspark.sql import functions as F

from tessella.operators.parts import PartedTable
from tessella.operators.store import ChunkStore

SCHEMA = "id string, file_name string, chunk_index int, content string"


@pytest.fixture
def wide(spark):
    """Parts of several files: ranges are not joined although they are small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows_of(spark, names, text="t"):
    return spark.createDataFrame([(f"{n}_{i}", n, i, f"{text} {n} {i}") for n in names for i in range(3)], SCHEMA)


def test_lookups_open_the_files_that_can_match(wide, tmp_path):
    store = ChunkStore(wide, f"file://{tmp_path}/store")
    for batch in range(5):
        store.insert(rows_of(wide, [f"f{batch}_{i}" for i in range(100)]))
    every = store.table.files(store.table.state())
    assert len(every) >= 15
    found = store.file_chunks("f3_7")
    assert [r["id"] for r in found.collect()] == ["f3_7_0", "f3_7_1", "f3_7_2"] and len(found.inputFiles()) <= 10 < len(every)
    two = store.of_files(["f0_0", "f4_99", "none"])
    assert sorted(r["id"] for r in two.collect()) == sorted([f"f0_0_{i}" for i in range(3)] + [f"f4_99_{i}" for i in range(3)]) and len(two.inputFiles()) < len(every)
    assert store.file_chunks("none").count() == 0 and store.read().count() == 1500


def test_inserts_open_the_files_that_can_match(wide, tmp_path, monkeypatch):
    store = ChunkStore(wide, f"file://{tmp_path}/store")
    store.insert(rows_of(wide, [f"f{i}" for i in range(300)]))
    opened, real = [], PartedTable.rows

    def watched(self, state, places=None, parts=None):
        opened.append(len(self.files(state, places)))
        return real(self, state, places, parts)

    monkeypatch.setattr(PartedTable, "rows", watched)
    store.insert(rows_of(wide, ["f17", "new"], "changed"))
    assert opened == [n for n in opened if n < len(store.table.files(store.table.state()))] and opened[0] <= 2
    assert store.read().count() == 903 and store.read().where("content like 'changed%'").count() == 3
    monkeypatch.setattr(PartedTable, "MOST_PLACES", 1)
    store.insert(rows_of(wide, ["f18", "newer"], "changed"))
    assert store.read().count() == 906


def test_one_name_fills_several_files(wide, tmp_path):
    store = ChunkStore(wide, f"file://{tmp_path}/store")
    store.insert(wide.range(2000).select(F.col("id").cast("string").alias("id"), F.lit("hot").alias("file_name"), F.col("id").cast("int").alias("chunk_index")))
    assert len(store.file_chunks("hot").inputFiles()) > 1 and store.file_chunks("hot").count() == 2000


def test_null_keys_and_names(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([(None, "a", 0, "x"), (None, "a", 1, "y"), (None, "a", 1, "y"), (None, None, 1, None), ("k", None, 2, "z"), ("k", "b", 2, "z")], SCHEMA)
    for _ in range(2):
        store.insert(rows)
        assert sorted(map(str, store.read().collect())) == sorted(map(str, rows.distinct().collect()))
    assert store.delete_file("a") == 2 and store.read().count() == 3
    assert sorted(str(r["id"]) for r in store.of_files([None]).collect()) == ["None", "k"]


def test_rows_without_names_go_by_their_key(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "n long, v string")
    store.insert(rows, "n")
    store.insert(rows.withColumn("v", F.lit("w")).union(spark.createDataFrame([(99, "w")], rows.schema)), "n")
    assert store.read().count() == 51 and store.read().where("v = 'w'").count() == 1
