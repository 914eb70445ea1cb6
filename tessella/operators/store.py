"""A chunk store on Parquet: append what is new, delete by file, truncate, compact, statistics."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.text import preview
from tessella.operators.parts import PartedTable


def insert_new_only(store: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """What an insert appends: rows of new whose key the store has not; existing rows stay as they are. The store is searched for the
    new keys first, so that few new rows never shuffle a large store. A null key is in no store."""
    held = store.select(key).join(new.select(key), key, "left_semi").distinct()
    return new.join(held, key, "left_anti")


def stats(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.sum(F.length(text)).cast("bigint").alias("chars"), F.countDistinct("source").alias("files"))


def samples(rows: DataFrame, n: int = 5, length: int = 200) -> DataFrame:
    """The first n rows by id, with a preview instead of their content; their other columns are what is known of them."""
    return rows.orderBy("id").limit(n).withColumn("preview", preview(F.col("content"), length)).drop("content")


def last_per_key(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def summaries(rows: DataFrame, first: int = 100) -> DataFrame:
    """(file_name, chunks, contents) of rows (file_name, chunk_index, content): contents joins the first chunks of a file."""
    nth = F.row_number().over(Window.partitionBy("file_name").orderBy("chunk_index"))
    kept = rows.select("file_name", "chunk_index", "content").withColumn("_n", nth).where(F.col("_n") <= first)
    texts = kept.groupBy("file_name").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("held"))
    counts = rows.groupBy("file_name").agg(F.count("*").alias("chunks"))
    return counts.join(texts, "file_name").select("file_name", "chunks", F.array_join(F.transform("held", lambda c: c["content"]), "\n\n").alias("contents"))


def workspace(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder. Where none is set, a folder of this machine serves in local mode alone."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/tessella-checkpoints"
    return f"{base.rstrip('/')}/tessella/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


class ChunkStore:
    """Rows (file_name, a key, any others) as a parted table whose places are hashes of file names: inserts and lookups open the files of
    the parts that can hold the names they are about. Rows of one key have one file name; a row is the same as another if both name and
    key are. Without a column file_name the places are hashes of the key."""

    MOST_NAMED = PartedTable.MOST_NAMED

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, PartedTable(spark, path)
        self.path = self.table.path

    def read(self) -> DataFrame | None:
        now = self.table.rows(self.table.state())
        return None if now is None else now.drop("_place", "_part")

    def parts(self) -> list[int]:
        return [p for p, _ in self.table.state()["parts"]]

    def rows_of(self, parts: list[int]) -> DataFrame:
        """The rows of some of the current parts."""
        return self.table.rows(self.table.state(), parts=parts).drop("_place", "_part")

    def places_of(self, names: list[str | None]) -> list[int]:
        rows = self.spark.createDataFrame([(n,) for n in names], "file_name string").select(F.xxhash64("file_name").alias("p"))
        return [r["p"] for r in rows.collect()]

    def insert(self, new: DataFrame, key: str = "id") -> None:
        """Appends the rows of new that the store has not, each once: of rows that are the same, the one with the smallest hash of all its
        columns. Rows of a null key are the same if all their columns are. new is computed once; of the store, the files that can hold the
        new rows are read, or all where new is of more than MOST_PLACES names."""
        state, staged = self.table.state(), f"{self.path}/staged/{uuid.uuid4().hex}"
        new.write.parquet(staged)
        rows = self.spark.read.schema(new.schema).parquet(staged)
        columns = sorted(rows.columns)
        place = F.xxhash64("file_name" if "file_name" in columns else key)

        def same(of: DataFrame) -> DataFrame:
            """of with _same: the key, or for a null key a digest of new's columns."""
            each = [F.to_json(F.struct(F.col(f"`{c}`").alias("v"))) if c in of.columns else F.lit("{}") for c in columns]
            return of.withColumn("_same", F.coalesce(F.concat(F.lit("k"), F.col(f"`{key}`").cast("string")), F.concat(F.lit("n"), F.sha2(F.to_json(F.array(*each)), 256))))

        whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
        once = same(rows).withColumn("_place", place).groupBy("_place", "_same").agg(F.min_by(whole, F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])).alias("_row"))
        first = once.select("_place", "_same", "_row.*")
        if state["parts"]:
            places = [r["_place"] for r in rows.select(place.alias("_place")).distinct().limit(self.table.MOST_PLACES + 1).collect()]
            now = same(self.table.rows(state, places if len(places) <= self.table.MOST_PLACES else None))
            known = now.select("_place", "_same").join(first.select("_place", "_same"), ["_place", "_same"], "left_semi").distinct()
            first = first.join(known, ["_place", "_same"], "left_anti")
        self.table.add(state, first.drop("_same"))
        self.table._fs.delete(self.table._jvm_path(staged), True)

    def delete_file(self, file_name: str) -> int:
        state = self.table.state()
        now = self.file_chunks(file_name)
        n = 0 if now is None else now.count()
        if n:
            self.table.forget(state, file_name)
        return n

    def clear(self) -> None:
        self.table.clear()

    def drop(self) -> None:
        self.table.drop()

    def compact(self) -> None:
        self.table.compact()

    def vacuum(self) -> None:
        self.table.vacuum()

    def of_files(self, names: list[str | None]) -> DataFrame | None:
        """The rows of some files, from the files of the store that can hold them."""
        now = self.table.rows(self.table.state(), self.places_of(names))
        if now is None:
            return None
        asked = F.col("file_name").isin([n for n in names if n is not None])
        return now.where(asked | F.col("file_name").isNull() if None in names else asked).drop("_place", "_part")

    def file_chunks(self, file_name: str) -> DataFrame | None:
        now = self.of_files([file_name])
        return now if now is None or "chunk_index" not in now.columns else now.orderBy("chunk_index")
