"""Rows that arrive late overwrite the days they touch: a layout of Parquet files by day, made anew only where late rows say so.

A layout keeps each key's latest-arrived row and cuts each day, sorted by time and key, into files of a given number of rows. Two shuffles
of RDDs make it, each sorted on the way:

1. by (key, arrival): all rows of a key follow each other, so one streaming pass folds them to the row that is kept of the early ones and
   the row that is kept of all. Before the shuffle each task folds what it has, so a key with a third of all rows is a few rows a task.
2. by (day, time, key), dealt by the exact bounds of files: a partition is one file, which one task writes as its rows stream by.

Bounds are the keys at every file's first place. Sorted ranges of the keys alone are counted by day, running sums of the counts give each
range its first place, and the keys at whole multiples of a file's rows are the bounds: a row a file on the driver, and files are as many as
the contract says, not as the input grows.

A day is touched where a late row is kept, or where the row stood that it replaces. Touched days are written by dynamic partition
overwrite, days left without rows are deleted, other files stay as they are. Every write is committed by Spark, so lost executors repeat
their tasks; the folded rows are a table in the shared folder, so nothing before is repeated.

Null times: rows of no time are day -1, first in its order; a row of no arrival is late and loses to any other. Rows of a key that arrive at
once: the greatest by time and then the other columns, nulls least, is kept. A null key is a key like any other, first in order. Rows that
repeat are one. An empty table gives no files. Columns keep their names, order and types, whatever they are called.
"""

from __future__ import annotations

import hashlib
import posixpath
from bisect import bisect_right
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.rdd import RDD, portable_hash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType, TimestampNTZType

from tessella.llm.shared import cut, scratch, table

FILES, LATE_FROM, NO_DAY = 900, datetime(2024, 3, 1), -1
#: Keys that a task folds before its rows are shuffled; what is beyond goes on as it is.
HELD = 100_000
#: Stands for a null among numbers that are compared: less than any of 64 bits.
NONE = -(2**64)
DAY_US = 86_400_000_000
#: Which layouts keep a row: bits of its role.
EARLY, ALL = 1, 2


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a time without a zone as it reads, or of an instant; the session's zone has no part in it."""
    c = F.col(f"`{column}`")
    if not isinstance(df.schema[column].dataType, TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))
    seconds = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")


def as_time(us: Column, kind: str) -> Column:
    """What micros() came from, as a value of its type."""
    if kind != "timestamp_ntz":
        return F.timestamp_micros(us)
    rest = F.pmod(us, F.lit(DAY_US))
    day = F.date_from_unix_date(((us - rest) / DAY_US).cast("int")).cast("timestamp_ntz")
    return day + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (rest.cast("decimal(18,0)") / 1_000_000).cast("decimal(18,6)"))


def _order(values: tuple) -> tuple:
    """values so that nulls compare, as the least."""
    return tuple((v is not None, v if v is not None else 0) for v in values)


def _later(a: tuple | None, b: tuple | None) -> tuple | None:
    """Of two (arrival, time, row), the one that arrived later."""
    if a is None or b is None:
        return a or b
    if a[:2] != b[:2]:
        return max(a, b, key=lambda x: x[:2])
    return max(a, b, key=lambda x: _order(x[2]))


def _pairs(rows: Iterator[tuple]) -> Iterator[tuple]:
    """((key, arrival), (arrival, time, row)) of rows (key, arrival, time, late, ...), at most an early and a late one of each key that
    is met again while it is held."""
    held: dict[int, list] = {}
    for key, arrival, time, late, *row in rows:
        key = NONE if key is None else key
        own = (NONE if arrival is None else arrival, NONE if time is None else time, tuple(row))
        best = held.get(key)
        if best is None:
            if len(held) >= HELD:
                yield from (((k, x[0]), x) for k, b in held.items() for x in b if x)
                held = {}
            best = held[key] = [None, None]
        best[late] = _later(best[late], own)
    yield from (((k, x[0]), x) for k, b in held.items() for x in b if x)


def _fold(rows: Iterator[tuple], limit: int) -> Iterator[tuple]:
    """(key, arrival, time, role, ...) of rows sorted by (key, arrival): what the layout of early rows keeps, and that of all."""

    def kept(key: int, early: tuple | None, last: tuple) -> Iterator[tuple]:
        none = lambda x: None if x == NONE else x
        for role, one in ((EARLY | ALL, last),) if early is last else ((EARLY, early), (ALL, last)):
            if one:
                yield none(key), none(one[0]), none(one[1]), role, *one[2]

    now = early = last = None
    for (key, arrival), own in rows:
        if now is not None and key != now:
            yield from kept(now, early, last)
            early = last = None
        now = key
        if arrival != NONE and arrival < limit:
            early = _later(early, own)
        last = _later(last, own)
        if early is not None and early == last:
            last = early
    if now is not None:
        yield from kept(now, early, last)


def folded(rows: DataFrame, key: str, arrived: str, time: str, late_from: datetime = LATE_FROM) -> DataFrame:
    """The rows that a layout keeps: role (bits EARLY and ALL), day, at (microseconds of time), arrived_us, and row, the columns of rows
    by their places, times as microseconds."""
    limit = int((late_from - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    us = {c: micros(rows, c) for c in (arrived, time)}
    rest = [c for c in rows.columns if c not in (key, arrived, time)]
    late = F.when(us[arrived] < limit, 0).otherwise(1)
    held = rows.select(F.col(f"`{key}`").cast("bigint"), us[arrived], us[time], late, *[F.col(f"`{c}`") for c in rest])
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    pairs = held.rdd.mapPartitions(_pairs)
    sorted_ = pairs.repartitionAndSortWithinPartitions(n, lambda k: portable_hash((k[0],)))
    fields = [StructField("key", LongType()), StructField("arrived_us", LongType()), StructField("at", LongType()), StructField("role", LongType()), *[StructField(f"c{i}", rows.schema[c].dataType) for i, c in enumerate(rest)]]
    kept = rows.sparkSession.createDataFrame(sorted_.mapPartitions(lambda part: _fold(part, limit)), StructType(fields), verifySchema=False)
    day = F.when(F.col("at").isNull(), NO_DAY).otherwise(F.expr(f"(at - pmod(at, {DAY_US})) div {DAY_US}"))
    return kept.withColumn("day", day.cast("bigint"))


def bounds(kept: DataFrame, rows_a_file: int) -> list[tuple[int, int, int]]:
    """(day, at, key) of the first row of every file of kept (day, at, key), in order; nulls as NONE."""
    order = ["day", "at", "key"]
    ranged = cut(kept.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy("day", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("day").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    places = counts.select("day", "range", F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("day", "range").orderBy("at", "key")) - 1
    first = ranged.withColumn("nth", nth).join(F.broadcast(places), ["day", "range"]).where((F.col("nth") + F.col("before")) % rows_a_file == 0)  # a row a range and day
    return sorted(tuple(NONE if v is None else v for v in r) for r in first.select(*order).collect())  # a row a file


def files_of(kept: DataFrame, rows_a_file: int) -> tuple[RDD, int]:
    """(rows in the order of files, files): a partition is a file, sorted by (day, at, key)."""
    firsts = bounds(kept, rows_a_file)
    shared = kept.sparkSession.sparkContext.broadcast(firsts)  # a row a file
    names = kept.columns
    day, at, key = (names.index(c) for c in ("day", "at", "key"))
    held = kept.rdd.map(lambda r: ((r[day], NONE if r[at] is None else r[at], NONE if r[key] is None else r[key]), tuple(r)))
    return held.repartitionAndSortWithinPartitions(max(1, len(firsts)), lambda k: bisect_right(shared.value, k) - 1).values(), len(firsts)


def write_days(kept: DataFrame, like: DataFrame, key: str, arrived: str, time: str, root: str, rows_a_file: int) -> None:
    """Writes kept, rows of folded(), under root: day=.../part-n, whose n ascend with the order; days that kept has are replaced as a
    whole, others are not touched. Files have the columns of like."""
    rows, n = files_of(kept, rows_a_file)
    if not n:
        return
    flat = like.sparkSession.createDataFrame(rows, kept.schema, verifySchema=False)
    rest = [c for c in like.columns if c not in (key, arrived, time)]
    own = {key: F.col("key").cast(like.schema[key].dataType)} | {c: as_time(F.col(u), like.schema[c].dataType.simpleString()) for c, u in ((arrived, "arrived_us"), (time, "at"))} | {c: F.col(f"c{i}") for i, c in enumerate(rest)}
    day = "day" if "day" not in like.columns else "_day"
    # the rows of a task are in order already; saying so keeps the writer from sorting them by day alone
    ordered = flat.sortWithinPartitions("day", "at", "key").select(*[own[c].alias(c) for c in like.columns], F.col("day").alias(day))
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(root)


def listing(spark: SparkSession, root: str) -> list[str]:
    """The data files under root."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found, out = fs.listFiles(path, True), []
    while found.hasNext():
        name = found.next().getPath().toString()
        if name.endswith(".parquet"):
            out.append(name)
    return sorted(out)


def overwrite_late(rows: DataFrame, key: str, arrived: str, time: str, root: str, rows_a_file: int, late_from: datetime = LATE_FROM) -> list[str]:
    """Writes the layout of the early rows under root, then makes it the layout of all; the files as they stood in between."""
    spark = rows.sparkSession
    kept = cut(folded(rows, key, arrived, time, late_from))
    place = (rows, key, arrived, time, root, rows_a_file)
    write_days(kept.where(F.col("role").bitwiseAND(EARLY) > 0).drop("role"), *place)
    start = listing(spark, root)
    touched = kept.where(F.col("role") != EARLY | ALL).groupBy("day").agg(F.max(F.col("role").bitwiseAND(ALL) > 0).alias("moved"))
    days = [r["day"] for r in touched.collect()]  # a row a day
    final = kept.where((F.col("role").bitwiseAND(ALL) > 0) & F.col("day").isin(days)).drop("role") if days else kept.limit(0).drop("role")
    left = {r["day"] for r in final.select("day").distinct().collect()}  # a row a day
    write_days(final, *place)
    for day in set(days) - left:
        for name in {posixpath.dirname(f) for f in start if f"day={day}/" in f}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return start


READ = "path string, day long, n_rows long, cents long, rows_crc long, ids_sha256 string"


def read_files(spark: SparkSession, root: str, like: DataFrame, start: list[str]) -> DataFrame:
    """A row a file under root, from its rows in the file's order. A file's rows come to one task, sorted, and stream through it."""
    now = listing(spark, root)
    names = "day long, file_no long, n_rows long, cents long, rows_crc long, path string, columns string, ids_sha256 string, rewritten boolean"
    if not now:
        return spark.createDataFrame([], names)
    held = spark.read.option("mergeSchema", "true").parquet(root)
    day = next(c for c in ("_day", "day") if c in held.columns and c not in like.columns)
    columns = ",".join(c for c in held.columns if c != day)
    null_empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    line = F.concat(null_empty(F.col("sale_id")), F.lit(":"), null_empty(micros(held, "sold_at")), F.lit(":"), null_empty(micros(held, "arrived_at")))
    cents = F.coalesce(F.floor(100 * F.col("total") + 0.5), F.lit(0)).cast("bigint")
    rows = held.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("nth"), F.col(day).cast("bigint").alias("day"), null_empty(F.col("sale_id")).alias("id"), cents.alias("cents"), F.crc32(line.cast("binary")).alias("crc"))
    streamed = rows.repartition("path").sortWithinPartitions("path", "nth")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now_, digest, sums = None, None, None
        done = []
        for pdf in batches:
            ends = np.flatnonzero(np.append(pdf["path"].to_numpy()[1:] != pdf["path"].to_numpy()[:-1], True)) + 1 if len(pdf) else []
            for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
                part = pdf.iloc[lo:hi]
                if part["path"].iloc[0] != now_:
                    if now_ is not None:
                        done.append((now_, *sums, digest.hexdigest()))
                    now_, digest, sums = part["path"].iloc[0], hashlib.sha256(), [int(part["day"].iloc[0]), 0, 0, 0]
                digest.update(("," * (sums[1] > 0) + ",".join(part["id"])).encode())
                sums = [sums[0], sums[1] + len(part), sums[2] + int(part["cents"].sum()), sums[3] + int(part["crc"].sum())]
        if now_ is not None:
            done.append((now_, *sums, digest.hexdigest()))
        yield pd.DataFrame(done, columns=[c.split()[0] for c in READ.split(", ")])

    # names of one file differ in their schemes alone between listings, so files are told apart by day folder and name
    tail = lambda c: F.concat_ws("/", F.slice(F.split(c, "/"), -2, 2))
    old = spark.createDataFrame([("/".join(p.split("/")[-2:]),) for p in start], "old string")  # a row a file
    found = streamed.mapInPandas(run, READ).withColumn("tail", tail(F.col("path")))
    nth = F.row_number().over(Window.partitionBy("day").orderBy(F.regexp_extract("tail", r"part-(\d+)", 1).cast("bigint"), "tail")) - 1
    rewritten = F.col("old").isNull()
    return found.join(F.broadcast(old), F.col("tail") == F.col("old"), "left").select("day", nth.cast("bigint").alias("file_no"), "n_rows", "cents", "rows_crc", "path", F.lit(columns).alias("columns"), "ids_sha256", rewritten.alias("rewritten"))


def with_copies(sales: DataFrame) -> DataFrame:
    """sales and the copies that the contract adds: later totals of some sales on every tenth day."""
    h = F.crc32(F.coalesce(F.col("sale_id").cast("string"), F.lit("")).cast("binary"))
    at = micros(sales, "sold_at")
    day = F.coalesce(((at - F.pmod(at, F.lit(DAY_US))) / DAY_US).cast("bigint"), F.lit(NO_DAY))

    def moved(column: str, days: Column) -> Column:
        return (F.col(column) + F.make_dt_interval(days.cast("int"))).cast(sales.schema[column].dataType)

    later = {"total": F.col("total") + 1, "sold_at": moved("sold_at", h % 2), "arrived_at": moved("arrived_at", 1 + h % 97)}
    copies = sales.where((h % 3 == 0) & (day % 10 == 0)).select(*[later[c].alias(c) if c in later else F.col(f"`{c}`") for c in sales.columns])
    return sales.unionAll(copies)


def op11_late_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = table(spark, sf_dir, "sales")
    root, rows_a_file = scratch(spark), 1 + sales.count() // FILES
    start = overwrite_late(with_copies(sales), "sale_id", "arrived_at", "sold_at", root, rows_a_file)
    return read_files(spark, root, sales, start)
