"""Helpers that the training-data operators share: table access, durable cuts, row identity."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as a word in the size and shingle contracts: runs of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The most rows of a table of keys that goes to every executor whole; parts that a frequent key is dealt into beyond it.
BROADCAST_ROWS, SALTS = 1_000_000, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns, matched exactly once by position, whatever other columns the table has; a column it lacks is null."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).alias(c) for c in columns])


def scratch(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder. Where none is set, a folder of this machine serves in local mode alone."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/tessella-checkpoints"
    return f"{base.rstrip('/')}/tessella/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: ends the lineage, so that a lost executor repeats no earlier stage."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files behind a cut that no later step reads."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        if "/tessella/" in path:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def beside(rows: DataFrame, keyed: DataFrame, on: str, how: str = "left", salts: int = SALTS) -> DataFrame:
    """rows joined with a cut that has few bytes a key: by broadcast where it has at most BROADCAST_ROWS rows, else with so many salted
    copies of it, so that the rows of a frequent key meet it in as many tasks (salts = 1: none, for whole texts with keys that are rarely
    repeated; as these are what is shuffled then, the bound is twice as high). The hints keep Spark from broadcasting the cut after all:
    it goes by the size of compressed files, to which salted copies add nothing."""
    if keyed.count() <= BROADCAST_ROWS * (1 if salts > 1 else 2):
        return rows.join(F.broadcast(keyed), on, how)
    if salts == 1:
        return rows.join(keyed.hint("shuffle_hash"), on, how)
    salted = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return dealt.join(salted.hint("merge"), [on, "salt"], how).drop("salt")


def crc32_text(column: Column) -> Column:
    """crc32 of a value's text, unsigned; of the empty text where it is null."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def unit(column: Column, salt: str) -> Column:
    """A number in (0, 1) that depends on the value's text and the salt alone, with 52 bits from md5."""
    digits = F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(column.cast("string"), F.lit(""))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(2**52))
