"""K-d tree partitioning by bytes, with DataFrame functions only.

Nodes are split at the weighted median of their widest metadata dimension until there are as many leaves as asked for (or until leaves
reach the target bytes). A dimension is an integer code: source and lang by their first bytes, size, doc_id; its spread is its range in
the node over its range in the table. Rows of a node are ordered by code and then by a hash. The median is found by summing bytes in BINS
equal steps of the code's range, for all nodes of a level in one aggregation, and again within the step where half is reached, and within
the hashes of one code where that code alone holds it, until the step holds at most EDGE_ROWS rows; those are put in order. Running
sums stay with Spark; one row a node reaches the driver, which keeps the tree. Rows that share the code at which the split falls, be it a
third of the table, are so split by their hashes.

Equal texts stay together where their bytes are at most TOGETHER of a leaf's and they are at most ROWS_TOGETHER rows: such a group is one
unit, with the least metadata of its rows and one hash of its text, so it is never cut. Rows of larger groups go each by its own metadata
and a hash of doc_id and text, as else leaves could not be near equal, and one task would hold all empty texts. Larger groups are broadcast
up to a checked number, else joined by salted keys.

doc_ids may be any 64-bit numbers: they count from the least on, in steps of four where they span more than 62 bits.

Null texts have size 1 and are equal texts, null metadata has the code 0. Rows that repeat in full share a hash and lie in one leaf; their
order in a slot comes from Spark's row numbers. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.shared import beside, cut, only, table

BINS = 2**16
#: Rows of a node's step that are put in order in one task.
EDGE_ROWS = 20_000
TIES = 2**48
#: Share of a leaf's bytes up to which a group of equal texts stays together.
TOGETHER = 1 / 100
ROWS_TOGETHER = 10_000
#: Ids that lie further apart are counted in steps of 2^COARSE, so that differences and bounds stay within 64 bits.
WIDEST, COARSE = 2**62, 2
ROWS_A_SLOT_BUCKET = 10_000
DIMENSIONS = ("source", "lang", "size", "doc")


def _code(text: Column) -> Column:
    """The first seven bytes as an integer, in the order of code points."""
    return F.conv(F.rpad(F.hex(F.substring(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("bigint")


def units(docs: DataFrame, leaves: int, target_bytes: int | None = None) -> tuple[DataFrame, int, int]:
    """(rows, bytes in all, leaves): per row doc_id, size, text_crc32, the codes by which it is split, and tie."""
    text = F.coalesce(F.col("text"), F.lit(""))
    held = cut(
        only(docs, "doc_id", "text", "source", "lang").select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("same"),
            F.struct(_code(F.col("source")).alias("source"), _code(F.col("lang")).alias("lang"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("doc"), F.xxhash64("doc_id", text).alias("tie")).alias("own"),
        )
    )
    total = held.agg(F.sum("size")).first()[0] or 0
    if target_bytes:
        leaves = 1
        while total > leaves * target_bytes:
            leaves *= 2
    copies = held.groupBy("same").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.struct(*[F.min(f"own.{c}").alias(c) for c in ("source", "lang", "doc")], F.xxhash64(F.first("same")).alias("tie")).alias("unit"))
    copies = cut(copies.where("n > 1"))
    fits = (F.col("bytes") <= total / leaves * TOGETHER) & (F.col("n") <= ROWS_TOGETHER)
    parted = beside(held, copies.where(~fits).select("same", F.lit(True).alias("large")), "same")
    alone = parted.where("large").withColumn("unit", F.col("own"))
    rest = parted.where("large is null").join(copies.where(fits).select("same", "unit"), "same", "left").withColumn("unit", F.coalesce("unit", "own"))
    rows = cut(alone.unionByName(rest).select("doc_id", "size", "text_crc32", "unit.source", "unit.lang", "unit.doc", F.col("unit.tie").bitwiseAND(F.lit(TIES - 1)).alias("tie")))
    low, high = rows.agg(F.min("doc"), F.max("doc")).first()
    step = COARSE if total and high - low >= WIDEST else 0
    return rows.withColumn("doc", F.shiftright("doc", step) - F.lit((low or 0) >> step)), total, leaves


def _beside(rows: DataFrame, known: dict[int, tuple], fields: str) -> DataFrame:
    """rows with the fields of their node; a row a node."""
    nodes = rows.sparkSession.createDataFrame([(k, *v) for k, v in sorted(known.items())], f"node int, {fields}")
    return rows.join(F.broadcast(nodes), "node")


def _medians(rows: DataFrame, ranges: dict[int, tuple[int, int]], goals: dict[int, float]) -> dict[int, tuple[int, int]]:
    """For each node of rows (node, code, tie, size), whose codes lie in its range, the last (code, tie) of its left half: the unit that
    crosses the goal goes where it leaves the less uneven halves."""
    state = {k: (*ranges[k], 0, TIES, 0) for k in ranges}  # codes from, to, ties from, to, bytes before
    fields = "code_low long, code_high long, tie_low long, tie_high long, below long, code_step long, tie_step long, goal double"
    open_ = set(ranges)

    def known() -> dict[int, tuple]:
        return {k: (*state[k], max(1, -(-(state[k][1] - state[k][0]) // BINS)), max(1, -(-(state[k][3] - state[k][2]) // BINS)), float(goals[k])) for k in state}

    def inside() -> DataFrame:
        return _beside(rows, known(), fields).where("code >= code_low and code < code_high and (code_high - code_low > 1 or (tie >= tie_low and tie < tie_high))")

    while open_:
        by_code = F.col("code_high") - F.col("code_low") > 1
        bin_ = F.when(by_code, F.expr("(code - code_low) div code_step")).otherwise(F.expr("(tie - tie_low) div tie_step"))
        bins = inside().where(F.col("node").isin(sorted(open_))).groupBy("node", bin_.alias("bin")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.first("goal").alias("goal"), F.first("below").alias("below"))
        upto = F.col("below") + F.sum("n").over(Window.partitionBy("node").orderBy("bin"))
        here = F.struct("bin", "n", "rows", "upto")
        found = bins.withColumn("upto", upto).groupBy("node").agg(F.coalesce(F.min(F.when(F.col("upto") >= F.col("goal"), here)), F.max(here)).alias("b")).select("node", "b.*").collect()  # one row a node
        for r in found:
            k = r["node"]
            code_low, code_high, tie_low, tie_high, code_step, tie_step = (known()[k][i] for i in (0, 1, 2, 3, 5, 6))
            if code_high - code_low > 1:
                code_low, code_high = (at := code_low + r["bin"] * code_step), min(at + code_step, code_high)
            else:
                tie_low, tie_high = (at := tie_low + r["bin"] * tie_step), min(at + tie_step, tie_high)
            state[k] = code_low, code_high, tie_low, tie_high, r["upto"] - r["n"]
            if r["rows"] <= EDGE_ROWS or (code_high - code_low <= 1 and tie_high - tie_low <= 1):
                open_.discard(k)
        open_ &= {r["node"] for r in found}
    each = inside().groupBy("node", "code", "tie").agg(F.sum("size").alias("n"), F.first("goal").alias("goal"), F.first("below").alias("below"))
    order = Window.partitionBy("node").orderBy("code", "tie")
    ordered = each.withColumn("upto", F.col("below") + F.sum("n").over(order))
    here = F.struct("code", "tie", "n", "upto", "goal")
    ends = ordered.groupBy("node").agg(F.coalesce(F.min(F.when(F.col("upto") >= F.col("goal"), here)), F.max(here)).alias("e")).select("node", "e.*").collect()  # one row a node
    return {r["node"]: (r["code"], r["tie"] - (r["goal"] - (r["upto"] - r["n"]) < r["upto"] - r["goal"])) for r in ends}


def tree(docs: DataFrame, leaves: int = 16, target_bytes: int | None = None) -> DataFrame:
    """units() with node (0 to leaves - 1). With target_bytes, as many leaves (a power of two) as it takes."""
    rows, total, leaves = units(docs, leaves, target_bytes)
    rows = rows.withColumn("node", F.lit(0))
    spread = [f(d).alias(f"{d}_{n}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]
    whole = rows.agg(*spread).first()
    if not total:
        return rows
    for _ in range((leaves - 1).bit_length()):
        nodes = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("n"), *spread).collect()}  # one row a node
        widest = {k: max(DIMENSIONS, key=lambda d: (r[f"{d}_hi"] - r[f"{d}_lo"]) / max(1, whole[f"{d}_hi"] - whole[f"{d}_lo"])) for k, r in nodes.items()}
        coded = _beside(rows, {k: (d,) for k, d in widest.items()}, "dimension string").withColumn("code", F.coalesce(*[F.when(F.col("dimension") == d, F.col(d)) for d in DIMENSIONS])).drop("dimension")
        last = _medians(coded, {k: (r[f"{widest[k]}_lo"], r[f"{widest[k]}_hi"] + 1) for k, r in nodes.items()}, {k: r["n"] / 2 for k, r in nodes.items()})
        right = F.when(F.col("code") != F.col("split"), F.col("code") > F.col("split")).otherwise(F.col("tie") > F.col("last"))
        rows = cut(_beside(coded, last, "split long, last long").withColumn("node", F.col("node") * 2 + right.cast("int")).drop("code", "split", "last"))
    return rows


def sharded(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Per row its shard, and its slot in it: numbered from 0 within hash buckets of a shard, whose offsets come from their counts."""
    rows = tree(docs, shards).select("doc_id", "size", "text_crc32", F.col("node").cast("int").alias("shard"), "tie")
    n = max(1, -(-rows.count() // (shards * ROWS_A_SLOT_BUCKET)))
    rows = rows.withColumn("bucket", F.pmod("tie", F.lit(n)))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("tie", "doc_id")) - 1
    return rows.withColumn("nth", nth).join(offsets, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") + F.col("before")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_kd_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))
