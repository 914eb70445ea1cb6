"""Which filters of a corpus do each other's work: every order of five filters, audited over a lattice of filter sets.

A document fails some of the filters: that set is its mask. Before a filter is applied, some subset of the others has been; such a (subset
already applied, next filter) pair is an edge of the lattice of subsets, 80 in all, and what the filter does there depends on the mask
alone. Documents are counted by part, mask and labels first, so that 32 masks a part reach the edges, whatever the corpus; an order of
filters is a path of five edges, so joining the counted edges to the 600 steps of the 120 orders gives the audit without going over the
documents again.

Filters: A too few words, B too few distinct words, C too many capitals, D marks of markup or code, E the text of a document with a smaller
doc_id. Words are runs of anything but ASCII white space, case-sensitive.

Null and empty texts count as empty: they fail A, and E where an earlier one exists; B and C need words and characters to fail. A null
source is the part of the empty string. A null doc_id has no smaller one, is smaller than none and has no labels. Rows that repeat count as
often, and none of them is before the other. Labels that repeat count once: a document is good or toxic if any of its labels says so. Very
long texts are read whole. An empty table gives no rows. Other columns are ignored.

Texts are read once, for counts and a 256-bit digest that stands for the text; the first document of each text is then found by aggregation
over digests and meets its rows by doc_id and digest, so that a text that many documents share is no key of many rows. Nothing that grows with
the tables goes to the driver.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.shared import cut, only, table

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 50, 65, 5, "[#$%&*|]"


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask) of docs (doc_id, text, source): mask holds filters A to D, which depend on the text alone."""
    held = only(docs, "doc_id", "text", "source").select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    read = held.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    n, capitals = F.size("words"), F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    fails = [n < LEAST_WORDS, 100 * F.size(F.array_distinct("words")) < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * F.length("text"), F.col("text").rlike(MARKS)]
    mask = reduce(Column.__add__, [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)])
    return read.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), mask.alias("mask"))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail just those filters, and how many of them carry each label. All joins
    are by key: what they join grows with the documents, so that it may not be broadcast. No key is frequent in them, as rows that repeat
    are counted before they are joined."""
    rows = cut(judged(docs))
    alike = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "digest", F.lit(True).alias("first"))
    again = F.col("doc_id").isNotNull() & F.col("first").isNull()
    full = alike.join(firsts.hint("merge"), ["doc_id", "digest"], "left").withColumn("mask", F.col("mask") + F.when(again, 1 << FILTERS.index("E")).otherwise(0))
    marked = only(labels, "doc_id", "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "bad"))])
    known = full.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).join(marked.where("good or bad").hint("merge"), "doc_id", "left")
    return known.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(name) for c, name in (("good", "good"), ("bad", "toxic"))])


def edges(counts: DataFrame) -> DataFrame:
    """What the next filter does after each subset of the others: 80 rows a part, from its at most 32 masks."""
    pairs = [(s, f) for f in range(len(FILTERS)) for s in range(1 << len(FILTERS)) if not s >> f & 1]
    ways = {s: factorial(bin(s).count("1")) * factorial(len(FILTERS) - 1 - bin(s).count("1")) for s, _ in pairs}  # orders through the edge
    every = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(1 << f).alias("next"), F.lit(ways[s]).alias("ways")) for s, f in pairs])
    each = counts.withColumn("edge", F.explode(every)).select("*", "edge.*")
    alive, fails = F.col("mask").bitwiseAND(F.col("applied")) == 0, F.col("mask").bitwiseAND(F.col("next")) != 0

    def total(column: str, when: Column, name: str) -> Column:
        return F.sum(F.when(when, F.col(column)).otherwise(0)).alias(name)

    sums = each.groupBy("part", "applied", "next", "ways").agg(
        total("n", alive & ~fails, "kept"), total("n", alive & fails, "removed"), total("n", ~alive & fails, "redundant"), total("n", F.col("mask") == F.col("next"), "unique_fails"),
        total("good", alive & fails, "good_lost"), total("toxic", alive & fails, "toxic_lost"),
    )
    return sums.withColumn("shapley", F.sum(F.col("removed") * F.col("ways")).over(Window.partitionBy("part", "next"))).drop("ways")


def steps(spark: SparkSession) -> DataFrame:
    """(filter_order, step, applied, next) of every order: five edges a path."""
    paths = [("".join(p), i + 1, sum(1 << FILTERS.index(x) for x in p[:i]), 1 << FILTERS.index(p[i])) for p in permutations(FILTERS) for i in range(len(p))]
    return spark.createDataFrame(paths, "filter_order string, step int, applied int, next int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order and step: the documents kept, removed, failing but gone before, failing nothing else, losses by label, and the
    filter's removals over all orders."""
    found = edges(masks(docs, labels)).join(F.broadcast(steps(docs.sparkSession)), ["applied", "next"])  # 600 rows
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Every order is walked over the documents themselves: a filter removes what fails it and failed none before it.
ORACLE_SQL = r"""
WITH held AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), marked AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id
), docs AS (
  SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
    (CASE WHEN len(words) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN held.doc_id > min(held.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails
  FROM held LEFT JOIN marked ON held.doc_id = marked.doc_id
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE b.x <> a.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)
), steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, CAST(step AS INTEGER), 1) AS own, '[' || substr(filter_order, 1, CAST(step AS INTEGER) - 1) || '0]' AS before FROM orders, range(1, 6) AS r(step)
), walked AS (
  SELECT part, filter_order, step, own, good, bad, contains(fails, own) AS failing, regexp_matches(fails, before) AS gone, fails = own AS alone FROM docs, steps
), counted AS (
  SELECT part, filter_order, step, own, count(*) FILTER (NOT gone AND NOT failing) AS kept, count(*) FILTER (NOT gone AND failing) AS removed, count(*) FILTER (gone AND failing) AS redundant,
    count(*) FILTER (alone) AS unique_fails, count(*) FILTER (NOT gone AND failing AND good) AS good_lost, count(*) FILTER (NOT gone AND failing AND bad) AS toxic_lost
  FROM walked GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM counted
"""
