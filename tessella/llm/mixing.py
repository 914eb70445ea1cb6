"""Mixing sources to target weights by Pareto order sampling.

A document's size is its number of words. Sources in code point order, null last, weigh 5, 2, 1, repeating; they share the sum of all
sizes by weight, and a target stops at MOST times its source's size, the excess reshared by weight until none is above.

Within a source, a document's expected copies are in proportion to its measure, the number of binary digits of its size (so a longer
text counts for more, but far less than in proportion), and at most MOST; the proportion is the one at which the expected words meet the
target. It is found from the sums of sizes by (source, measure), at most 63 rows a source. The whole part of the expected copies is
allocated for certain; the fraction is the document's inclusion probability p of one copy more. With u uniform from a hash of the
document, documents are ranked by Pareto odds [u / (1 - u)] / [p / (1 - p)], whatever their measure, and taken from the smallest on while
the words still to take last; the first that does not fit ends the run, and the largest of the later ones that fits the remainder
closes it. The end of the run is searched by sums over 4,096 ranges of the odds and again within the range where it lies, so no source
is gathered in one task; what a row needs to be judged (its source's target, probabilities and end) is one row a source.

Null texts and texts without words have size 0 and are never taken; a source without words has target 0. The hash covers doc_id and text,
so rows that repeat in full, and only they, share u: they are taken or left together. An empty table gives no rows. Other columns pass
through mix() untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.shared import beside, cut, only, table, unit

WEIGHTS = (5, 2, 1)
MOST = 3
#: Bits of the odds' place in (0, 1), and how many of them a step of the search settles.
PLACE_BITS, STEP_BITS = 48, 12
#: Rows of a source that may be put in order in one task, where the run ends.
EDGE_ROWS = 20_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]++")), F.lit(0)).cast("bigint")


def _level(parts: DataFrame, by: list[str], total: Column, order: Column) -> DataFrame:
    """parts (w, cap) with level: what a unit of w gets where total is shared by w under the caps; null where all are capped.

    Sorted by cap over w, the capped parts come first; the first whose cap is above its share of what is left ends them."""
    held = parts.withColumn("need", F.col("cap") / F.col("w"))
    up = Window.partitionBy(*by).orderBy("need", order)
    before = F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    shared = held.withColumn("share", (total - before) / F.sum("w").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    least = F.min(F.when(F.col("need") > F.col("share"), F.struct("need", order.alias("o"), "share"))).over(Window.partitionBy(*by))
    return shared.withColumn("level", least["share"]).drop("need", "share")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target from (source, source_size)."""
    by_name = F.col("source").asc_nulls_last()
    nth = F.row_number().over(Window.orderBy(by_name))
    ordered = sizes.withColumn("place", nth).withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights)) + 1))
    ordered = ordered.withColumn("cap", most * F.col("source_size").cast("double"))
    leveled = _level(ordered, [], F.sum("source_size").over(Window.partitionBy()).cast("double"), F.col("place"))
    return leveled.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w"))).alias("target"))


def _sized(docs: DataFrame, seed: str, carried: list[str]) -> DataFrame:
    """docs (doc_id, text, source) as key (the source's name), k (the measure), size and u."""
    known = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    held = docs.withColumns({"key": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), "size": words(F.col("text")), "u": unit(known, seed)})
    return held.withColumn("k", F.length(F.bin("size"))).select(*carried, "source", "key", "k", "size", "u")


def odds(u: Column, p: Column) -> Column:
    return (u / (1 - u)) / (p / (1 - p))


def _after(left: tuple[str, str], right: tuple[str, str]) -> Column:
    return (F.col(left[0]) > F.col(right[0])) | ((F.col(left[0]) == F.col(right[0])) & (F.col(left[1]) > F.col(right[1])))


def aims(held: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Per key: source_size, target, rest (words left to the draw), and by measure the whole copies and the probability of one more."""
    sums = cut(held.groupBy("source", "key", "k").agg(F.sum("size").alias("n")))
    by_source = sums.groupBy("source", "key").agg(F.sum("n").alias("source_size"))
    named = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key")
    wanted = cut(targets(by_source.select("source", "source_size"), weights, most).select(named, "source_size", "target"))
    parts = sums.where("n > 0").select("key", "k", "n").join(wanted, "key").withColumns({"w": F.col("k") * F.col("n").cast("double"), "cap": most * F.col("n").cast("double")})
    expected = F.when(F.col("level").isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.col("level") * F.col("k")))
    leveled = _level(parts, ["key"], F.col("target"), F.col("k")).withColumn("e", expected).withColumn("whole", F.floor(F.col("e") + 1e-9).cast("int"))
    leveled = leveled.withColumn("p", F.when(F.col("e") - F.col("whole") > 1e-9, F.col("e") - F.col("whole")).otherwise(0.0))
    by_key = leveled.groupBy("key").agg(F.sum(F.col("whole") * F.col("n")).alias("sure"), F.map_from_entries(F.collect_list(F.struct("k", F.struct("whole", "p")))).alias("chances"))
    rest = F.greatest(F.lit(0.0), F.col("target") - F.coalesce("sure", F.lit(0)))
    return cut(wanted.join(by_key, "key", "left").select("key", "source_size", "target", rest.alias("rest"), "chances"))


def _chanced(rows: DataFrame, aimed: DataFrame) -> DataFrame:
    """rows with their source's aims, whole, p and, where p is above 0, q."""
    chance = F.when(F.col("size") > 0, F.element_at("chances", F.col("k")))
    made = beside(rows, aimed, "key").withColumns({"whole": F.coalesce(chance["whole"], F.lit(0)), "p": F.coalesce(chance["p"], F.lit(0.0))}).drop("chances")
    return made.withColumn("q", F.when(F.col("p") > 0, odds(F.col("u"), F.col("p"))))


def ends(drawn: DataFrame, most_rows: int = EDGE_ROWS) -> DataFrame:
    """Per key where the run of drawn (key, size, u, q, rest) ends: the first (q, u) that does not fit, and the one that closes it."""
    drawn = drawn.withColumn("v", F.floor(F.col("q") / (1 + F.col("q")) * float(2**PLACE_BITS)))
    here, shift, found = drawn.withColumn("before", F.lit(0).cast("bigint")), PLACE_BITS, None
    while True:
        shift -= STEP_BITS
        bins = here.groupBy("key", F.shiftright("v", shift).alias("bin")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.first("before").alias("before"), F.first("rest").alias("rest"))
        upto = F.col("before") + F.sum("n").over(Window.partitionBy("key").orderBy("bin"))
        passed = bins.withColumn("upto", upto).where("upto > rest").groupBy("key").agg(F.min(F.struct("bin", (F.col("upto") - F.col("n")).alias("before"), "rows")).alias("e"))
        found = cut(passed.select("key", F.col("e.bin").alias("end"), F.col("e.before").alias("before"), F.col("e.rows").alias("rows")))
        here = beside(drawn, found.drop("rows"), "key", "inner").where(F.shiftright("v", shift) == F.col("end")).drop("end")
        if shift == 0 or (found.agg(F.max("rows")).first()[0] or 0) <= most_rows:
            break
    alike = here.groupBy("key", "q", "u").agg(F.sum("size").alias("s"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    upto = F.col("before") + F.sum("s").over(Window.partitionBy("key").orderBy("q", "u"))
    edge = alike.withColumn("upto", upto).where("upto > rest").groupBy("key").agg(F.min(F.struct("q", "u", (F.col("rest") - F.col("upto") + F.col("s")).alias("room"))).alias("e"))
    edge = cut(edge.select("key", F.col("e.q").alias("edge_q"), F.col("e.u").alias("edge_u"), F.col("e.room").alias("room")))
    later = beside(drawn, edge, "key", "inner").where(~_after(("edge_q", "edge_u"), ("q", "u"))).where("size <= room").groupBy("key", "q", "u").agg(F.sum("size").alias("s"), F.first("room").alias("room"))
    close = later.where("s <= room").groupBy("key").agg(F.max(F.struct("s", (-F.col("q")).alias("q"), (-F.col("u")).alias("u"))).alias("c"))
    return cut(edge.drop("room").join(close.select("key", (-F.col("c.q")).alias("close_q"), (-F.col("c.u")).alias("close_u")), "key", "left"))


def _judged(rows: DataFrame, aimed: DataFrame, ended: DataFrame) -> DataFrame:
    """rows (key, k, size, u) with source_size, target and copies."""
    seen = beside(_chanced(rows, aimed), ended, "key")
    run = F.col("edge_q").isNull() | _after(("edge_q", "edge_u"), ("q", "u"))
    closing = F.coalesce((F.col("q") == F.col("close_q")) & (F.col("u") == F.col("close_u")), F.lit(False))
    return seen.withColumn("copies", F.col("whole") + (F.col("q").isNotNull() & (run | closing)).cast("int"))


def _planned(docs: DataFrame, weights: tuple[int, ...], most: int, seed: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents (doc_id, source, key, k, size, u), written, and the two tables by which their rows are judged."""
    held = cut(_sized(only(docs, "doc_id", "text", "source"), seed, ["doc_id"]))
    aimed = aims(held, weights, most)
    return held, aimed, ends(_chanced(held, aimed).where("q is not null").select("key", "size", "u", "q", "rest"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken."""
    held, aimed, ended = _planned(docs, weights, most, seed)
    return _judged(held, aimed, ended).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Texts are not shuffled: each row is judged where it lies."""
    _, aimed, ended = _planned(docs, weights, most, seed)
    named = {c.lower(): c for c in docs.columns}
    known = [F.col(f"`{named[c]}`").alias(c) if c in named else F.lit(None).cast("string").alias(c) for c in ("doc_id", "text", "source")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *known)
    out = _judged(_sized(rows, seed, ["row"]), aimed, ended).where("copies > 0")
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op4_pareto_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


#: The same rows in DuckDB's SQL.
ORACLE_SQL = r"""
WITH held AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM held GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
                   row_number() OVER (ORDER BY source NULLS LAST) AS place, 3.0::DOUBLE * source_size AS cap FROM sizes),
shares AS (
  SELECT *, cap / w AS need, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM weighed),
aims AS (
  SELECT source, source_size, CASE WHEN l.level IS NULL THEN cap ELSE least(cap, l.level * w) END AS target
  FROM shares, (SELECT arg_min(share, need) AS level FROM shares WHERE need > share) AS l),
parts AS (
  SELECT h.source, length(bin(h.size)) AS k, sum(h.size)::BIGINT AS n, any_value(a.target) AS target
  FROM held h JOIN aims a ON h.source IS NOT DISTINCT FROM a.source WHERE h.size > 0 GROUP BY h.source, length(bin(h.size))),
part_shares AS (
  SELECT *, (3.0::DOUBLE * n) / (k * n::DOUBLE) AS need,
         (target - coalesce(sum(3.0::DOUBLE * n) OVER (PARTITION BY source ORDER BY (3.0::DOUBLE * n) / (k * n::DOUBLE), k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(k * n::DOUBLE) OVER (PARTITION BY source ORDER BY (3.0::DOUBLE * n) / (k * n::DOUBLE), k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM parts),
levels AS (SELECT source, arg_min(share, need) FILTER (WHERE need > share) AS level FROM part_shares GROUP BY source),
expected AS (
  SELECT p.source, p.k, p.n, p.target, CASE WHEN l.level IS NULL THEN 3.0::DOUBLE ELSE least(3.0::DOUBLE, l.level * p.k) END AS e
  FROM part_shares p JOIN levels l ON p.source IS NOT DISTINCT FROM l.source),
chances AS (
  SELECT *, floor(e + 1e-9::DOUBLE)::INT AS whole,
         CASE WHEN e - floor(e + 1e-9::DOUBLE) > 1e-9::DOUBLE THEN e - floor(e + 1e-9::DOUBLE) ELSE 0.0::DOUBLE END AS p FROM expected),
rests AS (SELECT source, greatest(0.0::DOUBLE, any_value(target) - sum(whole * n)::BIGINT) AS rest FROM chances GROUP BY source),
ranked AS (
  SELECT h.source, h.u, sum(h.size)::BIGINT AS s, any_value((h.u / (1 - h.u)) / (c.p / (1 - c.p))) AS q, any_value(r.rest) AS rest
  FROM held h JOIN chances c ON h.source IS NOT DISTINCT FROM c.source AND length(bin(h.size)) = c.k JOIN rests r ON h.source IS NOT DISTINCT FROM r.source
  WHERE h.size > 0 AND c.p > 0 GROUP BY h.source, h.u),
summed AS (SELECT *, sum(s) OVER (PARTITION BY source ORDER BY q, u ROWS UNBOUNDED PRECEDING) AS upto FROM ranked),
cutoff AS (SELECT source, min(upto) AS at, arg_min(rest - upto + s, upto) AS room FROM summed WHERE upto > rest GROUP BY source),
marked AS (
  SELECT s.*, (c.at IS NULL OR s.upto < c.at) AS run, (c.at IS NOT NULL AND s.upto >= c.at AND s.s <= c.room) AS fits
  FROM summed s LEFT JOIN cutoff c ON s.source IS NOT DISTINCT FROM c.source),
closing AS (SELECT *, row_number() OVER (PARTITION BY source, fits ORDER BY s DESC, q, u) AS nth FROM marked),
extras AS (SELECT source, u FROM closing WHERE run OR (fits AND nth = 1))
SELECT h.doc_id, h.size, a.source_size, a.target,
       h.size * (coalesce(c.whole, 0) + CASE WHEN x.u IS NOT NULL AND h.size > 0 THEN 1 ELSE 0 END) AS taken
FROM held h
JOIN aims a ON h.source IS NOT DISTINCT FROM a.source
LEFT JOIN chances c ON h.source IS NOT DISTINCT FROM c.source AND length(bin(h.size)) = c.k AND h.size > 0
LEFT JOIN extras x ON h.source IS NOT DISTINCT FROM x.source AND h.u = x.u
"""
