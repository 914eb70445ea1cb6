"""SpotSigs document fingerprints, with DataFrame functions only.

A signature is an anchor (a common word) with the chain of the next two content words after it; common words between them, at most
SKIP at a time, are passed over. Where no common word stood among the last STRETCH words, a word is its own anchor, so that every part
of a text reaches its fingerprint, listings without common words included. A document's fingerprint is the set of its signatures. Two
fingerprints can reach Jaccard t only if the smaller has at least t times the elements of the larger, so sets are dealt into
partitions by length, and a pair is looked at only where its lengths and its shared rare signatures allow it.

Null texts count as empty. A text without a signature takes all its words as one; a text without words has the empty fingerprint. Two
empty fingerprints have likeness 1. Rows that repeat are kept as they come; rows that share a doc_id follow each other by a hash of their
texts and the texts. A successor's text is found in ranges of doc_id of about ROWS_A_BUCKET rows, at most MOST_BUCKETS; beyond 80 million
rows the ranges grow with the table, each sorted by a task of its own, which can spill. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.shared import cut, only, table

#: Common words of English, German, French and Spanish: the anchors.
ANCHORS = (
    "a an and are as at be by for from had has have he her his in is it its not of on or she that the their they this to was were which with you "
    "auf aus bei das dem den der des die ein eine einer es für ist mit nicht sich sie und von war wie zu zum "
    "au aux ce dans de du elle en est et il je la le les leur mais ne ou par pas plus pour que qui sa se son sont sur un une "
    "al como con del el era ha las lo los más no para pero por su una y"
).split()
CHAIN = 2
#: Anchors that may stand before each content word of a chain; words without an anchor after which a word is its own.
SKIP, STRETCH = 4, 8
#: Rows that lie together when a document meets its successor.
ROWS_A_BUCKET = 2000
MOST_BUCKETS = 40_000


def signatures(text: Column, anchors: list[str] = ANCHORS, skip: int = SKIP, stretch: int = STRETCH) -> Column:
    """The sorted distinct signatures of a text, each as a 32-bit hash of its anchor and chain."""

    def hashed(*words: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(*words), 32)

    def spots(held: Column) -> Column:
        words, common = held["words"], held["common"]

        def ahead(i: Column) -> Column:
            """How many words after i the next content word stands; 0 where none is within reach."""
            return F.array_position(F.slice(common, i + 2, F.lit(skip + 1)), False).cast("int")

        def chain(word: Column, i: Column) -> Column:
            def second(one: Column) -> Column:
                two = ahead(i + one)
                return F.when((one > 0) & (two > 0), hashed(word, F.get(words, i + one), F.get(words, i + one + two)))

            return F.transform(F.array(ahead(i)), second)[0]

        def spot(word: Column, i: Column) -> Column:
            first = F.greatest(F.lit(0), i - (stretch - 1))
            bare = ~F.array_contains(F.slice(common, first + 1, i - first + 1), True)
            return F.when(F.get(common, i) | bare, chain(word, i))

        return F.array_compact(F.transform(words, spot))

    def whole(words: Column) -> Column:
        return F.when(F.size(words) > 0, F.array(hashed(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))

    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]++"), F.lit(0))
    marked = F.transform(F.array(words), lambda w: F.struct(w.alias("words"), F.transform(w, lambda x: x.isin(anchors)).alias("common")))
    pair = F.transform(marked, lambda m: F.struct(m["words"].alias("words"), spots(m).alias("spots")))
    return F.transform(pair, lambda p: F.sort_array(F.array_distinct(F.when(F.size(p["spots"]) > 0, p["spots"]).otherwise(whole(p["words"])))))[0]


def shown(signatures: Column) -> Column:
    """A fingerprint as text: eight hexadecimal digits for each signature, ascending."""
    return F.array_join(F.transform(signatures, lambda s: F.lpad(F.lower(F.hex(s)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signature sets; sets of which one is empty are settled by length, without comparing."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most key, less one and at least 0: a search in two steps of about the square root each."""
    if len(bounds) <= 1:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.lit([b[0] for b in blocks])
    inner = F.array(*[F.lit(b) for b in blocks])
    block = F.greatest(F.size(F.filter(heads, lambda b: b <= key)), F.lit(1))
    return F.greatest(F.lit(0), (block - 1) * step + F.size(F.filter(F.element_at(inner, block), lambda b: b <= key)) - 1)


def _narrow(sigs: Column) -> Column:
    """Signatures as 32-bit integers of the same order, for the shuffle."""
    return F.transform(sigs, lambda s: (s - F.lit(2**31)).cast("int"))


def _wide(sigs: Column) -> Column:
    return F.transform(sigs, lambda s: s.cast("bigint") + F.lit(2**31))


def with_next(docs: DataFrame, rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """Each row with next, its successor by (doc_id, text) around the table's end; columns doc_id, text, sigs.

    Buckets are ranges of doc_id between its quantiles. The first id of each bucket also goes to the bucket
    before, where only its text is looked at; so no range needs to see another. A null doc_id counts as lowest.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    low = F.lit(-(2**63))
    key = F.coalesce("doc_id", low)
    rows = docs.count()
    if not rows:
        return docs.select("doc_id", "text", signatures(F.col("text")).alias("sigs"), F.struct("text", signatures(F.col("text")).alias("sigs")).alias("next"))
    n = min(MOST_BUCKETS, max(1, -(-rows // rows_a_bucket)))
    found = docs.agg(F.min(key).alias("low"), F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], max(10_000, 10 * n)).alias("at")).first()
    bounds = sorted({found["low"], *(found["at"] if n > 1 else [])})
    bucket, last = _bucket(key, bounds), len(bounds) - 1
    firsts = F.array(*map(F.lit, bounds))
    here = docs.withColumn("bucket", bucket).select("*", _narrow(signatures(F.col("text"))).alias("sigs"))
    places = F.when(F.element_at(firsts, F.col("bucket") + 1) == key, F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("ghost")), F.struct(F.when(F.col("bucket") == 0, last).otherwise(F.col("bucket") - 1).alias("b"), F.lit(1).alias("ghost")))).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("ghost"))))
    from pyspark.sql import Window

    order = Window.partitionBy("b").orderBy("ghost", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    return here.withColumn("place", F.explode(places)).select("doc_id", "text", "sigs", "place.b", "place.ghost").withColumn("next", F.lead(F.struct("text", "sigs")).over(order)).where("ghost = 0").select("doc_id", "text", _wide(F.col("sigs")).alias("sigs"), F.struct("next.text", _wide(F.col("next.sigs")).alias("sigs")).alias("next"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: its fingerprint, that of its edited text (the end replaced by the next text's start), and both likenesses."""
    halves = with_next(only(docs, "doc_id", "text")).withColumn("n", F.length("text")).withColumn("half", F.expr("n div 2"))
    edited = F.concat(F.expr("substring(text, 1, n - half)"), F.expr("substring(next.text, 1, half)"))
    both = halves.withColumn("edited", edited).withColumn("esigs", signatures(F.col("edited")))
    return both.select(
        "doc_id",
        F.col("n").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown(F.col("sigs")).alias("fingerprint"),
        shown(F.col("esigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("esigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next.sigs")).alias("near_next"),
    )


def similar_pairs(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Pairs of different fingerprints with Jaccard of threshold or more, as (doc_a, doc_b, likeness); doc_a and doc_b stand for
    all rows with the same fingerprint, each by its smallest doc_id (see classes()).

    Sets go to partitions by length; within one, a pair must share a signature of both prefixes, in the order of rarity, and the
    pair of lengths must allow the threshold. Signatures in the prefix are the rarest, so a passage that many share makes no pairs.
    """
    sets = classes(docs).where(F.size("sigs") > 0).groupBy("sigs").agg(F.min("class_id").alias("id"))
    sets = cut(sets.select("id", "sigs", F.size("sigs").alias("n")))
    rarity = sets.select("id", "n", F.explode("sigs").alias("s")).groupBy("s").agg(F.count("*").alias("df"))
    ranked = sets.select("id", "n", F.explode("sigs").alias("s")).join(rarity, "s")
    prefix = F.slice(F.array_sort(F.collect_list(F.struct("df", "s"))), F.lit(1), F.first("n") - F.ceil(F.first("n") * threshold - 1e-9).cast("int") + 1)
    rare = ranked.groupBy("id").agg(F.first("n").alias("n"), prefix.alias("p")).select("id", "n", F.explode("p").alias("p")).select("id", "n", F.col("p.s").alias("s"))
    band = F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold) + 1e-9)
    left = rare.withColumn("band", band)
    right = left.select(F.col("id").alias("id_b"), F.col("n").alias("n_b"), "s", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"))
    close = left.join(right, ["band", "s"]).where("id_b <> id and n_b >= n and (n_b > n or id_b > id)").where(F.col("n") >= F.col("n_b") * threshold - 1e-9).select("id", "id_b").distinct()
    a, b = sets.select("id", F.col("sigs").alias("a")), sets.select(F.col("id").alias("id_b"), F.col("sigs").alias("b"))
    out = close.join(a, "id").join(b, "id_b").withColumn("likeness", likeness(F.col("a"), F.col("b"))).where(F.col("likeness") >= threshold)
    return out.select(F.least("id", "id_b").alias("doc_a"), F.greatest("id", "id_b").alias("doc_b"), "likeness")


def classes(docs: DataFrame) -> DataFrame:
    """Each distinct fingerprint once: class_id (the smallest doc_id that has it), its signatures and the number of rows."""
    held = only(docs, "doc_id", "text").select("doc_id", signatures(F.col("text")).alias("sigs"))
    return held.groupBy("sigs").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("rows"))


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


__all__ = ["classes", "fingerprints", "likeness", "op1_spotsigs", "shown", "signatures", "similar_pairs", "with_next"]
