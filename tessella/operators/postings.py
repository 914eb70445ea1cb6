"""An inverted index of the store's texts: BM25 by the postings of the asked terms alone.

A posting says how often a term stands in a row and how long that row's text is. Postings of a term lie in blocks of at most BLOCK, which
are cut from segments of the input: each task inverts some rows at a time, the ones with most weight first, so a term that stands in every
text is many blocks. The table is a parted one whose places are hashes of terms, so a query opens the files of its terms. A block knows its
greatest count and least length, which bound the score of every row in it: a search first scores the best blocks of each term, takes the
k-th best row as a threshold and reads no postings of blocks that cannot lead above it.

Every row with tokens has a posting of the term "" too, so numbers and lengths of rows are sums like any other. The mean inverse frequency
over all terms, which stands in for the negative ones of very common terms, is kept beside the table and counted anew when it changes."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import bm25_tokens
from tessella.operators.parts import PartedTable
from tessella.operators.retrieval import TOP_K

#: Postings of a block, tokens that are inverted at a time, blocks that go back to Spark at a time.
BLOCK, SEGMENT, SENT = 128, 4_000_000, 20_000
K1, B, EPSILON = 1.5, 0.75, 0.25
#: The term of every row that has tokens.
ALL = ""
SCHEMA = "term string, n int, most int, least int, ids array<string>, file_names array<string>, counts array<int>, lengths array<int>, file_name string"


def _inverted(ids: pa.Array, names: pa.Array, tokens: pa.Array) -> pa.RecordBatch:
    """The blocks of some rows, by term; of a term the postings with most weight first."""
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype("int64")
    words = pc.dictionary_encode(pc.list_flatten(tokens))
    terms, rows = len(words.dictionary), len(lengths)
    pairs, counts = np.unique(words.indices.to_numpy(zero_copy_only=False).astype("int64") * rows + np.repeat(np.arange(rows), lengths), return_counts=True)
    some = np.flatnonzero(lengths)  # rows with tokens have the term ALL too, whose number follows the others
    term, row = np.concatenate([pairs // rows, np.full(len(some), terms)]), np.concatenate([pairs % rows, some])
    counts = np.concatenate([counts, np.ones(len(some), "int64")])
    order = np.lexsort((lengths[row], -counts, term))
    term, row, counts = term[order], row[order], counts[order]
    size = lengths[row]
    first = np.flatnonzero(np.diff(term, prepend=-1))
    place = np.arange(len(term)) - np.repeat(first, np.diff(first, append=len(term)))
    start = np.flatnonzero(place % BLOCK == 0)
    reach = pa.array(np.append(start, len(term)).astype("int32"))
    held = names.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)[row]
    one = np.minimum.reduceat(held, start) == np.maximum.reduceat(held, start)

    def ints(values: np.ndarray) -> pa.Array:
        return pa.array(values.astype("int32"))

    def lists(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(reach, values)

    own, at = names.take(pa.array(row)), pa.array(term[start])
    many = np.repeat(~one, np.diff(start, append=len(term)))  # postings of blocks with more files than one
    named = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(one, 0, np.diff(start, append=len(term))))).astype("int32")), own.filter(pa.array(many)))
    return pa.RecordBatch.from_arrays([
        pa.concat_arrays([words.dictionary, pa.array([ALL], words.dictionary.type)]).take(at), ints(np.diff(start, append=len(term))), ints(np.maximum.reduceat(counts, start)), ints(np.minimum.reduceat(size, start)),
        lists(ids.take(pa.array(row))), pc.if_else(pa.array(one), None, named), lists(ints(counts)), lists(ints(size)), pc.if_else(pa.array(one), own.take(pa.array(start)), None),
    ], names=[c.split()[0] for c in SCHEMA.split(", ")])


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (id, file_name, tokens), inverted SEGMENT tokens at a time (or one row that has more). A block of one
    file has its file_name and no file_names, others the reverse."""
    held: list[pa.RecordBatch] = []
    n = 0

    def cut() -> Iterator[pa.RecordBatch]:
        columns = [pa.concat_arrays([b.column(c) for b in held]) for c in ("id", "file_name", "tokens")]
        made = _inverted(*columns)
        for lo in range(0, made.num_rows, SENT):
            yield made.slice(lo, SENT)

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy(zero_copy_only=False).astype("int64"))
        lo = before = 0
        while lo < batch.num_rows:
            hi = max(int(np.searchsorted(ends, before + SEGMENT - n, "right")), lo + (n == 0))
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
                n, before, lo = n + int(ends[hi - 1]) - before, int(ends[hi - 1]), hi
            if lo < batch.num_rows:  # the next row does not fit
                yield from cut()
                held, n = [], 0
    if held:
        yield from cut()


def _inverse(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


class Postings:
    """The index of rows (id, file_name, content); ids are strings and unique in a file."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, PartedTable(spark, path)

    def _each(self, state: dict, blocks: DataFrame) -> DataFrame:
        """The postings (term, id, file_name, count, length) of blocks, without those of deleted files."""
        one = F.explode(F.arrays_zip("ids", "file_names", "counts", "lengths"))
        named = blocks.withColumn("file_names", F.coalesce("file_names", F.array_repeat("file_name", F.col("n"))))
        flat = named.select("term", "_part", one.alias("p")).select("term", "_part", F.col("p.ids").alias("id"), F.col("p.file_names").alias("file_name"), F.col("p.counts").alias("count"), F.col("p.lengths").alias("length"))
        return self.table.present(state, flat)

    def _blocks(self, state: dict, terms: list[str] | None = None) -> DataFrame:
        """The blocks of some terms, or all; deleted files are left to _each()."""
        none = state | {"gone": []}
        if terms is None:
            return self.table.rows(none)
        places = [r["p"] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(F.xxhash64("t").alias("p")).collect()]
        return self.table.rows(none, places).where(F.col("term").isin(terms))

    def _frequencies(self, state: dict, blocks: DataFrame) -> DataFrame:
        """(term, df, length) of blocks: rows of each term and their tokens in all."""
        if not state["gone"]:
            total = F.when(F.col("term") == ALL, F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x))
            return blocks.groupBy("term").agg(F.sum("n").alias("df"), F.sum(total).alias("length"))
        return self._each(state, blocks).groupBy("term").agg(F.count("*").alias("df"), F.sum("length").alias("length"))

    def _mean(self, state: dict) -> float | None:
        """The mean inverse frequency over all terms."""
        found = self._frequencies(state, self._blocks(state))
        n = found.where(F.col("term") == ALL).select(F.col("df").alias("n"))
        return found.where(F.col("term") != ALL).join(F.broadcast(n)).agg(F.avg(_inverse(F.col("n"), F.col("df"))).alias("m")).first()["m"]  # n is one row

    def add(self, rows: DataFrame, notes: dict | None = None) -> None:
        """The blocks are written once as they are made: sorting them into ranges goes over its input twice, and over texts that takes long."""
        tokens = rows.select(F.col("id").cast("string").alias("id"), "file_name", bm25_tokens(F.coalesce("content", F.lit(""))).alias("tokens"))
        draft = PartedTable(self.spark, f"{self.table.path}/drafts/{uuid.uuid4().hex}")
        try:
            tokens.mapInArrow(blocks_of, SCHEMA).write.parquet(draft.path)
            made = self.spark.read.schema(SCHEMA).parquet(draft.path).withColumn("_place", F.xxhash64("term"))
            self._counted(self.table.add(self.table.state(), made, notes=notes))
        finally:
            draft.drop()

    def rebuild(self, rows: DataFrame, notes: dict | None = None) -> None:
        self.table.clear()
        self.add(rows, notes)

    def forget(self, file_name: str | None) -> None:
        state = self.table.state()
        if state["parts"]:
            self._counted(self.table.forget(state, file_name))

    def _counted(self, state: dict) -> None:
        self.table.publish(state | {"notes": state["notes"] | {"mean": self._mean(state)}})

    def clear(self) -> None:
        self.table.clear()

    def search(self, question: str, k: int | None = TOP_K) -> DataFrame | None:
        """(id, file_name, bm25_score) of the k best rows that hold an asked term, ties by id and file; with k None of all that hold one."""
        state = self.table.state()
        if state["schema"] is None or not state["parts"]:
            return None
        one = self.spark.range(1).select(bm25_tokens(F.lit(question)).alias("t")).first()  # the query's own words
        asked = Counter(one["t"])
        blocks = self._blocks(state, [ALL, *asked])
        known = {r["term"]: r for r in self._frequencies(state, blocks).collect()}  # a row a term
        none = self.spark.createDataFrame([], "id string, file_name string, bm25_score double")
        if ALL not in known or not asked.keys() & known.keys():
            return none
        n, mean_length, mean = known[ALL]["df"], known[ALL]["length"] / known[ALL]["df"], state["notes"]["mean"] or 0.0
        terms = [(t, float(times), float(n), float(known[t]["df"])) for t, times in asked.items() if t in known]
        raw = _inverse(F.col("n"), F.col("df"))
        weights = {r["term"]: r["w"] for r in self.spark.createDataFrame(terms, "term string, times double, n double, df double").select("term", (F.col("times") * F.when(raw >= 0, raw).otherwise(EPSILON * mean)).alias("w")).collect()}
        weight = F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("term"))

        def score(count: str, length: str) -> Column:
            return weight * F.col(count) * (K1 + 1) / (F.col(count) + K1 * (1 - B + B * F.col(length) / mean_length))

        held = blocks.where(F.col("term") != ALL)
        if k is not None and min(weights.values()) >= 0:
            held = self._promising(state, held, weights, score, k)
        found = self._each(state, held).groupBy("id", "file_name").agg(F.sum(score("count", "length")).alias("bm25_score"))
        return found if k is None else found.orderBy(F.desc("bm25_score"), "id", "file_name").limit(k)

    def _promising(self, state: dict, held: DataFrame, weights: dict[str, float], score, k: int) -> DataFrame:
        """The blocks whose rows may be among the k best: a row has at most its block's bound and the best of every other term. Scores are
        not negative here, so what a row gets from the best blocks alone is at most its score, and the k-th of those a threshold."""
        bounds = held.withColumn("bound", score("most", "least"))
        best = {r["term"]: r["b"] for r in bounds.groupBy("term").agg(F.max("bound").alias("b")).collect()}  # a row a term
        tops = [bounds.where(F.col("term") == t).orderBy(F.desc("bound")).limit(1 + k // BLOCK) for t in weights]
        seen = self._each(state, reduce(DataFrame.unionByName, tops))
        scored = seen.groupBy("id", "file_name").agg(F.sum(score("count", "length")).alias("s")).orderBy(F.desc("s")).limit(k).collect()  # k rows
        if len(scored) < k:
            return held
        least, others = scored[-1]["s"], sum(best.values())
        rest = F.element_at(F.create_map(*[F.lit(x) for t, b in best.items() for x in (t, others - b)]), F.col("term"))
        return bounds.where(F.col("bound") + rest >= least * (1 - 1e-12)).drop("bound")

