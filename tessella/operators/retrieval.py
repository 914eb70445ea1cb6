"""Vector search, neighbours of hits, BM25, rank fusion and re-ranking, for one query or many."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import bm25_tokens, page_range, preview, with_context
from tessella.operators.store import workspace

TOP_K, MOST_K, TOP_M, RRF_K, PER_FILE, FINAL_K = 20, 50, 30, 60, 3, 12


def distance(a: Column, b: Column, metric: str = "l2sq") -> Column:
    zero = F.lit(0.0)
    if metric == "l2sq":
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), zero, lambda s, x: s + x)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), zero, lambda s, v: s + v)
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def top_k(vectors: DataFrame, query: list[float], k: int = TOP_K, metric: str = "l2sq", min_similarity: float = 0.0) -> DataFrame:
    """The k nearest (id, embedding) of one query, with similarity and rank; the threshold holds after the limit."""
    q = F.array(*[F.lit(float(x)) for x in query])
    near = vectors.withColumn("distance", distance(F.col("embedding"), q, metric)).orderBy("distance", "id").limit(min(k, MOST_K))
    ranked = near.withColumn("vector_rank", F.row_number().over(Window.orderBy("distance", "id"))).withColumn("similarity", F.greatest(F.lit(0.0), 1 - F.col("distance")))
    return ranked.where(F.col("similarity") >= min_similarity)


def top_k_batch(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, block: int = 4096, query_block: int = 1024) -> DataFrame:
    """The k nearest of (id, embedding) for every row of queries (query_id, embedding), exactly: blocks of vectors meet blocks of
    queries, each pair of blocks gives k rows a query at most, and a window merges them."""
    counts = [max(1, -(-d.count() // n)) for d, n in ((vectors, block), (queries, query_block))]
    left = vectors.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(counts[0])).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(counts[1] - 1))).alias("q"))
    right = queries.select("query_id", F.col("embedding").alias("asked"), F.pmod(F.xxhash64("query_id"), F.lit(counts[1])).cast("int").alias("q"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(counts[0] - 1).cast("bigint"))).alias("b"))

    def near(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "id": np.empty(0, np.int64), "distance": np.empty(0)})
        x, ids, names = np.stack(rows["embedding"].to_numpy()).astype(float), rows["id"].to_numpy(), asked["query_id"].to_numpy()
        q, norms, out = np.stack(asked["asked"].to_numpy()).astype(float), (x**2).sum(1), []
        for lo in range(0, len(q), 128):
            part = q[lo : lo + 128]
            size = (part**2).sum(1)[:, None]
            close = norms + size - 2 * part @ x.T  # up to rounding, for which the slack below allows
            edge = np.partition(close, min(k, len(x)) - 1, 1)[:, min(k, len(x)) - 1, None]
            for i, maybe in enumerate(close <= edge + 1e-9 * (norms.max() + size)):
                at = np.flatnonzero(maybe)
                d = ((x[at] - part[i]) ** 2).sum(1)
                best = np.lexsort((ids[at], d))[:k]
                out.append((np.full(len(best), names[lo + i]), ids[at][best], d[best]))
        return pd.DataFrame({n: np.concatenate([o[i] for o in out]) for i, n in enumerate(("query_id", "id", "distance"))})

    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInPandas(near, "query_id long, id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("vector_rank", rank).where(F.col("vector_rank") <= k)


def neighbours(hits: DataFrame, chunks: DataFrame, window: int = 2) -> DataFrame:
    """Every hit (doc_id, chunk_index) with each chunk of its document at most window places away."""
    other = chunks.select(*[F.col(c).alias(f"n_{c}") for c in chunks.columns])
    return hits.join(other, (F.col("doc_id") == F.col("n_doc_id")) & F.col("n_chunk_index").between(F.greatest(F.lit(0), F.col("chunk_index") - window), F.col("chunk_index") + window))


def expanded(hits: DataFrame, chunks: DataFrame, window: int = 2) -> DataFrame:
    """Each chunk near some hit, once."""
    h = hits.select(F.col("doc_id").alias("h_doc"), F.col("chunk_index").alias("h_index"))
    return chunks.join(h, (F.col("doc_id") == F.col("h_doc")) & F.col("chunk_index").between(F.col("h_index") - window, F.col("h_index") + window), "left_semi")


def bm25(candidates: DataFrame, query: str, stopwords: list[str] | None = None, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """candidates (id, content) with bm25_score; statistics over the candidates that have tokens. Others score 0.

    Texts are tokenised twice: for document frequencies, combined before the shuffle and written to the workspace with the number and
    lengths of all documents as the null term, and for the scores, where each text lies; the statistics are one row."""
    spark = candidates.sparkSession
    one = spark.range(1).select(bm25_tokens(F.lit(query), stopwords).alias("t")).first()  # the query's own words
    asked = Counter(one["t"])
    held = candidates.withColumn("_tokens", bm25_tokens(F.coalesce("content", F.lit("")), stopwords))
    terms = held.where(F.size("_tokens") > 0).select(F.explode(F.concat(F.array_distinct("_tokens"), F.array(F.lit(None).cast("string")))).alias("term"), F.size("_tokens").alias("n"))
    path = workspace(spark)
    terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("n")).write.parquet(path)
    counts = spark.read.schema("term string, df long, n long").parquet(path)
    whole = counts.where("term is null").agg(F.max("df").alias("_n"), (F.max("n") / F.max("df")).alias("_avgdl"))
    df = counts.where("term is not null").select("term", "df")
    raw = F.log(F.col("_n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    each = [F.max(F.when(F.col("term") == t, raw)).alias(f"_raw{i}") for i, t in enumerate(asked)]
    stats = df.join(F.broadcast(whole)).agg(F.avg(raw).alias("_mean"), F.max("_avgdl").alias("_avgdl"), *each)

    def score(tokens: Column) -> Column:
        total, norm = F.lit(0.0), k1 * (1 - b + b * F.size(tokens) / F.col("_avgdl"))
        for i, (t, times) in enumerate(asked.items()):
            idf = F.when(F.col(f"_raw{i}") >= 0, F.col(f"_raw{i}")).otherwise(epsilon * F.col("_mean"))
            tf = F.size(tokens) - F.size(F.array_remove(tokens, t))
            total = total + F.when(F.col(f"_raw{i}").isNotNull() & (tf > 0), times * idf * tf * (k1 + 1) / (tf + norm)).otherwise(0.0)
        return total

    return held.join(F.broadcast(stats)).withColumn("bm25_score", score(F.col("_tokens"))).select(*candidates.columns, "bm25_score")


def bm25_many(candidates: DataFrame, queries: DataFrame, stopwords: list[str] | None = None, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """candidates (query_id, id, content) with bm25_score, by the statistics of each query's own candidates, which are a bounded list;
    queries: (query_id, text). Candidates are computed and shuffled once: all aggregations are by query_id, as the rows then lie."""
    held = candidates.withColumn("_tokens", bm25_tokens(F.coalesce("content", F.lit("")), stopwords)).repartition("query_id")
    asked = queries.select("query_id", F.explode(bm25_tokens(F.col("text"), stopwords)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    sizes = held.where(F.size("_tokens") > 0).groupBy("query_id").agg(F.count("*").alias("n"), F.avg(F.size("_tokens")).alias("_avgdl"))
    terms = held.select("query_id", F.explode(F.array_distinct("_tokens")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("df"))
    known = terms.join(sizes, "query_id").join(asked, ["query_id", "term"], "left").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    stats = known.groupBy("query_id").agg(F.avg("raw").alias("_mean"), F.first("_avgdl").alias("_avgdl"), F.collect_list(F.when(F.col("times").isNotNull(), F.struct("term", "times", "raw"))).alias("_asked"))
    norm = k1 * (1 - b + b * F.size("_tokens") / F.col("_avgdl"))

    def share(t: Column) -> Column:
        tf = F.size(F.filter("_tokens", lambda x: x == t["term"]))
        return F.when(tf > 0, t["times"] * F.when(t["raw"] >= 0, t["raw"]).otherwise(epsilon * F.col("_mean")) * tf * (k1 + 1) / (tf + norm)).otherwise(0.0)

    score = F.coalesce(F.aggregate("_asked", F.lit(0.0), lambda s, t: s + share(t)), F.lit(0.0))
    return held.join(stats, "query_id", "left").withColumn("bm25_score", score).select(*candidates.columns, "bm25_score")


def fuse_lists(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(id, rrf_score) of rank lists (id, rank), each with other ids: an id that a list lacks gets nothing from it."""
    each = [one.select("id", (1.0 / (k + F.col("rank"))).alias("share")) for one in lists]
    return reduce(DataFrame.unionByName, each).groupBy("id").agg(F.sum("share").alias("rrf_score"))


_TESTS: dict[str, Callable[[Column, object], Column]] = {
    "$eq": lambda c, v: c == F.lit(v), "$ne": lambda c, v: c != F.lit(v), "$gt": lambda c, v: c > F.lit(v), "$gte": lambda c, v: c >= F.lit(v),
    "$lt": lambda c, v: c < F.lit(v), "$lte": lambda c, v: c <= F.lit(v), "$in": lambda c, v: c.isin(list(v)), "$nin": lambda c, v: ~c.isin(list(v)),
}


def matches(where: dict) -> Column:
    """A metadata predicate as a Column, which the scan can push down: {field: value}, {field: {"$gte": a, "$lte": b}}, {"$and": [...]},
    {"$or": [...]}; several entries must all hold, none always does. A null field matches nothing."""
    each = []
    for name, want in where.items():
        if name in ("$and", "$or"):
            each.append(reduce((lambda a, b: a & b) if name == "$and" else (lambda a, b: a | b), map(matches, want)))
        elif name.startswith("$"):
            raise ValueError(f"unknown operator {name}")
        else:
            for test, value in (want if isinstance(want, dict) else {"$eq": want}).items():
                if test not in _TESTS:
                    raise ValueError(f"unknown operator {test}")
                each.append(_TESTS[test](F.col(name), value))
    return reduce(lambda a, b: a & b, each, F.lit(True))


def fused(ranked: DataFrame, columns: list[str], k: int = RRF_K) -> DataFrame:
    """rrf_score: the sum of 1 / (k + rank) over the rank columns; a null rank gives nothing."""
    return ranked.withColumn("rrf_score", reduce(Column.__add__, (F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0)) for c in columns)))


def rerank_many(hits: DataFrame, queries: DataFrame, scorer: Callable[[Column], Column] | None = None, top_m: int = TOP_M, final_k: int = FINAL_K) -> DataFrame:
    """hits (query_id, id, content, vector_rank) of many queries (query_id, text): BM25 over each query's own, fusion, the top_m by a scorer
    (by default the fused order), the best final_k. A query's hits are at most MOST_K rows."""
    w = Window.partitionBy("query_id")
    ranked = bm25_many(hits, queries).withColumn("bm25_rank", F.row_number().over(w.orderBy(F.desc("bm25_score"), "vector_rank")))
    both = fused(ranked, ["vector_rank", "bm25_rank"]).withColumn("fused_rank", F.row_number().over(w.orderBy(F.desc("rrf_score"), "vector_rank"))).where(F.col("fused_rank") <= top_m)
    ce = scorer(F.col("content")) if scorer else 1.0 - (F.col("fused_rank") - 1) * 0.01
    return both.withColumn("ce_score", ce).withColumn("rank", F.row_number().over(w.orderBy(F.desc("ce_score"), "fused_rank"))).where(F.col("rank") <= final_k)


def rerank(hits: DataFrame, query: str, scorer: Callable[[Column], Column] | None = None, top_m: int = TOP_M, final_k: int = FINAL_K) -> DataFrame:
    """rerank_many() of one query: hits (id, content, vector_rank)."""
    one = hits.sparkSession.createDataFrame([(0, query)], "query_id int, text string")
    return rerank_many(hits.withColumn("query_id", F.lit(0)), one, scorer, top_m, final_k).drop("query_id")


def rank_changes(reranked: DataFrame) -> DataFrame:
    """What re-ranking did, by file: rows, how far they moved, their best and worst score."""
    change = F.col("vector_rank") - F.col("rank")
    return reranked.groupBy("file_name").agg(
        F.count("*").alias("n"), F.avg(F.abs(change)).alias("mean_change"), F.max(change).alias("most_up"), F.min(change).alias("most_down"), F.min("ce_score").alias("least_score"), F.max("ce_score").alias("best_score")
    )


#: What a hit shows where it knows nothing.
DEFAULTS = {"file_name": "Unknown", "chunk_index": -1, "token_count": 0}


def shown(hits: DataFrame, preview_length: int = 200) -> DataFrame:
    """Hits as they are shown: pages as a range, DEFAULTS for what is null, a preview, the content with its breadcrumbs; other columns
    stay."""
    known = {c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items() if c in hits.columns}
    return hits.withColumns(known | {"page_range": page_range(F.col("page_from"), F.col("page_to")), "preview": preview(F.col("content"), preview_length), "payload": with_context(F.col("content"), F.col("breadcrumbs"))})


def keep_first_by_content(rows: DataFrame, order: list, hash_length: int = 16, within: tuple[str, ...] = ()) -> DataFrame:
    digest = F.left(F.md5(F.col("content").cast("binary")), F.lit(hash_length))
    return rows.withColumn("digest", digest).withColumn("_n", F.row_number().over(Window.partitionBy(*within, "digest").orderBy(*order))).where("_n = 1").drop("_n", "digest")


def cap_per_file(rows: DataFrame, order: list, most: int = PER_FILE, within: tuple[str, ...] = ()) -> DataFrame:
    if most <= 0:
        return rows
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*within, "file_name").orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def postprocess(rows: DataFrame, most: int = PER_FILE, within: tuple[str, ...] = ()) -> DataFrame:
    """Re-ranked rows without repeated contents, at most so many of a file, numbered anew; within: the columns that tell queries apart."""
    kept = cap_per_file(keep_first_by_content(rows, ["rank"], within=within), ["rank"], most, within)
    return kept.withColumn("final_rank", F.row_number().over(Window.partitionBy(*(within or [F.lit(0)])).orderBy("rank")))
