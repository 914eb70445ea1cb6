"""Nearest neighbours: score-aware anisotropic quantisation, four-bit table scans, exact reranking.

Vectors lie in lists by their nearest coarse centre c. With x = c + r, Euclidean search is maximum inner product search on the residuals,
their norms known: |q - x|^2 = |q - c|^2 + |r|^2 - 2 |r| (q - c).(r / |r|). Only the last product is approximated: each pair of dimensions
has a codebook of 16 entries (four bits) for unit residuals, so tight and wide lists are coded alike, and both codes and codebooks
minimise a loss that weighs the error along the residual ETA times the error across it. A query builds a table of its products with all
codebook entries and scans the codes; the RERANK best of every block are measured exactly, in double precision.

The index is fitted on at most SAMPLE vectors (those with the smallest hash of vec_id) and holds every vector. There is a list for each
LIST_ROWS vectors, at most one for 8 of the sample (1,024), whose members grow with the table beyond that. A query visits the lists of
its GUIDES nearest vectors of the sample; so many nearest lists that, on the sample, RECALL of the true neighbours lie in them; and
further ones until those hold RERANK candidates, or all lists. Lists are dealt into blocks of at most about BLOCK vectors and QUERY_BLOCK
queries, so that a list with a third of all rows becomes many tasks.

Every row is known by a number of its own: a query's candidates are all rows but that one, so rows that share a vec_id are candidates to
each other, and a query that occurs twice is answered twice. Vectors that are null, zero, hold null or non-finite components or have no
vec_id take no part. Vectors of different lengths have no distance: each length is searched by itself, one after the other. Equal
distances go to the smaller vec_id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.shared import cut, only, table

SAMPLE = 8192
LIST_ROWS = 400
RECALL = 0.985
BLOCK, QUERY_BLOCK = 4096, 2048
RERANK, GUIDES = 120, 40
#: Weight of the error along the vector, from a threshold of 0.2 on the cosine: (d - 1) T^2 / (1 - T^2), for 64 dimensions.
THRESHOLD = 0.2


def valid(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v): the rows that take part, v as an array of doubles."""
    v = F.col(vector_column).cast("array<double>")
    held = vectors.select(F.col(id_column).cast("bigint").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    return held.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))


def _kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centres, each started at a row drawn in proportion to its distance from those before."""
    rng, c, far = np.random.default_rng(8), [x[0]], np.full(len(x), np.inf)
    while len(c) < k:
        far = np.minimum(far, ((x - c[-1]) ** 2).sum(1))
        total = np.cumsum(np.sqrt(far))
        if not total[-1] > 0:
            break
        c.append(x[min(len(x) - 1, int(np.searchsorted(total, rng.random() * total[-1], "right")))])
    c = np.array(c)
    for _ in range(rounds):
        near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _split(x: np.ndarray) -> np.ndarray:
    """(rows, pairs, 2), with a zero in the end where the number of dimensions is odd."""
    x = np.pad(x, ((0, 0), (0, x.shape[1] % 2)))
    return x.reshape(len(x), -1, 2)


def encode(x: np.ndarray, books: np.ndarray, eta: float, rounds: int = 2) -> np.ndarray:
    """Codes (rows, pairs) by coordinate descent on |r|^2 + (eta - 1) (r.x / |x|)^2."""
    parts = _split(x)
    u = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
    far = ((parts[:, :, None, :] - books[None]) ** 2).sum(-1)
    codes = far.argmin(-1)
    along = (u[:, :, None, :] * (parts[:, :, None, :] - books[None])).sum(-1)
    rows = np.arange(len(x))
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(rounds):
        for m in range(parts.shape[1]):
            others = total - along[rows, m, codes[:, m]]
            codes[:, m] = (far[:, m] + (eta - 1) * (others[:, None] + along[:, m]) ** 2).argmin(1)
            total = others + along[rows, m, codes[:, m]]
    return codes.astype(np.uint8)


def _trained(x: np.ndarray, eta: float, rounds: int = 6) -> np.ndarray:
    """Codebooks (pairs, 16, 2): plain k-means first, then by turns codes and the entries that minimise the loss for them."""
    parts = _split(x)
    books = np.stack([np.pad(c := _kmeans(parts[:, m], 16), ((0, 16 - len(c)), (0, 0)), mode="edge") for m in range(parts.shape[1])])
    u = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
    for _ in range(rounds):
        codes = encode(x, books, eta)
        for m in range(parts.shape[1]):
            chosen = np.stack([books[k][codes[:, k]] for k in range(parts.shape[1])], 1)
            error = (u * (parts - chosen)).sum((1, 2)) - (u[:, m] * (parts[:, m] - chosen[:, m])).sum(1)
            left = np.eye(2) + (eta - 1) * u[:, m, :, None] * u[:, m, None, :]
            right = parts[:, m] + (eta - 1) * u[:, m] * ((u[:, m] * parts[:, m]).sum(1) + error)[:, None]
            for k in np.unique(codes[:, m]):
                own = codes[:, m] == k
                books[m, k] = np.linalg.lstsq(left[own].sum(0), right[own].sum(0), rcond=None)[0]
    return books


def _residuals(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The norms and the directions of x - centres; the direction of nothing is nothing."""
    r = x - centres
    norm = np.sqrt((r**2).sum(1))
    return norm, r / np.where(norm > 0, norm, 1.0)[:, None]


def _near_lists(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argsort((centres**2).sum(1) - 2 * x @ centres.T, 1, kind="stable").astype(np.int32)


def fit(vectors: DataFrame, k: int) -> dict:
    """The index's parameters from a bounded sample: coarse centres, how many lists to visit, codebooks."""
    n = vectors.count()
    near = vectors.withColumn("order", F.xxhash64("id", "row")).where(F.pmod("order", F.lit(1_000_000)) < int(1_000_000 * min(1.0, 1.2 * SAMPLE / max(1, n))) + 1)
    held = [r["v"] for r in near.orderBy("order", "id", "row").limit(SAMPLE).select("v").collect()] or [r["v"] for r in vectors.limit(SAMPLE).select("v").collect()]
    x = np.array(held, np.float64)
    lists = max(1, min(n // LIST_ROWS, len(x) // 8))
    centres = _kmeans(x, lists)
    eta = max(1.0, (x.shape[1] - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    queries = x[:: max(1, len(x) // 256)][:256]
    owner = _near_lists(x, centres)[:, 0]
    visits = len(centres)
    if visits > 1:
        far = (x**2).sum(1) - 2 * queries @ x.T
        true = np.argsort(far, 1)[:, 1 : k + 1]
        place = np.argsort(_near_lists(queries, centres), 1)
        seen = np.take_along_axis(place, owner[true], 1)
        visits = next(v for v in range(1, visits + 1) if (seen < v).mean() >= RECALL)
    return {"centres": centres, "visits": visits, "books": _trained(_residuals(x, centres[owner])[1], eta), "eta": eta, "sample": x, "owner": owner}


_INDEX = "row long, id long, v array<double>, asked boolean, list int, norm double, codes binary"


def _indexed(model):
    def run(batches):
        m = model.value
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy())
                lists = _near_lists(x, m["centres"])[:, 0]
                norm, direction = _residuals(x, m["centres"][lists])
                codes = encode(direction, m["books"], m["eta"])
                yield pdf[["row", "id", "v", "asked"]].assign(list=lists, norm=norm, codes=[c.tobytes() for c in codes])

    return run


def _asking(model, sizes: dict[int, int], k: int):
    """The lists that each query visits: those of its guides, the nearest, and on until they hold enough rows besides its own."""

    def run(batches):
        m = model.value
        rows, sample = np.array([sizes.get(i, 0) for i in range(len(m["centres"]))]), m["sample"]
        norms, guides = (sample**2).sum(1), min(GUIDES, len(sample))
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                part = pdf.iloc[lo : lo + 512]
                x = np.stack(part["v"].to_numpy())
                near = _near_lists(x, m["centres"])
                short = np.cumsum(rows[near], 1) < 1 + max(k, RERANK)
                visits = np.maximum(m["visits"], short.sum(1) + 1)
                guided = m["owner"][np.argpartition(norms - 2 * x @ sample.T, guides - 1, 1)[:, :guides]]
                yield part[["row", "id", "v"]].assign(lists=[np.union1d(a[:n], g).astype(np.int32) for a, n, g in zip(near, visits, guided, strict=True)])

    return run


def _scanned(model, k: int):
    def run(key, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": np.empty(0, np.int64), "query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        if not len(index) or not len(queries):
            return empty
        index = index.sort_values(["id", "row"], kind="stable")
        ids, rows, x, norm = index["id"].to_numpy(), index["row"].to_numpy(), np.stack(index["v"].to_numpy()), index["norm"].to_numpy()
        codes = np.frombuffer(b"".join(index["codes"]), np.uint8).reshape(len(index), -1)
        if codes.shape[1] % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        pairs = (codes[:, ::2].astype(np.intp) << 4) | codes[:, 1::2]
        flat = (pairs + 256 * np.arange(pairs.shape[1])).T.copy()
        books, centre, out = model.value["books"], model.value["centres"][int(index["list"].iloc[0])], []
        for own, query, q in zip(queries["row"].to_numpy(), queries["id"].to_numpy(), np.stack(queries["v"].to_numpy()), strict=True):
            small = (books * _split((q - centre)[None])[0][:, None, :]).sum(-1)
            small = np.pad(small, ((0, small.shape[0] % 2), (0, 0)))
            tables = (small[::2, :, None] + small[1::2, None, :]).ravel()
            product = np.zeros(len(index))
            for places in flat:
                product += tables[places]
            near = norm * (norm - 2 * product)
            near[rows == own] = np.inf
            if len(near) > RERANK:
                edge = np.partition(near, RERANK - 1)[RERANK - 1]
                best = np.flatnonzero(near <= edge)  # all that tie with the last one too, in the order of vec_id
                best = best[np.argsort(near[best], kind="stable")][:RERANK]
            else:
                best = np.flatnonzero(np.isfinite(near))
            best = best[np.isfinite(near[best])]
            exact = np.sqrt(((x[best] - q) ** 2).sum(1))
            first = np.lexsort((ids[best], exact))[:k]
            out.append((np.full(len(first), own), np.full(len(first), query), ids[best][first], exact[first]))
        return pd.DataFrame({n: np.concatenate([o[i] for o in out]) for i, n in enumerate(empty.columns)})

    return run


def _searched(held: DataFrame, k: int) -> DataFrame:
    """search() among vectors (row, id, v, asked) of one length."""
    spark = held.sparkSession
    model = fit(held, k)
    shared = spark.sparkContext.broadcast(model)  # at most SAMPLE / 8 centres and the codebooks
    index = cut(held.mapInPandas(_indexed(shared), _INDEX))
    sizes = {r["list"]: r["count"] for r in index.groupBy("list").count().collect()}  # one row a list
    asked = cut(index.where("asked").mapInPandas(_asking(shared, sizes, k), "row long, id long, v array<double>, lists array<int>").select("row", "id", "v", F.explode("lists").alias("list")))
    asking = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}  # one row a list
    dealt = [(i, -(-sizes[i] // BLOCK), -(-n // QUERY_BLOCK)) for i, n in sorted(asking.items()) if sizes.get(i)]
    parts = F.broadcast(spark.createDataFrame(dealt, "list int, blocks int, parts int"))
    left = index.join(parts, "list").select("list", F.expr("cast(pmod(xxhash64(row), blocks) as int)").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "row", "id", "v", "norm", "codes")
    right = asked.join(parts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.expr("cast(pmod(xxhash64(row), parts) as int)").alias("part"), "row", "id", "v")
    keys = ["list", "block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_scanned(shared, k), "query long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, asked: Column, k: int = 10) -> DataFrame:
    """For each of vectors (id, v) where asked holds, the k nearest of all other rows: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    held = cut(vectors.select("id", "v", F.coalesce(asked, F.lit(False)).alias("asked"), F.monotonically_increasing_id().alias("row")))
    lengths = [r["d"] for r in held.where("asked").groupBy(F.size("v").alias("d")).count().orderBy("d").collect()]
    found = [_searched(held.where(F.size("v") == d), k) for d in lengths]
    return reduce(DataFrame.unionByName, found, spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")) if len(found) != 1 else found[0]


def op8_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = valid(only(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vec_id", "embedding")
    return search(vectors, F.col("id") % 100 == 0)
