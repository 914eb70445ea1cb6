"""An inverted-file index of vectors, kept beside the store: nearest rows from a bounded share of the table.

Centres are fitted to a bounded sample, every row goes to the list of its nearest centre, and the table is a parted one whose places are
lists: a search opens the files that reach over the lists nearest to the query. How many lists that are is fitted too, so that the sample's
own nearest neighbours are found with RECALL. Distances are exact, on the vectors themselves; what a list-wise search can miss is a row of
a list that is not visited. Additions are parts; when the table has grown by GROWTH since its centres were fitted, they are fitted anew and
the rows laid out again."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.parts import PartedTable
from tessella.operators.retrieval import TOP_K, distance, matches

#: Rows of the sample, rows that a list should have, lists at most, neighbours and share of them by which visits are fitted.
SAMPLE, LIST_ROWS, MOST_LISTS, NEIGHBOURS, RECALL, GROWTH = 20_000, 1_000, 4_096, 20, 0.98, 4
#: The list of rows without a vector, which no search visits.
NOWHERE = -1


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres**2).sum(1) - 2 * x @ centres.T


def centres_of(x: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Centres by k-means; a centre that no row is near moves to the row that is farthest from its own."""
    centres = x[np.random.default_rng(11).permutation(len(x))[:lists]].copy()
    for _ in range(rounds):
        d = _distances(x, centres)
        own = d.argmin(1)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=lists)
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            far = np.argsort(-(d[np.arange(len(x)), own] + (x**2).sum(1)), kind="stable")
            centres[n == 0] = x[far[: (n == 0).sum()]]
    return centres


def visits_of(x: np.ndarray, centres: np.ndarray, k: int = NEIGHBOURS, recall: float = RECALL) -> int:
    """Lists nearest to a row that hold that share of its k nearest others, over some rows of the sample."""
    if len(centres) == 1 or len(x) <= k:
        return len(centres)
    asked = np.random.default_rng(12).permutation(len(x))[:512]
    far = (x**2).sum(1) - 2 * x[asked] @ x.T
    far[np.arange(len(asked)), asked] = np.inf
    near = np.argpartition(far, k - 1, 1)[:, :k]
    place = np.argsort(np.argsort(_distances(x[asked], centres), 1, kind="stable"), 1, kind="stable")
    seen = np.sort(np.take_along_axis(place, _distances(x, centres).argmin(1)[near], 1).ravel())
    return int(seen[min(len(seen) - 1, int(np.ceil(recall * len(seen))) - 1)]) + 1


class VectorIndex:
    """Rows (an id, file_name, embedding, any others); embeddings of one length, or null."""

    def __init__(self, spark: SparkSession, path: str, sample: int = SAMPLE, list_rows: int = LIST_ROWS):
        self.spark, self.table, self.sample, self.list_rows = spark, PartedTable(spark, path), sample, list_rows
        self._model: tuple[str, np.ndarray] | None = None

    def _centres(self, state: dict) -> np.ndarray:
        name = state["notes"]["model"]
        if self._model is None or self._model[0] != name:
            rows = self.spark.read.schema("list int, centre array<double>").parquet(f"{self.table.path}/models/{name}").orderBy("list").collect()  # at most MOST_LISTS rows
            self._model = name, np.array([r["centre"] for r in rows])
        return self._model[1]

    def _fit(self, rows: DataFrame) -> dict:
        """Notes of a new model: its name, how many lists a search visits, the rows it was fitted for."""
        held = rows.where("embedding is not null")
        n = held.count()
        drawn = held.where(F.pmod(F.xxhash64("id", "file_name"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 1.2 * self.sample / max(1, n))) + 1)
        vectors = [r["v"] for r in drawn.select(F.col("embedding").cast("array<double>").alias("v")).limit(self.sample).collect()] or [r["v"] for r in held.select(F.col("embedding").cast("array<double>").alias("v")).limit(self.sample).collect()]
        x = np.array(vectors)
        centres = centres_of(x, max(1, min(n // self.list_rows, MOST_LISTS, len(x) // 8))) if len(x) else np.zeros((1, 1))
        name = uuid.uuid4().hex
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>").write.parquet(f"{self.table.path}/models/{name}")
        return {"model": name, "visits": visits_of(x, centres) if len(x) else 1, "fitted": n}

    def _placed(self, rows: DataFrame, centres: np.ndarray) -> DataFrame:
        shared = self.spark.sparkContext.broadcast(centres)  # at most MOST_LISTS vectors

        @F.pandas_udf("long")
        def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for held in batches:
                out, full = np.full(len(held), NOWHERE), held.notna().to_numpy()
                if full.any():
                    out[full] = _distances(np.stack(held[full].to_numpy()), shared.value).argmin(1) if len(shared.value) > 1 else 0
                yield pd.Series(out)

        return rows.drop("_place", "_part").withColumn("_place", nearest(F.col("embedding").cast("array<double>")))

    def add(self, rows: DataFrame, notes: dict | None = None) -> None:
        """Appends rows; where the table has outgrown its centres, all rows are laid out by new ones."""
        state = self.table.state()
        n = sum(f[3] for _, files in state["parts"] for f in files) + rows.count()
        if state["schema"] is None or "model" not in state["notes"]:
            made = self._fit(rows)
            self.table.add(state, self._placed(rows, self._centres(state | {"notes": made})), notes=made | (notes or {}))
        elif n > GROWTH * max(state["notes"]["fitted"], 1) and state["notes"]["fitted"] < MOST_LISTS * self.list_rows:
            self.rebuild(self.table.rows(state).drop("_place", "_part").unionByName(rows, allowMissingColumns=True), notes)
        else:
            self.table.add(state, self._placed(rows, self._centres(state)), notes=notes)

    def rebuild(self, rows: DataFrame, notes: dict | None = None) -> None:
        """The index of rows alone, by new centres."""
        state, made = self.table.state(), self._fit(rows)
        self.table.add(state, self._placed(rows, self._centres(state | {"notes": made})), keep=False, notes=made | (notes or {}))

    def lists(self, vector: list[float], visits: int | None = None) -> list[int]:
        """The lists that a search of this vector visits, nearest first."""
        state = self.table.state()
        centres = self._centres(state)
        order = np.argsort(_distances(np.array([vector], float), centres)[0], kind="stable") if len(centres) > 1 else [0]  # one list needs no centre
        return [int(i) for i in order[: visits or state["notes"]["visits"]]]

    def nearest(self, vector: list[float], k: int = TOP_K, where: dict | None = None, exact: bool = False) -> DataFrame | None:
        """The k nearest rows that where allows, with distance (squared Euclidean): of the visited lists, and of twice as many until they
        hold k such rows or are all; exact: of all lists at once."""
        state = self.table.state()
        if state["schema"] is None or "model" not in state["notes"]:
            return None
        order = self.lists(vector, len(self._centres(state)))
        visits = len(order) if exact else state["notes"]["visits"]
        asked = F.array(*[F.lit(float(x)) for x in vector])
        while True:
            held = self.table.rows(state, order[:visits]) if visits < len(order) else self.table.rows(state)
            held = held.where((F.col("_place") != NOWHERE) & matches(where or {})).drop("_place", "_part")
            near = held.withColumn("distance", distance(F.col("embedding"), asked)).orderBy("distance", "id").limit(k)
            if visits >= len(order) or held.limit(k).count() >= k:
                return near
            visits = min(len(order), 2 * visits)

    def share(self, vector: list[float]) -> float:
        """The share of the table's files that a search of this vector opens."""
        state = self.table.state()
        return len(self.table.files(state, self.lists(vector))) / max(1, len(self.table.files(state)))

    def forget(self, file_name: str | None) -> None:
        state = self.table.state()
        if state["parts"]:
            self.table.forget(state, file_name)

    def clear(self) -> None:
        self.table.clear()


def recall(found: DataFrame, true: DataFrame, key: Column | str = "id") -> float:
    """The share of true's rows that found has."""
    both = true.select(F.col(key) if isinstance(key, str) else key)
    return both.intersect(found.select(*both.columns)).count() / max(1, both.count())
