"""Best-fit packing of token sequences under several capacities.

Documents are tokenised whole and end with one closing id. Those longer than a sequence are cut into pieces of full length, the
shorter piece first. Lengths are integers of at most CAPACITY, so the whole corpus is described by how many pieces there are of each
length: the driver packs that table (at most CAPACITY rows, whatever the corpus size), longest first, and never sees a document.
A bin has residual tokens, documents and attention cost (sum of squared lengths); a length goes to the kind of bin in which it fits
under every capacity and whose residuals have the largest weighted dot product with the need, or the smallest residual norm. most_docs and
most_cost are the capacities besides tokens; by default they are what a sequence of CAPACITY tokens can hold at all, as the fewest
sequences are asked for. A piece that exceeds the cost alone has a sequence of its own.
Pieces then take their places by their number within their length; that number comes from a count within each input partition and
an offset per partition, so no length class is gathered in one task.

Null texts count as empty (one piece of length 1). Repeated rows are packed as often as they come. An empty table gives no pieces.
Other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.shared import cut, only, table

CAPACITY = 1024
CLOSING = 2
#: Distinct words of which a worker remembers the ids; more are encoded anew.
REMEMBERED = 300_000
SPECIAL = "<|endoftext|>"
_loaded: dict = {}


class _Words(dict):
    """word -> its ids after a space, as little-endian unsigned 32-bit bytes."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = ids = array("I", self.encode(f" {word}")).tobytes()
        return ids


def encoder(json_path: str, ranks_path: str):
    """text -> bytes of its ids. A space starts a new token unless white space stands next to it, so the words of other texts are
    encoded one by one and remembered. Texts that spell a special token go through the tokenizer's own library."""
    if (json_path, ranks_path) not in _loaded:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        exact = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        words = _Words(exact)

        def encode(text: str) -> bytes:
            if SPECIAL in text:
                if "own" not in _loaded:
                    from tokenizers import Tokenizer

                    _loaded["own"] = Tokenizer.from_file(json_path)
                return array("I", _loaded["own"].encode(text, add_special_tokens=False).ids).tobytes()
            first, *rest = text.split(" ")
            if not rest or "" in rest or not first:
                return array("I", exact(text)).tobytes()
            return array("I", exact(first)).tobytes() + b"".join(map(words.__getitem__, rest))

        _loaded[json_path, ranks_path] = encode
    return _loaded[json_path, ranks_path]


def _paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per piece; part and nth: the input partition and the piece's number among those of its length there."""
    paths = paths or _paths()

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part, seen, end = encoder(*paths), TaskContext.get().partitionId(), [0] * (capacity + 1), array("I", [CLOSING]).tobytes()
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = encode(text or "") + end
                total = len(ids) // 4
                at, length = 0, total % capacity or capacity
                for k in range(-(-total // capacity)):
                    rows.append((doc_id, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), part, seen[length]))
                    seen[length] += 1
                    at, length = at + length, capacity
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]).astype({"doc_id": "Int64"})

    held = only(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return held.mapInPandas(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def plan(counts: dict[int, int], capacity: int = CAPACITY, most_docs: int | None = None, most_cost: int | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), by: str = "norm") -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, pieces, sequence, each, offset): pieces number first, first + 1, ... of a length go each by each to sequences
    from the given one on, at the given offset. Kinds of equal bins are filled together, so the work grows with the number of
    lengths, not of pieces."""
    most = np.array([capacity, most_docs or capacity, most_cost or capacity * capacity], float)
    w = np.array(weights) / most**2
    rest = np.empty((0, 3))
    many, base = np.empty(0, np.int64), np.empty(0, np.int64)
    out, made = [], 0
    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        need, left, first = np.array([length, 1, length * length], float), int(counts[length]), 0
        while left:
            fits = np.flatnonzero((rest >= need).all(1) & (many > 0))
            if len(fits):
                gap = rest[fits] - need
                score = (w * gap**2).sum(1) if by == "norm" else -(w * rest[fits] * need).sum(1)
                k = int(fits[score.argmin()])
                each = int((rest[k] // need).min())
                bins = min(int(many[k]), left // each)
                if not bins:
                    bins, each = 1, left
                out.append((length, first, bins * each, int(base[k]), each, int(capacity - rest[k, 0])))
                now, at = rest[k] - each * need, int(base[k])
                many[k] -= bins
                base[k] += bins
            else:
                each = max(1, int((most // need).min()))
                bins = left // each
                if not bins:
                    bins, each = 1, left
                out.append((length, first, bins * each, made, each, 0))
                now, at = most - each * need, made
                made += bins
            if (now >= 1).all():
                rest, many, base = np.vstack([rest, now]), np.append(many, bins), np.append(base, at)
            left -= bins * each
            first += bins * each
        alive = many > 0
        rest, many, base = rest[alive], many[alive], base[alive]
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str] | None = None, **how) -> DataFrame:
    """Each piece with its sequence_id and offset."""
    spark = docs.sparkSession
    held = cut(pieces(docs, capacity, paths))
    by_part = held.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    from pyspark.sql import Window

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = by_part.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = held.join(starts, ["length", "part"]).withColumn("number", F.col("nth") + F.col("before"))
    steps = plan(counts, capacity, **how)
    by_length: dict[int, np.ndarray] = {k: np.array([s[1:] for s in steps if s[0] == k], np.int64) for k in counts}
    shared = spark.sparkContext.broadcast(by_length)  # at most a few thousand steps

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sequence, offset = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
            lengths, numbers = pdf["length"].to_numpy(), pdf["number"].to_numpy()
            order = np.argsort(lengths, kind="stable")
            ends = np.flatnonzero(np.diff(lengths[order], append=-1)) + 1
            for rows in np.split(order, ends[:-1]) if len(order) else []:
                step = shared.value[int(lengths[rows[0]])]
                at = step[np.searchsorted(step[:, 0], numbers[rows], "right") - 1]
                nth = numbers[rows] - at[:, 0]
                sequence[rows] = at[:, 2] + nth // at[:, 3]
                offset[rows] = at[:, 4] + nth % at[:, 3] * lengths[rows]
            yield pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=sequence, offset=offset).astype({"doc_id": "Int64"})

    return numbered.mapInPandas(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
