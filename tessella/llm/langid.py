"""Language identification: nearest centroid over normalised TF-IDF vectors of character n-grams.

A text's vector counts the byte pairs and triples of its letters (lower case, UTF-8; runs of anything else
in ASCII are one space) in DIMENSIONS hashed places, as log(1 + count) times the inverse
document frequency, normalised. Document frequencies cover all learning rows. Each language has CENTROIDS clusters, fitted by spherical
k-means on at most SAMPLE of its learning rows (those with the smallest hash of doc_id and text), and on at most TOTAL rows in all, shared
evenly where there are more languages than that allows, one row each at least. A language is clustered in a task of its own; all have at most MOST_CENTRES
centroids: with more languages each has fewer, and beyond one each only those with the most learning rows are known. The nearest centroid by cosine names the language. A text is rejected where its cosine falls below the language's floor for a text of its length: FLOOR times the lowest cosines
seen among the fitting rows with about as many n-grams; texts of up to SHORT n-grams go below BARE only.

Null texts and texts without a letter are "und" with score 0 and count as rejected. Equal cosines go to the language first in code point
order. Without any learning row every text is "und", and keep_languages(), which then cannot tell, keeps all rows. Rows that repeat are predicted as often; other columns are ignored by classify()
and pass through keep_languages() untouched, which judges each row by its own text, whatever its doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessella.llm.shared import crc32_text, cut, only, table

DIMENSIONS = 8192
CENTROIDS = 3
#: The most rows of a language on which its centroids are fitted, and of all languages; parts in which the rows of a language are ranked.
SAMPLE, TOTAL, PARTS = 400, 40_000, 32
#: Centroids in all that go to every executor.
MOST_CENTRES = 2048
FLOOR = 0.4
SHORT, BARE = 160, 0.02
#: Upper ends of the classes of length (n-grams) for rejection.
LENGTHS = (40, 160, 640, 2560, 10_240)
#: Bytes as they count: ASCII other than letters is a space, and runs of those are one.
_LETTERS = np.array([b if b > 127 or chr(b).isalpha() else 32 for b in range(256)], np.uint32)


def _counts(text: str) -> tuple[np.ndarray, int]:
    """log(1 + count) of each hashed n-gram, and how many n-grams there are."""
    b = _LETTERS[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)]
    b = b[np.append(True, (b[1:] != 32) | (b[:-1] != 32))]
    two = b[:-1] * np.uint32(257) + b[1:]
    places = (two * np.uint32(2654435761)) >> np.uint32(19)
    three = ((two[:-1] * np.uint32(263) + b[2:]) * np.uint32(2246822519)) >> np.uint32(19)
    n = np.bincount(places, minlength=DIMENSIONS) + np.bincount(three, minlength=DIMENSIONS)
    return np.log1p(n).astype(np.float32), len(places) + len(three)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    df, rows = np.zeros(DIMENSIONS, np.int64), 0
    for pdf in batches:
        for text in pdf["text"]:
            if has_letter(text):
                df += _counts(text)[0] > 0
                rows += 1
    yield pd.DataFrame({"place": np.append(np.flatnonzero(df), -1), "n": np.append(df[df > 0], rows)})


_SAMPLED = "lang string, order long, places binary, counts binary, n long"


def _sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The vectors of rows (lang, order, text): which places count, and what, as packed numbers."""
    for pdf in batches:
        rows = [(lang, order, at.astype(np.uint16).tobytes(), v[at].tobytes(), n) for lang, order, text in zip(pdf["lang"], pdf["order"], pdf["text"], strict=True) if has_letter(text) for v, n in (_counts(text),) for at in (np.flatnonzero(v),)]
        yield pd.DataFrame(rows, columns=["lang", "order", "places", "counts", "n"])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _clustered(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centre is the mean's nearest row, each next the row farthest from those before."""
    centres = [x[(x @ x.mean(0)).argmax()]]
    while len(centres) < min(k, len(x)):
        centres.append(x[(x @ np.array(centres).T).max(1).argmin()])
    c = _unit(np.array(centres))
    for _ in range(rounds):
        nearest = (x @ c.T).argmax(1)
        c = _unit(np.array([x[nearest == i].mean(0) if (nearest == i).any() else c[i] for i in range(len(c))]))
    return c


def _chosen(labelled: DataFrame, sample: int) -> DataFrame:
    """(lang, text) of the rows to fit on: first the smallest hashes in PARTS parts of each language, then the smallest of those."""
    known = labelled.select("lang", F.xxhash64("doc_id", "text").alias("order")).distinct()
    languages = known.agg(F.count_distinct("lang")).first()[0]
    most = max(1, min(sample, TOTAL // max(1, languages)))
    in_part = F.row_number().over(Window.partitionBy("lang", F.pmod("order", F.lit(PARTS))).orderBy("order"))
    near = known.withColumn("nth", in_part).where(F.col("nth") <= most)
    chosen = near.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("order"))).where(F.col("nth") <= most)
    chosen = cut(chosen.select("lang", F.col("order").alias("chosen")))  # at most TOTAL rows, as languages are at most MOST_CENTRES
    held = labelled.withColumn("order", F.xxhash64("doc_id", "text"))
    rows = held.join(F.broadcast(chosen), (held["lang"] == chosen["lang"]) & (F.col("order") == F.col("chosen")), "left_semi")
    return rows.select("lang", "text", "order").dropDuplicates(["lang", "order"])


def _language(idf: np.ndarray, centroids: int):
    """The centroids and floors of one language from its at most SAMPLE vectors."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("order")
        x = np.zeros((len(own), DIMENSIONS), np.float32)
        for k, (at, v) in enumerate(zip(own["places"], own["counts"], strict=True)):
            x[k, np.frombuffer(at, np.uint16)] = np.frombuffer(v, np.float32)
        x = _unit(x * idf)
        c = _clustered(x, centroids)
        cosine, classes = (x @ c.T).max(1), np.searchsorted(LENGTHS, own["n"].to_numpy())
        low = [np.quantile(cosine[classes == k], 0.02) if (classes == k).sum() >= 5 else np.nan for k in range(len(LENGTHS) + 1)]
        known = np.flatnonzero(~np.isnan(low))
        # classes of length without rows take the floor of the next shorter one, the shortest a tenth of the shortest known
        floors = [FLOOR * low[k] if k in known else FLOOR * (low[known[known < k][-1]] if (known < k).any() else 0.1 * low[known[0]] if len(known) else 0.0) for k in range(len(low))]
        floors = [float(min(f, BARE) if k < np.searchsorted(LENGTHS, SHORT + 1) else f) for k, f in enumerate(floors)]
        return pd.DataFrame({"lang": [own["lang"].iloc[0]], "centres": [c.astype(np.float32).tobytes()], "floors": [floors]})

    return run


def fit(labelled: DataFrame, centroids: int = CENTROIDS, sample: int = SAMPLE) -> dict | None:
    """The model from rows (doc_id, text, lang): idf, centroids with their languages, floors by language and length."""
    labelled = labelled.where("lang is not null and text is not null")
    found = labelled.select("text").mapInPandas(_frequencies, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    df = {r["place"]: r["n"] for r in found}
    total = df.pop(-1, 0)
    if not total:
        return None
    idf = np.zeros(DIMENSIONS, np.float32)
    idf[list(df)] = np.log((1 + total) / (1 + np.array(list(df.values())))) + 0.1
    known = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_CENTRES).select("lang")
    languages = [r["lang"] for r in known.collect()]
    labelled = labelled.where(F.col("lang").isin(languages))
    each = max(1, min(centroids, MOST_CENTRES // len(languages)))
    vectors = _chosen(labelled, sample).mapInPandas(_sampled, _SAMPLED)
    found = vectors.groupBy("lang").applyInPandas(_language(idf, each), "lang string, centres binary, floors array<double>")
    rows = sorted(found.collect(), key=lambda r: r["lang"])  # at most MOST_CENTRES centroids
    centres = [np.frombuffer(r["centres"], np.float32).reshape(-1, DIMENSIONS) for r in rows]
    owner = np.repeat(np.arange(len(rows)), [len(c) for c in centres])
    return {"idf": idf, "names": [r["lang"] for r in rows], "centres": np.vstack(centres), "owner": owner, "floors": np.array([r["floors"] for r in rows], np.float32)}


def _judged(texts, m: dict) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, cosine, rejected) of each text."""
    weighted = m["weighted"] if "weighted" in m else m.setdefault("weighted", (m["centres"] * m["idf"]).T.copy())
    names, scores, out = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    for k, text in enumerate(texts):
        if has_letter(text):
            v, n = _counts(text)
            cosines = (v @ weighted) / max(1e-12, float(np.linalg.norm(v * m["idf"])))
            best = int(cosines.argmax())
            own = m["owner"][best]
            names[k], scores[k] = m["names"][own], min(1.0, max(0.0, float(cosines[best])))
            out[k] = scores[k] < m["floors"][own][np.searchsorted(LENGTHS, n)]
    return names, scores, out


def classify(docs: DataFrame, model: dict | None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, lang_pred, score (cosine) and rejected."""
    held = only(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if model is None:
        return held.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CENTROIDS rows of DIMENSIONS floats a language

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names, scores, out = _judged(pdf["text"], shared.value)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "lang_pred": names, "score": scores, "rejected": out})

    return held.mapInPandas(predict, "doc_id long, lang_pred string, score double, rejected boolean")


def learning(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: crc32(doc_id as text) mod 4 is not 2."""
    return only(docs, "doc_id", "text", "lang").where((crc32_text(F.col("doc_id")) % 4 != 2) & F.col("lang").isNotNull())


def keep_languages(docs: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected."""
    model = fit(learning(docs))
    if "text" not in docs.columns:
        return docs.where(F.lit(False))
    if model is None:
        return docs
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~_judged(batch.column(at).to_pylist(), shared.value)[2]))

    plain = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(docs.schema)])  # names may hold dots
    return docs.toDF(*plain.names).mapInArrow(keep, plain).toDF(*docs.columns)


def op10_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = classify(docs, fit(learning(docs)))
    return found.select("doc_id", (crc32_text(F.col("doc_id")) % 4 == 2).alias("held_out"), "lang_pred", "score", "rejected")
