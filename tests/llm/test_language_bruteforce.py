"""Language identification against a restatement n-gram by n-gram: document frequencies, vectors, cosines, floors; bounds of the model."""

import math
import zlib
from collections import Counter

import duckdb
import pytest

from tessella.llm import langid

SF = "/root/testdata/sf0.001"
MASK = 2**32 - 1


def grams(text):
    """Hashed n-grams of a text, counted one by one."""
    raw = f" {text.lower()} ".encode()
    kept = []
    for b in raw:
        b = b if b > 127 or chr(b).isalpha() else 32
        if b != 32 or not kept or kept[-1] != 32:
            kept.append(b)
    two = [(a * 257 + b) & MASK for a, b in zip(kept, kept[1:], strict=False)]
    out = Counter((t * 2654435761 & MASK) >> 19 for t in two)
    out.update(((t * 263 + b) * 2246822519 & MASK) >> 19 for t, b in zip(two, kept[2:], strict=False))
    return out, 2 * len(kept) - 3


def letters(text):
    return bool(text) and any(c.isalpha() for c in text)


def test_predictions_are_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet'").fetchall()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(langid.learning(docs))
    learned = [grams(t)[0] for d, t, lang in rows if zlib.crc32(str(d).encode()) % 4 != 2 and lang is not None and letters(t)]
    df = Counter(p for g in learned for p in g)
    idf = {p: math.log((1 + len(learned)) / (1 + n)) + 0.1 for p, n in df.items()}
    assert all(abs(model["idf"][p] - v) < 1e-5 for p, v in idf.items()) and sum(model["idf"] != 0) == len(idf)
    centres = [dict(enumerate(c.tolist())) for c in model["centres"]]
    assert all(abs(sum(v * v for v in c.values()) - 1) < 1e-4 for c in centres) and len(centres) == 3 * len(set(model["names"]))
    got = {r["doc_id"]: r for r in langid.classify(docs, model).collect()}
    for d, t, _ in rows:
        if not letters(t):
            assert (got[d]["lang_pred"], got[d]["score"], got[d]["rejected"]) == ("und", 0.0, True)
            continue
        counted, n = grams(t)
        vector = {p: math.log1p(c) * idf.get(p, 0.0) for p, c in counted.items()}
        size = math.sqrt(sum(v * v for v in vector.values()))
        cosines = [sum(v * c[p] for p, v in vector.items()) / size for c in centres]
        best = max(range(len(cosines)), key=lambda i: cosines[i])
        assert got[d]["score"] == pytest.approx(cosines[best], abs=1e-4)
        if cosines[best] - max((c for i, c in enumerate(cosines) if model["owner"][i] != model["owner"][best]), default=-1) > 1e-4:
            own = int(model["owner"][best])
            assert got[d]["lang_pred"] == model["names"][own]
            floor = model["floors"][own][sum(n > e for e in langid.LENGTHS)]
            assert got[d]["rejected"] == (cosines[best] < floor) or abs(cosines[best] - floor) < 1e-4


def test_centroids_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_CENTRES", 6)
    rows = [(i * 16 + j, f"{w} {w}{j} text number {j}", f"l{i}") for i, w in enumerate(["alpha", "bravo", "carrot", "delta", "ember", "ferry", "gamma", "hotel"]) for j in range(12 - i)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for n, each in ((2, 3), (4, 1), (8, 1)):
        model = langid.fit(docs.where(f"lang < 'l{n}'"))
        assert model["names"] == [f"l{i}" for i in range(min(n, 6))] and len(model["centres"]) == each * min(n, 6)


def test_nothing_is_rejected_where_nothing_is_known(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert langid.keep_languages(docs).count() == 2
