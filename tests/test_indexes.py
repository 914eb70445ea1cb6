"""The indexes beside the store: nearest rows and word scores against exact ones, what a search reads, deletions, growth."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import ann, postings
from tessella.operators.retrieval import bm25, top_k



@pytest.fixture
def parted(spark):
    """Tables of many files: ranges are not joined although they are small."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", before)


def vectors(spark, n, seed, start=0):
    rng = np.random.default_rng(seed)
    middles = np.random.default_rng(1).normal(size=(60, 16)) * 2
    x = middles[rng.integers(0, 60, n)] + rng.normal(size=(n, 16)) * 0.8
    rows = [(f"v{start + i}", f"f{(start + i) % 9}", [float(v) for v in r], (start + i) % 3) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id string, file_name string, embedding array<double>, kind int"), x


def test_nearest_rows_of_a_share_of_the_table(parted, tmp_path):
    index = ann.VectorIndex(parted, f"file://{tmp_path}/v", sample=4000, list_rows=100)
    assert index.nearest([0.0] * 16) is None
    rows, x = vectors(parted, 6000, 2)
    none = parted.createDataFrame([("null", "f0", None, 0)], rows.schema)
    index.add(rows.union(none))
    more, y = vectors(parted, 2000, 3, 6000)
    index.add(more)
    every, z = rows.union(more), np.concatenate([x, y])
    found, shares = [], []
    for i in range(0, 8000, 400):
        asked = [float(v) for v in z[i]]
        near = index.nearest(asked, 10)
        true = {f"v{j}" for j in np.argsort(((z - z[i]) ** 2).sum(1), kind="stable")[:10]}
        found.append(len(true & {r["id"] for r in near.select("id").collect()}) / 10)
        shares.append(index.share(asked))
        assert i or [r["id"] for r in index.nearest(asked, 10, exact=True).collect()] == [r["id"] for r in top_k(every.select("id", "embedding"), asked, 10).collect()]
    assert np.mean(found) >= 0.95 and np.mean(shares) < 0.6
    assert index.nearest([0.0] * 16, 20, {"kind": 1}).where("kind <> 1").count() == 0 and index.nearest([0.0] * 16, 20, {"id": "v7"}).count() == 1  # on until they are found
    index.forget("f3")
    assert index.nearest([float(v) for v in z[3]], 50).where("file_name = 'f3'").count() == 0 and index.nearest([0.0] * 16, 10000, exact=True).count() == 8000 - len(range(3, 8000, 9))
    assert ann.recall(index.nearest([0.0] * 16, 10), index.nearest([0.0] * 16, 10, exact=True)) >= 0.5


def test_index_grows_into_new_centres(spark, tmp_path):
    index = ann.VectorIndex(spark, f"file://{tmp_path}/v", sample=1000, list_rows=50)
    index.add(vectors(spark, 100, 5)[0])
    first = index.table.state()["notes"]
    index.add(vectors(spark, 200, 6, 100)[0])
    assert index.table.state()["notes"] == first and len(index.table.state()["parts"]) == 2
    index.add(vectors(spark, 500, 7, 300)[0])
    state = index.table.state()
    assert state["notes"]["fitted"] == 800 and len(state["parts"]) == 1 and index.nearest([0.0] * 16, 1000, exact=True).count() == 800
    index.clear()
    assert index.nearest([0.0] * 16) is None


def test_one_vector_many_times(spark, tmp_path):
    index = ann.VectorIndex(spark, f"file://{tmp_path}/v", sample=100, list_rows=10)
    index.add(spark.createDataFrame([(f"v{i}", "f", [1.0, 2.0]) for i in range(500)], "id string, file_name string, embedding array<double>"))
    assert [r["id"] for r in index.nearest([1.0, 2.0], 3, exact=True).collect()] == ["v0", "v1", "v10"] and index.nearest([1.0, 2.0], 3).count() == 3


def texts(spark, n, seed, start=0):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 500}" for _ in range(4000)]
    rows = [(f"d{start + i}", f"f{(start + i) % 7}", " ".join(["the", *rng.choices(words, k=rng.randrange(0, 60))]) if i % 11 else rng.choice([None, "", "..."])) for i in range(n)]
    return spark.createDataFrame(rows, "id string, file_name string, content string")


def scores(rows, question):
    return {r["id"]: r["bm25_score"] for r in bm25(rows, question).collect()}


@pytest.mark.parametrize("block", [128, 4])
def test_scores_are_those_of_the_scan(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(postings, "BLOCK", block)
    monkeypatch.setattr(postings, "SEGMENT", 900)
    index = postings.Postings(spark, f"file://{tmp_path}/w")
    assert index.search("the") is None
    first, second = texts(spark, 300, 1), texts(spark, 200, 2, 300)
    index.add(first)
    index.add(second)
    every = first.union(second).cache()
    for question in ("w1 w2 w3 w1", "the", "w77 the", "nothing known", "", "w5"):
        want = {k: v for k, v in scores(every, question).items() if v}
        got = {r["id"]: r["bm25_score"] for r in index.search(question, None).collect() if r["bm25_score"]}
        assert got == pytest.approx(want)
        for k in (3, 20):
            top = [(r["id"], r["bm25_score"]) for r in index.search(question, k).collect()]
            best = sorted(want.values(), reverse=True)[:k]
            assert [s for _, s in top if s] == pytest.approx([s for s in best if s > 0] if min(best, default=0) >= 0 else [s for s in best][: len(top)]) and all(want.get(i, 0) == pytest.approx(s) for i, s in top)
    index.forget("f3")
    left = every.where("file_name <> 'f3'")
    assert {r["id"]: r["bm25_score"] for r in index.search("w1 w2", None).collect()} == pytest.approx({k: v for k, v in scores(left, "w1 w2").items() if v})
    index.rebuild(left)
    assert {r["id"]: r["bm25_score"] for r in index.search("w1 w2", None).collect()} == pytest.approx({k: v for k, v in scores(left, "w1 w2").items() if v})


def test_a_search_opens_its_terms_files_and_skips_blocks(parted, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 8)
    index = postings.Postings(parted, f"file://{tmp_path}/w")
    rng = random.Random(4)
    rows = [(f"d{i}", "f", " ".join(["rare"] * (i % 40 == 0) + ["term"] * (1 + (i % 50 == 0) * 30) + rng.choices([f"x{j}" for j in range(900)], k=20))) for i in range(2000)]
    index.add(parted.createDataFrame(rows, "id string, file_name string, content string"))
    state = index.table.state()
    opened = len(index.table.files(state, [parted.range(1).select(F.xxhash64(F.lit("rare")).alias("p")).first()["p"]]))
    assert opened < len(index.table.files(state)) / 2
    kept, real = [], postings.Postings._promising

    def watched(self, state, held, weights, score, k):
        out = real(self, state, held, weights, score, k)
        kept.append((out.count(), held.count()))
        return out

    monkeypatch.setattr(postings.Postings, "_promising", watched)
    index.search("rare", 3).collect()
    assert math.isfinite(kept[0][0]) and kept[0][0] <= kept[0][1]


def test_rows_without_vectors(spark, tmp_path):
    index = ann.VectorIndex(spark, f"file://{tmp_path}/v")
    schema = "id string, file_name string, embedding array<double>"
    index.add(spark.createDataFrame([("a", "f", None), ("b", "f", None)], schema))
    assert index.nearest([1.0, 2.0]).count() == 0
    index.add(spark.createDataFrame([("c", "f", [1.0, 2.0]), ("d", None, [1.0, 3.0])], schema))
    assert [r["id"] for r in index.nearest([1.0, 2.0]).collect()] == ["c", "d"] and index.nearest([1.0, 2.0], 1, {"id": "d"}).first()["distance"] == 1.0
    index.forget(None)
    assert index.nearest([1.0, 2.0]).count() == 1
