"""Vector search by lists of uneven size: every query gets its k rows, and the right ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import vector_search


def asked_of(spark, ids, x, queries):
    v = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, x, strict=True)], "id long, v array<double>")
    return vector_search.search(v, F.col("id").isin(queries)).collect()


def test_every_query_gets_k_rows(spark, monkeypatch):
    """A hot list, lists of one and of three vectors, one list to visit at first, and an id that many rows share."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8))
    x[300:303] += 40
    x[399] -= 90
    ids = np.arange(400)
    ids[310:330] = 310
    x[310:330] = x[310] + 200 + 0.01 * rng.normal(size=(20, 8))
    fit = vector_search.fit
    centres = np.stack([x[:300].mean(0), x[300], x[399], x[310]])
    monkeypatch.setattr(vector_search, "fit", lambda v, k: (m := fit(v, k)) | {"centres": centres, "visits": 1, "owner": vector_search._near_lists(m["sample"], centres)[:, 0]})
    monkeypatch.setattr(vector_search, "GUIDES", 1)
    asked = [0, 50, 300, 310, 399]
    got = asked_of(spark, ids, x, asked)
    assert {q: sum(r["query_id"] == q for r in got) for q in asked} == dict.fromkeys(asked, 10) | {310: 200}
    assert all(r["query_id"] != r["vec_id"] or r["query_id"] == 310 for r in got)
    want = sorted((310, int(ids[j]), d[j]) for i in range(310, 330) for d in [np.sqrt(((x - x[i]) ** 2).sum(1)) + np.where(np.arange(400) == i, np.inf, 0)] for j in np.lexsort((ids, d))[:10])
    mine = sorted((r["query_id"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 310)
    assert [m[:2] for m in mine] == [w[:2] for w in want] and [m[2] for m in mine] == pytest.approx([w[2] for w in want])
    assert {r["vec_id"] for r in got if r["query_id"] == 300 and r["rank"] <= 2} == {301, 302}


@pytest.mark.parametrize(("clusters", "spread", "norm"), [(20, 0.08, 3), (6, 0.01, 12)])
def test_recall_of_clusters_and_outliers(spark, clusters, spread, norm):
    """Loose and tight clusters with outliers of larger norms, in lists: recall against brute force."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(clusters, 32))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    out = rng.normal(size=(40, 32))
    x = np.vstack([out / np.linalg.norm(out, axis=1)[:, None] * norm, centres[rng.integers(0, clusters, 4000)] + spread * rng.normal(size=(4000, 32))])
    queries = [*range(0, 20), *range(40, 4040, 100)]
    got = {}
    for r in asked_of(spark, np.arange(len(x)), x, queries):
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = []
    for q in queries:
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits.append(len(got[q] & set(np.argsort(d)[:10].tolist())) / 10)
    assert np.mean(hits[:20]) >= 0.9 and np.mean(hits[20:]) >= 0.9
