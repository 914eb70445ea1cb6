"""Language-model scoring against exact counts of real documents."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm import lm_scoring
from tests.llm.test_models import words

SF = "/root/testdata/sf0.001"


def expected(rows, learned, own):
    """doc_id -> (target loss, background loss) of rows (doc_id, text, wanted) by the counts of learned; own: each document is among those
    and its counts are subtracted."""
    models = {}
    for name in ("target", "background"):
        single, pair = Counter(), Counter()
        for _, text, wanted in learned:
            if wanted or name == "background":
                w = ["<s>", *words(text)]
                single.update(w)
                pair.update(zip(w, w[1:], strict=False))
        models[name] = single, pair, sum(single.values())
    scale = models["target"][2] / models["background"][2]
    out = {}
    for doc, text, wanted in rows:
        w, losses = ["<s>", *words(text)], []
        mine, pairs = Counter(w), Counter(zip(w, w[1:], strict=False))
        for name, by in (("target", 1.0), ("background", scale)):
            single, pair, total = models[name]
            less = int(own and (wanted or name == "background"))
            loss = 0.0
            for u, v in zip(w, w[1:], strict=False):
                plain = (by * (single[v] - less * mine[v]) + lm_scoring.NU / lm_scoring.VOCABULARY) / (by * (total - less * len(w)) + lm_scoring.NU)
                loss -= math.log((by * (pair[u, v] - less * pairs[u, v]) + lm_scoring.MU * plain) / (by * (single[u] - less * mine[u]) + lm_scoring.MU))
            losses.append(loss / max(1, len(w) - 1))
        out[doc] = losses
    return out


@pytest.mark.parametrize("own", [True, False])
def test_lm_scoring_counts_every_word_and_pair(spark, monkeypatch, own):
    """Real documents in several batches and slices, each scored by the others, or by models of other rows."""
    monkeypatch.setattr(lm_scoring, "BATCH", 3000)
    monkeypatch.setattr(lm_scoring, "SLICE", 500)
    if own:
        good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
        rows = [(r["doc_id"], r["text"], r["doc_id"] in good) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
        got, want = lm_scoring.op6_cross_entropy_difference(spark, SF).collect(), expected(rows, rows, True)
    else:
        held = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", (F.col("doc_id") % 3 == 0).alias("wanted"))
        rows = [tuple(r) for r in held.collect()]
        learned = held.where("doc_id % 2 = 0")
        got, want = lm_scoring.score(held, lm_scoring.fit(learned)).collect(), expected(rows, [r for r in rows if r[0] % 2 == 0], False)
    assert len(got) == len(rows)
    tokens = {doc: len(words(text)) for doc, text, _ in rows}
    for r in got:
        assert r["n_tokens"] == tokens[r["doc_id"]]
        if r["n_tokens"]:
            target, background = want[r["doc_id"]]
            assert r["loss_target"] == pytest.approx(target, rel=1e-9) and r["loss_background"] == pytest.approx(background, rel=1e-9)
            assert r["ce_diff"] == pytest.approx(target - background, abs=1e-9)


def test_copies_stand_out(spark):
    """A document that occurs twice is known to the background by its copy alone."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("n_chars > 500").dropDuplicates(["text"]).orderBy("doc_id").limit(60)
    rows = docs.unionByName(docs.where("doc_id % 2 = 0").withColumn("doc_id", F.col("doc_id") + 1000)).withColumns({"learned": F.lit(True), "wanted": F.col("doc_id") % 5 == 0, "asked": F.lit(True)})
    got = lm_scoring._losses(rows, 1000).collect()
    twice, once = ([r["loss_background"] for r in got if (r["doc_id"] % 2 == 0) is even] for even in (True, False))
    assert sorted(twice)[-2] < sorted(once)[len(once) // 2] and sum(twice) / len(twice) < sum(once) / len(once) - 1
