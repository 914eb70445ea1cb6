"""Toxicity's statistics against brute force over all learning rows."""

import math
from collections import Counter

import numpy as np
import pytest

from tessella.llm import toxicity


def test_counts_and_rate_cover_every_learning_row(spark, monkeypatch):
    """Documents that share a passage each count, in every quarter; equal texts count once; counts are passed on in parts."""
    monkeypatch.setattr(toxicity, "COUNTED", 64)
    rng = np.random.default_rng(3)
    passage, plain, bad = "one passage that all of these share", [f"plain{a}{b}" for a in "abcdefgh" for b in "klmnopqrst"], [f"{a}vile" for a in "uvwxyz"]
    rows = [(i, f"{passage} {' '.join(rng.choice(plain, 6))}" + (f" {' '.join(rng.choice(bad, 3))}" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(300)]
    rows += [(300 + i, *rows[1][1:]) for i in range(50)] + [(400, None, 0), (401, "", 0)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    n, seen = [0, 0], (Counter(), Counter())
    for text, toxic in {(t, k) for _, t, k in rows}:
        n[toxic] += 1
        seen[toxic].update({p for w in (text or "").lower().split() for p in toxicity.features(w)})
    want = {}
    for f in {*seen[0], *seen[1]}:
        y, alpha = (seen[0][f], seen[1][f]), toxicity.PRIOR * (seen[0][f] + seen[1][f]) / sum(n)
        if sum(y) == sum(n):
            continue
        odds = [math.log((y[k] + alpha) / (n[k] + toxicity.PRIOR - y[k] - alpha)) for k in (0, 1)]
        score = odds[1] - odds[0]
        sure = score / math.sqrt(1 / (y[0] + alpha) + 1 / (y[1] + alpha))
        if abs(sure) >= toxicity.SIGNIFICANT:
            want[f] = score, sure
    assert model["known"].keys() == want.keys() and len(want) >= 6
    for f, (score, sure) in want.items():
        assert model["known"][f] == pytest.approx((score, sure))
    scorer, words, best = toxicity._scorer(want), Counter(), {}
    for _, text, toxic in rows:
        if not toxic and text:
            held = text.lower().split()
            scores = [toxicity.DRIFT if scorer[w] > 0 and w in held[:i] else scorer[w] for i, w in enumerate(held)]
            words.update(round(s, 1) for s in scores)
            top = round(max([0.0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))]), 1)
            count, size = best.get(top, (0, 0))
            best[top] = count + 1, size + len(scores)
    assert (model["rate"], model["k"]) == pytest.approx(toxicity.extreme_values(words, best))


def test_features_beyond_the_broadcast_give_the_same_scores(spark, monkeypatch):
    """Where the significant features stay a table, the model and all scores are those of the broadcast; wide ids stay exact beside nulls."""
    rng = np.random.default_rng(5)
    plain, bad = [f"plain{a}{b}" for a in "abcdefgh" for b in "klmnopqrst"], [f"{a}vile" for a in "uvwxyz"]
    rows = [(2**62 + i, " ".join([*rng.choice(plain, 9), *(rng.choice(bad, 3) if i % 4 == 0 else [])]), int(i % 4 == 0)) for i in range(240)]
    rows += [(None, "uvile vvile wvile", 1), (2**62 + 900, None, 0), (2**62 + 901, "", 0), (2**62 + 1, rows[1][1], 0)]
    learn = spark.createDataFrame(rows, "doc_id long, text string, toxic int")

    def told(model):
        return sorted((str(r["doc_id"]), round(r["score"], 9), str(r["passages"])) for r in toxicity.score(learn, model).collect())

    small = toxicity.fit(learn)
    want = told(small)
    assert len(want) == len(rows) and {r[0] for r in want} == {str(r[0]) for r in rows} and len({r[1] for r in want}) > 5
    monkeypatch.setattr(toxicity, "MOST_FEATURES", 3)
    monkeypatch.setattr(toxicity, "PIECE", 500)
    large = toxicity.fit(learn)
    assert not isinstance(large["known"], dict) and large["known"].count() == len(small["known"])
    assert (large["rate"], large["k"]) == pytest.approx((small["rate"], small["k"])) and large["weights"] == pytest.approx(small["weights"])
    assert told(large) == want


def test_extreme_values_of_known_scores():
    """lambda solves mean(exp(lambda score)) = 1, and K makes the expected number of texts with their best scores right."""
    words, best = {-0.1: 9990, 2.0: 9}, {0.0: (95, 9500), 2.0: (5, 499)}
    rate, k = toxicity.extreme_values(words, best)
    assert (9990 * math.exp(-0.1 * rate) + 9 * math.exp(2 * rate) + math.exp(toxicity.MOST / 2 * rate)) / 10_000 == pytest.approx(1, abs=1e-6)
    assert k == pytest.approx(100 / (9500 + 499 * math.exp(-2 * rate)))


def test_passages_combine():
    """Two passages say more than one of them, a long text makes one less telling, and plain text says nothing."""
    scorer = toxicity._scorer({f: (4.0, 9.0) for w in ("vile", "foul", "base", "mean") for f in toxicity.features(w)})
    one, two = "plain " * 50 + "vile foul " + "plain " * 50, "plain " * 50 + "vile foul " + "plain " * 50 + "base mean " + "plain " * 50
    a, b, long = (toxicity.evidence(t, scorer, 1.0, 0.1)[0] for t in (one, two, one + "plain " * 5000))
    assert b > a > long > 0 and toxicity.evidence("plain " * 100, scorer, 1.0, 0.1) == (0.0, 100, [])
    assert toxicity.evidence("vile " * 60, scorer, 1.0, 0.1)[0] < a  # a word that repeats speaks once
    s = 8.0 - math.log(0.1 * 102)
    assert a == pytest.approx(s - math.log(2), abs=0.05)
