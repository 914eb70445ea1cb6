"""Toxic passages: maximum-scoring segments over token log-odds with Dirichlet priors, calibrated by extreme values.

Each word has features: itself and its first six, five and four letters, told apart by 64 bits of a hash. Learning documents of either
label that hold a feature are counted, over all learning rows; equal texts of a label count once, all others each. A feature's score is
the difference of its log-odds in both labels under an informative Dirichlet prior: PRIOR documents in which features occur as often as in
all learning documents. Its deviation follows from the counts. A word takes the score of the feature with the largest score over
deviation, where that is significant and strong, else the small negative DRIFT, so that plain text runs downhill.

A linear scan finds every maximal scoring segment of a text. In clean texts the best segment S of n words exceeds x with a chance of
1 - exp(-K n exp(-lambda x)). lambda is the root of mean(exp(lambda score)) = 1 over all clean words, K is estimated from the best
segments of all clean learning texts. A passage is significant where that chance is below ALPHA. A text's passages are combined: the sum
of the r best normalised scores lambda S - ln(K n) has a chance of its own, and the smallest over r, each doubled r times, is the text's.
A logistic curve turns that chance and the text's length, both in logarithms, into a score from 0 to 1: words of a text are not
independent, so long texts have more such passages than the formula allows for. It is fitted on at most SAMPLE rows of a quarter of the
learning texts, as they score by the counts of the other three, and drawn to the weights USUAL; all other scores use all counts.

Up to MOST_FEATURES significant features go to every executor. More stay a table: texts are put together in pieces of about PIECE
characters, and each piece meets those of its own features alone, by a join, with the same scores.

Null and empty texts get the score of no evidence. Without learning rows of both labels every score is 0. Labels of a doc_id that
disagree each count; ties need no order. Rows that repeat are scored as often. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.shared import beside, crc32_text, cut, only, table

#: Documents of the prior.
PRIOR = 50.0
DRIFT = -0.3
#: Score over deviation and score from which a feature speaks; scores are held to this size.
SIGNIFICANT, STRONG, MOST = 3.5, 1.5, 8.0
SAMPLE = 20_000
#: Words that a worker remembers, and features that it counts before it passes its counts on.
REMEMBERED, COUNTED = 400_000, 2**19
#: Significant features that are broadcast, some tens of megabytes a worker; characters of the texts that meet their own beyond it.
MOST_FEATURES, PIECE = 200_000, 4_000_000
#: Chance that a clean text has a significant passage.
ALPHA = 0.01
#: The logistic curve's weights where the learning rows say nothing else.
USUAL = (-2.0, 2.4, -0.6)
_KINDS = ("clean", "toxic", "curve_clean", "curve_toxic")
_EDGES = ".,;:!?\"'()[]{}<>«»“”„¿¡…-*_#"
#: feature -> (score, score over deviation), or a table (feature, score, sure) of more than MOST_FEATURES.
Known = dict[int, tuple[float, float]] | DataFrame
Scored = Callable[[Iterator[pd.DataFrame], "_Remembered"], Iterator[pd.DataFrame]]


def features(word: str) -> tuple[int, ...]:
    """The hashes of a word's features, from the most to the least specific; none for a word without letters."""
    word = word.strip(_EDGES)
    if not word or not any(map(str.isalpha, word)):
        return ()
    kinds = [b"w" + word.encode("utf-8", "surrogatepass")] + [b"%d" % k + word[:k].encode("utf-8", "surrogatepass") for k in (6, 5, 4) if len(word) > k]
    return tuple(int.from_bytes(hashlib.blake2b(k, digest_size=8).digest(), "little", signed=True) for k in kinds)


class _Remembered(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = self.make(word)
        return value


class _Places(dict):
    """feature -> its place in a worker's counts; words -> the places of a word's features."""

    def __init__(self):
        super().__init__()
        self.words = _Remembered(lambda word: tuple(map(self.__getitem__, features(word))))

    def __missing__(self, feature: int) -> int:
        self[feature] = place = len(self)
        return place


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents by feature, apart for the curve's quarter and the rest, and by label; a null feature counts all documents."""

    def sent(places: _Places, seen: np.ndarray, docs: np.ndarray) -> pd.DataFrame:
        keys = pd.array([*places, None], "Int64")
        return pd.DataFrame({"feature": keys} | {c: np.append(seen[i, : len(places)], docs[i]) for i, c in enumerate(_KINDS)})

    places, seen, docs = _Places(), np.zeros((4, COUNTED), np.int64), np.zeros(4, np.int64)
    for pdf in batches:
        for text, toxic, curve in zip(pdf["text"], pdf["toxic"], pdf["curve"], strict=True):
            kind = 2 * int(curve) + int(toxic)
            held = set().union(*map(places.words.__getitem__, set((text or "").lower().split())))
            if len(places) > seen.shape[1]:
                seen = np.pad(seen, ((0, 0), (0, len(places))))
            docs[kind] += 1
            seen[kind, np.fromiter(held, np.int64, len(held))] += 1
            if len(places) >= COUNTED:
                yield sent(places, seen, docs)
                places, seen, docs = _Places(), np.zeros((4, COUNTED), np.int64), np.zeros(4, np.int64)
    yield sent(places, seen, docs)


def _odds(clean: Column, toxic: Column, n_clean: int, n_toxic: int) -> tuple[Column, Column]:
    """A feature's score and its score over deviation, by log-odds with an informative Dirichlet prior."""
    alpha = PRIOR * (clean + toxic) / (n_clean + n_toxic)
    log_odds = [F.log((y + alpha) / (n + PRIOR - y - alpha)) for y, n in ((clean, n_clean), (toxic, n_toxic))]
    score = log_odds[1] - log_odds[0]
    return F.greatest(F.lit(-MOST), F.least(F.lit(MOST), score)), score / F.sqrt(1 / (clean + alpha) + 1 / (toxic + alpha))


def speaking(counts: DataFrame, clean: Column, toxic: Column, n_clean: int, n_toxic: int) -> Known:
    """The features whose score is significant, for or against. Features of every document say nothing and are left out."""
    held = counts.where((clean + toxic > 0) & (clean + toxic < n_clean + n_toxic))
    score, sure = _odds(clean, toxic, n_clean, n_toxic)
    found = held.select("feature", score.alias("score"), sure.alias("sure")).where(F.abs("sure") >= SIGNIFICANT)
    rows = found.limit(MOST_FEATURES + 1).collect()
    return {r["feature"]: (r["score"], r["sure"]) for r in rows} if len(rows) <= MOST_FEATURES else found


def _scorer(known: dict[int, tuple[float, float]]) -> _Remembered:
    def make(word: str) -> float:
        score, sure = max((known[f] for f in features(word) if f in known), key=lambda x: abs(x[1]), default=(0.0, 0.0))
        return score if sure >= SIGNIFICANT and score >= STRONG else DRIFT

    return _Remembered(make)


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with the number of their piece: rows in a row, up to PIECE characters and one text."""
    piece, size = TaskContext.get().partitionId() << 33, 0
    for pdf in batches:
        of = []
        for text in pdf["text"]:
            if size >= PIECE:
                piece, size = piece + 1, 0
            size += 1 + len(text or "")
            of.append(piece)
        yield pdf.assign(piece=np.array(of, np.int64))


def _asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The features of each piece, once a batch."""
    for pdf in batches:
        for piece, texts in pdf.groupby("piece")["text"]:
            words = set().union(*((t or "").lower().split() for t in texts))
            held = set().union(*map(features, words))
            yield pd.DataFrame({"piece": np.full(len(held), piece, np.int64), "feature": np.fromiter(held, np.int64, len(held))})


def scored(rows: DataFrame, known: Known, run: Scored, schema: str) -> DataFrame:
    """What run makes of rows (text, others), by a scorer that knows the features of the texts it gets."""
    if isinstance(known, dict):
        shared = rows.sparkSession.sparkContext.broadcast(known)  # at most MOST_FEATURES
        return rows.mapInPandas(lambda batches: run(batches, _scorer(shared.value)), schema)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    held = cut(rows.mapInPandas(_pieces, f"{fields}, piece long"))
    asked = held.select("piece", "text").mapInPandas(_asked, "piece long, feature long").distinct()
    told = asked.join(known, "feature")

    def each(texts: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        own = dict(zip(told["feature"].tolist(), zip(told["score"].tolist(), told["sure"].tolist(), strict=True), strict=True))
        return pd.concat(run(iter([texts.drop(columns="piece")]), _scorer(own)))

    return held.groupBy("piece").cogroup(told.groupBy("piece")).applyInPandas(each, schema)


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end) of a sequence, in linear time: each candidate runs from a positive score on and
    joins the nearest candidate to its left with a lower start, if its right end is not below the joined one's."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    found: list[tuple[int, int, float, float, int]] = []  # start, end, left sum, right sum, candidate with a lower left sum or -1
    for i in up.tolist():
        start, end, left, right = i, i + 1, total[i], total[i + 1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append((start, end, left, right, j))
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
    return [(r - l, s, e) for s, e, l, r, _ in found]


def word_scores(text: str | None, scorer: _Remembered) -> np.ndarray:
    """The scores of a text's words; where a word that speaks repeats, DRIFT."""
    words = (text or "").lower().split()
    scores = np.fromiter(map(scorer.__getitem__, words), np.float32, len(words))
    said: set[str] = set()
    for i in np.flatnonzero(scores > 0).tolist():
        if words[i] in said:
            scores[i] = DRIFT
        said.add(words[i])
    return scores


def evidence(text: str | None, scorer: _Remembered, rate: float, k: float) -> tuple[float, int, list[tuple[float, int, int]]]:
    """(minus the logarithm of the chance that a clean text has such passages, words, the significant passages by word numbers)."""
    scores = word_scores(text, scorer)
    n, found = len(scores), segments(scores)
    if not found:
        return 0.0, n, []
    floor = math.log(k * n)
    good = [s for s in found if rate * s[0] - floor > -math.log(-math.log1p(-ALPHA))]
    total, least = 0.0, 0.0
    for r, normal in enumerate(sorted((rate * s[0] - floor for s in found if rate * s[0] > floor), reverse=True), 1):
        total += normal
        least = min(least, (r - 1) * math.log(total) - total - math.lgamma(r + 1) - math.lgamma(r) + r * math.log(2))
    return -least, n, good


def _rate(share: dict[float, int]) -> float:
    """The positive root of mean(exp(rate * score)) = 1."""
    values, n = np.array(list(share)), np.array(list(share.values()), float)
    n /= n.sum()
    if values.max(initial=0) <= 0 or (values * n).sum() >= 0:
        return 1.0
    low, high = 1e-6, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (n * np.exp(mid * values)).sum() < 1 else (low, mid)
    return float(np.clip(low, 0.05, 5.0))


def extreme_values(words: dict[float, int], best: dict[float, tuple[int, int]]) -> tuple[float, float]:
    """(lambda, K) from the scores of clean words (score: how many) and the best segments of clean texts (score: texts, their words). A
    word of the highest score is taken to be seen once more than it was, so that what no clean text held stays possible."""
    top = max([MOST / 2, *words])
    rate = _rate({**words, top: words.get(top, 0) + 1})
    texts = sum(n for n, _ in best.values())
    weight = sum(size * math.exp(-rate * s) for s, (_, size) in best.items())
    return rate, min(1.0, max(1e-6, texts / weight)) if weight else 1.0


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton's method, drawn to USUAL with the weight of one row, so that a few rows without evidence leave them."""
    x, w = np.column_stack([np.ones(len(x)), x]), np.array(USUAL)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - (w - USUAL))
    return w


def _inputs(against: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.column_stack([np.log1p(np.clip(against, 0, 1e4)), np.log1p(words)])


def _curved() -> Column:
    """Whether a text is of the quarter that the curve is fitted on; equal texts are on one side."""
    return F.pmod(F.xxhash64("text"), F.lit(4)) == 0


def _clean_scores(batches: Iterator[pd.DataFrame], scorer: _Remembered) -> Iterator[pd.DataFrame]:
    """Of clean texts: kind 0, a word's score and how many words have it; kind 1, a best segment's score, how many texts, their words."""
    words: dict[float, int] = {}
    best: dict[float, list[int]] = {}
    for pdf in batches:
        for text in pdf["text"]:
            scores = word_scores(text, scorer)
            for value, n in zip(*np.unique(np.round(scores, 1), return_counts=True), strict=True):
                words[round(float(value), 1)] = words.get(round(float(value), 1), 0) + int(n)
            if len(scores):
                top = best.setdefault(round(max((s for s, _, _ in segments(scores)), default=0.0), 1), [0, 0])
                top[0] += 1
                top[1] += len(scores)
    rows = [(0, s, n, 0) for s, n in words.items()] + [(1, s, *n) for s, n in best.items()]
    yield pd.DataFrame(rows, columns=["kind", "s", "n", "size"]).astype({"kind": int, "s": float, "n": "int64", "size": "int64"})


def fit(labelled: DataFrame) -> dict | None:
    """The model from rows (doc_id, text, toxic)."""
    each = labelled.select("text", "toxic").distinct().withColumn("curve", _curved())
    counts = cut(each.mapInPandas(_counted, "feature long, " + ", ".join(f"{c} long" for c in _KINDS)).groupBy("feature").agg(*[F.sum(c).alias(c) for c in _KINDS]))
    whole = counts.where("feature is null").first()
    rest = {c: whole[c] if whole else 0 for c in _KINDS}
    n_clean, n_toxic = rest["clean"] + rest["curve_clean"], rest["toxic"] + rest["curve_toxic"]
    if not n_clean or not n_toxic:
        return None
    counts = counts.where("feature is not null")
    known = speaking(counts, F.col("clean") + F.col("curve_clean"), F.col("toxic") + F.col("curve_toxic"), n_clean, n_toxic)
    apart = speaking(counts, F.col("clean"), F.col("toxic"), rest["clean"], rest["toxic"]) if rest["clean"] and rest["toxic"] else None
    clean = scored(labelled.where("toxic = 0").select("text"), known, _clean_scores, "kind int, s double, n long, size long")
    clean = clean.groupBy("kind", "s").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).collect()  # scores have one decimal
    rate, k = extreme_values({r["s"]: r["n"] for r in clean if r["kind"] == 0} or {DRIFT: 1}, {r["s"]: (r["n"], r["size"]) for r in clean if r["kind"] == 1})
    weights = np.array(USUAL)
    if apart is not None:

        def evident(batches: Iterator[pd.DataFrame], scorer: _Remembered) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [evidence(t, scorer, rate, k)[:2] for t in pdf["text"]]
                yield pd.DataFrame(rows, columns=["a", "n"]).assign(toxic=pdf["toxic"].to_numpy()).astype({"a": float, "n": "int64"})

        rows = labelled.where(_curved()).select("doc_id", "text", "toxic")
        n = rows.count()
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE / max(1, n)))).select("text", "toxic")
        seen = scored(rows, apart, evident, "a double, n long, toxic int").toPandas()
        if seen["toxic"].nunique() == 2:
            weights = _curve(_inputs(seen["a"].to_numpy(), seen["n"].to_numpy()), seen["toxic"].to_numpy().astype(float))
    return {"known": known, "rate": rate, "k": k, "weights": weights}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, score, passages (start and end word of each significant passage)."""
    held = only(docs, "doc_id", "text").select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # pandas rounds wide ids beside nulls
    kind = "array<struct<start:int,end:int,score:double>>"
    doc_id = F.col("doc_id").cast("bigint").alias("doc_id")
    if model is None:
        return held.select(doc_id, F.lit(0.0).alias("score"), F.array().cast(kind).alias("passages"))
    rate, k, weights = model["rate"], model["k"], model["weights"]

    def run(batches: Iterator[pd.DataFrame], scorer: _Remembered) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen = [evidence(t, scorer, rate, k) for t in pdf["text"]]
            x = _inputs(*(np.array([s[i] for s in seen], float) for i in range(2)))
            p = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": p, "passages": [[{"start": a, "end": b, "score": s} for s, a, b in found] for *_, found in seen]})

    return scored(held, model["known"], run, f"doc_id string, score double, passages {kind}").select(doc_id, "score", "passages")


def op3_max_segment_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc32_text(F.col("doc_id")) % 3 == 1
    known = only(labels, "doc_id", "toxic").where(~held_out & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    labelled = cut(beside(only(docs, "doc_id", "text").where(~held_out), cut(known), "doc_id", "inner", salts=1))
    found = score(docs, fit(labelled))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "passages")
