"""Cross-entropy difference: how much more a document reads like the target corpus than like the whole.

Two interpolated bigram models share one vocabulary and count every distinct word and word pair: the target over the documents that a
label marks as wanted, the background over all. They are matched: background counts are scaled to the target's number of tokens, so both
carry the same weight against the smoothing, which is alike; a pair's probability backs off to the word's with weight MU, a word's to
the uniform one, 1 / VOCABULARY, with weight NU. A document is scored by what the others say: its own counts are subtracted from each
model that it was counted in. Its score is its mean loss per token under the target model less that under the background model: low
means like the target.

Words and pairs are told apart by 64 bits of a hash; no table of fixed size is kept. Rows are read and written once as batches of about
BATCH tokens, words as numbers of the batch. A batch sends each of its distinct words and pairs once, with its counts, to the bucket of
the hash; the bucket adds what all batches sent and answers each with what the others counted; the batch scores its documents with the
answers, some at a time. A frequent pair is thus one entry a batch, and a bucket's share stays the same size, as the number of buckets
grows with the text. Null and empty texts have no tokens and null losses. Rows that repeat count and score as often, each by the others.
Without a wanted row all scores are 0. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.shared import beside, cut, only, table

VOCABULARY = 2**17
MU, NU = 50.0, 1000.0
#: Tokens of a batch, about; characters of text for each bucket, and the least buckets, as powers of two.
BATCH = 1_500_000
BUCKET_CHARS, LEAST_BUCKETS = 2**25, 2**9
#: Tokens that a batch scores at a time, about.
SLICE = 200_000
_HELD = "batch long, asked boolean, hashes binary, w binary, about binary, n_background long, n_target long"
_SENT = "batch long, bucket int, asked boolean, keys binary, background binary, target binary"
_SCORES = "doc_id long, n_tokens long, loss_target double, loss_background double, ce_diff double"


def _hash(mark: bytes, word: str = "") -> int:
    return int.from_bytes(hashlib.blake2b(mark + word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class _Ids(dict):
    """The numbers of a batch's words as they stand in texts; hashes has a row for each word without its punctuation. 0 starts a text."""

    def __init__(self):
        super().__init__()
        self.words: dict[str, int] = {}
        self.hashes = [_hash(b"start")]

    def __missing__(self, raw: str) -> int:
        word = raw.strip(".,;:!?\"'()")
        if word not in self.words:
            self.words[word] = len(self.hashes)
            self.hashes.append(_hash(b"w", word))
        self[raw] = i = self.words[word]
        return i


def _squeezed(x: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes."""
    return zlib.compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _whole(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(b), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _steps(keys: np.ndarray) -> np.ndarray:
    """Ascending keys as steps, which squeeze well."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.int64)


def _climbed(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps.view(np.uint64), dtype=np.uint64)


def _keys(w: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A batch's ascending keys, the place of each word among them, the place and the (words) of each distinct pair, the tokens' places in
    w and each token's pair. w: the words of all texts, each with the start mark 0 before them; lengths: the words of each, with the mark."""
    follows = np.ones(len(w), bool)
    follows[np.cumsum(lengths) - lengths] = False
    at = np.flatnonzero(follows)
    codes, pair = np.unique(w[at - 1] * np.int64(len(hashes)) + w[at], return_inverse=True)
    u, v = np.divmod(codes, len(hashes))
    h = hashes[u] * np.uint64(0x9E3779B97F4A7C15) + (hashes[v] ^ (hashes[v] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    keys, place = np.unique(np.concatenate([hashes, h ^ (h >> np.uint64(31))]), return_inverse=True)
    return keys, place[: len(hashes)], place[len(hashes) :], np.stack([u, v]), at, pair.astype(np.int32)


def _counted(w: np.ndarray, lengths: np.ndarray, chosen: np.ndarray, n_keys: int, words: np.ndarray, pairs: np.ndarray, at: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """How often each key occurs in the chosen texts of a batch."""
    own = np.repeat(chosen, lengths)
    n = np.zeros(n_keys, np.int64)
    np.add.at(n, words, np.bincount(w[own], minlength=len(words)))
    np.add.at(n, pairs, np.bincount(pair[own[at]], minlength=len(pairs)))
    return n


def _held(batch: int, ids: _Ids, rows: list[tuple]) -> pd.DataFrame:
    """A batch of (words, doc_id, learned, wanted, asked) as one row."""
    lengths = np.array([len(r[0]) for r in rows])
    flags = np.array([r[2:] for r in rows], bool)
    flags[:, 1] &= flags[:, 0]
    known = np.array([r[1] is not None and r[1] == r[1] for r in rows])
    names = np.array([int(r[1]) if k else 0 for r, k in zip(rows, known, strict=True)], np.int64)
    about = _squeezed(np.concatenate([lengths, names, known, *flags.T]))
    row = (batch, bool(flags[:, 2].any()), np.array(ids.hashes, "<u8").tobytes(), _squeezed(np.concatenate([r[0] for r in rows])), about, *(int(lengths[f].sum()) for f in flags[:, :2].T))
    return pd.DataFrame([row], columns=[c.split()[0] for c in _HELD.split(", ")])


def _opened(hashes: bytes, w: bytes, about: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of a batch's words, its texts, and of each text its length, doc_id, whether that is known, learned, wanted, asked."""
    return np.frombuffer(hashes, "<u8"), _whole(w).astype(np.int32), _whole(about).reshape(6, -1)


def _sending(bits: int):
    """What each batch sends: its counts by bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for batch, asked, *held in zip(pdf["batch"], pdf["asked"], pdf["hashes"], pdf["w"], pdf["about"], strict=True):
                hashes, w, about = _opened(*held)
                keys, words, pairs, _, at, pair = _keys(w, about[0], hashes)
                counts = [_counted(w, about[0], chosen.astype(bool), len(keys), words, pairs, at, pair) for chosen in about[3:5]]
                bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
                edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(keys)]
                sent = [(batch, int(bucket[a]), asked, _squeezed(_steps(keys[a:b])), *(_squeezed(c[a:b]) for c in counts)) for a, b in zip(edges, edges[1:], strict=False) if a < b]
                yield pd.DataFrame(sent, columns=[c.split()[0] for c in _SENT.split(", ")])

    return run


def _batched(most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch, ids, held, size = TaskContext.get().partitionId() << 32, _Ids(), [], 0
        for pdf in batches:
            for text, *about in zip(pdf["text"], pdf["doc_id"].astype(object), pdf["learned"], pdf["wanted"], pdf["asked"], strict=True):
                words = (text or "").lower().split()
                w = np.zeros(len(words) + 1, np.int32)
                w[1:] = np.fromiter(map(ids.__getitem__, words), np.int32, len(words))
                held.append((w, *about))
                size += len(w)
                if size >= most:
                    yield _held(batch, ids, held)
                    batch, ids, held, size = batch + 1, _Ids(), [], 0
        if held:
            yield _held(batch, ids, held)

    return run


def _answered(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket: for each key that an asking batch sent, in the order of its keys, what all other batches counted."""
    sent = [_climbed(_whole(k)) for k in pdf["keys"]]
    keys, place = np.unique(np.concatenate(sent), return_inverse=True)
    ends = np.cumsum([len(k) for k in sent])[:-1]
    out = {"batch": pdf["batch"], "bucket": pdf["bucket"]}
    for name in ("background", "target"):
        each = np.concatenate([_whole(n) for n in pdf[name]])
        total = np.bincount(place, each, len(keys)).astype(np.int64)
        out[name] = [_squeezed(x) for x in np.split(total[place] - each, ends)]
    return pd.DataFrame(out)[pdf["asked"].to_numpy(bool)]


def _within(text: np.ndarray, what: np.ndarray, many: int) -> np.ndarray:
    """For each position how often its text holds what stands there."""
    _, place, n = np.unique(text * np.int64(many) + what, return_inverse=True, return_counts=True)
    return n[place]


def _scored(totals: tuple[int, int]):
    scale = totals[1] / totals[0] if totals[1] else 1.0

    def run(key, sums: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
        sums = sums.sort_values("bucket")
        hashes, w, about = _opened(*info[["hashes", "w", "about"]].iloc[0])
        lengths, names, known, learned, wanted, asked = about
        keys, words, pairs, (u, v), at, pair = _keys(w, lengths, hashes)
        counts = {}
        for name, chosen in (("background", learned), ("target", wanted)):
            count = np.concatenate([_whole(n) for n in sums[name]]) + _counted(w, lengths, chosen.astype(bool), len(keys), words, pairs, at, pair)
            counts[name] = count[words], count[pairs]
        del keys, words, pairs, sums
        ends, starts = np.cumsum(lengths), np.cumsum(lengths) - lengths
        losses = {name: np.full(len(lengths), np.nan) for name in counts}
        lo = 0
        while lo < len(lengths):
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + SLICE, "right")))
            texts, own = np.repeat(np.arange(hi - lo), lengths[lo:hi]), w[starts[lo] : ends[hi - 1]]
            a, b = np.searchsorted(at, [starts[lo], ends[hi - 1]])
            here, chosen = at[a:b] - starts[lo], pair[a:b]
            text, first_word, second_word = texts[here], u[chosen], v[chosen]
            own_word, own_pair = _within(texts, own, len(hashes)), _within(text, chosen, len(u))
            n = lengths[lo:hi]
            for name, total, counted, by in zip(("background", "target"), totals, (learned, wanted), (scale, 1.0), strict=True):
                single, double = counts[name]
                mine = counted[lo:hi][text]
                first = by * (single[first_word] - mine * own_word[here - 1])
                plain = (by * (single[second_word] - mine * own_word[here]) + NU / VOCABULARY) / (by * (total - mine * n[text]) + NU)
                token = -np.log((by * (double[chosen] - mine * own_pair) + MU * plain) / (first + MU))
                losses[name][lo:hi] = np.where(n > 1, np.bincount(text, token, hi - lo) / np.maximum(1, n - 1), np.nan)
            lo = hi
        background = losses["background"]
        target = losses["target"] if totals[1] else background
        ids = pd.array(names, "Int64")
        ids[~known.astype(bool)] = pd.NA
        out = {"doc_id": ids, "n_tokens": lengths - 1} | {c: pd.array(x, "Float64") for c, x in (("loss_target", target), ("loss_background", background), ("ce_diff", target - background))}
        made = pd.DataFrame(out)
        made.loc[lengths == 1, ["loss_target", "loss_background", "ce_diff"]] = pd.NA
        return made[asked.astype(bool)]

    return run


def _losses(rows: DataFrame, chars: int) -> DataFrame:
    """rows (doc_id, text, learned, wanted, asked): the scores of those asked about, by the counts of those learned."""
    bits = max(LEAST_BUCKETS, chars // BUCKET_CHARS).bit_length() - 1
    held = cut(rows.mapInPandas(_batched(BATCH), _HELD))
    totals = held.agg(F.sum("n_background"), F.sum("n_target")).first()
    sums = held.select("batch", "asked", "hashes", "w", "about").mapInPandas(_sending(bits), _SENT).groupBy("bucket").applyInPandas(_answered, "batch long, bucket int, background binary, target binary")
    info = held.where("asked").select("batch", "hashes", "w", "about")
    return sums.groupBy("batch").cogroup(info.groupBy("batch")).applyInPandas(_scored((totals[0] or 0, totals[1] or 0)), _SCORES)


def _chars(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.length("text"))).first()[0] or 0


def fit(docs: DataFrame) -> DataFrame:
    """The learning rows (text, wanted); score() counts them, as counts are only asked for by key."""
    return docs.select("text", "wanted")


def score(docs: DataFrame, learned: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_tokens, loss_target, loss_background, ce_diff."""
    held = only(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.lit(False).alias("learned"), F.lit(False).alias("wanted"), F.lit(True).alias("asked"))
    known = learned.select(F.lit(None).cast("bigint").alias("doc_id"), "text", F.lit(True).alias("learned"), F.coalesce("wanted", F.lit(False)).alias("wanted"), F.lit(False).alias("asked"))
    return _losses(held.unionByName(known), _chars(held) + _chars(known))


def op6_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    wanted = only(table(spark, sf_dir, "labels"), "doc_id", "quality").where("quality = 1").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    marked = beside(docs, cut(wanted.withColumn("wanted", F.lit(True))), "doc_id", salts=1)
    return _losses(marked.select("doc_id", "text", F.lit(True).alias("learned"), F.coalesce("wanted", F.lit(False)).alias("wanted"), F.lit(True).alias("asked")), _chars(docs))
