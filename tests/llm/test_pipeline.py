"""The corpus pipeline stage by stage, each against brute force on what the stage before kept."""

import bisect
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import langid, mixing, pii
from tests.llm.test_models import base_spans
from tests.llm.test_operators import shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, held[-1], SF).write.parquet(f"file://{folder}/{name}")
        held.append(spark.read.parquet(f"file://{folder}/{name}"))
    for made in held[:-1]:
        assert made.schema == docs.schema
    return [[r.asDict() for r in h.collect()] for h in held]


def key(row):
    return tuple(row.values())


def test_languages(spark, stages):
    before, after = stages[:2]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r["doc_id"] for r in langid.classify(docs, langid.fit(langid.learning(docs))).where("rejected").collect()}
    assert sorted(map(key, after)) == sorted(key(r) for r in before if r["doc_id"] not in out)
    assert len(after) > 0.9 * len(before)


def test_near_duplicates(stages):
    before, after = stages[1:3]
    sets = {r["doc_id"]: shingles(r["text"]) for r in before}
    root = {d: d for d in sets}

    def find(d):
        return d if root[d] == d else find(root[d])

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert sorted(map(key, after)) == sorted(key(r) for r in before if find(r["doc_id"]) == r["doc_id"])
    assert len(after) < len(before)


def test_personal_data(spark, stages):
    """Every span is replaced by its kind; the base ones are the patterns', and secrets are among the added ones."""
    before, after = stages[2:4]
    now = {r["doc_id"]: r for r in after}
    assert sorted(now) == sorted(r["doc_id"] for r in before)
    found = pii.found(spark.createDataFrame([(r["doc_id"], r["text"]) for r in before], "doc_id long, text string"))
    spans = {r["doc_id"]: r["s"].split(",") if r["s"] else [] for r in found.select("doc_id", pii.listed(F.col("spans")).alias("s")).collect()}
    kinds = Counter()
    for r in before:
        text, at, out = r["text"], 0, []
        assert {*filter(None, base_spans(text).split(","))} <= {*spans[r["doc_id"]]}
        for m in re.finditer(r'token = "([0-9a-f]{40})"', text):
            assert f"secret:{m.start(1)}:{m.end(1)}" in spans[r["doc_id"]]
        for start, less, kind in sorted((int(a), -int(b), k) for k, a, b in (s.split(":") for s in spans[r["doc_id"]])):
            kinds[kind] += 1
            if start >= at:
                out += [text[at:start], f"<{kind.upper()}>"]
            at = max(at, -less)
        want = "".join(out) + text[at:]
        assert now[r["doc_id"]]["text"] == want and now[r["doc_id"]]["n_chars"] == len(want)
    assert kinds


def test_mixture(spark, stages):
    before, after = stages[3:5]
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in before}
    copies = Counter(map(key, after))
    assert set(copies) <= set(map(key, before)) and max(copies.values()) <= 3
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    aims = mixing.mixture(spark.createDataFrame([tuple(r.values()) for r in before], schema)).collect()
    target = {}
    sources = {r["doc_id"]: r["source"] for r in before}
    for r in aims:
        target[sources[r["doc_id"]]] = r["target"]
    taken = Counter()
    for r in after:
        taken[r["source"]] += size[r["doc_id"]]
    longest = {s: max(size[r["doc_id"]] for r in before if r["source"] == s) for s in target}
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in target)
    assert sum(target.values()) == pytest.approx(sum(size.values()))


def best_fit_decreasing(lengths):
    """The number of sequences that plain best fit needs, longest first."""
    rest = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rest, n)
        bisect.insort(rest, (rest.pop(i) if i < len(rest) else 1024) - n)
    return len(rest)


def test_packing(spark, stages):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    before, after = stages[4:]
    own = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = Counter()
    for r in before:
        ids = [*own.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        at, end = 0, len(ids) % 1024 or 1024
        while at < len(ids):
            want[r["doc_id"], at, end - at, zlib.crc32(np.array(ids[at:end], "<u4").tobytes())] += 1
            at, end = end, end + 1024
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in after) == want
    bins = {}
    for r in after:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [at for at, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(bins) <= best_fit_decreasing([r["length"] for r in after])
    again = corpus_pipeline.run(spark, SF)
    assert sorted(tuple(r) for r in again.select("doc_id", "piece", "start", "length", "ids_crc32").collect()) == sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in after)
