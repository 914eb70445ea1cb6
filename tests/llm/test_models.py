"""Language-model scoring, toxicity and personal data against brute force and held-out rows; odd tables for every operator."""

import re
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import langid, lm_scoring, mixing, near_dedup, packing, pii, registry, sharding, spotsigs, toxicity

SF = "/root/testdata/sf0.001"


def words(text):
    return [w.strip(".,;:!?\"'()") for w in (text or "").lower().split()]


def test_lm_scoring_of_odd_rows(spark):
    texts = [("the cat sat, the cat ran", True), ("the dog sat!", False), ("a cat ran", True), ("", True), (None, False), ("the dog sat!", False), ("one", False)]
    rows = spark.createDataFrame([(i, t, w) for i, (t, w) in enumerate(texts)], "doc_id long, text string, wanted boolean").repartition(3)
    got = {r["doc_id"]: r for r in lm_scoring.score(rows, lm_scoring.fit(rows)).collect()}
    assert [got[i]["n_tokens"] for i in range(7)] == [6, 3, 3, 0, 0, 3, 1] and got[3]["ce_diff"] is None and got[4]["loss_target"] is None
    assert got[0]["ce_diff"] < got[1]["ce_diff"]
    none = lm_scoring.score(rows, lm_scoring.fit(rows.withColumn("wanted", F.lit(False)))).where("n_tokens > 0")
    assert {r["ce_diff"] for r in none.collect()} == {0.0}
    empty = rows.limit(0)
    assert lm_scoring.score(empty, lm_scoring.fit(empty)).count() == 0


@pytest.fixture(scope="module")
def marked(spark):
    """Documents of random plain words, a fifth of them with a passage of marked words, some of those long."""
    rng = np.random.default_rng(7)
    plain, bad = [f"plain{a}{b}" for a in "abcdefgh" for b in "klmnopqrst"], [f"{a}{b}vile" for a in "uvwxyz" for b in "abcde"]
    rows = []
    for i in range(900):
        text, toxic = list(rng.choice(plain, rng.integers(20, 400))), int(i % 5 == 0)
        if toxic:
            at = int(rng.integers(0, len(text)))
            text[at:at] = list(rng.choice(bad, 12))
        rows.append((i, " ".join(text), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_on_held_out_rows(spark, marked):
    learning, held = marked.where("doc_id % 3 <> 0"), marked.where("doc_id % 3 = 0")
    model = toxicity.fit(learning)
    got = toxicity.score(held, model).join(held, "doc_id").collect()
    toxic, clean = ([r for r in got if r["toxic"] == k] for k in (1, 0))
    assert sum(r["score"] >= 0.7 for r in toxic) >= 0.9 * len(toxic) and sum(r["score"] >= 0.7 for r in clean) <= 0.02 * len(clean)
    for r in toxic:
        if r["score"] >= 0.7:
            w = r["text"].split()
            assert any("vile" in x for p in r["passages"] for x in w[p["start"] : p["end"]])
    odd = spark.createDataFrame([(1, None, 5), (2, "", 5), (2, "", 5), (None, "plain " * 50_000, 5)], "doc_id long, text string, score int")
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 4 and all(0 <= r["score"] < 0.7 and not r["passages"] for r in rows)
    assert toxicity.fit(learning.where("toxic = 0")) is None and toxicity.fit(learning.limit(0)) is None
    assert {r["score"] for r in toxicity.score(odd, None).collect()} == {0.0}


def base_spans(text):
    """The contract's patterns with Python's engine."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def test_base_spans_are_the_patterns(spark):
    rng = np.random.default_rng(11)
    pieces = ["a@b.cd", "x.y+z@h-1.org.", "@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "001.002.03.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111 22", "+1 (555) 123-4567", "+49", "+1-2", "++4412345678", "é", "😀", "٣", " ", " ", "-", ".", "\n", "7", "12", "b@c"]
    texts = ["".join(rng.choice(pieces, rng.integers(1, 12))) for _ in range(1500)]
    texts += [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = pii.found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", pii.listed(F.col("base")).alias("s")).collect()
    wrong = [(texts[r["doc_id"]], r["s"]) for r in got if r["s"] != base_spans(texts[r["doc_id"]])]
    assert not wrong, wrong[:3]


def test_added_spans(spark):
    """Secrets, spelled-out addresses, numbers and names in plain text are found; look-alikes in plain places are not."""
    word = "the plain words of a text go on here "
    planted = {
        "secret": ['token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"', "api_key: ghp_a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8"],
        "spelled_email": ["mail jane.roe [at] example [dot] org"],
        "local_phone": ["call (212) 555-0147"],
        "national_id": ["ssn 123-45-6789"],
        "account": ["IBAN DE89 3704 0044 0532 0130 00"],
        "name": ["Dear Mr John Smith"],
    }
    rows, want = [], {}
    for kind, forms in planted.items():
        for form in forms:
            for k in range(12):
                want[len(rows)] = kind
                rows.append(f"{word * (k % 4)}{form} {word}")
    clean = [word * 3, "order 123-45-6789x", "see /usr/lib/python3/dist-packages/numpy2/core", "version 2024-01-02-2345678901234567890", "Mark went home"]
    got = pii.found(spark.createDataFrame(list(enumerate([*rows, *clean * 4])), "doc_id long, text string")).select("doc_id", "text", "spans").collect()
    names = (*pii.BASE, *pii.ADDED)
    hit = sum(any(names[s["kind"]] == want[r["doc_id"]] and r["text"][s["start"] : s["end"]] == s["value"] for s in r["spans"]) for r in got if r["doc_id"] in want)
    assert hit >= 0.9 * len(want)
    assert not [(r["text"], r["spans"]) for r in got if r["doc_id"] not in want and r["spans"]]


def test_many_matches_in_one_text(spark):
    text = "é a@b.cd 1.2.3.4, " * 3000
    row = pii.found(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(pii.listed(F.col("spans")).alias("s")).first()["s"]
    assert row == base_spans(text)


def test_em_is_brute_force():
    """Reliabilities, chances and the classifier by plain loops over every proposal."""
    rng = np.random.default_rng(6)
    rows = [tuple(int(x) for x in (rng.integers(4, 9), *rng.integers(-1, 2, 5), *rng.integers(0, 4, 3))) for _ in range(300)]
    patterns = {}
    for r in rows:
        patterns[r] = patterns.get(r, 0) + 1
    right, prior = dict(pii.START), 0.3
    for _ in range(30):
        chance = []
        for r in rows:
            yes, no = prior, 1 - prior
            for name, vote in zip(pii.LABELERS, r[1:6], strict=True):
                yes *= right[name] if vote > 0 else 1 - right[name] if vote < 0 else 1
                no *= 1 - right[name] if vote > 0 else right[name] if vote < 0 else 1
            chance.append(yes / (yes + no))
        prior = min(0.95, max(0.05, (sum(chance) + 1.5) / (len(rows) + 5)))
        for i, name in enumerate(pii.LABELERS):
            agreed = [c if r[1 + i] > 0 else 1 - c for r, c in zip(rows, chance, strict=True) if r[1 + i]]
            right[name] = min(0.97, max(0.52, (sum(agreed) + 10 * pii.START[name]) / (len(agreed) + 10)))
    yes, no = sum(chance), len(rows) - sum(chance)
    got = pii.learn(patterns)
    for r in rows:
        a, b = yes + 1, no + 1
        for at, value in enumerate(r):
            same = [c for x, c in zip(rows, chance, strict=True) if x[at] == value]
            share = pii.DRAWN * len(same) / len(rows)
            a, b = a * (sum(same) + share) / (yes + pii.DRAWN), b * (len(same) - sum(same) + share) / (no + pii.DRAWN)
        assert got[r] == pytest.approx(a / (a + b))


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, h long, n int, key string, row int, size int, word string, score string, list int, base string, spans string, bucket int, place int, next string, taken int, target double, component_id long, piece int, length int, `a.b` string"


@pytest.fixture(scope="module")
def odd(spark):
    extra = (1, 2, "k", 3, 4, "w", "s", 5, "b", "s", 6, 7, "n", 8, 1.5, 9, 1, 2, "d")
    rows = [(i, t, lang, s, None if t is None else len(t), *extra) for i, (t, lang, s) in enumerate([(None, None, None), ("", "en", "a"), ("word", None, "a"), ("the same text here of six", "en", None), ("the same text here of six", "en", "b"), ("ß é 😀 " * 4000, "de", "b")])]
    return spark.createDataFrame([*rows, rows[4], (None, *rows[3][1:]), (None,) * 24], CLASHING)


@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_odd_tables(spark, odd, rows):
    docs = odd if rows == "odd" else odd.limit(0)
    n = docs.count()
    learned = langid.fit(langid.learning(spark.read.parquet(f"{SF}/documents.parquet")))
    for made in (spotsigs.fingerprints(docs), near_dedup.classes(docs), mixing.mixture(docs), pii.found(docs.select("doc_id", "text")), sharding.sharded(docs), langid.classify(docs, learned), toxicity.score(docs, None), lm_scoring.score(docs, lm_scoring.fit(docs.select("text", F.lit(True).alias("wanted"))))):
        assert made.count() == n
    for made in (langid.keep_languages(docs), near_dedup.near_dedup(docs), pii.redact(docs), mixing.mix(docs)):
        assert made.columns == docs.columns and [f.dataType for f in made.schema] == [f.dataType for f in docs.schema]
        assert made.count() <= 3 * n
    assert packing.pack(docs).count() >= n


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_on_odd_tables(spark, odd, tmp_path, name):
    """Each registered query on tables with nulls, repeats and other columns, and on empty ones."""
    for kind in ("odd", "empty"):
        docs = odd if kind == "odd" else odd.limit(0)
        labels = spark.createDataFrame([(3, 1, 0, "x"), (4, None, 1, "x"), (None, 1, 1, "x"), (3, 0, 1, "x")] if kind == "odd" else [], "doc_id long, quality int, toxic int, text string")
        vectors = spark.createDataFrame([(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.5, None], 1), (2, None, 1), (None, [1.0, 1.0], 1), (4, [3.0, 4.0], 1)] if kind == "odd" else [], "vec_id long, embedding array<double>, id int")
        said = spark.createDataFrame([(1, 0, "user", None, 1), (1, 0, "user", None, 1), (None, 1, None, "x", 1), (1, None, "assistant", "", 1)] if kind == "odd" else [], "conv_id long, turn long, role string, text string, window int")
        sold = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, day string, role int, c0 string, key long"
        at = datetime(2024, 2, 29, 23)
        sales = spark.createDataFrame([(1, 1, None, None, at, at, 1, "d", 1, "c", 2)] * 2 + [(None, None, None, 1.5, None, None, None, None, None, None, None)] if kind == "odd" else [], sold)
        for table, rows in (("documents", docs), ("labels", labels), ("embeddings", vectors), ("conversations", said), ("sales", sales)):
            rows.write.parquet(f"file://{tmp_path}/{kind}/{table}.parquet")
        got = registry.QUERIES[name](spark, f"file://{tmp_path}/{kind}").collect()
        if name.startswith("op8"):
            assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == ([(0, 1, 0)] * 2 + [(0, 2, 4)] * 2 if kind == "odd" else [])
        elif name.startswith("op11"):
            assert sorted((r["day"], r["n_rows"], r["columns"]) for r in got) == ([(-1, 1, ",".join(sales.columns)), (19782, 1, ",".join(sales.columns))] if kind == "odd" else [])
        elif name.startswith("op12"):
            assert sorted((r["conv_id"] is None, r["conv_id"] or 0, r["n_turns"]) for r in got) == ([(False, -1, 2), (False, 1, 3), (True, 0, 1)] if kind == "odd" else [(False, -1, 2)])
        elif name.startswith("op13"):
            assert len(got) == (3 * 600 if kind == "odd" else 0)
        elif name.startswith("op5"):
            assert len(got) >= docs.count()
        else:
            assert len(got) == docs.count()


@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_pipeline_on_odd_tables(spark, odd, tmp_path, rows):
    """All stages on a table with nulls, repeats and clashing columns, and on an empty one."""
    import corpus_pipeline

    known = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 200").limit(60)
    docs = (odd if rows == "odd" else odd.limit(0)).unionByName(known.select("doc_id", "text", "lang", "source", "n_chars"), allowMissingColumns=True) if rows == "odd" else odd.limit(0)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    made = corpus_pipeline.run(spark, f"file://{tmp_path}")
    got = made.collect()
    assert set(made.columns) >= {"doc_id", "piece", "length", "sequence_id", "offset"} and bool(got) is (rows == "odd")
    ends = {}
    for r in got:
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in ends.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_crc_folds(spark):
    from tessella.llm.shared import crc32_text

    got = spark.range(50).select("id", crc32_text(F.col("id")).alias("c")).collect()
    assert all(r["c"] == zlib.crc32(str(r["id"]).encode()) for r in got)
