"""The training-data operators on small tables, against brute force: nulls, empty texts, ties, repeated rows, empty tables."""

import hashlib
import re
import zlib
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import langid, mixing, near_dedup, packing, pii, sharding, spotsigs, toxicity, vector_search

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, node int"
SF = "/root/testdata/sf0.001"
BASE = "the cat sat on a red mat and was then seen by the old dog who ran to the far green hill with all of his new young friends in the warm sun"


@pytest.fixture(scope="module")
def docs(spark):
    words = BASE.split()
    near = " ".join([*words[:-1], "rain"])
    texts = [BASE, near, BASE.upper(), None, "", "one", "one", "two words", " \t\n", "a.b@c.de 1.2.3.4 +1 (555) 123-4567, 4111 1111 1111 1111; 300.1.1.1", "x " * 3000, "no match here at all for this one text, quite other words than any before"]
    rows = [(i, t, "en", f"s{i % 3}" if i else None, len(t or ""), "d", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], (None, BASE, None, "s1", 1, "d", 1)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_dedup_is_brute_force(spark, docs, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.classes(docs).collect()}
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.collect() if r["doc_id"] is not None}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert {d: got[d] for d in sets} == {d: (len(s), find(d)) for d, s in sets.items()}
    assert got[None][1] == 0
    kept = near_dedup.near_dedup(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({find(d) for d in sets})
    assert near_dedup.classes(empty).count() == 0


def test_buckets_that_stars_leave(spark, monkeypatch):
    """Copies around the threshold, most not near their star's centre: in one task, and dealt into blocks of few rows."""
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(150):
        words = [f"w{i}" for i in range(120)]
        for at in rng.integers(0, 120, rng.integers(1, 6)):
            words[at] = f"x{rng.integers(3)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[100]), (200, texts[0].upper())], "doc_id long, text string")
    sets = {}
    for r in docs.collect():
        sets.setdefault(r["doc_id"], []).append(shingles(r["text"]))
    root = {d: d for d in sets}

    def find(d):
        return d if root[d] == d else find(root[d])

    for a, b in combinations(sorted(sets), 2):
        if any(100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    want = {d: find(d) for d in sets}
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.classes(docs).collect()} == want
    monkeypatch.setattr(near_dedup, "BLOCK", 20)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.classes(docs).collect()} == want
    everything = docs.select("doc_id", "text").groupBy("doc_id").agg(F.first("text").alias("text")).withColumn("h", F.xxhash64("text"))
    signed = everything.mapInPandas(near_dedup._signed, "doc_id long, h long, n long, s1 long, s2 long, keys array<long>, sig binary").withColumn("node", F.col("doc_id"))
    rest = signed.select("node", F.explode("keys").alias("key"), F.col("node").alias("label"))
    links = {(r["a"], r["b"]) for r in near_dedup._rest_links(rest, signed, everything).collect()}
    one = {r["doc_id"]: shingles(r["text"]) for r in everything.collect()}
    near = {frozenset((a, b)) for a, b in combinations(one, 2) if 100 * len(one[a] & one[b]) >= 75 * len(one[a] | one[b])}
    assert {frozenset(x) for x in links} <= near
    lone = spark.createDataFrame([], "node long, label long")
    assert {frozenset((r["a"], r["b"])) for r in near_dedup.prefix_links(everything.select("doc_id", "text"), lone).collect()} == near
    for pairs in (near, links):
        root.update({d: d for d in one})
        for a, b in map(sorted, pairs):
            a, b = sorted((find(a), find(b)))
            root[b] = a
        ends = {d: find(d) for d in one}
        want = ends if pairs is near else want
    assert ends == want


def test_signature_estimates_likeness():
    rng = np.random.default_rng(1)
    both, a, b = (np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * 2) for n in (300, 50, 50))
    x, y = (near_dedup.signature(np.unique(np.concatenate([both, s]))) for s in (a, b))
    assert abs((x == y).mean() - 300 / 400) < 0.1


def spot_signatures(text):
    words = re.findall(r"[^\W_]+", text.lower())
    common = [w in spotsigs.ANCHORS for w in words]

    def hashed(*parts):
        h = 42
        for part in parts:
            h = xxhash.xxh64(part.encode(), seed=h).intdigest()
        return h >> 32

    def ahead(i):
        return next((j for j in range(1, spotsigs.SKIP + 2) if i + j < len(words) and not common[i + j]), 0)

    out = set()
    for i, word in enumerate(words):
        if common[i] or not any(common[max(0, i - spotsigs.STRETCH + 1) : i + 1]):
            one = ahead(i)
            two = ahead(i + one) if one else 0
            if two:
                out.add(hashed(word, words[i + one], words[i + one + two]))
    return sorted(out or ({hashed(" ".join(words))} if words else set()))


def test_spotsigs_are_brute_force(spark):
    """Fingerprints and both likenesses of real documents and of texts without common words, in Python."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(1000, "alpha beta"), (1001, "alpha beta gamma delta epsilon"), (1002, "the of and a"), (1003, "the of and a is was in by for it alpha beta gamma"), (1004, "x1 " * 30)]
    got = {r["doc_id"]: r for r in spotsigs.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    rows.sort()

    def near(a, b):
        a, b = set(a), set(b)
        return len(a & b) / len(a | b) if a | b else 1.0

    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[doc]["fingerprint"] == "".join(f"{h:08x}" for h in spot_signatures(text))
        assert got[doc]["edited_fingerprint"] == "".join(f"{h:08x}" for h in spot_signatures(edited))
        assert got[doc]["near_edited"] == pytest.approx(near(spot_signatures(text), spot_signatures(edited)))
        assert got[doc]["near_next"] == pytest.approx(near(spot_signatures(text), spot_signatures(after)))


def test_spotsigs(spark, docs, empty):
    rows = spotsigs.fingerprints(docs.where("doc_id is not null")).collect()
    held = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect() if r["doc_id"] is not None), key=lambda r: r[0])
    want = []
    for i, (d, t) in enumerate(held):
        half, nxt = len(t) // 2, held[(i + 1) % len(held)][1]
        want.append((d, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == sorted(want)
    prints = {}
    for r in rows:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints[r["doc_id"]] = r["fingerprint"]
    assert prints[0] == prints[2] and prints[5] == prints[6] and prints[3] == prints[4] == ""
    assert spotsigs.fingerprints(empty).count() == 0
    one_bucket = {r["doc_id"]: r["edited_sha256"] for r in rows}
    many = spotsigs.with_next(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), rows_a_bucket=2).collect()
    ordered = sorted(held)[:12] and sorted({d: t for d, t in held}.items())
    after = {d: ordered[(i + 1) % len(ordered)][1] for i, (d, _) in enumerate(ordered)}
    assert {r["doc_id"]: r["next"]["text"] for r in many} == after and len(one_bucket) == 12


def test_spotsigs_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = [(r["class_id"], frozenset(r["sigs"])) for r in spotsigs.classes(docs).collect() if r["sigs"]]
    want = {(min(a, b), max(a, b)) for (a, x), (b, y) in combinations(sets, 2) if len(x & y) / len(x | y) >= 0.75}
    assert {(r["doc_a"], r["doc_b"]) for r in spotsigs.similar_pairs(docs).collect()} == want


def test_mixture(spark, docs, empty):
    con = duckdb.connect()
    con.execute(f"create view documents as from '{SF}/documents.parquet'")
    want = sorted(con.execute(mixing.ORACLE_SQL).fetchall())
    got = sorted(tuple(r) for r in mixing.mixture(spark.read.parquet(f"{SF}/documents.parquet")).collect())
    assert [(a, b, c, e) for a, b, c, _, e in got] == [(a, b, c, e) for a, b, c, _, e in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])
    rows = mixing.mixture(docs).collect()
    assert len(rows) == docs.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["taken"] // r["size"] for r in rows if r["size"])
    assert mixing.mixture(empty).count() == 0 == mixing.mix(empty).count()


def test_pareto_inclusion(spark):
    """Over many draws each document is taken as often as its probability says, and those differ within a source."""
    rng, draws = np.random.default_rng(4), 60
    sizes = [int(n) for n in rng.integers(1, 60, 240)]
    rows = [(1000 * d + i, " ".join(["w"] * n), f"{d:02}{'ab'[i % 2]}") for d in range(draws) for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    held, aimed, _ = mixing._planned(docs, (3, 1), 3, "mix")
    chance = {r["doc_id"]: (r["whole"], r["p"]) for r in mixing._chanced(held, aimed).select("doc_id", "whole", "p").collect()}
    assert len({p for _, p in chance.values()}) > 6 and all(0 <= w + p <= 3 for w, p in chance.values())
    for r in aimed.where("key like 's00%'").collect():
        assert sum(sum(chance[i]) * n for i, n in enumerate(sizes) if "ab"[i % 2] == r["key"][-1]) == pytest.approx(r["target"])
    taken = np.zeros(240)
    for r in mixing.mixture(docs, (3, 1), 3).collect():
        taken[r["doc_id"] % 1000] += r["taken"] // r["size"]
    for lo, hi in ((1, 3), (4, 7), (8, 15), (16, 31), (32, 63)):
        for source in (0, 1):
            own = [i for i, n in enumerate(sizes) if lo <= n <= hi and i % 2 == source]
            want = np.mean([sum(chance[i]) for i in own])
            assert abs(taken[own].mean() / draws - want) < 5 * 0.5 / np.sqrt(draws * len(own)) + 0.02


def test_run_ends_in_steps(spark, monkeypatch):
    """The end of the run is the same whether its range is searched in one step or in several."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(tuple, mixing.mixture(docs).collect()))
    monkeypatch.setattr(mixing.ends, "__defaults__", (1,))
    monkeypatch.setattr(mixing, "STEP_BITS", 8)
    assert sorted(map(tuple, mixing.mixture(docs).collect())) == want


def test_packing_round_trip(spark, docs, empty):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = packing.pack(docs).collect()
    for doc, text in texts.items():
        ids = [*own.encode(text, add_special_tokens=False).ids, 2]
        for r in rows:
            if r["doc_id"] == doc:
                assert zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a  b", "x \n y", "it's  <|endoftext|> ok", "tail ", "a\n b\n\n c", "ÄÖ ß 12,5%", "a  b"])
def test_encoder_is_the_tokenizer(text):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.encoder(*packing._paths())(text), "<u4").tolist() == want


@pytest.mark.parametrize(("how", "bound"), [({"most_docs": 2}, "docs"), ({"most_cost": 40_000}, "cost"), ({"most_docs": 2, "by": "dot"}, "docs"), ({}, None)])
def test_packing_under_binding_capacities(docs, how, bound):
    """Whole packings in which the number of documents or the attention cost of a sequence binds, not its tokens."""
    bins = {}
    for r in packing.pack(docs, 256, **how).collect():
        bins.setdefault(r["sequence_id"], []).append(r["length"])
    docs_, cost, used = (max(f(b) for b in bins.values()) for f in (len, lambda b: sum(n * n for n in b), sum))
    lone = max(n * n for b in bins.values() for n in b)
    assert used <= 256 and docs_ <= how.get("most_docs", 256) and cost <= max(lone, how.get("most_cost", 256 * 256))
    if bound == "docs":
        assert docs_ == how["most_docs"] and len(bins) > -(-sum(map(sum, bins.values())) // 256)


def test_plan_respects_every_capacity():
    counts = {700: 5, 300: 9, 100: 40, 3: 200}
    bins = {}
    for length, _, n, base, each, _ in packing.plan(counts, 1024, most_docs=12, most_cost=700_000):
        for k in range(n):
            bins.setdefault(base + k // each, []).append(length)
    assert sorted(x for b in bins.values() for x in b) == sorted(k for k, n in counts.items() for _ in range(n))
    assert all(sum(b) <= 1024 and len(b) <= 12 and sum(x * x for x in b) <= 700_000 for b in bins.values())


def test_pii(spark, docs, empty):
    row = pii.found(docs.where("doc_id = 9")).select(pii.listed(F.col("base")).alias("s")).first()["s"]
    assert row == "email:0:8,ip:9:16,card:36:55,phone:17:34"
    clean = pii.redact(docs.where("doc_id in (3, 9)")).orderBy("doc_id").collect()
    assert clean[0]["text"] is None and clean[1]["text"] == "<EMAIL> <IP> <PHONE>, <CARD>; 300.1.1.1"
    assert clean[1]["n_chars"] == len(clean[1]["text"]) and clean[1]["digest"] == "d"
    assert pii.redact(empty).count() == 0
    named = spark.createDataFrame([(i, f"Dear Mr John Smith, word {i}") for i in range(20)], "doc_id int, text string")
    assert all("name:5:18" in r["s"] for r in pii.found(named).select(pii.listed(F.col("spans")).alias("s")).collect())


def test_sharding(spark, docs, empty):
    rows = sharding.sharded(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r["shard"], []).append(r)
    assert len(rows) == 200 and set(sizes) == set(range(16))
    assert all(sorted(r["slot"] for r in s) == list(range(len(s))) for s in sizes.values())
    same = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"))
    n = [r["count"] for r in sharding.sharded(same).groupBy("shard").count().collect()]
    assert len(n) == 16 and max(n) - min(n) <= 8
    assert sharding.sharded(docs).count() == docs.count() and sharding.sharded(empty).count() == 0


def halves(rows, whole):
    """The k-d split of units (size, source, lang, doc, tie) by brute force: (left, right)."""
    dims = ("source", "lang", "size", "doc")
    spread = lambda rs, d: max(r[d] for r in rs) - min(r[d] for r in rs)
    by = max(dims, key=lambda d: spread(rows, d) / max(1, spread(whole, d)))
    ordered = sorted(rows, key=lambda r: (r[by], r["tie"]))
    goal, so_far = sum(r["size"] for r in rows) / 2, 0
    groups = []
    for r in ordered:
        if groups and (groups[-1][0][by], groups[-1][0]["tie"]) == (r[by], r["tie"]):
            groups[-1].append(r)
        else:
            groups.append([r])
    for i, g in enumerate(groups):
        n = sum(r["size"] for r in g)
        if so_far + n >= goal:
            cut = i if goal - so_far < so_far + n - goal else i + 1
            return [r for g in groups[:cut] for r in g], [r for g in groups[cut:] for r in g]
        so_far += n
    return rows, []


@pytest.mark.parametrize(("edge", "bins"), [(20_000, 2**16), (5, 2**10)])
def test_kd_splits_are_brute_force(spark, monkeypatch, edge, bins):
    monkeypatch.setattr(sharding, "EDGE_ROWS", edge)
    monkeypatch.setattr(sharding, "BINS", bins)
    monkeypatch.setattr(sharding, "TOGETHER", 1 / 25)
    copies = [(5000 + i, "a text of which there are some copies", "en", f"s{i % 4}") for i in range(4)] + [(6000 + i, "many copies " * 40, "en", f"s{i % 4}") for i in range(300)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame([*copies, (7000, None, None, None), (7001, None, "de", "s9")], "doc_id long, text string, lang string, source string"))
    rows = [r.asDict() for r in sharding.units(docs, 16)[0].collect()]
    found = [rows]
    for _ in range(4):
        found = [half for part in found for half in (halves(part, rows) if part else ([], []))]
    want = {r["doc_id"]: i for i, part in enumerate(found) for r in part}
    got = {r["doc_id"]: r["shard"] for r in sharding.sharded(docs).collect()}
    assert got == want
    assert len({got[5000 + i] for i in range(4)}) == 1 and got[7000] == got[7001]  # equal texts that fit stay together
    assert len({got[6000 + i] for i in range(300)}) > 1  # a group larger than its share of a shard does not


def test_shards_by_bytes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    total = docs.select(F.sum(F.octet_length("text") + 1)).first()[0]
    leaves = sharding.tree(docs, target_bytes=total // 100).groupBy("node").count().count()
    assert leaves > 64


def test_language_sample_is_bounded(spark, monkeypatch):
    """A frequent language, many rare ones, rows that repeat: so many fitting rows a language, each once, the same ones every time."""
    rows = [(i, f"word number{i} here", "en") for i in range(500)] + [(0, "word number0 here", "en")] * 300 + [(1000 + i, "ein wort", f"l{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = [sorted(tuple(r) for r in langid._chosen(docs.repartition(n), 40).select("lang", "text").collect()) for n in (3, 7)]
    assert kept[0] == kept[1] and len(kept[0]) == 60 and sum(lang == "en" for lang, _ in kept[0]) == 40 == len({t for lang, t in kept[0] if lang == "en"})
    monkeypatch.setattr(langid, "TOTAL", 63)
    assert langid._chosen(docs, 40).count() == 23


def test_language_counts_long_texts_whole():
    n = langid._counts("ab " * 9000)[0]
    assert np.isclose(n.max(), np.log1p(9000), atol=0.2)


def test_language(spark, docs, empty):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.classify(d, langid.fit(langid.learning(d))).join(d, "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) / len(got) > 0.9
    und = {r["doc_id"]: r["lang_pred"] for r in langid.classify(docs, langid.fit(langid.learning(d))).collect()}
    assert und[3] == und[4] == und[8] == "und" and und[0] == "en"
    assert langid.keep_languages(empty).count() == 0


def test_segments_are_maximal():
    rng = np.random.default_rng(2)
    for _ in range(50):
        s = rng.normal(-0.2, 1, 30)
        found = toxicity.segments(s)
        best = max((s[i:j].sum() for i in range(30) for j in range(i + 1, 31)), default=0)
        assert max(f[0] for f in found) == pytest.approx(best) if best > 0 else not found
        assert all(a[2] <= b[1] for a, b in zip(sorted(found, key=lambda f: f[1]), sorted(found, key=lambda f: f[1])[1:], strict=False))


def test_vector_search(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16))
    x[10] = x[20] = x[5]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, [1.0])]
    v = vector_search.valid(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = vector_search.search(v, F.expr("id % 100 = 0 or id in (5, 603)")).collect()
    for q in (0, 5, 100, 200, 300, 400, 500):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(600), d))[:10].tolist()
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in mine] == want and [r["rank"] for r in mine] == list(range(1, 11))
        assert [r["score"] for r in mine] == pytest.approx(d[want], rel=1e-12)
    assert not any(603 in (r["query_id"], r["vec_id"]) for r in got)  # alone among vectors of its length
    assert vector_search.search(v.where("id < 0"), F.lit(True)).count() == 0
