"""Texts and tables at their extremes: megabytes of one repeated piece, ids at both ends of 64 bits, one id for all rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import pii, sharding, vector_search

#: (text, its base spans); pieces repeat what each pattern repeats, some of them for megabytes.
MB = 2**17
LONG = {
    "domain": ("a@b" + ".c" * 2**20, [("email", 0, 3 + 2**21)]),
    "local": ("a.b-" * (MB // 4), []),
    "local_at_end": ("a.b-" * (MB // 4) + "@c.de", [("email", 0, MB + 5)]),
    "hosts": ("a@b" + "-" * MB, []),
    "mails": ("a@b.c " * (MB // 6), [("email", 6 * i, 6 * i + 5) for i in range(MB // 6)]),
    "ats": ("a@" * (MB // 2), []),
    "octets": ("1." * (MB // 2), [("ip", 8 * i, 8 * i + 7) for i in range(MB // 8)]),
    "digits": ("1" * MB, []),
    "zeros": ("0" * MB + "1.2.3.4", [("ip", 0, MB + 7)]),
    "cards": ("1-" * (MB // 2), []),
    "phone": ("+1" + "(" * MB + "2", []),
    "phones": ("+1 " * (MB // 3), []),
    "secret": ("a1-" * 2**20, []),
    "slashes": ("ab/" * 2**20, []),
    "tokens": ("a1" * (MB // 2) + "=" * MB, []),
    "spelled": ("a [at] " * (MB // 7), []),
    "account": ("DE12 " + "AB12 " * (MB // 5), []),
    "name": ("Dr. A" + "a" * MB, []),
    "capitals": ("Mary A" * (MB // 6), []),
    "spaces": (" " * MB, []),
}


@pytest.mark.parametrize("some", [list(LONG)[i::4] for i in range(4)])
def test_patterns_take_megabytes_of_one_piece(spark, some):
    docs = spark.createDataFrame([(k, LONG[k][0]) for k in some], "name string, text string").repartition(2)
    got = {r["name"]: [(pii.BASE[s["kind"]], s["start"], s["end"]) for s in r["base"]] for r in pii.found(docs).select("name", "base").collect()}
    assert {k: v for k, v in got.items() if v != LONG[k][1]} == {}


def test_megabytes_are_python_s(spark):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for name in ("domain", "local_at_end", "mails"):
        assert [("email", *m.span()) for m in email.finditer(LONG[name][0])] == LONG[name][1]


def test_secrets_hold_what_they_must(spark):
    texts = {"ab12CD34ef56GH78ij90": True, "ab12CD34ef56GH78/ij90": True, "ab/12CD34ef56GH78/ij90": False, "word-word-word-word-word-1": False, "abcdefghijklmnopqrstuvwx": False, "123456789012345678901234": False}
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: r["n"] > 0 for r in rows.select("text", F.size(F.filter(pii.proposals(F.col("text"), pii.base_spans(F.col("text"))), lambda s: s["kind"] == 4)).alias("n")).collect()}
    assert got == texts


def test_shards_of_ids_at_both_ends(spark):
    ends = [-(2**63), 2**63 - 1, 0, None]
    rng = np.random.default_rng(5)
    ids = [*ends, *map(int, rng.integers(-(2**63), 2**63 - 1, 400))]
    docs = spark.createDataFrame([(d, f"text {i} " * 10, "en", "s") for i, d in enumerate(ids)], "doc_id long, text string, lang string, source string")
    got = sharding.sharded(docs).collect()
    held = [sum(r["size"] for r in got if r["shard"] == s) for s in range(16)]
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got if r["doc_id"] is not None) == sorted((False, d) for d in ids if d is not None) and len(got) == len(ids)
    assert max(held) - min(held) <= 2 * max(r["size"] for r in got)
    for end in ends[:2]:  # ids that reach one end only
        few = spark.createDataFrame([(end + (-i if end > 0 else i), f"text {i} " * 10, "en", "s") for i in range(100)], docs.schema)
        assert len({r["shard"] for r in sharding.sharded(few).collect()}) == 16


def test_a_large_group_of_empty_texts_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_TOGETHER", 50)
    docs = spark.createDataFrame([(i, "" if i < 300 else f"t{i} " * 400, "en", "s") for i in range(600)], "doc_id long, text string, lang string, source string")
    ties = sharding.units(docs, 16)[0].where("size = 1").groupBy("tie").count().collect()
    assert len(ties) == 300


def test_one_id_for_more_rows_than_the_sample(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "SAMPLE", 64)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 4))
    rows = spark.createDataFrame([(100, [float(v) for v in r], True) for r in x], "id long, v array<double>, asked boolean")
    got = vector_search.search(rows.repartition(3), F.col("asked")).groupBy("rank").count().collect()
    assert {r["rank"]: r["count"] for r in got} == {k: 500 for k in range(1, 11)}
