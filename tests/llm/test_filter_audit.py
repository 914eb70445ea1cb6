"""The audit of filter orders against a walk over documents, one order after the other."""

from itertools import permutations

import duckdb
import pytest

from tessella.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, mask int, part string, digest string, words string"
LONG = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    (1, LONG, "a"), (2, LONG, "a"), (3, "few words", "b"), (4, "x " * 80, "a"), (5, LONG.upper(), "b"), (6, LONG + " #", None), (7, None, ""), (8, "", "a"), (9, " \t\r\n", "a"),
    (10, "few words", "c"), (10, "few words", "c"), (3, "few words", "b"), (None, LONG, "a"), (None, None, None), (0, "A# " * 60, "d"), (11, LONG + " É\x85\x1c", "d"), (12, " ".join(["é|"] * 20), "d"), (13, LONG.title(), "d"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (4, 1, None), (None, 1, 1), (99, 1, 1), (10, 1, 1)]


def fails(doc_id, text, rows):
    text = text or ""
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if w]
    out = {"A"} if len(words) < 50 else set()
    out |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
    out |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text) else set()
    out |= {"D"} if set(text) & set("#$%&*|") else set()
    return out | ({"E"} if doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in rows) else set())


def walked(rows, labels):
    good, bad = ({d for d, *v in labels if v[i] == 1 and d is not None} for i in (0, 1))
    out = {}
    for part in {s or "" for *_, s in rows}:
        held = [(d, fails(d, t, rows)) for d, t, s in rows if (s or "") == part]
        removals = dict.fromkeys("ABCDE", 0)
        for p in permutations("ABCDE"):
            left = held
            for i, f in enumerate(p):
                gone, kept = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                failing = sum(f in x[1] for x in held)
                out[part, "".join(p), i + 1] = [len(kept), len(gone), failing - len(gone), sum(x[1] == {f} for x in held), sum(d in good for d, _ in gone), sum(d in bad for d, _ in gone), f]
                removals[f] += len(gone)
                left = kept
        for key, row in out.items():
            if key[0] == part:
                row[-1] = removals[row[-1]]
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("most", [10**6, 0])
def test_audit_is_a_walk_over_documents(spark, monkeypatch, most):
    monkeypatch.setattr("tessella.llm.shared.BROADCAST_ROWS", most)
    docs = spark.createDataFrame([(d, t, s, 31, "x", "y", "z") for d, t, s in TEXTS], SCHEMA)
    got = filter_audit.audit(docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r[:3]): tuple(r[3:]) for r in got.collect()} == walked(TEXTS, LABELS) and got.count() == 5 * 600


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, labels).count() == 0
    one = filter_audit.audit(none.union(spark.createDataFrame([(1, "x", "s", 0, "", "", "")], SCHEMA)), labels).where("step = 1").groupBy().sum("removed", "good_lost").first()
    assert tuple(one) == (24, 0)  # only A fails, first in 24 orders


def test_audit_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    got = filter_audit.op13_filter_audit(spark, sf)
    want = con.sql(filter_audit.ORACLE_SQL)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert {f.name: f.dataType.simpleString() for f in got.schema} == {"part": "string", "filter_order": "string", "step": "int"} | dict.fromkeys(got.columns[3:], "bigint")
