"""The late-arrival layout against a plain restatement: files, their rows and bytes, which days are made anew."""

import hashlib
import math
import zlib
from datetime import datetime, timedelta

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessella.llm import late_overwrite as late

SF = "/root/testdata/sf0.001"
SCHEMA = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"
ZERO, LIMIT = datetime(1970, 1, 1), datetime(2024, 3, 1)
us = lambda t: "" if t is None else (t - ZERO) // timedelta(microseconds=1)
day_of = lambda r: -1 if r[4] is None else (r[4] - ZERO).days
order = lambda values: tuple((v is not None, v if v is not None else 0) for v in values)


def copied(rows):
    out = list(rows)
    for r in rows:
        h = zlib.crc32(("" if r[0] is None else str(r[0])).encode())
        if h % 3 == 0 and day_of(r) % 10 == 0:
            out.append((*r[:3], None if r[3] is None else r[3] + 1, None if r[4] is None else r[4] + timedelta(days=h % 2), None if r[5] is None else r[5] + timedelta(days=1 + h % 97), r[6]))
    return out


def layout(rows):
    best = {}
    for r in rows:
        rank = (order([r[5]]), order([r[4]]), order([r[1], r[2], r[3], r[6]]))
        if r[0] not in best or rank > best[r[0]][0]:
            best[r[0]] = (rank, r)
    days = {}
    for _, r in best.values():
        days.setdefault(day_of(r), []).append(r)
    return {d: sorted(v, key=lambda r: order([r[4], r[0]])) for d, v in days.items()}


def expected(rows):
    every, size = copied(rows), 1 + len(rows) // 900
    early = lambda r: r[5] is not None and r[5] < LIMIT
    start, final = layout([r for r in every if early(r)]), layout(every)
    was = {r[0]: d for d, held in start.items() for r in held}
    moved = [(d, r) for d, held in final.items() for r in held if not early(r)]
    touched = {d for d, _ in moved} | {was[r[0]] for _, r in moved if r[0] in was}
    out = []
    for d, held in final.items():
        for n, lo in enumerate(range(0, len(held), size)):
            part = held[lo : lo + size]
            cents = sum(0 if r[3] is None else math.floor(100 * r[3] + 0.5) for r in part)
            crc = sum(zlib.crc32(f"{'' if r[0] is None else r[0]}:{us(r[4])}:{us(r[5])}".encode()) for r in part)
            ids = hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for r in part).encode()).hexdigest()
            out.append((d, n, len(part), cents, crc, "sale_id,client_id,status,total,sold_at,arrived_at,priority", ids, d in touched))
    return sorted(out), {(d, n): held[n * size : (n + 1) * size] for d, held in final.items() for n in range(-(-len(held) // size))}


def made(spark, monkeypatch, sales):
    """The query's rows on sales, with the bytes of the files as they stood at the start."""
    bytes_ = {}

    def kept(spark_, root, real=late.listing):
        found = real(spark_, root)
        bytes_.setdefault("root", root)
        bytes_.setdefault("start", {f: open(f.removeprefix("file:"), "rb").read() for f in found})
        return found

    monkeypatch.setattr(late, "listing", kept)
    monkeypatch.setattr(late, "table", lambda *_: sales)
    return late.op11_late_overwrite(spark, "").collect(), bytes_


def same(spark, monkeypatch, sales, rows):
    got, before = made(spark, monkeypatch, sales)
    want, held = expected(rows)
    names = ["day", "file_no", "n_rows", "cents", "rows_crc", "columns", "ids_sha256", "rewritten"]
    assert sorted(tuple(r[n] for n in names) for r in got) == want
    now = {f.removeprefix("file:") for f in late.listing(spark, before["root"])}
    local = {r["path"].removeprefix("file://").removeprefix("file:"): r for r in got}
    assert set(local) == now
    start = {f.removeprefix("file:"): b for f, b in before["start"].items()}
    for path, r in local.items():
        read = pq.ParquetFile(path).read()
        assert [tuple(x.values()) for x in read.to_pylist()] == held[r["day"], r["file_no"]]
        assert (path in start and open(path, "rb").read() == start[path]) is not r["rewritten"]


def test_layout_of_the_table(spark, monkeypatch):
    rows = duckdb.sql(f"SELECT sale_id, client_id, status, total, sold_at, arrived_at, priority FROM '{SF}/sales.parquet'").fetchall()
    same(spark, monkeypatch, spark.read.parquet(f"{SF}/sales.parquet"), rows)


@pytest.mark.parametrize("held", [late.HELD, 2])
def test_odd_rows(spark, monkeypatch, held):
    monkeypatch.setattr(late, "HELD", held)
    t = lambda d, h=0: ZERO + timedelta(days=19783 + d, hours=h, microseconds=h)  # noqa: E731 (day 0 is 2024-03-01)
    rows = [(i, i % 3, "done", 10.125 * i, t(-60 + i, i % 24), t(-60 + i, 25), i % 2) for i in range(100)]
    rows += [(7, 1, None, None, t(-53, 2), t(-40 + k), k) for k in range(300)]  # one sale holds most rows
    rows += [(8, 0, "x", 1.0, t(5), None, 1), (8, 0, "x", 1.0, None, t(9), 1), (200, None, None, None, None, None, None), (201, None, None, 5.0, None, t(-5), None), (None, 1, "a", 2.5, t(-3), t(-2), 1), (None, 1, "b", 2.5, t(-3), t(8), 1)]
    rows += [(300, 1, s, v, t(-9), t(-8), None) for s, v in (("a", 1.0), ("b", None), (None, 9.0), ("b", 2.0))]  # arrived at once
    rows += [(301, 1, "only", 1.0, t(-200), t(-200), 1), (301, 1, "only", 1.0, t(-201), t(3), 1), rows[0], rows[0]]  # a day without rows at the end
    same(spark, monkeypatch, spark.createDataFrame(rows, SCHEMA).repartition(7), rows)


def test_empty_table(spark, monkeypatch):
    got, _ = made(spark, monkeypatch, spark.createDataFrame([], SCHEMA))
    assert got == []


def test_clashing_columns_and_instants(spark, tmp_path):
    """Columns named like the operator's own, times with a zone, a key of another name."""
    t = lambda d: datetime(2024, 2, 20) + timedelta(days=d)
    rows = spark.createDataFrame([(i, "k", t(i % 20), t(i), i, [i]) for i in range(40)], "key long, role string, at timestamp, arrived_us timestamp, c0 int, row array<int>").withColumn("day", F.lit("x"))
    root = f"file://{tmp_path}/layout"
    late.overwrite_late(rows, "key", "arrived_us", "at", root, 3)
    back = spark.read.parquet(root)
    assert set(rows.columns) < set(back.columns) and sorted(map(str, back.select(*rows.columns).collect())) == sorted(map(str, rows.collect()))
