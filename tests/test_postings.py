"""Blocks of postings: what they hold, and that texts are gone over once."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.operators import postings


@pytest.mark.parametrize("segment", [1, 7, 50, 10**6])
def test_blocks_hold_every_posting_once(monkeypatch, segment):
    monkeypatch.setattr(postings, "BLOCK", 3)
    monkeypatch.setattr(postings, "SEGMENT", segment)
    monkeypatch.setattr(postings, "SENT", 5)
    rng = random.Random(1)
    rows = [(None if i % 9 == 0 else str(i), rng.choice(["a", "b", None]), rng.choices("xyzw", k=rng.randrange(0, 9)) if i % 5 else rng.choice([None, []])) for i in range(60)]
    ids, names, tokens = zip(*rows, strict=True)
    table = pa.table({"id": pa.array(ids), "file_name": pa.array(names), "tokens": pa.array(tokens, pa.list_(pa.string()))})
    made = [b for batch in postings.blocks_of(iter(table.to_batches(max_chunksize=7))) for b in batch.to_pylist()]
    got = Counter((b["term"], *p) for b in made for p in zip(b["ids"], b["file_names"] or [b["file_name"]] * b["n"], b["counts"], b["lengths"], strict=True))
    assert got == Counter((t, i, f, n, len(words)) for i, f, words in rows if words for t, n in [*Counter(words).items(), (postings.ALL, 1)])
    for b in made:
        assert b["n"] == len(b["ids"]) <= 3 and b["most"] == b["counts"][0] == max(b["counts"]) and b["least"] == min(b["lengths"])
        assert b["file_names"] is None or b["file_name"] is None and len(set(b["file_names"])) > 1  # one file's name is not repeated


def test_rows_without_words_make_no_blocks():
    none = pa.table({"id": ["a"], "file_name": ["b"], "tokens": pa.array([[]], pa.list_(pa.string()))})
    assert not [b for t in (none, none.slice(1)) for batch in postings.blocks_of(iter(t.to_batches())) for b in batch.to_pylist()]


def test_texts_are_gone_over_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        seen.add(1)
        return f"the w{i % 7}" if i % 10 else None

    rows = spark.range(200).select(F.col("id"), F.lit("f").alias("file_name"), text.asNondeterministic()("id").alias("content"))
    index = postings.Postings(spark, f"file://{tmp_path}/w")
    index.add(rows)
    assert seen.value == 200 and index.search("the", None).count() == 180
    assert not list((tmp_path / "w" / "drafts").glob("*"))


def test_rows_of_one_file_and_of_none_keep_their_names(spark, tmp_path):
    rows = spark.createDataFrame([("a", "f", "x y"), ("b", None, "x x"), ("c", None, "z"), ("d", "g", "y")], "id string, file_name string, content string").coalesce(1)
    index = postings.Postings(spark, f"file://{tmp_path}/w")
    index.add(rows)
    assert sorted((r["id"], r["file_name"]) for r in index.search("x y z", None).collect()) == [("a", "f"), ("b", None), ("c", None), ("d", "g")]
    index.forget(None)
    assert sorted((r["id"], r["file_name"]) for r in index.search("x y z", None).collect()) == [("a", "f"), ("d", "g")]
