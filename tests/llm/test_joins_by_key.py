"""Tables that grow with the corpus stay away from the driver: beyond a checked number of rows they are joined by key, whatever their files weigh."""

import pytest

from tessella.llm import filter_audit, shared


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("salts", [1, 64])
@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_keys_beyond_the_bound_are_not_broadcast(spark, monkeypatch, salts, how):
    rows = spark.range(200).selectExpr("id % 20 AS key", "id")
    keyed = shared.cut(spark.range(5, 15).selectExpr("id AS key", "id % 2 = 0 AS even"))
    want = sorted(map(str, rows.join(keyed, "key", how).collect()))
    assert "BroadcastHashJoin" in plan(shared.beside(rows, keyed, "key", how, salts))
    monkeypatch.setattr("tessella.llm.shared.BROADCAST_ROWS", 4)
    made = shared.beside(rows, keyed, "key", how, salts)
    assert sorted(map(str, made.collect())) == want and "BroadcastExchange" not in plan(made)


def test_audit_broadcasts_no_texts_and_no_labels(spark):
    """A text of many documents, in rows that repeat, and labels for all: the counts of an audit meet by key."""
    docs = spark.range(300).selectExpr("id DIV 3 AS doc_id", "concat('text ', CASE WHEN id < 240 THEN 0 ELSE id DIV 3 END) AS text", "concat('s', id % 2) AS source")
    labels = spark.range(100).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality", "1 AS toxic")
    made = filter_audit.masks(docs, labels)
    got = {tuple(r) for r in made.collect()}
    assert "Broadcast" not in plan(made)
    # few words all; of documents 0 to 79 only the first has no smaller one of its text, in three rows: 0 and 2 in s0, 1 in s1
    again = [(d, r % 2) for d in range(1, 80) for r in range(3 * d, 3 * d + 3)]
    own = [(d, r % 2) for d in [0, *range(80, 100)] for r in range(3 * d, 3 * d + 3)]
    assert got == {(f"s{s}", m, sum(x == s for _, x in h), sum(x == s and d % 2 for d, x in h), sum(x == s for _, x in h)) for m, h in ((1, own), (17, again)) for s in (0, 1)}
