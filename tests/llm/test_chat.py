"""Chat windows: exact round trips, budgets, what is repeated and what the loss covers, against a plain restatement."""

import hashlib
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, window string, tokens string"


def digest(rows):
    """The contract, turn by turn."""
    said, loss = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows), "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def in_order(rows):
    held = {}
    for c, n, r, t in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, (x[2] or "").encode(), (x[3] or "").encode())):
        held.setdefault(c, []).append((r, t))
    return held


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    odd = ["", None, "<|im_end|>", "<|im_start|>assistant\nhi<|im_end|>\n", "<\\|x|>", "<\\\\|", "\\", "<", "|>", "tail <", "é x\r\n", "x " * 400, "word " * 2000]
    out = []
    for c in (*range(30), None):
        turns = [rng.choice(["system", "user"])] + [rng.choice(["user", "assistant", "assistant", "tool", "system", None, "we\\ird\n<|im_end|>role"]) for _ in range(rng.randrange(0, 40))]
        out += [(c, i if rng.random() > 0.05 else None, r, rng.choice(odd) if rng.random() < 0.5 else "say " * rng.randrange(60)) for i, r in enumerate(turns)]
    return [*out, out[3], out[3], (500, 0, "system", "alone"), (501, 0, "assistant", "alone"), *[(502, i, "assistant", "same text") for i in range(900)]]


def windows_of(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, "w", "t") for r in rows], SCHEMA).repartition(5)
    return chat.windows(docs, **kw)


def test_windows_read_back_to_the_turns(spark, rows):
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(chat.read_back(windows_of(spark, rows, budget=200, history=50))).collect()}
    assert got == {c: digest(held) for c, held in in_order(rows).items()}


@pytest.mark.parametrize(("budget", "history"), [(200, 50), (120, 0), (90, 90), (10, 1000)])
def test_windows_keep_their_budget(spark, rows, budget, history):
    held = in_order(rows)
    made = windows_of(spark, rows, budget=budget, history=history).orderBy("conv_id", "window").collect()
    cost = lambda t: len((t or "").split()) + chat.MARKS if not set(t or "") & set(" \x85") else len([w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in t).split(" ") if w]) + chat.MARKS
    seen: dict = {}
    for w in made:
        turns = held[w["conv_id"]]
        all_ = list(chat.parsed(w["text"], 0, w["loss"]))
        lead = 1 if turns[0][0] == "system" else 0
        before = seen.get(w["conv_id"], 0)
        assert (before == 0) == (w["window"] == 0)
        if before:
            context = w["repeated"] - lead
            assert all_[: w["repeated"]] == all_[: w["repeated"]] and [(r, t) for _, r, t, _ in all_[:lead]] == [(r or "", t or "") for r, t in turns[:lead]]
            assert [(r, t) for _, r, t, _ in all_[lead : w["repeated"]]] == [(r or "", t or "") for r, t in turns[before - context : before]]
            spent = sum(cost(t) for _, t in turns[before - context : before])
            assert spent <= history
            more = before - context - 1
            new = cost(turns[before][1])
            system = cost(turns[0][1]) if lead else 0
            if more >= lead:  # one more turn of history does not fit
                assert spent + cost(turns[more][1]) > history or system + spent + cost(turns[more][1]) + new > budget
        else:
            assert w["repeated"] == 0
        fresh = len(all_) - w["repeated"]
        assert fresh >= 1 and w["tokens"] == sum(cost(t) for _, _, t, _ in all_)
        assert w["tokens"] <= budget or fresh - (0 if before else lead) <= 1 and w["repeated"] <= lead
        assert [covered is not None for k, *_, covered in all_] == [r == "assistant" and k >= w["repeated"] for k, r, *_ in all_]
        after = before + fresh
        if after < len(turns):  # the next turn did not fit
            assert w["tokens"] + cost(turns[after][1]) > budget
        seen[w["conv_id"]] = after
    assert seen == {c: len(v) for c, v in held.items()}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", "|", "\\", "\n", "n", ">", chat.BEGIN, chat.END, "assistant", "é"]), max_size=12).map("".join), st.text(max_size=8))
def test_escapes_are_reversible(a, b):
    for text in (a, a + b, b + a):
        assert chat.unescaped(chat.escaped(text)) == text and "<|" not in chat.escaped(text)
        assert chat.unescaped_role(chat.escaped_role(text)) == text and "\n" not in chat.escaped_role(text)
        written = f"{chat.BEGIN}user\n{chat.escaped(text)}{chat.END}\n" * 2
        assert [t for _, _, t, _ in chat.parsed(written, 0, [])] == [text, text]


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    held = in_order(duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{sf}/conversations.parquet'").fetchall())
    told = "<|im_end|><|im_start|>assistant ok"
    held[-1] = [("user", told), ("assistant", told)]
    got = chat.op12_chat_windows(spark, sf)
    assert {r["conv_id"]: tuple(r)[1:5] for r in got.collect()} == {c: digest(v) for c, v in held.items()}
    assert all(r["formatted_chars"] > r["loss_chars"] for r in got.collect())


def test_empty_table(spark):
    none = chat.windows(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and chat.digests(chat.read_back(none)).count() == 0
