"""Operator 10 on hand-made threads."""

import pytest

from sessionlore.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def run(spark, rows):
    got = quotes.linked_conversations(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)).collect()
    return {(r["conv_id"], r["turn"], r["role"]): r.asDict() for r in got}, got


def test_levels_links_and_order(spark):
    rows, _ = run(spark, [
        (1, 0, "user", "First question\nwith two lines"),
        (1, 1, "assistant", "On Monday, user wrote:\n> First   question\n> with TWO lines\n\nAn answer"),
        (1, 2, "user", ">> First question\n>> with two lines\n> An answer\n\nThanks"),
        (1, 3, "user", "> with two lines\nOnly a part"),
        (1, 4, "user", "> nobody said this\nOdd"),
        (2, 5, "user", "> First question\n> with two lines\nother conversation"),
    ])
    a = rows[1, 1, "assistant"]
    assert (a["parent_turn"], a["root_turn"], a["depth"], a["n_quotes"], a["n_linked"]) == (0, 0, 1, 1, 1)
    assert a["formatted"] == "<|assistant|>\nAn answer\n<|end|>"
    b = rows[1, 2, "user"]
    assert (b["parent_turn"], b["root_turn"], b["depth"], b["quote_levels"], b["n_quotes"], b["n_linked"]) == (1, 0, 2, 2, 2, 2)
    assert rows[1, 3, "user"]["parent_turn"] == 0
    assert rows[1, 4, "user"]["parent_turn"] is None and rows[1, 4, "user"]["n_quotes"] == 1 and rows[1, 4, "user"]["n_linked"] == 0
    assert rows[2, 5, "user"]["parent_turn"] is None
    assert [rows[1, t, r]["place"] for t, r in ((0, "user"), (1, "assistant"), (2, "user"), (3, "user"), (4, "user"))] == [0, 1, 2, 3, 4]


def test_replies_follow_what_they_answer(spark):
    # 0 <- 2 <- 5, 0 <- 3, 1 <- 4: two threads that are told in turns.
    parent = {2: 0, 5: 2, 3: 0, 4: 1}
    rows, got = run(spark, [(1, t, "user", (f"> text of {parent[t]}\n" if t in parent else "") + f"text of {t}") for t in range(6)] + [(1, 2, "system", "beside")])
    assert sorted((r["place"], r["turn"], r["role"]) for r in got) == [(0, 0, "user"), (1, 2, "system"), (2, 2, "user"), (3, 5, "user"), (4, 3, "user"), (5, 1, "user"), (6, 4, "user")]
    frame = spark.createDataFrame(got)
    parts = {r["part"]: r for r in quotes.conversations(frame, 4).collect()}
    assert parts[0]["replies"] == "0<-/0,2<-/1,2<0/1,5<2/2" and parts[1]["n_messages"] == 3
    whole = quotes.conversations(frame).first()["conversation"]
    assert [whole.index(f"text of {t}") for t in (0, 2, 5, 3, 1, 4)] == sorted(whole.index(f"text of {t}") for t in range(6)) and ">" not in whole.replace("|>", "")


def test_equal_votes_go_to_the_earlier_turn(spark):
    rows, _ = run(spark, [(1, 0, "user", "first line\nx"), (1, 1, "user", "second line\ny"), (1, 2, "user", "> second line\n> first line\nboth"), (1, 3, "user", "first line\nx"), (1, 4, "user", "> first line\n> x\nwhole")])
    assert rows[1, 2, "user"]["parent_turn"] == 0 and rows[1, 4, "user"]["parent_turn"] == 0


def test_mail_quotes_earlier_turns(spark):
    rows = [(1, 0, "user", "a\nb"), (1, 1, "bot", "c"), (1, 2, "user", None), (1, None, "user", "d"), (None, 1, "user", "e"), (2, 1, "user", "f")]
    got = {(r["conv_id"], r["turn"]): r["text"] for r in quotes.quoting(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {(1, 0): "a\nb", (1, 1): "On Monday, someone wrote:\n> a\n\nc", (1, 2): "On Monday, someone wrote:\n> a\n> b\n\n", (1, None): "d", (None, 1): "e", (2, 1): "f"}


def test_edges(spark):
    long = "word " * 40000
    rows, got = run(spark, [
        (None, 1, "user", "> a"), (3, None, "user", "b"), (3, 1, None, None), (3, 1, None, None), (3, 1, "user", ""), (3, 70, "user", long), (3, 71, "user", "> " + long),
    ])
    assert len(got) == 6
    assert rows[3, 1, None]["copies"] == 2 and rows[None, 1, "user"]["place"] is None
    assert rows[3, 71, "user"]["parent_turn"] == 70 and rows[3, 71, "user"]["place"] == 3


@pytest.mark.parametrize("n", [0, 200])
def test_chain(spark, n):
    rows, got = run(spark, [(7, i, "user", f"> message {i - 1}\nmessage {i}" if i else "message 0") for i in range(n)])
    assert len(got) == n
    assert all(rows[7, i, "user"]["depth"] == i and rows[7, i, "user"]["root_turn"] == 0 and rows[7, i, "user"]["place"] == i for i in range(n))


def test_equals_sql(spark):
    import random

    import duckdb
    import pandas as pd

    from sessionlore.llm.oracles import OP10, OP10_MESSAGES

    rng = random.Random(2)
    bodies, rows = {}, []
    for conv in range(12):
        for turn in range(8):
            text = "\n".join(f"{rng.choice(['alpha', 'Beta', 'gamma  x'])} {rng.randrange(6)}" for _ in range(rng.randrange(1, 4)))
            if turn and rng.random() < 0.7:
                other = bodies[conv, rng.randrange(turn)].split("\n")
                part = other if rng.random() < 0.6 else other[:1]
                text = ("On Monday, x wrote:\n" if rng.random() < 0.3 else "") + "\n".join(rng.choice([">", "> ", ">>"[: 1 + turn % 2] + " "]) + x for x in part) + "\n" + text
            bodies[conv, turn] = text
            rows += [(conv, turn, rng.choice(["user", "assistant"]), text)] * rng.choice([1, 1, 1, 2])
    rows += [(1, 3, "user", "twice"), (None, 1, "user", "> a"), (3, None, "user", "b"), (3, 1, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quotes.linked_conversations(df)
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", conversations)
    found = con.execute(OP10_MESSAGES)
    columns = [c[0] for c in found.description]
    key = lambda r: tuple(map(str, r))
    want = sorted(found.fetchall(), key=key)
    assert sorted(map(tuple, got.select(columns).collect()), key=key) == want
    assert sum(r[columns.index("parent_turn")] is not None for r in want) > 20
    found = con.execute(OP10)
    columns = [c[0] for c in found.description]
    want = sorted(found.fetchall(), key=key)
    parts = quotes.conversations(quotes.linked_conversations(quotes.quoting(df)))
    assert sorted(map(tuple, parts.select(columns).collect()), key=key) == want
