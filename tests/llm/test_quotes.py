"""Quotation linking: its SQL on a table with quotes, very long quote runs, odd rows."""

import random

import duckdb
import pytest

from ridgeloom.llm import quotes

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ("conv_id", "turn", "role", "text", "n_quoted", "reply_to", "thread", "depth")


def quoted_chats():
    """Chats that quote runs of earlier lines at several levels, with attributions, blanks and repeated lines."""
    rng = random.Random(1)
    bits = ["Yes.", "No way", "first POINT here", "second  point", "", "On Monday, a wrote:", " x\ty "]
    rows = []
    for conv in range(40):
        said = []
        for turn in range(rng.randrange(1, 12)):
            out = []
            for _ in range(rng.randrange(6)):
                if said and rng.random() < 0.5:
                    lines = rng.choice(said).split("\n")
                    at = rng.randrange(len(lines))
                    marks = ">" * rng.randrange(1, 3) + " " * rng.randrange(2)
                    out += [marks + line for line in lines[at : at + rng.randrange(1, 4)]]
                else:
                    out.append(rng.choice(bits))
            said.append("\n".join(out))
            rows.append((conv, turn, rng.choice("ab"), said[-1]))
    rows += [(1, 0, "a", None), (1, 0, "a", rows[0][3]), (None, 1, "x", "> Yes."), (1, None, "x", "> Yes."), (2, 3, "c", "ÀB\r\n> àb\r\nÉ\x01\x02é")]
    return rows


def test_sql_agrees_on_a_table_with_quotes(spark, tmp_path):
    path = f"{tmp_path}/conversations"
    spark.createDataFrame(quoted_chats(), SCHEMA).coalesce(1).write.parquet(path)
    got = [tuple(r[c] for c in COLUMNS) for r in quotes.format_chats(spark.read.parquet(path)).collect()]
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{path}/*.parquet'")
    want = con.sql(f"select {', '.join(COLUMNS)} from ({quotes.ORACLE})").fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(r[5] is not None for r in got) > 80 and max(r[7] for r in got) > 2


def test_whole_passages_come_before_their_lines(spark):
    rows = [(1, 0, "a", "Fine.\nYes."), (1, 1, "b", "Yes."), (1, 2, "c", "> Yes.\nOk."), (1, 3, "d", "> Fine.\n> No such line.\nOk then."), (1, 4, "e", ">>  fine.\n>> YES.")]
    got = {r.turn: r.reply_to for r in quotes.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: None, 1: None, 2: 1, 3: 0, 4: 0}


def test_quotes(spark):
    rows = [
        (1, 0, "a", "First point.\nSecond  point."), (1, 1, "b", "Mine."), (1, 2, "c", "On Monday, a wrote:\n> second POINT.\nYes."),
        (1, 3, "d", ">> Second point.\n> Yes.\nIndeed."), (1, 4, "e", "> said by nobody\nHm."), (2, 0, "a", None), (2, 0, "a", ""), (None, 1, "x", "> First point."),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as level", "2 as thread")
    got = {(r.conv_id, r.turn, r.role): (r.text, r.n_quoted, r.reply_to, r.thread, r.depth) for r in quotes.format_chats(df).where("conv_id = 1").collect()}
    assert got[1, 2, "c"] == ("Yes.", 1, 0, 0, 1)
    assert got[1, 3, "d"] == ("Indeed.", 2, 2, 0, 2)
    assert got[1, 4, "e"] == ("Hm.", 1, None, 4, 0) and got[1, 1, "b"] == ("Mine.", 0, None, 1, 0)
    assert quotes.format_chats(df).count() == len(rows) and quotes.format_chats(df.limit(0)).collect() == []


@pytest.mark.parametrize("text", [">" * 100_000 + " hi", "> > > " * 50_000 + "\n" + "> line\n" * 50_000])
def test_very_long_quotes(spark, text):
    rows = [(1, 0, "a", "line\n" * 50_000), (1, 1, "b", text)]
    got = {r.turn: (r.n_quoted, r.reply_to) for r in quotes.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == ((1, None) if text[1] == ">" else (50_001, 0))
