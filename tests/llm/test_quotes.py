import duckdb
import pytest

from ledgerloom.llm import quotes

SF = "/root/testdata/sf0.01"


def oracle(**views):
    con = duckdb.connect()
    for k, v in views.items():
        con.register(k, v) if not isinstance(v, str) else con.execute(f"CREATE VIEW {k} AS SELECT * FROM '{v}'")
    return con.execute(quotes.OP1_SQL)


def test_query(spark):
    out = quotes.op1_quotation_linking(spark, SF)
    rel = oracle(conversations=f"{SF}/conversations.parquet")
    assert [c[0] for c in rel.description] == out.columns
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, rel.fetchall()))


ROWS = [
    (1, 0, "user", "Shall we meet?\nI am free on Monday."),
    (1, 1, "assistant", "On Friday Ann wrote:\n> Shall we  MEET?\nYes.\n\n"),
    (1, 2, "user", ">> shall we meet?\n> Yes.\nGood.\r\n"),
    (1, 3, "user", "> I am free on monday.\nThat is not me."),
    (1, 4, "user", "> > > Nobody said this\n>\nWell"),
    (1, 5, "assistant", "Yes."),
    (1, 300, "user", " >Yes.\n>Good.\n>That is\n> not  ME.\n>That is not me.\nBoth"),
    (2, 0, "user", "> Yes.\nalone"),
    (2, 1, "user", ""),
]


def test_links_levels_and_paths(spark):
    m = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    out = quotes.linked(m)
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, oracle(conversations=m.toPandas()).fetchall()))
    got = {(r["conv_id"], r["turn"]): r for r in out.collect()}
    assert [got[1, t]["reply_to"] for t in (0, 1, 2, 3, 4, 5, 300)] == [None, 0, 1, 0, None, None, 3]
    assert got[1, 300]["path"] == "0000000000,0000000003,0000000300" and got[1, 2]["depth"] == 2 and got[1, 1]["own_text"] == "Yes."
    assert got[1, 4]["max_level"] == 3 and got[1, 4]["n_linked"] == 0
    order = {r["conv_id"]: [x["turn"] for x in r["messages"]] for r in quotes.conversations(out).collect()}
    assert order == {1: [0, 1, 2, 3, 300, 4, 5], 2: [0, 1]}


def test_rewrapped_and_nested_passages_and_short_lines(spark):
    said = "The delivery will reach you on Tuesday morning. Please keep the receipt. Yes."
    rows = [
        (1, 0, "user", said),
        (1, 1, "user", "A first answer.\n\nYes."),
        (1, 2, "user", "> The delivery will reach\n> you on Tuesday\n> morning. Please keep\n> the receipt. Yes.\nFine."),
        (1, 3, "user", "> Please keep the\n> receipt. Yes.\nI did."),
        (1, 4, "user", ">> The delivery will reach you on Tuesday\n>> morning.\n> I did.\nNo."),
        (1, 5, "user", "> Nothing like it. Yes.\nOdd."),
        (1, 6, "user", "> Yes.\nWhich?"),
    ]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = quotes.linked(m)
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, oracle(conversations=m.toPandas()).fetchall()))
    got = {r["turn"]: (r["n_quoted"], r["n_linked"], r["reply_to"]) for r in out.collect()}
    assert got == {0: (0, 0, None), 1: (0, 0, None), 2: (1, 1, 0), 3: (1, 1, 0), 4: (2, 2, 3), 5: (1, 0, None), 6: (1, 1, 1)}


def test_siblings_stand_in_the_order_of_turns(spark):
    rows = [(1, 0, "user", "What do you all think?")] + [(1, t, "user", f"> What do you all think?\nAnswer {t}") for t in range(1, 13)]
    out = quotes.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [r["turn"] for r in out.orderBy("path").collect()] == list(range(13))


def test_very_long_text(spark):
    long = "\n".join(f"Line number {k} of a very long message." for k in range(5_000))
    rows = [(1, 0, "user", long), (1, 1, "user", "> Line number 4999 of a\n> very long message.\nOk"), (1, 2, "user", "\n".join("> " + x for x in long.split("\n")))]
    got = {r["turn"]: (r["n_linked"], r["reply_to"]) for r in quotes.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: (0, None), 1: (1, 0), 2: (1, 0)}


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, 0, "user", "a b"), (1, 0, "user", "a b"), (1, 1, None, "> a b"), (1, 1, None, "> a b"), (None, 1, "user", "> a b"), (1, None, "user", "> a b"), (1, 2, "user", None)]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS lines", "2 AS path")
    got = sorted((str(r["conv_id"]), str(r["turn"]), str(r["reply_to"])) for r in quotes.linked(m).collect())
    assert got == [("1", "0", "None")] * 2 + [("1", "1", "0")] * 2 + [("1", "2", "None"), ("1", "None", "None"), ("None", "1", "None")]
    assert quotes.linked(m.where("false")).count() == 0


@pytest.mark.parametrize("depth", [40])
def test_deep_chain_of_common_lines(spark, depth):
    rows = [(7, t, "user", f"line {t}\n> line {t - 1}") for t in range(depth)]
    got = {r["turn"]: r["depth"] for r in quotes.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {t: t for t in range(depth)}
