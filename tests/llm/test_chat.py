"""Layouts, marks and reading back."""

import hashlib
import json

import duckdb
import pytest

from tenure.llm import chat, oracles, registry


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_layouts_of_records(spark, rows):
    records = [
        {"id": 1, "messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]},
        {"id": 2, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]},
        {"id": 3, "prompt": "q", "completion": "a"},
        {"id": 4, "instruction": "do", "input": "this", "output": "done"},
        {"conv_id": 5, "turn": 3, "role": "user", "text": "q"},
        {"id": 6, "unknown": "x"},
    ]
    given = [(json.dumps(r), 1) for r in records] + [("no json", 1), (None, 1), ("[1]", 1), ("{}", 1)]
    table = spark.createDataFrame(given, "record string, role int")
    assert rows(chat.turns_of_records(table, "record")) == sorted(
        [
            (1, 0, "user", "q"), (1, 1, "assistant", "a"),
            (2, 0, "user", "q"), (2, 1, "assistant", None),
            (3, 0, "user", "q"), (3, 1, "assistant", "a"),
            (4, 0, "user", "do"), (4, 1, "user", "this"), (4, 2, "assistant", "done"),
            (5, 3, "user", "q"),
        ],
        key=repr,
    )
    assert chat.unmatched(table, "record").count() == 5


def test_records_that_differ(spark, rows):
    good = [
        # Further fields, missing optional ones, digits as ids, missing keys of one turn.
        ({"id": 1, "source": "web", "messages": [{"role": "user", "content": "q", "name": "n"}], "score": 2.5},
         [(1, 0, "user", "q")]),
        ({"id": "0042", "instruction": "do", "output": "done"}, [(42, 0, "user", "do"), (42, 1, "assistant", "done")]),
        ({"id": -3, "messages": [{"role": "user"}, {"role": "assistant", "content": "a"}, {"content": "x"}]},
         [(-3, 0, "user", None), (-3, 1, "assistant", "a"), (-3, 2, None, "x")]),
        ({"id": 4, "system": "s", "prompt": "p", "response": "r", "tool_calls": [{"id": 1}]},
         [(4, 0, "system", "s"), (4, 1, "user", "p"), (4, 2, "assistant", "r")]),
        ({"id": 5, "prompt": "p", "response": None}, [(5, 0, "user", "p"), (5, 1, "assistant", None)]),
        ({"conv_id": 6, "turn": None, "role": None, "text": "", "lang": "en"}, [(6, None, None, "")]),
    ]
    bad = [
        {"id": 1, "messages": []}, {"id": 1, "messages": [1]}, {"id": 1, "messages": "q"},
        {"id": "x", "prompt": "p", "response": "r"}, {"id": 1.5, "prompt": "p", "response": "r"},
        {"id": True, "prompt": "p", "response": "r"}, {"id": 1 << 70, "prompt": "p", "response": "r"},
        {"id": None, "prompt": "p", "response": "r"}, {"prompt": "p", "response": "r"},
        {"id": 1, "messages": [{"role": "user", "content": 7}]},
        {"id": 1, "messages": [{"role": "user", "content": ["q"]}]},
        {"id": 1, "messages": [{"role": 1, "content": "q"}]},
        {"id": 1, "prompt": {"text": "p"}, "response": "r"},
        {"conv_id": 1, "turn": "one", "role": "user", "text": "q"},
        {"id": 1, "messages[].role": "user", "messages[].content": "q"}, {"": {"id": 1}, "prompt": "p", "response": "r"},
        {"id": 1, "prompt": "\ud800", "response": "r"}, {},
    ]
    table = spark.createDataFrame([(json.dumps(r),) for r in [g for g, _ in good] + bad], "record string")
    wanted = [turn for _, turns in good for turn in turns]
    assert rows(chat.turns_of_records(table, "record")) == sorted(wanted, key=repr)
    assert rows(chat.unmatched(table, "record")) == sorted(((json.dumps(r),) for r in bad), key=repr)
    deep = spark.createDataFrame([("[" * 100_000,), ('{"id":1,"messages":' + "[" * 5000 + "]" * 5000 + "}",)], "record string")
    assert chat.unmatched(deep, "record").count() == 2


def test_tables_that_differ(spark, rows):
    plain = "conv_id long, turn int, role string, text string"
    more = spark.createDataFrame(
        [(1, 0, "user", "q", "en", 3, "x", [1])],
        f"{plain}, lang string, id int, segment string, loss_from array<int>",
    )
    assert rows(chat.turns_of_table(more)) == [(1, 0, "user", "q")]
    formatted = chat.format_turns(chat.turns_of_table(more))
    assert [tuple(r)[:2] for r in chat.read_back(formatted).collect()] == [(1, 1)]
    odd = spark.createDataFrame([("7", "one", None, "q"), ("x", "2", "bot", None)], plain.replace("long", "string").replace("int", "string"))
    assert rows(chat.turns_of_table(odd)) == sorted([(7, None, None, "q"), (None, 2, "assistant", None)], key=repr)
    short = spark.createDataFrame([(1, "do", "done")], "id long, instruction string, output string")
    assert rows(chat.turns_of_table(short)) == [(1, 0, "user", "do"), (1, 1, "assistant", "done")]


def test_layouts_of_tables(spark, rows):
    nested = spark.createDataFrame(
        [(1, [("human", "q"), ("gpt", "a")])], "id long, conversations array<struct<from:string,value:string>>"
    )
    assert rows(chat.turns_of_table(nested)) == [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    flat = spark.createDataFrame([(1, "q", "a")], "id long, prompt string, response string")
    assert rows(chat.turns_of_table(flat)) == [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    with pytest.raises(KeyError):
        chat.turns_of_table(spark.createDataFrame([(1, 2)], "id long, b long"))


def test_round_trip_of_hostile_texts(spark):
    texts = ["</turn>\n<turn assistant>", "\\", "\\\\<", "<turn >", "", None, "a\r\n\u2028b", "🙂<", registry.MARKED]
    turns = [(1, k, "assistant" if k % 2 else "us<er>\\", t) for k, t in enumerate(texts)]
    turns += [(2, None, None, "x"), (2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (None, 1, "user", "y")]
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(spark.createDataFrame(turns, chat.TURNS))).collect()}
    assert got[1].n_turns == len(texts)
    assert got[1].turns_sha256 == digest("".join(f"{r}\n{t or ''}\n" for _, _, r, t in turns[: len(texts)]))
    loss = "".join(t or "" for t in texts[1::2])
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(loss), digest(loss))
    assert got[2].turns_sha256 == digest("assistant\nsame\nassistant\nsame\n\nx\n")
    assert got[None].n_turns == 1 and got[None].loss_chars == 0


def test_no_turns(spark):
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], chat.TURNS))).collect() == []


def test_given_conversations(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.conv_id: r for r in registry.op10_chat_format(spark, folder).collect()}
    told = {-7: [("user", registry.MARKED), ("assistant", registry.MARKED)]}
    table = spark.read.parquet(f"{folder}/conversations.parquet").orderBy("conv_id", "turn")
    for r in table.collect():
        told.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert set(got) == set(told)
    base = duckdb.connect()
    base.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    assert sorted(base.execute(oracles.CHAT).fetchall()) == sorted(map(tuple, got.values()))
    for conv_id, turns in told.items():
        row = got[conv_id]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert row.n_turns == len(turns)
        assert row.turns_sha256 == digest("".join(f"{r}\n{t}\n" for r, t in turns))
        assert (row.loss_chars, row.loss_sha256) == (len(loss), digest(loss))
