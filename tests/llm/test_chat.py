"""Tool-call linking on small logs, and the query against its SQL."""

import json

import duckdb
import pytest

from quillwork.llm import chat, queries

SCHEMA = {"add": {"type": "object", "required": ["a"], "additionalProperties": False,
                  "properties": {"a": {"type": "number", "maximum": 9}, "b": {"type": "array", "items": {"type": "string"}, "minItems": 1},
                                 "c": {"enum": ["x", None]}, "d": {"type": ["object", "null"]}}}}
CALLS = "conv long, turn long, call_id string, name string, arguments string, after string"
RESULTS = "conv long, turn long, call_id string, content string"


def test_faults():
    check = lambda v: chat.faults(v, SCHEMA["add"])
    assert check({"a": 1, "b": ["s"], "c": None, "d": {}}) == []
    assert check([]) == ["$:type"] and check({}) == ["$.a:required"]
    assert check({"a": True, "b": [], "c": 3, "e": 1}) == ["$.a:type", "$.b:minItems", "$.c:enum", "$.e:unknown"]
    assert check({"a": 10, "b": [1], "d": 4}) == ["$.a:maximum", "$.b[0]:type", "$.d:type"]


def test_equal_in_json():
    assert chat.faults(True, {"enum": [1]}) == chat.faults(1, {"const": True}) == ["$:enum"]
    assert chat.faults(1.0, {"enum": [1]}) == chat.faults({"a": [1]}, {"const": {"a": [1.0]}}) == []
    assert chat.faults(10**400, {"type": "integer", "minimum": 0}) == [] and chat.faults(0.5, {"type": "integer"}) == ["$:type"]


def test_arguments_that_cannot_be_written(spark):
    bad = ['{"a": "\\ud800"}', '{"\\udfff": 1}', '{"a": 1e400}', '{"a": -Infinity}', "[" * 5000 + "]" * 5000, "[" * 300 + "]" * 300, "9" * 5000, ""]
    good = ['{"a": "\\ud83d\\ude00"}', '{"a": 1' + "0" * 400 + "}", '{"a": 1e300}', '{"a": ' + "[" * 150 + "]" * 150 + "}"]
    calls = [(1, i, f"c{i}", "any", a, None) for i, a in enumerate(bad + good)]
    out = chat.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), {"any": {"type": "object"}}).collect()
    got = {r["turn"]: r["errors"] for r in out}
    assert [got[i] for i in range(len(calls))] == ["not_json"] * len(bad) + [None] * len(good)
    with_const = {"any": {"type": "object", "properties": {"a": {"type": "integer"}}}}
    out = chat.link(spark.createDataFrame([calls[len(bad) + 1]], CALLS), spark.createDataFrame([], RESULTS), with_const).collect()
    assert [r["errors"] for r in out] == [None]


def test_canonical():
    assert chat.canonical({"b": [1.0, 0.5, None], "a": {"é": "\n\""}}) == '{"a":{"é":"\\n\\""},"b":[1,0.5,null]}'


def test_linking(spark):
    calls = [
        (1, 0, "a", "add", '{"a": 1}', None), (1, 2, "b", "add", '{"b": [], "a": 2}', "a"), (1, 4, "c", "mul", "{}", "b"),
        (1, 6, "d", "add", "nope", "zzz"), (1, 7, "a", "add", '{"a": 1}', None), (1, 8, None, "add", '{"a": 1}', None),
        (1, 9, "e", "add", '{"a": 1}', "f"), (1, 10, "f", "add", '{"a": 1}', "e"), (1, 11, "g", "add", '{"a": 1}', "f"), (1, 12, "h", "add", '{"a": 1}', "h"),
        (2, 5, "a", "add", '{"a": NaN}', None), (2, 6, "a", "add", '{"a": NaN}', None), (None, 1, "a", "add", None, None),
    ]
    results = [(1, 1, "a", "one"), (1, 3, "b", None), (1, 5, "c", ""), (1, 7, "d", "x"), (1, 8, "a", "again"), (1, 9, "q", "lost"), (2, 4, "a", "before"),
               (1, 10, None, "n"), (1, 11, "e", "r"), (1, 11, "f", "r"), (1, 12, "g", "r"), (1, 13, "h", "r")]
    c = spark.createDataFrame([(*r, "z") for r in calls], CALLS + ", Status string").repartition(3)
    r = spark.createDataFrame([(*x, 5) for x in results], RESULTS + ", level int").repartition(2)
    out = chat.link(c, r, SCHEMA).collect()
    got = {(x["conv"], x["turn"], x["kind"], x["call_id"]): x for x in out}
    assert len(out) == len(got) == len(calls) + 3
    status = lambda *k: (got[k]["status"], got[k]["level"], got[k]["errors"])
    assert status(1, 0, "call", "a") == ("linked", 0, None)
    assert status(1, 2, "call", "b") == ("linked", 1, "$.b:minItems")
    assert status(1, 4, "call", "c") == ("linked", 2, "unknown_tool")
    assert status(1, 6, "call", "d") == ("unknown_after", 0, "not_json")
    assert status(1, 7, "call", "a") == ("repeated", None, None)
    assert status(1, 8, "call", None)[0] == "no_id" and status(None, 1, "call", "a") == ("no_id", None, "not_json")
    for k in ((9, "e"), (10, "f"), (11, "g"), (12, "h")):
        assert status(1, k[0], "call", k[1])[:2] == ("circular", None)
    assert status(2, 5, "call", "a") == ("early", 0, "not_json") and status(2, 6, "call", "a")[0] == "repeated"
    assert status(1, 8, "result", "a")[0] == "repeated" and status(1, 9, "result", "q")[0] == "orphan" and status(1, 10, "result", None)[0] == "no_id"
    said = json.loads(got[1, 2, "call", "b"]["message"])
    assert said == {"after": "a", "function": {"arguments": {"a": 2, "b": []}, "name": "add"}, "id": "b", "result": {"content": None, "turn": 3}}
    for conv in (1, 2, None):
        own = sorted((x for x in out if x["conv"] == conv), key=lambda x: x["position"])
        assert [x["position"] for x in own] == list(range(len(own)))
        known = [x["level"] for x in own if x["level"] is not None]
        assert known == sorted(known)
    assert chat.link(c.limit(0), r.limit(0), SCHEMA).count() == 0


def test_long_chain(spark):
    n = 300
    calls = [(1, i, f"c{i}", "add", '{"a": 1}', f"c{i - 1}" if i else None) for i in range(n)]
    out = chat.link(spark.createDataFrame(calls, CALLS).repartition(4), spark.createDataFrame([], RESULTS), SCHEMA).collect()
    assert sorted((r["turn"], r["level"], r["position"]) for r in out) == [(i, i, i) for i in range(n)]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(cols).collect()))) == sorted(map(str, want))
