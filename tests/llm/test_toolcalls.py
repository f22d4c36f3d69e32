import json
import random

import pytest

from tessera.llm import toolcalls

SCHEMAS = {"add": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}, "tags": {"type": "array", "items": {"enum": ["a", "b"]}}}, "additionalProperties": False}}
MESSAGE = "conv_id long, turn long, kind string, call_id string, name string, arguments string, depends_on array<string>, content string, linked string"


def test_link(spark):
    rows = [
        (1, 0, "call", "p", "add", '{"x": 1}', None, None, "?"),
        (1, 1, "result", "p", None, None, None, "é\n", "?"),
        (1, 2, "result", "p", None, None, None, "later", "?"),
        (1, 3, "call", "q", "add", '{"tags": ["c"], "x": true, "y": 0}', ["p"], None, "?"),
        (1, 4, "result", "nobody", None, None, None, "z", "?"),
        (1, 5, "call", "p", "add", '{"x": 2}', [], None, "?"),
        (1, 5, "call", "p", "add", '{"x": 2}', [], None, "?"),
        (2, 0, "call", "a", "add", '{"x": NaN}', ["b", "missing"], None, "?"),
        (2, 1, "call", "b", "other", "{}", ["c"], None, "?"),
        (2, 2, "call", "c", "add", None, [], None, "?"),
        (3, 0, "call", "u", "add", '{"x": 3}', ["v"], None, "?"),
        (3, 1, "call", "v", "add", '{"x": 3}', ["u"], None, "?"),
        (4, 0, "call", None, "add", '{"x": 3}', None, None, "?"),
        (None, 0, "call", "p", "add", '{"x": 3}', None, None, "?"),
        (4, 1, None, None, None, None, None, "hello", "?"),
        (4, 2, "result", None, None, None, None, "hello", "?"),
    ]
    df = spark.createDataFrame(rows, MESSAGE)
    got = toolcalls.link(df, SCHEMAS).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.call_id, r.turn, r.kind): r for r in got}
    p = by[1, "p", 0, "call"]
    assert p.linked and p.valid and p.n_results == 2 and json.loads(p.canonical)["result"] == {"content": "é\n", "turn": 1}
    assert p.canonical.startswith('{"arguments":{"x":1},"id":"p"')
    assert set(by[1, "q", 3, "call"].problems) == {"$.x: not integer", "$.tags[0]: not in enum", "$.y: unknown"}
    assert not by[1, "nobody", 4, "result"].linked and by[1, "p", 2, "result"].linked
    assert by[1, "p", 5, "call"].problems == ["repeated identifier"]
    assert [by[2, k, t, "call"].level for t, k in enumerate("abc")] == [2, 1, 0]
    assert [by[2, k, t, "call"].problems for t, k in enumerate("abc")] == [["not JSON"], ["no schema"], ["not JSON"]]
    assert by[3, "u", 0, "call"].level is None and by[3, "v", 1, "call"].level is None
    assert by[4, None, 0, "call"].problems == ["no identifier"] and by[None, "p", 0, "call"].problems == ["no identifier"]
    assert not by[4, None, 1, None].linked and not by[4, None, 2, "result"].linked
    assert toolcalls.link(df.limit(0), SCHEMAS).count() == 0


def test_turns(spark):
    df = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "ho"), (1, 3, "user", ""), (2, 0, "user", None), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in toolcalls.link(toolcalls.turns(df), toolcalls.REPLY).collect()}
    assert got[1, 1].canonical == '{"arguments":{"text":"hi","turn":1},"id":"1-1","name":"reply","result":{"content":"ho","turn":2}}'
    assert got[1, 2].linked and not got[1, 3].linked and not got[1, 3].valid and not got[2, 0].valid and len(got) == 6


def test_levels(spark):
    n = 100
    rows = [(1, f"c{i}", i, [f"c{i + 1}"] if i < n - 1 else []) for i in range(n)]  # each on the next turn
    rows += [(2, f"c{i}", i, [f"c{i - 1}"] if i else ["x"]) for i in range(n)] + [(2, "x", n, ["unknown"])]
    rows += [(4, f"c{i}", i, [f"c{i - 1}", f"c{i - 2}", f"c{i - 1}"] if i > 1 else []) for i in range(6)]
    rows += [(5, "a", 0, ["b"]), (5, "b", 1, ["a"]), (5, "c", 2, ["b"]), (5, "d", 3, []), (5, "e", 4, ["e"]), (5, "f", 5, ["d", "c"]), (5, "g", 6, ["f"]), (5, "h", 7, ["d", "i"]), (5, "i", 8, ["d"])]
    rows += [(6, "p", 0, ["q", "r"]), (6, "q", 1, ["p", "r"]), (6, "r", 2, [])]
    got = {(r.conv_id, r.call_id): r.level for r in toolcalls.levels(spark.createDataFrame(rows, "conv_id long, call_id string, turn long, depends_on array<string>")).collect()}
    assert len(got) == len(rows)
    assert [got[1, f"c{i}"] for i in range(n)] == list(range(n - 1, -1, -1))
    assert [got[2, f"c{i}"] for i in range(n)] == list(range(1, n + 1)) and got[2, "x"] == 0
    assert [got[4, f"c{i}"] for i in range(6)] == [0, 0, 1, 2, 3, 4]
    assert [got[5, k] for k in "abcdefghi"] == [None, None, None, 0, None, None, None, 2, 1]
    assert [got[6, k] for k in "pqr"] == [None, None, 0]


def test_levels_against_rounds(spark):
    rng = random.Random(4)
    rows = [(c, f"c{i}", i, [f"c{rng.randrange(30)}" for _ in range(rng.choice((0, 1, 1, 1, 2)))] if rng.random() < 0.1 else [f"c{rng.randrange(i)}" for _ in range(rng.choice((0, 1, 1, 1, 2))) if i]) for c in range(20) for i in range(30)]
    want = {}
    for c in range(20):
        needs = {k: set(d) for conv, k, _, d in rows if conv == c}
        level = {}
        while more := {k: 1 + max(level[x] for x in d) if d else 0 for k, d in needs.items() if k not in level and d <= level.keys()}:
            level |= more
        want |= {(c, k): level.get(k) for k in needs}
    got = toolcalls.levels(spark.createDataFrame(rows, "conv_id long, call_id string, turn long, depends_on array<string>")).collect()
    assert {(r.conv_id, r.call_id): r.level for r in got} == want


def test_odd_arguments(spark):
    deep = "[" * 5000 + "]" * 5000
    rows = [(1, 0, "call", "a", "add", '{"x": 1, "t": "\\ud800"}', None, None, ""), (1, 1, "call", "b", "add", deep, None, None, ""), (1, 2, "call", "c", "add", "[" * 300 + "]" * 300, None, None, ""), (1, 3, "call", "d", "add", '{"x": 2.0}', None, None, "")]
    got = {r.call_id: r for r in toolcalls.link(spark.createDataFrame(rows, MESSAGE), {"add": {"type": "object", "properties": {"x": {"type": "integer"}}}}).collect()}
    assert got["a"].valid and json.loads(got["a"].canonical)["arguments"]["t"] == "\ud800" and got["d"].valid
    assert got["b"].problems == got["c"].problems == ["nested too deeply"]
    for schema in ({"pattern": "x"}, {"properties": {"x": {"oneOf": []}}}, {"type": "text"}):
        with pytest.raises(ValueError):
            toolcalls.check_schema(schema)
    assert toolcalls.problems(True, {"enum": [1]}) and not toolcalls.problems(1.0, {"enum": [1]})
    assert toolcalls.problems(5, {"maximum": 4}) and toolcalls.problems("abc", {"maxLength": 2}) and toolcalls.problems({"z": 1}, {"additionalProperties": {"type": "string"}})


def test_numbers_beyond_a_double_are_not_json(spark):
    odd = ['{"text":"a","turn":1e999}', '{"text":["b",{"c":-1E400}],"turn":1}', "1e999", "[1e999]", "Infinity", '{"turn":NaN}', "1" * 5000]
    rows = [(1, i, "call", f"c{i}", "reply", text, None, None, "") for i, text in enumerate(odd)] + [(1, 99, "call", "ok", "reply", '{"text":"a","turn":1e300}', None, None, "")]
    got = {r.call_id: r for r in toolcalls.link(spark.createDataFrame(rows, MESSAGE), {"reply": {"type": "object"}}).collect()}
    for i, text in enumerate(odd):
        assert got[f"c{i}"].problems == ["not JSON"] and json.loads(got[f"c{i}"].canonical)["arguments"] == text
    assert got["ok"].valid
