"""Tool-call linking: calls meet their results by identifier, are put in topological order, checked, and serialised.

Messages are rows (conv_id, turn, kind, call_id, name, arguments, depends_on, content): kind ``call`` (arguments: JSON
text; depends_on: identifiers of calls whose results it needs), ``result`` (content) or anything else, which is passed on.
No conversation is gathered: links are hash joins by (conversation, identifier), and the order is a column of levels.
"""

from __future__ import annotations

import json
import math
import re
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, map_batches

_TYPES = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None), "integer": int, "number": (int, float)}
#: What schemas may say. "$schema", "title", "description" and "default" say nothing about validity.
KEYWORDS = {"type", "enum", "minLength", "maxLength", "minimum", "maximum", "required", "properties", "additionalProperties", "items", "$schema", "title", "description", "default"}
#: Arguments nested deeper are a problem of their own.
DEEPEST = 200


def check_schema(schema: dict) -> None:
    """Raise ValueError for what ``problems`` could not judge: other keywords or types, and schemas that aren't objects."""
    if not isinstance(schema, dict) or schema.keys() - KEYWORDS:
        raise ValueError(f"schema with unknown keywords: {sorted(schema.keys() - KEYWORDS) if isinstance(schema, dict) else schema}")
    kinds = schema.get("type", [])
    if unknown := {kinds} - _TYPES.keys() if isinstance(kinds, str) else set(kinds) - _TYPES.keys():
        raise ValueError(f"schema with unknown types: {sorted(unknown)}")
    for inner in [*schema.get("properties", {}).values(), *([schema["items"]] if "items" in schema else []), *([x] if isinstance(x := schema.get("additionalProperties"), dict) else [])]:
        check_schema(inner)


def _is(value: Any, kind: str) -> bool:
    if kind == "integer" and isinstance(value, float):
        return value.is_integer()
    return isinstance(value, _TYPES[kind]) and (kind == "boolean" or not isinstance(value, bool))


def _same(a: Any, b: Any) -> bool:
    """Equal as JSON: true is not 1."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(v, b[k]) for k, v in a.items())
    return a == b


def depth(value: Any) -> int:
    """How deep lists and objects are nested, without recursion."""
    deepest, level = 0, [value]
    while level := [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]:
        deepest += 1
    return deepest


def problems(value: Any, schema: dict, at: str = "$") -> list[str]:
    """Where a value breaks a schema (see ``KEYWORDS``)."""
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not {kinds}"]
    out = []
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        out.append(f"{at}: not in enum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: too long")
    if _is(value, "number"):
        if value < schema.get("minimum", value):
            out.append(f"{at}: too small")
        if value > schema.get("maximum", value):
            out.append(f"{at}: too large")
    if isinstance(value, dict):
        own, others = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in own:
                out += problems(v, own[k], f"{at}.{k}")
            elif others is False:
                out.append(f"{at}.{k}: unknown")
            elif isinstance(others, dict):
                out += problems(v, others, f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += problems(v, schema["items"], f"{at}[{i}]")
    return out


def _escaped(text: str) -> str:
    """A lone surrogate, which UTF-8 has no form for, as its escape."""
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


_SURROGATE = re.compile("[\ud800-\udfff]")


def canonical(value: Any) -> str:
    """JSON with sorted keys and without white space; characters are not escaped without need."""
    return _escaped(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _no_constant(name: str):
    raise ValueError(name)


def _finite(number: str) -> float:
    """JSON has no infinity, which a number beyond a double would become."""
    value = float(number)
    if math.isinf(value):
        raise ValueError(number)
    return value


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level), calls (conv_id, call_id, turn, depends_on) one a key: the topological order. A call's
    level is one more than the highest of the calls that it depends on; 0 without any.

    Unknown dependencies do not count. The level is null on a cycle, and where a cycle is depended on.

    Calls that depend on one other call jump along their chains, twice as far each round, to the first call that depends
    on none or on several: a chain of n calls takes log2(n) rounds of joins. Those that depend on several take a round
    each time such a call depends on another one.
    """
    scratch, key = Scratch(calls.sparkSession, "levels"), ["conv_id", "call_id"]
    needs = calls.select(*key, F.explode("depends_on").alias("need"))
    there = calls.select("conv_id", F.col("call_id").alias("need"))
    edges = needs.join(there, ["conv_id", "need"]).distinct()
    edges = scratch.write(edges.groupBy(*key).agg(F.count("*").alias("k"), F.min("need").alias("need"), F.collect_set("need").alias("needs")), "edges")
    nodes = scratch.write(calls.select(*key).join(edges, key, "left").select(*key, F.coalesce("k", F.lit(0)).alias("k"), "need", "needs"), "nodes")

    # chains: where each call that depends on one other gets to, and after how many steps
    chains, single = nodes.where("k = 1").select(*key, F.col("need").alias("to"), F.lit(1).alias("steps")), nodes.where("k = 1").count()
    chains, reach, turn = scratch.write(chains, "chains-0"), 1, 0
    while reach < single:
        turn, reach = turn + 1, 2 * reach
        further = chains.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("beyond"), F.col("steps").alias("more"))
        jumped = chains.join(further, ["conv_id", "to"], "left")
        jumped = jumped.select(*key, F.coalesce("beyond", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("beyond").isNotNull().alias("moved"))
        jumped = scratch.write(jumped, f"chains-{turn}")
        scratch.drop(f"chains-{turn - 1}")
        moved, chains = jumped.where("moved").limit(1).count(), jumped.drop("moved")
        if not moved:
            break

    # what is left: calls that depend on none, and on several
    tips = nodes.where("k <> 1").select("conv_id", F.col("call_id").alias("need"), F.col("call_id").alias("to"), F.lit(0).alias("steps"))
    tips = tips.unionByName(chains.select("conv_id", F.col("call_id").alias("need"), "to", "steps"))
    several = nodes.where("k > 1")
    joins = scratch.write(several.select(*key, F.explode("needs").alias("need")).join(tips, ["conv_id", "need"]).select(*key, "to", "steps"), "joins")
    free = scratch.write(nodes.where("k = 0").select(*key, F.lit(0).alias("level")), "done-0")
    done, count, turn, left = free, 0, 0, several.count()
    while count < left:
        turn += 1
        known = done.select("conv_id", F.col("call_id").alias("to"), F.col("level").alias("above"))
        ready = joins.join(known, ["conv_id", "to"], "left").groupBy(*key)
        ready = ready.agg(F.max(F.col("above") + F.col("steps") + 1).alias("level"), F.max(F.col("above").isNull()).alias("waits")).where("not waits").drop("waits")
        more, before = scratch.write(ready, f"done-{turn}"), count
        if turn > 1:
            scratch.drop(f"done-{turn - 1}")
        done, count = free.unionByName(more), more.count()
        if count == before:  # what is left waits for itself
            break
    ends = done.select("conv_id", F.col("call_id").alias("to"), F.col("level").alias("base"))
    along = chains.join(ends, ["conv_id", "to"], "left").select(*key, (F.col("base") + F.col("steps")).alias("level"))
    waiting = several.select(key).join(done, key, "left_anti").withColumn("level", F.lit(None).cast("int"))
    out = scratch.write(done.unionByName(along).unionByName(waiting), "levels")
    scratch.keep("levels")
    return out


def link(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """A row per message: (conv_id, turn, kind, call_id, linked, n_results, level, valid, problems, canonical).

    linked: a call with a result, or a result with a call, in the same conversation. n_results: the results of a call.
    Order messages by (conv_id, level, turn): calls come after those that they depend on; see ``levels``.
    valid: arguments are JSON that meets the schema of the call's name; problems say why not. canonical: the call with
    the content and turn of its first result, or null, as canonical JSON; null for other messages. Arguments that aren't
    JSON (numbers beyond a double among them), or are nested deeper than ``DEEPEST``, stand in it as text. Schemas with unknown keywords raise ValueError.

    Of calls with one identifier the first by turn (then by arguments) is meant by results and dependencies; the others
    are reported too, unlinked, with the problem "repeated identifier". Null identifiers link with nothing; null
    arguments are not JSON; a name without a schema is a problem. Extra columns are dropped; no rows give no rows.
    """
    for schema in schemas.values():
        check_schema(schema)
    kinds = {"conv_id": "long", "turn": "long", "kind": "string", "call_id": "string", "name": "string", "arguments": "string", "depends_on": "array<string>", "content": "string"}
    rows = messages.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])
    key = ["conv_id", "call_id"]
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    sound = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first = rows.where(is_call & sound).groupBy(*key).agg(F.min(F.struct("turn", "arguments", "name", "depends_on")).alias("first"))
    first = first.select(*key, "first.turn", "first.arguments", "first.name", F.coalesce("first.depends_on", F.array().cast("array<string>")).alias("depends_on"))
    answers = rows.where(is_result & sound).groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("answer"), F.count("*").alias("n_results"))
    ordered = levels(first.select(*key, "turn", "depends_on"))
    linked = first.join(answers, key, "left").join(ordered, key)

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        valid, wrong, text = [], [], []
        for call_id, name, arguments, answer in zip(*(batch[c].to_pylist() for c in ("call_id", "name", "arguments", "answer")), strict=True):
            try:
                value = json.loads(arguments if arguments is not None else "", parse_constant=_no_constant, parse_float=_finite)
                if depth(value) > DEEPEST:
                    value, bad = arguments, ["nested too deeply"]
                else:
                    bad = problems(value, schemas[name]) if name in schemas else ["no schema"]
            except ValueError:
                value, bad = arguments, ["not JSON"]
            except RecursionError:
                value, bad = arguments, ["nested too deeply"]
            valid.append(not bad)
            wrong.append([_escaped(x) for x in bad])
            text.append(canonical({"arguments": value, "id": call_id, "name": name, "result": answer}))
        return pa.record_batch([*(batch[c] for c in keep), pa.array(valid), pa.array(wrong, pa.list_(pa.string())), pa.array(text)], [*keep, "valid", "problems", "canonical"])

    keep = ["conv_id", "call_id", "turn", "n_results", "level"]
    calls = map_batches(linked.select(*keep, "name", "arguments", "answer"), finish, "conv_id long, call_id string, turn long, n_results long, level int, valid boolean, problems array<string>, canonical string")
    none = {"problems": F.lit(None).cast("array<string>"), "canonical": F.lit(None).cast("string"), "valid": F.lit(None).cast("boolean"), "n_results": F.lit(None).cast("long"), "level": F.lit(0)}
    out = ["conv_id", "turn", "kind", "call_id", "linked", "n_results", "level", "valid", "problems", "canonical"]
    heads = calls.withColumns({"kind": F.lit("call"), "linked": F.col("n_results").isNotNull(), "n_results": F.coalesce("n_results", F.lit(0))}).select(out)
    # calls beyond the first of their identifier, as often as they occur, and those without one
    same = [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in ("turn", "arguments", "name")]
    copies = rows.where(is_call).groupBy("conv_id", "call_id", "turn", "arguments", "name", "depends_on").agg(F.count("*").alias("copies"))
    copies = copies.join(first.select(*key, *[F.col(c).alias(f"f_{c}") for c in ("turn", "arguments", "name", "depends_on")], F.lit(1).alias("found")), key, "left")
    is_first = F.coalesce(same[0] & same[1] & same[2] & F.coalesce("depends_on", F.array().cast("array<string>")).eqNullSafe(F.col("f_depends_on")) & F.col("found").isNotNull(), F.lit(False))
    extra = copies.withColumn("copies", F.col("copies") - is_first.cast("int")).where("copies > 0").withColumn("one", F.explode(F.expr("sequence(1, copies)")))
    reason = F.when(sound, "repeated identifier").otherwise("no identifier")
    repeated = extra.withColumns(none | {"kind": F.lit("call"), "linked": F.lit(False), "n_results": F.lit(0).cast("long"), "valid": F.lit(False), "problems": F.array(reason)}).select(out)
    known = first.select(*key, F.lit(True).alias("found"))
    results = rows.where(is_result).join(known, key, "left").withColumns(none | {"linked": F.coalesce("found", F.lit(False))}).select(out)
    others = rows.where(~F.coalesce(is_call | is_result, F.lit(False))).withColumns(none | {"linked": F.lit(False)}).select(out)
    return heads.unionByName(repeated).unionByName(results).unionByName(others)


#: The schema of the calls that ``turns`` makes.
REPLY = {"reply": {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}}}


def turns(conversations: DataFrame) -> DataFrame:
    """Messages of plain conversations (conv_id, turn, role, text): a user's turn calls ``reply`` with its text, and
    needs the reply to the user's turn two before; an assistant's turn is the result of the turn before it."""
    at = lambda back: F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    call_id = F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.when(user, at(0)).when(assistant, at(1)))
    arguments = F.to_json(F.struct("text", "turn"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(user, "call").when(assistant, "result").otherwise(F.col("role")).alias("kind"),
        call_id.alias("call_id"),
        F.when(user, "reply").alias("name"),
        F.when(user, arguments).alias("arguments"),
        F.when(user & (F.col("turn") >= 2), F.array(at(2))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
        F.when(assistant, F.col("text")).alias("content"),
    )
