"""Walking schemas gives what the compiled expression gives, and takes schemas that contain themselves."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from proofmill.operators.schema_check import problems
from proofmill.operators.schema_walk import _brackets, _depth, compiled, settled, violations

MEMBERS = ["a", "b", "0", "x y"]


def schema(rnd, depth):
    """A random schema of the keywords that published ones have."""
    out = {}
    for word, make in (
        ("type", lambda: rnd.choice(["object", "array", "string", "integer", "number", ["null", "boolean"], "object", "object"])), ("enum", lambda: rnd.sample([None, 1, True, "s", [1], {"a": 1}], 3)),
        ("const", lambda: rnd.choice([1, "s", None])), ("pattern", lambda: "^s"), ("minimum", lambda: 1), ("maximum", lambda: 2.5), ("minItems", lambda: rnd.randint(1, 2)), ("required", lambda: rnd.sample(MEMBERS, rnd.randint(1, 2))),
    ):
        if rnd.random() < 0.2:
            out[word] = make()
    if depth:
        sub = lambda: schema(rnd, depth - 1) if rnd.random() < 0.9 else rnd.random() < 0.5
        for word, make in (
            ("properties", lambda: {m: sub() for m in rnd.sample(MEMBERS, 2)}), ("additionalProperties", sub), ("items", sub), ("contains", lambda: schema(rnd, 0)), ("allOf", lambda: [schema(rnd, depth - 1)]),
            ("oneOf", lambda: [schema(rnd, depth - 1), schema(rnd, depth - 1)]), ("anyOf", lambda: [schema(rnd, depth - 1), schema(rnd, 0)]), ("$ref", lambda: "#/$defs/p"),
        ):
            if rnd.random() < 0.25:
                out[word] = make()
    return out


def value(rnd, depth):
    kind = rnd.choice(["object", "array", "plain"]) if depth else "plain"
    if kind == "object":
        return {m: value(rnd, depth - 1) for m in rnd.sample(MEMBERS, rnd.randint(0, 3))}
    return [value(rnd, depth - 1) for _ in range(rnd.randint(0, 3))] if kind == "array" else rnd.choice([None, True, 0, 1, 2.0, 3.5, "s", "t"])


def walked(spark, schemas, values):
    rows = spark.createDataFrame([(i, json.dumps(v), name) for name in schemas for i, v in enumerate(values)], "i int, text string, schema string").withColumn("name", F.col("schema"))
    return sorted((r["name"], r.i, r.word, r["at"]) for r in violations(rows, schemas).collect())


def test_walks_find_what_expressions_find(spark):
    rnd = random.Random(11)
    schemas = {f"s{k}": {**schema(rnd, 2), "$defs": {"p": {"required": ["a"], "type": "object"}}} for k in range(14)}
    values = [value(rnd, 3) for _ in range(40)]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, t string").withColumn("v", F.parse_json("t"))
    want = []
    for name, s in schemas.items():
        want += [(name, r.i, r.x.word, r.x.pointer) for r in df.select("i", F.explode(problems(s, F.col("v"))).alias("x")).collect()]
    # a state that is reached twice is asked once: of two equal findings of one value the expression has both
    assert set(walked(spark, schemas, values)) == set(want) and len(set(want)) > 200


def test_schemas_may_contain_themselves(spark):
    tree = {"$defs": {"node": {"type": "object", "required": ["id"], "properties": {"kids": {"type": "array", "items": {"$ref": "#/$defs/node"}}, "up": {"$ref": "#"}}}}, "$ref": "#/$defs/node"}
    values = [{"id": 1, "kids": [{"id": 2}, {"kids": [{"id": 3, "kids": [{}]}]}, 5]}, {"id": 1, "up": {"up": {"id": "{[\"}"}}}, {"id": 0}, 7]
    assert [x[1:] for x in walked(spark, {"t": tree}, values)] == [(0, "required", "/kids/1/id"), (0, "required", "/kids/1/kids/0/kids/0/id"), (0, "type", "/kids/2"), (1, "required", "/up/id"), (3, "type", "")]
    assert compiled({"t": tree}).levels is None
    with pytest.raises(ValueError):
        compiled({"t": {"$defs": {"n": {"oneOf": [{"type": "null"}, {"properties": {"n": {"$ref": "#/$defs/n"}}}]}}, "$ref": "#/$defs/n"}})
    with pytest.raises(ValueError):
        compiled({"t": {"$ref": "other.json"}})


def test_rows_without_json_or_schema_have_no_violations(spark):
    rows = spark.createDataFrame([("{oops", "t"), (None, "t"), ("5", "none"), ("5", None), ("5", "t"), ("5", "t")], "text string, schema string")
    assert [(r.word, r["at"]) for r in violations(rows, {"t": {"type": "string"}, "u": True}).collect()] == [("type", "")] * 2
    assert violations(rows.limit(0), {"t": {"type": "string"}}).collect() == []


def test_the_plan_does_not_grow_with_schemas(spark):
    one = {"type": "object", "required": ["a"], "properties": {"a": {"oneOf": [{"type": "string"}, {"minimum": 2}]}}}
    rows = spark.createDataFrame([("{}", "s0")], "text string, schema string")
    lines = [len(violations(rows, {f"s{k}": one for k in range(n)})._jdf.queryExecution().optimizedPlan().toString().splitlines()) for n in (1, 40)]
    assert lines[0] == lines[1]


def test_documents_are_walked_once_and_counted_where_they_are(spark):
    inner = {"oneOf": [{"anyOf": [{"type": "string"}, {"minimum": 2}]}, {"items": {"type": "string"}, "type": "array"}]}
    rows = spark.createDataFrame([("{}", "t", "d1")], "text string, schema string, name string")
    found = violations(rows, {"t": {"properties": {"a": inner, "b": {"items": inner}}}})
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD [text#") == 1
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_conditions_beyond_a_cycle_are_counted(spark):
    to = lambda name: {"$ref": f"#/$defs/{name}"}
    schema = {
        "$defs": {"a": {"properties": {"n": to("b"), "c": {"oneOf": [{"type": "string"}, {"type": "null"}]}}}, "b": {"properties": {"m": to("a")}}},
        "properties": {"a": to("a")}, "oneOf": [{"properties": {"b": to("b")}}, {"type": "string"}],
    }
    assert compiled({"t": schema}).inner == 2
    assert walked(spark, {"t": schema}, [{"b": {"m": {"c": 5}}}, {"b": {"m": {"c": "s"}}}]) == [("t", 0, "oneOf", "")]


def test_settled_conditions_find_what_walked_ones_find(spark, monkeypatch):
    """As many rows too. Where two states of a value lead on to the same one, conditions stay conditions."""
    to = lambda name: {"$ref": f"#/$defs/{name}"}
    plain = {"oneOf": [{"minimum": 2}, {"type": ["string", "null"]}, {"enum": [1, [1], "s"]}], "anyOf": [{"type": "object", "required": ["a"], "additionalProperties": False}, {"const": {"a": 1}}, {"type": "array", "minItems": 2}, {"type": "string", "pattern": "^s"}, False]}
    schemas = {
        "once": {"properties": {"a": plain, "b": {"items": {"required": ["a"], **plain}}, "0": {"oneOf": [plain, {"type": "string"}]}}, "items": {**plain, "allOf": [{"type": "number"}]}},
        "twice": {"$defs": {"q": plain, "p": {"properties": {"a": to("q")}}, "r": {"properties": {"a": to("q")}}}, "allOf": [to("p"), to("r")]},
        "itself": {"$defs": {"n": {"properties": {"b": to("n"), "a": plain}}}, "$ref": "#/$defs/n"},
    }
    assert [any(r.get("settled") for r in settled(compiled({n: s})).rows) for n, s in schemas.items()] == [True, False, True]
    assert (settled(compiled({"t": schemas["itself"]})).inner, compiled({"t": schemas["itself"]}).inner) == (0, 1)
    rnd = random.Random(5)
    values = [{"a": 1}, {"a": 1.5}, {"a": "s"}, {"a": {"a": 1}}, {"a": [1]}, {"a": None}, {"b": {"b": {"a": 5}}}, {"b": [{"a": 1}, {}, 3]}, [1, "s", {"a": 1, "b": 2}]] + [value(rnd, 3) for _ in range(30)]
    found = walked(spark, schemas, values)
    monkeypatch.setattr("proofmill.operators.schema_walk.settled", lambda automaton: automaton)
    assert found == walked(spark, schemas, values)
    assert {(name, word) for name, _, word, _ in found} >= {(name, word) for name in schemas for word in ("oneOf", "anyOf")}


def test_depth_is_that_of_the_brackets(spark):
    texts = {"5": 0, "{}": 1, '{"a": [{}, {"b": "[{\\"["}, []]}': 3, "[[], [[1, [2]]], {}]": 4, '"{["': 0}
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", _depth(_brackets(F.col("t"))).alias("d")).collect()
    assert {r.t: r.d for r in found} == texts
