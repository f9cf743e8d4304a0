"""Schemas within schemas; published ones, where a folder of them is given."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from proofmill.operators.schema_check import problems
from proofmill.operators.schema_walk import compiled
from proofmill.plans.validate import validate
from proofmill.sources import bundle
from proofmill.sources.schemas import read_schemas, read_variants, record_types

SCHEMAS = os.environ.get("SCHEMA_DIR")


def found(spark, schema, *values):
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, t string")
    df = rows.select("i", F.explode(problems(schema, F.parse_json("t"))).alias("x"))
    return sorted((r.i, r.x.word, r.x.pointer) for r in df.collect())


def test_members_of_arrays_are_looked_into(spark):
    schema = {"properties": {"l": {"items": {"type": "object", "required": ["a"], "properties": {"a": {"type": "string"}, "m": {"items": {"required": ["z"]}}}}}}}
    values = {"l": [{"a": "x"}, {"a": 1}, 5, {"m": [{"z": 1}, {}]}]}, {"l": "none"}, {"l": []}, {}, {"l": None}
    assert found(spark, schema, *values) == [(0, "required", "/l/3/a"), (0, "required", "/l/3/m/1/z"), (0, "type", "/l/1/a"), (0, "type", "/l/2")]


def test_choices(spark):
    one = {"properties": {"v": {"oneOf": [{"type": "number"}, {"type": "integer"}, {"type": "null"}]}}}
    assert found(spark, one, {"v": 1}, {"v": 1.5}, {"v": None}, {"v": "s"}, {}) == [(0, "oneOf", "/v"), (3, "oneOf", "/v")]
    some = {"anyOf": [{"required": ["a"]}, {"properties": {"b": {"const": 2}}, "required": ["b"]}], "allOf": [{"type": "object"}, {"properties": {"c": {"enum": [None, 1]}}}]}
    assert found(spark, some, {"a": 1}, {"b": 2}, {"b": 3, "c": None}, {"a": 0, "c": 2}) == [(2, "anyOf", ""), (3, "enum", "/c")]


def test_other_members_and_references(spark):
    assert found(spark, {"properties": {"a": True}, "additionalProperties": False}, {"a": 1}, {"a": 1, "b": 2, "c": 3}, [], {}) == [(1, "additionalProperties", "")]
    assert found(spark, {"properties": {"a": True, "no": False}, "additionalProperties": {"type": "integer", "minimum": 1}}, {"a": "s", "b": 0, "c": "x", "d": 1}, {"no": 1}) == [(0, "minimum", "/b"), (0, "type", "/c"), (1, "false", "/no")]
    nested = {"$defs": {"p": {"required": ["id"]}}, "properties": {"l": {"items": {"$ref": "#/$defs/p"}}, "p": {"$ref": "#/$defs/p"}}}
    assert found(spark, nested, {"l": [{"id": 1}, {}], "p": {}}) == [(0, "required", "/l/1/id"), (0, "required", "/p/id")]
    for bad in ({"$defs": {"p": {"properties": {"q": {"$ref": "#/$defs/p"}}}}, "$ref": "#/$defs/p"}, {"$ref": "other.json"}):
        with pytest.raises(ValueError):
            problems(bad, F.parse_json(F.lit("{}")))


def test_contained_members(spark):
    schema = {"contains": {"const": "/payload"}, "minItems": 1}
    assert found(spark, schema, ["/payload"], ["x"], [], "s") == [(1, "contains", ""), (2, "contains", ""), (2, "minItems", "")]


def test_manifests_and_envelopes(spark, tmp_path):
    (tmp_path / "s").mkdir()
    named = {"manifest": {"required": ["metadata", "owner"]}, "record-envelope": {"properties": {"trust": {"enum": ["high"]}}}, "log": {"properties": {"x": {"type": "integer"}}}, "template": {}}
    for name, schema in named.items():
        (tmp_path / f"s/{name}.schema.json").write_text(json.dumps(schema))
    (tmp_path / "s/variant-registry.json").write_text(json.dumps({"variants": [{"artifact_name": "visit", "record_type": "log", "discriminator_field": "/payload/kind", "discriminator_value": "v"}]}))
    schemas = read_schemas(str(tmp_path / "s"))
    assert record_types(schemas) == ["log"] and read_variants(str(tmp_path / "s"))["visit"]["record_type"] == "log" and read_variants(str(tmp_path)) == {}
    rows = [{"record_id": "r1", "record_type": "log", "payload": {"x": "s"}, "trust": "low"}, {"record_id": "r2", "record_type": "log", "payload": {"x": 1}, "trust": "high"}]
    bundle.write_bundle(str(tmp_path / "b/one"), {"metadata": {"package_id": "p"}}, {"log": rows})
    codes = [(r.code, r.path) for r in validate(spark, str(tmp_path / "b"), [], "2025-01-01T00:00:00Z", schemas=schemas).findings.orderBy("code", "path").collect()]
    assert codes == [("EV-002", "/owner"), ("EV-004", "r1/payload/x"), ("EV-004", "r1/trust")]


@pytest.mark.skipif(not SCHEMAS, reason="no folder of published schemas")
def test_published_schemas_are_one_automaton():
    automaton = compiled(read_schemas(SCHEMAS))
    assert len(automaton.roots) == 20 and len(automaton.rows) > 500 and automaton.levels < 12 and automaton.inner == 2
