"""JSON Schemas as rows and back, tenants' own types, and types that a tenant changes."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from paperloom.operators import schemas
from paperloom.plans import specs

SCHEMA = {"type": "object", "required": ["b", "a"], "properties": {"a": {"oneOf": [{"type": "string", "maxLength": 3}]}, "b": {"type": "array", "description": "some \"b\"", "items": {"properties": {"c": {"type": "string", "x-field": {"label": "Cee"}}, "default": {"type": ["null", "integer"], "default": 1}}}}, "e": {}, "n": {"type": "object", "properties": {}}}, "enum": [{"title": "kept"}], "items": [{"type": "null"}, {"title": "x"}]}


def made(spark, schema, **how):
    df = spark.createDataFrame([(1, json.dumps(schema))], "schema_id int, json string")
    words = schemas.keywords(df)
    return json.loads(schemas.assembled(schemas.for_provider(words, **how)).first().json)


def test_a_schema_goes_through_unchanged(spark):
    df = spark.createDataFrame([(1, json.dumps(SCHEMA)), (2, "{}")], "schema_id int, json string")
    assert {r.schema_id: json.loads(r.json) for r in schemas.assembled(schemas.keywords(df)).collect()} == {1: SCHEMA, 2: {}}


@pytest.mark.parametrize("strict", [False, True])
def test_what_a_provider_takes(spark, strict):
    out = made(spark, SCHEMA, strict=strict)
    assert out["properties"]["a"] == {"oneOf": [{"type": "string"}]} and out["properties"]["b"]["items"]["additionalProperties"] is False
    assert out["properties"]["b"]["items"]["properties"] == {"c": {"type": "string", "description": "Cee"}, "default": {"type": ["null", "integer"]}}
    assert out["required"] == (["a", "b", "e", "n"] if strict else ["b", "a"]) and out["enum"] == [{"title": "kept"}] and out["items"] == [{"type": "null"}, {}]
    assert out["additionalProperties"] is False and out["properties"]["n"]["additionalProperties"] is False


def test_nulls_where_they_are_not_yet_allowed(spark):
    properties = {"a": {"type": "string"}, "b": {"type": ["string", "null"]}, "c": {"anyOf": [{"type": "string"}, {"$ref": "#/x"}]}, "d": {"anyOf": [{"type": "null"}]}, "e": {"$ref": "#/x", "description": "see x"}, "f": {"const": 1}}
    out = made(spark, {"properties": properties}, nullable=True)["properties"]
    assert out["a"] == {"type": ["string", "null"]} and out["b"] == properties["b"] and out["d"] == properties["d"] and out["f"] == {"const": 1}
    assert out["c"] == {"anyOf": [*properties["c"]["anyOf"], {"type": "null"}]}
    assert out["e"] == {"anyOf": [{"$ref": "#/x"}, {"type": "null"}], "description": "see x"}
    assert made(spark, {"properties": out}, nullable=True)["properties"] == out


def test_notes(spark):
    cases = {"a": ({"description": "d", "x-field": {"hint": "h"}}, "d — h"), "b": ({"description": "d", "x-field": {"hint": "d"}}, "d"), "c": ({"title": "T", "x-field": {"label": "t"}}, None), "d": ({"x-field": {"label": "L"}}, "L"), "e": ({"description": "d"}, "d"), "f": ({"x-field": {"hint": "é \"q\""}}, "é \"q\"")}
    out = made(spark, {"properties": {k: v for k, (v, _) in cases.items()}})["properties"]
    assert {k: v.get("description") for k, v in out.items()} == {k: w for k, (_, w) in cases.items()}


def test_outline(spark):
    df = spark.createDataFrame([(1, json.dumps(SCHEMA))], "schema_id int, json string")
    rows = {r.path: (r.kind, r.required, r.description) for r in schemas.outline(schemas.keywords(df)).collect()}
    assert rows == {"a": ("any", True, None), "b": ("array", True, 'some "b"'), "b[].c": ("string", False, None), "b[].default": ("integer", False, None), "e": ("any", False, None), "n": ("object", False, None)}


def test_schemas_that_nest_too_deep_are_refused(spark, monkeypatch):
    monkeypatch.setattr(schemas, "DEEPEST", 2)
    with pytest.raises(ValueError, match="deeper"):
        schemas.keywords(spark.createDataFrame([(1, json.dumps(SCHEMA))], "schema_id int, json string"))


def test_own_types(spark):
    rows = [("good", 1, "subject", "string", True, False), ("good", 2, "flag", "boolean", False, True), ("name", 1, "X", "string", False, False), ("kind", 1, "a", "blob", False, False), ("twice", 1, "a", "text", False, False), ("twice", 2, "a", "text", False, False), (None, 1, "a", "text", None, None), ("none", 1, None, "text", True, True)]
    rows += [("many", i, f"f{i}", "text", False, False) for i in range(specs.OWN_FIELDS + 1)]
    got = schemas.own_types(spark.createDataFrame(rows, "tenant string, place int, name string, kind string, required boolean, critical boolean")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("good", "subject", "string", "R", None), ("good", "flag", "boolean", "CN", None), (None, "a", "text", "", None), *((t, None, None, None, e) for t, e in (("name", "bad field"), ("kind", "bad field"), ("twice", "repeated field"), ("none", "bad field"), ("many", "too many fields")))], key=str)
    typed = specs.typed([("subject", "string", True, False, True), ("a.b", "text", False, False, True), ("l[].c", "date", False, False, True)])
    assert specs.schema_of(typed).simpleString() == "struct<subject:string,a:struct<b:string>,l:array<struct<c:string>>>"


def test_overlays(spark):
    field = f"map<string,{schemas.FIELD}>"
    rows = [(1, "generic", None, None), (2, "unknown", None, None), (3, "unknown", {"x": (None, None, True, None)}, None), (4, "generic", {"title": (None, True, None, None)}, ["currency", "nothing"]), (5, None, None, None)]
    df = spark.createDataFrame(rows, f"id int, wanted string, overlay {field}, hidden array<string>")
    got = {r.id: r.r for r in df.select("id", schemas.resolved(F.col("wanted"), F.col("overlay"), F.col("hidden")).alias("r")).collect()}
    plain = {f.path: (f.kind, f.required, f.critical, f.groundable) for f in specs.typed(specs.FIELDS["generic"])}
    assert {p: tuple(v) for p, v in got[1].fields.items()} == plain and got[2].document_type == got[5].document_type == "generic" and len(got[2].fields) == len(plain)
    assert got[3].document_type == "unknown" and {p: tuple(v) for p, v in got[3].fields.items()} == {"x": ("string", False, True, True)}
    assert {p: tuple(v) for p, v in got[4].fields.items()} == {p: v for p, v in plain.items() if p != "currency"} | {"title": ("string", True, False, True)}
