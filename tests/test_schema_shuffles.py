"""Schemas are dealt over all cores, and each of them meets its parts in one shuffle."""

from __future__ import annotations

import json

from paperloom.operators import schemas


def test_one_aggregate_and_no_join(spark):
    rows = [(i, json.dumps({"properties": {"a": {"type": "string"}, "k": {"anyOf": [{"const": i}]}}})) for i in range(40)]
    words = schemas.keywords(spark.createDataFrame(rows, "schema_id int, json string").coalesce(1))
    plan = schemas.for_provider(words, strict=True, nullable=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate ") == 1 and "Join " not in plan
    files = {f.rsplit("/", 1)[-1].split("-")[1] for f in words.inputFiles() if "keywords-0-" in f}
    assert len(files) > 1  # one task had all schemas of one file
    out = {r.schema_id: json.loads(r.json)["properties"] for r in schemas.assembled(schemas.for_provider(words, strict=True, nullable=True)).collect()}
    assert out == {i: {"a": {"type": ["string", "null"]}, "k": {"anyOf": [{"const": i}, {"type": "null"}]}} for i in range(40)}
