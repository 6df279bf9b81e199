"""Queries over schemas: JSON Schemas made from parts, tenants' types declared by order lines, and types that customers change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import schemas

from . import specs
from .kernels import ways
from .registry import query
from .relational import _t


def part_schemas(spark: SparkSession, d: str) -> DataFrame:
    """(schema_id, json): a schema for each part, with keywords to drop, notes to fold, references and lists."""
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    name, size, key = F.col("p_name"), F.col("p_size").cast("string"), F.col("p_partkey")
    hint = F.when(key % 2 == 0, '"hint":"as printed",').otherwise("")
    about = F.when(key % 3 == 0, said('"description":"', name, '",')).otherwise("")
    kind = F.when(key % 5 == 0, ',{"type":"null"}').otherwise("")
    json = said(
        '{"title":"Part","type":"object","required":["name"],"properties":{"name":{"type":"string","title":"Name","minLength":3,', about, '"x-field":{', hint, '"label":"', F.when(key % 7 == 0, "name").otherwise("Label"), '"}},',
        '"size":{"type":"integer","format":"int32","default":', size, '},"day":{"type":["string","null"],"format":"date","pattern":"x"},"brand":{"$ref":"#/$defs/Brand","title":"B"},"title":{"type":"number","maximum":', size, "},",
        '"tags":{"type":"array","minItems":1,"items":{"type":"object","properties":{"v":{"type":"number","enum":[1,', size, ']}}}},"kind":{"anyOf":[{"const":"', F.col("p_type"), '"},{"type":"integer","maximum":5}', kind, "]}},",
        '"$defs":{"Brand":{"properties":{"id":{"type":"string","format":"uuid"}},"required":["id"]},"Any":{}}}',
    )
    return _t(spark, d, "part").select(key.alias("schema_id"), json.alias("json"))


_NOTE = "CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN p_name || ' — as printed' WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 2 = 0 THEN 'as printed' WHEN p_partkey % 7 <> 0 THEN 'Label' END"


@query("pth11_provider_schema", f"""SELECT p_partkey AS schema_id, '{{"$defs":{{"Any":{{}},"Brand":{{"additionalProperties":false,"properties":{{"id":{{"format":"uuid","type":["string","null"]}}}},"required":["id"]}}}},"additionalProperties":false,"properties":{{"brand":{{"anyOf":[{{"$ref":"#/$defs/Brand"}},{{"type":"null"}}]}},"day":{{"format":"date","type":["string","null"]}},"kind":{{"anyOf":[{{"const":"'
  || p_type || '"}},{{"type":"integer"}},{{"type":"null"}}]}},"name":{{' || coalesce('"description":"' || {_NOTE} || '",', '') || '"type":["string","null"]}},"size":{{"type":["integer","null"]}},"tags":{{"items":{{"additionalProperties":false,"properties":{{"v":{{"enum":[1,' || p_size || '],"type":["number","null"]}}}},"required":["v"],"type":"object"}},"type":["array","null"]}},"title":{{"type":["number","null"]}}}},"required":["brand","day","kind","name","size","tags","title"],"type":"object"}}' AS json FROM part""")
def provider_schema(spark, d):  # noqa: ANN001, ANN201
    """Schemas as a strict provider takes them, where every property may be null."""
    return schemas.assembled(schemas.for_provider(schemas.keywords(part_schemas(spark, d)), strict=True, nullable=True))


_KINDS = [*specs.OWN_KINDS, "blob"]


@query("pth12_own_type", f"""WITH f AS (SELECT l_orderkey AS tenant, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS place, l_partkey, CASE WHEN l_suppkey % 13 = 0 THEN 'Bad name' ELSE 'field_' || l_partkey % 29 END AS name, ({_KINDS})[CASE WHEN l_partkey % 61 = 0 THEN 9 ELSE l_partkey % 8 + 1 END] AS kind, l_returnflag = 'R' AS required, l_linestatus = 'F' AS critical FROM lineitem),
w AS (SELECT *, CASE WHEN name = 'Bad name' OR kind = 'blob' THEN 'bad field' WHEN place > min(place) OVER (PARTITION BY tenant, name) THEN 'repeated field' END AS wrong FROM f),
t AS (SELECT tenant, arg_min(wrong, place) FILTER (wrong IS NOT NULL) AS error FROM w GROUP BY 1)
SELECT tenant, name AS path, kind, CASE WHEN required THEN 'R' ELSE '' END || CASE WHEN critical THEN 'C' ELSE '' END || CASE WHEN kind = 'boolean' THEN 'N' ELSE '' END AS flags, NULL AS error FROM w JOIN t USING (tenant) WHERE error IS NULL
UNION ALL SELECT tenant, NULL, NULL, NULL, error FROM t WHERE error IS NOT NULL""")
def own_types(spark, d):  # noqa: ANN001, ANN201
    """A type for each order, a field for each of its lines: compiled, or refused with the first thing that is wrong."""
    place = F.expr("row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)")
    kind = F.array(*(F.lit(k) for k in _KINDS))[F.when(F.col("l_partkey") % 61 == 0, 8).otherwise(F.col("l_partkey") % 8).cast("int")]
    name = F.when(F.col("l_suppkey") % 13 == 0, "Bad name").otherwise(F.concat(F.lit("field_"), (F.col("l_partkey") % 29).cast("string")))
    return schemas.own_types(_t(spark, d, "lineitem").select(F.col("l_orderkey").alias("tenant"), place.alias("place"), name.alias("name"), kind.alias("kind"), (F.col("l_returnflag") == "R").alias("required"), (F.col("l_linestatus") == "F").alias("critical")))


_ROWS = ", ".join(f"('{k}', '{f.path}', '{f.kind}', {f.required}, {f.critical}, {f.groundable})" for k, rows in specs.FIELDS.items() for f in specs.typed(rows))
_WANTED = ["invoice", "receipt", "contract", "memo", "memo"]


@query("pth13_resolve_type", f"""WITH c AS (SELECT c_custkey AS k, ({_WANTED})[c_custkey % 5 + 1] AS wanted, c_custkey % 5 <> 4 AND c_custkey % 3 = 0 AS overlaid, c_custkey % 7 = 0 AS hides, c_mktsegment AS segment FROM customer),
b AS (SELECT c.*, CASE WHEN wanted = 'memo' AND NOT overlaid THEN 'generic' ELSE wanted END AS document_type FROM c), s AS (SELECT * FROM (VALUES {_ROWS}) AS v(t, path, kind, required, critical, groundable)),
f AS (SELECT k, document_type, overlaid, hides, path, kind, CASE WHEN overlaid AND path = 'currency' THEN false ELSE required END AS required, CASE WHEN overlaid AND path = 'currency' THEN true ELSE critical END AS critical, groundable FROM b JOIN s ON s.t = b.document_type
  UNION ALL SELECT k, document_type, overlaid, hides, 'own_' || lower(segment), 'number', true, false, true FROM b WHERE overlaid
  UNION ALL SELECT k, document_type, overlaid, hides, 'currency', 'string', false, true, true FROM b WHERE overlaid AND wanted = 'memo')
SELECT k AS c_custkey, document_type, path, kind, required, critical, groundable FROM f WHERE NOT (hides AND (path = 'supplier' OR starts_with(path, 'supplier.') OR starts_with(path, 'items[]')))""")
def resolve(spark, d):  # noqa: ANN001, ANN201
    """Types as customers see them: their own fields over the built-in ones, some hidden, unknown types as generic."""
    own = F.concat(F.lit("own_"), F.lower("c_mktsegment"))
    field = lambda kind, required, critical: F.struct(F.lit(kind).cast("string").alias("kind"), F.lit(required).cast("boolean").alias("required"), F.lit(critical).cast("boolean").alias("critical"), F.lit(None).cast("boolean").alias("groundable"))
    overlay = F.create_map(F.lit("currency"), field(None, False, True), own, field("number", True, None))
    k = F.col("c_custkey")
    rows = _t(spark, d, "customer").select("c_custkey", ways("c_custkey", *_WANTED).alias("wanted"), F.when((k % 5 != 4) & (k % 3 == 0), overlay).alias("overlay"), F.when(k % 7 == 0, F.array(F.lit("supplier"), F.lit("items"))).alias("hidden"))
    seen = rows.select("c_custkey", schemas.resolved(F.col("wanted"), F.col("overlay"), F.col("hidden")).alias("r"))
    return seen.select("c_custkey", "r.document_type", F.explode("r.fields").alias("path", "f")).select("c_custkey", "document_type", "path", "f.kind", "f.required", "f.critical", "f.groundable")
