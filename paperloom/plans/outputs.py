"""Queries over readers, storage and sinks: files and objects written to the shared folder and read back, exports,
ledgers, persisted tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import confidence, evaluation, extract, paths, sinks
from paperloom.sources import corpus, storage

from .golden import values_sql
from .registry import query
from .relational import DOCS, _t, docs

# ---- storage ----


@query("src14_object_keys", "SELECT id, 'org/' || organization_id || '/' || strftime(created_at, '%Y/%m') || '/' || id || '/original.txt' AS key FROM (" + DOCS + ")")
def object_keys(spark, d):  # noqa: ANN001, ANN201
    return docs(spark, d).select("id", storage.object_key(F.col("organization_id"), F.col("id"), F.col("created_at"), "original", "txt").alias("key"))


@query("src14_object_table", "SELECT 'k' || doc_id AS key, CASE WHEN doc_id % 3 = 0 THEN sha256('again' || text) ELSE sha256(text) END AS checksum_sha256 FROM documents WHERE doc_id % 4 <> 0")
def object_table(spark, d):  # noqa: ANN001, ANN201
    """Objects put, some put again, some deleted; what get finds."""
    rows = _t(spark, d, "documents").select("doc_id", F.concat(F.lit("k"), "doc_id").alias("key"), F.col("text").cast("binary").alias("content"), F.lit("text/plain").alias("content_type"))
    store = storage.ObjectTable(spark, storage.scratch(spark, "objects"))
    store.put(rows)
    store.put(rows.where("doc_id % 3 = 0").withColumn("content", F.concat(F.lit("again"), F.col("content").cast("string")).cast("binary")))
    store.delete(rows.where("doc_id % 4 = 0"))
    return store.get().select("key", "checksum_sha256")


@query("src15_jsonl", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def jsonl(spark, d):  # noqa: ANN001, ANN201
    rows, at = _t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), storage.scratch(spark, "jsonl")
    corpus.write_jsonl(rows, at)
    return corpus.read_jsonl(spark, at, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string")


# ---- sinks ----

_PAGE = f"SELECT CAST(id AS VARCHAR) AS id, document_type_key, CAST(size_bytes AS VARCHAR) AS size_bytes FROM (SELECT * FROM ({DOCS}) WHERE organization_id = (SELECT min(source) FROM documents) ORDER BY created_at DESC, id DESC LIMIT 25)"


def _page(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).withColumn("is_current", F.lit(True))
    first = rows.agg(F.min("organization_id")).first()[0]
    return sinks.export_page(rows, first, limit=25).select("id", "document_type_key", "size_bytes")


@query("snk01_export_csv", _PAGE)
def export_csv(spark, d):  # noqa: ANN001, ANN201
    return sinks.write_export(_page(spark, d), storage.scratch(spark, "export"), "csv")


@query("snk01_export_json", _PAGE)
def export_json(spark, d):  # noqa: ANN001, ANN201
    return sinks.write_export(_page(spark, d), storage.scratch(spark, "export"), "json").select("id", "document_type_key", "size_bytes")


@query("snk04_usage_ledger", "SELECT event_type AS kind, strftime(ts, '%Y-%m') AS billing_period, count(*) AS n, CAST(sum(event_id % 1000) AS BIGINT) AS tokens FROM events WHERE event_id % 3 > 0 GROUP BY 1, 2")
def usage_ledger(spark, d):  # noqa: ANN001, ANN201
    """Two batches, one of them sent twice."""
    e = _t(spark, d, "events")
    runs = e.select((F.col("user_id") % 7).alias("organization_id"), F.col("user_id").alias("document_id"), F.col("event_type").alias("kind"), (F.col("event_id") % 3).alias("calls"), (F.col("event_id") % 1000).alias("input_tokens"), F.lit(0).alias("output_tokens"), F.col("value").alias("cost_usd"), F.lit(1).alias("latency_ms"), F.col("ts").alias("finished_at"), "event_id")
    at = storage.scratch(spark, "usage")
    for batch in (0, 1, 1):
        rows = sinks.append_usage(runs.where(F.col("event_id") % 2 == batch), at, f"b{batch}")
    return rows.groupBy("kind", "billing_period").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("tokens"))


@query("snk05_persisted_tables", """SELECT 'steps' AS name, 'clean' AS key, count(*) AS n FROM documents UNION ALL SELECT 'steps', 'extract', count(*) FROM documents UNION ALL SELECT 'extractions', lang, count(*) FROM documents GROUP BY lang
  UNION ALL SELECT 'fields', 'source', count(*) FROM documents UNION ALL SELECT 'fields', 'note', count(*) FROM documents UNION ALL SELECT 'issues', 'short', count(*) FROM documents WHERE n_chars < 500 HAVING count(*) > 0""")
def persisted_tables(spark, d):  # noqa: ANN001, ANN201
    """Documents as processed results in two batches; rows of each table by step, type, path or code."""
    t, s = _t(spark, d, "documents"), lambda **kw: F.struct(*(F.lit(v).alias(k) if not hasattr(v, "alias") else v.alias(k) for k, v in kw.items()))
    results = t.select(
        F.col("doc_id").alias("document_id"), F.col("lang").alias("document_type"), F.array(s(stage="clean", status="succeeded"), s(stage="extract", status="succeeded")).alias("steps"),
        F.array(s(path="source", value=F.col("source")), s(path="note", value=F.lit(None).cast("string"))).alias("fields"), F.filter(F.array(s(code="short", severity=F.when(F.col("n_chars") < 500, "warning"))), lambda x: x["severity"].isNotNull()).alias("issues"),
    )
    at = storage.scratch(spark, "persisted")
    for batch in (0, 1, 1):
        sinks.persist(results.where(F.col("document_id") % 2 == batch), at, f"b{batch}")
    key = {"steps": "stage", "extractions": "document_type", "fields": "path", "issues": "code"}
    parts = [sinks.persisted(spark, at, n).groupBy(F.lit(n).alias("name"), F.col(k).alias("key")).agg(F.count("*").alias("n")) for n, k in key.items()]
    return sinks.header_union(parts)


@query("snk06_audit", "SELECT event_id AS id, 'user' || user_id AS actor, event_type AS action FROM events WHERE user_id % 5 = 1 ORDER BY ts DESC, event_id DESC LIMIT 100")
def audit(spark, d):  # noqa: ANN001, ANN201
    rows = _t(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 5).cast("string").alias("organization_id"), F.concat(F.lit("user"), "user_id").alias("actor"), F.col("event_type").alias("action"), F.lit("document").alias("resource"), F.col("props").alias("meta"), F.col("ts").alias("created_at"))
    ledger = sinks.Ledger(spark, storage.scratch(spark, "audit"))
    for batch in (0, 1):
        ledger.append(rows.where(F.col("id") % 2 == batch), f"b{batch}")
    return sinks.recent_audit(ledger.rows(), "1").select("id", "actor", "action")


@query("snk07_report", "SELECT 'events' AS label, count(*) AS n, count(DISTINCT user_id) AS users, (SELECT count(DISTINCT event_type) FROM events) AS kinds FROM events")
def report(spark, d):  # noqa: ANN001, ANN201
    """A report written as JSON and Markdown, and read back."""
    e, at = _t(spark, d, "events"), storage.scratch(spark, "report")
    parts = {"totals": e.agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")), "kinds": e.groupBy("event_type").count().orderBy("event_type")}
    storage.put_bytes(spark, f"{at}/report.json", sinks.report_json(parts, {"label": "events"}).encode())
    storage.put_bytes(spark, f"{at}/report.md", sinks.report_markdown(parts, "Events").encode())
    return spark.read.json(f"{at}/report.json").select("label", "totals.n", "totals.users", F.size("kinds").cast("long").alias("kinds"))


@query("snk08_exposition", """WITH h AS (SELECT event_type AS t, count(*) AS n, CAST(sum(event_id % 700) AS BIGINT) AS s FROM events GROUP BY 1), b AS (SELECT event_type AS t, le, count(*) FILTER (event_id % 700 <= le) AS c FROM events, (VALUES (50), (250), (1000)) v(le) GROUP BY 1, 2)
  SELECT 'stage_ms_bucket{kind="' || t || '",le="' || le || '"} ' || c AS line FROM b UNION ALL SELECT 'stage_ms_bucket{kind="' || t || '",le="+Inf"} ' || n FROM h UNION ALL SELECT 'stage_ms_sum{kind="' || t || '"} ' || s FROM h UNION ALL SELECT 'stage_ms_count{kind="' || t || '"} ' || n FROM h""")
def exposition(spark, d):  # noqa: ANN001, ANN201
    rows = _t(spark, d, "events").select(F.col("event_type").alias("kind"), (F.col("event_id") % 700).alias("ms"))
    return sinks.exposition(sinks.histogram(rows, ["kind"], "ms", [50, 250, 1000]), "stage_ms", ["kind"])


# ---- schema tools and checks ----

@query("pth08_jsonable", "SELECT o_orderkey, '{\"total\":\"' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || '\",\"day\":\"' || strftime(o_orderdate, '%Y-%m-%d') || '\",\"tags\":[\"' || o_orderstatus || '\"]}' AS json FROM orders")
def jsonable(spark, d):  # noqa: ANN001, ANN201
    rows = _t(spark, d, "orders").select("o_orderkey", F.struct(F.col("o_totalprice").cast("decimal(18,2)").alias("total"), F.col("o_orderdate").cast("date").alias("day"), F.array("o_orderstatus").alias("tags")).alias("v"))
    return rows.select("o_orderkey", paths.to_plain_json(F.col("v"), rows.schema["v"].dataType).alias("json"))


@query("cls05_schema_note", "SELECT lang AS resolved, count(*) AS n, count(*) FILTER (lang = 'fr') AS noted FROM documents GROUP BY lang")
def schema_note(spark, d):  # noqa: ANN001, ANN201
    kind = F.when(F.col("lang") == "fr", "generic").otherwise("invoice")
    return _t(spark, d, "documents").groupBy(F.col("lang").alias("resolved")).agg(F.count("*").alias("n"), F.count(confidence.schema_note(kind)).alias("noted"))


@query("ext12_cross_check", """SELECT event_id AS doc_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.25 END AS agreement FROM events""")
def cross_check(spark, d):  # noqa: ANN001, ANN201
    """Model fields beside what the rules read; a model that is the rules is not checked against itself."""
    e = _t(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.lit("total").alias("path"), F.concat(F.lit("1 2"), F.col("event_id").cast("string"), F.lit(",50")).alias("value"))
    model = e.withColumn("model", F.when(F.col("doc_id") % 3 == 0, "fixture-heuristic").otherwise("m1"))
    base = e.where("doc_id % 5 <> 0").select("doc_id", "path", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("12"), F.col("doc_id").cast("string"), F.lit(".50"))).otherwise("7").alias("baseline"))
    return extract.cross_checked(model, base).select("doc_id", "agreement")
