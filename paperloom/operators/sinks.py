"""Where results go: exports, the usage ledger, the tables of processed documents, audit, reports and metrics."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.sources import storage

#: Rows of an export and of an audit page at most.
MAX_EXPORT, AUDIT_PAGE = 5000, 100


def export_page(extractions: DataFrame, organization: str, key: str | None = None, since: Column | None = None, limit: int = MAX_EXPORT) -> DataFrame:
    """Current extractions of an organization, newest first."""
    rows = extractions.where((F.col("organization_id") == organization) & F.col("is_current"))
    if key is not None:
        rows = rows.where(F.col("document_type_key") == key)
    if since is not None:
        rows = rows.where(F.col("created_at") >= since)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(min(limit, MAX_EXPORT))


def header_union(parts: list[DataFrame]) -> DataFrame:
    """All rows under the union of the headers, in the order in which columns are first seen."""
    header = dict.fromkeys(c for p in parts for c in p.columns)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select(*(F.col(f"`{c}`") for c in header))


def write_export(rows: DataFrame, path: str, kind: str) -> DataFrame:
    """rows as CSV with a header, or as JSON lines, in one file (an export is MAX_EXPORT rows at most); read back as text columns."""
    reader, one = rows.sparkSession.read, rows.limit(MAX_EXPORT).coalesce(1).write
    if kind == "csv":
        one.option("header", True).option("emptyValue", "").csv(path)
        return reader.option("header", True).csv(path)
    one.option("ignoreNullFields", False).json(path)
    return reader.option("primitivesAsString", True).json(path)


class Ledger:
    """A table that is only appended to: a batch counts once its marker stands, and once whatever is retried."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def append(self, rows: DataFrame, batch: str) -> bool:
        """False if the batch is there already."""
        if f"{batch}.ok" in storage.names(self.spark, f"{self.path}/batches"):
            return False
        name = f"{batch}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        storage.put_bytes(self.spark, f"{self.path}/batches/{batch}.ok", name.encode())
        return True

    def rows(self) -> DataFrame | None:
        marks = [n for n in storage.names(self.spark, f"{self.path}/batches") if n.endswith(".ok")]
        parts = [storage.get_bytes(self.spark, f"{self.path}/batches/{m}").decode() for m in marks]
        return self.spark.read.parquet(*(f"{self.path}/{p}" for p in parts)) if parts else None


def append_usage(runs: DataFrame, path: str, batch: str) -> DataFrame:
    """runs (organization_id, document_id, kind, calls, input_tokens, output_tokens, cost_usd, latency_ms, finished_at): one row
    for each run that called a model, also if it failed."""
    used = runs.where("calls > 0").select("organization_id", "document_id", "kind", "input_tokens", "output_tokens", "cost_usd", "latency_ms", F.date_format("finished_at", "yyyy-MM").alias("billing_period"), F.col("finished_at").alias("created_at"))
    ledger = Ledger(runs.sparkSession, path)
    ledger.append(used, batch)
    return ledger.rows()


#: Table -> its rows from a processed document.
TABLES = {
    "steps": lambda r: r.select("document_id", F.posexplode("steps").alias("sequence", "s")).select("document_id", "sequence", "s.*"),
    "extractions": lambda r: r.drop("steps", "fields", "issues"),
    "fields": lambda r: r.select("document_id", F.inline("fields")),
    "issues": lambda r: r.select("document_id", F.inline("issues")),
}


def persist(results: DataFrame, path: str, batch: str) -> bool:
    """results (document_id, ..., steps, fields, issues as arrays of structs): four tables that appear together, null leaves included."""
    spark = results.sparkSession
    if f"{batch}.ok" in storage.names(spark, f"{path}/batches"):
        return False
    at = f"{batch}-{uuid.uuid4().hex}"
    once = storage.written(results, "results")
    for name, rows in TABLES.items():
        rows(once).write.parquet(f"{path}/{at}/{name}")
    storage.put_bytes(spark, f"{path}/batches/{batch}.ok", at.encode())
    return True


def persisted(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of all batches that are whole."""
    parts = [storage.get_bytes(spark, f"{path}/batches/{n}").decode() for n in storage.names(spark, f"{path}/batches") if n.endswith(".ok")]
    return spark.read.parquet(*(f"{path}/{p}/{name}" for p in parts))


def recent_audit(entries: DataFrame, organization: str, limit: int = AUDIT_PAGE) -> DataFrame:
    """The newest entries (actor, action, resource, meta) of an organization."""
    return entries.where(F.col("organization_id") == organization).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def histogram(rows: DataFrame, labels: list[str], value: str, edges: list[float]) -> DataFrame:
    """(labels, le, cumulative, total, sum): counts at or under each edge, one pass over the rows."""
    counts = rows.groupBy(*labels).agg(*(F.count_if(F.col(value) <= e).alias(f"__{i}") for i, e in enumerate(edges)), F.count(value).alias("total"), F.sum(value).alias("sum"))
    return counts.select(*labels, "total", "sum", F.inline(F.array(*(F.struct(F.lit(e).alias("le"), F.col(f"__{i}").alias("cumulative")) for i, e in enumerate(edges)))))


def exposition(counts: DataFrame, name: str, labels: list[str]) -> DataFrame:
    """The lines of a scrape for a histogram: buckets, the open one, sum and count."""
    label = lambda c: F.concat(F.lit(f'{c}="'), F.col(c).cast("string"), F.lit('"'))
    own = F.concat_ws(",", *(label(c) for c in labels))
    bucket = counts.select(F.concat(F.lit(f"{name}_bucket{{"), own, F.lit(',le="'), F.col("le").cast("string"), F.lit('"} '), F.col("cumulative").cast("string")).alias("line"))
    whole = counts.select(*labels, "total", "sum").distinct()
    line = lambda end, v: F.concat(F.lit(f"{name}{end}{{"), own, F.lit("} "), v.cast("string"))
    rest = whole.select(F.explode(F.array(F.concat(F.lit(f"{name}_bucket{{"), own, F.lit(',le="+Inf"} '), F.col("total").cast("string")), line("_sum", F.col("sum")), line("_count", F.col("total")))).alias("line"))
    return bucket.unionByName(rest)


#: Rows that a table of a report may have; it is read by people.
REPORT_ROWS = 1000


def _report_rows(name: str, df: DataFrame) -> list:
    """All rows of a report's table; one that is longer than a report can show is refused, never cut."""
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"table {name} has more than {REPORT_ROWS} rows: write it as an export")
    return rows


def report_json(parts: dict[str, DataFrame], head: dict[str, object]) -> str:
    """A report as JSON: single rows as objects, others as lists. Its tables are aggregates of tens of rows."""
    out = dict(head)
    for name, df in parts.items():
        rows = [r.asDict(recursive=True) for r in _report_rows(name, df)]
        out[name] = rows[0] if len(rows) == 1 else rows
    return json.dumps(out, default=str, sort_keys=True)


def report_markdown(parts: dict[str, DataFrame], title: str) -> str:
    lines = [f"# {title}"]
    for name, df in parts.items():
        lines += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in _report_rows(name, df)]
    return "\n".join(lines) + "\n"
