"""Evaluation reports: labels as the truth, a fixed rule over the texts as the extractor."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import evaluation as ev

from .golden import values_sql
from .registry import query, vector
from .relational import _t

FACT = """SELECT *, e IS NOT DISTINCT FROM a AS correct, e IS NOT NULL AS he, a IS NOT NULL AS ha FROM (
  SELECT d.doc_id, 'quality' AS path, CAST(quality AS VARCHAR) AS e, CASE WHEN d.doc_id % 17 = 0 THEN NULL WHEN n_chars >= 500 THEN '1' ELSE '0' END AS a, true AS is_required, false AS is_critical, (n_chars % 1000) / 999.0 AS confidence, lang, source FROM documents d LEFT JOIN labels l USING (doc_id)
  UNION ALL SELECT d.doc_id, 'toxic', CAST(toxic AS VARCHAR), CASE WHEN contains(text, 'idiot') THEN '1' ELSE '0' END, false, true, CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE (n_chars % 500) / 499.0 END, lang, source FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE e IS NOT NULL OR a IS NOT NULL"""
RUNS = "SELECT doc_id, doc_id % 50 = 0 AS failed, doc_id % 4 = 0 AS needs_review, doc_id % 6 = 0 AS invalid, lang = 'en' AS type_correct, n_chars % 700 AS latency_ms FROM documents"
RATE = "round(count(*) FILTER ({0}) / nullif(count(*) FILTER ({1}), 0), 4)"


def fact(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = _t(spark, d, "documents"), _t(spark, d, "labels")
    truth = labels.select("doc_id", F.explode(F.array(*(F.struct(F.lit(c).alias("path"), F.col(c).cast("string").alias("value")) for c in ("quality", "toxic")))).alias("s")).select("doc_id", "s.*")
    quality = F.when(F.col("doc_id") % 17 == 0, F.lit(None).cast("string")).when(F.col("n_chars") >= 500, "1").otherwise("0")
    toxic = F.when(F.contains("text", F.lit("idiot")), "1").otherwise("0")
    found = F.array(
        F.struct(F.lit("quality").alias("path"), quality.alias("value"), ((F.col("n_chars") % 1000) / F.lit(999.0)).alias("confidence")),
        F.struct(F.lit("toxic").alias("path"), toxic.alias("value"), F.when(F.col("doc_id") % 3 != 0, (F.col("n_chars") % 500) / F.lit(499.0)).alias("confidence")),
    )
    actual = docs.select("doc_id", F.explode(found).alias("s")).select("doc_id", "s.*").where("value is not null or path = 'quality'")
    spec = spark.createDataFrame([("quality", "identifier", True, False), ("toxic", "identifier", False, True)], "path string, kind string, is_required boolean, is_critical boolean")
    out = ev.outcomes(truth, actual, spec).where("has_expected or has_actual")
    return out.join(docs.select("doc_id", F.col("lang").alias("document_type"), F.when(F.col("doc_id") % 2 == 0, F.array("source")).otherwise(F.array().cast("array<string>")).alias("tags")), "doc_id")


def runs(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return _t(spark, d, "documents").select("doc_id", (i % 50 == 0).alias("failed"), (i % 4 == 0).alias("needs_review"), (i % 6 == 0).alias("invalid"), (F.col("lang") == "en").alias("type_correct"), (F.col("n_chars") % 700).alias("latency_ms"))


def report(name: str, sql: str | None):  # noqa: ANN201
    """Register a report over the fact table."""

    def put(f):  # noqa: ANN001, ANN202
        @wraps(f)
        def run(spark: SparkSession, d: str) -> DataFrame:
            return f(fact(spark, d))

        query(name, sql)(run)
        return f

    return put


_PAIRS = [
    (None, " ", "string", "exact"), (None, "x", "string", "miss"), ("a", "a", "string", "exact"), ("1 234,50", "1234.50", "money", "normalised"), ("10.00", "10.01", "money", "normalised"), ("10.00", "10.02", "money", "miss"),
    ("2024-03-15", "15.03.2024", "date", "normalised"), ("CZK", "Kč", "currency", "normalised"), ("true", "True", "boolean", "normalised"), ("19-2000145399/0800", "192000145399/0800", "identifier", "normalised"), ("19-2000145399/0800", "19-2000145398/0800", "identifier", "miss"),
    ("ACME s.r.o.", "acme sro", "string", "normalised"), ("International Widgets Ltd", "International Widget Ltd", "string", "fuzzy"), ("alpha", "omega", "text", "miss"), ("abc", "1", "money", "miss"),
]


@vector("evl01_compare", values_sql(["n", "level"], [(i, p[3]) for i, p in enumerate(_PAIRS)], ["INTEGER", ""]))
def compare(spark, d):  # noqa: ANN001, ANN201
    rows = spark.createDataFrame([(i, *p[:3]) for i, p in enumerate(_PAIRS)], "n int, expected string, actual string, kind string")
    return ev.compare(rows).select("n", "level")


@report("evl02_outcomes", f"SELECT doc_id, path, e AS expected, a AS actual, CASE WHEN e IS NULL OR a IS NULL THEN 'miss' WHEN e = a THEN 'exact' ELSE 'miss' END AS level FROM ({FACT})")
def fact_rows(f: DataFrame) -> DataFrame:
    return f.select("doc_id", "path", "expected", "actual", "level")


@report("evl03_accuracy", f"SELECT {RATE.format('correct', 'true')} AS field_correct, {RATE.format('correct AND is_required', 'is_required')} AS required_correct, {RATE.format('correct AND is_critical', 'is_critical')} AS critical_correct FROM ({FACT})")
def accuracy(f: DataFrame) -> DataFrame:
    return ev.accuracy(f).select("field_correct", "required_correct", "critical_correct")


@report("evl04_document_success", f"SELECT doc_id, coalesce(bool_and(correct) FILTER (is_required), false) AS success FROM ({FACT}) GROUP BY doc_id")
def success(f: DataFrame) -> DataFrame:
    return ev.document_success(f)


@query("evl05_07_operational", f"SELECT {RATE.format('failed', 'true')} AS failure_rate, {RATE.format('needs_review AND NOT failed', 'NOT failed')} AS review_rate, {RATE.format('invalid AND NOT failed', 'NOT failed')} AS validation_failure_rate, {RATE.format('type_correct AND NOT failed', 'NOT failed')} AS classification_accuracy FROM ({RUNS})")
def operational(spark, d):  # noqa: ANN001, ANN201
    return ev.operational(runs(spark, d))


@report("evl06_precision_recall", f"""WITH c AS (SELECT count(*) FILTER (he AND ha AND correct) AS tp, count(*) FILTER (ha AND (NOT he OR NOT correct)) AS fp, count(*) FILTER (he AND (NOT ha OR NOT correct)) AS fn FROM ({FACT})), p AS (SELECT *, round(tp / (tp + fp), 4) AS p, round(tp / (tp + fn), 4) AS r FROM c)
SELECT tp AS true_positive, fp AS false_positive, fn AS false_negative, p AS precision, r AS recall, 2 * p * r / (p + r) AS f1 FROM p""")
def precision_recall(f: DataFrame) -> DataFrame:
    return ev.precision_recall(f)


@query("evl08_latency", f"WITH s AS (SELECT list_sort(list(latency_ms)) AS v, count(*) AS n, avg(latency_ms) AS mean FROM ({RUNS})) SELECT mean, v[CAST(round_even(0.5 * (n - 1), 0) AS BIGINT) + 1] AS p50, v[CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1] AS p95, v[CAST(round_even(0.99 * (n - 1), 0) AS BIGINT) + 1] AS p99, v[n] AS max FROM s")
def latency(spark, d):  # noqa: ANN001, ANN201
    return ev.latency(runs(spark, d))


@query("evl25_load_percentiles", f"WITH s AS (SELECT list_sort(list(latency_ms)) AS v, count(*) AS n, avg(latency_ms) AS mean FROM ({RUNS})) SELECT mean, v[least(n - 1, n * 50 // 100) + 1] AS p50, v[least(n - 1, n * 95 // 100) + 1] AS p95, v[least(n - 1, n * 99 // 100) + 1] AS p99, v[n] AS max FROM s")
def load_percentiles(spark, d):  # noqa: ANN001, ANN201
    return ev.load_percentiles(runs(spark, d))


@query("evl09_costs", "SELECT event_type, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DECIMAL(28,6)) AS total, count(DISTINCT user_id) AS documents FROM events GROUP BY 1")
def costs(spark, d):  # noqa: ANN001, ANN201
    return _t(spark, d, "events").groupBy("event_type").agg(F.sum(F.col("value").cast("decimal(18,6)")).cast("decimal(28,6)").alias("total"), F.countDistinct("user_id").alias("documents"))


@report("evl10_calibration", f"SELECT CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS band, count(*) AS fields, round(avg(correct::INT), 6) AS accuracy, round(avg(confidence), 6) AS mean_confidence FROM ({FACT}) WHERE confidence IS NOT NULL GROUP BY 1")
def calibration(f: DataFrame) -> DataFrame:
    return ev.calibration(f)


@report("evl11_worst_fields", f"SELECT path, count(*) AS errors FROM ({FACT}) WHERE NOT correct GROUP BY path ORDER BY errors DESC, path LIMIT 12")
def worst(f: DataFrame) -> DataFrame:
    return ev.worst_fields(f)


@report("evl12_field_table", f'SELECT path, count(*) AS total, count(*) FILTER (correct) AS "right", count(*) FILTER (he AND NOT ha) AS missing, count(*) FILTER (ha AND NOT he) AS spurious, {RATE.format("correct", "true")} AS accuracy FROM ({FACT}) GROUP BY path')
def field_table(f: DataFrame) -> DataFrame:
    return ev.field_table(f)


@report("evl13_by_type", f"SELECT lang AS document_type, count(DISTINCT doc_id) AS documents, {RATE.format('correct', 'true')} AS field_accuracy FROM ({FACT}) GROUP BY 1")
def by_type(f: DataFrame) -> DataFrame:
    return ev.by_type(f)


@report("evl14_by_difficulty", f"SELECT CASE WHEN doc_id % 2 = 0 THEN source ELSE '(none)' END AS tag, count(*) AS fields, {RATE.format('correct', 'true')} AS accuracy FROM ({FACT}) GROUP BY 1")
def by_difficulty(f: DataFrame) -> DataFrame:
    return ev.by_difficulty(f)


@report("evl15_predictions", f"SELECT doc_id, path, a AS actual FROM ({FACT}) WHERE he")
def predictions(f: DataFrame) -> DataFrame:
    return f.where("has_expected").select("doc_id", "path", "actual")


@report("evl16_wilson", f"WITH c AS (SELECT lang, count(*) AS n, count(*) FILTER (correct) / count(*) AS p, 3.8414588206941254 AS k FROM ({FACT}) GROUP BY 1) SELECT lang, round(greatest(0, (p + k / (2 * n) - sqrt(k) * sqrt(p * (1 - p) / n + k / (4 * n * n))) / (1 + k / n)), 6) AS low, round(least(1, (p + k / (2 * n) + sqrt(k) * sqrt(p * (1 - p) / n + k / (4 * n * n))) / (1 + k / n)), 6) AS high FROM c")
def wilson(f: DataFrame) -> DataFrame:
    from paperloom.functions.numbers import wilson as interval

    rows = f.groupBy(F.col("document_type").alias("lang")).agg(interval(F.count_if("correct"), F.count("*")).alias("w"))
    return rows.select("lang", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


@report("evl17_report_delta", f"SELECT path AS metric, round({RATE.format('correct AND doc_id % 2 = 1', 'doc_id % 2 = 1')} - {RATE.format('correct AND doc_id % 2 = 0', 'doc_id % 2 = 0')}, 4) AS delta FROM ({FACT}) GROUP BY 1")
def report_delta(f: DataFrame) -> DataFrame:
    half = lambda k: ev.field_table(f.where(F.col("doc_id") % 2 == k)).select(F.col("path").alias("metric"), F.col("accuracy").alias("value"))
    return ev.report_delta(half(0), half(1))


@report("evl18_deciles", f"SELECT CAST(least(9, floor(confidence * 10)) AS INTEGER) AS bucket, count(*) AS n, round(avg(correct::INT), 6) AS accuracy FROM ({FACT}) WHERE confidence IS NOT NULL GROUP BY 1")
def deciles(f: DataFrame) -> DataFrame:
    return ev.deciles(f).select("bucket", "n", F.round("accuracy", 6).alias("accuracy"))


@report("evl19_coarse", f"SELECT bucket, low, count(f.doc_id) AS n, round(avg(correct::INT), 4) AS accuracy FROM (VALUES (0, 0.0::DOUBLE, 0.5), (1, 0.5::DOUBLE, 0.6), (2, 0.6::DOUBLE, 0.7), (3, 0.7::DOUBLE, 0.8), (4, 0.8::DOUBLE, 0.9), (5, 0.9::DOUBLE, 2)) b(bucket, low, high) LEFT JOIN ({FACT}) f ON confidence >= low AND confidence < high GROUP BY 1, 2")
def coarse(f: DataFrame) -> DataFrame:
    return ev.coarse(f)


@report("evl20_ece", f"SELECT round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece FROM (SELECT count(*) AS n, avg(correct::INT) AS acc, avg(confidence) AS conf FROM ({FACT}) WHERE confidence IS NOT NULL GROUP BY least(9, floor(confidence * 10)))")
def ece(f: DataFrame) -> DataFrame:
    return ev.calibration_error(f)


@report("evl21_drops", f"SELECT bucket, round(before - accuracy, 6) AS drop FROM (SELECT bucket, accuracy, lag(accuracy) OVER (ORDER BY bucket) AS before FROM (SELECT CAST(least(9, floor(confidence * 10)) AS INTEGER) AS bucket, avg(correct::INT) AS accuracy FROM ({FACT}) WHERE confidence IS NOT NULL GROUP BY 1)) WHERE before - accuracy > 0.01")
def drops(f: DataFrame) -> DataFrame:
    return ev.drops(f, 0.01)


@vector("evl22_gates", "SELECT * FROM (VALUES ('a', 'm1', 'compared', ['required', 'success']), ('a', 'm2', 'compared', []::VARCHAR[]), ('b', 'm3', 'new run, no baseline', []::VARCHAR[]), ('c', 'm4', 'missing in after', []::VARCHAR[]), ('d', 'm5', 'compared', ['critical', 'review'])) t(provider, model, status, violations)")
def gates(spark, d):  # noqa: ANN001, ANN201
    schema = "provider string, model string, required double, critical double, success double, review double"
    before = spark.createDataFrame([("a", "m1", 1.0, 0.8, 0.9, 0.2), ("a", "m2", 0.9, 0.8, 0.9, 0.2), ("c", "m4", 1.0, 1.0, 1.0, 0.0), ("d", "m5", 0.9, 0.9, 0.5, 0.1)], schema)
    after = spark.createDataFrame([("a", "m1", 0.95, 0.8, 0.89, 0.2), ("a", "m2", 0.88, 0.79, 0.95, 0.3), ("b", "m3", 1.0, 1.0, 1.0, 0.0), ("d", "m5", 0.9, 0.8, 0.5, 0.3)], schema)
    return ev.gates(before, after)


@query("evl27_type_counts", "SELECT lang, count(*) AS n FROM (SELECT lang FROM documents ORDER BY doc_id LIMIT 120) GROUP BY 1")
def type_counts(spark, d):  # noqa: ANN001, ANN201
    return _t(spark, d, "documents").orderBy("doc_id").limit(120).groupBy("lang").agg(F.count("*").alias("n"))
