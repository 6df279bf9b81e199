"""Grading of extracted fields against the truth, and every report over the graded rows.

The fact table has a row for each (document, field path) that either side has: expected, actual, kind,
level, flags, confidence. All reports are aggregates of it.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import numbers, text
from paperloom.sources import storage

FUZZY, MONEY_TOLERANCE = 0.90, "0.01"
LEVELS = ["exact", "normalised", "fuzzy", "miss"]
#: Gates in points, coarse bucket edges.
GATES = {"required": 3.0, "critical": 3.0, "success": 0.0, "review": 10.0}
COARSE_EDGES = [0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]


@F.pandas_udf(T.DoubleType())
def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; no built-in computes it."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in zip(left, right, strict=True)])


def compare(rows: DataFrame) -> DataFrame:
    """rows (expected, actual, kind) with the match level of the two values.

    Keys are columns of their own, so each is computed once, and only where the values differ; the similarity is
    computed only for texts that fail all else.
    """
    differ = F.col("expected") != F.col("actual")
    truth = lambda c: F.lower(c).isin("true", "1", "yes")
    by_kind = lambda c, k, v: F.when(differ & F.col("kind").isin(*k), v(F.col(c)))
    keys = {}
    for side in ("expected", "actual"):
        keys |= {
            f"__{side}_blank": numbers.is_blank(F.col(side)), f"__{side}_key": F.when(differ, text.match_key(F.col(side))), f"__{side}_number": by_kind(side, ("money", "number"), numbers.parse_decimal),
            f"__{side}_date": by_kind(side, ("date",), lambda c: numbers.parse_date(c)["value"]), f"__{side}_currency": by_kind(side, ("currency",), numbers.currency), f"__{side}_truth": truth(F.col(side)),
        }
    rows = rows.withColumns(keys)
    e, a, kind = (lambda n: F.col(f"__expected_{n}")), (lambda n: F.col(f"__actual_{n}")), F.col("kind")
    same = (
        F.when(kind.isin("money", "number"), F.abs(e("number") - a("number")) <= F.lit(MONEY_TOLERANCE).cast("decimal(4,2)"))
        .when(kind == "date", e("date") == a("date")).when(kind == "currency", e("currency").eqNullSafe(a("currency"))).when(kind == "boolean", e("truth") == a("truth"))
        .otherwise(e("key") == a("key"))
    )
    shorter, both = F.least(F.length(e("key")), F.length(a("key"))), F.length(e("key")) + F.length(a("key"))
    # no similarity is above what the lengths allow; most pairs are settled by that
    open_ = ~e("blank") & ~a("blank") & kind.isin("string", "text") & (e("key") != a("key")) & (2 * shorter >= FUZZY * both)
    rows = rows.withColumn("__ratio", _ratio(F.when(open_, e("key")).otherwise(""), F.when(open_, a("key")).otherwise("")))
    level = (
        F.when(e("blank") & a("blank"), "exact").when(e("blank") | a("blank"), "miss").when(F.col("expected") == F.col("actual"), "exact")
        .when(F.coalesce(same, F.lit(False)), "normalised").when(F.col("__ratio") >= FUZZY, "fuzzy").otherwise("miss")
    )
    return rows.withColumn("level", level).drop(*keys, "__ratio")


def outcomes(expected: DataFrame, actual: DataFrame, spec: DataFrame) -> DataFrame:
    """The fact table: the union of both sides' (doc_id, path), unknown paths dropped."""
    e = expected.select("doc_id", "path", F.col("value").alias("expected"))
    a = actual.select("doc_id", "path", F.col("value").alias("actual"), "confidence")
    both = e.join(a, ["doc_id", "path"], "full_outer").join(F.broadcast(spec), "path")  # the spec has tens of rows
    return graded(both)


def graded(rows: DataFrame) -> DataFrame:
    """rows (expected, actual, kind, ...) with level and flags."""
    rows = compare(rows)
    return rows.withColumns({"exact": F.col("level") == "exact", "correct": F.col("level").isin("exact", "normalised"), "fuzzy": F.col("level") != "miss", "has_expected": ~numbers.is_blank(F.col("expected")), "has_actual": ~numbers.is_blank(F.col("actual"))})


def _rate(flag: Column, among: Column | None = None) -> Column:
    """Share to four places; null without rows."""
    n = F.count("*") if among is None else F.count_if(among)
    return F.round(F.try_divide(F.count_if(flag if among is None else flag & among), n), 4)


def accuracy(fact: DataFrame, *by: str) -> DataFrame:
    """Shares of exact, right and similar fields, of all, of required and of critical ones; for each value of `by` if given."""
    out = []
    for scope, among in (("field", None), ("required", F.col("is_required")), ("critical", F.col("is_critical"))):
        out += [_rate(F.col(c), among).alias(f"{scope}_{c}") for c in ("exact", "correct", "fuzzy")]
    return fact.groupBy(*by).agg(*out)


def accuracy_and_success(fact: DataFrame, *by: str) -> DataFrame:
    """`accuracy` with the number of documents that `document_success` finds, in one pass: counts of each document, then their sums."""
    among = {"field": F.lit(True), "required": F.col("is_required"), "critical": F.col("is_critical")}
    counts = [F.count_if(a).alias(f"__{scope}") for scope, a in among.items()] + [F.count_if(a & F.col(c)).alias(f"__{scope}_{c}") for scope, a in among.items() for c in ("exact", "correct", "fuzzy")]
    success = F.coalesce(F.bool_and(F.when(F.col("is_required"), F.col("correct"))), F.lit(False)).cast("long")
    one = fact.groupBy(*by, "doc_id").agg(*counts, success.alias("__success"))
    names = [c for c in one.columns if c.startswith("__")]
    rows = one.groupBy(*by).agg(*(F.sum(c).alias(c) for c in names))
    rates = [F.round(F.try_divide(F.col(f"__{scope}_{c}"), F.col(f"__{scope}")), 4).alias(f"{scope}_{c}") for scope in among for c in ("exact", "correct", "fuzzy")]
    return rows.select(*by, F.col("__success").alias("successes"), *rates)


def document_success(fact: DataFrame, *by: str) -> DataFrame:
    """(*by, doc_id, success): at least one required field, all of them right."""
    required = F.when(F.col("is_required"), F.col("correct"))
    return fact.groupBy(*by, "doc_id").agg(F.coalesce(F.bool_and(required), F.lit(False)).alias("success"))


def precision_recall(fact: DataFrame) -> DataFrame:
    """Precision and recall to four places before F1; a wrong value counts against both."""
    tp = F.count_if(F.col("has_expected") & F.col("has_actual") & F.col("correct"))
    wrong = F.count_if(F.col("has_expected") & F.col("has_actual") & ~F.col("correct"))
    fp, fn = wrong + F.count_if(~F.col("has_expected") & F.col("has_actual")), wrong + F.count_if(F.col("has_expected") & ~F.col("has_actual"))
    rows = fact.agg(tp.alias("true_positive"), fp.alias("false_positive"), fn.alias("false_negative"))
    p, r = (F.round(F.try_divide(F.col("true_positive"), F.col("true_positive") + F.col(c)), 4) for c in ("false_positive", "false_negative"))
    rows = rows.withColumns({"precision": p, "recall": r})
    return rows.withColumn("f1", F.when((F.col("precision") > 0) & (F.col("recall") > 0), 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def operational(docs: DataFrame) -> DataFrame:
    """Failure rate over all documents, the other rates over those that did not fail."""
    ok = ~F.col("failed")
    return docs.agg(_rate(F.col("failed")).alias("failure_rate"), _rate(F.col("needs_review"), ok).alias("review_rate"), _rate(F.col("invalid"), ok).alias("validation_failure_rate"), _rate(F.col("type_correct"), ok).alias("classification_accuracy"))


def latency(docs: DataFrame, column: str = "latency_ms") -> DataFrame:
    """Mean and nearest-index percentiles, the index rounded half to even: each is read off by rank, so the
    values are never gathered into one array.
    """
    rows = docs.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    counts = rows.groupBy("v").agg(F.count("*").alias("n"))
    return _by_rank(counts, {"p50": lambda n: F.bround(F.lit(0.5) * (n - 1), 0), "p95": lambda n: F.bround(F.lit(0.95) * (n - 1), 0), "p99": lambda n: F.bround(F.lit(0.99) * (n - 1), 0)})


def load_percentiles(docs: DataFrame, column: str = "latency_ms") -> DataFrame:
    """The other rule: index int(n * q), the last one at most."""
    counts = docs.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    return _by_rank(counts, {f"p{q}": (lambda q: lambda n: F.least(n - 1, F.floor(n * F.lit(q) / 100)))(q) for q in (50, 95, 99)})


def _by_rank(counts: DataFrame, index: dict) -> DataFrame:
    """Values at indices of the sorted list that (value, n) stands for: ranges of values are numbered side by side."""
    dealt = storage.written(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("part").agg(F.sum("n").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))  # a row for each range
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    total = dealt.agg(F.sum("n").alias("total"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"), F.max("v").alias("max"))
    ranked = dealt.withColumn("upto", upto).join(F.broadcast(before), "part").withColumn("upto", F.col("upto") + F.col("before")).join(F.broadcast(total), how="left")  # one row
    picks = [F.min(F.when(F.col("upto") > f(F.col("total")), F.col("v"))).alias(name) for name, f in index.items()]
    return ranked.agg(F.first("mean").alias("mean"), *picks, F.first("max").alias("max"))


def calibration(fact: DataFrame) -> DataFrame:
    """Accuracy and mean confidence of each band that has fields."""
    band = F.when(F.col("confidence") >= 0.85, "high").when(F.col("confidence") >= 0.60, "medium").when(F.col("confidence").isNotNull(), "low")
    return fact.withColumn("band", band).where("band is not null").groupBy("band").agg(F.count("*").alias("fields"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def field_table(fact: DataFrame) -> DataFrame:
    return fact.groupBy("path").agg(
        F.count("*").alias("total"), F.count_if("correct").alias("right"), F.count_if(F.col("has_expected") & ~F.col("has_actual")).alias("missing"),
        F.count_if(~F.col("has_expected") & F.col("has_actual")).alias("spurious"), _rate(F.col("correct")).alias("accuracy"),
    )


def worst_fields(fact: DataFrame, limit: int = 12) -> DataFrame:
    return fact.where(~F.col("correct")).groupBy("path").agg(F.count("*").alias("errors")).orderBy(F.desc("errors"), "path").limit(limit)


def by_type(fact: DataFrame) -> DataFrame:
    return fact.groupBy("document_type").agg(F.countDistinct("doc_id").alias("documents"), _rate(F.col("correct")).alias("field_accuracy"))


def by_difficulty(fact: DataFrame) -> DataFrame:
    tags = F.when(F.size("tags") == 0, F.array(F.lit("(none)"))).otherwise(F.col("tags"))
    return fact.withColumn("tag", F.explode(tags)).groupBy("tag").agg(F.count("*").alias("fields"), _rate(F.col("correct")).alias("accuracy"))


def deciles(fact: DataFrame) -> DataFrame:
    bucket = F.least(F.lit(9), F.floor(F.col("confidence") * 10)).cast("int")
    return fact.where("confidence is not null").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("int")).alias("accuracy"), F.avg("confidence").alias("mean_confidence"))


def coarse(fact: DataFrame) -> DataFrame:
    """All coarse buckets, empty ones with 0 and null."""
    spark = fact.sparkSession
    at = F.lit(0)
    for i, edge in enumerate(COARSE_EDGES[:-1]):
        at = F.when(F.col("confidence") >= edge, i).otherwise(at)
    edges = spark.createDataFrame([(i, float(e)) for i, e in enumerate(COARSE_EDGES[:-1])], "bucket int, low double")
    counts = fact.where("confidence is not null").groupBy(at.alias("bucket")).agg(F.count("*").alias("n"), _rate(F.col("correct")).alias("accuracy"))
    return edges.join(counts, "bucket", "left").select("bucket", "low", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "accuracy")


def calibration_error(fact: DataFrame) -> DataFrame:
    return deciles(fact).agg(F.round(F.coalesce(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))) / F.sum("n"), F.lit(0.0)), 6).alias("ece"))


def drops(fact: DataFrame, points: float = 0.05) -> DataFrame:
    """Neighbouring populated deciles where accuracy falls by more than the given points."""
    w = Window.orderBy("bucket")  # ten rows at most
    rows = deciles(fact).withColumn("before", F.lag("accuracy").over(w))
    return rows.where(F.col("before") - F.col("accuracy") > points).select("bucket", F.round(F.col("before") - F.col("accuracy"), 6).alias("drop"))


def report_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, delta) of two long reports (metric, value)."""
    return before.withColumnRenamed("value", "b").join(after.withColumnRenamed("value", "a"), "metric").select("metric", F.round(F.col("a") - F.col("b"), 4).alias("delta"))


def gates(before: DataFrame, after: DataFrame) -> DataFrame:
    """Runs (provider, model, required, critical, success, review) side by side: status and violated gates."""
    cols = list(GATES)
    b = before.select("provider", "model", F.lit(True).alias("__b"), *(F.col(c).alias(f"b_{c}") for c in cols))
    a = after.select("provider", "model", F.lit(True).alias("__a"), *(F.col(c).alias(f"a_{c}") for c in cols))
    both = b.join(a, ["provider", "model"], "full_outer")
    delta = lambda c: F.round((F.col(f"a_{c}") - F.col(f"b_{c}")) * 100, 6)
    bad = F.array_compact(F.array(*(F.when(delta(c) < -GATES[c], c) for c in ("required", "critical", "success")), F.when(delta("review") > GATES["review"], "review")))
    status = F.when(F.col("__b").isNull(), "new run, no baseline").when(F.col("__a").isNull(), "missing in after").otherwise("compared")
    return both.select("provider", "model", status.alias("status"), bad.alias("violations"))
