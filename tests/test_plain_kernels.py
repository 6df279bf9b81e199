"""Kernels read what is plainly written without their slow part, and grading takes one pass over the fields."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from paperloom.functions import numbers, text
from paperloom.operators import evaluation, paths


def test_plain_figures_and_days_read_as_the_others(spark):
    figures = ["0", "12.5", "12.34", "1.234", "12.345", "1" * 28, "1" * 28 + ".25", "1" * 29, "7.", ".5", " 12.5", "12.5\n", "-12.5", "١٢", None, ""]
    days = ["2024-02-29", "2023-02-29", "0000-01-01", "0001-01-01", "9999-12-31", "2024-2-9", "2024-02-29T10:00", " 2024-02-29", "2024-13-01", "2024-00-10", None, ""]
    padded = lambda xs: spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string").withColumn("y", F.concat(F.lit(" "), "x", F.lit(" ")))  # noqa: E731  # what is padded is no plain one
    for rows, read in ((padded(figures), numbers.parse_decimal), (padded(days), lambda c: numbers.parse_date(c).cast("string"))):
        for r in rows.select("x", read(F.col("x")).alias("a"), read(F.col("y")).alias("b")).collect():
            assert r.a == r.b, r.x
    blank = ["", " ", "\n\t", "\xa0", "　", "x", " x ", "​", None]
    got = padded(blank).select("x", numbers.is_blank(F.col("x")).alias("a"), (F.col("x").isNull() | (text.strip(F.col("x")) == "")).alias("b")).collect()
    assert all(r.a == r.b for r in got)


def test_plain_leaves_are_one_array(spark):
    """The parts of the plan grew with the fields; each array of a concat is looked at for each row."""
    lines = [("a", "string", "R"), ("b.c", "string", ""), ("l[].x", "string", ""), ("l[].y", "string", ""), ("d", "date", "")]
    data = spark.createDataFrame([(("1", ("2",), [("3", "4"), (None, "6")], None),), ((None, None, None, "7"),)], "d struct<a:string,b:struct<c:string>,l:array<struct<x:string,y:string>>,d:string>")
    column = paths.leaves(F.col("d"), lines)
    got = [[(x.path, x.template, x.value) for x in r[0]] for r in data.select(column).collect()]
    assert got[0] == [("a", "a", "1"), ("b.c", "b.c", "2"), ("l.0.x", "l[].x", "3"), ("l.1.x", "l[].x", None), ("l.0.y", "l[].y", "4"), ("l.1.y", "l[].y", "6"), ("d", "d", None)]
    assert got[1] == [("a", "a", None), ("b.c", "b.c", None), ("d", "d", "7")]
    plan = data.select(column)._jdf.queryExecution().analyzed().toString()
    assert len(re.findall(r"array\((?:named_)?struct\(", plan)) == 4  # two, in the column and again in its name


def test_accuracy_and_success_in_one_pass(spark):
    rows = [(m, k, r, c, e, x) for m in ("p", "q") for k in range(6) for r, c, e, x in ((True, True, k % 2 == 0, k % 3 > 0), (False, False, False, m == "q"), (k == 5, k > 3, True, True))]
    rows += [("s", 1, False, False, False, False)]
    fact = spark.createDataFrame(rows, "model string, doc_id int, is_required boolean, is_critical boolean, exact boolean, correct boolean").withColumn("fuzzy", F.col("correct"))
    one = evaluation.accuracy_and_success(fact, "model")
    want = evaluation.document_success(fact, "model").groupBy("model").agg(F.sum(F.col("success").cast("int")).alias("successes")).join(evaluation.accuracy(fact, "model"), "model")
    assert sorted(map(tuple, one.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert one._jdf.queryExecution().analyzed().toString().count("LogicalRDD") == 1  # two passes before


def test_equal_values_need_no_key(spark):
    days = [("2024-01-05", "5.1.2024", "date"), ("1.0", "1.01", "money"), ("a b", "A-B", "string"), ("x", "x", "string"), (None, None, "date"), ("", "x", "string"), ("EUR", "eur", "currency"), ("true", "1", "boolean"), ("q" * 30, "q" * 29 + "z", "string")]
    got = evaluation.graded(spark.createDataFrame(days, "expected string, actual string, kind string")).collect()
    assert [r.level for r in got] == ["normalised", "normalised", "normalised", "exact", "exact", "miss", "normalised", "normalised", "fuzzy"]
