"""Heavy work on small files runs on all cores, and once."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import extract, paths
from paperloom.plans import bound, records, ruled, specs
from paperloom.session import spread
from paperloom.sources import corpus, pdf


def _plan(df) -> str:  # noqa: ANN001
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_one_file_is_dealt_over_all_cores(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet")
    dealt = spread(rows)
    assert dealt.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert dealt.count() == rows.count()


def test_texts_are_dealt_before_they_are_read(spark, sf):
    assert bound.texts(spark, sf).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_rules_are_not_asked_twice(spark, sf):
    """An inner inline would put a filter on the size of the issues below it, which computes them again."""
    rows = ruled.payload(ruled.orders(spark, sf), "receipt", ruled.struct(purchase_date=F.lit("2024-06-03")))
    assert rows.count() > 0
    assert "size(" not in _plan(ruled.paths.flatten(rows.select(F.col(ruled.K).alias("doc_id"), "data"), specs.fields("receipt")))


def test_a_line_without_the_label_is_not_searched_by_pattern(spark):
    rows = spark.createDataFrame([(1, "Total\n\n  12,50 \nCELKEM K ÚHRADĚ: 99"), (2, "nothing"), (3, "")], "doc_id int, text string")
    lines = extract.with_lines(rows).select("lines").collect()
    assert [s["said"] for s in lines[0]["lines"]] == ["Total", "", "12,50", "CELKEM K ÚHRADĚ: 99"]
    assert lines[0]["lines"][3]["low"] == "celkem k uhrade: 99"
    found = {r["doc_id"]: r["values"] for r in extract.extract(rows, "receipt").collect()}
    assert found[1]["total"] in ("99", "12.5") and "total" not in found[2] and "total" not in found[3]


def test_the_graded_baseline_broadcasts_no_documents(spark):
    """Truth and records of all documents are joined by sorting; only the specification is sent around."""
    truth = corpus.labelled(spark, 30)
    both = truth.select("doc_id", "document_type", "difficulty", "expected", F.expr("cast(array() as array<struct<path:string,value:string>>)").alias("leaves"), F.expr("cast(array() as array<struct<path:string,score:double>>)").alias("fields"))
    fact = records.graded_fields(spark, both)
    assert fact.count() > 0 and fact.where("has_actual").count() == 0
    assert _plan(fact).count("Join ") == 1


def test_pdf_parts_are_bounded_by_files(spark, tmp_path):
    for i in range(pdf.PART_FILES + 1):
        (tmp_path / f"{i}.pdf").write_bytes(b"x")
    assert [len(p.paths) for p in pdf.PdfReader({"path": str(tmp_path)}).partitions()] == [pdf.PART_FILES, 1]


def test_levels_of_json_do_not_double(spark):
    rows = spark.createDataFrame([(1, '{"a":{"b":["x",null,{"c":"y"}]},"e":{},"f":[],"n":1}'), (2, "[[1],{}]"), (3, "{broken"), (4, None)], "doc_id long, json string")
    flat = paths.flatten_json(rows, 5)
    assert sorted((r.doc_id, r.path, r.value) for r in flat.collect() if r.doc_id != 4) == [(1, "a.b.0", "x"), (1, "a.b.1", None), (1, "a.b.2.c", "y"), (1, "n", "1"), (2, "0.0", "1")]
    assert _plan(flat).count("LogicalRDD") + _plan(flat).count("LocalRelation") <= 6
