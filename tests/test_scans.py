"""Scanned corpora: the same each time, graded as read by OCR, failures left out."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.sources import corpus, scans


def test_confusion_is_seeded_and_keeps_lengths(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["", "Sell 10 items", "é" * 500, "l" * 20_000])], "doc_id long, text string")
    given = df.withColumn("seed", scans.seed(F.col("doc_id")))
    one, two, none, every = (given.select("doc_id", "text", scans.confused(F.col("text"), F.col("seed"), rate).alias("read")).collect() for rate in (0.1, 0.1, 0.0, 1.0))
    assert one == two and all(len(r.text) == len(r.read) for r in one + every) and all(r.text == r.read for r in none)
    assert {r.doc_id: r.read for r in every}[1] == "5c11 10 itcms"
    assert abs(sum(a != b for a, b in zip(one[3].text, one[3].read, strict=True)) / 20_000 - 0.1) < 0.01
    got = given.select("doc_id", scans.errors(F.col("text"), scans.confused(F.col("text"), F.col("seed"), 0.1)).alias("n")).collect()
    assert [r.n for r in sorted(got)] == [sum(a != b for a, b in zip(r.text, r.read, strict=True)) for r in sorted(one)]


def test_a_scanned_corpus(spark):
    docs = corpus.labelled(spark, 40)
    engine = scans.reader(0.03)
    out, skipped = scans.scanned(docs, lambda given: engine(given).where("doc_id <> 3").withColumn("read", F.when(F.col("doc_id") == 5, F.lit(" \n")).otherwise(F.col("read"))))
    assert {r.doc_id: r.reason for r in skipped.collect()} == {3: "empty_document", 5: "empty_document"}
    rows, before = out.collect(), {r.doc_id: r for r in docs.collect()}
    assert len(rows) == 38 and out.columns == docs.columns
    assert all(scans.TAG in r.difficulty and set(before[r.doc_id].difficulty) <= set(r.difficulty) and r.expected == before[r.doc_id].expected for r in rows)
    assert any(r.text != before[r.doc_id].text for r in rows)


def test_texts_are_not_taken_apart_into_strings(spark, sf):
    """A string for each character took a microsecond; the clean text came by a join of its own."""
    from paperloom.plans import registry

    plan = registry.queries()["evl26_scans"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and plan.count("Join ") == 2


def test_no_seed_no_text_and_characters_beyond_16_bits(spark):
    df = spark.createDataFrame([(1, 7, None), (2, None, "lIO"), (3, 7, "\U0001f600l" * 600)], "i int, seed long, text string")
    read = scans.confused_in_batches(F.col("text"), F.col("seed"), 1.0)
    assert [tuple(r) for r in df.select("i", read, scans.errors(F.col("text"), read)).orderBy("i").collect()] == [(1, None, None), (2, "lIO", 0), (3, "\U0001f6001" * 600, 600)]
