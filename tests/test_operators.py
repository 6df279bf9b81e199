"""Operators that no table query covers: files, own types, timers, sinks."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paperloom.functions import numbers, text
from paperloom.operators import paths, store
from paperloom.plans import specs
from paperloom.sources import files


def test_read_and_decode_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("účet".encode())
    (tmp_path / "b.txt").write_bytes("účet".encode("cp1250"))
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.7")
    found = files.check_uploads(files.read_files(spark, str(tmp_path))).select(F.substring_index("path", "/", -1).alias("n"), "content_type", "reject").collect()
    got = {r.n: (r.content_type, r.reject) for r in found}
    assert got["a.txt"] == ("text/plain", None) and got["c.pdf"] == ("application/pdf", None) and got["b.txt"][1] == "unsupported_file_type"
    texts = {r.path.rsplit("/", 1)[1]: r.text for r in files.read_plain(files.read_files(spark, str(tmp_path))).collect()}
    assert texts["a.txt"] == texts["b.txt"] == "účet"


def test_page_readers(spark, tmp_path, monkeypatch):
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.7")
    monkeypatch.setattr(files, "READERS", {})
    assert files.read_pages(files.read_files(spark, str(tmp_path))).first().error == "text_extraction_failed"
    files.register_reader("application/pdf", lambda raw: [("one", False), ("two", True)])
    try:
        row = files.read_pages(files.read_files(spark, str(tmp_path))).first()
        assert [p.text for p in row.pages] == ["one", "two"] and row.error is None
    finally:
        monkeypatch.setattr(files, "READERS", {})


def test_ocr_text_must_be_longer(spark):
    rows = spark.createDataFrame([("abc", "ab", "abc"), ("abc", "abcd", "abcd"), ("abc", None, "abc")], "n string, o string, want string")
    assert all(r.got == r.want for r in rows.select("want", files.accept_ocr(F.col("n"), F.col("o")).alias("got")).collect())


def test_template_of_expanded_path_is_itself(spark):
    for key in specs.FIELDS:
        data = F.from_json(F.lit('{"line_items":[{},{}],"items":[{}],"parties":[{}]}'), specs.schema(key))
        out = spark.range(1).select(F.inline(paths.leaves(data, specs.fields(key)))).where(paths.template(F.col("path")) != F.col("template"))
        assert out.count() == 0


def test_empty_inputs_have_rows_of_zero_and_null(spark):
    none = spark.createDataFrame([], "status string, needs_review boolean, processing_ms long, is_current boolean")
    row = store.dashboard(none, none).first()
    assert row.total_documents == 0 and row.success_rate is None and row.review_rate is None


def test_wilson_stays_in_bounds(spark):
    rows = spark.createDataFrame([(s, n) for n in (1, 5, 100) for s in range(0, n + 1, max(1, n // 5))] + [(0, 0)], "s int, n int")
    for r in rows.select("n", numbers.wilson(F.col("s"), F.col("n")).alias("w")).collect():
        assert (r.w is None) == (r.n == 0)
        assert r.w is None or 0 <= r.w.low <= r.w.high <= 1


def test_folding_keeps_length(spark):
    s = "".join(map(chr, range(0x20, 0x250)))
    assert spark.range(1).select(F.length(text.fold_accents(F.lit(s))).alias("n")).first().n == len(s)


def test_sinks_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    rows.write.json(str(tmp_path / "j"))
    assert spark.read.schema(rows.schema).json(str(tmp_path / "j")).orderBy("id").collect() == rows.collect()
    rows.write.option("header", True).csv(str(tmp_path / "c"))
    assert spark.read.schema(rows.schema).option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_stale_needs_more_than_the_limit(spark):
    now = dt.datetime(2024, 1, 1, 12)
    rows = spark.createDataFrame([("processing", now - dt.timedelta(seconds=s)) for s in (1799, 1801)] + [("queued", now - dt.timedelta(days=1))], "status string, processing_started_at timestamp")
    assert store.stale(rows, F.lit(now)).count() == 1
