"""Answers of models: prices, recordings, bounded repair and graded runs, on small cases worked out by hand."""

from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from paperloom.operators import answers, pricing, replay
from paperloom.sources import storage

TODAY = dt.date(2024, 6, 1)
RECEIPT = {"merchant_name": "Corner Shop", "purchase_date": "2024-05-31", "currency": "CZK", "total": "100.00", "subtotal": "82.64", "tax_amount": "17.36"}


def test_costs(spark):
    table = pricing.price_table(spark, [("m", None, "1.00", "2.00", None), ("m", dt.date(2024, 3, 1), "3.00", "4.00", "0.50"), ("n", dt.date(2024, 3, 1), "5", "5", None)])
    rows = [("m", "2024-02-29", 10, 10, 4), ("m", "2024-03-01", 10, 10, 4), ("m", "2024-03-01", 1, 0, 9), ("n", "2024-02-01", 10, 10, 0), ("none", "2024-03-01", 10, 10, 0), ("m", "2024-02-01", None, None, None)]
    df = spark.createDataFrame(rows, "model string, day string, input_tokens long, output_tokens long, cached_tokens long")
    got = [r.cost_usd for r in pricing.priced(df, table, F.col("day")).orderBy("model", "day", "input_tokens").collect()]
    # nulls; fresh 6 + written 20; all cached beyond what was read; 18 + 40 + 2
    assert got == [Decimal("0.000000"), Decimal("0.000026"), Decimal("0.000004"), Decimal("0.000060"), Decimal("0.000000"), Decimal("0.000000")]
    half = pricing.price_table(spark, [("h", None, "0.50", "0", None)])
    few = spark.createDataFrame([("h", n, 0, 0) for n in (1, 3, 5)], "model string, input_tokens long, output_tokens long, cached_tokens long")
    assert [int(r.cost_usd * 10**6) for r in pricing.priced(few, half).orderBy("input_tokens").collect()] == [0, 2, 2]  # half to even


def test_ceiling(spark):
    row = spark.range(1).select(*(pricing.over_ceiling(F.lit(n), 0, p, F.lit(1), Decimal("1")).alias(a) for a, n, p in (("at", 10**6, F.lit(1)), ("over", 10**6 + 1, F.lit(1)), ("unknown", 10**9, F.lit(None).cast("double"))))).first()
    assert (row["at"], row.over, row.unknown) == (False, True, False)


def test_recordings(spark):
    store = replay.ReplayStore(spark, storage.scratch(spark, "replay-test"))
    rows = lambda *r: spark.createDataFrame([*r], "request_key string, raw string")
    assert store.replay(rows(("k", "ignored")).select("request_key")).collect()[0].raw is None
    store.record(rows(("a", "1"), ("b", "1"), ("b", "0")))
    store.record(rows(("b", "2"), ("c", "2")))
    before = store.answers()
    store.compact()
    store.record(rows(("c", "3")))
    held = {r.request_key: r.raw for r in store.answers().collect()}
    assert held == {"a": "1", "b": "2", "c": "3"}
    assert {r.request_key: r.raw for r in before.collect()} == {"a": "1", "b": "2", "c": "2"}  # a reader keeps what it began with
    got = store.replay(rows(("a", ""), ("a", ""), ("z", "")).select("request_key")).collect()
    assert sorted((r.request_key, r.raw or "", r.model or "") for r in got) == [("a", "1", "fixture-replay"), ("a", "1", "fixture-replay"), ("z", "", "")]
    key = spark.range(1).select(replay.request_key(F.lit("s"), F.lit("ab"), F.lit("c")), replay.request_key(F.lit("s"), F.lit("a"), F.lit("bc"))).first()
    assert key[0] != key[1] and len(key[0]) == 32


def test_a_name_is_taken_once(spark):
    at = storage.scratch(spark, "names")
    assert storage.put_new(spark, f"{at}/one", b"first")
    assert not storage.put_new(spark, f"{at}/one", b"second")
    assert storage.get_bytes(spark, f"{at}/one") == b"first"
    storage.put_bytes(spark, f"{at}/one", b"third")
    assert storage.get_bytes(spark, f"{at}/one") == b"third"
    assert [n for n in storage.names(spark, at) if not n.startswith(".")] == ["one"]


def _said(spark, rows):
    return spark.createDataFrame([(i, "gpt-4.1-mini", raw, 1000, 100, 0, 5) for i, raw in rows], "doc_id long, model string, raw string, input_tokens long, output_tokens long, cached_tokens long, latency_ms long")


def _but(**changes):
    return json.dumps({k: v for k, v in {**RECEIPT, **changes}.items() if v is not None})


ROUNDS = [
    {1: _but(), 2: _but(currency="?"), 3: _but(currency="?", purchase_date="soon"), 4: "{", 5: _but(total="900"), 6: _but(currency="?"), 7: _but(extra=1), 8: None, 9: _but(currency="?"), 10: "[1]"},
    {2: _but(), 3: _but(currency="?"), 6: "no", 7: _but(extra=1, total="900"), 9: _but(currency="?", total=None)},
    {3: _but(), 6: _but(), 7: _but(), 9: _but()},
]


@pytest.mark.parametrize("repairs", [0, 1, 2])
def test_repair(spark, repairs):
    asked = []

    def ask(rows, attempt):
        seen = rows.collect()
        asked.append({r.doc_id: (r.problems, r.previous) if attempt > 1 else None for r in seen})
        return _said(spark, [(r.doc_id, ROUNDS[attempt - 1].get(r.doc_id)) for r in seen])

    docs = spark.createDataFrame([(i, "receipt", "text") for i in ROUNDS[0]], "doc_id long, document_type string, text string")
    done = answers.with_repair(docs, ask, pricing.price_table(spark), TODAY, repairs, types=["receipt"])
    got = {r.doc_id: (r.broken, r.errors, r.attempts, r.repaired, r.attempt, int(r.cost_usd * 10**6)) for r in done.chosen.collect()}
    one = 560
    first = {1: (False, 0), 2: (False, 1), 3: (False, 2), 4: (True, 0), 5: (False, 1), 6: (False, 1), 7: (False, 1), 8: (True, 0), 9: (False, 1), 10: (True, 0)}
    want = {i: (*v, 1, False, 1, one) for i, v in first.items()}
    if repairs:
        assert set(asked[1]) == {2, 3, 6, 7, 9}
        assert asked[1][3] == ("- currency: unsupported_currency\n- purchase_date: unparseable_date", ROUNDS[0][3])
        want |= {2: (False, 0, 2, True, 2, 2 * one), 3: (False, 1, 2, True, 2, 2 * one), 7: (False, 1, 2, False, 1, 2 * one), 9: (False, 1, 2, False, 1, 2 * one)}
    if repairs == 2:
        assert set(asked[2]) == {3, 7, 9}  # a repair that could not be read is not tried again
        want |= {3: (False, 0, 3, True, 3, 3 * one), 7: (False, 0, 3, True, 3, 3 * one), 9: (False, 0, 3, True, 3, 3 * one)}
    assert got == want
    assert done.log.count() == sum(map(len, asked))
    assert answers.with_repair(docs, ask, pricing.price_table(spark), TODAY, 1, Decimal("0.0005"), ["receipt"]).log.where("attempt = 2").count() == 0  # the first answer cost the whole allowance


def test_graded_runs(spark):
    text = "Corner Shop\n2024-05-31\n82.64 17.36\nTotal 100.00 CZK\nmilk 2 50.00"
    truth = {**RECEIPT, "items.0.description": "milk", "items.0.price": "50.00"}
    corpus = spark.createDataFrame([(1, "receipt", text, truth, []), (2, "receipt", text, truth, ["ocr_scanned"])], "doc_id long, document_type string, text string, expected map<string,string>, difficulty array<string>")
    good = _but(items=[{"description": "milk", "quantity": "2", "price": "50.00"}])
    rows = [("a", 1, good, None), ("a", 2, good, None), ("b", 1, _but(merchant_name="Zebra", items=[{"description": "milk"}]), None), ("b", 2, "nothing", None), ("c", 1, None, "timeout"), ("c", 2, _but(total="1"), None)]
    given = spark.createDataFrame([(m, i, raw, 10, 10, 0, 7, e) for m, i, raw, e in rows], "model string, doc_id long, raw string, input_tokens long, output_tokens long, cached_tokens long, latency_ms long, error_code string")
    runs = answers.graded_run(corpus, given, pricing.price_table(spark), TODAY, ["receipt"]).cache()
    got = {(r.model, r.doc_id): r for r in runs.collect()}
    # all but the currency: (0.40 + 0.15 + 0.15 + 0.10 * context) / 0.80; the currency need not stand in the text
    assert got["a", 1].overall == 0.9875 and got["a", 2].overall == 0.9125
    assert not got["a", 1].needs_review and got["a", 1].error_code is None
    assert got["b", 1].needs_review and got["b", 1].validation_errors == 0 and got["b", 1].overall == pytest.approx(0.54375, abs=1e-4)
    assert (got["b", 2].failed, got["b", 2].error_code, got["b", 2].needs_review) == (True, answers.MALFORMED, None)
    assert (got["c", 1].failed, got["c", 1].error_code) == (True, "timeout")
    assert got["c", 2].validation_errors == 1 and got["c", 2].needs_review
    fact = {(r.model, r.doc_id, r.path): r for r in answers.facts(runs).collect()}
    assert len([k for k in fact if k[:2] == ("a", 1)]) == 9  # quantity is in the answer alone
    assert fact["a", 1, "items.0.quantity"].expected is None and not fact["a", 1, "items.0.quantity"].correct
    assert fact["b", 1, "items.0.price"].actual is None and fact["b", 1, "merchant_name"].level == "miss"
    table = {r.model: r for r in answers.by_model(runs, answers.facts(runs)).collect()}
    assert (table["a"].documents, table["a"].completed, table["a"].field_correct, table["a"].document_success_rate) == (2, 2, round(16 / 18, 4), 1.0)
    assert (table["b"].failure_rate, table["b"].review_rate, table["b"].document_success_rate) == (0.5, 1.0, 0.0)
    assert table["c"].completed == 1 and table["c"].critical_correct == round(2 / 3, 4)
    none = answers.graded_run(corpus, given.limit(0), pricing.price_table(spark), TODAY, ["receipt"])
    assert answers.by_model(none, answers.facts(none)).count() == 0
