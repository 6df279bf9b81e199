"""Where values stand: lines and offsets through cleaning, folding and look-ahead."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import extract

TEXTS = {
    "invoice": "\n".join(["Žluťoučký kůň", "", "  Invoice number:   A-1 b  ", "Due date", "", "  2024-03-29 (final)", "Total 5,00", "VAT amount: none", "Subtotal excl", "Totál: 1 234,50 EUR", "Payment terms: " + "x" * 400, "Variable symbol", "", "", "too far"]),
    "generic": "Reference:  Réf 1\nreference: second",
}


def places(spark, key, text):
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "\n\n")], "doc_id long, text string")
    return {r.path: r for r in extract.located(df, key).collect() if r.doc_id == 1}, {r.doc_id for r in extract.located(df, key).collect()}


def test_values_stand_where_they_were_read(spark):
    text = TEXTS["invoice"]
    got, docs = places(spark, "invoice", text)
    said = {p: text[r.start - 1 : r.start - 1 + r.length] for p, r in got.items()}
    assert docs == {1}
    assert said["invoice_number"] == "A-1 b" and got["invoice_number"].line == 2
    assert said["due_date"] == "2024-03-29 (final)" and (got["due_date"].line, got["due_date"].value) == (5, "2024-03-29")
    assert said["total"] == "1 234,50 EUR" and got["total"].value == "1234.5" and got["total"].line == 9
    assert said["payment_terms"] == "x" * 80
    assert "tax_amount" not in got and "variable_symbol" not in got  # unreadable, and beyond two lines
    for r in got.values():
        assert text.split("\n")[r.line].find(said[r.path]) >= 0


def test_the_first_label_counts_and_odd_blanks_are_stepped_over(spark):
    text = TEXTS["generic"]
    got, _ = places(spark, "generic", text)
    r = got["reference_number"]
    assert text[r.start - 1 : r.start - 1 + r.length] == "Réf 1" and r.line == 0


def test_evidence_agrees_with_extraction(spark):
    df = spark.createDataFrame([(1, TEXTS["invoice"])], "doc_id long, text string")
    values = extract.extract(df, "invoice").select(F.explode("values").alias("path", "value")).collect()
    found = {r.path: r.value for r in extract.located(df, "invoice").collect()}
    assert found.items() <= {r.path: r.value for r in values}.items()
