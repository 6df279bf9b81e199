"""Kernels over literal vectors, for the tests: the inputs in Spark, the expected rows as SQL VALUES."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import ids, numbers, text
from paperloom.sources import files

from .registry import vector


def literal(v: Any, kind: str = "") -> str:
    """A DuckDB literal."""
    if v is None:
        return f"CAST(NULL AS {kind or 'VARCHAR'})"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, dt.date):
        return f"DATE '{v.isoformat()}'"
    if isinstance(v, (int, float, Decimal)):
        return f"CAST({v} AS {kind})" if kind else str(v)
    if isinstance(v, list):
        return "[" + ", ".join(literal(x) for x in v) + "]"
    return "'" + str(v).replace("'", "''") + "'"


def values_sql(columns: list[str], rows: list[tuple], kinds: list[str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(literal(v, k) for v, k in zip(r, kinds, strict=True)) + ")" for r in rows) + f") AS t({', '.join(columns)})"


def vectors(name: str, rows: list[tuple[Any, Any]], kernel: Callable[[Column], Column], in_type: str = "string", kind: str = "VARCHAR", doc: str = "") -> None:
    """Keep (raw, value) vectors of a kernel."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(rows)], f"n int, raw {in_type}")
        return raw.select("n", kernel(F.col("raw")).alias("value"))

    run.__doc__ = doc
    vector(name, values_sql(["n", "value"], [(i, v) for i, (_, v) in enumerate(rows)], ["INTEGER", kind]))(run)


D = Decimal
vectors("scl01_parse_decimal", [
    ("1234.56", D("1234.56")), ("1,234.56", D("1234.56")), ("1 234,56", D("1234.56")), ("1.234,56", D("1234.56")), ("1234,56", D("1234.56")), ("€ 1.234,56", D("1234.56")),
    ("(1 234,56)", D("-1234.56")), ("1 234,56 Kč", D("1234.56")), ("-1234.56", D("-1234.56")), ("+5", D("5")), ("1,234", D("1234")), ("1.234", D("1234")), (".123", D("0.123")), ("0.123", D("123")),
    ("1.2345", D("1.2345")), ("1,2,3", None), ("", None), (None, None), ("abc", None), ("78\xa0287,00", D("78287")), ("1'234.50", D("1234.5")), ("12-34", None), ("1.234.567", D("1234567")),
], numbers.parse_decimal, kind="DECIMAL(38,10)", doc="Numbers from messy text.")
vectors("scl12_decimal_or_null", [("x1,00y", D("1.00")), ("--5", None), ("5-", None), ("  42 ", D("42"))], numbers.parse_decimal, kind="DECIMAL(38,10)")

_DATES = [
    ("2024-03-15", dt.date(2024, 3, 15), False, False), ("2024-03-15T10:00:00Z", dt.date(2024, 3, 15), False, False), ("20240315", dt.date(2024, 3, 15), True, False), ("15.03.2024", dt.date(2024, 3, 15), True, False),
    ("03/15/2024", dt.date(2024, 3, 15), True, False), ("03/04/2024", dt.date(2024, 4, 3), True, True), ("1.2.69", dt.date(2069, 2, 1), True, True), ("1.2.70", dt.date(1970, 2, 1), True, True),
    ("15 March 2024", dt.date(2024, 3, 15), True, False), ("15. března 2024", dt.date(2024, 3, 15), True, False), ("1. října 2023", dt.date(2023, 10, 1), True, False), ("1. července 2023", None, True, False),
    ("31.02.2024", None, True, False), ("2024-13-01", None, False, False), ("nonsense", None, True, False), ("", None, False, False), (None, None, False, False),
]


@vector("scl02_parse_date", values_sql(["n", "value", "was_fuzzy", "ambiguous"], [(i, r[1] and r[1].isoformat(), *r[2:]) for i, r in enumerate(_DATES)], ["INTEGER", "", "", ""]))
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates with how hard they were to read."""
    raw = spark.createDataFrame([(i, r[0]) for i, r in enumerate(_DATES)], "n int, raw string")
    return raw.select("n", F.inline(F.array(numbers.parse_date(F.col("raw"))))).withColumn("value", F.col("value").cast("string"))


vectors("scl03_date_value", [(r[0], r[1] and r[1].isoformat()) for r in _DATES], lambda c: numbers.parse_date(c)["value"].cast("string"))
vectors("scl04_currency", [("kč", "CZK"), (" eur ", "EUR"), ("$", "USD"), ("£", "GBP"), ("zł", "PLN"), ("Ft", "HUF"), ("HRK", "HRK"), ("XYZ", None), ("", None), (None, None)], numbers.currency)
vectors("scl05_iban_key", [("cz65 0800-0000 1920 0014 5399", "CZ6508000000192000145399"), (None, None)], ids.iban_key)
vectors("scl06_iban_check", [("CZ6508000000192000145399", True), ("CZ65 0800 0000 1920 0014 5399", True), ("CZ6508000000192000145398", False), ("GB82WEST12345698765432", True), ("DE89370400440532013000", True), ("DE8937040044053201300", False), ("XX00", False), ("", False), (None, False)], ids.is_iban, kind="")
vectors("scl07_ico_key", [("123", "00000123"), ("CZ 27074358", "27074358"), ("123456789", "123456789"), ("x", None), (None, None)], ids.ico_key)
vectors("scl08_ico_check", [("27074358", True), ("45274649", True), ("45274648", False), ("123456789", False), ("", False), (None, False)], ids.is_ico, kind="")
vectors("scl09_account_check", [("19-2000145399/0800", True), ("2000145399/0800", True), ("2000145398/0800", False), ("19-2000145399", False), ("19 - 2000145399 / 0800", True), (None, False)], ids.is_account, kind="")
vectors("scl10_vat_check", [("CZ27074358", True), ("CZ2707", False), ("DE123456789", True), ("DE12345678", False), ("ATU12345678", True), ("FR12345678901", True), ("fr 123.456.789-01", True), ("1234567890", False), (None, False)], ids.is_vat, kind="")
vectors("scl11_vat_key", [("cz 270-743.58", "CZ27074358"), (" - ", None), (None, None)], ids.vat_key)
vectors("scl13_blank", [(None, True), ("", True), (" \xa0 ", True), ("x", False)], numbers.is_blank, kind="")
vectors("scl16_backoff_ceiling", [(1, 2.0), (2, 4.0), (5, 32.0), (6, 60.0), (9, 60.0)], numbers.backoff_ceiling, in_type="int", kind="DOUBLE", doc="Upper bound of the jittered delay.")
vectors("txt01_clean_text", [("a  b \t\r\nc\rd", "a  b\nc\nd"), ("x\n\n\n\ny", "x\n\ny"), ("ﬁle – “q” ‘r’\xa0s\u200bt", "file - \"q\" 'r' st"), ("  pad  ", "pad"), (None, None)], text.clean_text)
vectors("txt02_detect_language", [("Faktura č. 1, DPH 21 %", "cs"), ("Invoice total amount", "en"), ("Rechnung Betrag", "de"), ("invoice", None), ("", None), ("faktura kwota razem nabywca", "pl")], text.detect_language)
vectors("txt03_fold_accents", [("Příliš žluťoučký", "Prilis zlutoucky"), ("ﬁ", "f"), ("Ångström", "Angstrom"), ("ß", "ß")], text.fold_accents)
vectors("txt04_match_key", [("Účet č. 12-34", "ucetc1234"), ("Straße", "strasse"), ("ﬁne", "fine"), ("--", "")], text.match_key)
vectors("txt05_match_tokens", [("Účet č. 12-34", ["ucet", "c", "12", "34"]), ("", [])], text.match_tokens, kind="VARCHAR[]")
vectors("txt06_squeeze", [(" a \xa0 b\n c ", "a b c"), (" \t ", None), (None, None)], text.squeeze)
vectors("txt07_fold_ascii", [("ŘÍJEN", "rijen"), ("März", "marz")], text.fold_ascii)
vectors("txt13_slug", [("ACME, spol. s r.o.", "acme-spol-s-r-o"), ("  ", "")], text.slug)
vectors("txt15_hmac", [("1700000000.{}", "35495024f4ef3f94")], lambda c: F.substring(text.hmac_sha256("whsec_test", c), 1, 16))
vectors("src05_safe_filename", [("../../etc/passwd", "passwd"), ("C:\\x\\Faktura č.1 (kopie).pdf", "Faktura č.1 (kopie).pdf"), ("a*b?c.txt", "a_b_c.txt"), ("...", "document"), ("", "document"), (None, "document"), ("n" * 300 + ".pdf", "n" * 196 + ".pdf")], text.safe_filename)
vectors("src01_sniff_type", [
    ("%PDF-1.7", "application/pdf"), ("\x89PNG\r\n\x1a\n", None), ("plain words\n", "text/plain"), ("II*\x00", "image/tiff"), ("RIFF0000WEBPVP8 ", "image/webp"), ("RIFF0000WAVE", None), ("PK\x03\x04 word/document.xml", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"), ("PK\x03\x04 xl/", None), ("", None), ("a\x00b", None),
], lambda c: files.sniff_type(c.cast("binary")))
vectors("src02_looks_like_text", [("words\n\ttabs", True), ("", False), ("a\x00b", False), ("\x01\x02\x03abc", False), ("č" * 20, True)], lambda c: files.looks_like_text(c.cast("binary")), kind="")
vectors("src06_type_mismatch", [("application/pdf; q=1", True), ("text/plain", False)], lambda c: files.type_mismatch(c, F.lit("text/plain")), kind="")
vectors("ext04_pick_amount", [("Total (incl. 21% VAT) ... 39 930,00", D("39930")), ("DPH 21%: 6 930,00", D("6930")), ("Total 5", None), ("10.00 5 %", None), ("78\xa0287,00 Kč", D("78287")), ("none", None), (None, None)], numbers.pick_amount, kind="DECIMAL(38,10)")
vectors("evl16_wilson_low", [(0, 0.0), (5, 0.236593), (10, 0.722467)], lambda c: F.round(numbers.wilson(c, F.lit(10))["low"], 6), in_type="int", kind="DOUBLE")
