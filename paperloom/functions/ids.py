"""Identifier normalisation and checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, constant_map

#: IBAN lengths by country, checksum weights, VAT shapes.
IBAN_LENGTHS = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22,
    "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15,
    "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
}
ICO_WEIGHTS = [8, 7, 6, 5, 4, 3, 2]
PREFIX_WEIGHTS, NUMBER_WEIGHTS = [10, 5, 8, 4, 2, 1], [6, 3, 7, 9, 10, 5, 8, 4, 2, 1]
VAT_SHAPES = {"CZ": r"\ACZ\d{8,10}\z", "SK": r"\ASK\d{10}\z", "PL": r"\APL\d{10}\z", "DE": r"\ADE\d{9}\z", "AT": r"\AATU\d{8}\z", "HU": r"\AHU\d{8}\z"}


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def _weighted(digits: Column, weights: list[int]) -> Column:
    pairs = F.zip_with(_chars(digits), F.array(*(F.lit(w) for w in weights)), lambda d, w: d.cast("int") * w)
    return F.aggregate(pairs, F.lit(0), lambda a, v: a + v)


def iban_key(x: Column) -> Column:
    return F.upper(F.regexp_replace(x, r"(?U)[\s\-]", ""))


def is_iban(x: Column) -> Column:
    """Shape, length by country where it is known, and remainder 1 modulo 97."""
    return bind(iban_key(x), _iban)


def _iban(t: Column) -> Column:
    known = F.element_at(constant_map(IBAN_LENGTHS), F.substring(t, 1, 2))
    shape = F.length(t).between(15, 34) & t.rlike(r"\A[A-Z]{2}[0-9]{2}[A-Z0-9]+\z") & (known.isNull() | (known == F.length(t)))
    turned = F.concat(F.substring(t, F.lit(5), F.length(t)), F.substring(t, 1, 4))
    digit = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(_chars(turned), F.lit(0), lambda a, c: (a * F.when(digit(c) > 9, 100).otherwise(10) + digit(c)) % 97)
    return F.coalesce(F.when(shape, rest == 1), F.lit(False))


def ico_key(x: Column) -> Column:
    digits = F.nullif(F.regexp_replace(x, r"\D", ""), F.lit(""))
    return F.when(F.length(digits) <= 8, F.lpad(digits, 8, "0")).otherwise(digits)


def is_ico(x: Column) -> Column:
    return bind(ico_key(x), _ico)


def _ico(t: Column) -> Column:
    rest = _weighted(F.substring(t, 1, 7), ICO_WEIGHTS) % 11
    check = F.when(rest == 0, 1).when(rest == 1, 0).otherwise(11 - rest)
    return F.coalesce(F.when(F.length(t) == 8, check == F.substring(t, 8, 1).try_cast("int")), F.lit(False))


def is_account(x: Column) -> Column:
    """[prefix-]number/bank with both weighted sums divisible by 11."""
    return bind(F.regexp_replace(x, r"(?U)\s", ""), _account)


def _account(t: Column) -> Column:
    rx = r"\A(?:(\d{1,6})-)?(\d{2,10})/(\d{4})\z"
    prefix, number = F.regexp_extract(t, rx, 1), F.regexp_extract(t, rx, 2)
    good = lambda d, w: _weighted(F.lpad(d, len(w), "0"), w) % 11 == 0
    return F.coalesce(F.when(t.rlike(rx), ((prefix == "") | good(prefix, PREFIX_WEIGHTS)) & good(number, NUMBER_WEIGHTS)), F.lit(False))


def vat_key(x: Column) -> Column:
    return F.nullif(F.upper(F.regexp_replace(x, r"(?U)[\s\-./]", "")), F.lit(""))


def is_vat(x: Column) -> Column:
    return bind(vat_key(x), _vat)


def _vat(t: Column) -> Column:
    fits = None
    for country, shape in VAT_SHAPES.items():
        test = F.substring(t, 1, 2) == country
        fits = F.when(test, t.rlike(shape)) if fits is None else fits.when(test, t.rlike(shape))
    return F.coalesce((F.length(t) >= 8) & fits.otherwise(t.rlike(r"\A[A-Z]{2}[A-Z0-9]{6,14}\z")), F.lit(False))
