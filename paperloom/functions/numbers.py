"""Locale-tolerant numbers, dates, currencies and amounts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, constant_map, fold_ascii, squeeze, strip

#: Supported currency codes, and what else stands for one.
CURRENCIES = ["CZK", "EUR", "USD", "GBP", "PLN", "HUF", "CHF", "SEK", "NOK", "DKK", "RON", "BGN", "HRK", "CAD", "AUD", "JPY"]
CURRENCY_ALIASES = {
    "KČ": "CZK", "KC": "CZK", "CZ": "CZK", "KORUN": "CZK", "KČS": "CZK", "€": "EUR", "EURO": "EUR", "EUROS": "EUR", "$": "USD", "US$": "USD",
    "DOLLAR": "USD", "DOLLARS": "USD", "£": "GBP", "POUND": "GBP", "ZŁ": "PLN", "ZL": "PLN", "FT": "HUF",
}
#: The first three folded letters of month names, English and Czech.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "led": 1, "uno": 2, "bre": 3, "dub": 4, "kve": 5, "cvn": 6, "cvc": 7, "srp": 8, "zar": 9, "rij": 10, "lis": 11, "pro": 12,
}
#: Fixed value: an amount within running text.
AMOUNT = r"-?\(?[\d][\d \x{00A0}.,']{0,15}[\d](?:[.,]\d{1,2})?\)?"
DECIMAL = "decimal(38,10)"
#: Most figures and days are written so; they need no further reading.
PLAIN_FIGURE, ISO_DAY = r"\A\d{1,28}(?:\.\d{1,2})?\z", r"\A[1-9]\d{3}-\d\d-\d\d\z"


def _tail(x: Column, mark: str) -> Column:
    """Characters after the last mark."""
    return F.length(F.substring_index(x, mark, -1))


def _plain(t: Column) -> Column:
    """Digits with at most one point: which mark is the decimal one is told by place and tail."""
    dot, comma = t.contains("."), t.contains(",")
    both = F.when(_tail(t, ",") < _tail(t, "."), F.translate(F.translate(t, ".", ""), ",", ".")).otherwise(F.translate(t, ",", ""))
    only_comma = F.when(_tail(t, ",") == 3, F.translate(t, ",", "")).otherwise(F.translate(t, ",", "."))
    thousands = (_tail(t, ".") == 3) & (F.length(F.translate(t, ".", "")) > 3)
    only_dot = F.when(thousands, F.translate(t, ".", "")).otherwise(t)
    return F.when(dot & comma, both).when(comma, only_comma).when(dot, only_dot).otherwise(t)


def parse_decimal(x: Column) -> Column:
    """Decimal from messy text; null where it is none."""

    def signed(t: Column) -> Column:
        """t starts with ( where it was wrapped; only digits, marks and signs follow."""
        wrapped, bare = t.startswith("("), F.regexp_replace(t, r"\A\(?[+-]?", "")
        minus = wrapped | t.rlike(r"\A\(?-")
        number = bind(_plain(bare), lambda p: F.when(p.rlike(r"\A(\d+\.?\d*|\.\d+)\z"), p.try_cast(DECIMAL)))
        return bind(F.struct(minus.alias("minus"), number.alias("number")), lambda s: F.when(s["minus"], (-s["number"]).cast(DECIMAL)).otherwise(s["number"]))

    def reduced(t: Column) -> Column:
        return F.concat(F.when(t.startswith("(") & t.endswith(")"), "(").otherwise(""), F.regexp_replace(t, r"[^\d,.\-+]", ""))

    return bind(x, lambda v: F.when(v.rlike(PLAIN_FIGURE), v.try_cast(DECIMAL)).when(v.isNotNull(), bind(strip(v), lambda t: bind(reduced(t), signed))))


def _day(y: Column, m: Column, d: Column) -> Column:
    """The calendar date, or null."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")


def parse_date(x: Column, day_first: bool = True) -> Column:
    """struct(value date, was_fuzzy, ambiguous)."""
    plain = lambda v: F.struct(v.try_cast("date").alias("value"), F.lit(False).alias("was_fuzzy"), F.lit(False).alias("ambiguous"))
    return bind(x, lambda v: F.when(v.rlike(ISO_DAY), plain(v)).otherwise(bind(strip(v), lambda t: _date(t, day_first))))


def _date(t: Column, day_first: bool) -> Column:
    part = lambda rx, i: F.regexp_extract(t, rx, i).try_cast("int")
    iso, compact = r"\A(\d{4})-(\d{1,2})-(\d{1,2})", r"\A(\d{4})(\d{2})(\d{2})\z"
    dmy, text = r"\A(\d{1,2})[./\- ](\d{1,2})[./\- ](\d{2,4})", r"(\d{1,2})[.\s-]+([a-zA-Zěščřžýáíéúůň]{3,12})[.\s,-]+(\d{4})"
    month = F.element_at(constant_map(MONTHS), F.substring(fold_ascii(F.regexp_extract(t, text, 2)), 1, 3))
    # year, month, day and the two flags as numbers; the calendar is asked once
    row = lambda y, m, d, fuzzy, unsure: F.struct(y.alias("y"), m.alias("m"), d.alias("d"), F.lit(fuzzy).alias("was_fuzzy"), unsure.alias("ambiguous"))
    no, none = F.lit(False), F.lit(None).cast("int")

    def ordered(p: Column) -> Column:
        """Two numbers below 100 and a year: one over 12 is the day."""
        a, b, y = p["a"], p["b"], p["y"]
        year = F.when(y >= 100, y).when(y < 70, y + 2000).otherwise(y + 1900)
        unsure = (a <= 12) & (b <= 12)
        swap = (a <= 12) & ((b > 12) | F.lit(not day_first))
        return row(year, F.when(swap, a).otherwise(b), F.when(swap, b).otherwise(a), True, unsure)

    found = (
        F.when(t.isNull() | (t == ""), row(none, none, none, False, no))
        .when(t.rlike(iso), row(part(iso, 1), part(iso, 2), part(iso, 3), False, no))
        .when(t.rlike(compact), row(part(compact, 1), part(compact, 2), part(compact, 3), True, no))
        .when(t.rlike(dmy), bind(F.struct(part(dmy, 1).alias("a"), part(dmy, 2).alias("b"), part(dmy, 3).alias("y")), ordered))
        .when(t.rlike(text) & month.isNotNull(), row(part(text, 3), month, part(text, 1), True, no))
        .otherwise(row(none, none, none, True, no))
    )
    return bind(found, lambda s: F.struct(F.when(s["y"].isNotNull(), _day(s["y"], s["m"], s["d"])).alias("value"), s["was_fuzzy"].alias("was_fuzzy"), s["ambiguous"].alias("ambiguous")))


def currency(x: Column) -> Column:
    alias = constant_map(CURRENCY_ALIASES)
    return bind(F.upper(strip(x)), lambda t: F.when(t.isin(*CURRENCIES), t).otherwise(F.element_at(alias, t)))


def pick_amount(x: Column) -> Column:
    """The last figure of a line that is no percentage."""
    found = F.regexp_extract_all(squeeze(x), F.lit(rf"({AMOUNT}(?:\s*%)?)"), F.lit(1))
    plain = F.filter(found, lambda m: ~m.endswith("%"))
    return parse_decimal(F.try_element_at(plain, F.lit(-1)))


def is_blank(x: Column) -> Column:
    return x.isNull() | ~x.rlike(r"(?U)\S")


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """US dollars at prices for a million tokens, to six places, half to even; 0 for an unknown model."""
    raw = (tokens_in.cast("decimal(18,0)") * price_in.cast("decimal(10,4)") + tokens_out.cast("decimal(18,0)") * price_out.cast("decimal(10,4)")) / F.lit(1_000_000).cast("decimal(8,0)")
    return F.coalesce(F.bround(raw.cast("decimal(24,12)"), 6), F.lit(0)).cast("decimal(12,6)")


def backoff_ceiling(attempt: Column, base: float = 2.0, cap: float = 60.0) -> Column:
    """The most that a retry waits; the delay itself is uniform from 0 to it."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt - 1))


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """struct(low, high) of the score interval, within 0 and 1; null without trials."""
    p, k = successes / n, F.lit(z * z)
    mid = (p + k / (2 * n)) / (1 + k / n)
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + k / (4 * n * n)) / (1 + k / n)
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), mid - half).alias("low"), F.least(F.lit(1.0), mid + half).alias("high")))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
