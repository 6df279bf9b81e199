"""Business rules: each gives a payload's issues as an array; the engine concatenates them in order."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import ids, numbers
from paperloom.functions.text import bind
from paperloom.plans import specs
from paperloom.plans.totals import agreement

from .paths import expand, get, leaves

ISSUE = "struct<rule_id:string,code:string,severity:string,field_path:string>"
_NONE = f"array<{ISSUE}>"
Rule = Callable[["Context"], Column]
REGISTRY: dict[str, Rule] = {}


class Context:
    """A type's payload column and the day of the check."""

    def __init__(self, key: str, data: Column, today: dt.date, parsed: Column | None = None) -> None:
        self.key, self.data, self.today, self.parsed = key, data, today, parsed
        self.lines = specs.fields(key)
        self.paths = {p for p, _, _ in self.lines}

    def _read(self, *kinds: str) -> list[str]:
        return [p for p, kind, _ in self.lines if kind in kinds and "[]" not in p]

    def readings(self) -> Column:
        """Numbers and dates of the plain leaves, each read once for all rules, by one expression for each kind."""
        raw = lambda *kinds: F.array(F.lit(None).cast("string"), *(get(self.data, p) for p in self._read(*kinds)))
        dates = F.transform(raw("date"), lambda x: numbers.parse_date(x)["value"])
        amounts = F.transform(raw("money", "number"), lambda x: numbers.parse_decimal(x).cast("decimal(18,6)"))
        return F.struct(dates.alias("dates"), amounts.alias("amounts"))

    def has(self, path: str) -> bool:
        return path in self.paths

    def text(self, path: str) -> Column:
        return get(self.data, path) if self.has(path) else F.lit(None).cast("string")

    def number(self, path: str) -> Column:
        return self.parsed["amounts"][self._read("money", "number").index(path) + 1] if self.has(path) else F.lit(None).cast("decimal(18,6)")

    def date(self, path: str) -> Column:
        return self.parsed["dates"][self._read("date").index(path) + 1] if self.has(path) else F.lit(None).cast("date")

    def of_kind(self, *kinds: str) -> Column:
        some = [line for line in self.lines if line[1] in kinds]
        return leaves(self.data, some) if some else F.array().cast("array<struct<path:string,template:string,kind:string,flags:string,value:string>>")


def rule(name: str) -> Callable[[Rule], Rule]:
    def put(f: Rule) -> Rule:
        REGISTRY[name] = f
        return f

    return put


def issue(rule_id: str, code: str, severity: Column | str, path: Column | str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(rule_id).alias("rule_id"), F.lit(code).alias("code"), lit(severity).alias("severity"), lit(path).alias("field_path"))


def when(condition: Column, rule_id: str, code: str, severity: Column | str, path: str) -> Column:
    """The issue, or null where the condition is not met or unknown."""
    return F.when(condition, issue(rule_id, code, severity, path))


def some(*issues: Column) -> Column:
    return F.array_compact(F.array(*issues)).cast(_NONE)


def each(items: Column, bad: Callable[[Column], Column], rule_id: str, code: str, severity: str) -> Column:
    """An issue for every leaf that is bad; one without a value is not."""
    return F.transform(F.filter(items, lambda x: x["value"].isNotNull() & F.coalesce(bad(x["value"]), F.lit(False))), lambda x: issue(rule_id, code, severity, x["path"])).cast(_NONE)


@rule("required_fields")
def required_fields(c: Context) -> Column:
    """Required leaves must hold something; below an absent parent they are not asked for."""
    out = []
    for line in c.lines:
        path, _, flags = line
        if "R" not in flags:
            continue
        missing = lambda p: issue("required_fields", "missing_required_field", "error", p)
        if "[]" in path:
            head = path.split("[]")[0]
            rows = F.transform(F.filter(expand(c.data, line), lambda x: numbers.is_blank(x["value"])), lambda x: missing(x["path"]))
            out.append(F.when(F.size(get(c.data, head)) > 0, rows).otherwise(F.array().cast(_NONE)))
        elif "." in path:
            head = path.rsplit(".", 1)[0]
            inside = [p for p, _, _ in c.lines if p.startswith(head + ".")]
            present = reduce(lambda a, b: a | b, (~numbers.is_blank(c.text(p)) for p in inside))
            out.append(some(F.when(present & numbers.is_blank(c.text(path)), missing(F.lit(path)))))
        else:
            out.append(some(F.when(numbers.is_blank(c.text(path)), missing(F.lit(path)))))
    return F.concat(*out)


def _totals(c: Context, rule_id: str) -> list[Column]:
    sub, tax, total = (c.number(p) for p in ("subtotal", "tax_amount", "total"))
    # the three figures are read once and judged together
    grade = lambda s: agreement(s["sub"] + s["tax"], s["total"])
    level = F.transform(F.array(F.struct(sub.alias("sub"), tax.alias("tax"), total.alias("total"))), lambda s: F.struct(
        grade(s).alias("level"), (s["tax"].isNull() & (s["sub"] > s["total"] + F.lit("0.02").cast("decimal(4,2)"))).alias("sub_over"), (s["sub"].isNull() & (s["tax"] > s["total"] + F.lit("0.02").cast("decimal(4,2)"))).alias("tax_over")))[0]
    return [
        F.when(level["level"] != "none", issue(rule_id, "totals_mismatch", level["level"], "total")),
        when(level["sub_over"], rule_id, "subtotal_exceeds_total", "error", "subtotal"), when(level["tax_over"], rule_id, "tax_exceeds_total", "error", "tax_amount"),
    ]


@rule("po_totals_consistency")
def po_totals(c: Context) -> Column:
    return some(*_totals(c, "po_totals_consistency"))


@rule("receipt_totals_consistency")
def receipt_totals(c: Context) -> Column:
    return some(*_totals(c, "receipt_totals_consistency"))


@rule("invoice_totals_consistency")
def invoice_totals(c: Context) -> Column:
    name = "invoice_totals_consistency"
    implied = F.try_divide(c.number("tax_amount").cast("double"), c.number("subtotal").cast("double")) * 100
    rate = when(F.abs(implied - c.number("tax_rate").cast("double")) > 1.0, name, "tax_rate_mismatch", "warning", "tax_rate")
    due = when(c.number("amount_due") > c.number("total") + F.lit("0.02").cast("decimal(4,2)"), name, "amount_due_exceeds_total", "warning", "amount_due")
    return some(*_totals(c, name), rate, due)


@rule("line_items_sum")
def line_items_sum(c: Context) -> Column:
    """Lines are quantity times price; they make up the subtotal once all of them have a figure."""
    name, dec = "line_items_sum", lambda x: numbers.parse_decimal(x).cast("decimal(18,6)")
    rows = F.transform(c.data["line_items"], lambda e, i: F.struct(i.alias("i"), dec(e["quantity"]).alias("q"), dec(e["unit_price"]).alias("p"), dec(e["line_total"]).alias("t")))

    def judged(r: Column) -> Column:
        bad = F.filter(r, lambda x: F.coalesce(agreement((x["q"] * x["p"]).cast("decimal(18,6)"), x["t"]).isin("warning", "error"), F.lit(False)))
        lines = F.transform(bad, lambda x: issue(name, "line_total_mismatch", "warning", F.concat(F.lit("line_items."), x["i"], F.lit(".line_total"))))
        total = F.aggregate(r, F.lit(0).cast("decimal(18,6)"), lambda a, x: (a + x["t"]).cast("decimal(18,6)"))  # null if a line has none
        level = agreement(total, c.number("subtotal"))
        return F.concat(lines, F.array_compact(F.array(F.when((F.size(r) > 0) & level.isin("warning", "error"), issue(name, "line_items_subtotal_mismatch", level, "subtotal")))))

    return F.coalesce(F.transform(F.array(rows), judged)[0], F.array()).cast(_NONE)


@rule("positive_amounts")
def positive_amounts(c: Context) -> Column:
    return each(c.of_kind("money", "number"), lambda v: (v.contains("-") | v.contains("(")) & (numbers.parse_decimal(v) < 0), "positive_amounts", "negative_amount", "warning")


def _order(c: Context, name: str, first: str, last: str, severity: str = "error") -> Column:
    return when(c.date(first) > c.date(last), name, "date_order_violation", severity, last)


@rule("invoice_date_order")
def invoice_dates(c: Context) -> Column:
    days = F.datediff(c.date("due_date"), c.date("issue_date"))
    return some(_order(c, "invoice_date_order", "issue_date", "due_date"), when(days > 365, "invoice_date_order", "implausible_payment_term", "warning", "due_date"))


@rule("po_date_order")
def po_dates(c: Context) -> Column:
    return some(_order(c, "po_date_order", "order_date", "requested_delivery_date"))


@rule("contract_date_order")
def contract_dates(c: Context) -> Column:
    name = "contract_date_order"
    months, term = F.datediff(c.date("expiration_date"), c.date("effective_date")) / F.lit(30.44), c.number("term_months").cast("double")
    span = when((term != 0) & (F.abs(months - term) > 1.5), name, "term_span_mismatch", "warning", "term_months")
    return some(_order(c, name, "effective_date", "expiration_date"), _order(c, name, "signature_date", "expiration_date", "warning"), span)


@rule("date_sanity")
def date_sanity(c: Context) -> Column:
    far = dt.date.fromordinal(c.today.toordinal() + 3650)
    held = F.filter(c.of_kind("date"), lambda x: ~numbers.is_blank(x["value"]))
    day = F.transform(held, lambda x: F.struct(x["path"].alias("path"), numbers.parse_date(x["value"])["value"].alias("day")))

    def judged(days: Column) -> Column:
        those = lambda bad, code: F.transform(F.filter(days, bad), lambda x: issue("date_sanity", code, "error", x["path"])).cast(_NONE)
        return F.concat(those(lambda x: x["day"].isNull(), "unparseable_date"), those(lambda x: ~x["day"].between(F.lit(dt.date(1990, 1, 1)), F.lit(far)), "implausible_date"))

    return bind(day, judged)


@rule("date_not_future")
def date_not_future(c: Context) -> Column:
    return some(when(c.date("purchase_date") > F.lit(dt.date.fromordinal(c.today.toordinal() + 1)), "date_not_future", "future_date", "warning", "purchase_date"))


@rule("currency_supported")
def currency_supported(c: Context) -> Column:
    v = c.text("currency")
    return some(when(~numbers.is_blank(v) & numbers.currency(v).isNull(), "currency_supported", "unsupported_currency", "error", "currency"))


@rule("iban_checksum")
def iban_checksum(c: Context) -> Column:
    v = c.text("bank_details.iban")
    return some(when(~numbers.is_blank(v) & ~ids.is_iban(v), "iban_checksum", "invalid_iban", "error", "bank_details.iban"))


@rule("czech_account_checksum")
def account_checksum(c: Context) -> Column:
    v = c.text("bank_details.account_number")
    return some(when(v.rlike(r"/\d{4}\s*\z") & ~ids.is_account(v), "czech_account_checksum", "invalid_account_number", "error", "bank_details.account_number"))


@rule("ico_checksum")
def ico_checksum(c: Context) -> Column:
    some_lines = [line for line in c.lines if line[0].endswith("registration_id")]
    return each(leaves(c.data, some_lines), lambda v: (F.length(F.regexp_replace(v, r"\D", "")) == 8) & ~ids.is_ico(v), "ico_checksum", "invalid_registration_id", "warning")


@rule("vat_id_format")
def vat_format(c: Context) -> Column:
    some_lines = [line for line in c.lines if line[0].endswith("vat_id")]
    return each(leaves(c.data, some_lines), lambda v: ~numbers.is_blank(v) & ~ids.is_vat(v), "vat_id_format", "implausible_vat_id", "warning")


@rule("variable_symbol_format")
def variable_symbol(c: Context) -> Column:
    v, name = F.trim(c.text("variable_symbol")), "variable_symbol_format"
    odd = (v != "") & ~v.rlike(r"\A\d+\z")
    return some(when(odd, name, "non_numeric", "warning", "variable_symbol"), when(~odd & (F.length(v) > 10), name, "too_long", "warning", "variable_symbol"))


@rule("contract_parties_min")
def parties_min(c: Context) -> Column:
    return some(when(F.coalesce(F.size(c.data["parties"]), F.lit(0)) < 2, "contract_parties_min", "insufficient_parties", "error", "parties"))


@rule("contract_renewal_consistency")
def renewal(c: Context) -> Column:
    name, auto, notice = "contract_renewal_consistency", F.lower(c.text("auto_renewal")), c.number("notice_period_days")
    return some(
        when((auto == "true") & notice.isNull(), name, "missing_notice_period", "warning", "notice_period_days"),
        when((notice < 0) | (notice > 730), name, "implausible_notice_period", "warning", "notice_period_days"), when((auto == "false") & (notice > 0), name, "notice_without_renewal", "info", "auto_renewal"),
    )


def issues(key: str, data: Column, today: dt.date, rule_ids: list[str] | None = None) -> Column:
    """All issues of a payload, in the order of the type's rules; an unknown rule is an info issue."""
    some_rules = rule_ids or specs.RULES[key]

    def check(parsed: Column) -> Column:
        c = Context(key, data, today, parsed)
        return F.concat(F.array().cast(_NONE), *(REGISTRY[r](c) if r in REGISTRY else some(issue(r, "rule_not_found", "info", "")) for r in some_rules))

    return bind(Context(key, data, today).readings(), check)


def summary(rows: DataFrame) -> DataFrame:
    """rows (doc_id, issues) with errors, warnings, validity and affected paths."""
    n = lambda s: F.size(F.filter("issues", lambda i: i["severity"] == s))
    return rows.select("doc_id", n("error").alias("errors"), n("warning").alias("warnings"), (n("error") == 0).alias("is_valid"), F.array_sort(F.array_distinct(F.transform("issues", lambda i: i["field_path"]))).alias("paths"))
