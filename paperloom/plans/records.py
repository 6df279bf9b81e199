"""Queries over records: rules on payloads, paths, classification, extraction, confidence and routing."""

from __future__ import annotations

import copy
import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text
from paperloom.operators import confidence, evaluation, extract, paths, rules, sinks
from paperloom.session import spread
from paperloom.sources import storage

from . import specs
from .golden import values_sql
from .registry import query, vector
from .relational import _t
from .totals import agreement

TODAY = dt.date(2024, 6, 1)
INVOICE = {
    "invoice_number": "2024-001", "supplier": {"name": "ACME s.r.o.", "vat_id": "CZ27074358", "registration_id": "27074358"}, "customer": {"name": "Beta"}, "issue_date": "2024-03-01", "due_date": "2024-03-15", "currency": "CZK",
    "subtotal": "1000.00", "tax_amount": "210.00", "tax_rate": "21", "total": "1210.00", "bank_details": {"iban": "CZ6508000000192000145399", "account_number": "19-2000145399/0800"}, "variable_symbol": "2024001",
    "line_items": [{"description": "a", "quantity": "2", "unit_price": "300.00", "line_total": "600.00"}, {"description": "b", "quantity": "1", "unit_price": "400.00", "line_total": "400.00"}],
}
CONTRACT = {"title": "Lease", "contract_type": "lease", "parties": [{"name": "A"}, {"name": "B"}], "effective_date": "2024-01-01", "expiration_date": "2024-12-31", "term_months": "12", "auto_renewal": "true", "notice_period_days": "30", "currency": "EUR"}
ORDER = {"po_number": "PO-1", "buyer": {"name": "A"}, "supplier": {"name": "B"}, "order_date": "2024-02-01", "requested_delivery_date": "2024-02-10", "currency": "EUR", "subtotal": "100", "tax_amount": "20", "total": "120", "line_items": [{"description": "x", "quantity": "1"}]}
RECEIPT = {"merchant_name": "Shop", "purchase_date": "2024-05-31", "currency": "CZK", "total": "100.00", "subtotal": "82.64", "tax_amount": "17.36"}


def _but(base: dict, **changes) -> dict:  # noqa: ANN003
    """A copy with some fields changed; __ stands for a dot, None removes."""
    out = copy.deepcopy(base)
    for k, v in changes.items():
        at, parts = out, k.split("__")
        for p in parts[:-1]:
            at = at[int(p)] if isinstance(at, list) else at.setdefault(p, {})
        if v is None:
            at.pop(parts[-1], None)
        else:
            at[parts[-1]] = v
    return out


#: rule query -> (type, payloads, issues expected of each: code, severity, path)
CASES: dict[str, tuple[str, list[tuple[dict, list[tuple[str, str, str]]]]]] = {
    "val01_required_fields": ("invoice", [
        (INVOICE, []), (_but(INVOICE, invoice_number=None), [("missing_required_field", "error", "invoice_number")]), (_but(INVOICE, supplier__name=" "), [("missing_required_field", "error", "supplier.name")]), (_but(INVOICE, supplier=None), []),
        (_but(INVOICE, line_items__1__description=None), [("missing_required_field", "error", "line_items.1.description")]), (_but(INVOICE, total=None, currency=None), [("missing_required_field", "error", "currency"), ("missing_required_field", "error", "total")]),
    ]),
    "val03_invoice_totals": ("invoice", [
        (INVOICE, []), (_but(INVOICE, total="1210.50"), [("totals_mismatch", "info", "total")]), (_but(INVOICE, total="1225.00"), [("totals_mismatch", "warning", "total")]), (_but(INVOICE, total="9999.00"), [("totals_mismatch", "error", "total")]),
        (_but(INVOICE, tax_amount=None, total="900"), [("subtotal_exceeds_total", "error", "subtotal")]), (_but(INVOICE, subtotal=None, total="100"), [("tax_exceeds_total", "error", "tax_amount")]), (_but(INVOICE, tax_rate="15"), [("tax_rate_mismatch", "warning", "tax_rate")]),
        (_but(INVOICE, amount_due="2000"), [("amount_due_exceeds_total", "warning", "amount_due")]), (_but(INVOICE, total=None), []),
    ]),
    "val04_po_totals": ("purchase_order", [(ORDER, []), (_but(ORDER, total="200"), [("totals_mismatch", "error", "total")])]),
    "val04_receipt_totals": ("receipt", [(RECEIPT, []), (_but(RECEIPT, total="101.50"), [("totals_mismatch", "warning", "total")])]),
    "val05_line_items_sum": ("invoice", [
        (INVOICE, []), (_but(INVOICE, line_items__0__line_total="700.00"), [("line_total_mismatch", "warning", "line_items.0.line_total"), ("line_items_subtotal_mismatch", "error", "subtotal")]),
        (_but(INVOICE, line_items__0__line_total=None, subtotal="5"), []), (_but(INVOICE, line_items=None), []),
    ]),
    "val06_positive_amounts": ("invoice", [(INVOICE, []), (_but(INVOICE, total="-5", line_items__1__unit_price="(3)"), [("negative_amount", "warning", "line_items.1.unit_price"), ("negative_amount", "warning", "total")])]),
    "val07_invoice_dates": ("invoice", [(INVOICE, []), (_but(INVOICE, due_date="2024-02-01"), [("date_order_violation", "error", "due_date")]), (_but(INVOICE, due_date="2025-06-01"), [("implausible_payment_term", "warning", "due_date")])]),
    "val08_po_dates": ("purchase_order", [(ORDER, []), (_but(ORDER, requested_delivery_date="2024-01-01"), [("date_order_violation", "error", "requested_delivery_date")])]),
    "val09_contract_dates": ("contract", [
        (CONTRACT, []), (_but(CONTRACT, expiration_date="2023-12-31", term_months="0"), [("date_order_violation", "error", "expiration_date")]), (_but(CONTRACT, signature_date="2025-02-01"), [("date_order_violation", "warning", "expiration_date")]), (_but(CONTRACT, term_months="24"), [("term_span_mismatch", "warning", "term_months")]),
    ]),
    "val10_date_sanity": ("invoice", [(INVOICE, []), (_but(INVOICE, due_date="soon"), [("unparseable_date", "error", "due_date")]), (_but(INVOICE, issue_date="1980-01-01"), [("implausible_date", "error", "issue_date")]), (_but(INVOICE, due_date="2040-01-01"), [("implausible_date", "error", "due_date")])]),
    "val11_date_not_future": ("receipt", [(RECEIPT, []), (_but(RECEIPT, purchase_date="2024-06-02"), []), (_but(RECEIPT, purchase_date="2024-06-03"), [("future_date", "warning", "purchase_date")])]),
    "val12_currency": ("invoice", [(INVOICE, []), (_but(INVOICE, currency="Kč"), []), (_but(INVOICE, currency="XYZ"), [("unsupported_currency", "error", "currency")]), (_but(INVOICE, currency=None), [])]),
    "val13_iban": ("invoice", [(INVOICE, []), (_but(INVOICE, bank_details__iban="CZ6508000000192000145398"), [("invalid_iban", "error", "bank_details.iban")])]),
    "val14_account": ("invoice", [(INVOICE, []), (_but(INVOICE, bank_details__account_number="19-2000145398/0800"), [("invalid_account_number", "error", "bank_details.account_number")]), (_but(INVOICE, bank_details__account_number="DE123"), [])]),
    "val15_ico": ("invoice", [(INVOICE, []), (_but(INVOICE, supplier__registration_id="27074359"), [("invalid_registration_id", "warning", "supplier.registration_id")]), (_but(INVOICE, supplier__registration_id="123"), [])]),
    "val15_ico_parties": ("contract", [(_but(CONTRACT, parties=[{"name": "A", "registration_id": "27074358"}, {"name": "B", "registration_id": "27074359"}]), [])]),
    "val16_vat": ("invoice", [(INVOICE, []), (_but(INVOICE, supplier__vat_id="CZ12"), [("implausible_vat_id", "warning", "supplier.vat_id")])]),
    "val17_variable_symbol": ("invoice", [(INVOICE, []), (_but(INVOICE, variable_symbol="12a"), [("non_numeric", "warning", "variable_symbol")]), (_but(INVOICE, variable_symbol="12345678901"), [("too_long", "warning", "variable_symbol")])]),
    "val18_parties": ("contract", [(CONTRACT, []), (_but(CONTRACT, parties=[{"name": "A"}]), [("insufficient_parties", "error", "parties")]), (_but(CONTRACT, parties=None), [("insufficient_parties", "error", "parties")])]),
    "val19_renewal": ("contract", [
        (CONTRACT, []), (_but(CONTRACT, notice_period_days=None), [("missing_notice_period", "warning", "notice_period_days")]), (_but(CONTRACT, notice_period_days="900"), [("implausible_notice_period", "warning", "notice_period_days")]), (_but(CONTRACT, auto_renewal="false"), [("notice_without_renewal", "info", "auto_renewal")]),
    ]),
}
ONLY = {
    "val01_required_fields": "required_fields", "val03_invoice_totals": "invoice_totals_consistency", "val04_po_totals": "po_totals_consistency", "val04_receipt_totals": "receipt_totals_consistency", "val05_line_items_sum": "line_items_sum", "val06_positive_amounts": "positive_amounts", "val07_invoice_dates": "invoice_date_order",
    "val08_po_dates": "po_date_order", "val09_contract_dates": "contract_date_order", "val10_date_sanity": "date_sanity", "val11_date_not_future": "date_not_future", "val12_currency": "currency_supported", "val13_iban": "iban_checksum", "val14_account": "czech_account_checksum", "val15_ico": "ico_checksum", "val15_ico_parties": "required_fields",
    "val16_vat": "vat_id_format", "val17_variable_symbol": "variable_symbol_format", "val18_parties": "contract_parties_min", "val19_renewal": "contract_renewal_consistency",
}


def payloads(spark: SparkSession, key: str, rows: list[dict]) -> DataFrame:
    """(doc_id, data) of a type from payload dicts."""
    raw = spark.createDataFrame([(i, json.dumps(r, ensure_ascii=False)) for i, r in enumerate(rows)], "doc_id int, json string")
    return raw.select("doc_id", "json", F.from_json("json", specs.schema(key)).alias("data"))


def _register(name: str) -> None:
    key, cases = CASES[name]
    expected = [(i, *e) for i, (_, found) in enumerate(cases) for e in found] or [(-1, "", "", "")]
    sql = values_sql(["doc_id", "code", "severity", "field_path"], expected, ["INTEGER", "", "", ""]) + " WHERE doc_id >= 0"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = payloads(spark, key, [p for p, _ in cases])
        return rows.select("doc_id", F.inline(rules.issues(key, F.col("data"), TODAY, [ONLY[name]]))).select("doc_id", "code", "severity", "field_path")

    vector(name, sql)(run)


for _name in CASES:
    _register(_name)


@vector("val20_summary", values_sql(["doc_id", "errors", "warnings", "is_valid", "n_paths"], [(0, 0, 0, True, 0), (1, 2, 1, False, 3)], ["INTEGER", "INTEGER", "INTEGER", "", "INTEGER"]))
def summary(spark, d):  # noqa: ANN001, ANN201
    rows = payloads(spark, "invoice", [INVOICE, _but(INVOICE, total=None, currency="XYZ", variable_symbol="x1")])
    return rules.summary(rows.select("doc_id", rules.issues("invoice", F.col("data"), TODAY).alias("issues"))).select("doc_id", "errors", "warnings", "is_valid", F.size("paths").alias("n_paths"))


@vector("val21_rule_sets", values_sql(["document_type", "place", "rule_id"], [(k, i, r) for k, rs in specs.RULES.items() for i, r in enumerate(rs)], ["", "INTEGER", ""]))
def rule_sets(spark, d):  # noqa: ANN001, ANN201
    sets = spark.createDataFrame([(k, r) for k, r in specs.RULES.items()], "document_type string, rules array<string>")
    return sets.select("document_type", F.posexplode("rules").alias("place", "rule_id"))


@query("val02_perturbed_totals", """WITH l AS (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(1 - l_discount AS DECIMAL(6,2))) + sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(1 - l_discount AS DECIMAL(6,2)) * CAST(l_tax AS DECIMAL(6,2))) AS DECIMAL(18,6)) AS e FROM lineitem GROUP BY 1),
x AS (SELECT l_orderkey, e, CAST(e * CAST(1 + (l_orderkey % 7) * 0.004 AS DECIMAL(6,3)) AS DECIMAL(18,6)) AS a FROM l)
SELECT CASE WHEN abs(a - e) <= 0.02 THEN 'none' WHEN abs(a - e) <= greatest(1.00, 0.005 * greatest(abs(a), abs(e), 1)) THEN 'info' WHEN abs(a - e) <= 0.02 * greatest(abs(a), abs(e), 1) THEN 'warning' ELSE 'error' END AS severity, count(*) AS n FROM x GROUP BY 1""")
def perturbed(spark, d):  # noqa: ANN001, ANN201
    from .totals import order_sums

    sums = order_sums(_t(spark, d, "lineitem")).select("l_orderkey", (F.col("subtotal") + F.col("tax")).cast("decimal(18,6)").alias("e"))
    rows = sums.withColumn("a", (F.col("e") * (1 + (F.col("l_orderkey") % 7) * F.lit(0.004)).cast("decimal(6,3)")).cast("decimal(18,6)"))
    return rows.select(agreement(F.col("e"), F.col("a")).alias("severity")).groupBy("severity").agg(F.count("*").alias("n"))


@query("val05_orders_line_sums", "SELECT o_orderkey, count(l_orderkey) AS n_lines, CAST(coalesce(sum(CAST(l_quantity AS DECIMAL(12,2))), 0) AS DECIMAL(24,2)) AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def line_sums(spark, d):  # noqa: ANN001, ANN201
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(12,2)")).alias("q"))
    return _t(spark, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_lines"), F.coalesce("q", F.lit(0)).cast("decimal(24,2)").alias("quantity"))


# ---- paths ----


def _leaves(x, at: str = "") -> list[tuple[str, str]]:  # noqa: ANN001
    if isinstance(x, dict):
        return [y for k, v in x.items() for y in _leaves(v, f"{at}.{k}" if at else k)]
    if isinstance(x, list):
        return [y for i, v in enumerate(x) for y in _leaves(v, f"{at}.{i}")]
    return [(at, x)]


@vector("pth03_04_flatten", values_sql(["path", "value"], _leaves(INVOICE), ["", ""]))
def flatten(spark, d):  # noqa: ANN001, ANN201
    return paths.flatten(payloads(spark, "invoice", [INVOICE]), specs.fields("invoice")).select("path", "value")


@vector("pth04_flatten_json", values_sql(["path", "value"], _leaves({"a": {"b": ["x", None, {"c": "y"}]}, "e": {}, "f": [], "n": "1"}), ["", ""]))
def flatten_json(spark, d):  # noqa: ANN001, ANN201
    rows = spark.createDataFrame([(1, json.dumps({"a": {"b": ["x", None, {"c": "y"}]}, "e": {}, "f": [], "n": "1"}))], "doc_id int, json string")
    return paths.flatten_json(rows, 4).select("path", "value")


_PATHS = [("line_items.2.total", "line_items[].total", "line_items.2"), ("total", "total", ""), ("a.0.b.1", "a[].b[]", "a.0.b"), ("supplier.name", "supplier.name", "supplier")]


@vector("pth05_06_templates", values_sql(["path", "template", "parent"], _PATHS, ["", "", ""]))
def templates(spark, d):  # noqa: ANN001, ANN201
    rows = spark.createDataFrame([(p[0],) for p in _PATHS], "path string")
    return rows.select("path", paths.template(F.col("path")).alias("template"), paths.parent(F.col("path")).alias("parent"))


@vector("pth01_02_get_set", values_sql(["name", "changed"], [("ACME s.r.o.", "New")], ["", ""]))
def get_set(spark, d):  # noqa: ANN001, ANN201
    rows = payloads(spark, "invoice", [INVOICE]).withColumn("new", F.col("data").withField("supplier.name", F.lit("New")))
    return rows.select(paths.get(F.col("data"), "supplier.name").alias("name"), paths.get(F.col("new"), "supplier.name").alias("changed"))


@vector("pth07_null_leaves", "SELECT 'invoice' AS document_type, CAST(34 AS BIGINT) AS leaves, CAST(8 AS BIGINT) AS list_leaves")
def null_leaves(spark, d):  # noqa: ANN001, ANN201
    flat = paths.flatten(payloads(spark, "invoice", [_but(INVOICE, line_items=[{"description": "a"}])]), specs.fields("invoice"), keep_null=True)
    both = flat.agg(F.count("*").alias("leaves"), (F.count_if(F.col("path").startswith("line_items")) + 2).alias("list_leaves"))
    return both.select(F.lit("invoice").alias("document_type"), "leaves", "list_leaves")


@vector("pth09_unknown_keys", values_sql(["doc_id", "unknown"], [(0, []), (1, ["foo"])], ["INTEGER", "VARCHAR[]"]).replace("[]::", "").replace(", [])", ", []::VARCHAR[])"))
def unknown_keys(spark, d):  # noqa: ANN001, ANN201
    rows = payloads(spark, "invoice", [INVOICE, INVOICE | {"foo": "1"}])
    return rows.select("doc_id", paths.unknown_keys(F.col("json"), [f.name for f in specs.schema("invoice").fields]).alias("unknown"))


@vector("pth10_field_specs", values_sql(["document_type", "path", "kind", "is_required", "is_critical", "groundable"], [(k, p, kind, "R" in fl, "C" in fl, "N" not in fl) for k in specs.FIELDS for p, kind, fl in specs.fields(k)], [""] * 6))
def field_specs(spark, d):  # noqa: ANN001, ANN201
    rows = spark.createDataFrame([(k, *line) for k in specs.FIELDS for line in specs.fields(k)], "document_type string, path string, kind string, flags string")
    return rows.select("document_type", "path", "kind", *(F.col("flags").contains(x).alias(n) for x, n in (("R", "is_required"), ("C", "is_critical"))), (~F.col("flags").contains("N")).alias("groundable"))


@vector("snk02_flatten_export", values_sql(["invoice_number", "supplier_name", "n_items", "empty_items"], [("2024-001", "ACME s.r.o.", 2, "")], ["", "", "INTEGER", ""]))
def flatten_export(spark, d):  # noqa: ANN001, ANN201
    both = [payloads(spark, "invoice", [p]).select(*paths.for_export(F.col("data"), specs.fields("invoice"))) for p in (INVOICE, _but(INVOICE, line_items=[]))]
    a, b = (x.select("invoice_number", F.col("`supplier.name`").alias("supplier_name"), F.col("line_items").alias("items")) for x in both)
    return a.join(b.select("invoice_number", F.col("items").alias("empty_items")), "invoice_number").select("invoice_number", "supplier_name", F.size(F.from_json("items", "array<string>")).alias("n_items"), "empty_items")


@query("snk03_header_union", "SELECT 'p' AS kind, n_name AS name, NULL::DOUBLE AS balance FROM nation UNION ALL SELECT 's', s_name, s_acctbal FROM supplier")
def header_union(spark, d):  # noqa: ANN001, ANN201
    left = _t(spark, d, "nation").select(F.lit("p").alias("kind"), F.col("n_name").alias("name"))
    right = _t(spark, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return sinks.header_union([left, right])


# ---- classification ----


def _evidence_sql(key: str) -> str:
    q = lambda s: s.replace("'", "''")
    kw, pat, neg = specs.HINTS[key]
    parts = [f"CASE WHEN contains(folded, strip_accents('{q(k)}')) THEN {w} ELSE 0 END" for k, w in kw.items()]
    parts += [f"CASE WHEN regexp_matches(low, '{q(p)}') THEN {w} ELSE 0 END" for p, w in pat.items()]
    parts += [f"CASE WHEN contains(folded, strip_accents('{q(k)}')) THEN -{w} ELSE 0 END" for k, w in neg.items()]
    return f"greatest(0, CAST({' + '.join(parts)} AS DOUBLE))"


_SCORES = ", ".join(f"round({_evidence_sql(k)} / ({_evidence_sql(k)} + 4.0), 6) AS {k}" for k in specs.TIE_ORDER)
CLASSIFY_SQL = f"""WITH s AS (SELECT doc_id, lower(substr(text, 1, 6000)) AS low, strip_accents(lower(substr(text, 1, 6000))) AS folded FROM documents),
e AS (SELECT doc_id, {_SCORES} FROM s),
u AS (SELECT doc_id, unnest([{', '.join(f"{{'k': '{k}', 'o': {i}, 's': {k}}}" for i, k in enumerate(specs.TIE_ORDER))}], recursive := true) FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, o) AS n, lead(s) OVER (PARTITION BY doc_id ORDER BY s DESC, o) AS second FROM u)
SELECT doc_id, CASE WHEN s <= 0 THEN 'generic' ELSE k END AS document_type, CASE WHEN s <= 0 THEN 0.0 WHEN s - second < 0.15 THEN round(least(s, 0.5 + s - second), 4) ELSE round(s, 4) END AS type_confidence FROM r WHERE n = 1"""


@query("cls01_02_classify", CLASSIFY_SQL)
def classify(spark, d):  # noqa: ANN001, ANN201
    return extract.classify(_t(spark, d, "documents").select("doc_id", "text")).select("doc_id", "document_type", "type_confidence")


INVOICE_TEXT = "\n".join([
    "ACME Supplies s.r.o.", "Faktura č. 2024-0042", "IČO: 27074358   DIČ: CZ27074358", "Datum vystavení: 15. března 2024", "Datum splatnosti:", "", "29.03.2024", "Variabilní symbol: 20240042", "Základ daně 33 000,00", "DPH 21%: 6 930,00", "Celkem k úhradě: 39 930,00 Kč", "IBAN CZ65 0800 0000 1920 0014 5399", "Číslo účtu: 19-2000145399/0800",
])
RECEIPT_TEXT = "\n".join(["Corner Shop", "Receipt no: R-77", "Date: 2024-05-30", "Total 120.50 EUR", "VAT 21% 20.91", "Thank you for your purchase", "card payment"])
CONTRACT_TEXT = "\n".join(["Agreement title: Office lease", "This Agreement is made between the parties", "Effective date: 01/02/2024", "Expiration date: 31/12/2024", "Notice period: 30 days", "Governing law: Czech Republic", "Clause 4 Termination"])
ORDER_TEXT = "\n".join(["Purchase order number: PO-991", "Order date: 2024-04-02", "Ship to: Prague depot", "Requested delivery: 2024-04-20", "Order total: 1,250.00", "Currency: USD"])
NOTE_TEXT = "A short note about nothing in particular."
TEXTS = [INVOICE_TEXT, RECEIPT_TEXT, CONTRACT_TEXT, ORDER_TEXT, NOTE_TEXT]
KINDS = ["invoice", "receipt", "contract", "purchase_order", "generic"]
EXTRACTED = [
    (0, "invoice_number", ". 2024-0042"), (0, "issue_date", "2024-03-15"), (0, "due_date", "2024-03-29"), (0, "subtotal", "33000"), (0, "tax_amount", "6930"), (0, "total", "39930"), (0, "currency", "CZK"), (0, "variable_symbol", "20240042"),
    (0, "bank_details.iban", "CZ6508000000192000145399"), (0, "bank_details.account_number", "19-2000145399/0800"), (0, "supplier.vat_id", "CZ27074358"), (0, "supplier.registration_id", "27074358"), (0, "supplier.name", "ACME Supplies s.r.o."),
    (1, "receipt_number", "R-77"), (1, "purchase_date", "2024-05-30"), (1, "total", "120.5"), (1, "tax_amount", "20.91"), (1, "currency", "EUR"), (1, "merchant_name", "Corner Shop"),
    (2, "title", "Office lease"), (2, "effective_date", "2024-02-01"), (2, "expiration_date", "2024-12-31"), (2, "notice_period_days", "30"), (2, "governing_law", "Czech Republic"),
    (3, "po_number", "PO-991"), (3, "order_date", "2024-04-02"), (3, "delivery_address", "Prague depot"), (3, "requested_delivery_date", "2024-04-20"), (3, "total", "1250"), (3, "currency", "USD"),
]


def _texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").withColumn("text", text.clean_text(F.col("text")))


@vector("cls02_samples", values_sql(["doc_id", "document_type"], list(enumerate(KINDS)), ["INTEGER", ""]))
def classify_samples(spark, d):  # noqa: ANN001, ANN201
    return extract.classify(_texts(spark)).select("doc_id", "document_type")


@vector("cls03_04_cascade", values_sql(["n", "document_type", "confidence", "method"], [(0, "receipt", 1.0, "explicit"), (1, "invoice", 0.8, "heuristic"), (2, "contract", 1.0, "model"), (3, "generic", 0.3, "model"), (4, "invoice", 0.4, "heuristic")], ["INTEGER", "", "DOUBLE", ""]))
def cascade(spark, d):  # noqa: ANN001, ANN201
    rows = [(0, "receipt", "invoice", 0.9, None, None), (1, None, "invoice", 0.8, "contract", 0.9), (2, None, "invoice", 0.4, "contract", 1.7), (3, None, "invoice", 0.4, "alien", 0.9), (4, None, "invoice", 0.4, None, None)]
    df = spark.createDataFrame(rows, "n int, explicit string, heuristic string, c double, model string, mc double")
    return df.select("n", F.inline(F.array(extract.escalate(*(F.col(c) for c in ("explicit", "heuristic", "c", "model", "mc"))))))


@vector("cls06_hints", values_sql(["document_type", "part", "term", "weight"], [(k, p, t, w) for k, parts in specs.HINTS.items() for p, m in zip(("keyword", "pattern", "negative"), parts, strict=True) for t, w in m.items()], ["", "", "", "DOUBLE"]))
def hints(spark, d):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(k, p, t, float(w)) for k, parts in specs.HINTS.items() for p, m in zip(("keyword", "pattern", "negative"), parts, strict=True) for t, w in m.items()], "document_type string, part string, term string, weight double")


@vector("ext01_07_extract", values_sql(["doc_id", "path", "value"], EXTRACTED, ["INTEGER", "", ""]))
def extract_samples(spark, d):  # noqa: ANN001, ANN201
    rows, out = _texts(spark), None
    for i, key in enumerate(KINDS):
        part = extract.extract(rows.where(F.col("doc_id") == i), key)
        out = part if out is None else out.unionByName(part)
    return out.select("doc_id", F.explode("values").alias("path", "value"))


@vector("ext06_rules", values_sql(["document_type", "path", "kind", "n_labels"], [(k, r[0], r[1], len(r[2])) for k, rs in specs.EXTRACT.items() for r in rs], ["", "", "", "INTEGER"]))
def extraction_rules(spark, d):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(k, r[0], r[1], r[2]) for k, rs in specs.EXTRACT.items() for r in rs], "document_type string, path string, kind string, labels array<string>").select("document_type", "path", "kind", F.size("labels").alias("n_labels"))


@query("ext09_repair_choice", "SELECT user_id, arg_min(event_id, (event_id % 5, attempt)) AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events) WHERE attempt <= 2 GROUP BY user_id")
def repair_choice(spark, d):  # noqa: ANN001, ANN201
    """Of the first answer and its one repair the one with fewer errors; the first at a tie."""
    e = _t(spark, d, "events").withColumn("attempt", F.expr("row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)")).where("attempt <= 2")
    return e.groupBy("user_id").agg(F.min_by("event_id", F.struct(F.col("event_id") % 5, "attempt")).alias("chosen"))


# ---- confidence ----

_SIGNALS = [(1.0, 1.0, 1.0, 0.95, 0.9938), (1.0, 1.0, 1.0, 0.65, 0.9563), (0.75, 1.0, 1.0, 0.95, 0.8688), (0.40, 1.0, 1.0, 0.95, 0.6938), (0.10, 1.0, 1.0, 0.95, 0.5438), (1.0, 1.0, 0.45, 0.95, 0.8906), (1.0, 1.0, 0.05, 0.95, 0.8156), (None, 1.0, 1.0, 0.95, 0.9875), (None, None, None, None, 0.60)]


@vector("cnf02_03_weighted", values_sql(["n", "near", "band"], [(i, True, "high" if s[4] >= 0.85 else "medium" if s[4] >= 0.6 else "low") for i, s in enumerate(_SIGNALS)], ["INTEGER", "", ""]))
def weighted(spark, d):  # noqa: ANN001, ANN201
    rows = spark.createDataFrame([(i, *s) for i, s in enumerate(_SIGNALS)], "n int, g double, f double, v double, c double, expected double")
    score = confidence.weighted({"grounding": F.col("g"), "format": F.col("f"), "validation": F.col("v"), "context": F.col("c")})
    return rows.select("n", (F.abs(score - F.col("expected")) < 0.0001).alias("near"), confidence.band(score).alias("band"))


_GROUND = [("39 930,00", 1.0), ("12", 1.0), ("ACME Widgets", 0.40), ("2024-03-15", 0.75), ("zebra", 0.10), ("", 0.10), (None, 0.10), ("99", 1.0)]


@vector("cnf01_grounding", values_sql(["n", "score"], [(i, s) for i, (_, s) in enumerate(_GROUND)], ["INTEGER", "DOUBLE"]))
def grounding(spark, d):  # noqa: ANN001, ANN201
    rows = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(_GROUND)], "n int, value string").withColumn("key", text.match_key(F.lit("ACME s.r.o. 15. března 2024, total 39 930,00 ref 3120")))
    return rows.select("n", confidence.grounding(F.col("value"), F.col("key")).cast("double").alias("score"))


_FORMATS = [("2024-03-15", "date", 1.0), ("15.03.2024", "date", 0.8), ("03/04/2024", "date", 0.5), ("x", "date", 0.1), ("12,50", "money", 1.0), ("abc", "money", 0.1), ("Kč", "currency", 1.0), ("?", "currency", 0.1), ("", "string", 0.1), ("x", "string", 0.4), ("xy", "text", 1.0), ("lease", "enum", 1.0)]


@vector("cnf04_format_signal", values_sql(["n", "signal"], [(i, s) for i, (_, _, s) in enumerate(_FORMATS)], ["INTEGER", "DOUBLE"]))
def formats(spark, d):  # noqa: ANN001, ANN201
    rows = spark.createDataFrame([(i, v, k) for i, (v, k, _) in enumerate(_FORMATS)], "n int, value string, kind string")
    return rows.select("n", confidence.format_signal(F.col("value"), F.col("kind")).cast("double").alias("signal"))


@query("cnf05_06_signals", "SELECT doc_id, CASE WHEN toxic = 1 THEN 0.05 WHEN quality = 0 THEN 0.45 ELSE 1.0 END::DOUBLE AS validation, CASE WHEN doc_id % 2 = 0 THEN 0.65 ELSE 0.95 END::DOUBLE AS context FROM labels")
def signals(spark, d):  # noqa: ANN001, ANN201
    severity = F.when(F.col("toxic") == 1, "error").when(F.col("quality") == 0, "warning")
    return _t(spark, d, "labels").select("doc_id", confidence.validation_signal(severity).cast("double").alias("validation"), confidence.context_signal(F.col("doc_id") % 2 == 0).cast("double").alias("context"))


_AGREE = [("1210.00", "1 210,00", 1.0), ("ACME s.r.o.", "acme sro", 1.0), ("5", "6", 0.25), ("x", None, None)]


@vector("cnf07_agreement", values_sql(["n", "signal"], [(i, s) for i, (_, _, s) in enumerate(_AGREE)], ["INTEGER", "DOUBLE"]))
def agreed(spark, d):  # noqa: ANN001, ANN201
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(_AGREE)], "n int, value string, baseline string")
    return rows.select("n", confidence.agreement_signal(F.col("value"), F.col("baseline")).cast("double").alias("signal"))


@query("cnf08_12_documents", "SELECT user_id AS doc_id, round(least(avg(s), min(s) FILTER (event_type = 'purchase')), 4) AS overall, count(*) FILTER (s >= 0.85) AS high, count(*) FILTER (s >= 0.6 AND s < 0.85) AS medium, count(*) FILTER (s < 0.6) AS low FROM (SELECT *, (event_id % 101) / 100.0 AS s FROM events) GROUP BY 1")
def document_scores(spark, d):  # noqa: ANN001, ANN201
    s = F.least(F.lit(1.01), (F.col("event_id") % 101) / F.lit(100.0))
    rows = _t(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.when(F.col("event_type") == "purchase", "R").otherwise("").alias("flags"), s.alias("score"), confidence.band(s).alias("band"))
    return confidence.document_scores(rows)


@vector("cnf13_display_order", values_sql(["path", "place"], [("total", 0), ("supplier.name", 1), ("notes", 2), ("currency", 3), ("a.b", 4)], ["", "INTEGER"]))
def display(spark, d):  # noqa: ANN001, ANN201
    rows = spark.createDataFrame([("a.b", False, False), ("currency", False, True), ("notes", True, False), ("supplier.name", True, True), ("total", True, True)], "path string, review boolean, required boolean")
    one = rows.agg(F.sort_array(F.collect_list(confidence.display_order(F.col("path"), F.col("review"), F.col("required")))).alias("all"))
    return one.select(F.posexplode("all").alias("place", "s")).select("s.path", "place")


def records(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """From texts to routed records: clean, classify, extract, check, score, route.

    docs (doc_id, text) -> (doc_id, document_type, leaves, issues, fields, overall, reasons).
    Everything about a document is computed in its row, in one pass over the texts, which are dealt over all cores first.
    Each step holds all types' expressions, and a row takes its own type's branch.
    """
    docs = spread(docs.select("doc_id", "text"))
    rows = extract.classify(docs.select("doc_id", text.clean_text(F.col("text")).alias("text"))).select("doc_id", "text", "document_type")
    rows = extract.with_lines(rows).withColumn("source_key", text.match_key(F.col("text")))
    own = lambda k, c: F.when(F.col("document_type") == k, c)
    keys = [*specs.FIELDS]
    raw = {k: [f"{k}_{i}" for i in range(len(specs.EXTRACT[k]))] for k in keys}
    rows = rows.withColumns({n: own(k, c) for k in keys for n, c in zip(raw[k], extract.raw_values(k), strict=True)})
    rows = rows.withColumn("values", F.coalesce(*(own(k, extract.value_map(k, [F.col(n) for n in raw[k]])) for k in keys)))
    rows = rows.select("doc_id", "document_type", "source_key", *(own(k, extract.payload(F.col("values"), k)).alias(f"data_{k}") for k in keys))
    plain = {k: [x for x in specs.fields(k) if "[]" not in x[0]] for k in keys}
    leaves = F.coalesce(*(own(k, F.filter(paths.leaves(F.col(f"data_{k}"), plain[k]), lambda x: x["value"].isNotNull())) for k in keys))
    issues = F.coalesce(*(own(k, rules.issues(k, F.col(f"data_{k}"), TODAY)) for k in keys))
    rows = rows.select("doc_id", "document_type", "source_key", leaves.alias("leaves"), issues.alias("issues"))
    rows = rows.withColumn("fields", F.transform("leaves", lambda x: confidence.scored(x, F.col("issues"), F.col("source_key"))))
    rows = rows.withColumn("overall", confidence.overall(F.col("fields")))
    rows = rows.withColumn("reasons", F.coalesce(*(own(k, confidence.reasons(k, F.col("issues"), F.col("overall"), F.col("fields"))) for k in keys)))
    return rows.select("doc_id", "document_type", "leaves", "issues", "fields", "overall", "reasons")


def processed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, document_type, overall, n_fields, errors, needs_review, reasons)."""
    rows = records(spark, docs)
    return rows.select("doc_id", "document_type", "overall", F.size("fields").alias("n_fields"), F.size(F.filter("issues", lambda i: i["severity"] == "error")).alias("errors"), (F.size("reasons") > 0).alias("needs_review"), "reasons")


def graded_fields(spark: SparkSession, both: DataFrame) -> DataFrame:
    """Fields of records beside a labelled corpus (doc_id, document_type, difficulty, expected map, leaves, fields), by the fields of the true type.

    A document's fields meet in its row, so nothing but the specification is joined.
    """
    spec = [(k, p, kind, "R" in flags, "C" in flags) for k in specs.FIELDS for p, kind, flags in specs.fields(k)]
    known = spark.createDataFrame(spec, "document_type string, template string, kind string, is_required boolean, is_critical boolean")
    none = lambda t: F.create_map().cast(t)
    expected = F.coalesce("expected", none("map<string,string>"))
    actual = F.coalesce(F.map_from_entries(F.transform("leaves", lambda x: F.struct(x["path"], x["value"]))), none("map<string,string>"))
    scores = F.coalesce(F.map_from_entries(F.transform("fields", lambda x: F.struct(x["path"], x["score"]))), none("map<string,double>"))
    rows = both.select("doc_id", "document_type", F.col("difficulty").alias("tags"), expected.alias("expected"), actual.alias("actual"), scores.alias("scores"))
    at = lambda m, p: F.try_element_at(F.col(m), p)
    each = F.transform(F.array_union(F.map_keys("expected"), F.map_keys("actual")), lambda p: F.struct(p.alias("path"), at("expected", p).alias("expected"), at("actual", p).alias("actual"), at("scores", p).alias("confidence"), paths.template(p).alias("template")))
    rows = rows.select("doc_id", "document_type", "tags", F.inline_outer(each)).where("path is not null")
    return evaluation.graded(rows.join(F.broadcast(known), ["document_type", "template"]))  # the specification has tens of rows


@vector("cnf09_11_flagship_samples", values_sql(["doc_id", "document_type", "errors", "needs_review"], [(0, "invoice", 0, False), (1, "receipt", 0, False), (2, "contract", 2, True), (3, "purchase_order", 0, False), (4, "generic", 0, True)], ["INTEGER", "", "INTEGER", ""]))
def flagship_samples(spark, d):  # noqa: ANN001, ANN201
    return processed(spark, _texts(spark)).select("doc_id", "document_type", "errors", "needs_review")


@query("evl23_process_documents")
def process_documents(spark, d):  # noqa: ANN001, ANN201
    """The whole record pipeline over the documents table."""
    return processed(spark, _t(spark, d, "documents").select("doc_id", "text")).drop("reasons")


def baseline_report(spark: SparkSession, truth: DataFrame) -> DataFrame:
    """One row of accuracy and rates of the rules over a labelled corpus (doc_id, document_type, text, expected, difficulty)."""
    truth = spread(truth)
    done = records(spark, truth.select("doc_id", "text")).select("doc_id", F.col("document_type").alias("found"), "leaves", "fields", F.exists("issues", lambda i: i["severity"] == "error").alias("wrong"))
    # the sizes of texts and maps are guessed from their ids': a join that fits itself into memory by that guess does not
    both = storage.written(truth.drop("text").hint("merge").join(done.hint("merge"), "doc_id"), "records")
    fact = storage.written(graded_fields(spark, both), "graded")
    rates = both.agg(F.count("*").alias("documents"), F.round(F.avg((F.col("found") == F.col("document_type")).cast("int")), 4).alias("classification_accuracy"), F.round(F.avg(F.col("wrong").cast("int")), 4).alias("review_rate"))
    success = evaluation.document_success(fact).agg(F.round(F.avg(F.col("success").cast("int")), 4).alias("document_success_rate"))
    return evaluation.accuracy(fact).crossJoin(rates).crossJoin(success)  # one row each
