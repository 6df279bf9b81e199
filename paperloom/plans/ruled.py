"""Rules and paths over payloads written from orders: what is wrong with each follows from its number, and so does the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import paths, rules
from paperloom.session import spread

from . import kernels, specs
from .kernels import ways
from .records import TODAY
from .registry import query
from .relational import _t

K = "o_orderkey"


def every(n: int, yes: Column | str | None, no: Column | str | None = None, rest: int = 0) -> Column:
    """`yes` where the order's number leaves `rest` by n."""
    lit = lambda x: F.lit(x) if x is None or isinstance(x, str) else x
    return F.when(F.col(K) % n == rest, lit(yes)).otherwise(lit(no))


def orders(spark: SparkSession, d: str) -> DataFrame:
    """(o_orderkey, c_custkey, date, price, tax): price and tax with two places."""
    p = F.col("o_totalprice").cast("decimal(16,2)")
    rows = spread(_t(spark, d, "orders")).select(K, F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus"), F.to_date("o_orderdate").alias("date"), p.alias("price"))
    return rows.withColumn("tax", F.round(F.col("price") * F.lit("0.21").cast("decimal(3,2)"), 2).cast("decimal(16,2)")).withColumn("total", (F.col("price") + F.col("tax")).cast("decimal(17,2)"))


def struct(**parts: Column | str | None) -> Column:
    """A struct of text fields."""
    return F.struct(*((F.lit(v) if v is None or isinstance(v, str) else v).alias(k) for k, v in parts.items()))


def text(c: str | Column, by: float | int = 1) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (c if by == 1 else (c * by)).cast("decimal(20,2)").cast("string")


def date(shift: int = 0) -> Column:
    return F.date_add("date", shift).cast("string")


def items(*each: Column) -> Column:
    return F.array(*each)


def payload(rows: DataFrame, key: str, made: Column) -> DataFrame:
    """(o_orderkey, json, data) of a type from a struct column."""
    return rows.select(K, F.to_json(made).alias("json")).withColumn("data", F.from_json("json", specs.schema(key)))


def rule(name: str, key: str, rule_id: str, made: Callable[[], Column], *found: tuple[str, str, str, str]) -> None:
    """Register one rule over all orders; found: (condition on o_orderkey as k and o_custkey as c, code, severity, path)."""
    parts = (f"SELECT k AS doc_id, '{code}' AS code, '{severity}' AS severity, '{path}' AS field_path FROM o WHERE {where}" for where, code, severity, path in found)
    sql = "WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders) " + " UNION ALL ".join(parts)

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = payload(orders(spark, d), key, made())
        return rows.select(F.col(K).alias("doc_id"), F.inline_outer(rules.issues(key, F.col("data"), TODAY, [rule_id]))).where("code is not null").select("doc_id", "code", "severity", "field_path")

    query(name, sql)(run)


E, W, I = "error", "warning", "info"  # noqa: E741
MISSING = "missing_required_field"


def invoice(**changes: Column | None) -> Column:
    """A sound invoice with some fields changed."""
    base = {
        "invoice_number": F.concat(F.lit("INV-"), F.col(K).cast("string")), "supplier": struct(name="Order Desk"), "customer": struct(name=F.concat(F.lit("Customer "), F.col("c_custkey").cast("string"))), "issue_date": date(), "due_date": date(30), "currency": F.lit("EUR"),
        "subtotal": text("price"), "tax_amount": text("tax"), "total": text("total"),
    }
    return struct(**(base | changes))


rule(
    "val01_required_fields", "invoice", "required_fields",
    lambda: invoice(
        invoice_number=every(5, None, F.col(K).cast("string")), supplier=F.when(F.col(K) % 7 != 1, struct(name=every(7, " ", "Order Desk"), vat_id="CZ27074358")), total=every(11, None, text("total")),
        line_items=items(struct(description="a", quantity="1"), struct(description=every(3, None, "b"), quantity="2")),
    ),
    ("k % 5 = 0", MISSING, E, "invoice_number"), ("k % 7 = 0", MISSING, E, "supplier.name"), ("k % 11 = 0", MISSING, E, "total"), ("k % 3 = 0", MISSING, E, "line_items.1.description"),
)
rule(
    "val03_invoice_totals", "invoice", "invoice_totals_consistency",
    lambda: invoice(
        total=ways(K, text("total"), text(F.col("total") + F.lit("0.50").cast("decimal(3,2)")), text("total", 1.01), text("total", 2), text("price", 0.5), text("tax", 0.5), text("total"), text("total")),
        tax_amount=every(8, None, text("tax"), 4), subtotal=every(8, None, text("price"), 5), tax_rate=every(8, "15", "21", 6), amount_due=every(8, text("total", 2), None, 7),
    ),
    ("k % 8 = 1", "totals_mismatch", I, "total"), ("k % 8 = 2", "totals_mismatch", W, "total"), ("k % 8 = 3", "totals_mismatch", E, "total"), ("k % 8 = 4", "subtotal_exceeds_total", E, "subtotal"), ("k % 8 = 5", "tax_exceeds_total", E, "tax_amount"),
    ("k % 8 = 6", "tax_rate_mismatch", W, "tax_rate"), ("k % 8 = 7", "amount_due_exceeds_total", W, "amount_due"),
)


def _sums(**more: Column) -> Column:
    return struct(subtotal=text("price"), tax_amount=text("tax"), **more)


rule("val04_po_totals", "purchase_order", "po_totals_consistency", lambda: _sums(total=every(2, text("total", 2), text("total"))), ("k % 2 = 0", "totals_mismatch", E, "total"))
rule("val04_receipt_totals", "receipt", "receipt_totals_consistency", lambda: _sums(total=every(3, text("total", 1.01), text("total"))), ("k % 3 = 0", "totals_mismatch", W, "total"))
rule(
    "val06_positive_amounts", "invoice", "positive_amounts", lambda: invoice(total=every(4, F.concat(F.lit("-"), text("total")), text("total")), line_items=items(struct(description="a", unit_price="1"), struct(description="b", unit_price=every(6, "(3)", "3")))),
    ("k % 4 = 0", "negative_amount", W, "total"), ("k % 6 = 0", "negative_amount", W, "line_items.1.unit_price"),
)
rule("val07_invoice_dates", "invoice", "invoice_date_order", lambda: invoice(due_date=ways(K, date(-5), date(400), date(30))), ("k % 3 = 0", "date_order_violation", E, "due_date"), ("k % 3 = 1", "implausible_payment_term", W, "due_date"))
rule("val08_po_dates", "purchase_order", "po_date_order", lambda: struct(order_date=date(), requested_delivery_date=every(2, date(-1), date(9))), ("k % 2 = 0", "date_order_violation", E, "requested_delivery_date"))
rule(
    "val09_contract_dates", "contract", "contract_date_order",
    lambda: struct(effective_date=date(), expiration_date=every(4, date(-1), F.add_months("date", 12).cast("string")), signature_date=every(4, date(400), date(-3), 1), term_months=ways(K, "0", "12", "24", "12")),
    ("k % 4 = 0", "date_order_violation", E, "expiration_date"), ("k % 4 = 1", "date_order_violation", W, "expiration_date"), ("k % 4 = 2", "term_span_mismatch", W, "term_months"),
)
rule(
    "val10_date_sanity", "invoice", "date_sanity", lambda: invoice(due_date=ways(K, "soon", date(30), "2040-01-01", date(30)), issue_date=every(4, "1980-01-01", date(), 1)),
    ("k % 4 = 0", "unparseable_date", E, "due_date"), ("k % 4 = 1", "implausible_date", E, "issue_date"), ("k % 4 = 2", "implausible_date", E, "due_date"),
)
rule("val11_date_not_future", "receipt", "date_not_future", lambda: struct(purchase_date=ways(K, "2024-06-03", "2024-06-02", date())), ("k % 3 = 0", "future_date", W, "purchase_date"))
rule("val12_currency", "invoice", "currency_supported", lambda: invoice(currency=ways(K, "Kč", "XYZ", "eur", None)), ("k % 4 = 1", "unsupported_currency", E, "currency"))
rule("val13_iban", "invoice", "iban_checksum", lambda: invoice(bank_details=struct(iban=kernels._iban())), ("c % 6 IN (2, 3, 4)", "invalid_iban", E, "bank_details.iban"))
rule("val14_account", "invoice", "czech_account_checksum", lambda: invoice(bank_details=struct(account_number=kernels._account())), ("c % 5 IN (2, 3)", "invalid_account_number", E, "bank_details.account_number"))
rule("val15_ico", "invoice", "ico_checksum", lambda: invoice(supplier=struct(name="x", registration_id=kernels._ico())), ("c % 4 = 1", "invalid_registration_id", W, "supplier.registration_id"))
rule("val15_ico_parties", "contract", "ico_checksum", lambda: struct(parties=items(struct(name="a", registration_id="27074358"), struct(name="b", registration_id=kernels._ico()))), ("c % 4 = 1", "invalid_registration_id", W, "parties.1.registration_id"))
rule("val16_vat", "invoice", "vat_id_format", lambda: invoice(supplier=struct(name="x", vat_id=kernels._vat())), ("c % 8 IN (2, 5, 6)", "implausible_vat_id", W, "supplier.vat_id"))
rule(
    "val17_variable_symbol", "invoice", "variable_symbol_format", lambda: invoice(variable_symbol=ways(K, F.concat(F.col(K).cast("string"), F.lit("a")), F.lpad(F.col(K).cast("string"), 11, "1"), F.col(K).cast("string"))),
    ("k % 3 = 0", "non_numeric", W, "variable_symbol"), ("k % 3 = 1", "too_long", W, "variable_symbol"),
)
rule("val18_parties", "contract", "contract_parties_min", lambda: struct(title="x", parties=ways(K, F.lit(None), items(struct(name="a")), items(struct(name="a"), struct(name="b")))), ("k % 3 < 2", "insufficient_parties", E, "parties"))
rule(
    "val19_renewal", "contract", "contract_renewal_consistency", lambda: struct(auto_renewal=every(4, "false", "true", 2), notice_period_days=ways(K, None, "900", "30", "30")),
    ("k % 4 = 0", "missing_notice_period", W, "notice_period_days"), ("k % 4 = 1", "implausible_notice_period", W, "notice_period_days"), ("k % 4 = 2", "notice_without_renewal", I, "auto_renewal"),
)


@query("val05_line_items_sum", """WITH l AS (SELECT l_orderkey, list_sort(list({'n': l_linenumber, 'p': 'part ' || l_partkey, 'q': CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 'a': CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS VARCHAR)})) AS x, sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS s FROM lineitem GROUP BY 1),
m AS (SELECT l_orderkey AS doc_id, s, CAST(x[1].a AS DECIMAL(14,2)) AS first FROM l WHERE l_orderkey % 3 = 0),
g AS (SELECT *, first / greatest(s + first, 1) AS share FROM m)
SELECT doc_id, 'line_total_mismatch' AS code, 'warning' AS severity, 'line_items.0.line_total' AS field_path FROM g
UNION ALL SELECT doc_id, 'line_items_subtotal_mismatch', CASE WHEN share > 0.02 THEN 'error' ELSE 'warning' END, 'subtotal' FROM g WHERE doc_id % 5 <> 0 AND first > greatest(1, 0.005 * (s + first))""")
def line_items(spark: SparkSession, d: str) -> DataFrame:
    """Line totals against quantity and price, and their sum against the subtotal; some first lines are doubled, some last ones have no total."""
    price = F.col("l_extendedprice").cast("decimal(14,2)")
    line = F.struct(F.col("l_linenumber").alias("n"), F.concat(F.lit("part "), "l_partkey").alias("description"), F.col("l_quantity").cast("long").cast("string").alias("quantity"), price.cast("string").alias("amount"), (price / F.col("l_quantity").cast("decimal(10,0)")).cast("decimal(16,4)").cast("string").alias("unit_price"))
    rows = spread(_t(spark, d, "lineitem"), "l_orderkey").groupBy(F.col("l_orderkey").alias(K)).agg(F.sort_array(F.collect_list(line)).alias("lines"), F.sum(price).cast("string").alias("sum"))  # seven lines at most
    doubled = lambda x, i: F.when((F.col(K) % 3 == 0) & (i == 0), (x["amount"].cast("decimal(16,2)") * 2).cast("string")).otherwise(x["amount"])
    listed = F.transform("lines", lambda x, i: F.struct(x["description"].alias("description"), x["quantity"].alias("quantity"), x["unit_price"].alias("unit_price"), doubled(x, i).alias("line_total")))
    extra = F.when(F.col(K) % 5 == 0, F.array(struct(description="no total", quantity=None, unit_price=None, line_total=None))).otherwise(F.array().cast("array<struct<description:string,quantity:string,unit_price:string,line_total:string>>"))
    rows = payload(rows, "invoice", struct(subtotal=F.col("sum"), line_items=F.concat(listed, extra)))
    return rows.select(F.col(K).alias("doc_id"), F.inline_outer(rules.issues("invoice", F.col("data"), TODAY, ["line_items_sum"]))).where("code is not null").select("doc_id", "code", "severity", "field_path")


@query("val20_summary", "SELECT o_orderkey AS doc_id, CAST(CAST(o_orderkey % 2 = 0 AS INTEGER) + CAST(o_orderkey % 3 = 0 AS INTEGER) AS INTEGER) AS errors, CAST(o_orderkey % 5 = 0 AS INTEGER) AS warnings, o_orderkey % 2 <> 0 AND o_orderkey % 3 <> 0 AS is_valid, CAST(CAST(o_orderkey % 2 = 0 AS INTEGER) + CAST(o_orderkey % 3 = 0 AS INTEGER) + CAST(o_orderkey % 5 = 0 AS INTEGER) AS INTEGER) AS n_paths FROM orders")
def summary(spark, d):  # noqa: ANN001, ANN201
    """All rules of a type over every order, summed up."""
    made = invoice(total=every(2, None, text("total")), currency=every(3, "XYZ", "EUR"), variable_symbol=every(5, "x1", "1"))
    rows = payload(orders(spark, d), "invoice", made)
    return rules.summary(rows.select(F.col(K).alias("doc_id"), rules.issues("invoice", F.col("data"), TODAY).alias("issues"))).select("doc_id", "errors", "warnings", "is_valid", F.size("paths").alias("n_paths"))


_RULES = ", ".join(f"('{k}', {n}, {i}, '{r}')" for n, (k, rs) in enumerate(specs.RULES.items()) for i, r in enumerate(rs))


@query("val21_rule_sets", f"SELECT document_type, CAST(place AS INTEGER) AS place, rule_id, count(*) AS documents FROM orders JOIN (VALUES {_RULES}) AS v(document_type, n, place, rule_id) ON o_orderkey % 5 = n GROUP BY 1, 2, 3")
def rule_sets(spark, d):  # noqa: ANN001, ANN201
    """The rules that each document's type has, in order, and how many documents each of them checks."""
    sets = F.create_map(*(x for k, rs in specs.RULES.items() for x in (F.lit(k), F.array(*(F.lit(r) for r in rs)))))
    docs = _t(spark, d, "orders").select(ways(K, *specs.RULES).alias("document_type"))
    each = docs.select("document_type", F.posexplode(F.element_at(sets, F.col("document_type"))).alias("place", "rule_id"))
    return each.groupBy("document_type", "place", "rule_id").agg(F.count("*").alias("documents"))


# ---- paths ----


def listed() -> Column:
    """An invoice with as many lines as its number leaves by 3."""
    line = lambda i: struct(description=F.concat(F.lit(f"line {i} of "), F.col(K).cast("string")), quantity=(F.col(K) % 7 + i).cast("string"))
    return invoice(line_items=F.slice(items(line(0), line(1)), F.lit(1), (F.col(K) % 3).cast("int")))


def invoices(spark: SparkSession, d: str) -> DataFrame:
    return payload(orders(spark, d), "invoice", listed())


_PLAIN = """SELECT k, unnest(['invoice_number', 'supplier.name', 'customer.name', 'issue_date', 'due_date', 'currency', 'subtotal', 'tax_amount', 'total']) AS path,
  unnest(['INV-' || k, 'Order Desk', 'Customer ' || c, strftime(day, '%Y-%m-%d'), strftime(day + 30, '%Y-%m-%d'), 'EUR', CAST(p AS VARCHAR), CAST(t AS VARCHAR), CAST(p + t AS VARCHAR)]) AS value
FROM (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(16,2)) AS p, CAST(round(CAST(o_totalprice AS DECIMAL(16,2)) * 0.21, 2) AS DECIMAL(16,2)) AS t FROM orders)"""
_LINES = "SELECT o_orderkey AS k, 'line_items.' || i || '.' || f AS path, CASE f WHEN 'description' THEN 'line ' || i || ' of ' || o_orderkey ELSE CAST(o_orderkey % 7 + i AS VARCHAR) END AS value FROM orders, range(2) AS r(i), (VALUES ('description'), ('quantity')) AS v(f) WHERE i < o_orderkey % 3"


@query("pth03_04_flatten", f"SELECT k AS doc_id, path, value FROM ({_PLAIN}) UNION ALL SELECT k, path, value FROM ({_LINES})")
def flatten(spark, d):  # noqa: ANN001, ANN201
    rows = invoices(spark, d).select(F.col(K).alias("doc_id"), "data")
    return paths.flatten(rows, specs.fields("invoice")).select("doc_id", "path", "value")


@query("pth04_flatten_json", """SELECT event_id AS doc_id, unnest(['id', 'p.k', 'l.0', 'l.1', 'l.2.v.0']) AS path, unnest([CAST(event_id AS VARCHAR), props->>'k', 'x', NULL, event_type]) AS value FROM events""")
def flatten_json(spark, d):  # noqa: ANN001, ANN201
    raw = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"p":'), "props", F.lit(',"none":{},"few":[],"l":["x",null,{"v":["'), "event_type", F.lit('"]}]}'))
    return paths.flatten_json(spread(_t(spark, d, "events")).select(F.col("event_id").alias("doc_id"), raw.alias("json")), 5)


@query("pth05_06_templates", "SELECT l_orderkey, l_linenumber, 'line_items[].taxes[].rate' AS template, 'line_items.' || l_linenumber || '.taxes.' || l_suppkey AS parent, 'l' || l_partkey AS plain, '' AS top FROM lineitem")
def templates(spark, d):  # noqa: ANN001, ANN201
    path = F.concat(F.lit("line_items."), F.col("l_linenumber").cast("string"), F.lit(".taxes."), F.col("l_suppkey").cast("string"), F.lit(".rate"))
    plain = F.concat(F.lit("l"), F.col("l_partkey").cast("string"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", paths.template(path).alias("template"), paths.parent(path).alias("parent"), paths.template(plain).alias("plain"), paths.parent(plain).alias("top"))


@query("pth01_02_get_set", "SELECT o_orderkey, 'Customer ' || o_custkey AS name, NULL::VARCHAR AS absent, 'New ' || o_orderkey AS changed, 'Order Desk' AS kept, CASE WHEN o_orderkey % 3 > 0 THEN 'set' END AS line FROM orders")
def get_set(spark, d):  # noqa: ANN001, ANN201
    """Leaves read by path; one set in a struct, one in a list."""
    lines = F.transform(paths.get(F.col("data"), "line_items"), lambda x, i: F.when(i == 0, x.withField("unit", F.lit("set"))).otherwise(x))
    new = F.col("data").withField("customer.name", F.concat(F.lit("New "), F.col(K).cast("string"))).withField("line_items", lines)
    rows = invoices(spark, d).withColumn("new", new)
    get = lambda c, p: paths.get(F.col(c), p)
    return rows.select(K, get("data", "customer.name").alias("name"), get("data", "bank_details.iban").alias("absent"), get("new", "customer.name").alias("changed"), get("new", "supplier.name").alias("kept"), F.get(get("new", "line_items"), F.lit(0))["unit"].alias("line"))


@query("pth07_null_leaves", "SELECT o_orderkey, 28 + 6 * (o_orderkey % 3) AS leaves, 6 * (o_orderkey % 3) AS list_leaves, 28 - 9 + 4 * (o_orderkey % 3) AS nulls FROM orders")
def null_leaves(spark, d):  # noqa: ANN001, ANN201
    """Leaves kept for persistence: those without a value too."""
    flat = paths.flatten(invoices(spark, d).select(F.col(K).alias("doc_id"), "data"), specs.fields("invoice"), keep_null=True)
    return flat.groupBy(F.col("doc_id").alias(K)).agg(F.count("*").alias("leaves"), F.count_if(F.col("path").startswith("line_items")).alias("list_leaves"), F.count_if(F.col("value").isNull()).alias("nulls"))


@query("pth09_unknown_keys", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'colour' || CASE WHEN o_orderkey % 2 = 0 THEN ',total_amount' ELSE '' END WHEN o_orderkey % 2 = 0 THEN 'total_amount' ELSE '' END AS unknown FROM orders")
def unknown_keys(spark, d):  # noqa: ANN001, ANN201
    made = invoice(colour=every(3, "red", None), total_amount=every(2, "1", None))
    known = [f.name for f in specs.schema("invoice").fields]
    return payload(orders(spark, d), "invoice", made).select(K, F.array_join(F.array_sort(paths.unknown_keys(F.col("json"), known)), ",").alias("unknown"))


_SPEC = ", ".join(f"('{p}', '{kind}', {'R' in fl}, {'C' in fl}, {'N' not in fl})" for p, kind, fl in specs.fields("invoice"))


@query("pth10_field_specs", f"""SELECT s.path, s.kind, s.is_required, s.is_critical, s.groundable, count(f.k) AS found FROM (VALUES {_SPEC}) AS s(path, kind, is_required, is_critical, groundable)
LEFT JOIN (SELECT k, regexp_replace(path, '\\.\\d+\\.', '[].') AS path FROM (SELECT k, path FROM ({_PLAIN}) UNION ALL SELECT k, path FROM ({_LINES}))) f ON f.path = s.path GROUP BY ALL""")
def field_specs(spark, d):  # noqa: ANN001, ANN201
    """Fields of a type with their flags, and how many of each the payloads hold."""
    flat = paths.flatten(invoices(spark, d).select(F.col(K).alias("doc_id"), "data"), specs.fields("invoice"), keep_null=True)
    own = F.create_map(*(x for p, kind, flags in specs.fields("invoice") for x in (F.lit(p), F.struct(F.lit(kind).alias("kind"), *(F.lit(t).alias(n) for t, n in (("R" in flags, "is_required"), ("C" in flags, "is_critical"), ("N" not in flags, "groundable")))))))
    counts = flat.groupBy(F.col("template").alias("path")).agg(F.count("value").alias("found"))
    return counts.withColumn("s", F.element_at(own, F.col("path"))).select("path", "s.kind", "s.is_required", "s.is_critical", "s.groundable", "found")


@query("snk02_flatten_export", "SELECT 'INV-' || o_orderkey AS invoice_number, 'Order Desk' AS supplier_name, CAST(o_orderkey % 3 AS INTEGER) AS n_items, o_orderkey % 3 = 0 AS none, CASE WHEN o_orderkey % 3 > 0 THEN '{\"description\":\"line 0 of ' || o_orderkey || '\",\"quantity\":\"' || o_orderkey % 7 || '\"}' END AS first FROM orders")
def flatten_export(spark, d):  # noqa: ANN001, ANN201
    """Dotted columns, lists as JSON text, an empty list as an empty string."""
    rows = invoices(spark, d).select(*paths.for_export(F.col("data"), specs.fields("invoice")))
    listed = F.from_json("line_items", "array<string>")
    return rows.select("invoice_number", F.col("`supplier.name`").alias("supplier_name"), F.coalesce(F.size(listed), F.lit(0)).alias("n_items"), (F.col("line_items") == "").alias("none"), F.get(listed, F.lit(0)).alias("first"))
