"""Classification, extraction, confidence and store queries over texts and rows written from the supplied tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text
from paperloom.operators import confidence, evaluation, extract, store
from paperloom.session import spread
from paperloom.sources import corpus

from . import kernels, specs
from .kernels import ways
from .records import KINDS, baseline_report, processed
from .registry import query
from .relational import FINAL, RETRYABLE, _t

K = "o_orderkey"

# ---- texts of the five types ----


def _us(c: str) -> Column:
    return F.format_number(F.col(c), 2)


def _czech(c: str) -> Column:
    return F.translate(_us(c), ",.", " ,")


def texts(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, kind, text): an order as an invoice, a receipt, a contract, a purchase order or a note, by its number modulo 5."""
    p = F.col("o_totalprice").cast("decimal(16,2)")
    o = spread(_t(spark, d, "orders")).select(F.col(K).alias("doc_id"), F.to_date("o_orderdate").alias("day"), p.alias("net"), F.round(p * F.lit("0.21").cast("decimal(3,2)"), 2).cast("decimal(16,2)").alias("tax"), F.col("o_custkey").cast("string").alias("c"), F.col(K).cast("string").alias("k"))
    o = o.withColumn("total", (F.col("net") + F.col("tax")).cast("decimal(16,2)"))
    day = lambda f, shift=0: F.date_format(F.date_add("day", shift), f)
    line = lambda *c: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in c))
    k, c = F.col("k"), F.col("c")
    made = {
        "invoice": [line("Supplies of ", c, " s.r.o."), line("Faktura číslo: F-", k), line("IČO: 27074358   DIČ: CZ27074358"), line("Datum vystavení: ", day("dd.MM.yyyy")), line("Datum splatnosti:"), line(""), line(day("yyyy-MM-dd", 14)), line("Variabilní symbol: ", k), line("Základ daně ", _czech("net")), line("DPH 21%: ", _czech("tax")), line("Celkem k úhradě: ", _czech("total"), " Kč"), line("IBAN CZ65 0800 0000 1920 0014 5399"), line("Číslo účtu: 19-2000145399/0800")],
        "receipt": [line("Corner Shop ", c), line("Receipt no: R-", k), line("Date: ", day("yyyy-MM-dd")), line("Total ", _us("total"), " EUR"), line("VAT 21% ", _us("tax")), line("Thank you for your purchase"), line("card payment")],
        "contract": [line("Agreement title: Lease ", k), line("This Agreement is made between the parties"), line("Effective date: ", day("d MMMM yyyy")), line("Expiration date: ", day("yyyyMMdd", 365)), line("Notice period: 30 days"), line("Governing law: Czech Republic"), line("Clause 4 Termination")],
        "purchase_order": [line("Purchase order number: PO-", k), line("Order date: ", day("yyyy-MM-dd")), line("Ship to: depot ", c), line("Requested delivery: ", day("yyyy-MM-dd", 20)), line("Order total: ", _us("total")), line("Currency: USD")],
        "generic": [line("A short note about nothing in particular, number ", k, ".")],
    }
    body = ways("doc_id", *(F.concat_ws("\n", *made[t]) for t in KINDS))
    return o.select("doc_id", ways("doc_id", *KINDS).alias("kind"), text.clean_text(body).alias("text"))


_KIND = "CASE o_orderkey % 5 WHEN 0 THEN 'invoice' WHEN 1 THEN 'receipt' WHEN 2 THEN 'contract' WHEN 3 THEN 'purchase_order' ELSE 'generic' END"


@query("cls02_samples", f"SELECT o_orderkey AS doc_id, {_KIND} AS document_type, o_orderkey % 5 = 4 AS fallback FROM orders")
def samples(spark, d):  # noqa: ANN001, ANN201
    """The best type of each text, and which texts fit none."""
    return extract.classify(texts(spark, d)).select("doc_id", "document_type", "fallback")


_HINTS = [(k, part, term, float(w)) for k, parts in specs.HINTS.items() for part, m in zip(("keyword", "pattern", "negative"), parts, strict=True) for term, w in m.items()]


def _hint_sql(part: str, term: str) -> str:
    term = term.replace("'", "''")
    return f"regexp_matches(low, '{term}')" if part == "pattern" else f"contains(folded, strip_accents('{term}'))"


@query("cls06_hints", f"""WITH s AS (SELECT lower(substr({kernels.MARKS_SQL} || text, 1, 6000)) AS low FROM documents), f AS (SELECT low, strip_accents(low) AS folded FROM s),
n AS (SELECT [{', '.join(f'count(*) FILTER ({_hint_sql(p, t)})' for _, p, t, _w in _HINTS)}] AS n FROM f)
SELECT document_type, part, term, weight, n[i] AS documents FROM n, (VALUES {', '.join(f"({i + 1}, '{k}', '{p}', '{t}', CAST({w} AS DOUBLE))" for i, (k, p, t, w) in enumerate(_HINTS))}) AS v(i, document_type, part, term, weight)""")
def hints(spark, d):  # noqa: ANN001, ANN201
    """Every hint with its weight, and how many documents hold it."""
    low = F.lower(F.substring(kernels._marked(), 1, specs.SAMPLE_CHARS))
    rows = _t(spark, d, "documents").select(low.alias("low")).withColumn("folded", text.fold_accents(F.col("low")))
    held = [F.col("low").rlike(t) if p == "pattern" else F.col("folded").contains(extract._fold(t)) for _, p, t, _w in _HINTS]
    counts = rows.agg(*(F.count_if(h).alias(f"n{i}") for i, h in enumerate(held)))
    each = F.array(*(F.struct(F.lit(k).alias("document_type"), F.lit(p).alias("part"), F.lit(t).alias("term"), F.lit(w).alias("weight"), F.col(f"n{i}").alias("documents")) for i, (k, p, t, w) in enumerate(_HINTS)))
    return counts.select(F.inline(each))


@query("cls03_04_cascade", """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'receipt' WHEN c >= 0.65 THEN 'invoice' WHEN event_id % 3 = 0 THEN 'contract' WHEN event_id % 3 = 1 THEN 'generic' ELSE 'invoice' END AS document_type,
  CASE WHEN event_id % 7 = 0 THEN 1.0 WHEN c >= 0.65 THEN c WHEN event_id % 3 = 0 THEN least(1.0, greatest(0.0, m)) WHEN event_id % 3 = 1 THEN 0.3 ELSE c END AS confidence,
  CASE WHEN event_id % 7 = 0 THEN 'explicit' WHEN c >= 0.65 THEN 'heuristic' WHEN event_id % 3 < 2 THEN 'model' ELSE 'heuristic' END AS method FROM (SELECT *, event_id % 101 / 100.0 AS c, (event_id % 31 - 5) / 20.0 AS m FROM events)""")
def cascade(spark, d):  # noqa: ANN001, ANN201
    """A given type, a trusted heuristic, the model's answer checked, or the heuristic."""
    e = _t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, "receipt").alias("explicit"), F.lit("invoice").alias("heuristic"), (F.col("event_id") % 101 / 100.0).alias("c"), ways("event_id", "contract", "alien", None).alias("model"), ((F.col("event_id") % 31 - 5) / 20.0).alias("m"))
    return e.select("event_id", F.inline(F.array(extract.escalate(*(F.col(x) for x in ("explicit", "heuristic", "c", "model", "m"))))))


_TRIM = r"regexp_replace(regexp_replace(CAST({} AS VARCHAR), '(\.\d*?)0+$', '\1'), '\.$', '')"
_NET, _TAX, _TOTAL = (_TRIM.format(c) for c in ("net", "tax", "net + tax"))
_VALUES = {
    0: {
        "supplier.name": "'Supplies of ' || c || ' s.r.o.'", "invoice_number": "'F-' || k", "supplier.registration_id": "'27074358'", "supplier.vat_id": "'CZ27074358'", "issue_date": "strftime(day, '%Y-%m-%d')", "due_date": "strftime(day + 14, '%Y-%m-%d')", "variable_symbol": "k", "subtotal": _NET, "tax_amount": _TAX, "total": _TOTAL,
        "currency": "'CZK'", "bank_details.iban": "'CZ6508000000192000145399'", "bank_details.account_number": "'19-2000145399/0800'",
    },
    1: {"merchant_name": "'Corner Shop ' || c", "receipt_number": "'R-' || k", "purchase_date": "strftime(day, '%Y-%m-%d')", "total": _TOTAL, "tax_amount": _TAX, "currency": "'EUR'"},
    2: {"title": "'Lease ' || k", "effective_date": "strftime(day, '%Y-%m-%d')", "expiration_date": "strftime(day + 365, '%Y-%m-%d')", "notice_period_days": "'30'", "governing_law": "'Czech Republic'"},
    3: {"po_number": "'PO-' || k", "order_date": "strftime(day, '%Y-%m-%d')", "delivery_address": "'depot ' || c", "requested_delivery_date": "strftime(day + 20, '%Y-%m-%d')", "total": _TOTAL, "currency": "'USD'"},
}
_ORDERS = "(SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS k, CAST(o_custkey AS VARCHAR) AS c, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(16,2)) AS net, CAST(round(CAST(o_totalprice AS DECIMAL(16,2)) * 0.21, 2) AS DECIMAL(16,2)) AS tax FROM orders)"


@query("ext01_07_extract", " UNION ALL ".join(f"SELECT id AS doc_id, '{p}' AS path, {v} AS value FROM {_ORDERS} WHERE id % 5 = {n}" for n, vs in _VALUES.items() for p, v in vs.items()))
def extracted(spark, d):  # noqa: ANN001, ANN201
    """Fields that the rules read from texts of each type: labels in two languages, values on the next lines, amounts and dates in several notations."""
    rows, out = texts(spark, d), None
    for key in KINDS:
        part = extract.extract(rows.where(F.col("kind") == key), key)
        out = part if out is None else out.unionByName(part)
    # an inner explode has the optimiser ask before it whether there is anything to explode, and so read every text twice
    return out.select("doc_id", F.explode_outer("values").alias("path", "value")).where("path is not null")


_CZ = "translate(format('{{:,.2f}}', CAST({} AS DOUBLE)), ',.', ' ,')"
_US = "format('{{:,.2f}}', CAST({} AS DOUBLE))"
#: path -> line and what is read there; values are those of _VALUES.
_EVIDENCE = {
    0: {
        "invoice_number": (1, "'F-' || k"), "supplier.registration_id": (2, "'27074358   DIČ: CZ27074358'"), "supplier.vat_id": (2, "'CZ27074358'"), "issue_date": (3, "strftime(day, '%d.%m.%Y')"), "due_date": (6, "strftime(day + 14, '%Y-%m-%d')"), "variable_symbol": (7, "k"),
        "subtotal": (8, _CZ.format("net")), "tax_amount": (9, f"'21%: ' || {_CZ.format('tax')}"), "total": (10, f"{_CZ.format('net + tax')} || ' Kč'"), "bank_details.iban": (11, "'CZ65 0800 0000 1920 0014 5399'"), "bank_details.account_number": (12, "'19-2000145399/0800'"),
    },
    1: {"receipt_number": (1, "'R-' || k"), "purchase_date": (2, "strftime(day, '%Y-%m-%d')"), "total": (3, f"{_US.format('net + tax')} || ' EUR'"), "tax_amount": (4, f"'21% ' || {_US.format('tax')}")},
    2: {"title": (0, "'Lease ' || k"), "effective_date": (2, "strftime(day, '%-d %B %Y')"), "expiration_date": (3, "strftime(day + 365, '%Y%m%d')"), "notice_period_days": (4, "'30 days'"), "governing_law": (5, "'Czech Republic'")},
    3: {"po_number": (0, "'PO-' || k"), "order_date": (1, "strftime(day, '%Y-%m-%d')"), "delivery_address": (2, "'depot ' || c"), "requested_delivery_date": (3, "strftime(day + 20, '%Y-%m-%d')"), "total": (4, _US.format("net + tax")), "currency": (5, "'USD'")},
}


@query("ext02_evidence", " UNION ALL ".join(f"SELECT id AS doc_id, '{p}' AS path, {_VALUES[n][p]} AS value, CAST({line} AS INTEGER) AS line, {said} AS evidence FROM {_ORDERS} WHERE id % 5 = {n}" for n, vs in _EVIDENCE.items() for p, (line, said) in vs.items()))
def evidence(spark, d):  # noqa: ANN001, ANN201
    """Where each labelled value stands: the characters at its place in the text are what it was read from."""
    rows, out = texts(spark, d), None
    for key in KINDS:
        part = extract.located(rows.where(F.col("kind") == key), key)
        out = part if out is None else out.unionByName(part)
    both = out.join(rows.select("doc_id", "text"), "doc_id")
    return both.select("doc_id", "path", "value", "line", F.col("text").substr(F.col("start"), F.col("length")).alias("evidence"))


_RULES = ", ".join(f"({n}, '{k}', '{r[0]}', '{r[1]}', {len(r[2])})" for n, k in enumerate(KINDS) for r in specs.EXTRACT[k])


@query("ext06_rules", f"SELECT document_type, path, kind, CAST(n_labels AS INTEGER) AS n_labels, count(*) AS documents FROM orders JOIN (VALUES {_RULES}) AS v(n, document_type, path, kind, n_labels) ON o_orderkey % 5 = n GROUP BY ALL")
def rules_asked(spark, d):  # noqa: ANN001, ANN201
    """The extraction rules of each type, and how many documents each of them is asked of."""
    rules = F.create_map(*(x for k in KINDS for x in (F.lit(k), F.array(*(F.struct(F.lit(r[0]).alias("path"), F.lit(r[1]).alias("kind"), F.lit(len(r[2])).alias("n_labels")) for r in specs.EXTRACT[k])))))
    docs = _t(spark, d, "orders").select(ways(K, *KINDS).alias("document_type"))
    return docs.select("document_type", F.inline(F.element_at(rules, F.col("document_type")))).groupBy("document_type", "path", "kind", "n_labels").agg(F.count("*").alias("documents"))


@query("ext05_patterns", """SELECT c_custkey, 'CZ65 0800 0000 ' || lpad(CAST(c_custkey AS VARCHAR), 4, '0') || ' 0014 5399' AS iban, lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '/0800' AS account, 'DE ' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS vat,
  lpad(CAST(c_custkey AS VARCHAR), 8, '7') AS ico, 'GIBACZPX' AS swift, CASE c_custkey % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'Kč' ELSE '' END AS currency, CAST(c_custkey AS VARCHAR) || ' 500,25' AS amount FROM customer""")
def patterns(spark, d):  # noqa: ANN001, ANN201
    """Identifiers, currencies and amounts found in running text by their shapes."""
    n = lambda w, fill="0": F.lpad(F.col("c_custkey").cast("string"), w, fill)
    said = F.concat(F.lit("pay to CZ65 0800 0000 "), n(4), F.lit(" 0014 5399, or (account "), n(6), F.lit("/0800) by GIBACZPX; vat DE "), n(9), F.lit(", company "), n(8, "7"), F.lit(". Sum:"), ways("c_custkey", " EUR ", " Kč ", " XEUR "), F.lit("~"), F.col("c_custkey").cast("string"), F.lit(" 500,25."))
    rows = _t(spark, d, "customer").select("c_custkey", said.alias("t"))
    found = {"iban": (extract.IBAN, "t"), "account": (extract.ACCOUNT, "t"), "vat": (extract.VAT, "t"), "ico": (extract.ICO, "t"), "swift": (extract.SWIFT, "t"), "currency": (extract.CURRENCY, "t")}
    from paperloom.functions.numbers import AMOUNT

    return rows.select("c_custkey", *(F.regexp_extract(c, rx, 1).alias(a) for a, (rx, c) in found.items()), F.regexp_extract(F.substring_index("t", "~", -1), f"({AMOUNT})", 1).alias("amount"))


# ---- confidence ----


@query("cnf01_grounding", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.40 WHEN 3 THEN 0.10 WHEN 4 THEN 0.10 ELSE 1.0 END::DOUBLE AS score FROM orders")
def grounding(spark, d):  # noqa: ANN001, ANN201
    """Values that stand in the text in one piece, in pieces, in part, or not at all."""
    p = F.col("o_totalprice").cast("decimal(16,2)")
    source = F.concat(F.lit("ACME s.r.o., Příliš 15. března 2024, total "), F.translate(F.format_number(p, 2), ",.", " ,"), F.lit(" ref 3120"))
    value = ways(K, p.cast("string"), "března total ACME", "ACME Widgets", "zebra quagga", "", "PRILIS")
    return _t(spark, d, "orders").select(K, confidence.grounding(value, text.match_key(source)).cast("double").alias("score"))


_SIG = {"g": ("grounding", 0.40, "CASE event_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.4 WHEN 2 THEN 0.1 END"), "f": ("format", 0.15, "CASE WHEN event_id % 5 < 4 THEN 1.0 END"), "v": ("validation", 0.15, "CASE event_id % 3 WHEN 0 THEN 0.05 WHEN 1 THEN 1.0 END"), "c": ("context", 0.10, "CASE WHEN event_id % 7 < 5 THEN 0.95 END")}
_WEIGHED = "CAST((" + " + ".join(f"coalesce({s} * {w}, 0)" for s, (_, w, _x) in _SIG.items()) + ") AS DOUBLE) / nullif(CAST((" + " + ".join(f"CASE WHEN {s} IS NULL THEN 0 ELSE {w} END" for s, (_, w, _x) in _SIG.items()) + ") AS DOUBLE), 0)"


@query("cnf02_03_weighted", f"SELECT event_id, round(score, 4) AS score, CASE WHEN score >= 0.85 THEN 'high' WHEN score >= 0.6 THEN 'medium' ELSE 'low' END AS band FROM (SELECT event_id, coalesce({_WEIGHED}, 0.6) AS score FROM (SELECT event_id, {', '.join(f'CAST({x} AS DOUBLE) AS {s}' for s, (_, _w, x) in _SIG.items())} FROM events))")
def weighted(spark, d):  # noqa: ANN001, ANN201
    """The mean of the signals that there are, and its band."""
    e = _t(spark, d, "events").select("event_id", *(F.expr(x).cast("double").alias(s) for s, (_, _w, x) in _SIG.items()))
    score = confidence.weighted({name: F.col(s) for s, (name, _w, _x) in _SIG.items()})
    return e.select("event_id", F.round(score, 4).alias("score"), confidence.band(score).alias("band"))


_FORMS = [("date", "yyyy-MM-dd", 1.0), ("date", "dd.MM.yyyy", None), ("date", None, 0.1), ("money", "price", 1.0), ("money", None, 0.1), ("currency", "Kč", 1.0), ("currency", "?", 0.1), ("string", "", 0.1), ("string", "x", 0.4), ("text", "xy", 1.0), ("enum", "lease", 1.0)]


@query("cnf04_format_signal", "SELECT o_orderkey, CASE o_orderkey % 11 WHEN 1 THEN CASE WHEN day(o_orderdate) <= 12 THEN 0.5 ELSE 0.8 END WHEN 2 THEN 0.1 WHEN 4 THEN 0.1 WHEN 6 THEN 0.1 WHEN 7 THEN 0.1 WHEN 8 THEN 0.4 ELSE 1.0 END::DOUBLE AS signal FROM orders")
def formats(spark, d):  # noqa: ANN001, ANN201
    """How clean a value is for its kind."""
    dt = lambda f: F.date_format("o_orderdate", f)
    value = ways(K, dt("yyyy-MM-dd"), dt("dd.MM.yyyy"), "some day", F.format_number("o_totalprice", 2), "abc", "Kč", "?", "", "x", "xy", "lease")
    return _t(spark, d, "orders").select(K, value.alias("v"), ways(K, *(f[0] for f in _FORMS)).alias("kind")).select(K, confidence.format_signal(F.col("v"), F.col("kind")).cast("double").alias("signal"))


@query("cnf07_agreement", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 4 THEN NULL ELSE 0.25 END::DOUBLE AS signal FROM orders")
def agreed(spark, d):  # noqa: ANN001, ANN201
    """A model's reading beside that of the rules."""
    p = F.col("o_totalprice").cast("decimal(16,2)")
    us = F.format_number(p, 2)
    rows = _t(spark, d, "orders").select(K, ways(K, p.cast("string"), "ACME s.r.o.", us, "x", us).alias("v"), ways(K, F.translate(us, ",.", " ,"), "acme SRO", (p + 1).cast("string"), "y", " ").alias("b"))
    return rows.select(K, confidence.agreement_signal(F.col("v"), F.col("b")).cast("double").alias("signal"))


@query("cnf13_display_order", """SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN v AND r THEN 0 WHEN v THEN 1 WHEN r THEN 2 ELSE 3 END, dots, path) AS place
FROM (SELECT *, event_id % 3 = 0 AS v, event_id % 2 = 0 AS r, event_id % 4 AS dots, repeat('a.', CAST(event_id % 4 AS BIGINT)) || event_type || event_id AS path FROM events)""")
def display(spark, d):  # noqa: ANN001, ANN201
    """Fields of each user in the order in which a reviewer sees them."""
    from pyspark.sql import Window

    path = F.concat(F.repeat(F.lit("a."), (F.col("event_id") % 4).cast("int")), "event_type", F.col("event_id").cast("string"))
    rows = _t(spark, d, "events").select("event_id", "user_id", confidence.display_order(path, F.col("event_id") % 3 == 0, F.col("event_id") % 2 == 0).alias("by"))
    return rows.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("by")).cast("long").alias("place"))


@query("cnf09_11_flagship_samples", f"SELECT o_orderkey AS doc_id, {_KIND} AS document_type, CASE o_orderkey % 5 WHEN 2 THEN 2 ELSE 0 END AS errors, o_orderkey % 5 IN (2, 4) OR o_orderkey < 10 AND o_orderkey % 5 = 0 AS needs_review FROM orders WHERE o_custkey % 5 = 0")
def flagship(spark, d):  # noqa: ANN001, ANN201
    """The whole record pipeline over orders of some customers, written as texts of five types. A variable symbol of one digit needs checking."""
    some = _t(spark, d, "orders").where("o_custkey % 5 = 0").select(F.col(K).alias("doc_id"))
    return processed(spark, texts(spark, d).join(some, "doc_id", "left_semi").select("doc_id", "text")).select("doc_id", "document_type", "errors", "needs_review")


# ---- grading ----


@query("evl01_compare", "SELECT o_orderkey, CASE o_orderkey % 12 WHEN 1 THEN 'miss' WHEN 4 THEN 'exact' WHEN 6 THEN 'fuzzy' WHEN 7 THEN 'miss' WHEN 8 THEN 'exact' WHEN 9 THEN 'miss' ELSE 'normalised' END AS level FROM orders")
def compared(spark, d):  # noqa: ANN001, ANN201
    """Pairs of values at every level of agreement."""
    p, k = F.col("o_totalprice").cast("decimal(16,2)"), F.col(K).cast("string")
    say = lambda *c: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in c))
    name = say("International Widgets and Partners number ", k)
    e = ways(K, p.cast("string"), p.cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), "EUR", name, name, name, say("19-", F.lpad(k, 8, "0")), None, k, "true", p.cast("string"))
    a = ways(K, F.format_number(p, 2), (p + F.lit("0.02").cast("decimal(3,2)")).cast("string"), F.date_format("o_orderdate", "d MMMM yyyy"), "€", name, F.upper(F.replace(name, F.lit(" "), F.lit("  "))), F.replace(name, F.lit("Widgets"), F.lit("Widget")), say("18-", F.lpad(k, 8, "0")), " ", "", "True", (p + F.lit("0.01").cast("decimal(3,2)")).cast("string"))
    kind = ways(K, "money", "money", "date", "currency", "string", "string", "string", "identifier", "string", "text", "boolean", "money")
    return evaluation.compare(_t(spark, d, "orders").select(K, e.alias("expected"), a.alias("actual"), kind.alias("kind"))).select(K, "level")


_RATES = {"required": "event_type <> 'error'", "critical": "event_type <> 'view'", "success": "event_type = 'purchase'", "review": "event_type = 'signup'"}
_HALF = ", ".join(f"round(avg(CASE WHEN {c} THEN 1 ELSE 0 END), 4) AS {r}" for r, c in _RATES.items())


@query("evl22_gates", f"""WITH b AS (SELECT user_id, {_HALF} FROM events WHERE event_id % 2 = 0 AND user_id % 10 <> 1 GROUP BY 1), a AS (SELECT user_id, {_HALF} FROM events WHERE event_id % 2 = 1 AND user_id % 10 <> 2 GROUP BY 1)
SELECT CAST(coalesce(a.user_id, b.user_id) AS VARCHAR) AS model, CASE WHEN b.user_id IS NULL THEN 'new run, no baseline' WHEN a.user_id IS NULL THEN 'missing in after' ELSE 'compared' END AS status,
  concat_ws(',', CASE WHEN round((a.required - b.required) * 100, 6) < -3 THEN 'required' END, CASE WHEN round((a.critical - b.critical) * 100, 6) < -3 THEN 'critical' END, CASE WHEN round((a.success - b.success) * 100, 6) < 0 THEN 'success' END, CASE WHEN round((a.review - b.review) * 100, 6) > 10 THEN 'review' END) AS violations
FROM a FULL JOIN b ON a.user_id = b.user_id""")
def gates(spark, d):  # noqa: ANN001, ANN201
    """Two runs for each user as a model: what got worse by more than it may."""
    e = _t(spark, d, "events")
    run = lambda rows: rows.groupBy(F.lit("events").alias("provider"), F.col("user_id").cast("string").alias("model")).agg(*(F.round(F.avg(F.expr(c).cast("int")), 4).alias(r) for r, c in _RATES.items()))
    both = evaluation.gates(run(e.where("event_id % 2 = 0 AND user_id % 10 <> 1")), run(e.where("event_id % 2 = 1 AND user_id % 10 <> 2")))
    return both.select("model", "status", F.array_join("violations", ",").alias("violations"))


@query("evl23_graded_baseline")
def graded_baseline(spark, d):  # noqa: ANN001, ANN201
    """The rules graded on a labelled document for each customer."""
    return baseline_report(spark, corpus.labelled(spark, ids=_t(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"))))


@query("src16_corpus_mix", "SELECT CASE WHEN k % 20 < 11 THEN 'invoice' WHEN k % 20 < 15 THEN 'receipt' WHEN k % 20 < 18 THEN 'purchase_order' ELSE 'contract' END AS document_type, count(*) AS n, count(*) FILTER (k % 20 < 18) AS totals_hold FROM (SELECT c_custkey AS k FROM customer) GROUP BY 1")
def corpus_mix(spark, d):  # noqa: ANN001, ANN201
    """Types of the labelled corpus, and how many of its documents have totals that add up."""
    cents = lambda p: F.col("expected")[p].cast("decimal(18,2)")
    rows = corpus.labelled(spark, ids=_t(spark, d, "customer").select(F.col("c_custkey").alias("doc_id")))
    return rows.groupBy("document_type").agg(F.count("*").alias("n"), F.count_if(cents("subtotal") + cents("tax_amount") == cents("total")).alias("totals_hold"))


# ---- the store ----


@query("rel21_types_for_org", """SELECT key, CAST(version AS INTEGER) AS version, organization_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY organization_id IS NULL, version DESC) AS n FROM (
  SELECT 't' || p_partkey % 40 AS key, p_partkey AS version, CASE p_partkey % 3 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END AS organization_id FROM part WHERE p_partkey % 5 <> 0) WHERE organization_id IS NULL OR organization_id = 'a') WHERE n = 1""")
def types_for_org(spark, d):  # noqa: ANN001, ANN201
    """The types that an organisation sees: its own before the global ones, the newest of each key."""
    rows = _t(spark, d, "part").select(F.concat(F.lit("t"), (F.col("p_partkey") % 40).cast("string")).alias("key"), F.col("p_partkey").cast("int").alias("version"), ways("p_partkey", None, "a", "b").alias("organization_id"), (F.col("p_partkey") % 5 != 0).alias("is_active"))
    return store.types_for(rows, "a").select("key", "version", "organization_id")


@query("rel22_webhooks_for_event", "SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 4 <> 2")
def webhooks_for_event(spark, d):  # noqa: ANN001, ANN201
    """Active endpoints that want an event: those that name it, and those that name none."""
    listed = lambda *e: F.array(*(F.lit(x) for x in e)).cast("array<string>")
    rows = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), ways("c_custkey", listed(), listed("document.completed", "x"), listed("x"), listed()).alias("events"), (F.col("c_custkey") % 3 != 0).alias("is_active"))
    return store.webhooks_for(rows, "document.completed").select("id")


_CODES = RETRYABLE + FINAL


@query("rel36_error_taxonomy", f"SELECT code, list_contains({RETRYABLE}, code) AS retryable, count(*) AS n FROM (SELECT ({_CODES})[event_id % {len(_CODES)} + 1] AS code FROM events WHERE event_type = 'error') GROUP BY 1")
def failures(spark, d):  # noqa: ANN001, ANN201
    """Failed jobs by error code, and whether another attempt may help."""
    failed = _t(spark, d, "events").where("event_type = 'error'").select(ways("event_id", *_CODES).alias("code"))
    return failed.withColumn("retryable", F.col("code").isin(*RETRYABLE)).groupBy("code", "retryable").agg(F.count("*").alias("n"))
