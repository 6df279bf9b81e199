"""A seeded corpus of labelled business documents of any size, and its JSON-lines form.

Invoices list lines, write their labels, dates and currencies in several ways, and say by tags which of these make them hard.

Every value comes from hashes of the document's number and the seed, as columns: a row is made where it is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED, SIZE = 20240613, 120
#: Share of types in twentieths, as upper ends.
MIX = [(11, "invoice"), (15, "receipt"), (18, "purchase_order"), (20, "contract")]
#: Known-good account pairs.
ACCOUNTS = [("CZ6508000000192000145399", "19-2000145399/0800")]
#: What invoices list: Czech and English name, unit, price in cents.
CATALOG = [
    ("Papír A4", "Copy paper", "ks", 12_900), ("Tonerová kazeta", "Toner cartridge", "ks", 189_000), ("Servisní hodina", "Service hour", "h", 95_000), ("Kabel HDMI", "HDMI cable", "ks", 24_950), ("Pronájem přístroje", "Equipment rental", "den", 310_000),
    ("Školení", "Training day", "den", 1_250_000), ("Doprava", "Delivery", "km", 1_450), ("Kancelářská židle", "Office chair", "ks", 429_900), ("Licence", "Software licence", "rok", 599_000),
]
#: Labels of number, day of issue and day due, by language; the second of each is the rarer one.
INVOICE_LABELS = {"cs": [("Číslo faktury", "Datum vystavení", "Datum splatnosti"), ("Faktura č.", "Vystaveno", "Splatnost")], "en": [("Invoice number", "Date of issue", "Due date"), ("Invoice No.", "Invoice date", "Payment due")]}
NAMES = ["Alder Works s.r.o.", "Birch Trading a.s.", "Cedar Tools s.r.o.", "Dogwood Print s.r.o.", "Elm Logistics a.s.", "Fir Office s.r.o."]
SCHEMA = "doc_id long, document_type string, text string, expected map<string,string>, difficulty array<string>, language string"


class _Draw:
    """Columns drawn for a document."""

    def __init__(self, seed: int) -> None:
        self.seed = seed

    def number(self, what: str, n: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), F.col("doc_id"), F.lit(what)), F.lit(n)).cast("int")

    def pick(self, what: str, values: list[str]) -> Column:
        return F.array(*(F.lit(v) for v in values))[self.number(what, len(values))]

    def ico(self, what: str) -> Column:
        """A registration number with its check digit: weights 8 to 2, modulo 11."""
        base = (F.lit(1_000_000) + self.number(what, 8_999_999)).cast("string")
        total = sum((F.substring(base, i + 1, 1).cast("int") * (8 - i) for i in range(7)), F.lit(0))
        return F.concat(base, ((11 - total % 11) % 10).cast("string"))


def _lines(d: _Draw) -> Column:
    """One to four different lines of the catalogue, drawn without putting back: the least of its hashes for the document."""
    ranked = F.array_sort(F.array(*(
        F.struct(F.xxhash64(F.lit(d.seed), F.col("doc_id"), F.lit("line"), F.lit(i)).alias("rank"), F.when(F.col("cs"), cs).otherwise(en).alias("description"), (1 + F.pmod(F.xxhash64(F.lit(d.seed), F.col("doc_id"), F.lit("quantity"), F.lit(i)), F.lit(20))).cast("long").alias("quantity"), F.lit(unit).alias("unit"), F.lit(price).cast("long").alias("price"))
        for i, (cs, en, unit, price) in enumerate(CATALOG)
    )))
    return F.slice(ranked, F.lit(1), 1 + d.number("lines", 4))


def labelled(spark: SparkSession, n: int = SIZE, seed: int = SEED, ids: DataFrame | None = None) -> DataFrame:
    """A document for each of the numbers below n, or of ids (doc_id)."""
    d = _Draw(seed)
    rows = spark.range(n).withColumnRenamed("id", "doc_id") if ids is None else ids.select("doc_id")
    twentieth = F.col("doc_id") % 20
    kind = F.lit(MIX[-1][1])
    for end, name in reversed(MIX[:-1]):
        kind = F.when(twentieth < end, name).otherwise(kind)
    czech = d.number("language", 100) < 77
    rows = rows.withColumn("cs", czech).withColumn("lines", F.when(kind == "invoice", _lines(d)))
    listed = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["quantity"] * x["price"])
    net, day = F.coalesce(listed, (10_000 + d.number("net", 900_000)).cast("long")), F.date_add(F.lit("2024-01-02").cast("date"), d.number("day", 110))
    tax = F.floor((net * 21 + 50) / 100).cast("long")
    rows = rows.withColumns({
        "document_type": kind, "comma": czech & (d.number("comma", 10) < 9), "plain": czech & (d.number("plain", 10) < 3), "extra": d.number("extra", 10) < 3, "net": net, "tax": tax, "day": day, "due": F.date_add(day, 14 + d.number("due", 30)),
        "supplier": d.pick("supplier", NAMES), "customer": d.pick("customer", NAMES[::-1]), "ico": d.ico("ico"), "no": F.concat(F.date_format(day, "yyyy"), F.lpad(d.number("no", 100_000).cast("string"), 5, "0")), "months": 6 + d.number("months", 30),
    })

    def money(cents: Column) -> Column:
        us = F.format_number(cents / 100, 2)
        return F.when(F.col("comma"), F.translate(us, ",.", " ,")).otherwise(us)

    def date(x: Column) -> Column:
        return F.when(F.col("cs"), F.date_format(x, "dd.MM.yyyy")).otherwise(F.date_format(x, "yyyy-MM-dd"))

    slash, rare, coded = d.number("slash", 10) < 3, d.number("labels", 10) < 4, d.number("code", 100) < 45
    rows = rows.withColumns({"slash": (F.col("document_type") == "invoice") & slash, "rare": (F.col("document_type") == "invoice") & rare, "coded": coded})
    written = lambda x: F.when(F.col("slash"), F.date_format(x, "dd/MM/yyyy")).otherwise(date(x))
    label = lambda i: F.when(F.col("cs"), F.when(F.col("rare"), INVOICE_LABELS["cs"][1][i]).otherwise(INVOICE_LABELS["cs"][0][i])).otherwise(F.when(F.col("rare"), INVOICE_LABELS["en"][1][i]).otherwise(INVOICE_LABELS["en"][0][i]))
    said = lambda i, v: F.concat(label(i), F.lit(": "), v)
    say = lambda cs, en: F.when(F.col("cs"), cs).otherwise(en)
    line = lambda cs, en, v: F.concat(say(cs, en), F.lit(": "), v)
    iso, cents = (lambda x: F.date_format(x, "yyyy-MM-dd")), (lambda x: F.format_string("%d.%02d", F.floor(x / 100).cast("int"), (x % 100).cast("int")))
    total, iban, account = F.col("net") + F.col("tax"), *map(F.lit, ACCOUNTS[0])
    code = say(F.lit("CZK"), F.lit("EUR"))
    unit = F.when(F.col("coded"), code).otherwise(say(F.lit("Kč"), F.lit("€")))
    table = F.array_join(F.transform("lines", lambda x: F.concat_ws("  ", F.rpad(x["description"], 24, " "), x["quantity"].cast("string"), x["unit"], money(x["price"]), money(x["quantity"] * x["price"]))), "\n")
    amounts = [line("Základ daně", "Subtotal", money(F.col("net"))), line("DPH celkem", "VAT amount", money(F.col("tax"))), line("Celkem k úhradě", "Total amount due", F.concat(money(total), F.lit(" "), code))]
    noise = F.when(F.col("extra"), F.concat(F.lit("Tel. +420 601 "), d.number("tel", 900).cast("string"), F.lit(" 114")))
    texts = {
        "invoice": [
            F.col("supplier"), say(F.lit("FAKTURA - daňový doklad"), F.lit("INVOICE")), noise, said(0, F.col("no")), line("IČO", "Company ID", F.col("ico")), line("Odběratel", "Bill to", F.col("customer")), said(1, written(F.col("day"))), said(2, written(F.col("due"))), table,
            line("Základ daně", "Subtotal", F.concat(money(F.col("net")), F.lit(" "), unit)), line("DPH celkem", "VAT amount", money(F.col("tax"))), line("Celkem k úhradě", "Total amount due", F.concat(money(total), F.lit(" "), unit)), line("Variabilní symbol", "Variable symbol", F.col("no")), F.concat(F.lit("IBAN: "), iban), line("Číslo účtu", "Account number", account),
        ],
        "receipt": [F.col("supplier"), say(F.lit("ÚČTENKA"), F.lit("RECEIPT")), noise, line("Účtenka č", "Receipt no", F.col("no")), line("Datum", "Date", date(F.col("day"))), line("Bez DPH", "Subtotal", money(F.col("net"))), line("DPH", "VAT", money(F.col("tax"))), line("Celkem", "Total", F.concat(money(total), F.lit(" "), code)), say(F.lit("Děkujeme, platba kartou, terminal 4"), F.lit("Thank you for your purchase, card payment"))],
        "purchase_order": [say(F.lit("OBJEDNÁVKA"), F.lit("PURCHASE ORDER")), noise, line("Číslo objednávky", "PO number", F.concat(F.lit("PO-"), F.col("no"))), line("Objednatel", "Buyer", F.col("customer")), line("IČO", "Company ID", F.col("ico")), line("Datum objednávky", "Order date", date(F.col("day"))), line("Termín dodání", "Requested delivery", date(F.col("due"))), line("Měna", "Currency", code), *amounts[:1], line("DPH", "VAT", money(F.col("tax"))), line("Celkem", "Order total", money(total)), F.lit("Incoterms: DAP")],
        "contract": [say(F.lit("SMLOUVA O DÍLO"), F.lit("SERVICE AGREEMENT")), noise, line("Název smlouvy", "Agreement title", say(F.lit("Údržba strojů"), F.lit("Machine upkeep"))), F.concat(say(F.lit("Smluvní strany: "), F.lit("This agreement is made by the parties: ")), F.col("supplier"), say(F.lit(" a "), F.lit(" and ")), F.col("customer")), line("Datum účinnosti", "Effective date", date(F.col("day"))), line("Datum ukončení", "Expiration date", date(F.add_months(F.col("day"), F.col("months")))), line("Hodnota smlouvy", "Contract value", F.concat(money(total), F.lit(" "), code)), line("Rozhodné právo", "Governing law", say(F.lit("Česká republika"), F.lit("Ireland")))],
    }
    values = {
        "invoice": {"invoice_number": F.col("no"), "supplier.name": F.col("supplier"), "supplier.registration_id": F.col("ico"), "customer.name": F.col("customer"), "issue_date": iso(F.col("day")), "due_date": iso(F.col("due")), "currency": code, "subtotal": cents(F.col("net")), "tax_amount": cents(F.col("tax")), "total": cents(total), "variable_symbol": F.col("no"), "bank_details.iban": iban, "bank_details.account_number": account},
        "receipt": {"merchant_name": F.col("supplier"), "receipt_number": F.col("no"), "purchase_date": iso(F.col("day")), "currency": code, "subtotal": cents(F.col("net")), "tax_amount": cents(F.col("tax")), "total": cents(total)},
        "purchase_order": {"po_number": F.concat(F.lit("PO-"), F.col("no")), "buyer.name": F.col("customer"), "buyer.registration_id": F.col("ico"), "order_date": iso(F.col("day")), "requested_delivery_date": iso(F.col("due")), "currency": code, "subtotal": cents(F.col("net")), "tax_amount": cents(F.col("tax")), "total": cents(total), "shipping_terms": F.lit("DAP")},
        "contract": {"title": say(F.lit("Údržba strojů"), F.lit("Machine upkeep")), "effective_date": iso(F.col("day")), "expiration_date": iso(F.add_months(F.col("day"), F.col("months"))), "total_value": cents(total), "currency": code, "governing_law": say(F.lit("Česká republika"), F.lit("Ireland"))},
    }
    own = lambda parts: F.coalesce(*(F.when(F.col("document_type") == k, c) for k, c in parts.items()))
    text = own({k: F.array_join(F.array_compact(F.array(*v)), "\n") for k, v in texts.items()})
    bare = F.translate(text, "áčďéěíňóřšťúůýžÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ", "acdeeinorstuuyzACDEEINORSTUUYZ")
    expected = own({k: F.create_map(*(x for p, c in v.items() for x in (F.lit(p), c))) for k, v in values.items()})
    listed = F.flatten(F.transform("lines", lambda x, i: F.array(*(F.struct(F.concat(F.lit("line_items."), i.cast("string"), F.lit(f".{p}")).alias("k"), v.alias("v")) for p, v in (("description", x["description"]), ("quantity", x["quantity"].cast("string")), ("unit", x["unit"]), ("unit_price", cents(x["price"])), ("line_total", cents(x["quantity"] * x["price"])))))))
    expected = F.when(F.col("lines").isNotNull(), F.map_concat(expected, F.map_from_entries(listed))).otherwise(expected)
    tags = F.array_compact(F.array(F.when(F.col("slash"), "ambiguous_date"), F.when(F.col("rare"), "label_variants"), F.when((F.col("document_type") == "invoice") & ~F.col("coded"), "no_currency_code"), F.when(F.col("comma"), "decimal_comma"), F.when(F.col("plain"), "diacritics_stripped"), F.when(F.col("extra"), "extra_numbers")))
    return rows.select("doc_id", "document_type", F.when(F.col("plain"), bare).otherwise(text).alias("text"), expected.alias("expected"), tags.alias("difficulty"), F.when(F.col("cs"), "cs").otherwise("en").alias("language"))


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line, UTF-8, nulls kept."""
    rows.write.option("ignoreNullFields", False).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """Blank lines are skipped; a line that is no JSON fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
