"""Classification and label-anchored extraction over text lines, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import ids, numbers, text
from paperloom.functions.text import bind
from paperloom.plans import specs

#: Shapes of identifiers in running text.
IBAN = r"\b([A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]){11,30})\b"
ACCOUNT = r"\b((?:\d{1,6}-)?\d{2,10}/\d{4})\b"
VAT = r"\b((?:CZ|SK|PL|DE|AT|HU|GB|FR|IT|ES|NL|BE|SE|DK|FI|IE|PT|RO|BG|SI|HR|LT|LV|EE|LU|MT|CY|GR)\s?[0-9A-Z]{8,12})\b"
ICO = r"\b(\d{8})\b"
SWIFT = r"\b([A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)\b"
CURRENCY = r"(?iu)(?:^|[\s(])(CZK|EUR|USD|GBP|PLN|HUF|CHF|SEK|NOK|DKK|RON|BGN|CAD|AUD|JPY|Kč|€|\$|£|zł)(?:[\s).,]|$)"
HEADINGS = r"(?iu)^(invoice|faktura|tax invoice|daňový doklad|receipt|účtenka|purchase order|objednávka|page \d|strana \d|\d{1,3}$)"
LOOK_AHEAD = 2


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def evidence(low: Column, folded: Column, key: str) -> Column:
    """Weights of what a lower-cased sample and its folded form hold, 0 at least."""
    keywords, patterns, negative = specs.HINTS[key]
    held = [F.when(folded.contains(_fold(k)), F.lit(w)).otherwise(0.0) for k, w in keywords.items()]
    held += [F.when(low.rlike(p), F.lit(w)).otherwise(0.0) for p, w in patterns.items()]
    held += [F.when(folded.contains(_fold(k)), F.lit(-w)).otherwise(0.0) for k, w in negative.items()]
    return F.greatest(F.lit(0.0), _sum(held))


def _fold(s: str) -> str:
    return "".join(text._FOLD_TO[text._FOLD_FROM.index(c)] if c in text._FOLD_FROM else c for c in s.lower())


def classify(docs: DataFrame) -> DataFrame:
    """docs (text, ...) with document_type, type_confidence and fallback, by one expression for each type: no shuffle."""
    cols = docs.columns
    rows = docs.withColumn("__low", F.lower(F.substring("text", 1, specs.SAMPLE_CHARS))).withColumn("__fold", text.fold_accents(F.col("__low")))
    for key in specs.TIE_ORDER:
        e = evidence(F.col("__low"), F.col("__fold"), key)
        rows = rows.withColumn(f"__{key}", bind(e, lambda v: F.round(v / (v + specs.HALF_EVIDENCE), 6)))
    ranked = F.reverse(F.array_sort(F.array(*(F.struct(F.col(f"__{k}").alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("key")) for i, k in enumerate(specs.TIE_ORDER)))))
    rows = rows.withColumn("__best", ranked)
    best, margin = F.col("__best")[0], F.col("__best")[0]["score"] - F.col("__best")[1]["score"]
    sure = F.when(margin < specs.MIN_MARGIN, F.least(best["score"], 0.5 + margin)).otherwise(best["score"])
    none = F.coalesce(best["score"], F.lit(0.0)) <= 0
    return rows.select(*(F.col(f"`{c}`") for c in cols), F.when(none, "generic").otherwise(best["key"]).alias("document_type"), F.when(none, F.lit(0.0)).otherwise(F.round(sure, 4)).alias("type_confidence"), none.alias("fallback"))


def escalate(explicit: Column, heuristic: Column, confidence: Column, model: Column, model_confidence: Column) -> Column:
    """struct(document_type, confidence, method): a given type, a trusted heuristic, the model's checked answer, the heuristic."""
    known = [*specs.FIELDS]
    answer = lambda k, c, m: F.struct(k.alias("document_type"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)).alias("confidence"), F.lit(m).alias("method"))
    return (
        F.when(explicit.isNotNull(), answer(explicit, F.lit(1.0), "explicit")).when(confidence >= specs.TRUSTED, answer(heuristic, confidence, "heuristic"))
        .when(model.isin(*known), answer(model, model_confidence, "model")).when(model.isNotNull(), answer(F.lit("generic"), F.lit(0.3), "model")).otherwise(answer(heuristic, confidence, "heuristic"))
    )


def _value(raw: Column, kind: str) -> Column:
    """What a label's text means; null where it is not of the kind."""
    first = lambda x, rx: F.nullif(F.regexp_extract(x, rx, 1), F.lit(""))
    if kind == "amount":
        return _decimal_text(numbers.pick_amount(raw))
    if kind == "date":
        return numbers.parse_date(raw)["value"].cast("string")
    if kind == "currency":
        return F.coalesce(numbers.currency(first(raw, CURRENCY)), numbers.currency(raw))
    if kind == "iban":
        return ids.iban_key(first(F.upper(raw), IBAN))
    if kind == "account":
        return first(raw, ACCOUNT)
    if kind == "vat":
        return first(F.replace(F.upper(raw), F.lit(" "), F.lit("")), VAT)
    if kind == "ico":
        return first(raw, ICO)
    if kind == "digits":
        return F.nullif(F.regexp_replace(raw, r"\D", ""), F.lit(""))
    return text.squeeze(raw)


def _decimal_text(x: Column) -> Column:
    """Plain digits without the zeros that the fixed scale adds."""
    return F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def _labelled(s: Column, labels: list[str]) -> Column:
    """Whether a line may hold one of the labels: a search for plain text, before the pattern is tried at every place."""
    return numbers.any_of([s["low"].contains(_fold(x)) for x in labels])


def _find(lines: Column, rule: tuple) -> Column:
    """The text that follows a rule's label, on its line or within the next two; first or last of all."""
    _, _, labels, excluded, last, longest = rule
    names = "|".join(re.escape(_fold(x)) for x in labels)  # tried in the order given
    rx = rf"(?i)(?:^|\b)(?:{names})\s*[:：#]?\s*"
    bad = lambda s: numbers.any_of([s.contains(_fold(x)) for x in excluded]) if excluded else F.lit(False)

    def candidate(s: Column, i: Column) -> Column:
        """Offsets in the folded line hold for the line itself: folding keeps the length."""
        rest = F.length(s["folded"]) - F.length(F.regexp_extract(s["folded"], rf"(?s){rx}(.*)\z", 1))
        tail = text.strip(F.substring(s["line"], rest + 1, F.length(s["line"])))
        below = F.filter(F.transform(F.slice(lines, i + 2, LOOK_AHEAD), lambda n: n["said"]), lambda n: n != "")
        value = F.when(tail != "", tail).otherwise(F.get(below, F.lit(0)))
        return F.when((s["said"] != "") & _labelled(s, labels) & s["folded"].rlike(rx) & ~bad(s["low"]), F.substring(value, 1, longest))

    found = F.array_compact(F.transform(lines, candidate))
    return F.try_element_at(found, F.lit(-1 if last else 1))


#: Fixed value: characters of evidence that are kept.
EVIDENCE = 300


def _placed(lines: Column, rule: tuple) -> Column:
    """What `_find` finds, with its line (from 0) and its place in that line (from 1)."""
    _, _, labels, excluded, last, longest = rule
    names = "|".join(re.escape(_fold(x)) for x in labels)
    rx = rf"(?i)(?:^|\b)(?:{names})\s*[:：#]?\s*"
    bad = lambda s: numbers.any_of([s.contains(_fold(x)) for x in excluded]) if excluded else F.lit(False)
    lead = lambda x: F.length(x) - F.length(F.regexp_replace(x, r"(?U)\A\s+", ""))
    place = lambda line, at, said: F.struct(line.cast("int").alias("line"), at.cast("int").alias("at"), said.alias("said"))

    def candidate(s: Column, i: Column) -> Column:
        skipped = F.length(s["folded"]) - F.length(F.regexp_extract(s["folded"], rf"(?s){rx}(.*)\z", 1))
        own = text.bind(F.struct(skipped.alias("n"), F.substring(s["line"], skipped + 1, F.length(s["line"])).alias("x")), lambda r: place(i, r["n"] + 1 + lead(r["x"]), text.strip(r["x"])))
        below = F.filter(F.transform(F.slice(lines, i + 2, LOOK_AHEAD), lambda n, j: place(i + 1 + j, lead(n["line"]) + 1, n["said"])), lambda p: p["said"] != "")
        found = text.bind(own, lambda o: F.when(o["said"] != "", o).otherwise(F.get(below, F.lit(0))))
        cut = text.bind(found, lambda o: F.when(o.isNotNull(), place(o["line"], o["at"], F.substring(o["said"], 1, min(longest, EVIDENCE)))))
        return F.when((s["said"] != "") & _labelled(s, labels) & s["folded"].rlike(rx) & ~bad(s["low"]), cut)

    return F.try_element_at(F.array_compact(F.transform(lines, candidate)), F.lit(-1 if last else 1))


def located(docs: DataFrame, key: str) -> DataFrame:
    """docs (doc_id, text) of one type -> (doc_id, path, value, line, start, length): each labelled value with where it stands.

    `substring(text, start, length)` is what was read, of the text as given; line counts from 0. Texts are cleaned ones: a line ends with one
    character. A label whose value cannot be read gives no row.
    """
    rows = with_lines(docs.select("doc_id", "text"))
    before = lambda n: F.aggregate(F.slice(F.col("lines"), F.lit(1), n), F.lit(0), lambda a, s: a + F.length(s["line"]) + 1)
    places = rows.select("doc_id", "lines", *(_placed(F.col("lines"), r).alias(f"p{i}") for i, r in enumerate(specs.EXTRACT[key])))

    def found(i: int, rule: tuple) -> Column:
        p = F.col(f"p{i}")
        return F.struct(F.lit(rule[0]).alias("path"), _value(p["said"], rule[1]).alias("value"), p["line"].alias("line"), (before(p["line"]) + p["at"]).alias("start"), F.length(p["said"]).alias("length"))

    each = F.array(*(F.when(F.col(f"p{i}").isNotNull(), found(i, r)) for i, r in enumerate(specs.EXTRACT[key])))
    return places.select("doc_id", F.inline_outer(F.filter(each, lambda e: e["value"].isNotNull()))).where("path is not null")  # an inner one is computed twice: as a filter too


def leading_name(lines: Column) -> Column:
    """The first of twelve lines that looks like a name."""
    t = F.transform(F.slice(lines, 1, 12), lambda s: s["said"])
    fits = F.filter(t, lambda x: F.length(x).between(3, 80) & ~x.rlike(HEADINGS) & (F.length(F.regexp_replace(x, r"\D", "")) * 3 <= F.length(x)))
    return text.squeeze(F.get(fits, F.lit(0)))


def with_lines(docs: DataFrame) -> DataFrame:
    """docs with `lines`: each line, stripped, folded, and folded in lower case. Every rule asks every line, so these are made once."""
    folded = lambda x: F.struct(x.alias("line"), text.strip(x).alias("said"), text.fold_accents(x).alias("folded"))
    parts = F.transform(F.split("text", r"\R", -1), folded)
    return docs.withColumn("lines", F.transform(parts, lambda s: F.struct(s["line"].alias("line"), s["said"].alias("said"), s["folded"].alias("folded"), F.lower(s["folded"]).alias("low"))))


def raw_values(key: str) -> list[Column]:
    """What follows each label of a type, from `lines`."""
    return [_find(F.col("lines"), r) for r in specs.EXTRACT[key]]


def value_map(key: str, raw: list[Column]) -> Column:
    """map<path,string> of a type's fields from its raw values, `text` and `lines`; null values are left out."""
    of_kind: dict[str, list[tuple[str, Column]]] = {}
    for r, c in zip(specs.EXTRACT[key], raw, strict=True):
        of_kind.setdefault(r[1], []).append((r[0], c))

    def reader(kind: str) -> Callable[[Column], Column]:
        return lambda x: _value(x, kind)

    # one expression for each kind, bound once
    read = F.struct(*(F.transform(F.array(*(c for _, c in rows)), reader(kind)).alias(kind) for kind, rows in of_kind.items()))
    return bind(read, lambda v: _assembled(key, {p: v[kind][i] for kind, rows in of_kind.items() for i, (p, _) in enumerate(rows)}))


def _assembled(key: str, values: dict[str, Column]) -> Column:
    """The map of a type's labelled values, with what a sweep of the whole text adds."""
    first = lambda x, rx: F.nullif(F.regexp_extract(x, rx, 1), F.lit(""))
    if key in ("invoice", "purchase_order"):
        sweep = {"bank_details.iban": ids.iban_key(first(F.upper("text"), IBAN)), "bank_details.account_number": first(F.col("text"), ACCOUNT)}
        values |= {p: F.coalesce(values.get(p, F.lit(None).cast("string")), v) for p, v in sweep.items()}
    values["currency"] = F.coalesce(values["currency"], numbers.currency(first(F.col("text"), CURRENCY)))
    if key == "invoice":
        values["supplier.name"] = leading_name(F.col("lines"))
    if key == "receipt":
        values["merchant_name"] = leading_name(F.col("lines"))
    pairs = F.map_from_arrays(F.array(*(F.lit(p) for p in values)), F.array(*values.values()))
    return F.map_filter(pairs, lambda k, v: v.isNotNull())


def extract(docs: DataFrame, key: str) -> DataFrame:
    """docs (doc_id, text) of one type as (doc_id, values map<path,string>)."""
    rows = with_lines(docs.select("doc_id", "text"))
    n = len(specs.EXTRACT[key])
    rows = rows.select("doc_id", "text", "lines", *(c.alias(f"r{i}") for i, c in enumerate(raw_values(key))))
    return rows.select("doc_id", value_map(key, [F.col(f"r{i}") for i in range(n)]).alias("values"))


def payload(values: Column, key: str) -> Column:
    """A map of dotted paths as the type's struct; lists are absent."""
    schema = specs.schema(key)

    def build(node, prefix: str) -> Column:  # noqa: ANN001
        out = []
        for f in node.fields:
            path = f"{prefix}{f.name}"
            if f.dataType.typeName() == "struct":
                out.append(build(f.dataType, path + ".").alias(f.name))
            elif f.dataType.typeName() == "array":
                out.append(F.lit(None).cast(f.dataType).alias(f.name))
            else:
                out.append(F.try_element_at(values, F.lit(path)).alias(f.name))
        return F.struct(*out)

    return build(schema, "")


#: Models whose answers are the rules' own.
NOT_INDEPENDENT = ["fixture-heuristic"]


def cross_checked(fields: DataFrame, baseline: DataFrame) -> DataFrame:
    """fields (doc_id, path, value, model) with `baseline` and `agreement` by what the rules read (doc_id, path, baseline).

    Null where the rules read nothing, or where the model is the rules.
    """
    from .confidence import agreement_signal

    own = F.coalesce(F.col("model").isin(*NOT_INDEPENDENT), F.lit(False))
    both = fields.join(baseline, ["doc_id", "path"], "left").withColumn("baseline", F.when(~own, F.col("baseline")))
    return both.withColumn("agreement", agreement_signal(F.col("value"), F.col("baseline")))
