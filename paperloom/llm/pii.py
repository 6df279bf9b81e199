"""Personal data: four fixed kinds, and identifiers that their contexts give away.

Spans of the fixed kinds are seeds. The word before and the word after each seed, and both together,
are patterns; so are those around every other token that holds a digit, `@` or `_`, and around groups of
digits. Patterns and instances form a
graph: a pattern is trusted as far as what it surrounds is known to be of one kind, and an instance as
far as its patterns are (noisy or). A few rounds of this, each written to the shared folder, let
trusted patterns find identifiers that no fixed rule knows; these are added as found_<kind>.

A null or empty text has no spans, and an empty table no rows. Texts are worked on whole, and by content, so rows
alike get equal spans, whatever their doc_id, null included. Scores that tie go to the kind listed first. Other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, small, text_key
from .spans import SPAN, Rule, digits, find, free_of, joined, luhn

ROUNDS, MIN_SEEDS, MIN_TRUST, MIN_SCORE, SMOOTH = 3, 3, 0.6, 0.8, 2.0


def _ip(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))


def _card(value: Column) -> Column:
    return F.length(digits(value)).between(14, 19) & luhn(digits(value))


#: Base kinds, as listed. Possessive forms match as the plain ones do, without trying again; a match starts where
#: its run of characters or the search does.
RULES = [
    Rule("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@")),
    Rule("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]"), _ip),
    Rule("card", r"[0-9]++(?:[\x20-][0-9]++)*+", lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), _card),
    Rule("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.rlike(r"\+[0-9]"), lambda v: F.length(digits(v)).between(10, 15)),
]
_IN = r"[^\s.,;:!?()\[\]{}\"'<>]"
#: Groups of digits, or a token with a digit, `@` or `_`, without the punctuation around it. What they are is left to the patterns.
CANDIDATE = Rule(
    "candidate",
    rf"(?<![^\s.,;:!?()\[\]{{}}\"'<>=])(?:\+?\(?[0-9]++(?:[)\x20./-]++\(?[0-9]++)++(?!{_IN})|(?=[^\s,;:!?()\[\]{{}}\"'<>0-9@_]*+[0-9@_]){_IN}++(?:\.++{_IN}++)*+)",
    lambda t: t.rlike(r"[0-9@_]"),
)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base array of spans, marks): one pass over the texts."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", "text", *(find(text, r, i, words=True).alias(r.kind) for i, r in enumerate(RULES)), find(text, CANDIDATE, len(RULES), words=True).alias("other"))
    rows = rows.withColumn("base", F.array_sort(F.concat(*(F.col(r.kind) for r in RULES))))
    marks = F.transform(F.concat("base", free_of(F.col("other"), F.col("base"), text)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind_no"].alias("kind_no"), F.lower(s["value"]).alias("instance"), F.lower(s["before"]).alias("before"), F.lower(s["after"]).alias("after")))
    base = F.transform("base", lambda s: F.struct(*(s[c].alias(c) for c in ("start", "kind_no", "end", "kind", "value"))))
    return rows.select("doc_id", text_key(text).alias("key"), base.alias("base"), F.when(F.size("base") + F.size("other") > 0, marks).alias("marks"))


def _edges(scanned: DataFrame) -> DataFrame:
    """(pattern, instance, kind_no, n): how often each instance stands in each pattern; candidates have a null kind."""
    marks = scanned.where("marks is not null").select(F.inline("marks"))
    none = F.lit(None).cast("string")
    pattern = F.array_compact(F.array(
        F.when(F.col("before") != "", F.concat(F.lit("< "), "before")).otherwise(none),
        F.when(F.col("after") != "", F.concat(F.lit("> "), "after")).otherwise(none),
        F.when((F.col("before") != "") & (F.col("after") != ""), F.concat(F.lit("= "), "before", F.lit(" "), "after")).otherwise(none),
    ))
    kind = F.when(F.col("kind_no") < len(RULES), F.col("kind_no"))
    return marks.select("instance", kind.alias("kind_no"), F.explode(pattern).alias("pattern")).groupBy("pattern", "instance", "kind_no").agg(F.count("*").alias("n"))


def discover(scanned: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(instance, kind_no, score) of the candidates that trusted patterns identify."""
    edges = save(_edges(scanned), "edges")
    seeds = edges.where("kind_no is not null").select("pattern", "instance", "kind_no", "n", F.lit(1.0).alias("score"))
    others = edges.where("kind_no is null").select("pattern", "instance", "n")
    total = save(edges.groupBy("pattern").agg(F.sum("n").alias("total")), "pattern-totals")
    known = None
    for _ in range(rounds):
        facts = seeds
        if known is not None:
            facts = facts.unionByName(others.join(known, "instance").select("pattern", "instance", "kind_no", "n", "score"))
        trust = facts.groupBy("pattern", "kind_no").agg(F.sum(F.col("n") * F.col("score")).alias("hits"), F.count("*").alias("support"))
        trust = trust.where(F.col("support") >= MIN_SEEDS).join(total, "pattern").select("pattern", "kind_no", (F.col("hits") / (F.col("total") + SMOOTH)).alias("trust")).where(F.col("trust") >= MIN_TRUST)
        scored = others.join(trust, "pattern").groupBy("instance", "kind_no").agg((1 - F.exp(F.sum(F.log1p(-F.least("trust", F.lit(0.999)))))).alias("score"))
        best = scored.groupBy("instance").agg(F.max(F.struct("score", (-F.col("kind_no")).alias("k"))).alias("s"))
        known = save(best.where(F.col("s.score") >= MIN_SCORE).select("instance", (-F.col("s.k")).cast("int").alias("kind_no"), F.col("s.score").alias("score")), "known")
    return known


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) for each row of docs: arrays of spans."""
    scanned = save(scan(docs), "scanned")
    known = discover(scanned)
    kinds = F.array(*(F.lit(f"found_{r.kind}") for r in RULES))
    spots = scanned.where("marks is not null").select("key", F.inline("marks")).where(F.col("kind_no") == len(RULES)).drop("kind_no")
    added = spots.join(known, "instance").select("key", F.struct(F.col("start"), (F.col("kind_no") + len(RULES)).cast("int").alias("kind_no"), F.col("end"), kinds[F.col("kind_no")].alias("kind"), F.col("instance").alias("value")).cast(SPAN).alias("span"))
    added = save(added.groupBy("key").agg(F.collect_set("span").alias("added")), "added")
    return scanned.join(small(added, 10 * added.count()), "key", "left").select("doc_id", "base", F.concat("base", F.coalesce("added", F.array().cast(f"array<{SPAN}>"))).alias("spans"))


def op4_pii(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind_no"] == i)).cast("long")
    return found.select("doc_id", *(count(i).alias(f"n_{r.kind}") for i, r in enumerate(RULES)), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
