"""Benchmark decontamination by winnowing, on DataFrame operators only.

Of the 5-word grams in every run of 10 words the one of least hash is kept, for texts and benchmark
items alike; equal runs keep equal grams, so a join of the kept grams misses no shared run of 10 words.
Each candidate is then held against the item word by word, five to either side, and counts if 10 words
or more agree. Items of under 10 words are one window each and are looked up whole.

Texts are worked on once by content (MD5), whatever their ids. A null or empty text, and a null or
empty item, has no words and matches nothing; a null item_id counts as the id `null`. Items that share
an id are one item. Texts of any length are matched whole; rows alike get equal results; an empty table of
documents gives no rows, one of items no hits. Other columns are not read, and `decontaminate` returns them unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, small, text_key

GRAM, SPAN = 5, 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RAW_SEP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; an empty array for null."""
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.array_remove(F.split(low, _SEP, -1), ""), F.array().cast("array<string>"))


def count_words(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, _RAW_SEP, -1), "")), F.lit(0)).cast("long")


def _grams(rows: DataFrame) -> DataFrame:
    """rows with words `w` get the hash `g` of each run of GRAM words."""
    return rows.withColumn("g", F.expr(f"IF(size(w) < {GRAM}, array(), transform(sequence(1, size(w) - {GRAM - 1}), i -> xxhash64(slice(w, i, {GRAM}))))"))


def _kept(rows: DataFrame) -> DataFrame:
    """rows with grams `g` get the distinct least grams `kept` of each run of SPAN words."""
    width = SPAN - GRAM + 1
    return rows.withColumn("kept", F.expr(f"IF(size(g) < {width}, array(), array_distinct(transform(sequence(1, size(g) - {width - 1}), i -> array_min(slice(g, i, {width})))))"))


def _short(lengths: list[int]) -> Column:
    """Hashes of all runs of the given numbers of words."""
    runs = [F.expr(f"IF(size(w) < {n}, array(), transform(sequence(1, size(w) - {n - 1}), i -> xxhash64(slice(w, i, {n}), {n})))") for n in lengths]
    return F.array_distinct(F.concat(*runs)) if runs else F.array().cast("array<bigint>")


def _agree() -> list[Column]:
    """Words of ctx and item that agree in a row to the left and to the right of the gram."""
    left = F.expr(f"aggregate(sequence(1, {SPAN - GRAM}), 0, (a, k) -> IF(a = k - 1 AND ctx[{SPAN - GRAM} - k] = item[{SPAN - GRAM} - k], k, a))")
    right = F.expr(f"aggregate(sequence(1, {SPAN - GRAM}), 0, (a, k) -> IF(a = k - 1 AND ctx[{SPAN - 1} + k] = item[{SPAN - 1} + k], k, a))")
    return [left.alias("left"), right.alias("right")]


def _context() -> str:
    pad = f"array_repeat(CAST(NULL AS STRING), {SPAN - GRAM})"
    return f"concat({pad}, w, {pad})"


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, n_hit, items array<string>) of each distinct text of docs that shares a window with an item."""
    pad, span = SPAN - GRAM, SPAN + (SPAN - GRAM)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), words(F.col("text").cast("string")).alias("w"))
    items = save(_kept(_grams(items)).where(F.size("w") > 0), "items")
    lengths = sorted(r[0] for r in items.where(F.size("w") < SPAN).select(F.size("w")).distinct().collect())  # at most SPAN - 1
    looked_up = items.where(F.size("w") >= SPAN).select(F.explode("kept").alias("h")).unionByName(
        items.where(F.size("w") < SPAN).select(F.xxhash64("w", F.size("w")).alias("h"))
    )
    looked_up = save(looked_up.distinct(), "item-grams")

    texts = docs.select(text_key(F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"))
    prints = _kept(_grams(texts.select("key", words(F.col("text")).alias("w"))))
    prints = prints.select("key", F.explode(F.concat("kept", _short(lengths))).alias("h"))
    found = prints.join(small(looked_up, looked_up.count()), "h", "left_semi").groupBy("key").agg(F.collect_set("h").alias("found"))

    found = save(found, "candidates")
    # copies of a candidate merge within each task before they move
    candidates = texts.join(small(found.select("key"), found.count()), "key", "left_semi").dropDuplicates(["key"]).join(found, "key")
    candidates = save(candidates.select("key", "found", words(F.col("text")).alias("w")), "candidate-words")
    wanted = candidates.select("key", F.explode("found").alias("h"))
    # places of the hashes looked for: they meet by (text, hash), so that the work is linear in the words of a text
    spots = _grams(candidates.select("key", "w")).select("key", F.posexplode("g").alias("at", "h")).join(wanted, ["key", "h"], "left_semi")
    spots = spots.groupBy("key").agg(F.collect_list(F.struct((F.col("at") + 1).alias("at"), "h")).alias("spots"))
    # the padded words are bound once: Catalyst would build them again for each position
    long_at = F.expr(f"transform(array({_context()}), p -> transform(spots, s -> named_struct('at', s.at, 'h', s.h, 'ctx', slice(p, s.at, {span}))))[0]")
    mine = save(candidates.select("key", "w").join(spots, "key").select("key", long_at.alias("at")), "anchors")
    ctx = _context()

    long_items = items.where(F.size("w") >= SPAN)
    long_items = long_items.select("item_id", F.inline(F.expr(f"transform(array({ctx}), p -> transform(sequence(1, size(g)), i -> named_struct('h', g[i - 1], 'item', slice(p, i, {span}))))[0]")))
    long_items = save(long_items.groupBy("h", "item").agg(F.collect_set("item_id").alias("ids")), "item-contexts")
    pairs = mine.select("key", F.inline("at")).join(small(long_items, 20 * long_items.count()), "h")
    pairs = pairs.where(F.slice("ctx", pad + 1, GRAM) == F.slice("item", pad + 1, GRAM)).select("key", "at", "ids", *_agree())
    spans = pairs.where(F.col("left") + GRAM + F.col("right") >= SPAN).select("key", (F.col("at") - F.col("left")).alias("a"), (F.col("at") + GRAM - 1 + F.col("right")).alias("b"), "ids")
    if lengths:
        shorts = save(items.where(F.size("w") < SPAN).groupBy(F.xxhash64("w", F.size("w")).alias("h"), F.col("w").alias("item")).agg(F.collect_set("item_id").alias("ids")), "short-items")
        each = ", ".join(f"transform(IF(size(w) < {n}, array(), sequence(1, size(w) - {n - 1})), i -> named_struct('at', i, 'h', xxhash64(slice(w, i, {n}), {n})))" for n in lengths)
        placed = candidates.select("key", F.inline(F.expr(f"concat({each})"))).join(wanted, ["key", "h"], "left_semi").join(small(shorts, 20 * shorts.count()), "h")
        placed = placed.groupBy("key").agg(F.collect_list(F.struct("at", "item", "ids")).alias("placed"))
        held = candidates.select("key", "w").join(placed, "key").select("key", F.inline(F.expr("filter(placed, x -> slice(w, x.at, size(x.item)) = x.item)")))
        spans = spans.unionByName(held.select("key", F.col("at").alias("a"), (F.col("at") + F.size("item") - 1).alias("b"), "ids"))
    # runs of one text meet by key: they are as many as its words at most
    by_text = spans.groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("runs"), F.array_distinct(F.flatten(F.collect_set("ids"))).alias("items"))
    return by_text.select("key", F.expr("size(array_distinct(flatten(transform(runs, r -> sequence(r.a, r.b)))))").cast("long").alias("n_hit"), "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that share no window with any item, all columns unchanged."""
    bad = save(hits(docs, benchmark).select(F.col("key").alias("__key")), "contaminated")
    return docs.join(small(bad, bad.count()), text_key(F.col("text").cast("string")) == F.col("__key"), "left_anti")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = save(hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")), "hits")
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), count_words(F.col("text")).alias("n_words"))
    rows = rows.join(small(found, found.count()), "key", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


OP5_SQL = f"""
WITH item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
item_window AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
doc AS (
  SELECT doc_id, row_number() OVER () AS rn, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
doc_window AS (
  SELECT rn, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM doc, (SELECT DISTINCT n FROM item_window) AS lengths, unnest(range(1, len(w) - n + 2)) AS u(i)),
hit AS (SELECT rn, i, d.n, item_id FROM doc_window AS d JOIN item_window AS t ON d.s = t.s AND d.n = t.n),
hit_words AS (SELECT rn, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS u(p) GROUP BY rn),
hit_items AS (SELECT rn, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit_words USING (rn) LEFT JOIN hit_items USING (rn)"""
