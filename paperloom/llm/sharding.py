"""Weighted rendezvous hashing of record keys.

Every (key, shard) pair hashes to a uniform number u; a record goes to the shard of least
-ln(u) / weight. A new shard takes only the records it wins, and takes them from all others;
nothing else moves. The hash is MD5 of the key's text, so any engine gives the same shards.

A null key is the text `null`; rows with one key go to one shard. Slots number a shard's rows from 0
without gaps, ordered by (bucket of the key, key, checksum, size): buckets of about BUCKET_ROWS rows
a shard let the numbering run in parallel, offset by the counts before them. Rows alike in all of
these are interchangeable. Null texts have size 1, texts of any length count whole, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small

BUCKET_ROWS = 20_000


def unit_hash(key: Column, salt: str) -> Column:
    """52 bits of MD5(key#salt) as an integer."""
    text = F.concat_ws("#", F.coalesce(key.cast("string"), F.lit("null")), F.lit(salt))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def shard_of(key: Column, weights: list[float]) -> Column:
    """Index of the shard that wins the key; a shard of weight 0 wins nothing."""
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a weight")
    score = lambda i: -F.log((unit_hash(key, str(i)) + F.lit(0.5)) / F.lit(float(2**52))) / F.lit(float(weights[i]))
    return F.array_min(F.array(*(F.struct(score(i).alias("score"), F.lit(i).alias("shard")) for i in range(len(weights)) if weights[i] > 0)))["shard"]


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def with_slots(rows: DataFrame, n_rows: int) -> DataFrame:
    """rows (doc_id, size, text_crc32, shard, ...) with `slot`, gapless from 0 in each shard."""
    buckets = max(1, -(-n_rows // BUCKET_ROWS))
    rows = rows.withColumn("__bucket", F.pmod(unit_hash(F.col("doc_id"), "bucket"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "__bucket").count().select("shard", "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("shard", "__bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("__nth", F.row_number().over(inside) - 1)
    return numbered.join(small(starts, 1024 * buckets), ["shard", "__bucket"]).withColumn("slot", (F.col("__start") + F.col("__nth")).cast("long")).drop("__bucket", "__nth", "__start")


def assign(docs: DataFrame, weights: list[float], grown: float = 1.0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): grown_shard is the shard with one more of weight `grown`."""
    key, text = F.col("doc_id"), F.col("text").cast("string")
    rows = docs.select(
        "doc_id", text_size(text).alias("size"), text_crc32(text).alias("text_crc32"), F.lit("key").alias("law"),
        shard_of(key, weights).alias("shard"), shard_of(key, [*weights, grown]).alias("grown_shard"),
    )
    return with_slots(rows, docs.count()).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def place(docs: DataFrame, weights: list[float]) -> DataFrame:
    """docs with `shard` and `slot`; columns of docs that have these names give way."""
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), "doc_id", text_size(text).alias("size"), text_crc32(text).alias("text_crc32"), shard_of(F.col("doc_id"), weights).alias("shard"))
    others = [F.col("__row")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return with_slots(rows, docs.count()).select(*others, "shard", "slot")


def op2_sharding(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), [1.0] * 8)


def _winner(n: int) -> str:
    shards = ", ".join(f"{{'score': -ln((CAST('0x' || substr(md5(k || '#{i}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0), 'shard': {i}}}" for i in range(n))
    return f"list_sort([{shards}])[1].shard"


OP2_SQL = f"""
WITH step AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab),
rows_ AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, coalesce(text, '') AS t, count(*) OVER () AS n FROM documents),
points AS (
  SELECT doc_id, k, n, CAST(octet_length(encode(t)) + 1 AS BIGINT) AS size,
    CASE WHEN t = '' THEN [] ELSE flatten(list_transform(string_split(t, ''), lambda x: CASE
      WHEN unicode(x) < 128 THEN [unicode(x)]
      WHEN unicode(x) < 2048 THEN [192 | (unicode(x) >> 6), 128 | (unicode(x) & 63)]
      WHEN unicode(x) < 65536 THEN [224 | (unicode(x) >> 12), 128 | ((unicode(x) >> 6) & 63), 128 | (unicode(x) & 63)]
      ELSE [240 | (unicode(x) >> 18), 128 | ((unicode(x) >> 12) & 63), 128 | ((unicode(x) >> 6) & 63), 128 | (unicode(x) & 63)] END)) END AS bytes
  FROM rows_),
placed AS (
  SELECT doc_id, k, n, size, xor(list_reduce(list_transform(bytes, lambda b: CAST(b AS BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32,
    {_winner(8)} AS shard, {_winner(9)} AS grown_shard
  FROM points, step)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, CAST(grown_shard AS INTEGER) AS grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5(k || '#bucket'), 1, 13) AS BIGINT) % CAST(greatest(1, ceil(n / {BUCKET_ROWS}.0)) AS BIGINT), doc_id, text_crc32, size) - 1 AS slot
FROM placed"""
