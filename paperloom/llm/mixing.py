"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words: its weight's share of the total, at most CAP times what it
has, the excess shared again by weight. Every document of a source starts at target / size copies; the
whole part is fixed and the fraction is a probability. Rounding pairs two open documents, the larger ones
first, and moves words from one to the other at random, as far as one of them becomes whole; the words taken
stay the same, no probability changes in expectation, and the one that is left open meets the next. Blocks of
documents round at the same time; the one document that a block leaves open goes to the next level of a
reduction tree, and each source's last one is drawn by its own probability. So a source misses its target by less
than the size of that one document.

Sources are ranked, shared out and reshared in tables: no row for each source comes to the driver. Random numbers
come from the source, the level and the block: the same rows give the same mix. A null source is one source, after
all others. Null and empty texts have size 0. Rows alike in id, text and source are one unit; it takes the whole
part of m times its probability, and what is left of it is one document in the rounding. A null doc_id is an id. An
empty table gives no rows; other columns are not read, and `resample` returns them unchanged.
"""

from __future__ import annotations

import zlib
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, save, small, text_key

BLOCK, FAN_IN = 4096, 1024
#: Weights by rank, and the share of all words that is taken, as a fraction.
WEIGHTS, SHARE, CAP = (5, 2, 1), (3, 2), 2


def _ranked(sources: DataFrame) -> DataFrame:
    """sources (source, ...) with `source_no`, its place by code point from 0, null last: by ranges, each numbered by itself."""
    by = [F.col("source").isNull(), F.col("source").cast("binary")]
    dealt = save(sources.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), "source-ranges")
    sizes = dealt.groupBy("part").count()
    before = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))  # a row for each range
    nth = F.row_number().over(Window.partitionBy("part").orderBy(*by))
    return dealt.withColumn("nth", nth).join(F.broadcast(before), "part").withColumn("source_no", F.col("before") + F.col("nth") - 1).drop("part", "nth", "before")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP) -> DataFrame:
    """sources (source, words, ...) -> with source_no and target, in words; no target is above cap times its source.

    Whole numbers throughout: with R / share[1] words left for open sources of weight W in all, a source of weight w
    is above its cap if R * w > cap * words * share[1] * W.
    """
    ranked = _ranked(sources).withColumn("weight", F.array(*(F.lit(w) for w in weights))[F.pmod("source_no", F.lit(len(weights))).cast("int")])
    now = save(ranked.withColumn("goal", F.lit(None).cast("decimal(38,0)")), "goals")  # over share[1]; null: open
    rest = None
    big = lambda x: F.lit(Decimal(x)).cast("decimal(20,0)")
    while True:
        total, taken, open_ = now.agg(F.sum("words"), F.sum("goal"), F.sum(F.when(F.col("goal").isNull(), F.col("weight")))).first()
        if not open_:
            break
        rest = share[0] * int(total) - int(taken or 0)
        top = (F.col("words") * (cap * share[1])).cast("decimal(20,0)")
        over = F.col("goal").isNull() & ((big(rest) * F.col("weight")).cast("decimal(38,0)") > (top * open_).cast("decimal(38,0)"))
        step = save(now.withColumn("goal", F.when(over, top.cast("decimal(38,0)")).otherwise(F.col("goal"))), "goals")
        if step.where("goal is not null").count() == now.where("goal is not null").count():
            return now.withColumn("target", F.coalesce(F.col("goal").cast("double") / share[1], F.lit(float(rest)) * F.col("weight") / F.lit(float(share[1] * open_)))).drop("goal", "weight")
        now = step
    return now.withColumn("target", F.col("goal").cast("double") / share[1]).drop("goal", "weight")


def round_block(weight: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities x, for documents in descending weight, after rounding: at most one is left open.

    The sum of weight * x does not change, but for documents of weight 0, which are drawn by themselves.
    """
    x, eps = x.astype(float).copy(), 1e-12
    free = weight <= 0
    x[free] = rng.random(free.sum()) < x[free]
    w, p, draws = weight.astype(float).tolist(), x.tolist(), rng.random(len(x)).tolist()
    i = -1  # the open one
    for j in np.flatnonzero((x > eps) & (x < 1 - eps)).tolist():
        if i < 0:
            i = j
            continue
        up, down = min(w[i] * (1 - p[i]), w[j] * p[j]), min(w[i] * p[i], w[j] * (1 - p[j]))
        step = up if draws[j] * (up + down) < down else -down
        p[i] += step / w[i]
        p[j] -= step / w[j]
        for k in (i, j):
            p[k] = 0.0 if p[k] < eps else 1.0 if p[k] > 1 - eps else p[k]
        i = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1
    out = np.array(p)
    out[out < eps], out[out > 1 - eps] = 0.0, 1.0
    return out


#: Ids travel as text: pandas would turn whole numbers beside a null into doubles.
_UNIT = "source_no long, block long, doc_id string, key binary, size long, m long, whole long, x double"


def _level(level: int, last: bool):  # noqa: ANN202
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(id=[-(2**63) if v is None else int(v) for v in rows["doc_id"]], k=[bytes(v) for v in rows["key"]])
        rows = rows.sort_values(["size", "id", "k"], ascending=[False, True, True], ignore_index=True)
        rng = np.random.default_rng([int(rows["source_no"].iloc[0]), level, zlib.crc32(str(rows["block"].iloc[0]).encode())])
        x = round_block(rows["size"].to_numpy(), rows["x"].to_numpy(), rng)
        if last:
            some = (x > 0) & (x < 1)
            x[some] = rng.random(some.sum()) < x[some]
        return rows.assign(x=x).drop(columns=["id", "k"])

    return run


def mix(docs: DataFrame) -> DataFrame:
    """(source, doc_id, key, size, m, source_size, target, copies) for each unit of docs: m rows, taken `copies` times in all."""
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    units = save(rows.select("source", "doc_id", text_key(F.col("text")).alias("key"), n_words(F.col("text")).alias("size")).groupBy("source", "doc_id", "key", "size").agg(F.count("*").alias("m")), "units")
    sources = save(targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("words"), F.count("*").alias("units"))), "sources")
    n, most = sources.agg(F.count("*"), F.max("units")).first()
    rate = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(0.0)
    known = sources.select(F.col("source").alias("s"), "source_no", rate.alias("rate"), F.ceil(F.col("units") / BLOCK).alias("blocks"))
    joined = units.join(small(known, n), F.col("source").eqNullSafe(F.col("s")))
    every = F.col("m") * F.col("rate")
    now = joined.select("source_no", F.pmod(F.xxhash64("doc_id", "key"), "blocks").alias("block"), F.col("doc_id").cast("string").alias("doc_id"), "key", "size", "m", F.floor(every).cast("long").alias("whole"), (every - F.floor(every)).alias("x"))
    done, width, level = None, -(-(most or 0) // BLOCK), 0
    while True:
        last = width <= 1
        now = save(now.groupBy("source_no", "block").applyInPandas(_level(level, last), _UNIT), "rounded")
        whole = now.where("x = 0 or x = 1")
        done = whole if done is None else done.unionByName(whole)
        if last:
            break
        now = now.where("x > 0 and x < 1").withColumn("block", F.floor(F.col("block") / FAN_IN))
        width, level = -(-width // FAN_IN), level + 1
    named = sources.select("source_no", "source", F.col("words").alias("source_size"), "target")
    return done.join(small(named, n), "source_no").select("source", F.col("doc_id").cast("long").alias("doc_id"), "key", "size", "m", "source_size", "target", (F.col("whole") + F.col("x")).cast("long").alias("copies"))


def _nth_copies(nth: Column) -> Column:
    """Copies of the nth of a unit's m rows, from 1."""
    return F.floor(F.col("copies") / F.col("m")) + F.when(nth <= F.col("copies") % F.col("m"), 1).otherwise(0)


def resample(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it (0 to CAP times); all columns unchanged."""
    taken = save(mix(docs).where("copies > 0").select(F.col("source").alias("__source"), F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "copies", "m"), "taken")
    unit = F.struct(F.col("copies"), F.col("m")).alias("__unit")
    mine = (text_key(F.col("text").cast("string")) == F.col("__key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & F.col("source").cast("string").eqNullSafe(F.col("__source"))
    own = [F.col(f"`{c}`") for c in docs.columns]

    def picked(rows: DataFrame, nth: Column) -> DataFrame:
        n = F.floor(F.col("__unit.copies") / F.col("__unit.m")) + F.when(nth <= F.col("__unit.copies") % F.col("__unit.m"), 1).otherwise(0)
        return rows.withColumn("__n", n.cast("int")).where("__n > 0").withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*own)

    joined = docs.join(small(taken.select("__source", "__id", "__key", unit), 2 * taken.count()), mine)
    out = picked(joined.where("__unit.m = 1"), F.lit(1))
    if taken.where("m > 1").isEmpty():
        return out
    alike = Window.partitionBy("__source", "__id", "__key").orderBy(F.md5(F.to_json(F.struct(*own))), F.to_json(F.struct(*own)))  # rows of one id and text
    return out.unionByName(picked(joined.where("__unit.m > 1").withColumn("__row", F.row_number().over(alike)), F.col("__row")))


def op6_mixing(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    found = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    each = found.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * _nth_copies(F.col("row"))).cast("long").alias("taken"))
