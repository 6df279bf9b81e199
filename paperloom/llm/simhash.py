"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits are cut into m parts of correlated bits. Part i gets a threshold t_i with
sum(t_i) = tau - m + 1 (t_i = -1 leaves a part out); then any two fingerprints within tau differ by
at most t_i in some part i. m and the t_i come from a dynamic programme over the candidate counts
that a bounded sample predicts; they decide the cost only, never the result. Every fingerprint is
indexed and probed, buckets over a size are split into pairs of blocks, and each bucket returns a
spanning forest of its verified links, not its pairs.

Nulls, empty texts and texts without words have fingerprint zero and link like any other. A null
doc_id takes part and gets the smallest doc_id of its component (null if there is none). Texts of any length are
hashed whole; rows alike are one fingerprint; an empty table gives no rows; other columns are not read, and
`keep_one` returns them unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, small, text_key
from .components import Forest, connected_components
from .textvec import tidy

#: Fingerprints that the partition plan is fitted on; the plan changes cost, never results.
PLAN_SAMPLE = 2048
#: A bucket of more fingerprints than this is dealt out as pairs of blocks.
BUCKET = 8192
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes, shingle: int = 4, block: int = 1 << 16) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text, repeats included."""
    found = text.translate(_LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    start = end - size
    m = max(1, len(found) - shingle + 1)
    last = end[min(shingle, len(found)) - 1 :]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    starts, ends = start[:m].tolist(), last[:m].tolist()
    for i in range(0, m, block):
        h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[i : i + block], ends[i : i + block], strict=True)), np.uint64, min(block, m - i))
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > m, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):  # noqa: ANN202
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch["text"].cast(pa.large_binary())
            out = np.fromiter((fingerprint(x.as_py() or b"", shingle) for x in text), np.uint64, len(text))
            yield pa.RecordBatch.from_pydict({c: batch[c] for c in batch.schema.names if c != "text"} | {"fp": pa.array(out.view(np.int64))})

    return run


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id long, fp long) for each row of docs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints(4), "doc_id long, fp long")


def keyed_fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id long, key binary, fp long): with the content key of the text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("key"), text.alias("text")).mapInArrow(_fingerprints(shingle), "doc_id long, key binary, fp long")


# ---- the plan -----------------------------------------------------------------------------------


def correlated_parts(bits: np.ndarray, m: int) -> list[list[int]]:
    """m groups of about equal width; a group grows by the bit most correlated with those it has."""
    with np.errstate(invalid="ignore"):
        corr = np.abs(np.nan_to_num(np.corrcoef(bits.T.astype(float))))
    left, parts = list(range(64)), []
    for i in range(m):
        width = len(left) // (m - i)
        part = [left.pop(0)]
        while len(part) < width:
            best = max(left, key=lambda b: (corr[b, part].sum(), -b))
            left.remove(best)
            part.append(best)
        parts.append(part)
    return parts


def _ball(width: int, t: int) -> int:
    out = c = 1
    for i in range(t):
        c = c * (width - i) // (i + 1)
        out += c
    return out if t >= 0 else 0


def plan(sample: np.ndarray, n: int, tau: int = 4, probe_cost: float = 40.0) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is probed, for n fingerprints of which sample is a sample.

    Cost of a part at threshold t: n index rows and n * ball probes, each worth probe_cost pair checks,
    plus the candidate pairs that the sample's part distances predict for n fingerprints.
    """
    bits = np.unpackbits(np.ascontiguousarray(sample).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(1, tau + 2):
        parts, budget = correlated_parts(bits, m) if len(sample) > 1 else [list(range(i, 64, m)) for i in range(m)], tau - m + 1
        costs = []
        for part in parts:
            x = bits[:, part].astype(np.float32)
            ones = x.sum(axis=1)
            apart = ones[:, None] + ones[None, :] - 2 * (x @ x.T)
            pairs = max(1, len(sample) * (len(sample) - 1))
            near = [((apart <= t + 0.5).sum() - len(sample) + 1) / pairs for t in range(budget + m)]
            costs.append([0.0] + [probe_cost * n * _ball(len(part), t) + near[t] * float(n) * n / 2 for t in range(budget + m)])
        # least cost with thresholds summing to the budget; thresholds run from -1
        reach: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in reach.items():
                for t in range(-1, min(len(cost) - 1, budget + m)):
                    if (s + t not in step or c + cost[t + 1] < step[s + t][0]) and s + t <= budget + m:
                        step[s + t] = (c + cost[t + 1], [*ts, t])
            reach = step
        if budget in reach and (best is None or reach[budget][0] < best[0]):
            best = reach[budget][0], [(p, t) for p, t in zip(parts, reach[budget][1], strict=True) if t >= 0]
    return best[1]


def _masks(width: int, t: int) -> np.ndarray:
    out = [0]
    if t >= 1:
        out += [1 << i for i in range(width)]
    if t >= 2:
        from itertools import combinations

        out += [sum(1 << i for i in c) for k in range(2, t + 1) for c in combinations(range(width), k)]
    return np.array(out, np.uint64)


def _project(fp: np.ndarray, part: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for i, b in enumerate(part):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def _emit(parts: list[tuple[list[int], int]]):  # noqa: ANN202
    """Bucket keys of each fingerprint: its own value in a part, and probes for the values within t_i."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            for i, (part, t) in enumerate(parts):
                own, masks = _project(fp, part), _masks(len(part), t)
                for j in range(0, len(masks), 64):
                    some = masks[j : j + 64]
                    key = (own[:, None] ^ some[None, :]).ravel()
                    probe = np.tile(some != 0, len(fp))
                    yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(key), i, np.int32)), "key": pa.array(key.view(np.int64)), "fp": pa.array(np.repeat(fp, len(some)).view(np.int64)), "probe": pa.array(probe)})

    return run


def _forest(fp: np.ndarray, group: np.ndarray, probe: np.ndarray, tau: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of each group's pairs within tau; rows are sorted by group.

    Compares every row with the d-th after it, d = 1, 2, ...: each pair of a group once. A block of
    shifts that has many verified pairs is cut down by current labels before any link is made.
    """
    n = len(fp)
    last = np.searchsorted(group, group, "right")
    label = np.arange(n)
    forest, links = Forest(), []
    at, d = np.arange(n), 1
    while True:
        at = at[last[at] > at + d]
        if not len(at):
            return links
        a, b = at, at + d
        near = (np.bitwise_count(fp[a] ^ fp[b]) <= tau) & ~(probe[a] & probe[b])
        a, b = a[near], b[near]
        new = label[a] != label[b]
        a, b = a[new], b[new]
        if len(a):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                if forest.join(x, y):
                    links.append((int(fp[x]), int(fp[y])))
            touched = np.fromiter(forest.up, np.int64, len(forest.up))
            label[touched] = [forest.find(x) for x in touched.tolist()]
        d += 1


def _verify(tau: int):  # noqa: ANN202
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(rows: pa.Table) -> pa.RecordBatch:
            col = {c: rows[c].to_numpy() for c in ("part", "key", "pair", "fp", "probe")}
            change = np.ones(len(rows), bool)
            change[1:] = (col["part"][1:] != col["part"][:-1]) | (col["key"][1:] != col["key"][:-1]) | (col["pair"][1:] != col["pair"][:-1])
            links = _forest(col["fp"].view(np.uint64), np.cumsum(change), col["probe"].astype(bool), tau)
            signed = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_pydict({"a": pa.array(signed[:, 0]), "b": pa.array(signed[:, 1])})

        for batch in batches:  # sorted by bucket; the last bucket of a batch may go on in the next
            held.append(batch)
            if sum(map(len, held)) < 50_000:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            end = len(rows) - 1
            col = [rows[c].to_numpy() for c in ("part", "key", "pair")]
            same = np.ones(len(rows), bool)
            for c in col:
                same &= c == c[end]
            cut = int(np.argmax(same))
            if cut:
                yield settle(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
        if held:
            yield settle(pa.Table.from_batches(held).combine_chunks())

    return run


def links(distinct: DataFrame, tau: int = 4, bucket: int = BUCKET) -> DataFrame:
    """distinct (fp long, no repeats) -> (a, b): links that connect what pairs within tau connect."""
    n = distinct.count()
    sample = np.array([r[0] for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(PLAN_SAMPLE).collect()], np.int64).view(np.uint64)
    parts = plan(sample, n, tau) if n > 1 else []
    if not parts:
        return distinct.sparkSession.createDataFrame([], "a long, b long")
    rows = distinct.mapInArrow(_emit(parts), "part int, key long, fp long, probe boolean")
    hot = save(rows.groupBy("part", "key").count().where(F.col("count") > bucket), "hot-buckets")
    n_hot = hot.count()
    if n_hot:
        blocks = F.ceil(F.coalesce("count", F.lit(1)) / bucket).cast("int")
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        pairs = F.expr("transform(sequence(0, blocks - 1), j -> least(j, mine) * cast(blocks as long) + greatest(j, mine))")
        rows = rows.join(small(hot, n_hot), ["part", "key"], "left").withColumn("blocks", blocks).withColumn("mine", mine).select("part", "key", "fp", "probe", F.explode(pairs).alias("pair"))
    else:
        rows = rows.withColumn("pair", F.lit(0).cast("long"))
    dealt = rows.repartition(F.col("part"), F.col("key"), F.col("pair")).sortWithinPartitions("part", "key", "pair")
    return dealt.mapInArrow(_verify(tau), "a long, b long")


def components(prints: DataFrame, tau: int = 4, bucket: int = BUCKET) -> DataFrame:
    """prints (doc_id, fp) -> (fp, root, component_id): the least fingerprint and the least doc_id that links within tau reach."""
    classes = save(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "classes")
    rooted = connected_components(links(classes.select("fp"), tau, bucket))
    rooted = classes.join(rooted, classes.fp == rooted.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    reached = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return save(rooted.join(reached, "root").select("fp", "root", "component_id"), "reached")


def near_duplicates(docs: DataFrame, tau: int = 4, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs."""
    prints = save(fingerprints(docs), "prints")
    return prints.join(components(prints, tau, bucket), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, tau: int = 4, bucket: int = BUCKET) -> DataFrame:
    """One row of docs of each component, the one of least doc_id; all columns unchanged.

    Components of rows without an id keep one of them. Rows that share that least id keep one.
    """
    prints = save(keyed_fingerprints(docs), "prints")
    return keep_first(docs, prints.join(components(prints, tau, bucket), "fp").select("doc_id", "key", "root", "component_id"))


def keep_first(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """The rows of docs that keep_one leaves, given (doc_id, key, root, component_id) of each."""
    placed = save(placed.select("doc_id", "key", "root", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("first")), "placed")
    mine = (F.col("doc_id").cast("long").eqNullSafe(F.col("__id"))) & (text_key(F.col("text").cast("string")) == F.col("__key"))
    gone = placed.where("not first").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct()
    left = docs.join(small(gone, gone.count()), mine, "left_anti")
    tied = placed.where("first").groupBy("root").agg(F.count("*").alias("n")).where("n > 1")
    if tied.isEmpty():
        return left
    roots = placed.where("first").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("root").alias("__root")).distinct()
    return left.join(roots, mine).dropDuplicates(["__root"]).select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
