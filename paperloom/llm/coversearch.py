"""Exact top-k inner products by a dual-tree search on cover trees.

A net of centres over a bounded sample cuts the space: each vector belongs to the cell of its nearest centre, so
the blocks of the data are compact, and a cell that holds many is cut further by hash. No pair (q, r) below nodes
with centres a, b and covering radii s, t scores above <a,b> + s|b| + t|a| + st. Scores against the sample give
every query a floor, and a cell of queries meets only the cells of data whose bound reaches the least floor in
it. Where the two meet, each side gets a cover tree, pairs of nodes are left out against the least kth score of
the query node, and what is left is scored by matrix products, best bound first, until the bounds fall
below the scores that the queries have by then. Products are whole numbers that doubles hold exactly, else Python's integers.

Nodes of a cover tree have children that are more than half its radius apart and cover it within half its radius;
where that takes more than CHILDREN of them, nothing compact is below and the node is a leaf of any size.

Vectors that are null, or hold a null or a component that is not finite, take no part; vectors of
unlike length do not meet. Rows alike in id and vector are one query, and as data each count. Equal scores go to the smaller id.
Few-valued data costs no more: equal vectors of a block are one point with its smallest 2k ids, of each at most k rows. A score beyond 64
bits is given as the end of their range. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save

BLOCK, GROUP, LEAF, CHILDREN = 8192, 16384, 32, 64
#: Rows that give the centres and each query's first floor, and centres at most; they change the pruning, never the result.
SAMPLE, CENTRES = 2048, 256
#: Rows of data that a leaf of queries is scored against between two looks at the bounds.
STEP = 2048
_EXACT = 2.0**53


def farthest_first(points: np.ndarray, most: int, apart: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres (rows, farthest point first) that are more than `apart` from each other, each row's centre and distance from it."""
    centres, owner = [0], np.zeros(len(points), np.int64)
    near = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    while len(centres) < most:
        far = int(near.argmax())
        if near[far] <= apart:
            break
        d = np.sqrt(((points - points[far]) ** 2).sum(axis=1))
        owner = np.where(d < near, len(centres), owner)
        near = np.minimum(near, d)
        centres.append(far)
    return np.array(centres), owner, near


class CoverTree:
    """centre, radius and norm of each node, its rows, and its children as a slice of `kids`."""

    def __init__(self, points: np.ndarray) -> None:
        self.points, centre, radius, self.rows, below = points, [], [], [], []
        stack = [(np.arange(len(points)), -1)] if len(points) else []
        while stack:
            rows, up = stack.pop()
            me = len(centre)
            if up >= 0:
                below[up].append(me)
            apart = np.sqrt(((points[rows] - points[rows[0]]) ** 2).sum(axis=1))
            centre.append(points[rows[0]])
            radius.append(float(apart.max()))
            self.rows.append(rows)
            below.append([])
            if len(rows) > LEAF and radius[me] > 0:
                _, owner, near = farthest_first(points[rows], CHILDREN + 1, radius[me] / 2)
                if near.max() <= radius[me] / 2:
                    for k in range(int(owner.max()) + 1):
                        # a child's centre is the net's, its first row
                        part = rows[owner == k]
                        first = np.flatnonzero(near[owner == k] == 0)[:1]
                        stack.append((np.concatenate([part[first], np.delete(part, first)]), me))
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.norm = np.sqrt((self.centre**2).sum(axis=1)) if centre else np.zeros(0)
        self.many = np.array([len(b) for b in below])
        self.start = np.cumsum(self.many) - self.many
        self.kids = np.array([c for b in below for c in b], np.int64)


def leaf_pairs(qt: CoverTree, rt: CoverTree, floor: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of leaves (a, b, bound) that may hold a score of a query's floor or more; walked from both roots, level by level."""
    least = np.array([floor[rows].min() for rows in qt.rows])
    a, b, found = np.zeros(1, np.int64), np.zeros(1, np.int64), []
    while len(a):
        bound = np.einsum("ij,ij->i", qt.centre[a], rt.centre[b]) + qt.radius[a] * rt.norm[b] + rt.radius[b] * qt.norm[a] + qt.radius[a] * rt.radius[b] + slack
        keep = bound >= least[a]
        a, b, bound = a[keep], b[keep], bound[keep]
        done = (qt.many[a] == 0) & (rt.many[b] == 0)
        found.append((a[done], b[done], bound[done]))
        a, b = a[~done], b[~done]
        right = (rt.many[b] > 0) & ((qt.many[a] == 0) | (rt.radius[b] >= qt.radius[a]))  # the wider one is opened
        n = np.where(right, rt.many[b], qt.many[a])
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        r, x, y = np.repeat(right, n), np.repeat(a, n), np.repeat(b, n)
        a, b = x.copy(), y.copy()
        b[r] = rt.kids[rt.start[y[r]] + at[r]]
        a[~r] = qt.kids[qt.start[x[~r]] + at[~r]]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _distinct(ids: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct points, each with the ids of its rows in order: of one id k at most, 2k in all.

    A query leaves out the rows of its own id, which are k of these at most; k others are all it can need.
    """
    uniq, at = np.unique(points, axis=0, return_inverse=True)
    at = at.ravel()
    order = np.lexsort((ids, at))
    at, ids = at[order], ids[order]
    same = np.concatenate([[True], (np.diff(at) != 0) | (np.diff(ids) != 0)]).nonzero()[0]
    nth = np.arange(len(ids)) - np.repeat(same, np.diff(np.append(same, len(ids))))
    at, ids = at[nth < k], ids[nth < k]
    cuts = np.searchsorted(at, np.arange(len(uniq) + 1))
    return uniq, [ids[cuts[i] : min(cuts[i + 1], cuts[i] + 2 * k)] for i in range(len(uniq))]


def _own(q_ids: np.ndarray, owners: list[np.ndarray]) -> dict[int, list[tuple[int, int]]]:
    """For ids of queries: the points that have rows of that id, and how many."""
    out: dict[int, list[tuple[int, int]]] = {}
    every, at = np.concatenate(owners), np.repeat(np.arange(len(owners)), [len(o) for o in owners])
    mine = np.isin(every, q_ids)
    for (point, i), n in zip(*np.unique(np.stack([at[mine], every[mine]], axis=1), axis=0, return_counts=True), strict=True):
        out.setdefault(int(i), []).append((int(point), int(n)))
    return out


def _whole(points: np.ndarray) -> np.ndarray:
    """As Python's integers, which no product overflows."""
    return np.array([[int(x) for x in row] for row in points], object).reshape(points.shape)


def search(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, r_ids: np.ndarray, r: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query position, vec_id, score) of each query's k best in r, at least; own rows (equal id) left out."""
    if not len(q) or not len(r):
        return []
    points, owners = _distinct(r_ids, r, k)
    biggest = float(np.abs(q).max(initial=0)) * float(np.abs(points).max(initial=0)) * q.shape[1]
    exact, low, high = biggest < _EXACT, -(2**63), 2**63 - 1
    left, right = (q, points) if exact else (_whole(q), _whole(points))
    qt, rt = CoverTree(q), CoverTree(points)
    with np.errstate(over="ignore", invalid="ignore"):  # a bound past the range of doubles leaves nothing out
        a, b, bound = leaf_pairs(qt, rt, floor, 1e-6 * max(1.0, biggest))
    if not len(a):
        return []
    many, own = np.array([len(o) for o in owners]), _own(q_ids, owners)
    worst = floor.astype(float).copy()  # least score that can still enter
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(len(q))]
    held = np.zeros(len(q), np.int64)

    def trim(i: int) -> None:
        score, at = (np.concatenate([x[j] for x in found[i]]) for j in (0, 1))
        # a point stands for several rows, some of which may be the query's own: k others are enough
        order = np.argsort(-score, kind="stable")
        foreign = many[at[order]]
        for point, n in own.get(int(q_ids[i]), []):
            foreign[at[order] == point] -= n
        enough = int(np.searchsorted(np.cumsum(foreign), k)) + 1
        if enough <= len(order):
            cut = score[order[enough - 1]]
            keep = score >= cut
            worst[i] = max(worst[i], float(cut) if exact else np.nextafter(float(cut), -np.inf))
            score, at = score[keep], at[keep]
        found[i] = [(score, at)]
        held[i] = len(score)

    order = np.lexsort((-bound, a))
    a, b, bound = a[order], b[order], bound[order]
    for leaf, first, past in zip(*np.unique(a, return_index=True), [*np.unique(a, return_index=True)[1][1:].tolist(), len(a)], strict=True):
        rows, at = qt.rows[leaf], int(first)
        while at < past and not bound[at] < worst[rows].min():
            some, n = [], 0
            while at < past and n < STEP:
                some.append(rt.rows[b[at]])
                n, at = n + len(some[-1]), at + 1
            cols = np.concatenate(some)
            score = left[rows] @ right[cols].T
            if not exact:
                score = np.clip(score, low, high)
            for x, i in enumerate(rows.tolist()):
                good = np.flatnonzero(score[x] >= worst[i])
                if len(good):
                    found[i].append((score[x][good], cols[good]))
                    held[i] += len(good)
                    if held[i] > 2 * (k + 1):
                        trim(i)
    out = []
    for i in range(len(q)):
        if not found[i]:
            continue
        trim(i)
        score, at = found[i][0]
        rows = sorted((-int(s), int(v)) for s, p in zip(score.tolist(), at.tolist(), strict=True) for v in owners[p].tolist() if v != q_ids[i])
        out += [(i, v, -s) for s, v in rows[:k]]
    return out


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, vectors = [], []
        for i, v in zip(batch["vec_id"].to_pylist(), batch["embedding"].to_pylist(), strict=True):
            if i is None or v is None or any(x is None for x in v):
                continue
            x = np.floor(64.0 * np.array(v, np.float64))
            if len(x) and np.isfinite(x).all():
                ids.append(i)
                vectors.append(x)
        flat = np.concatenate(vectors) if vectors else np.zeros(0)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in vectors])]).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids, pa.int64()), "v": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))})


def _place(ids: np.ndarray, sample: np.ndarray, centres: np.ndarray, k: int, every: int):  # noqa: ANN202
    """Each row's nearest centre and its distance; a query's kth best score against the sample: its true kth best is no less."""
    exact = float(np.abs(sample).max(initial=0)) ** 2 * sample.shape[1] < _EXACT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            mine, v = batch["vec_id"].to_numpy(), batch["v"].flatten().to_numpy().reshape(len(batch), -1)
            cell, apart = np.zeros(len(v), np.int32), np.full(len(v), np.inf)
            for c, centre in enumerate(centres):
                d = np.sqrt(((v - centre) ** 2).sum(axis=1))
                closer = d < apart
                cell[closer], apart[closer] = c, d[closer]
            floor = np.full(len(v), -np.inf)
            asks = np.flatnonzero(mine % every == 0)
            if exact and len(asks) and len(sample) > k and float(np.abs(v[asks]).max()) * float(np.abs(sample).max(initial=0)) * v.shape[1] < _EXACT:
                score = v[asks] @ sample.T
                score[mine[asks][:, None] == ids[None, :]] = -np.inf
                floor[asks] = np.partition(score, len(sample) - k, axis=1)[:, len(sample) - k]
            yield pa.RecordBatch.from_pydict({"vec_id": batch["vec_id"], "v": batch["v"], "cell": pa.array(cell), "apart": pa.array(apart), "floor": pa.array(floor)})

    return run


def _meet(k: int):  # noqa: ANN202
    def run(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        if not len(data) or not len(queries):
            return empty
        q_ids = queries["query"].to_numpy()
        rows = search(q_ids, np.stack(queries["q"].to_numpy()), queries["least"].to_numpy(), data["vec_id"].to_numpy(), np.stack(data["v"].to_numpy()), k)
        return pd.DataFrame([(int(q_ids[i]), v, s) for i, v, s in rows], columns=["query_id", "vec_id", "score"]).astype("int64") if rows else empty

    return run


def meeting(centres: np.ndarray, data: dict[int, tuple[float, int]], asks: dict[int, tuple[float, float]]) -> list[tuple[int, int]]:
    """Cells of queries (radius, least floor) and of data (radius, rows) that may hold a pair for the result."""
    norm = np.sqrt((centres**2).sum(axis=1))
    most = max([1.0, *(float(norm.max() + r) ** 2 for r, _ in data.values())])
    bound = lambda c, s, d, t: float(centres[c] @ centres[d]) + s * norm[d] + t * norm[c] + s * t + 1e-6 * most
    return [(c, d) for c, (s, floor) in asks.items() for d, (t, _) in data.items() if not bound(c, s, d, t) < floor]


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, block: int = BLOCK, group: int = GROUP, centres: int = CENTRES) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose vec_id is divisible by `every`, the k best of all other rows."""
    spark = vectors.sparkSession
    data = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_quantise, "vec_id long, v array<double>")
    data = save(data.withColumn("dim", F.size("v")), "vectors")
    many = {r[0]: (r[1], r[2]) for r in data.groupBy("dim").agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).collect()}
    out = None
    for dim, (n, n_queries) in sorted(many.items()):  # one in practice
        head = data.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).dropDuplicates(["vec_id"]).orderBy("vec_id").collect()
        ids, sample = np.array([r["vec_id"] for r in head], np.int64), np.array([r["v"] for r in head], np.float64)
        net = sample[farthest_first(sample, min(centres, 4 * -(-n // block)))[0]]
        placed = save(data.where(F.col("dim") == dim).select("vec_id", "v").mapInArrow(_place(ids, sample, net, k, every), "vec_id long, v array<double>, cell int, apart double, floor double"), "placed")
        asked = (F.col("vec_id") % every == 0)
        cells = placed.groupBy("cell").agg(F.max("apart"), F.count("*"), F.max(F.when(asked, F.col("apart"))), F.min(F.when(asked, F.col("floor")))).collect()  # a row for each centre
        pairs = meeting(net, {r[0]: (r[1], r[2]) for r in cells}, {r[0]: (r[3], r[4]) for r in cells if r[3] is not None})
        if not pairs:
            continue
        parts = spark.createDataFrame([(r[0], -(-r[2] // block)) for r in cells], "cell int, parts int")
        groups = max(1, -(-n_queries // group))
        left = placed.select("vec_id", "v", "cell").join(F.broadcast(parts), "cell").select("vec_id", "v", "cell", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
        to = spark.createDataFrame(pairs, "cell int, other int").join(parts.withColumnRenamed("cell", "other"), "other").select("cell", "other", F.explode(F.expr("sequence(0L, parts - 1L)")).alias("b"))
        asks = placed.where(asked).select("vec_id", "v", "cell", "floor").distinct()
        right = asks.join(F.broadcast(to.groupBy("cell").agg(F.collect_list(F.struct("other", "b")).alias("to"))), "cell")
        right = right.select(F.col("vec_id").alias("query"), F.col("v").alias("q"), F.col("floor").alias("least"), F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("g"), F.inline("to")).withColumnRenamed("other", "cell")
        met = left.groupBy("cell", "b", "g").cogroup(right.groupBy("cell", "b", "g")).applyInPandas(_meet(k), "query_id long, vec_id long, score long")
        out = met if out is None else out.unionByName(met)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_top_k(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
  FROM v AS q JOIN v AS d ON q.vec_id <> d.vec_id AND len(q.e) = len(d.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""
