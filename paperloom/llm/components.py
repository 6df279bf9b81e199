"""Connected components by rounds of local forests and pointer jumps on written edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, save, small

#: Links that a task holds before it contracts them.
HELD = 500_000


class Forest:
    """Union-find over long ids; remembers the links that joined two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _contract(held_rows: int, whole: bool):  # noqa: ANN202
    """Stars in place of links, fewer or as many: what is connected among the links that a task holds at once hangs on its least node.

    With `whole`, rows come sorted by a, and those of one a are held at once.
    """

    def stars(rows: pa.Table) -> pa.RecordBatch:
        forest = Forest()
        for a, b in zip(rows["a"].to_pylist(), rows["b"].to_pylist(), strict=True):
            forest.join(a, b)
        found = [(x, forest.find(x)) for x in list(forest.up)]
        found = np.array([(x, r) for x, r in found if x != r], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_pydict({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n < held_rows:
                continue
            rows = pa.Table.from_batches(held)
            a = rows["a"].to_numpy()
            cut = int(np.searchsorted(a, a[-1])) if whole else n
            if cut:
                yield stars(rows.slice(0, cut))
                held, n = rows.slice(cut).to_batches(), n - cut
        if n:
            yield stars(pa.Table.from_batches(held))

    return run


def _dealt(edges: DataFrame, held_rows: int) -> DataFrame:
    """edges (a > b) contracted where they are, then with all links of an a in one place.

    A task passes on an a once for all that it held, so no a has many rows to deal, and no hub is dealt by at all.
    """
    mine = edges.mapInArrow(_contract(held_rows, False), "a long, b long")
    return mine.repartition(F.col("a")).sortWithinPartitions("a").mapInArrow(_contract(held_rows, True), "a long, b long")


def connected_components(edges: DataFrame, held_rows: int = HELD) -> DataFrame:
    """edges (a long, b long) -> (node, root): root is the least node of the component. Nodes without a link are absent.

    Ends when each node has one link, to a node that has none to a lesser one. Till then what hangs on a node that is no root moves
    to the least that this node hangs on, and the links are contracted. Links never grow in number nor their lesser ends in order, and
    a round without end lessens one of both. A round is dealt twice, once to count and once to contract; each is written to the shared folder.
    """
    spark = edges.sparkSession
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = save(_dealt(edges, held_rows), "links")
    while True:
        ends = now.select(F.col("a").alias("u"), F.col("b").alias("m"), F.lit(1).alias("up")).unionByName(now.select(F.col("b").alias("u"), F.lit(None).cast("long").alias("m"), F.lit(0).alias("up")))
        nodes = ends.groupBy("u").agg(F.min("m").alias("m"), F.sum("up").alias("up"), F.min("up").alias("leaf"))
        unsettled = save(nodes.where("up > 1 or (up = 1 and leaf = 0)").select("u", F.when(F.col("leaf") == 0, F.col("m")).alias("m")), "unsettled")
        if unsettled.isEmpty():
            remove(spark, unsettled)
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        inner = unsettled.where("m is not null")
        moved = now.join(small(inner, inner.count()), F.col("b") == F.col("u"), "left").select("a", F.coalesce("m", "b").alias("b"))
        after = save(_dealt(moved, held_rows), "links")
        remove(spark, unsettled)
        remove(spark, now)
        now = after
