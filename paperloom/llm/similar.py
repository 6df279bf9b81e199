"""Near copies by exact Jaccard similarity of word shingles, for the stages of a pipeline.

Texts are sets of hashed SHINGLE-word shingles (lower case; a shorter text is one shingle), and texts with
one set are one node. In any one order of all shingles, two sets of similarity t share one of the first
n - ceil(t * n) + 1 of each, so nodes that share none of these are no candidates: nothing similar is missed. The
order puts shingles that are common in a bounded sample last; it decides the cost only.

Pairs are compared by bitmaps of the parity of their shingles, which differ in no more places than the sets do, and,
where these allow the similarity, by the whole sets. Nodes of a shared shingle meet the least of them first. What short
bitmaps then allow between components of a shingle is joined to clusters, and these are split by whole bitmaps; any pair
that is still to be linked lies in one cluster, and a node in one only, so in a cluster the sets themselves are compared. Each
step gives a spanning forest of a group and not its pairs: fewer rows than nodes, however many pairs are alike.
Nulls and texts without words have the empty set and are one node.
Texts of any length are compared whole; of rows alike in id and text one stays; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from . import textvec as tv
from .common import save, small, text_key
from .components import Forest, connected_components
from .simhash import keep_first

#: Similarity as a fraction of whole numbers.
SHINGLE, SIMILARITY = 5, (4, 5)
#: Texts in the sample that common shingles are read from, and shingles taken from it: cost, never results.
ORDER_SAMPLE, COMMON, MIN_COMMON = 4096, 200_000, 3
#: Bits of a short bitmap at most, as 64-bit numbers.
SHORT = 16
#: A shingle of more nodes than this is dealt out as pairs of blocks; and a cluster of more than a quarter of it, or of more shingles than WEIGHT.
BUCKET, WEIGHT = 1024, 2_000_000
#: Bytes of sorted groups that a task holds before it settles them.
HELD_BYTES = 32_000_000
_LEAST, _MOST = -(2**63), 2**63 - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(buf: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of the distinct shingles of each document, by document and hash."""
    buf = _LOWER[buf]
    start, end, doc = tv.words(buf, off)
    word = tv.word_hashes(buf, start, end)
    n = np.bincount(doc, minlength=len(off) - 1)
    first = np.cumsum(n) - n
    grams = tv.gram_hashes(word, size)
    at = np.flatnonzero(doc[: len(grams)] == doc[size - 1 :]) if len(grams) else np.zeros(0, np.int64)
    found = [(grams[at], doc[at])]
    for k in range(1, size):
        mine = np.flatnonzero(n == k)
        if len(mine):
            found.append((tv.gram_hashes(word, k)[first[mine]], mine))
    h, doc = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def _nodes(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit number of each set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tv.mix(h ^ np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)])
    end = np.cumsum(size)
    return tv.mix(total[end] - total[end - size] + size.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)).view(np.int64)


def _lists(flat: np.ndarray, size: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat.view(np.int64)))


def _bitmaps(h: np.ndarray, doc: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Parity of the shingles of each set by their low bits; 64 places or the next power of two over its size."""
    width = np.int64(1) << np.maximum(6, np.ceil(np.log2(np.maximum(n, 1)))).astype(np.int64)
    end = np.cumsum(width)
    odd = np.bincount((end - width)[doc] + (h & (width[doc] - 1).astype(np.uint64)).astype(np.int64), minlength=int(end[-1]) if len(end) else 0) & 1
    raw = np.packbits(odd.astype(bool), bitorder="little").tobytes()
    return [raw[i:j] for i, j in zip(((end - width) // 8).tolist(), (end // 8).tolist(), strict=True)]


def _apart(x: bytes, y: bytes) -> int:
    """Places in which two bitmaps differ, the wider folded to the width of the other."""
    a, b, wide, width = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * len(x), 8 * len(y)
    if wide < width:
        a, b, wide, width = b, a, width, wide
    while wide > width:
        wide //= 2
        a = (a >> wide) ^ (a & ((1 << wide) - 1))
    return (a ^ b).bit_count()


def _folded(bits: bytes, words: int) -> np.ndarray:
    """A bitmap as 64-bit numbers, folded to `words` of them where it is wider."""
    out = np.frombuffer(bits, np.uint64)
    while len(out) > words:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def _possible(similarity: tuple[int, int]):  # noqa: ANN202
    """Pairs whose sizes and bitmaps allow the similarity; sets of n and m differ in (n + m)(1 - t) / (1 + t) shingles at most."""
    less, more = similarity[1] - similarity[0], similarity[1] + similarity[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = (batch[c].to_pylist() for c in ("x", "y", "n", "m"))
            near = [min(n, m) * similarity[1] >= max(n, m) * similarity[0] and _apart(x, y) * more <= (n + m) * less for x, y, n, m in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_pydict({c: batch[c].filter(pa.array(near, pa.bool_())) for c in ("a", "b")})

    return run


def _sampled(size: int):  # noqa: ANN202
    @tv.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, off in tv.chunks(batch["text"]):
                yield pa.RecordBatch.from_pydict({"h": pa.array(shingles(buf, off, size)[0].view(np.int64))})

    return run


def _prints(size: int, similarity: tuple[int, int], common: np.ndarray, count: np.ndarray):  # noqa: ANN202
    @tv.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in tv.chunks(batch["text"]):
                h, doc = shingles(buf, off, size)
                n = np.bincount(doc, minlength=j - i)
                node = _nodes(h, n)
                often = np.zeros(len(h), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    often = np.where(common[at] == h, count[at], 0)
                order = np.lexsort((h, often, doc))
                taken = np.where(n > 0, n - -(-n * similarity[0] // similarity[1]) + 1, 0)
                place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                head, bits = h[order][place < taken[doc]], _bitmaps(h, doc, n)
                yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].slice(i, j - i), "key": batch["key"].slice(i, j - i), "node": pa.array(node), "n": pa.array(n.astype(np.int32)), "bits": pa.array(bits, pa.binary()), "short": pa.array([_folded(x, SHORT).tobytes() for x in bits], pa.binary()), "head": _lists(head, taken)})

    return run


def _whole(size: int):  # noqa: ANN202
    @tv.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in tv.chunks(batch["text"]):
                h, doc = shingles(buf, off, size)
                ends = np.cumsum(np.bincount(doc, minlength=j - i))
                yield pa.RecordBatch.from_pydict({"node": batch["node"].slice(i, j - i), "items": pa.array([x.tobytes() for x in np.split(h, ends[:-1])], pa.binary())})

    return run


def _similar(similarity: tuple[int, int]):  # noqa: ANN202
    @tv.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both * similarity[1] >= (len(x) + len(y) - both) * similarity[0])
            yield pa.RecordBatch.from_pydict({c: batch[c].filter(pa.array(near, pa.bool_())) for c in ("a", "b")})

    return run


def _levels(bits: list[bytes]) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Width of each bitmap in 64-bit numbers; and by width the place of each that is no narrower, and these folded to it."""
    own = np.array([len(x) // 8 for x in bits], np.int64)
    levels, w = {}, int(own.max(initial=0))
    at, wide = np.zeros(0, np.int64), np.zeros((0, 2 * w), np.uint64)
    while w:
        mine = np.flatnonzero(own == w)
        raw = np.frombuffer(b"".join([bits[i] for i in mine.tolist()]), np.uint64).reshape(-1, w)
        at, wide = np.concatenate([at, mine]), np.concatenate([wide[:, :w] ^ wide[:, w:], raw])
        place = np.full(len(own), -1, np.int64)
        place[at] = np.arange(len(at))
        levels[w], w = (place, wide), w // 2
    return own, levels


def _across(similarity: tuple[int, int], exact: bool = False):  # noqa: ANN202
    """Links between nodes of different components in each group (h, pair), as a spanning forest: fewer of them than nodes.

    A link is a pair whose sizes and bitmaps allow the similarity: every such pair is in one tree. With `exact`, a pair whose sets have it:
    the trees are what such pairs and the components connect. In a group of two blocks, pairs of one block are left to the block's own group.
    """
    less, more = similarity[1] - similarity[0], similarity[1] + similarity[0]

    def settle(rows: pa.Table) -> pa.RecordBatch:
        h, pair, node, root, n, turn = (rows[c].to_numpy() for c in ("h", "pair", "node", "root", "n", "turn"))
        change = np.ones(len(h), bool)
        change[1:] = (h[1:] != h[:-1]) | (pair[1:] != pair[:-1])
        group, first = np.cumsum(change) - 1, np.flatnonzero(change)
        several = lambda x: (np.minimum.reduceat(x, first) != np.maximum.reduceat(x, first))[group]
        last, two, at = np.searchsorted(group, group, "right"), several(turn), np.flatnonzero(several(root))
        where = np.zeros(len(h), np.int64)
        where[at] = np.arange(len(at))
        own, levels = _levels(rows["bits"].take(pa.array(at)).to_pylist())
        sets = dict(zip(at.tolist(), rows["items"].take(pa.array(at)).to_pylist(), strict=True)) if exact else {}
        # trees of one group are not those of another
        base = np.unique(np.column_stack([group, root if exact else node]), axis=0, return_inverse=True)[1].ravel()
        label, forest, links, d = base, Forest(), [], 1

        def alike(x: int, y: int) -> bool:
            x, y = np.frombuffer(sets[x], np.uint64), np.frombuffer(sets[y], np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            return both * similarity[1] >= (len(x) + len(y) - both) * similarity[0]

        while len(at := at[last[at] > at + d]):
            a, b = at, at + d
            low, high = np.minimum(n[a], n[b]).astype(np.int64), np.maximum(n[a], n[b]).astype(np.int64)
            some = (root[a] != root[b]) & (label[a] != label[b]) & ((turn[a] != turn[b]) | ~two[a]) & (low * similarity[1] >= high * similarity[0])
            a, b, both = a[some], b[some], (low + high)[some]
            x, y, apart = where[a], where[b], np.zeros(len(a), np.int64)
            width = np.minimum(own[x], own[y])
            for w in np.unique(width).tolist():
                mine, (place, bits) = np.flatnonzero(width == w), levels[w]
                for some in np.array_split(mine, 1 + len(mine) * w // 1_000_000):
                    apart[some] = np.bitwise_count(bits[place[x[some]]] ^ bits[place[y[some]]]).sum(axis=1)
            near = apart * more <= both * less
            found = len(links)
            for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
                if forest.find(base[x].item()) != forest.find(base[y].item()) and (not exact or alike(x, y)):
                    forest.join(base[x].item(), base[y].item())
                    links.append((node[x].item(), node[y].item()))
            if len(links) > found:
                now = np.arange(base.max() + 1)
                now[list(forest.up)] = [forest.find(x) for x in list(forest.up)]
                label = now[base]
            d += 1
        out = np.array(links, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_pydict({"a": pa.array(out.max(axis=1, initial=_LEAST)), "b": pa.array(out.min(axis=1, initial=_MOST))})

    @tv.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:  # sorted; the last group of a batch may go on in the next
            held.append(batch)
            if sum(map(len, held)) < 50_000 and sum(x.nbytes for x in held) < HELD_BYTES:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            h, pair = rows["h"].to_numpy(), rows["pair"].to_numpy()
            cut = int(np.argmax((h == h[-1]) & (pair == pair[-1])))
            if cut:
                yield settle(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
        if sum(map(len, held)):
            yield settle(pa.Table.from_batches(held).combine_chunks())

    return run


def _common(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample hold, and how many do; at most COMMON come to the driver."""
    every = max(1, -(-rows.count() // ORDER_SAMPLE))
    found = rows.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).select("text").mapInArrow(_sampled(size), "h long")
    found = found.groupBy("h").count().where(F.col("count") >= MIN_COMMON).orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    h, count = found["h"].to_numpy().view(np.uint64), found["count"].to_numpy()
    order = np.argsort(h)
    return h[order], count[order]


def placed(docs: DataFrame, size: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, key, root, component_id) for each row of docs: what links of `similarity` or more connect, and its least doc_id."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("key"), text.alias("text"))
    prints = save(rows.mapInArrow(_prints(size, similarity, *_common(rows, size)), "doc_id long, key binary, node long, n int, bits binary, short binary, head array<long>"), "shingle-prints")
    nodes = save(prints.dropDuplicates(["node"]), "nodes")  # copies merge in each task before they move
    heads = nodes.select(F.explode("head").alias("h"), "node", "n")
    shared = heads.groupBy("h").agg(F.count("*").alias("m"), F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").drop("most")
    shared = save(shared, "shared-shingles")
    met = save(heads.join(small(shared, shared.count()), "h"), "met")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()

    def whole(some: DataFrame) -> DataFrame:
        """(node, items): the sets of some nodes, read from one text of each."""
        need = save(nodes.join(some, "node").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "node"), "need")
        mine = (F.col("key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id"))
        sets = rows.join(small(need, need.count()), mine).select("node", "text").dropDuplicates(["node"])
        return save(sets.mapInArrow(_whole(size), "node long, items binary"), "sets")

    def links(pairs: DataFrame) -> DataFrame:
        """pairs (a, b), no repeats -> those whose sets are similar."""
        marks = save(nodes.join(ends(pairs), "node").select("node", "n", "bits"), "bitmaps")
        both = pairs.join(marks.select(F.col("node").alias("a"), F.col("bits").alias("x"), "n"), "a").join(marks.select(F.col("node").alias("b"), F.col("bits").alias("y"), F.col("n").alias("m")), "b")
        pairs = save(both.mapInArrow(_possible(similarity), "a long, b long"), "possible")
        sets = whole(ends(pairs))
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
        return save(both.mapInArrow(_similar(similarity), "a long, b long"), "similar")

    def trees(groups: DataFrame, exact: bool = False) -> DataFrame:
        """groups (h, blocks, node, n, root, bits, and items if exact) -> (a, b): what _across links."""
        dealt = groups.withColumn("turn", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        pair = F.expr("transform(sequence(0, blocks - 1), j -> least(j, turn) * cast(blocks as long) + greatest(j, turn))")
        dealt = dealt.withColumn("pair", F.explode(pair)).drop("blocks").repartition(F.col("h"), F.col("pair")).sortWithinPartitions("h", "pair")
        return save(dealt.mapInArrow(_across(similarity, exact), "a long, b long").distinct(), "trees")

    def clusters(pairs: DataFrame) -> DataFrame:
        """(h, blocks, node, n, root) of all that pairs connect: h is the cluster."""
        joined = connected_components(pairs)
        joined = joined.select(F.col("root").alias("h"), "node").unionByName(joined.select(F.col("root").alias("h"), F.col("root").alias("node")).distinct())
        joined = save(joined.join(nodes.select("node", "n"), "node").join(roots.withColumnRenamed("root", "r"), "node", "left").select("h", "node", "n", F.coalesce("r", "node").alias("root")), "clusters")
        blocks = F.greatest(F.ceil(4 * F.count("*") / bucket), F.ceil(F.sum("n") / WEIGHT)).cast("int")
        return joined.join(joined.groupBy("h").agg(blocks.alias("blocks")), "h")

    found = links(save(met.where(F.col("node") != F.col("least")).select(F.col("node").alias("a"), F.col("least").alias("b")).distinct(), "pairs"))
    roots = connected_components(found)
    # with two nodes there is no pair but the one that was compared; nodes of one component have nothing left to compare
    more = met.where("m > 2").join(roots.withColumnRenamed("root", "r"), "node", "left").select("h", "node", "n", "m", F.coalesce("r", "node").alias("root"))
    mixed = more.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("h")
    more = save(more.join(mixed, "h", "left_semi"), "mixed")
    near = trees(more.join(nodes.select("node", F.col("short").alias("bits")), "node").withColumn("blocks", F.ceil(F.col("m") / bucket).cast("int")).drop("m"))
    if not near.isEmpty():
        near = trees(clusters(near).join(nodes.select("node", "bits"), "node"))
    if not near.isEmpty():
        left = save(clusters(near), "left")
        others = trees(left.join(nodes.select("node", "bits"), "node").join(whole(left.select("node")), "node"), exact=True)
        roots = connected_components(save(found.unionByName(others), "found"))
    each = prints.select("doc_id", "key", "node").join(roots.withColumnRenamed("root", "r"), "node", "left").select("doc_id", "key", F.coalesce("r", "node").alias("root"))
    least = each.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return each.join(least, "root").select("doc_id", "key", "root", "component_id")


def placed_by_both(docs: DataFrame, size: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, tau: int = 4) -> DataFrame:
    """placed(), where links of fingerprints connect too: SimHash of the same shingles, within tau bits.

    Both kinds of classes are classes of texts. A class of one kind and one of the other are linked by a text that is in both; what these
    links connect is one component, so no link of either kind is lost.
    """
    alike = save(placed(docs, size, similarity), "alike")
    prints = save(simhash.keyed_fingerprints(docs, size), "prints")
    near = prints.select("key", "fp").distinct().join(simhash.components(prints, tau), "fp").select("key", F.xxhash64(F.lit("print"), F.col("root")).alias("b"))
    mine = F.xxhash64(F.lit("set"), F.col("root"))
    texts = alike.select("key", mine.alias("a")).distinct()
    roots = connected_components(save(texts.join(near, "key").select("a", "b").distinct(), "classes"))
    each = alike.select("doc_id", "key", mine.alias("node")).join(roots, "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("root"))
    least = each.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return each.join(least, "root").select("doc_id", "key", "root", "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """One row of docs of each component, the one of least doc_id, as simhash.keep_one does; all columns unchanged."""
    return keep_first(docs, placed(docs, size, similarity, bucket))


def keep_one_by_both(docs: DataFrame) -> DataFrame:
    """One row of docs of each component of placed_by_both."""
    return keep_first(docs, placed_by_both(docs))
