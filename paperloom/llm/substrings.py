"""Substring deduplication over a log-structured fingerprint index.

A fingerprint is the hash of the GRAM-word run that is least among those of a SPAN-word window; equal
windows share their fingerprint, so windows whose fingerprint occurs once need no second look. The index
is a set of immutable runs, each of two tables that are bucketed and sorted by hash:

* `prints`: every fingerprint of some batches with its number of occurrences, and where it is if there is one;
* `windows`: a digest of every window that was looked at, with the first place of its words.

A new batch is one run more. Its fingerprints are merge-joined with all runs; those that now occur twice are
opened: the windows of the new documents, and the one window group that an older document has there, are read
from the texts and digested (BLAKE2b, 128 bits, over the exact words joined by one space). Digests are
merge-joined with the windows of all runs, and all but the first of equal ones are late. A fingerprint that an
older batch opened has its windows in the index already, so no text is read for it again. When a level holds
FAN runs they are merged into one of the next level; a manifest names the runs of each state of the index.

Documents are ordered by doc_id and positions in them by word; a null doc_id comes first. Rows with one
doc_id and one text are one document and get the same result. Several texts of one doc_id (or of none) are
documents of their own, told apart and ordered by `part`, a 64-bit hash of the text; part is 0 where an id
has one text. Null and empty texts have no words; a text of any length is one document, worked on whole. An
empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import early_cleanup, list_dir, put_text, read_text, remove, save, scratch, small

SPAN, GRAM, FAN, BATCHES = 20, 6, 2, 4
#: Windows that a task compares with each other before it passes the earliest on.
HELD = 1_000_000
_FIRST = -(2**63)


def _fingerprints(span: int, gram: int):  # noqa: ANN202
    """Fingerprints of each document, with the windows (first word, number) that have each of them, in turn."""

    @tv.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch["doc"].to_numpy(), batch["part"].to_numpy()
            for i, j, buf, off in tv.chunks(batch["text"]):
                start, end, doc = tv.words(buf, off)
                n = len(start) - span + 1
                if n <= 0:
                    continue
                first = np.searchsorted(doc, np.arange(len(off)))  # words before each document
                grams = tv.gram_hashes(tv.word_hashes(buf, start, end), gram)
                window, width = np.flatnonzero(doc[:n] == doc[span - 1 :]), span - gram + 1
                views, at = np.lib.stride_tricks.sliding_window_view(grams, width), np.empty(n, np.int64)
                for k in range(0, n, 1 << 15):
                    some = views[k : k + (1 << 15)]
                    at[k : k + len(some)] = np.arange(k, k + len(some)) + width - 1 - np.argmin(some[:, ::-1], axis=1)
                at = at[window]
                if not len(at):
                    continue
                head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                many = np.diff(np.concatenate([head, [len(at)]]))
                owner, place = doc[window[head]], window[head]
                h, place = grams[at[head]], place - first[owner]
                order = np.lexsort((place, owner, h))  # what a document repeats is one row
                h, owner, pairs = h[order], owner[order], np.column_stack([place[order], many[order]]).astype(np.int32).ravel()
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]))
                offsets = (2 * np.concatenate([new, [len(h)]])).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"h": pa.array(h[new].view(np.int64)), "doc": pa.array(ids[i:j][owner[new]]), "part": pa.array(parts[i:j][owner[new]]), "runs": pa.ListArray.from_arrays(pa.array(offsets), pa.array(pairs))})

    return run


def digests(text: bytes, at: np.ndarray, span: int) -> bytes:
    """16 bytes for each of the windows that begin at the words `at`: of their words, joined by one space."""
    words = text.split()
    joined = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = end - np.fromiter(map(len, words), np.int64, len(words))
    blake = hashlib.blake2b
    return b"".join([blake(joined[a:b], digest_size=16).digest() for a, b in zip(start[at].tolist(), end[at + span - 1].tolist(), strict=True)])


_SEEN = "late boolean, d1 long, d2 long, doc long, part long, at int, length int"


def _late_runs(doc: np.ndarray, part: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Late windows as runs of consecutive places."""
    order = np.lexsort((at, part, doc))
    doc, part, at = doc[order], part[order], at[order]
    head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (part[1:] != part[:-1]) | (at[1:] > at[:-1] + 1)])) if len(doc) else np.zeros(0, np.int64)
    length = np.diff(np.concatenate([head, [len(doc)]])).astype(np.int32)
    none = pa.nulls(len(head), pa.int64())
    return pa.RecordBatch.from_pydict({"late": pa.array(np.ones(len(head), bool)), "d1": none, "d2": none, "doc": pa.array(doc[head]), "part": pa.array(part[head]), "at": pa.array(at[head]), "length": pa.array(length)})


def _windows(span: int):  # noqa: ANN202
    """Digests of the listed windows. One that an equal one of this task precedes is late for certain and goes on
    only as a place in its document, so a passage that many documents share is few rows of a task.
    """

    def settle(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        d1, d2, doc, part, at = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((at, part, doc, d2, d1))
        d1, d2, doc, part, at = d1[order], d2[order], doc[order], part[order], at[order]
        late = np.zeros(len(d1), bool)
        late[1:] = (d1[1:] == d1[:-1]) & (d2[1:] == d2[:-1])
        yield _late_runs(doc[late], part[late], at[late])
        first = ~late
        n = int(first.sum())
        yield pa.RecordBatch.from_pydict({"late": pa.array(np.zeros(n, bool)), "d1": pa.array(d1[first]), "d2": pa.array(d2[first]), "doc": pa.array(doc[first]), "part": pa.array(part[first]), "at": pa.array(at[first]), "length": pa.array(np.ones(n, np.int32))})

    @tv.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in batches:
            for doc, part, text, spots in zip(batch["doc"].to_pylist(), batch["part"].to_pylist(), batch["text"].cast(pa.large_binary()), batch["spots"], strict=True):
                pairs = spots.values.to_numpy().reshape(-1, 2).astype(np.int64)
                at = np.repeat(pairs[:, 0] - np.cumsum(pairs[:, 1]) + pairs[:, 1], pairs[:, 1]) + np.arange(pairs[:, 1].sum())
                both = np.frombuffer(digests(text.as_py(), at, span), np.int64).reshape(-1, 2)
                held.append((both[:, 0], both[:, 1], np.full(len(at), doc, np.int64), np.full(len(at), part, np.int64), at.astype(np.int32)))
                n += len(at)
                if n > HELD:
                    yield from settle(held)
                    held, n = [], 0
        if held:
            yield from settle(held)

    return run


def _rest(span: int):  # noqa: ANN202
    """Words, removed words and the digest of what is left of each document, given its runs of late windows."""

    @tv.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept, texts = [], [], [], []
            for raw, late in zip(batch["text"].cast(pa.large_binary()), batch["late"], strict=True):
                words = (raw.as_py() or b"").split()
                cut = np.zeros(len(words) + 1, np.int64)
                if late.is_valid and len(late):
                    runs = np.column_stack([late.values.field(k).to_numpy() for k in (0, 1)]).astype(np.int64)
                    np.add.at(cut, runs[:, 0], 1)
                    np.add.at(cut, runs.sum(axis=1) - 1 + span, -1)
                    gone = np.cumsum(cut)[:-1] > 0
                    left = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                    n_removed.append(int(gone.sum()))
                else:
                    left = b" ".join(words)
                    n_removed.append(0)
                n_words.append(len(words))
                kept.append(hashlib.sha256(left).hexdigest())
                texts.append(left.decode() if n_removed[-1] else None)
            yield pa.RecordBatch.from_pydict({"doc": batch["doc"], "m": batch["m"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(kept, pa.string()), "kept_text": pa.array(texts, pa.string())})

    return run


def bucketed(rows: DataFrame, path: str, name: str, buckets: int, *keys: str, by: str | None = None) -> DataFrame:
    """rows as a table of sorted buckets, so that joins with it by its keys need no shuffle of it."""
    writer = rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path)
    (writer.partitionBy(by) if by else writer).saveAsTable(name)
    return rows.sparkSession.table(f"`{name}`")


class FingerprintIndex:
    """Runs of fingerprints and windows under a path that all executors share; opened again, it goes on from its manifest.

    A run has a name of its own, so what a lost batch or compaction leaves is in nobody's way. Documents of a later batch come after those of earlier ones: their `doc` is greater. One writer at a time.
    """

    KEYS = {"prints": ("h",), "windows": ("d1", "d2")}
    COLUMNS = {"prints": "h long, n long, doc long, part long, at int, length int", "windows": "d1 long, d2 long, doc long, part long, at int, late boolean"}

    def __init__(self, spark: SparkSession, path: str, span: int = SPAN, gram: int = GRAM, fan: int = FAN) -> None:
        self.spark, self.path, self.span, self.gram, self.fan = spark, path.rstrip("/"), span, gram, fan
        known = [f for f in list_dir(spark, f"{self.path}/manifest") if f.endswith(".json")]
        self.state = json.loads(read_text(spark, f"{self.path}/manifest/{max(known)}")) if known else {"version": 0, "buckets": n_buckets(spark), "runs": []}

    @property
    def runs(self) -> list[dict]:
        return self.state["runs"]

    def _name(self, kind: str, no: str) -> str:
        return f"{self.path.rsplit('/', 1)[-1].replace('-', '_')}_{kind}_{no}"

    def table(self, kind: str, no: str) -> DataFrame:
        name, keys = self._name(kind, no), ", ".join(self.KEYS[kind])
        if not self.spark.catalog.tableExists(name):  # another session wrote it
            self.spark.sql(f"CREATE TABLE `{name}` ({self.COLUMNS[kind]}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.state['buckets']} BUCKETS LOCATION '{self.path}/{kind}-{no}'")
        return self.spark.table(f"`{name}`")

    def _write(self, kind: str, no: str, rows: DataFrame) -> None:
        bucketed(rows, f"{self.path}/{kind}-{no}", self._name(kind, no), self.state["buckets"], *self.KEYS[kind])

    def _commit(self, runs: list[dict]) -> None:
        """The index is what the newest manifest says: one that is lost before leaves the state as it was."""
        self.state = self.state | {"version": self.state["version"] + 1, "runs": runs}
        put_text(self.spark, f"{self.path}/manifest/{self.state['version']:08d}.json", json.dumps(self.state))

    def _drop(self, run: dict) -> None:
        for kind in self.KEYS:
            remove(self.spark, self.table(kind, run["no"]))
            self.spark.sql(f"DROP TABLE `{self._name(kind, run['no'])}`")

    def opened(self, no: str) -> DataFrame:
        """(h, old): fingerprints of run `no` that occur twice or more now; old is the place of the one that an older run has of it."""
        rows = self.table("prints", no).select("h", "n")
        for r in self.runs:
            place = F.struct("doc", "part", "at", "length").alias(f"p{r['no']}")
            rows = rows.join(self.table("prints", r["no"]).select("h", F.col("n").alias(f"n{r['no']}"), place), "h", "left")
        before = sum((F.coalesce(f"n{r['no']}", F.lit(0)) for r in self.runs), F.lit(0))
        none = F.lit(None).cast("struct<doc:long,part:long,at:int,length:int>")
        old = F.when(before == 1, F.coalesce(*(f"p{r['no']}" for r in self.runs), none)) if self.runs else none
        return rows.where(F.col("n") + before > 1).select("h", old.alias("old"))

    def batch(self, new: DataFrame, every: DataFrame) -> DataFrame:
        """Take in new (doc, part, text); every has these columns of all documents so far, new ones included.

        Gives (doc, part, at, length): runs of windows of new documents that equal ones precede.
        """
        spark, no = self.spark, uuid.uuid4().hex
        prints = save(new.mapInArrow(_fingerprints(self.span, self.gram), "h long, doc long, part long, runs array<int>"), "prints")
        # one row of a fingerprint however many documents have it: copies merge in each task before they move
        mine = prints.groupBy("h").agg(F.sum(F.size("runs") / 2).cast("long").alias("n"), F.min("doc").alias("doc"), F.min("part").alias("part"), F.min(F.col("runs")[0]).alias("at"), F.min(F.col("runs")[1]).alias("length"))
        self._write("prints", no, mine.select("h", "n", *(F.when(F.col("n") == 1, F.col(c)).alias(c) for c in ("doc", "part", "at", "length"))))
        opened = save(self.opened(no), "opened")
        spots = prints.join(small(opened.select("h"), opened.count()), "h", "left_semi").select("doc", "part", "runs")
        spots = spots.unionByName(opened.where("old is not null").select("old.doc", "old.part", F.array("old.at", "old.length").alias("runs")))
        spots = spots.groupBy("doc", "part").agg(F.flatten(F.collect_list("runs")).alias("spots"))  # of one document: no more than its words
        seen = save(every.join(spots, ["doc", "part"]).select("doc", "part", "text", "spots").mapInArrow(_windows(self.span), _SEEN), "seen")
        rows = seen.where("not late").select("d1", "d2", "doc", "part", "at")
        for r in self.runs:
            rows = rows.join(self.table("windows", r["no"]).where("not late").select("d1", "d2", F.lit(True).alias(f"k{r['no']}")), ["d1", "d2"], "left")
        known = reduce(or_, (F.col(f"k{r['no']}").isNotNull() for r in self.runs), F.lit(False))
        nth = F.row_number().over(Window.partitionBy("d1", "d2").orderBy("doc", "part", "at"))
        self._write("windows", no, rows.select("d1", "d2", "doc", "part", "at", (known | (nth > 1)).alias("late")))
        late = self.table("windows", no).where("late").select("doc", "part", "at", F.lit(1).alias("length"))
        late = save(seen.where("late").select("doc", "part", "at", "length").unionByName(late), "late")
        for gone in (prints, opened, seen):
            remove(spark, gone)
        self._commit([*self.runs, {"level": 0, "no": no}])
        return late

    def compact(self) -> None:
        """Merge the runs of a level that is full into one of the next; the old ones go after the manifest has it."""
        while True:
            levels = [r["level"] for r in self.runs]
            full = next((lv for lv in sorted(set(levels)) if levels.count(lv) >= self.fan), None)
            if full is None:
                return
            some, no = [r for r in self.runs if r["level"] == full], uuid.uuid4().hex
            prints = self.table("prints", some[0]["no"])
            for r in some[1:]:  # sorted buckets on either side: a merge without a shuffle
                other = self.table("prints", r["no"])
                place = [F.when(F.col("a.n").isNull() | F.col("b.n").isNull(), F.coalesce(f"a.{c}", f"b.{c}")).alias(c) for c in ("doc", "part", "at", "length")]
                prints = prints.alias("a").join(other.alias("b"), F.col("a.h") == F.col("b.h"), "full_outer").select(F.coalesce("a.h", "b.h").alias("h"), (F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))).alias("n"), *place)
            self._write("prints", no, prints)
            windows = self.table("windows", some[0]["no"]).where("not late")
            for r in some[1:]:  # a window that an older run has is late in a newer one, so no two of these are equal
                other = self.table("windows", r["no"]).where("not late")
                windows = windows.alias("a").join(other.alias("b"), ["d1", "d2"], "full_outer").select("d1", "d2", *(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("doc", "part", "at", "late")))
            self._write("windows", no, windows)
            self._commit([r for r in self.runs if r["level"] != full] + [{"level": full + 1, "no": no}])
            for r in some:
                self._drop(r)

    def drop(self) -> None:
        for r in self.runs:
            self._drop(r)
        self._commit([])


def n_buckets(spark: SparkSession) -> int:
    """As many as shuffles have partitions: sized by the session for its data. Spark takes up to 100,000 of a table."""
    return min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _taken_in(docs: DataFrame, batches: int, span: int, gram: int, fan: int) -> tuple[DataFrame, list[DataFrame]]:
    """The texts as a table of buckets, and what each batch of them gives."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("doc"), F.col("text").cast("string").alias("text"))
    keyed = rows.select("doc", F.xxhash64("text").alias("part"), "text")
    several = save(keyed.groupBy("doc").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("doc", F.lit(True).alias("several")), "several-texts")
    n_several = several.count()
    if n_several:
        keyed = keyed.join(small(several, n_several), "doc", "left").select("doc", F.when(F.col("several"), F.col("part")).otherwise(F.lit(0)).cast("long").alias("part"), "text")
    else:
        keyed = rows.select("doc", F.lit(0).cast("long").alias("part"), "text")
    cuts = sorted(set(keyed.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 1000)).first()[0] or [])) if batches > 1 else []
    no = sum((F.col("doc") > c).cast("int") for c in cuts) if cuts else F.lit(0)
    path = scratch(spark, "fingerprints")
    merged = keyed.groupBy("doc", "part").agg(F.first("text").alias("text"), F.count("*").alias("m")).withColumn("batch", no)
    name = path.rsplit("/", 1)[-1].replace("-", "_") + "_texts"
    texts = bucketed(merged, f"{path}/texts", name, n_buckets(spark), "doc", "part", by="batch")
    index, late = FingerprintIndex(spark, path, span, gram, fan), []
    for i in range(len(cuts) + 1):
        index.compact()
        late.append(index.batch(texts.where(F.col("batch") == i).select("doc", "part", "text"), texts.where(F.col("batch") <= i).select("doc", "part", "text")))
    index.drop()
    return texts, late


def dedup(docs: DataFrame, batches: int = BATCHES, span: int = SPAN, gram: int = GRAM, fan: int = FAN) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text): kept_text is null where nothing was removed.

    The rows come in `batches` ranges of doc_id, as they would over time; each finds its repeats in all before it.
    """
    with early_cleanup(docs.sparkSession):
        texts, late = _taken_in(docs, batches, span, gram, fan)
    every = reduce(DataFrame.unionByName, late).groupBy("doc", "part").agg(F.collect_list(F.struct("at", "length")).alias("late"))  # of one document, as above
    done = texts.join(every, ["doc", "part"], "left").select("doc", "m", "text", "late").mapInArrow(_rest(span), "doc long, m long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    each = done.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    return each.select(F.when(F.col("doc") != _FIRST, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept_text")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS no, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (
  SELECT no, doc_id, i, array_to_string(w[i : i + 19], ' ') AS s
  FROM (SELECT no, doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM t WHERE len(w) >= 20)),
f AS (SELECT md5(s) AS s, min(struct_pack(d := doc_id, i := i)) AS m FROM g GROUP BY md5(s)),
late AS (SELECT g.no, g.i FROM g JOIN f ON md5(g.s) = f.s WHERE struct_pack(d := g.doc_id, i := g.i) > f.m),
gone AS (SELECT DISTINCT no, unnest(generate_series(i, i + 19)) AS k FROM late),
word AS (SELECT no, unnest(w) AS v, unnest(generate_series(1, len(w))) AS k FROM t),
kept AS (SELECT no, count(*) AS n, string_agg(v, ' ' ORDER BY k) AS s FROM word ANTI JOIN gone USING (no, k) GROUP BY no)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (no)"""
