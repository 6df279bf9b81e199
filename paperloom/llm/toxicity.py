"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens are words and six-byte word stems, by 64-bit hashes. A token's weight is its log-odds between toxic and
clean training rows under a Dirichlet prior proportional to its count in the whole corpus, drawn towards zero
by a number of its standard deviations: what the labels do not support weighs nothing, and what speaks for clean
text weighs less than nothing. Every occurrence scores, less a drift, so a text at large scores below zero, and a
linear scan (Ruzzo and Tompa) finds all maximal segments. A segment's score is that of the best run of tokens in
it where what the segment repeats counts once.
Segment scores of clean training rows fit the extreme-value law P(S >= x) = 1 - exp(-K n exp(-lambda x)); a
document's evidence is the significance of its best segment and the sum over its segments, best first, where what
a better one holds counts no more; a two-feature logistic curve maps it to 0..1. `passages` lists the significant segments themselves.

The labelled rows that the classifier is fitted on are at most MAX_LABELLED (those of lowest hash); the prior
counts and the scores cover every row. The counts stay in a table that is joined by token; what comes to the
driver are the weights of tokens of the labelled rows. Null and empty texts have no tokens and get the score of
no evidence; a text of any length is scanned whole, and rows alike score alike. Rows whose label is null, and
labels without a document, are not used; a document labelled twice counts as toxic if any label says so. Without
toxic or without clean rows the score is their share; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import save

MAX_LABELLED = 20_000
STEM = 6
#: Prior weight in documents, standard deviations given up, the least log-odds that count, and the cost of a token that says nothing.
PRIOR, SHRINK, LEAST, DRIFT = 20.0, 1.5, 0.3, 0.1
#: Distinct tokens that a task counts before it passes them on.
HELD = 1_000_000
#: A passage is listed if chance gives at most so many as good in a clean text of its length.
EXPECTED = 0.05

_SEP = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def _tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key of each word, key of its stem, document number, start and end."""
    low = _LOW[buf]
    start, end, doc = tv.words(low, off, _SEP)
    stem = tv.word_hashes(low, start, np.minimum(end, start + STEM))
    return tv.word_hashes(low, start, end), tv.mix(stem ^ np.uint64(0x9E3779B97F4A7C15)), doc, start, end


def segments(score: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, past) of a sequence, in linear time."""
    total = np.concatenate([[0.0], np.cumsum(score)])
    found: list[list] = []  # left sum, right sum, first, past, index of the nearest earlier one with a lower left sum
    for i in np.flatnonzero(score > 0).tolist():
        left, right, first, j = float(total[i]), float(total[i + 1]), i, len(found) - 1
        while True:
            while j >= 0 and found[j][0] >= left:
                j = found[j][4]
            if j < 0 or found[j][1] >= right:
                found.append([left, right, first, i + 1, j])
                break
            left, first, before = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = before
    return [(r - a, f, p) for a, r, f, p, _ in found]


def _best(score: list[float]) -> float:
    """The greatest sum of a run of a sequence, 0 for none."""
    best = now = 0.0
    for v in score:
        now = now + v if now + v > 0 else 0.0
        best = now if now > best else best
    return best


@dataclass
class Model:
    """Weights by token key, the extreme-value constants and the logistic curve."""

    keys: np.ndarray
    weight: np.ndarray
    lam: float = 1.0
    ln_k: float = 0.0
    curve: tuple[float, float, float] = (-3.0, 0.0, 0.0)

    def _weights(self, key: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(key))
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.weight[at], 0.0)

    def token_scores(self, word: np.ndarray, stem: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each token, by word or stem, whichever says more, and the key that it goes by."""
        own, base = self._weights(word), self._weights(stem)
        mine = np.abs(own) >= np.abs(base)
        return np.where(mine, own, base) - DRIFT, np.where(mine, word, stem)

    def found(self, col: pa.Array, least: float = -np.inf) -> Iterator[tuple[int, list[tuple[float, int, int, float]], np.ndarray, np.ndarray]]:
        """(tokens, maximal segments, start and end byte of each token) of each text, in order.

        A segment is (score, first, past, fresh): its score counts a token once, `fresh` only tokens that no better segment
        has. Segments whose significance cannot exceed `least`, 0 or less, are left out.
        """
        for i, j, buf, off in tv.chunks(col):
            word, stem, doc, start, end = _tokens(buf, off)
            score, key = self.token_scores(word, stem)
            bounds = np.searchsorted(doc, np.arange(j - i + 1))
            some = np.zeros(j - i, bool)
            some[doc[score > 0]] = True
            for d in range(j - i):
                a, b = int(bounds[d]), int(bounds[d + 1])
                found = []
                for s, f, p in segments(score[a:b]) if some[d] else []:
                    if not self.significance(b - a, s) > least:
                        continue
                    mine = score[a + f : a + p].tolist()
                    up = {}  # first place of each token that counts
                    for k, v in enumerate(mine):
                        if v > 0 and up.setdefault(int(key[a + f + k]), k) != k:
                            mine[k] = -DRIFT
                    found.append((_best(mine), f, p, mine, up))
                found.sort(key=lambda x: (-x[0], x[1]))
                out, seen = [], set()
                for s, f, p, mine, up in found:
                    known = up.keys() & seen
                    fresh = s
                    if known:
                        for k in known:
                            mine[up[k]] = -DRIFT
                        fresh = _best(mine)
                    out.append((s, f, p, fresh))
                    seen |= up.keys()
                yield b - a, out, start[a:b] - off[d], end[a:b] - off[d]

    def significance(self, n: int, score: np.ndarray) -> np.ndarray:
        """-ln(E) of segments, E = K n exp(-lambda S)."""
        return self.lam * score - self.ln_k - np.log(max(n, 1))

    def evidence(self, n: int, found: list[tuple[float, float]]) -> tuple[float, float]:
        """Significance of the best segment and of all, given (score, fresh) of each; squashed by log1p."""
        if not found:
            return 0.0, 0.0
        sig = np.maximum(0.0, self.significance(n, np.array(found)))
        return float(np.log1p(sig[:, 0].max())), float(np.log1p(sig[:, 1].sum()))

    def scores(self, col: pa.Array) -> np.ndarray:
        x = np.array([self.evidence(n, [(s, f) for s, _, _, f in found]) for n, found, _, _ in self.found(col, 0.0)]).reshape(-1, 2)
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a + x @ np.array([b, c]), -30, 30)))


@tv.tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each token in the texts of this task."""
    held: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {False: [], True: []}

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return key, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(key)).astype(np.int64)

    def flush(least: int) -> Iterator[pa.RecordBatch]:
        for stem, parts in held.items():
            if parts and sum(len(k) for k, _ in parts) > least:
                held[stem] = [merged(parts)]
                if len(held[stem][0][0]) > least // 2:
                    key, n = held[stem].pop()
                    for i in range(0, len(key), 100_000):
                        yield pa.RecordBatch.from_pydict({"stem": pa.array(np.full(len(key[i : i + 100_000]), stem)), "h": pa.array(key[i : i + 100_000].view(np.int64)), "n": pa.array(n[i : i + 100_000])})

    for batch in batches:
        for _, _, buf, off in tv.chunks(batch["text"]):
            word, stem, *_ = _tokens(buf, off)
            held[False].append(np.unique(word, return_counts=True))
            held[True].append(np.unique(stem, return_counts=True))
        yield from flush(HELD)
    yield from flush(0)


@tv.tidy
def _count_labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of each labelled text, once a text."""
    for batch in batches:
        label = batch["label"].to_numpy()
        for i, j, buf, off in tv.chunks(batch["text"]):
            word, stem, doc, *_ = _tokens(buf, off)
            for kind, key in ((False, word), (True, stem)):
                order = np.lexsort((key, doc))
                k, d = key[order], doc[order]
                new = np.ones(len(k), bool)
                new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
                yield pa.RecordBatch.from_pydict({"stem": pa.array(np.full(int(new.sum()), kind)), "h": pa.array(k[new].view(np.int64)), "toxic": pa.array((label[i:j][d[new]] == 1).astype(np.int64))})


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text, divisible by 5. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _odds(corpus: DataFrame, sample: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """(h, weight): shrunken log-odds, signed, of the tokens that weigh anything. Counted by document, repeats within one text add nothing.

    The prior of a token is its share of the corpus, scaled to PRIOR documents of the mean length.
    """
    of = sample.groupBy("stem", "h").agg(F.sum("toxic").cast("double").alias("t"), F.sum(1 - F.col("toxic")).cast("double").alias("c"))
    of = save(of, "labelled-tokens")
    kinds = corpus.groupBy("stem").agg(F.sum("n").alias("every"), F.count("*").alias("words"))
    kinds = kinds.join(of.groupBy("stem").agg((F.sum(F.col("t") + F.col("c")) / (n_toxic + n_clean)).alias("length")), "stem")  # two rows
    share = F.col("length") * (F.col("n") + 0.5) / (F.col("every") + 0.5 * F.col("words"))
    prior = PRIOR * F.least(F.greatest(share, F.lit(1e-4)), F.lit(0.9))
    rows = of.join(corpus, ["stem", "h"]).join(F.broadcast(kinds), "stem").select("h", (F.col("t") + prior).alias("t"), (F.col("c") + prior).alias("c"))
    odds = F.log(F.col("t") / (n_toxic + PRIOR - F.col("t"))) - F.log(F.col("c") / (n_clean + PRIOR - F.col("c")))
    sure = F.abs(odds) - SHRINK * F.sqrt(1 / F.col("t") + 1 / F.col("c"))
    return rows.select("h", (F.signum(odds) * sure).alias("weight"), sure.alias("sure")).where(F.col("sure") > LEAST).select("h", "weight")


def _decay(value: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(lambda * value)) = 1; value's mean is below zero."""
    if not len(value) or value.max() <= 0:
        return 1.0
    lo, hi = 0.0, 1.0
    excess = lambda x: float((share * np.exp(np.minimum(x * value, 700))).sum()) - 1
    while excess(hi) < 0 and hi < 64:
        hi *= 2
    lo = hi / 2**20
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    return hi


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float, float]:
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 9.5))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        pull = ridge * np.array([0, w[1], w[2]])
        grad = a.T @ (y - p) - pull
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-6, ridge, ridge])
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on the labelled rows that are not held out; prior counts come from all rows of docs."""
    picked = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id")))
        .groupBy("id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    )
    picked = save(picked, "labelled")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    # copies of one text are one observation
    sample = save(rows.join(F.broadcast(picked), "id").groupBy("text").agg(F.max("label").alias("label")), "sample")
    sizes = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    model = Model(np.zeros(0, np.uint64), np.zeros(0))
    if sizes.get(1) and sizes.get(0):
        corpus = save(rows.select("text").mapInArrow(_count, "stem boolean, h long, n long").groupBy("stem", "h").agg(F.sum("n").alias("n")), "tokens")
        found = _odds(corpus, sample.mapInArrow(_count_labelled, "stem boolean, h long, toxic long"), sizes[1], sizes[0]).toArrow()  # tokens of the labelled rows
        order = np.argsort(found["h"].to_numpy().view(np.uint64))
        model = Model(found["h"].to_numpy().view(np.uint64)[order], found["weight"].to_numpy()[order].astype(np.float32))
    return _calibrate(model, sample)


def _calibrate(model: Model, sample: DataFrame) -> Model:
    """Extreme-value constants from clean training rows, then the curve from all training rows."""

    @tv.tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch["label"].to_pylist()
            value = np.zeros(0)
            many = np.zeros(0, np.int64)
            for i, j, buf, off in tv.chunks(batch["text"]):
                word, stem, doc, *_ = _tokens(buf, off)
                clean = np.array(label[i:j])[doc] == 0 if len(doc) else np.zeros(0, bool)
                v, k = np.unique(np.round(model.token_scores(word, stem)[0][clean], 1), return_counts=True)
                value, many = np.concatenate([value, v]), np.concatenate([many, k])
            uniq, at = np.unique(value, return_inverse=True)
            many = np.bincount(at, weights=many, minlength=len(uniq)).astype(np.int64)
            rows = [(int(y), n, [(s, f) for s, _, _, f in found]) for y, (n, found, _, _) in zip(label, model.found(batch["text"]), strict=True)]
            yield pa.RecordBatch.from_pydict({
                "label": pa.array([y for y, _, _ in rows] + [-1] * len(uniq), pa.int32()),
                "n": pa.array([n for _, n, _ in rows] + many.tolist(), pa.int64()),
                "found": pa.array([[x for x, _ in s] for _, _, s in rows] + [[float(v)] for v in uniq], pa.list_(pa.float64())),
                "fresh": pa.array([[x for _, x in s] for _, _, s in rows] + [[]] * len(uniq), pa.list_(pa.float64())),
            })

    rows = sample.mapInArrow(scan, "label int, n long, found array<double>, fresh array<double>").toArrow().to_pylist()  # bounded by max_labelled
    rows.sort(key=lambda r: (r["label"], r["n"], r["found"]))
    back = [r for r in rows if r["label"] < 0]
    docs = [r for r in rows if r["label"] >= 0]
    y = np.array([r["label"] for r in docs], float)
    if not len(docs) or not y.sum() or y.sum() == len(y):
        model.curve = (float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 9.5))), 0.0, 0.0)
        return model
    many = np.array([r["n"] for r in back], float)
    model.lam = _decay(np.array([r["found"][0] for r in back]), many / many.sum())
    tops = np.array([model.lam * max(r["found"]) - np.log(max(r["n"], 1)) for r in docs if r["label"] == 0 and r["found"]])
    # a clean row without a segment lies below every fitted one; the Gumbel mean is ln K + Euler's constant
    model.ln_k = float(tops.mean() - 0.5772156649) if len(tops) else 0.0
    x = np.array([model.evidence(r["n"], list(zip(r["found"], r["fresh"], strict=True))) for r in docs])
    model.curve = _logistic(x, y)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of docs."""

    @tv.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "score": pa.array(model.scores(batch["text"]))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that score under one half, all columns unchanged."""

    @tv.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch["text"].cast(pa.string())) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def passages(docs: DataFrame, model: Model, expected: float = EXPECTED) -> DataFrame:
    """(doc_id, first, past, score, expected, passage): every significant segment of each row of docs, by its tokens.

    `expected` is the number of segments as good that chance gives in a clean text as long.
    """

    @tv.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, raw, (n, found, start, end) in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.large_binary()), model.found(batch["text"], min(0.0, -float(np.log(expected)))), strict=True):
                for s, f, p, _ in sorted(found, key=lambda x: x[1]):
                    e = float(np.exp(-model.significance(n, np.array(s))))
                    if e <= expected:
                        rows.append((doc, f, p, s, e, raw.as_py()[start[f] : end[p - 1]].decode()))
            cols = zip(*rows, strict=True) if rows else [()] * 6
            types = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for c, v, t in zip(("doc_id", "first", "past", "score", "expected", "passage"), cols, types, strict=True)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, first int, past int, score double, expected double, passage string")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    found = score(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
