"""Language identification by unigram pieces, with all segmentations of a word summed.

The pieces are those of a fixed public vocabulary; each language has a probability for each piece. A word, led by the
vocabulary's mark for a word start, has the probability of all ways to cut it into pieces, summed by a forward pass over its
code points; a text has that of its words, times its language's share of the texts that were learned from. The prediction is the
language of greatest posterior, the score that posterior; of equal languages the first by code point wins.

Piece probabilities are learned by expectation maximisation over all words of all labelled texts: words are counted per
language in one shuffle, and in each of ROUNDS rounds every distinct word spreads its count over its segmentations by a
forward and a backward pass. Counts are smoothed towards those of all languages together, worth PRIOR pieces. What comes to the driver
is one number for each piece and language (256 kB a language); languages are learned and scored in blocks of LANGS, so their
number is not bounded. A code point that is no piece of its own is one piece for all such.

Words are runs of letters (with their marks), in lower case and composed form; all else is no evidence. Texts are read whole, in
linear time. A null text, or one without a letter, is `und` with score 0; so is every text where nothing could be learned. A null
doc_id is not held out. Repeated rows give repeated rows, an empty table none; other columns than doc_id, text and lang are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save
from .textvec import chunks, tidy, word_hashes, words
from .toxicity import held_out

#: The public vocabulary; a file of its own for each executor, sent by Spark.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
ROUNDS, PRIOR, LANGS = 2, 2000.0, 64
MARK, UNKNOWN = "▁", 0
#: Distinct words that a task keeps before it writes them out, or forgets their scores.
KEPT = 200_000
#: Longest word whose pieces are held between the passes.
LOOKED_UP = 256

_APART = np.ones(256, bool)  # in lower-case UTF-8: everything but a-z and what is not ASCII
_APART[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BITS, _SHIFT = 18, np.uint64(46)


class Pieces:
    """Pieces by number (0: unknown), and a table of their prefixes by hash."""

    def __init__(self, pieces: list[str]) -> None:
        self.pieces = ["", *sorted({p for p in pieces if _WORD.fullmatch(p.removeprefix(MARK)) or p == MARK})]
        piece = {p: i for i, p in enumerate(self.pieces) if i}
        prefixes = sorted({p[:i] for p in piece for i in range(1, len(p) + 1)})
        hashed = np.array([self._hash(p) for p in prefixes], np.uint64)
        order = np.argsort(hashed)
        self.hashes, self.piece = hashed[order], np.array([piece.get(p, -1) for p in prefixes], np.int64)[order]
        if len(hashed) and not (np.diff(self.hashes) > 0).all():
            raise ValueError("two prefixes of pieces share a hash")
        # first place of each bucket of hashes, by their leading bits; the last place holds none
        self.first = np.searchsorted(self.hashes, np.arange(1 << _BITS, dtype=np.uint64) << _SHIFT).astype(np.int32)
        self.deep = int(np.bincount((self.hashes >> _SHIFT).astype(np.int64)).max()) if len(hashed) else 0
        self.hashes, self.piece = np.append(self.hashes, np.uint64(0)), np.append(self.piece, -1)

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_BASE) + ord(c) + 1) % 2**64
        return h * int(_MIX) % 2**64

    def _found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a hash is that of a prefix, and its piece (-1: none)."""
        if len(h) < 256:  # few: a search has fewer steps
            i = np.searchsorted(self.hashes[:-1], h)
            there = (self.hashes[i] == h) & (i < len(self.hashes) - 1)
            return there, np.where(there, self.piece[i], -1)
        i = self.first[h >> _SHIFT]
        there = self.hashes[i] == h
        left = np.flatnonzero(~there)
        for _ in range(1, self.deep):
            i[left] = np.minimum(i[left] + 1, len(self.hashes) - 1)
            hit = self.hashes[i[left]] == h[left]
            there[left[hit]] = True
            left = left[~hit]
            left = left[(self.hashes[i[left]] < h[left]) & (i[left] < len(self.hashes) - 1)]  # in order: a greater one ends the search
        there &= i < len(self.hashes) - 1
        return there, np.where(there, self.piece[i], -1)

    def edges(self, points: np.ndarray, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """points: code points of words of one length, a row each. (length, rows, pieces) of the pieces that start at `at`."""
        rows = np.arange(len(points))
        h = np.zeros(len(points), np.uint64)
        for k in range(1, points.shape[1] - at + 1):
            h = h * _BASE + (points[:, at + k - 1][rows] + 1).astype(np.uint64)
            there, piece = self._found(h * _MIX)
            if k == 1:
                yield 1, rows, np.maximum(piece, UNKNOWN)
            else:
                ends = piece >= 0
                if ends.any():
                    yield k, rows[ends], piece[ends]
            rows, h = rows[there], h[there]
            if not len(rows):
                return


@lru_cache(2)
def load(path: str) -> Pieces:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return Pieces([model.id_to_piece(i) for i in range(model.get_piece_size())])


def by_length(found: list[str], least: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers, code points) of the words with their mark, those of one length together, in parts of about `least` code points."""
    lengths = np.array([len(w) for w in found], np.int64)
    order = np.argsort(lengths, kind="stable")
    cut = np.flatnonzero(np.diff(lengths[order])) + 1
    for same in np.split(order, cut):
        if len(same):
            n = int(lengths[same[0]]) + 1
            for i in range(0, len(same), max(1, least // n)):
                part = same[i : i + max(1, least // n)]
                text = "".join(MARK + found[j] for j in part.tolist())
                yield part, np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(part), n)


def _plain(logp: np.ndarray, n: int) -> bool:
    """Whether the probability of every segmentation of n code points is a normal double, so that sums need no logarithms."""
    return logp.size > 0 and n * -logp.min() < 650 and logp.max() <= 0


def likelihoods(known: Pieces, found: list[str], logp: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language (a column of logp), all segmentations summed."""
    out = np.zeros((len(found), logp.shape[1]))
    p = np.exp(logp)
    for numbers, points in by_length(found):
        n = points.shape[1]
        plain = _plain(logp, n)
        ahead = {0: np.full((len(numbers), logp.shape[1]), 1.0 if plain else 0.0)}
        for at in range(n):
            here = ahead.pop(at)
            for k, rows, piece in known.edges(points, at):
                if plain:
                    step = (here if k == 1 else here[rows]) * p[piece]
                    if k == 1:  # all rows
                        ahead[at + 1] = ahead[at + 1] + step if at + 1 in ahead else step
                    else:
                        to = ahead.setdefault(at + k, np.zeros_like(here))
                        to[rows] += step
                else:
                    to = ahead.setdefault(at + k, np.full_like(here, -np.inf))
                    to[rows] = np.logaddexp(to[rows], here[rows] + logp[piece])
        out[numbers] = np.log(ahead[n]) if plain else ahead[n]
    return out


def expected(known: Pieces, found: list[str], lang: np.ndarray, count: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Expected number of each piece in each language over words that occur `count` times in their language."""
    total = np.zeros(logp.shape)
    flat, p = total.reshape(-1), np.exp(logp).reshape(-1)
    for numbers, points in by_length(found, 1 << 17):
        n, mine, times = points.shape[1], lang[numbers], count[numbers]
        if _plain(logp, n):
            _expected_plainly(known, points, mine, times, p, flat, total.shape[1])
            continue
        front = np.full((n + 1, len(numbers)), -np.inf)
        front[0] = 0
        edges = {}
        for at in range(n):
            edges[at] = list(known.edges(points, at))
            for k, rows, piece in edges[at]:
                front[at + k, rows] = np.logaddexp(front[at + k, rows], front[at, rows] + logp[piece, mine[rows]])
            if n > LOOKED_UP:  # looked up again on the way back
                del edges[at]
        back = np.full((n + 1, len(numbers)), -np.inf)
        back[n] = 0
        for at in reversed(range(n)):
            for k, rows, piece in edges.get(at) or known.edges(points, at):
                rest = logp[piece, mine[rows]] + back[at + k, rows]
                back[at, rows] = np.logaddexp(back[at, rows], rest)
                share = np.exp(front[at, rows] + rest - front[n, rows]) * times[rows]
                np.add.at(flat, piece * total.shape[1] + mine[rows], share)
    return total


def _expected_plainly(known: Pieces, points: np.ndarray, mine: np.ndarray, times: np.ndarray, p: np.ndarray, flat: np.ndarray, langs: int) -> None:
    """Adds to flat the expected pieces of words of one length, where no product can vanish; such words are short."""
    n = points.shape[1]
    front = np.zeros((n + 1, len(mine)))
    front[0] = 1
    edges = []
    for at in range(n):
        for k, rows, piece in known.edges(points, at):
            cell = piece * langs + mine[rows]
            odds = p[cell]
            front[at + k, rows] += front[at, rows] * odds
            edges.append((at, k, rows, cell, odds))
    back = np.zeros((n + 1, len(mine)))
    back[n] = times / front[n]
    cells, shares = [], []
    for at, k, rows, cell, odds in reversed(edges):
        rest = odds * back[at + k, rows]
        back[at, rows] += rest
        cells.append(cell)
        shares.append(front[at, rows] * rest)
    flat += np.bincount(np.concatenate(cells), np.concatenate(shares), len(flat))


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities (piece, language) of expected counts."""
    both = counts.sum(axis=1) + 1
    base = PRIOR * both / both.sum()
    return np.log(counts + base[:, None]) - np.log(counts.sum(axis=0) + PRIOR)


def split(token: str) -> list[str]:
    """Words of a token; what is ASCII is one word."""
    return [token] if token.isascii() else _WORD.findall(unicodedata.normalize("NFC", token))


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[str]]]:
    """For runs of rows: first row, past row, row of each token, its number among the distinct ones, and these."""
    for i, j, buf, offsets in chunks(pc.utf8_lower(column.cast(pa.large_string())), 1 << 22):
        start, end, row = words(buf, offsets, _APART)
        h, first, number = np.unique(word_hashes(buf, start, end), return_index=True, return_inverse=True)
        data = buf.tobytes()
        yield i, j, row, number, [data[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)] if len(h) else []


def _path(vocabulary: str) -> str:
    return SparkFiles.get(vocabulary)


def _counted(langs: dict[str, int]):  # noqa: ANN202
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def summed() -> pa.Table:
            done = pa.concat_tables(held).group_by(["lang", "word"], use_threads=False).aggregate([("n", "sum")])
            return pa.table({"lang": done["lang"], "word": done["word"], "n": done["n_sum"]})

        for batch in batches:
            mine = np.array([langs[v] for v in batch.column(0).to_pylist()], np.int64)
            for i, _, row, number, tokens in _tokens(batch.column(1)):
                if not tokens:
                    continue
                cut = [(j, w) for j, t in enumerate(tokens) if not t.isascii() for w in split(t)]
                pair, n = np.unique(number * len(langs) + mine[i + row], return_counts=True)
                token, lang = np.divmod(pair, len(langs))
                whole = pa.array(tokens, pa.string())
                ascii_ = np.array([t.isascii() for t in tokens])[token]
                held.append(pa.table({"lang": pa.array(lang[ascii_], pa.int32()), "word": whole.take(pa.array(token[ascii_])), "n": pa.array(n[ascii_], pa.int64())}))
                if cut:  # each word of a token, as often as the token in its language
                    of, of_words = np.array([c[0] for c in cut], np.int64), pa.array([c[1] for c in cut], pa.string())
                    low, high = np.searchsorted(token, of), np.searchsorted(token, of, "right")
                    place = np.repeat(np.arange(len(of)), high - low)
                    at = np.arange(len(place)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[place]
                    held.append(pa.table({"lang": pa.array(lang[at], pa.int32()), "word": of_words.take(pa.array(place)), "n": pa.array(n[at], pa.int64())}))
                size += len(pair) + len(cut)
                if size > KEPT:
                    held = [summed()]
                    size = len(held[0])
                    if size > KEPT // 2:
                        yield from held[0].to_batches()
                        held, size = [], 0
        if held:
            yield from summed().to_batches()

    return run


def _spread(vocabulary: str, model: object, low: int):  # noqa: ANN202
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logp, total = load(_path(vocabulary)), model.value, None
        for batch in batches:
            got = expected(known, batch.column(1).to_pylist(), batch.column(0).to_numpy() - low, batch.column(2).to_numpy().astype(float), logp)
            total = got if total is None else total + got
        if total is not None:
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[piece, lang])], names=["piece", "lang", "n"])

    return run


@dataclass
class Model:
    """Languages in code point order, their log share, and log-probabilities (piece, language)."""

    vocabulary: str
    langs: list[str]
    share: np.ndarray
    logp: np.ndarray


def train(docs: DataFrame, vocabulary: str = VOCABULARY) -> Model:
    """Learn from text and non-null lang of all rows of docs."""
    spark = docs.sparkSession
    spark.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null")
    found = sorted((r.lang.encode(), r.lang, r["count"]) for r in rows.groupBy("lang").count().collect())  # a row for each language
    langs = [r[1] for r in found]
    pieces = len(load(vocabulary).pieces)
    if not langs:
        return Model(name, [], np.zeros(0), np.zeros((pieces, 0)))
    counted = rows.where("text is not null").mapInArrow(_counted({v: i for i, v in enumerate(langs)}), "lang int, word string, n long")
    table = save(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    logp = np.full((pieces, len(langs)), -np.log(pieces))
    for _ in range(ROUNDS):
        counts = np.zeros_like(logp)
        for low in range(0, len(langs), LANGS):
            part = spark.sparkContext.broadcast(logp[:, low : low + LANGS])
            mine = table.where(F.col("lang").between(low, low + LANGS - 1))
            got = mine.mapInArrow(_spread(name, part, low), "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
            counts[got["piece"].to_numpy(), low + got["lang"].to_numpy()] = got["n"].to_numpy()
            part.unpersist()
        logp = smoothed(counts)
    share = np.log(np.array([r[2] for r in found], float)) - np.log(sum(r[2] for r in found))
    return Model(name, langs, share, logp)


def _scored(vocabulary: str, part: object, langs: list[str], share: np.ndarray, last: bool):  # noqa: ANN202
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds a block of languages to what is known of a text: its best language, that one's log-probability, and the sum of all."""
        known, logp = load(_path(vocabulary)), part.value
        seen: dict[str, int] = {}
        scores = np.zeros((1 << 12, len(langs) + 1))  # per token: log-probabilities, number of words
        for batch in batches:
            columns = batch.columns
            out: list[list] = [[], [], []]
            for i, j, row, number, tokens in _tokens(columns[1]):
                if len(seen) > KEPT:
                    seen.clear()
                new = [t for t in tokens if t not in seen]
                cut = [(k, w) for k, t in enumerate(new) for w in ((t,) if t.isascii() else split(t))]
                flat = likelihoods(known, [w for _, w in cut], logp)
                of = np.array([k for k, _ in cut], np.int64)
                while len(seen) + len(new) > len(scores):
                    scores = np.concatenate([scores, np.zeros_like(scores)])
                base = len(seen)
                for c in range(len(langs)):
                    scores[base : base + len(new), c] = np.bincount(of, flat[:, c], len(new))
                scores[base : base + len(new), -1] = np.bincount(of, minlength=len(new))
                seen.update(zip(new, range(base, base + len(new)), strict=True))
                at = np.array([seen[t] for t in tokens], np.int64)[number] if len(tokens) else np.zeros(0, np.int64)
                total = np.stack([np.bincount(row, scores[at, c], j - i) for c in range(len(langs) + 1)], axis=1)
                full, worded = total[:, :-1] + share, total[:, -1] > 0
                top = np.argmax(full, axis=1)
                best = full[np.arange(j - i), top]
                whole = best + np.log(np.exp(full - best[:, None]).sum(axis=1))
                olds = list(zip(*(columns[2 + c].slice(i, j - i).to_pylist() for c in range(3)), strict=True))
                for r, old in enumerate(olds):
                    if not worded[r]:
                        new_row = [None, None, None]
                    elif old[0] is None:
                        new_row = [langs[top[r]], float(best[r]), float(whole[r])]
                    else:
                        new_row = [*(old[:2] if old[1] >= best[r] else (langs[top[r]], float(best[r]))), float(np.logaddexp(old[2], whole[r]))]
                    for c in range(3):
                        out[c].append(new_row[c])
            arrays = [columns[0], pa.array([None] * len(columns[0]), pa.string()) if last else columns[1], pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text", "lang_pred", "best", "whole"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, lang_pred, score)."""
    spark = docs.sparkSession
    null = lambda t: F.lit(None).cast(t)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), null("string").alias("lang_pred"), null("double").alias("best"), null("double").alias("whole"))
    n = len(model.langs)
    for low in range(0, n, LANGS):
        at = slice(low, low + LANGS)
        part = spark.sparkContext.broadcast(np.ascontiguousarray(model.logp[:, at]))
        rows = rows.mapInArrow(_scored(model.vocabulary, part, model.langs[at], model.share[at], low + LANGS >= n), "doc_id long, text string, lang_pred string, best double, whole double")
    score = F.when(F.col("best").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.exp(F.col("best") - F.col("whole"))))
    return rows.select("doc_id", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), score.alias("score"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs.select("doc_id", "text"), train(docs.where(~held_out(F.col("doc_id"))).select("text", "lang")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
