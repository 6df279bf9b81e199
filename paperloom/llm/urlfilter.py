"""URL filtering: rules first, then segmented host and path tokens under naive Bayes.

Concatenated names of hosts and paths are split into words by a unigram Viterbi search; the unigrams are the
words of all pages' visible text, of any length. Tokens of pages that a rule decides train a multinomial
naive Bayes model, which gives the verdict for the others. Both models are tables that are joined by key: each
distinct name meets the words that it holds, each token its odds, so nothing that grows with the corpus is broadcast
or comes to the driver, and no two words share a count.

A verdict depends on host and path alone, so each distinct pair is judged once, and pages count as often as they
stand there; pages alike, or without a page_id, get the verdict of their pair. A null url, or one without `://`, has
an empty host and path and no tokens; its verdict is that of the prior, which is `allow` where the rules decide
nothing. Null html has no words. Names of any length are split whole. An empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, small

#: (verdict, host, path prefix)
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Letters up to which every part of a name is looked up as a word (longer ones only at lengths that words have), the smoothing of both models, and
#: what a letter of an unknown word costs.
SHORT_WORD, SMOOTH, LETTER = 32, 0.5, 2.3
#: Letters of parts that are passed on at a time.
PART_LETTERS = 1 << 21
#: Distinct words that a task counts before it passes them on.
HELD = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    has = url.contains("://")
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null without one."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule = verdict = None
    for v, h, p in order:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


_TAG, _LETTERS = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>"), re.compile(r"[^\W\d_]+")


def _html_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of visible text, of this task."""
    count: dict[str, int] = {}

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"word": pa.array(list(count), pa.string()), "n": pa.array(list(count.values()), pa.int64())})
        count.clear()
        return out

    for batch in batches:
        for html in batch["html"]:
            for w in _LETTERS.findall(_TAG.sub(" ", html.as_py() or "").lower()):
                count[w] = count.get(w, 0) + 1
            if len(count) > HELD:
                yield rows()
    yield rows()


def unigrams(pages: DataFrame) -> DataFrame:
    """(word, n) of all pages' visible text."""
    return pages.select(F.col("html").cast("string").alias("html")).mapInArrow(_html_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def split(name: str, known: dict[str, int], total: int) -> list[str]:
    """The words of highest joint probability; a run of letters that is no word costs a word and more by length."""
    cost = {w: math.log(total / n) for w, n in known.items()}
    rare = math.log(max(1, total))
    lengths = sorted({len(w) for w in cost}, reverse=True)
    best, back = [0.0] + [math.inf] * len(name), [0] * (len(name) + 1)
    unknown, since = math.inf, 0  # cost up to here where an unknown run ends here, and its start
    for j in range(1, len(name) + 1):
        unknown, since = min((unknown + LETTER, since), (best[j - 1] + rare + LETTER, j - 1))
        best[j], back[j] = unknown, since
        for i in (j - k for k in lengths if k <= j):
            c = cost.get(name[i:j])
            if c is not None and best[i] + c < best[j]:
                best[j], back[j] = best[i] + c, i
    out, j = [], len(name)
    while j:
        out.append(name[back[j] : j])
        j = back[j]
    return out[::-1]


def pieces(host: str, path: str) -> list[tuple[str, str, bool]]:
    """(mark, piece, whether it is a name to split): h of host labels, t of the last one, p of the path; digits as one mark."""
    labels = [x for x in host.split(".") if x]
    out = [("t:", x, False) for x in labels[-1:]]
    for label in labels[:-1]:
        for x in re.findall(r"[^\W\d_]+|\d+|[^\w-]+|_+", label):
            out.append(("h:", "#", False) if x.isdigit() else ("h:", x, x.isalpha()))
    for x in re.findall(r"[^\W\d_]+|\d+", path.lower()):
        out.append(("p:", f"#{len(x)}", False) if x.isdigit() else ("p:", x, True))
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(u, *x) for u, host, path in zip(*(batch[c].to_pylist() for c in ("u", "host", "path")), strict=True) for x in pieces(host, path)]
        cols = zip(*rows, strict=True) if rows else [()] * 4
        kinds = (pa.binary(), pa.string(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_pydict({c: pa.array(v, k) for c, v, k in zip(("u", "mark", "piece", "name"), cols, kinds, strict=True)})


def _substrings(longer: list[int]):  # noqa: ANN202
    """Each name with its parts that may be words: all of up to SHORT_WORD letters, and those of the given lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch["piece"].to_pylist():
                lengths = [*range(1, min(SHORT_WORD, len(name)) + 1), *(k for k in longer if k <= len(name))]
                step = max(1, PART_LETTERS // max(1, sum(lengths)))
                for at in range(0, len(name), step):
                    held = list({name[i : i + k] for i in range(at, min(at + step, len(name))) for k in lengths if i + k <= len(name)})
                    yield pa.RecordBatch.from_pydict({"piece": pa.array([name] * len(held), pa.string()), "word": pa.array(held, pa.string())})

    return run


def _split_names(total: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [split(name, {w["word"]: w["n"] for w in known or []}, total) for name, known in zip(batch["piece"].to_pylist(), batch["known"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"piece": batch["piece"], "words": pa.array(words, pa.list_(pa.string()))})

    return run


def tokens(urls: DataFrame, words: DataFrame) -> DataFrame:
    """urls (u, host, path) and words (word, n) -> (u, token), repeats included."""
    total = int(words.agg(F.sum("n")).first()[0] or 0)
    parts = save(urls.select("u", "host", "path").mapInArrow(_pieces, "u binary, mark string, piece string, name boolean"), "url-pieces")
    names = save(parts.where("name").select("piece").distinct(), "names")
    most = names.agg(F.max(F.length("piece"))).first()[0] or 0
    long_words = words.select(F.length("word").alias("n")).where((F.col("n") > SHORT_WORD) & (F.col("n") <= most)).distinct()
    longer = sorted(r[0] for r in long_words.collect())  # lengths, not words: as many as the longest name has letters at most
    known = names.mapInArrow(_substrings(longer), "piece string, word string").join(words, "word").groupBy("piece").agg(F.collect_list(F.struct("word", "n")).alias("known"))  # of one name: its own parts
    found = names.join(known, "piece", "left").mapInArrow(_split_names(total), "piece string, words array<string>")
    named = parts.where("name").join(found, "piece").select("u", "mark", F.explode("words").alias("word"))
    rest = parts.where("not name").select("u", "mark", F.col("piece").alias("word"))
    return named.unionByName(rest).select("u", F.concat("mark", "word").alias("token"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, odds): odds of block against allow by the model."""
    host, path = parts(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    rows = rows.withColumn("u", F.unhex(F.md5(F.concat(F.col("host"), F.lit("\n"), F.col("path")).cast("binary"))))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = save(rows.groupBy("u").agg(F.min("host").alias("host"), F.min("path").alias("path"), F.count("*").alias("n")).select("*", verdict.alias("ruled")), "urls")
    held = save(tokens(urls, save(unigrams(pages), "unigrams")), "tokens")
    n_block, n_allow = (int(x or 0) for x in urls.agg(F.sum(F.when(F.col("ruled") == "block", F.col("n"))), F.sum(F.when(F.col("ruled") == "allow", F.col("n")))).first())
    if n_block and n_allow:
        prior = math.log(n_block / n_allow)
        taught = held.join(urls.where("ruled is not null").select("u", "n", "ruled"), "u").groupBy("token").agg(F.sum(F.when(F.col("ruled") == "block", F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(F.col("ruled") == "allow", F.col("n")).otherwise(0)).alias("a"))
        taught = save(taught, "taught")
        kinds, block, allow = (int(x or 0) for x in taught.agg(F.count("*"), F.sum("b"), F.sum("a")).first())
        log_of = lambda c, total: F.log((c + SMOOTH) / F.lit(total + SMOOTH * max(1, kinds)))
        odds = taught.select("token", (log_of(F.col("b"), block) - log_of(F.col("a"), allow)).alias("odds"))
        new = math.log(allow + SMOOTH * max(1, kinds)) - math.log(block + SMOOTH * max(1, kinds))  # of a token that no ruled page has
        summed = held.join(small(odds, kinds), "token", "left").groupBy("u").agg(F.sum(F.coalesce("odds", F.lit(new))).alias("odds"))
        scored = urls.join(summed, "u", "left").select("u", (F.lit(prior) + F.coalesce("odds", F.lit(0.0))).alias("odds"))
    else:  # one class or none: the prior decides
        scored = urls.select("u", F.lit(math.log((n_block + 0.5) / (n_allow + 0.5)) - 0.001).alias("odds"))
    judged = rows.join(scored, "u").select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), "odds")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("odds") > 0, "block").otherwise("allow")).alias("verdict"), "odds")


def op7_url_filter(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")
