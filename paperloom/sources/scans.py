"""A labelled corpus as if it had been scanned: the texts are what a reader makes of them, the truth stays.

Rendering, rasterising and reading images need libraries that are not here: `read` is an adapter. The bundled one confuses characters as
readers do, at a given rate, by a seed that follows from the document; so a corpus is the same each time it is built.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.numbers import is_blank

#: The tag that graded runs take as read by OCR, and what is mistaken for what.
TAG = "ocr_scanned"
LOOKS, READ_AS = "lIOSBgqeéèêáäöüñçíóú", "1l0589gceeeaaouncíou"
#: A place is hit where this falls below the rate: a step along a row of numbers for each character.
_PRIME, _STEP, _SHARE = 1_000_003, 7919, 1000


def seed(doc_id: Column) -> Column:
    """A number that follows from the document's id: the first fifteen hex digits of its SHA-256."""
    return F.conv(F.substring(F.sha2(doc_id.cast("string"), 256), 1, 15), 16, 10).cast("long")


def confused(text: Column, seed: Column, rate: float) -> Column:
    """The text with a share of its characters taken for others that look like them; its length stays."""
    start = F.pmod(seed, F.lit(_PRIME)) * 31
    hit = lambda i: F.pmod(start + (i + 1) * _STEP, F.lit(_SHARE)) < int(rate * _SHARE)
    read = F.transform(F.split(text, ""), lambda c, i: F.when(hit(i), F.translate(c, LOOKS, READ_AS)).otherwise(c))
    return F.when(text == "", "").otherwise(F.array_join(read, ""))


def _points(text: str) -> np.ndarray:
    """A text's characters as numbers: a split into strings takes a microsecond for each."""
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


_TABLE = np.arange(max(map(ord, LOOKS)) + 1, dtype=np.uint32)
_TABLE[[ord(c) for c in LOOKS]] = [ord(c) for c in READ_AS]


def confused_in_batches(text: Column, seed: Column, rate: float) -> Column:
    """What `confused` gives, on batches of texts: for tables whose texts are columns, not long expressions, which a plan repeats."""
    below = int(rate * _SHARE)

    @F.pandas_udf(T.StringType())
    def read(texts: pd.Series, starts: pd.Series) -> pd.Series:
        out = []
        for t, start in zip(texts, starts, strict=True):
            if not t or pd.isna(start):
                out.append(t)
                continue
            points = _points(t).copy()
            hit = ((int(start) + np.arange(1, len(points) + 1) * _STEP) % _SHARE < below) & (points < len(_TABLE))
            points[hit] = _TABLE[points[hit]]
            out.append(points.tobytes().decode("utf-32-le"))
        return pd.Series(out, dtype=object)

    return read(text, F.pmod(seed, F.lit(_PRIME)) * 31)


@F.pandas_udf(T.IntegerType())
def errors(text: pd.Series, read: pd.Series) -> pd.Series:
    """Places at which two texts of one length differ."""
    both = (None if a is None or b is None else (_points(a), _points(b)) for a, b in zip(text, read, strict=True))
    return pd.Series([None if x is None else int(np.count_nonzero(x[0][: len(x[1])] != x[1][: len(x[0])])) for x in both], dtype=object)


def reader(rate: float, how: Callable[[Column, Column, float], Column] = confused) -> Callable[[DataFrame], DataFrame]:
    """The bundled adapter."""
    return lambda docs: docs.withColumn("read", how(F.col("text"), F.col("seed"), rate))


def scanned(corpus: DataFrame, read: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """corpus (doc_id, text, difficulty, ...) as scanned documents, and (doc_id, reason) of those that could not be read.

    read gets (doc_id, text, seed) and gives them with `read`: null or blank where a document yields no text. Those are left out, as they would be in
    a run; the others have what was read as their text, and the tag.
    """
    given = corpus.select("doc_id", "text").withColumn("seed", seed(F.col("doc_id")))
    done = read(given).select(F.col("doc_id").alias("__id"), "read")
    both = corpus.join(done, F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    good = ~is_blank(F.col("read"))
    tagged = F.array_union(F.coalesce("difficulty", F.array().cast("array<string>")), F.array(F.lit(TAG)))
    out = both.where(good).withColumns({"text": F.col("read"), "difficulty": tagged}).select(*corpus.columns)
    return out, both.where(~good).select("doc_id", F.lit("empty_document").alias("reason"))
