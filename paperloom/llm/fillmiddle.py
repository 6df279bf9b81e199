"""Fill-in-the-middle training texts: each text is cut at two units and its middle moved to the end.

A unit is a run of letters A-Z, a-z, or any other single code point. A text is held as its maximal runs of one class
(letters or not), each with the units and code points before it: a run of letters is one unit, any other run is as many
units as code points. A cut is found by binary search over the units before each run, and its place inside the run by
arithmetic, so no list of units is made. All texts of a batch are encoded at once; the work is linear in their bytes
and a text of any length is cut whole.

Which texts stay plain, and where the others are cut, follows from a hash of (seed, doc_id): rows of one id are treated
alike, and reruns agree. A null doc_id hashes as the empty string. Null and empty texts have no units and stay plain and
empty. A text that already holds a marker stays plain, so that every output can be taken apart again. Repeated rows give
repeated rows, an empty table gives none, and columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textvec import chunks, tidy

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are cut at all, and percent of those whose suffix comes first.
CUT, SUFFIX_FIRST = 90, 20
SEED = "1"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


@dataclass
class Runs:
    """Maximal class runs of a batch of texts; none spans two texts."""

    start: np.ndarray  # first byte of each run
    letters: np.ndarray  # whether it is a run of letters
    units: np.ndarray  # units before each run, and in all
    chars: np.ndarray  # code points before each run
    points: np.ndarray  # first byte of each code point, and the end
    first: np.ndarray  # first run of each text, and the number of runs

    def count(self) -> np.ndarray:
        """Units of each text."""
        at = self.units[self.first]
        return at[1:] - at[:-1]

    def code_points(self, row: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Code points of the batch before the given unit of the given text."""
        want = self.units[self.first[row]] + unit
        run = np.searchsorted(self.units, want, "right") - 1  # the run that holds the unit, or none at the end
        inside = np.minimum(run, max(0, len(self.start) - 1))
        return np.where(run >= len(self.start), len(self.points) - 1, self.chars[inside] + want - self.units[inside]) if len(self.start) else np.zeros(len(want), np.int64)


def encode(buf: np.ndarray, offsets: np.ndarray) -> Runs:
    """Class runs of the texts that lie in buf (UTF-8) from one offset to the next."""
    letter = _LETTER[buf]
    lead = (buf & 0xC0) != 0x80
    begins = np.zeros(len(buf) + 1, bool)
    begins[offsets] = True
    begins[1:-1] |= letter[1:] != letter[:-1]
    start = np.flatnonzero(begins[:-1])
    points = np.append(np.flatnonzero(lead), len(buf))
    chars = np.searchsorted(points, start)
    letters = letter[start]
    length = np.where(letters, 1, np.diff(np.append(chars, len(points) - 1)))
    units = np.concatenate([[0], np.cumsum(length)])
    return Runs(start, letters, units, chars, points, np.searchsorted(start, offsets))


def _draws(seed: str, doc_id: int | None) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _rearranged(ids: list[int | None], buf: np.ndarray, offsets: np.ndarray, seed: str, cut: int, suffix_first: int, markers: tuple[str, str, str]) -> pa.RecordBatch:
    runs = encode(buf, offsets)
    n = runs.count()
    draws = np.array([_draws(seed, i) for i in ids], np.int64).reshape(-1, 4)
    sides = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    rows = np.arange(len(ids))
    a, b = runs.code_points(rows, sides[:, 0]), runs.code_points(rows, sides[:, 1])
    zero = np.searchsorted(runs.points, offsets[:-1])
    cuts = runs.points[np.stack([a, b])] if len(buf) else np.zeros((2, len(ids)), np.int64)
    data = buf.tobytes()
    p, s, m = (x.encode() for x in markers)
    forms, outs = [], []
    for r, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        x, y = int(cuts[0, r]), int(cuts[1, r])
        if lo == hi or draws[r, 2] % 100 >= cut or any(data.find(t, lo, hi) >= 0 for t in (p, s, m)):
            forms.append("plain")
            outs.append(data[lo:hi])
        elif draws[r, 3] % 100 < suffix_first:
            forms.append("spm")
            outs.append(b"".join((s, data[y:hi], p, data[lo:x], m, data[x:y])))
        else:
            forms.append("psm")
            outs.append(b"".join((p, data[lo:x], s, data[y:hi], m, data[x:y])))
    plain = np.array([f == "plain" for f in forms], bool)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(n), pa.array(forms, pa.string()), pa.array(a - zero, pa.int64(), mask=plain), pa.array(b - a, pa.int64(), mask=plain), pa.array(outs, pa.binary()).cast(pa.string())], schema=_OUT
    )


def _overlap(x: str, y: str) -> bool:
    """Whether y, set right after a cut text or another marker, could be seen earlier through x."""
    return not x or (x != y and x in y) or any(x.endswith(y[:i]) for i in range(1, len(y)))


def rearrange(docs: DataFrame, seed: str = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n, form, prefix_chars, middle_chars, output): n units; form plain, psm or spm; lengths in code points."""
    if len({*markers}) < 3 or any(_overlap(x, y) for x in markers for y in markers):
        raise ValueError("markers must be three different texts, none inside another and none begun by the end of another")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, buf, offsets in chunks(batch.column(1)):
                yield _rearranged(ids[i:j], buf, offsets, seed, cut, suffix_first, markers)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text an output was made from."""

    def parts(x: Column, marks: list[str], then: Callable[[list[Column]], Column], got: tuple[Column, ...] = ()) -> Column:
        """Pieces between marks: the first of each kind, in order."""
        if not marks:
            return then([*got, x])
        head = F.substring_index(x, marks[0], 1)
        tail = x.substr(F.length(head) + len(marks[0]) + 1, F.length(x))
        return parts(tail, marks[1:], then, (*got, head))

    p, s, m = markers
    return (
        F.when(form == "psm", parts(output, [p, s, m], lambda x: F.concat(x[1], x[3], x[2])))
        .when(form == "spm", parts(output, [s, p, m], lambda x: F.concat(x[2], x[3], x[1])))
        .otherwise(output)
    )


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    made = rearrange(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    whole = F.sha2(restored(F.col("output"), F.col("form")), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), whole.alias("restored_sha256"))


_H = [f"CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)" for i in range(4)]
OP12_SQL = f"""
WITH cut AS (
  SELECT doc_id, t, k, len(k) AS n, {_H[2]} % 100 AS h3, {_H[3]} % 100 AS h4,
    least({_H[0]} % (len(k) + 1), {_H[1]} % (len(k) + 1)) AS a, greatest({_H[0]} % (len(k) + 1), {_H[1]} % (len(k) + 1)) AS b
  FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS k, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents)),
parts AS (
  SELECT doc_id, t, n, coalesce(array_to_string(k[1:a], ''), '') AS p, coalesce(array_to_string(k[a + 1:b], ''), '') AS m, coalesce(array_to_string(k[b + 1:n], ''), '') AS s,
    CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 >= {CUT} THEN 'plain' WHEN h4 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
  FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts"""
