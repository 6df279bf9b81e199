"""Regular-expression spans with code-point offsets, on DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A span as an array element: order is by start, then by the kind's place in its list.
SPAN = "struct<start:int,kind_no:int,end:int,kind:string,value:string>"


@dataclass(frozen=True)
class Rule:
    """A kind of span: its pattern, a literal test that every match passes (or None), and what a match must meet."""

    kind: str
    pattern: str
    hint: Callable[[Column], Column] | None = None
    accept: Callable[[Column], Column] | None = None


#: A span with the word before it and the word after it.
MARK = SPAN[:-1] + ",before:string,after:string>"
_SPACES = "\t\n\x0b\x0c\r"


def _last(gap: Column) -> Column:
    return F.substring_index(F.rtrim(F.translate(gap, _SPACES, " " * 5)), " ", -1)


def _first(gap: Column) -> Column:
    return F.substring_index(F.ltrim(F.translate(gap, _SPACES, " " * 5)), " ", 1)


def find(text: Column, rule: Rule, kind_no: int, words: bool = False) -> Column:
    """array<SPAN> (array<MARK> with `words`) of the leftmost non-overlapping matches of a rule that it accepts.

    The words around a match come from the text between it and the next match on that side, or from that match
    where there is nothing between them; whole words of any length, each gap being read once.
    """
    kind = MARK if words else SPAN
    none = F.array().cast(f"array<{kind}>")
    matches = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(1))
    gaps = F.split(text, rule.pattern, -1)
    # bound once: matches with the gaps before and after them; a match's start is the sum of what comes before
    trios = F.transform(F.array(F.struct(matches.alias("m"), gaps.alias("g"))), lambda b: F.arrays_zip(b["m"].alias("m"), F.slice(b["g"], 1, F.size(b["m"])).alias("g"), F.slice(b["g"], 2, F.size(b["m"])).alias("a")))[0]

    def place(z: Column) -> Column:
        lens = F.flatten(F.transform(z, lambda p: F.array(F.length(p["g"]), F.length(p["m"]))))
        return F.transform(F.array(lens), lambda n: _place(z, n, rule.kind, kind_no, words))[0]

    found = F.transform(F.array(trios), place)[0]
    if rule.accept:
        found = F.filter(found, lambda s: rule.accept(s["value"]))
    some = text.isNotNull() if rule.hint is None else text.isNotNull() & rule.hint(text)
    return F.when(some, F.when(F.regexp_like(text, F.lit(rule.pattern)), found).otherwise(none)).otherwise(none)


def _running(n: Column, levels: int = 2) -> Column:
    """Sums before each element of an int array: by blocks of 64, whose own running sums come in the same way."""
    top = F.greatest(F.size(n) - 1, F.lit(0))
    add = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    if not levels:
        return F.transform(F.sequence(F.lit(0), top), lambda i: add(F.slice(n, F.lit(1), i)))
    sums = F.transform(F.sequence(F.lit(0), F.floor(top / 64).cast("int")), lambda b: add(F.slice(n, b * 64 + 1, 64)))
    block = lambda i: F.floor(i / 64).cast("int")
    before = F.transform(F.array(sums), lambda s: _running(s, levels - 1))[0]
    return F.transform(F.array(before), lambda r: F.transform(F.sequence(F.lit(0), top), lambda i: r[block(i)] + add(F.slice(n, block(i) * 64 + 1, i - block(i) * 64))))[0]


def _place(z: Column, lens: Column, kind: str, kind_no: int, words: bool) -> Column:
    def span(at: Column, p: Column, i: Column) -> Column:
        fields = [at[i * 2 + 1].alias("start"), F.lit(kind_no).alias("kind_no"), (at[i * 2 + 1] + F.length(p["m"])).alias("end"), F.lit(kind).alias("kind"), p["m"].alias("value")]
        if words:
            near = lambda own, other, word: F.when(own != "", own).otherwise(word(F.coalesce(other["m"], F.lit(""))))
            fields += [near(_last(p["g"]), F.get(z, i - 1), _last).alias("before"), near(_first(p["a"]), F.get(z, i + 1), _first).alias("after")]
        return F.struct(*fields)

    return F.transform(F.array(_running(lens)), lambda at: F.transform(z, lambda p, i: span(at, p, i)))[0]


#: Code points of a block of free_of.
_BLOCK = 4096


def free_of(spans: Column, taken: Column, text: Column) -> Column:
    """The spans that overlap none of `taken`: each is held against those of its blocks of the text only."""
    last = F.floor(F.length(text) / _BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.filter(taken, lambda b: (b["start"] < (k + 1) * _BLOCK) & (b["end"] > k * _BLOCK)))
    at = lambda x: F.floor(x / _BLOCK).cast("int")

    def free(by: Column, s: Column) -> Column:
        return ~F.exists(F.sequence(at(s["start"]), at(s["end"] - 1)), lambda k: F.exists(by[k], lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))

    return F.when(F.size(taken) == 0, spans).otherwise(F.transform(F.array(blocks), lambda by: F.filter(spans, lambda s: free(by, s)))[0])


def joined(spans: Column) -> Column:
    """kind:start:end of each span by start, then kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    back = F.split(F.reverse(number), "")
    each = F.transform(F.filter(back, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, v: a + v) % 10 == 0


def spans_sql(base: list[tuple[str, str, str]], more: list[tuple[str, str, str]]) -> str:
    """SQL of (doc_id, n_<kind> of the base kinds, base_sha256, spans) over documents; kinds as (kind, pattern, condition on v)."""
    parts = []
    for k, (kind, pattern, ok) in enumerate([*base, *more]):
        parts.append(f"""
  SELECT no, {k} AS kind_no, '{kind}' AS kind, s, s + length(v) AS e FROM (
    SELECT no, unnest(m) AS v, unnest(list_transform(range(len(m)), lambda i: CAST(list_sum(list_transform(g[1 : i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i], lambda x: length(x))), 0) AS BIGINT))) AS s
    FROM (SELECT no, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS g FROM t WHERE regexp_matches(text, '{pattern}'))) WHERE {ok}""")
    union = " UNION ALL ".join(parts)
    counts = ", ".join(f"CAST(count(*) FILTER (kind_no = {k}) AS BIGINT) AS n_{kind}" for k, (kind, _, _) in enumerate(base))
    listed = lambda test: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no) FILTER ({test}), '')"
    return f"""
WITH t AS (SELECT row_number() OVER () AS no, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({union})
SELECT doc_id, {counts}, sha256({listed(f"kind_no < {len(base)}")}) AS base_sha256, {listed("kind_no IS NOT NULL")} AS spans
FROM t LEFT JOIN f USING (no) GROUP BY no, doc_id"""
