"""Paths into nested payloads: flatten, expand, templates."""

from __future__ import annotations

from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAF = "struct<path:string,template:string,kind:string,flags:string,value:string>"


def get(data: Column, path: str) -> Column:
    """A leaf of a struct by a dotted path without lists."""
    return reduce(lambda c, p: c[p], path.split("."), data)


def template(path: Column) -> Column:
    """line_items.2.total becomes line_items[].total."""
    return F.regexp_replace(path, r"\.\d+(?=\.|$)", "[]")


def parent(path: Column) -> Column:
    """The path above; empty for a top-level one."""
    return F.when(path.contains("."), F.regexp_replace(path, r"\.[^.]*$", "")).otherwise("")


def _leaf(line: tuple[str, str, str], p: Column, v: Column) -> Column:
    path, kind, flags = line
    return F.struct(p.alias("path"), F.lit(path).alias("template"), F.lit(kind).alias("kind"), F.lit(flags).alias("flags"), v.cast("string").alias("value"))


def expand(data: Column, line: tuple[str, str, str]) -> Column:
    """array<LEAF>: one element for a plain leaf, one for each list element of a [] template; none for an absent list."""
    path = line[0]
    if "[]" not in path:
        return F.array(_leaf(line, F.lit(path), get(data, path)))
    head, tail = path.split("[].")
    rows = F.transform(get(data, head), lambda e, i: _leaf(line, F.concat(F.lit(head + "."), i, F.lit("." + tail)), get(e, tail)))
    return F.coalesce(rows, F.array().cast(f"array<{LEAF}>"))


def leaves(data: Column, lines: list[tuple[str, str, str]]) -> Column:
    """All leaves of a payload, null ones too; plain ones in a row are one array, since each array of a concat costs time."""
    out: list[Column] = []
    for listed, some in groupby(lines, lambda line: "[]" in line[0]):
        out += [expand(data, line) for line in some] if listed else [F.array(*(_leaf(line, F.lit(line[0]), get(data, line[0])) for line in some))]
    return F.concat(*out)


def flatten(rows: DataFrame, lines: list[tuple[str, str, str]], keep_null: bool = False) -> DataFrame:
    """rows (doc_id, data) as (doc_id, path, template, kind, flags, value)."""
    out = rows.select("doc_id", F.inline_outer(leaves(F.col("data"), lines))).where("path is not null")
    return out if keep_null else out.where("value is not null")


def flatten_json(rows: DataFrame, max_depth: int = 8) -> DataFrame:
    """rows (doc_id, json) of any shape as (doc_id, path, value): a level of objects and lists at a time.

    A JSON null is a row with a null value; empty objects and lists give none. What lies deeper than
    max_depth stays JSON text.
    """
    level = rows.select("doc_id", F.lit("").alias("path"), F.col("json").alias("value"))
    done = None
    key = lambda k: F.when(F.col("path") == "", k).otherwise(F.concat_ws(".", "path", k))
    for _ in range(max_depth):
        t = F.trim("value")
        inner = level.where(t.startswith("{") | t.startswith("["))
        flat = level.where(~F.coalesce(t.startswith("{") | t.startswith("["), F.lit(False)))
        done = flat if done is None else done.unionByName(flat)
        entry = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
        objects = F.transform(F.map_entries(F.from_json("value", "map<string,string>")), lambda e: entry(e["key"], e["value"]))
        lists = F.transform(F.from_json("value", "array<string>"), lambda v, i: entry(i.cast("string"), v))
        # one branch a level: a branch for objects and one for lists would double with each
        entries = F.when(F.trim("value").startswith("{"), objects).otherwise(lists)
        level = inner.select("doc_id", "path", F.inline_outer(entries)).where("k is not null").select("doc_id", key(F.col("k")).alias("path"), F.col("v").alias("value"))
    return done.unionByName(level)


def for_export(data: Column, lines: list[tuple[str, str, str]]) -> list[Column]:
    """Dotted columns; lists as JSON text, an empty or absent list as an empty string."""
    out, seen = [], set()
    for path, _, _ in lines:
        head = path.split("[]")[0]
        if head in seen:
            continue
        seen.add(head)
        value = get(data, head)
        out.append((F.when(F.size(value) > 0, F.to_json(value)).otherwise("") if "[]" in path else value).alias(head))
    return out


def unknown_keys(json: Column, known: list[str]) -> Column:
    """Top-level keys that a type does not have."""
    return F.array_except(F.json_object_keys(json), F.array(*(F.lit(k) for k in known)))


def to_plain_json(value: Column, kind: T.DataType) -> Column:
    """JSON in which decimals, dates and times are strings, as their plain text."""

    def plain(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            return F.when(c.isNotNull(), F.struct(*(plain(c[f.name], f.dataType).alias(f.name) for f in t.fields)))
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: plain(x, t.elementType))
        return c.cast("string") if isinstance(t, (T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)) else c

    return F.to_json(plain(value, kind), {"ignoreNullFields": "false"})
