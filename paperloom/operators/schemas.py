"""Schemas as rows: JSON Schemas made fit for a model provider, tenants' own types, and types that a tenant changes field by field.

A JSON Schema becomes a row for each keyword of each schema inside it. What a provider accepts is then a matter of filters, of one
aggregate for each schema, and of a few columns; the result is put together again from the innermost schemas outwards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.plans import specs
from paperloom.session import spread
from paperloom.sources import storage

#: Keywords that providers do not take, and the string formats that they do.
DROPPED = [
    "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "minItems", "maxItems", "uniqueItems", "contains", "minContains", "maxContains", "minProperties", "maxProperties",
    "patternProperties", "propertyNames", "dependentRequired", "dependentSchemas", "if", "then", "else", "not", "unevaluatedProperties", "unevaluatedItems", "prefixItems", "default", "examples", "deprecated", "readOnly", "writeOnly",
]
FORMATS = ["date-time", "time", "date", "duration", "email", "hostname", "uri", "ipv4", "ipv6", "uuid"]
#: Keywords that hold schemas: under names, in a list, one alone.
NAMED, LISTED, ALONE = ["properties", "$defs", "definitions"], ["anyOf", "allOf", "oneOf"], ["items"]
DEEPEST, NULL = 12, '{"type":"null"}'


def _entries(rows: DataFrame, value: str, keep: list[str], key: str, out: str, empty: bool = False) -> DataFrame:
    """A row for each member of a JSON object or list (a variant column); with `empty`, one without a key for those that hold nothing."""
    tvf = rows.sparkSession.tvf
    each = (tvf.variant_explode_outer if empty else tvf.variant_explode)(F.col(value).outer()).select(F.col("pos"), F.col("key"), F.col("value").alias("__v"))
    joined = rows.lateralJoin(each)
    return joined.select(*keep, F.coalesce("key", F.col("pos").cast("string")).alias(key), F.col("__v").alias(out))


def keywords(schemas: DataFrame) -> DataFrame:
    """schemas (schema_id, json) -> (schema_id, depth, node, parent, slot, name, keyword, value): the keywords of every schema inside.

    node is an address; slot is the parent's keyword that holds it and name its place there. value is JSON; where it holds schemas it is null. An
    empty schema has one row, without a keyword. Schemas that nest deeper than DEEPEST are refused.
    """
    holds = [*NAMED, *LISTED, *ALONE]
    at = ["schema_id", "node", "parent", "slot", "name"]
    level = spread(schemas.select("schema_id", "json")).select("schema_id", F.lit("#").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("slot"), F.lit(None).cast("string").alias("name"), F.parse_json("json").alias("v"))
    out = []
    for depth in range(DEEPEST):
        if level.isEmpty():
            break
        words = _entries(level, "v", at, "keyword", "value", empty=True).withColumn("depth", F.lit(depth))
        inner = F.col("keyword").isin(*holds) & F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)") & ~F.schema_of_variant("value").isin("OBJECT<>", "ARRAY<VOID>")
        words = storage.written(words.select("*", F.coalesce(inner, F.lit(False)).alias("inner"), F.to_json("value").alias("text")).drop("value"), f"keywords-{depth}")
        out.append(words.select(*at, "depth", "keyword", F.when(~F.col("inner"), F.col("text")).alias("value")))
        held = words.where("inner").select("schema_id", F.col("node").alias("parent"), F.col("keyword").alias("slot"), F.parse_json("text").alias("v"))
        alone = F.col("slot").isin(*ALONE) & F.schema_of_variant("v").startswith("OBJECT")
        many = _entries(held.where(~alone), "v", ["schema_id", "parent", "slot"], "name", "v")
        both = held.where(alone).withColumn("name", F.lit(None).cast("string")).select("schema_id", "parent", "slot", "name", "v").unionByName(many.select("schema_id", "parent", "slot", "name", "v"))
        level = both.where(F.schema_of_variant("v").startswith("OBJECT")).select("schema_id", F.concat_ws("/", "parent", "slot", "name").alias("node"), "parent", "slot", "name", "v")
    else:
        if not level.isEmpty():
            raise ValueError(f"schemas nest deeper than {DEEPEST}")
    kept = "schema_id", "node", "parent", "slot", "name", "depth", "keyword", "value"
    return reduce(DataFrame.unionByName, out) if out else schemas.select("schema_id", *(F.lit(None).cast("int" if c == "depth" else "string").alias(c) for c in kept[1:])).limit(0)


def _said(json: Column) -> Column:
    """The text of a JSON string."""
    return F.from_json(F.concat(F.lit('{"a":'), json, F.lit("}")), "a string")["a"]


def _quoted(x: Column) -> Column:
    return F.regexp_replace(F.to_json(F.struct(x.alias("a"))), r'^\{"a":(.*)\}$', "$1")


def for_provider(words: DataFrame, strict: bool = False, nullable: bool = False, private: str = "x-field") -> DataFrame:
    """keywords() -> the same rows as a provider takes them.

    Unknown keywords, titles and unknown formats go. A hint of the private keyword joins the description; without either its label stands
    in, unless it only repeats the title. Objects are closed; with `strict` they require all their properties. With `nullable` each property
    may be null, so that nothing need be made up.
    """
    fixed = ["description", "type", "$ref", "title", "additionalProperties", private, *DROPPED]
    stays = ~F.col("keyword").isin(*fixed) & ((F.col("keyword") != "format") | _said(F.col("value")).isin(*FORMATS))
    has = lambda k: F.max(F.when(F.col("keyword") == k, F.col("value")))
    # a schema meets its own keywords and what it has to know of those below it in one shuffle
    own_rows = words.select("schema_id", "node", F.struct("depth", "parent", "slot", "name").alias("at"), "keyword", "value", *(F.lit(None).cast(t).alias(c) for c, t in (("property", "string"), ("choice", "int"), ("may", "boolean"))))
    choice = F.when(F.col("slot") == "anyOf", F.col("name").cast("int"))
    below = words.where(F.col("slot").isin("properties", "anyOf")).select(
        "schema_id", F.col("parent").alias("node"), F.lit(None).cast(own_rows.schema["at"].dataType).alias("at"), F.lit(None).cast("string").alias("keyword"), F.lit(None).cast("string").alias("value"),
        F.when(F.col("slot") == "properties", F.col("name")).alias("property"), choice.alias("choice"), ((F.col("slot") == "anyOf") & (F.col("keyword") == "type") & (F.col("value") == '"null"')).alias("may"),
    )
    each = own_rows.unionByName(below).groupBy("schema_id", "node").agg(
        F.max("at").alias("at"), *(has(k).alias(a) for k, a in (("description", "description"), ("title", "title"), ("type", "type"), ("$ref", "ref"), (private, "own"))), F.max((F.col("keyword") == "properties").cast("int")).alias("props"), F.max((F.col("keyword") == "anyOf").cast("int")).alias("any"),
        F.array_sort(F.collect_set("property")).alias("properties"), F.max("choice").alias("last"), F.coalesce(F.max("may"), F.lit(False)).alias("may"), F.collect_list(F.when(stays, F.struct("keyword", "value"))).alias("plain"),
    ).where("at is not null").select("*", "at.*")
    # the description
    own = F.from_json("own", "hint string, label string")
    notes = F.array_distinct(F.filter(F.array(_said(F.col("description")), own["hint"]), lambda x: x != ""))
    label = F.when(F.lower(own["label"]) != F.lower(F.coalesce(_said(F.col("title")), F.lit(""))), own["label"])
    note = F.when(F.size(notes) > 0, F.array_join(notes, " — ")).otherwise(label)
    described = F.when(F.col("own").isNotNull() & note.isNotNull(), _quoted(note)).otherwise(F.col("description"))
    kinds = F.when(F.col("type").startswith("["), F.from_json("type", "array<string>")).when(F.col("type").isNotNull(), F.array(_said(F.col("type"))))
    closed = F.coalesce(F.array_contains(kinds, "object"), F.lit(False)) | ((F.col("props") == 1) & F.col("ref").isNull())
    required = F.when(closed & F.lit(strict) & (F.col("props") == 1), F.to_json(F.coalesce("properties", F.array().cast("array<string>"))))
    # null where it is not yet allowed
    free = F.lit(nullable) & (F.col("slot") == "properties")
    wide = F.when(F.array_contains(kinds, "null"), F.col("type")).otherwise(F.to_json(F.array_append(kinds, F.lit("null"))))
    kind = F.when(free & (F.col("any") == 0) & F.col("type").isNotNull(), wide).otherwise(F.col("type"))
    lone = free & (F.col("any") == 0) & F.col("type").isNull() & F.col("ref").isNotNull()
    put = lambda k, v: F.struct(F.lit(k).alias("keyword"), v.alias("value"))
    made = F.array(
        put("description", described), put("type", kind), put("additionalProperties", F.when(closed, "false")), put("required", required),
        put("$ref", F.when(~lone, F.col("ref"))), put("anyOf", F.when(lone, F.concat(F.lit('[{"$ref":'), "ref", F.lit("}," + NULL + "]")))),
    )
    plain = F.col("plain")
    if strict:
        plain = F.filter(plain, lambda x: (x["keyword"] != "required") | ~F.coalesce(closed & (F.col("props") == 1), F.lit(False)))
    bare = F.array(F.struct(F.lit(None).cast("string").alias("keyword"), F.lit(None).cast("string").alias("value")))  # a schema that loses all is still one
    row = lambda depth, node, parent, slot, name, keyword, value: F.struct(*(c.alias(a) for c, a in ((depth, "depth"), (node, "node"), (parent, "parent"), (slot, "slot"), (name, "name"), (keyword, "keyword"), (value, "value"))))
    mine = F.transform(F.concat(bare, plain, F.filter(made, lambda x: x["value"].isNotNull())), lambda x: row(*(F.col(c) for c in ("depth", "node", "parent", "slot", "name")), x["keyword"], x["value"]))
    choice = (F.coalesce("last", F.lit(-1)) + 1).cast("string")
    null = F.array(row(F.col("depth") + 1, F.concat_ws("/", "node", F.lit("anyOf"), F.lit("null")), F.col("node"), F.lit("anyOf"), choice, F.lit("type"), F.lit('"null"')))
    rows = F.when(free & (F.col("any") == 1) & ~F.col("may"), F.concat(mine, null)).otherwise(mine)
    return each.select("schema_id", rows.alias("rows")).select("schema_id", F.inline_outer("rows"))


def assembled(words: DataFrame) -> DataFrame:
    """Keyword rows -> (schema_id, json), names in order; an empty schema inside is `{}`."""
    rows = storage.written(words, "words")
    deepest = rows.agg(F.max("depth")).first()[0]
    made: DataFrame | None = None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        here = rows.where(F.col("depth") == depth)
        part = F.when(F.col("value").isNotNull(), F.struct("keyword", F.concat(_quoted(F.col("keyword")), F.lit(":"), "value").alias("part")))
        own = here.select("schema_id", "node", F.struct("parent", "slot", "name").alias("at"), part.alias("own"))
        if made is None:
            both = own.withColumn("member", F.lit(None).cast("struct<keyword:string,named:boolean,alone:boolean,i:int,n:string,m:string>"))
        else:
            named, alone = F.col("slot").isin(*NAMED), F.col("slot").isin(*ALONE) & F.col("name").isNull()
            member = F.struct(F.col("slot").alias("keyword"), named.alias("named"), alone.alias("alone"), F.when(~named, F.col("name").cast("int")).alias("i"), F.when(named, F.col("name")).alias("n"), F.when(named, F.concat(_quoted(F.col("name")), F.lit(":"), "json")).otherwise(F.col("json")).alias("m"))
            both = own.unionByName(made.select("schema_id", F.col("parent").alias("node"), member.alias("member")), allowMissingColumns=True)
        each = both.groupBy("schema_id", "node").agg(F.max("at").alias("at"), F.collect_list("own").alias("own"), F.sort_array(F.collect_list("member")).alias("members")).where("at is not null")

        def whole(kind):  # noqa: ANN001, ANN202
            """What a keyword holds: kind is the keyword with how its members are written."""
            inside = F.array_join(F.transform(F.filter("members", lambda m: (m["keyword"] == kind["keyword"]) & (m["alone"] == kind["alone"])), lambda m: m["m"]), ",")
            json = F.when(kind["alone"], inside).when(kind["named"], F.concat(F.lit("{"), inside, F.lit("}"))).otherwise(F.concat(F.lit("["), inside, F.lit("]")))
            return F.struct(kind["keyword"].alias("keyword"), F.concat(_quoted(kind["keyword"]), F.lit(":"), json).alias("part"))

        kinds = F.array_distinct(F.transform("members", lambda m: F.struct(m["keyword"].alias("keyword"), m["named"].alias("named"), m["alone"].alias("alone"))))
        parts = F.sort_array(F.concat("own", F.transform(kinds, whole)))
        made = each.select("schema_id", "node", "at.*", F.concat(F.lit("{"), F.array_join(F.transform(parts, lambda x: x["part"]), ","), F.lit("}")).alias("json"))
    return made.select("schema_id", "json") if made is not None else rows.select("schema_id", F.col("value").alias("json")).limit(0)


def outline(words: DataFrame) -> DataFrame:
    """Keyword rows -> (schema_id, path, kind, required, description) of the properties, for the request that asks for a repair: the first kind that is
    not null, items of a list under []. References are not followed."""
    has = lambda k: F.max(F.when(F.col("keyword") == k, F.col("value")))
    each = words.groupBy("schema_id", "node", "parent", "slot", "name").agg(has("type").alias("type"), has("description").alias("description"), has("required").alias("required"))
    above = each.select("schema_id", F.col("node").alias("parent"), F.from_json("required", "array<string>").alias("must"))
    kinds = F.when(F.col("type").startswith("["), F.from_json("type", "array<string>")).otherwise(F.array(_said(F.col("type"))))
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("node", r"^#/properties/", ""), "/items(?=/|$)", "[]"), r"/properties/", ".")
    rows = each.where("slot = 'properties' and node like '#/properties/%'").join(above, ["schema_id", "parent"], "left")
    kind = F.coalesce(F.get(F.filter(kinds, lambda k: k != "null"), F.lit(0)), F.lit("any"))
    return rows.select("schema_id", path.alias("path"), kind.alias("kind"), F.coalesce(F.array_contains("must", F.col("name")), F.lit(False)).alias("required"), _said(F.col("description")).alias("description"))


# --- types of tenants -----------------------------------------------------------------------------------------------


def own_types(declared: DataFrame) -> DataFrame:
    """declared (tenant, place, name, kind, required, critical) -> (tenant, path, kind, flags, error): the fields of each sound type, or one row with
    what is wrong with it first: how many fields, then each field in its place."""
    ok_name = F.coalesce(F.col("name").rlike(r"\A[a-z][a-z0-9_]{0,63}\z"), F.lit(False))
    wrong = F.when(~ok_name | ~F.coalesce(F.col("kind").isin(*specs.OWN_KINDS), F.lit(False)), "bad field").when(F.col("place") > F.col("first"), "repeated field")
    first = declared.groupBy("tenant", "name").agg(F.min("place").alias("first")).select(F.col("tenant").alias("t"), F.col("name").alias("n"), "first")
    rows = declared.join(first, F.col("tenant").eqNullSafe(F.col("t")) & F.col("name").eqNullSafe(F.col("n"))).drop("t", "n").withColumn("wrong", wrong)
    verdict = rows.groupBy("tenant").agg(F.count("*").alias("fields"), F.min(F.when(F.col("wrong").isNotNull(), F.struct("place", "wrong"))).alias("worst"))
    error = F.when(F.col("fields") > specs.OWN_FIELDS, "too many fields").otherwise(F.col("worst.wrong"))
    judged = verdict.select(F.col("tenant").alias("t"), error.alias("error"))
    flags = F.concat(*(F.when(c, f).otherwise("") for c, f in ((F.col("required"), "R"), (F.col("critical"), "C"), (F.col("kind") == "boolean", "N"))))
    good = rows.join(judged.where("error is null"), F.col("tenant").eqNullSafe(F.col("t"))).select("tenant", F.col("name").alias("path"), "kind", flags.alias("flags"), "error")
    none = F.lit(None).cast("string")
    return good.unionByName(judged.where("error is not null").select(F.col("t").alias("tenant"), none.alias("path"), none.alias("kind"), none.alias("flags"), "error"))


FIELD = "struct<kind:string,required:boolean,critical:boolean,groundable:boolean>"


def built_in() -> Column:
    """map<type, map<path, FIELD>> of the built-in types."""
    one = lambda f: F.struct(F.lit(f.kind).alias("kind"), F.lit(f.required).alias("required"), F.lit(f.critical).alias("critical"), F.lit(f.groundable).alias("groundable"))
    return F.create_map(*(x for k, rows in specs.FIELDS.items() for x in (F.lit(k), F.create_map(*(y for f in specs.typed(rows) for y in (F.lit(f.path), one(f)))))))


def resolved(wanted: Column, overlay: Column, hidden: Column, known: Column | None = None) -> Column:
    """struct(document_type, fields): a tenant's view of a type.

    overlay is a map<path, FIELD> of what the tenant says, over the built-in type field by field: members that are null stay as they were, new
    paths are added (a member that is not said is false, groundable true, and the kind string). hidden paths go, and with them what lies below
    them. A type that is not built in and for which nothing is said is generic.
    """
    base = F.element_at(known if known is not None else built_in(), wanted)
    said = F.coalesce(overlay, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{FIELD}>")))
    generic = base.isNull() & (F.cardinality(said) == 0)
    start = F.coalesce(base, F.when(generic, F.element_at(known if known is not None else built_in(), F.lit("generic"))), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{FIELD}>")))

    def merged(p: Column, b: Column, o: Column) -> Column:
        pick = lambda m, default: F.coalesce(o[m], b[m], F.lit(default)).alias(m)
        return F.struct(pick("kind", "string"), pick("required", False), pick("critical", False), pick("groundable", True))

    both = F.map_zip_with(start, said, merged)
    gone = F.coalesce(hidden, F.array().cast("array<string>"))
    seen = F.map_filter(both, lambda p, v: ~F.exists(gone, lambda h: (p == h) | p.startswith(F.concat(h, F.lit("."))) | p.startswith(F.concat(h, F.lit("[]")))))
    return F.struct(F.when(generic, "generic").otherwise(wanted).alias("document_type"), seen.alias("fields"))
