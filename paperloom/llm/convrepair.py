"""Conversation structure repair as a scan of min-plus matrices.

A conversation is sound if its roles spell `(s?(ua)+)?`: empty, or an optional system row and then pairs of user and
assistant. A state says what has been written so far: nothing, a system row, or something that ends with a user or with
an assistant. Each row is a 4x4 matrix of (cost, audit) elements over these states: keeping costs KEEP, another role
REROLE, deleting DELETE, and TRUNCATED more where the row stays but ends without `.!?`; before each row stands the closure
of inserts, at INSERT apiece. Elements add up by cost and by concatenating audits (K, R, D, I); of two the cheaper stays,
then the one that is less in ASCII. Two audits of one stretch and one cost are never prefixes of one another (what follows
the shorter would cost more), so the order survives concatenation, and products may be taken in any grouping.

Rows are sorted into ranges of (conversation, turn, role, SHA-256 of text): a long conversation lies in many partitions. Each task
multiplies its rows in blocks of at most BLOCK; blocks of conversations that do not lie whole in one block are multiplied in a tree
of fan-in FAN; then the states between children go down the same tree, and each block reads its own part of the cheapest audit.
Only digests take part in all this; texts move once, to meet their edits.

Rows are ordered by turn, nulls first; rows of one turn by role and SHA-256 of their text, so alike rows are neighbours. A row is
a duplicate if its conversation has its role and text before it. Rows alike in all of these are one record with a count until they are edited.
Null roles and texts count as one space, texts of any length are read whole, a null conv_id is a conversation, an empty
table gives no rows, and columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, small
from .textvec import tidy

BLOCK, FAN = 512, 64
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NONE, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEW = {USER: "user", ASSISTANT: "assistant"}
SPACE = " \t\n\x0b\x0c\r"
_SOUND = {"su", "ua", "au"}

Element = tuple[int, str] | None
Matrix = list[list[Element]]


def _then(state: int, initial: str) -> int | None:
    """The state after a row of this initial, if one may stand here."""
    if initial == "s":
        return SYSTEM if state == NONE else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def _least(x: Element, y: Element) -> Element:
    return y if x is None else x if y is None else min(x, y)


def _closure() -> Matrix:
    """Any number of inserts; more than two never pay."""
    out: Matrix = [[None] * 4 for _ in STATES]
    for s in STATES:
        out[s][s] = (0, "")
        at = USER if s != USER else ASSISTANT
        out[s][at] = _least(out[s][at], (INSERT, "I"))
        if at == USER:
            out[s][ASSISTANT] = _least(out[s][ASSISTANT], (2 * INSERT, "II"))
    return out


def times(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = [[None] * 4 for _ in STATES]
    for s in STATES:
        for m in STATES:
            if a[s][m] is not None:
                for e in STATES:
                    if b[m][e] is not None:
                        out[s][e] = _least(out[s][e], (a[s][m][0] + b[m][e][0], a[s][m][1] + b[m][e][1]))
    return out


CLOSURE = _closure()
#: What ends a conversation from each state: nothing, or the inserts that make it sound.
TAIL = [_least(CLOSURE[s][NONE], CLOSURE[s][ASSISTANT]) for s in STATES]
SOUND, BLANK, DUPLICATE, CUT = range(4)


def _row(initial: str, fault: int) -> Matrix:
    """Closure of inserts, then one row."""
    step: Matrix = [[None] * 4 for _ in STATES]
    for s in STATES:
        step[s][s] = (DELETE, "D")
        if fault in (BLANK, DUPLICATE):
            continue
        more = TRUNCATED if fault == CUT else 0
        if (to := _then(s, initial)) is not None:
            step[s][to] = _least(step[s][to], (more, "K"))
        to = ASSISTANT if s == USER else USER
        step[s][to] = _least(step[s][to], (REROLE + more, "R"))
    return times(CLOSURE, step)


#: Per row kind, for each end state: (state before, cost, audit).
_ROWS = {(c, f): [[(s, *m[s][e]) for s in STATES if m[s][e] is not None] for e in STATES] for c in ("s", "u", "a", "") for f in (SOUND, BLANK, DUPLICATE, CUT) for m in [_row(c, f)]}


def _step(v: list[Element], kind: list[list[tuple[int, int, str]]]) -> list[Element]:
    """Row vector times the matrix of a row; audits are joined only for the cheapest."""
    out: list[Element] = []
    for into in kind:
        least, audit = -1, ""
        for s, cost, text in into:
            if v[s] is not None:
                total = v[s][0] + cost
                if least < 0 or total < least:
                    least, audit = total, v[s][1] + text
                elif total == least:
                    audit = min(audit, v[s][1] + text)
        out.append(None if least < 0 else (least, audit))
    return out


# --- blocks ---------------------------------------------------------------------------------------------------------

_NODE = "conv_id long, node long, costs array<long>, audits array<string>, first string, last string, illegal long, blank long, duplicate long, truncated long"
_BLOCK = f"{_NODE}, sole boolean, turns array<long>, roles array<string>, digests array<binary>"
_LEVEL = f"{_NODE}, children array<long>, paths array<string>"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    kind = lambda t: pa.list_(kinds[t[6:-1]]) if t.startswith("array<") else kinds[t]
    return pa.schema([(name, kind(t)) for name, t in (f.split() for f in ddl.split(", "))])


class _Block:
    """Rows of one conversation that follow one another, as the product of their matrices."""

    def __init__(self, conv: int | None, fresh: bool) -> None:
        self.conv, self.fresh = conv, fresh
        self.vectors = {s: [(0, "") if e == s else None for e in STATES] for s in ((NONE,) if fresh else STATES)}
        self.keys: list[tuple[int | None, str, bytes]] = []
        self.initials: list[str] = []
        self.faults = [0, 0, 0, 0]

    def add(self, turn: int | None, role: str, digest: bytes, fault: int) -> None:
        initial = role[:1]
        kind = _ROWS[initial if initial in ("s", "u", "a") else "", fault]
        for s, v in self.vectors.items():
            self.vectors[s] = _step(v, kind)
        self.keys.append((turn, role, digest))
        self.initials.append(initial)
        self.faults[fault] += 1

    def row(self, node: int, sole: bool) -> dict:
        flat = [self.vectors[s][e] if s in self.vectors else None for s in STATES for e in STATES]
        return {
            "conv_id": self.conv, "node": node, "costs": [x and x[0] for x in flat], "audits": [x and x[1] for x in flat], "first": self.initials[0], "last": self.initials[-1],
            "illegal": sum(a + b not in _SOUND for a, b in pairwise(self.initials)), "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[CUT], "sole": sole,
            "turns": [k[0] for k in self.keys], "roles": [k[1] for k in self.keys], "digests": [k[2] for k in self.keys],
        }


def _blocks(size: int):  # noqa: ANN202
    schema = _arrow(_BLOCK)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted records -> blocks. The first block of a task may go on from the task before, and the last into the next."""
        task, made, out, now = TaskContext.get().partitionId() << 24, 0, [], None
        for batch in batches:
            for conv, turn, role, digest, fault, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for nth in range(n):
                    changed = now is not None and now.conv != conv
                    if now is not None and (changed or len(now.keys) == size):
                        out.append(now.row(task + made, changed and now.fresh))
                        made += 1
                    if now is None or changed or len(now.keys) == size:
                        now = _Block(conv, changed)
                    now.add(turn, role, digest, fault if nth == 0 or fault == BLANK else DUPLICATE)
                    if len(out) == 256:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
        if now is not None:
            out.append(now.row(task + made, False))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def records(rows: DataFrame) -> DataFrame:
    """Rows -> (conv_id, turn, role, digest, fault, n): alike rows as one, with the fault of the first of them."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    bare = F.rtrim(text, F.lit(SPACE))
    own = F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(CUT)
    each = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.unhex(F.sha2(text, 256)).alias("digest"), own.alias("own"))
    alike = save(each.groupBy("conv_id", "turn", "role", "digest", "own").agg(F.count("*").alias("n")), "records")
    when = F.struct(F.col("turn").isNotNull(), "turn")
    seen = alike.where(F.col("own") != BLANK).groupBy("conv_id", "role", "digest").agg(F.min(when).alias("since"), F.count("*").alias("times")).where("times > 1")
    seen = save(seen.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "since"), "seen")
    again = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    fault = F.when(F.col("own") == BLANK, BLANK).when(F.col("since") < when, DUPLICATE).otherwise(F.col("own"))
    return alike.join(small(seen, seen.count()), again, "left").select("conv_id", "turn", "role", "digest", fault.alias("fault"), "n")


# --- tree -----------------------------------------------------------------------------------------------------------


def _product(nodes: pa.Table) -> pa.Table:
    """Nodes of one group, multiplied in order; paths are the states between them, a digit each."""
    rows = sorted(nodes.to_pylist(), key=lambda r: r["node"])
    best: list[list[tuple[int, str, str] | None]] = [[(0, "", str(s)) if s == e else None for e in STATES] for s in STATES]
    for r in rows:
        after: list[list[tuple[int, str, str] | None]] = [[None] * 4 for _ in STATES]
        for s in STATES:
            for m in STATES:
                if (x := best[s][m]) is None:
                    continue
                for e in STATES:
                    cost = r["costs"][4 * m + e]
                    if cost is None or ((y := after[s][e]) is not None and y[0] < x[0] + cost):
                        continue
                    z = (x[0] + cost, x[1] + r["audits"][4 * m + e], x[2] + str(e))
                    after[s][e] = z if y is None else min(y, z)
        best = after
    flat = [x for line in best for x in line]
    whole = {
        "conv_id": rows[0]["conv_id"], "node": rows[0]["group"], "costs": [x and x[0] for x in flat], "audits": [x and x[1] for x in flat], "first": rows[0]["first"], "last": rows[-1]["last"],
        "illegal": sum(r["illegal"] for r in rows) + sum(a["last"] + b["first"] not in _SOUND for a, b in pairwise(rows)),
        **{k: sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated")}, "children": [r["node"] for r in rows], "paths": [x and x[2] for x in flat],
    }
    return pa.Table.from_pylist([whole], _arrow(_LEVEL))


def _best(start: int | Column = NONE) -> Column:
    """(cost, audit, end) of the cheapest way from a state to the end of the conversation."""
    at = lambda e: F.col("costs")[start * 4 + e]
    ways = (F.when(at(e).isNotNull(), F.struct((at(e) + TAIL[e][0]).alias("cost"), F.concat(F.col("audits")[start * 4 + e], F.lit(TAIL[e][1])).alias("audit"), F.lit(e).alias("end"))) for e in STATES)
    return F.array_min(F.array_compact(F.array(*ways)))


_COUNTS = ("illegal", "blank", "duplicate", "truncated")


@dataclass
class Audit:
    """conversations: conv_id, cost, audit and the counts of faults; edits: what happens to each row (see `repaired`)."""

    conversations: DataFrame
    edits: DataFrame


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their start state and audit -> one row for each edited row: inserts before and after it, its edit, its new role."""
    schema = _arrow(_EDIT)
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            state, k, before = r["start"], 0, ""
            for i, c in enumerate(r["audit"]):
                if c == "I":
                    state = ASSISTANT if state == USER else USER
                    before += "ua"[state == ASSISTANT]
                    continue
                role, to = r["roles"][k], None
                if c == "K":
                    state = _then(state, role[:1])
                elif c == "R":
                    state = ASSISTANT if state == USER else USER
                    to = NEW[state]
                rest = r["audit"][i + 1 :] if k + 1 == len(r["roles"]) else ""
                after = "".join("ua"[(state == USER) ^ (j % 2)] for j in range(len(rest)))
                out.append({"conv_id": r["conv_id"], "turn": r["turns"][k], "role": role, "digest": r["digests"][k], "node": r["node"], "k": k, "edit": c, "to": to, "before": before, "after": after})
                before, k = "", k + 1
                if rest:
                    break
            if len(out) > 2000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)


_EDIT = "conv_id long, turn long, role string, digest binary, node long, k long, edit string, to string, before string, after string"


def audit(rows: DataFrame, block: int = BLOCK, fan: int = FAN) -> Audit:
    """The cheapest edits of every conversation in rows (conv_id, turn, role, text)."""
    by = ["conv_id", "turn", "role", "digest"]
    found = save(records(rows).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_blocks(block), _BLOCK), "blocks")
    level = found.where("not sole").select(*(f.name for f in found.schema.fields if f.name in _NODE))
    levels: list[DataFrame] = []
    roots: list[DataFrame] = []
    depth = 0
    while not level.isEmpty():
        wide = save(level.groupBy("conv_id").count().where(F.col("count") > fan).select(F.col("conv_id").alias("c"), F.lit(True).alias("wide")), "wide")
        left = wide.count()
        grouped = level.join(small(wide, left), F.col("conv_id").eqNullSafe(F.col("c")), "left")
        grouped = grouped.withColumn("group", F.when(F.col("wide"), F.floor(F.col("node") / fan)).otherwise(F.lit(-1)).cast("long")).drop("c", "wide")
        levels.append(save(grouped.groupBy("conv_id", "group").applyInArrow(_product, _LEVEL), f"level-{depth}"))
        roots.append(levels[-1].where("node = -1"))
        level, depth = levels[-1].where("node <> -1").drop("children", "paths"), depth + 1
        if not left:
            break
    sole = found.where("sole").withColumn("best", _best())
    whole = [sole.select("conv_id", "best.cost", "best.audit", *_COUNTS)]
    want = None  # nodes with the states between which they lie
    for nodes, root in zip(reversed(levels), reversed(roots), strict=True):
        top = root.withColumn("best", _best())
        whole.append(top.select("conv_id", "best.cost", "best.audit", *_COUNTS))
        mine = top.select("conv_id", "node", F.lit(NONE).cast("int").alias("start"), F.col("best.end").cast("int").alias("end")).withColumn("tail", F.element_at(F.array(*(F.lit(t[1]) for t in TAIL)), F.col("end") + 1))
        mine = mine if want is None else mine.unionByName(want)
        ways = mine.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "start", "end", "tail").join(nodes.select("conv_id", "node", "children", "paths"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")))
        steps = ways.select("conv_id", F.col("paths")[F.col("start") * 4 + F.col("end")].alias("path"), "tail", F.size("children").alias("of"), F.posexplode("children").alias("i", "node"))
        digit = lambda i: F.substring("path", i, 1).cast("int")
        want = save(steps.select("conv_id", "node", digit(F.col("i") + 1).alias("start"), digit(F.col("i") + 2).alias("end"), F.when(F.col("i") + 1 == F.col("of"), F.col("tail")).otherwise("").alias("tail")), "states")
    keys = ("conv_id", "node", "turns", "roles", "digests")
    ready = sole.select(*keys, F.lit(NONE).alias("start"), F.col("best.audit").alias("audit"))
    if want is not None:
        ends = want.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "start", "end", "tail")
        parts = found.where("not sole").join(small(ends, ends.count()), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")))
        ready = ready.unionByName(parts.select(*keys, "start", F.concat(F.col("audits")[F.col("start") * 4 + F.col("end")], F.col("tail")).alias("audit")))
    conversations = whole[0]
    for w in whole[1:]:
        conversations = conversations.unionByName(w)
    return Audit(conversations, ready.mapInArrow(tidy(_edited), _EDIT))


# --- texts ----------------------------------------------------------------------------------------------------------

_REPAIRED = "conv_id long, turn long, node long, k long, j long, edit string, role string, text string"


@tidy
def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted texts and edits, each record's text before its edits -> rows as they are after repair."""
    schema, out, held, key, text = _arrow(_REPAIRED), [], 0, None, None
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        texts = columns.pop("text")
        for i, r in enumerate(zip(*(columns[c].to_pylist() for c in ("conv_id", "turn", "role", "digest", "node", "k", "edit", "to", "before", "after")), strict=True)):
            conv, turn, role, digest, node, k, edit, to, before, after = r
            if edit is None:
                key, text = r[:4], texts[i].as_py()
                continue
            put = [("I", NEW[USER if c == "u" else ASSISTANT], "") for c in before]
            if edit != "D":
                assert key == r[:4], "an edit without its text"
                put.append((edit, to or role, text))
                held += len(text)
            put += [("I", NEW[USER if c == "u" else ASSISTANT], "") for c in after]
            out += [{"conv_id": conv, "turn": turn, "node": node, "k": k, "j": j, "edit": e, "role": x, "text": t} for j, (e, x, t) in enumerate(put)]
            if held > 1 << 20 or len(out) > 2000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, held = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def repaired(rows: DataFrame, edits: DataFrame, whole: bool = False) -> DataFrame:
    """(conv_id, turn, node, k, j, edit, role, text): rows after repair; (node, k, j) is their order in a conversation.

    Texts meet their edits in ranges of (conversation, turn, role, digest), so that a long conversation is edited in many tasks. With
    `whole`, each conversation lies in one partition, in order, for what has to read it from start to end; it is streamed, never held.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    edit = [f.split()[0] for f in _EDIT.split(", ")]
    mine = {"conv_id": F.col("conv_id").cast("long"), "turn": F.col("turn").cast("long"), "role": F.coalesce(F.col("role").cast("string"), F.lit(" ")), "digest": F.unhex(F.sha2(text, 256))}
    kinds = {f.split()[0]: f.split()[1] for f in _EDIT.split(", ")}
    texts = rows.where(F.rtrim(text, F.lit(SPACE)) != "").select(*((mine[c] if c in mine else F.lit(None).cast(kinds[c])).alias(c) for c in edit), text.alias("text"))
    both = texts.unionByName(edits.withColumn("text", F.lit(None).cast("string")))
    by = ["conv_id", "turn", "role", "digest"]
    dealt = both.repartition("conv_id") if whole else both.repartitionByRange(*by)
    return dealt.sortWithinPartitions(*by, F.col("edit").isNotNull(), "node", "k").mapInArrow(_applied, _REPAIRED)


@tidy
def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations in order, one after another -> SHA-256 of their `role:text` lines."""
    ids, shas, sha, now = [], [], None, None
    for batch in batches:
        roles, texts = batch.column("role"), batch.column("text")
        for i, conv in enumerate(batch.column("conv_id").to_pylist()):
            if sha is None or conv != now:
                if sha is not None:
                    ids.append(now)
                    shas.append(sha.hexdigest())
                sha, now = hashlib.sha256(), conv
            else:
                sha.update(b"\n")
            sha.update(f"{roles[i].as_py()}:{texts[i].as_py()}".encode())
    if sha is not None:
        ids.append(now)
        shas.append(sha.hexdigest())
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shas, pa.string())], names=["conv_id", "repaired_sha256"])


def damage(rows: DataFrame) -> DataFrame:
    """Rows with the faults that their (conv_id, turn) draws: dropped, emptied, cut of its stops, repeated, or said by the user."""
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(say("conv_id"), F.lit(":"), say("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(say("text"), "[.!?]", "")).otherwise(say("text"))
    hit = rows.withColumn("kind", kind).where("kind <> 0")
    hit = hit.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(say("role")).alias("role"), text.alias("text"), "kind")
    return hit.withColumn("n", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("kind", "n")


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair_report(rows, damage(rows))


def repair_report(rows: DataFrame, damaged: DataFrame) -> DataFrame:
    """One row for each conv_id of rows: what was wrong in `damaged`, its cheapest repair and a digest of the result."""
    found = audit(damaged)
    turns = damaged.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    shas = repaired(damaged, found.edits, whole=True).mapInArrow(_digests, "conv_id long, repaired_sha256 string")
    parts = rows.select("conv_id").distinct()
    for p in (turns, found.conversations, shas):
        parts = parts.unionByName(p, allowMissingColumns=True)
    none = hashlib.sha256().hexdigest()
    count = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c)
    return parts.groupBy("conv_id").agg(
        *map(count, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(none)).alias("repaired_sha256")
    )


def _cheaper(*ways: str) -> str:
    """The least of some structs (c, a, r) that may be null."""
    return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w.c IS NOT NULL))[1]"


def _sql_way(v: str, cost: str, audit: str, line: str, when: str = "true") -> str:
    return f"{{'c': CASE WHEN {when} THEN {v}.c + {cost} END, 'a': {v}.a || '{audit}', 'r': {v}.r || {line}}}"


_U, _A = "'user:' || chr(10)", "'assistant:' || chr(10)"


def _sql_insert(u: str) -> str:
    """States v0 to v3 of a row source, closed under inserts: w2 first, then w3 from it."""
    w2 = _cheaper("v2", *(_sql_way(v, "3", "I", _U) for v in ("v0", "v1", "v3")))
    return f"SELECT *, {_cheaper('v3', _sql_way('w2', '3', 'I', _A))} AS w3 FROM (SELECT *, v0 AS w0, v1 AS w1, {w2} AS w2 FROM {u})"


_OWN, _AS_U, _AS_A = "role || ':' || text || chr(10)", "'user:' || text || chr(10)", "'assistant:' || text || chr(10)"
_MAY = "fault NOT IN ('blank', 'duplicate')"


def _sql_keep(v: str, initial: str) -> str:
    return _sql_way(v, "more", "K", _OWN, f"{_MAY} AND first = '{initial}'")


def _sql_other(v: str, line: str) -> str:
    return _sql_way(v, "3 + more", "R", line, _MAY)


_NEXT = [
    _cheaper(_sql_way("w0", "4", "D", "''")),
    _cheaper(_sql_way("w1", "4", "D", "''"), _sql_keep("w0", "s")),
    _cheaper(_sql_way("w2", "4", "D", "''"), *(w for v in ("w0", "w1", "w3") for w in (_sql_keep(v, "u"), _sql_other(v, _AS_U)))),
    _cheaper(_sql_way("w3", "4", "D", "''"), _sql_keep("w2", "a"), _sql_other("w2", _AS_A)),
]

OP13_SQL = f"""
WITH RECURSIVE step AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab),
drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(unicode(x) AS BIGINT)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS kind
  FROM conversations, step),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM drawn, LATERAL unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copies(copy)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos FROM damaged),
seen AS (
  SELECT *, role[1] AS first, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM placed),
faults AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen),
rows_ AS (SELECT *, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM faults),
ends AS (SELECT conv_id, max(pos) AS n FROM rows_ GROUP BY conv_id),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, {{'c': CAST(0 AS BIGINT), 'a': '', 'r': ''}} AS v0, {{'c': CAST(NULL AS BIGINT), 'a': '', 'r': ''}} AS v1, {{'c': CAST(NULL AS BIGINT), 'a': '', 'r': ''}} AS v2, {{'c': CAST(NULL AS BIGINT), 'a': '', 'r': ''}} AS v3 FROM ends
  UNION ALL
  SELECT conv_id, pos, {_NEXT[0]}, {_NEXT[1]}, {_NEXT[2]}, {_NEXT[3]}
  FROM ({_sql_insert("(SELECT r.*, v0, v1, v2, v3 FROM walk JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM walk.conv_id AND r.pos = walk.pos + 1)")})),
done AS (
  SELECT conv_id, {_cheaper("w0", "w3")} AS best
  FROM ({_sql_insert("(SELECT walk.* FROM walk JOIN ends ON ends.conv_id IS NOT DISTINCT FROM walk.conv_id AND ends.n = walk.pos)")})),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(first) OVER (PARTITION BY conv_id ORDER BY pos) || first AS pair FROM rows_) GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(left(best.r, length(best.r) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM o.conv_id"""
