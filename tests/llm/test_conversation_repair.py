"""Conversation repair against a plain walk over whole conversations, and that against every list of edits."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pandas as pd
import pytest

from paperloom.llm import convrepair

SOUND = re.compile(r"(s?(ua)+)?")
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        say = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def order(row):
    return (row[1] is not None, row[1] or 0, row[2].encode(), hashlib.sha256(row[3].encode()).digest())


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        words = BLANK.findall(text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, wrong):
    """(cost, audit, repaired) by one pass; every state's best is over whole prefixes."""
    best = {"": (0, "", ())}
    def put(to, state, cost, audit, lines):
        if state not in to or (cost, audit) < to[state][:2]:
            to[state] = (cost, audit, lines)
    def inserts(now):
        for _ in range(3):
            for state, (cost, audit, lines) in list(now.items()):
                role = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
                put(now, role[0], cost + 3, audit + "I", (*lines, role + ":"))
        return now
    for (_, _, role, text), fault in zip(rows, wrong, strict=True):
        after = {}
        for state, (cost, audit, lines) in inserts(best).items():
            put(after, state, cost + 4, audit + "D", lines)
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            may = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
            if role[:1] and role[:1] in may:
                put(after, role[0], cost + more, audit + "K", (*lines, f"{role}:{text}"))
            new = "assistant" if state == "u" else "user"
            put(after, new[0], cost + 3 + more, audit + "R", (*lines, f"{new}:{text}"))
        best = after
    return min(v for k, v in inserts(best).items() if k in ("", "a"))


def every_way(rows, wrong, longest):
    """The same by trying every list of edits up to a length."""
    out = None
    for n in range(longest + 1):
        for edits in itertools.product("KuaDIi", repeat=n):  # u, a: new role; I, i: insert user, assistant
            if sum(e not in "Ii" for e in edits) != len(rows):
                continue
            cost, roles, k = 0, "", 0
            for e in edits:
                if e in "Ii":
                    cost, roles = cost + 3, roles + ("u" if e == "I" else "a")
                    continue
                role, fault = rows[k][2], wrong[k]
                k += 1
                if e == "D":
                    cost += 4
                    continue
                if fault in ("blank", "duplicate"):
                    cost = 10**6
                cost += (3 if e in "ua" else 0) + 3 * (fault == "truncated")
                roles += e if e in "ua" else (role[:1] or "-")
            if cost < 10**6 and SOUND.fullmatch(roles):
                got = (cost, "".join({"u": "R", "a": "R", "i": "I"}.get(e, e) for e in edits))
                out = got if out is None else min(out, got)
    return out


def expected(rows, already_damaged=False):
    kept = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows] if already_damaged else damaged(rows)
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in kept if r[0] == conv), key=order)
        wrong = faults(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        cost, audit, lines = cheapest(mine, wrong)
        pairs = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (conv, gaps, wrong.count("blank"), wrong.count("duplicate"), wrong.count("truncated"), pairs, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
DDL = "conv_id long, turn long, role string, text string"


def made(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"] * 6 + ["system", "tool", "", None])
            text = rng.choice([f"Said {rng.randint(0, 99)}.", f"Cut {rng.randint(0, 9)}", "", " \t\n", None, "Again!", "né? ", "x" * rng.randint(1, 3000) + "."])
            rows.append((c, rng.choice([t, t, t, t + 3, 2, None]), role, text))
    return rows


def test_the_plain_walk_is_the_least_of_all_ways():
    rng = random.Random(3)
    for _ in range(60):
        rows = [(1, t, rng.choice(["user", "assistant", "system", ""]), rng.choice(["A.", "B", "", "C!"])) for t in range(rng.randint(0, 3))]
        wrong = faults(rows)
        assert cheapest(rows, wrong)[:2] == every_way(rows, wrong, len(rows) + 3)


@pytest.mark.parametrize(("block", "fan"), [(512, 64), (3, 2), (1, 3)])
def test_reports_equal_the_plain_walk(spark, block, fan, monkeypatch):
    rows = made(block, [None, -1, *range(40)], 12) + made(9, [100], 300) + [(200, 1, "user", "same.")] * 9 + [(201, None, "assistant", "a.")] * 3 + [(300, 20 * i, "user", "hm") for i in range(3)]
    df = spark.createDataFrame([(*r, "z") for r in rows], DDL + ", node string").repartition(5)
    report = convrepair.audit
    monkeypatch.setattr(convrepair, "audit", lambda d: report(d, block, fan))
    got = convrepair.repair_report(df, convrepair.damage(df)).select(*COLUMNS).collect()
    want = expected(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r) == want[r.conv_id]


def test_rows_after_repair(spark):
    rows = made(5, range(12), 30)
    df = spark.createDataFrame(rows, DDL)
    edits = convrepair.audit(df, 4, 2).edits
    lines: dict = {}
    for r in sorted(convrepair.repaired(df, edits).collect(), key=lambda r: (r.node, r.k, r.j)):
        lines.setdefault(r.conv_id, []).append((r.role, r.text))
    want = expected(rows, already_damaged=True)
    for c, w in want.items():
        mine = lines.get(c, [])
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in mine).encode()).hexdigest() == w[-1]
        assert SOUND.fullmatch("".join(a[0] for a, _ in mine))


def test_sql_says_the_same_and_no_rows_give_none(spark):
    rows = made(21, [None, *range(30)], 9)
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    got = {r[0]: r for r in con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({convrepair.OP13_SQL})").fetchall()}
    assert got == expected(rows)
    none = spark.createDataFrame([], DDL)
    assert convrepair.repair_report(none, convrepair.damage(none)).count() == 0
