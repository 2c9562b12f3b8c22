"""Repair of conversations against a plain search over all edits, whole conversations and ones spread over partitions."""

import random
import re
from functools import lru_cache
from hashlib import sha256
from zlib import crc32

import pytest

from quillscan.llm import queries, turns

SHAPE = "conv_id long, turn long, role string, text string, part int, was string, new boolean, times long, same string"
STATES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def damage(rows):
    out = []
    for c, t, role, text in rows:
        said = lambda v: " " if v is None else str(v)
        kind = crc32(f"{said(c)}:{said(t)}".encode()) % 20
        role, text = said(role), said(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(c, t, role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired rows) of rows (role, text, fault), by trying every edit."""

    @lru_cache(maxsize=None)
    def best(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def go(cost, letter, kept, to, j, n=0):
            rest = best(j, to, n)
            if rest:
                found.append((cost + rest[0], letter + rest[1], kept + rest[2]))

        new = "a" if state == "u" else "u"
        full = {"u": "user", "a": "assistant"}[new]
        if inserted < 3:
            go(2, "I", ((full, ""),), new, i, inserted + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            go(3, "D", (), state, i + 1)
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                go(2 + more, "R", ((full, text),), new, i + 1)
                if (state, role[:1]) in STATES:
                    go(more, "K", ((role, text),), STATES[state, role[:1]], i + 1)
        return min(found, key=lambda x: x[:2]) if found else None

    for i in range(len(rows), -1, -1):  # so that no call goes deep
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    return best(0, "", 0)


def brute(rows, damaged=True):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], [])
    for r in damage(rows) if damaged else rows:
        convs[r[0]].append(r)
    out = {}
    for c, some in convs.items():
        some.sort(key=lambda r: (r[1] is not None, r[1] or 0, (r[2] + "\0" + r[3]).encode()))
        seen, faults = set(), []
        for _, _, role, text in some:
            said = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
            seen.add((role, text))
        at = [r[1] for r in some if r[1] is not None]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(some, some[1:], strict=False))
        cost, audit, kept = cheapest(tuple((r[2], r[3], f) for r, f in zip(some, faults, strict=True)))
        gaps = min(max(at) - min(at) + 1 - len(set(at)), 2**63 - 1) if at else 0
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out[c] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha256(text.encode()).hexdigest())
    return out


def got(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in df.collect()}


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "w", True, 5, "s") for r in rows], SHAPE)
    return got(turns.digest(turns.placed(turns.damaged(df)), df))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_a_search_over_all_edits(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op11_conversation_repair(spark, f"/root/testdata/{sf}")) == brute(rows)


def odd(seed, convs, longest):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "u", "", None, "tool", "Assistant", "spam"])
            text = rng.choice(["Yes.", "No", "Well!", "", " \n", "  ok \t", None, "é?", f"one {rng.random()}.", f"cut {rng.random()}"])
            rows.append((rng.choice([c, c, c, None]), rng.choice([t, t, 2 * t, None, -t]), role, text))
    return rows


TABLES = {
    "short": odd(1, 60, 7),
    "long": odd(2, 3, 90),
    "one spread over all partitions": [(7, t, ["user", "assistant", "system", "x"][t * t % 7 % 4], f"{t % 50}{'.' * (t % 3)}") for t in range(400)],
    "hot equal rows": [(1, 5, "user", "same.")] * 300 + [(1, 6, "assistant", "same.")] * 200 + [(2, 1, "user", "q?")],
    "one text at every turn": [(3, t, "user", "again") for t in range(200)] + [(3, None, "assistant", "again")] * 5,
    "nulls": [(None, None, None, None)] * 4,
    "all dropped": [(c, t, "user", "x.") for c in range(40) for t in range(3) if crc32(f"{c}:{t}".encode()) % 20 == 0],
    "ids": [(2**62 + k, 2**61 + k % 2, "user", "a" * 100_000 + "\0") for k in range(3)] + [(-1, -5, "assistant", "\U0001f600")],
    "far turns": [(1, -(2**63), "user", "x."), (1, 2**63 - 1, "assistant", "y.")],
    "none": [],
}


@pytest.mark.parametrize("name", TABLES)
def test_odd_tables_equal_a_search_over_all_edits(spark, name):
    want = brute(TABLES[name])
    have = run(spark, TABLES[name])
    assert have.keys() == want.keys()
    assert {k: (v, want[k]) for k, v in have.items() if v != want[k]} == {}


def test_restored_conversations_are_well_formed(spark):
    rows = odd(5, 40, 8)
    edits = turns.conversations(spark.createDataFrame([(*r, 1, "w", True, 5, "s") for r in rows], SHAPE))
    found = {}
    for r in turns.restored(edits).collect():
        found.setdefault(r["conv_id"], {}).setdefault(r["part"], []).append(r["role"][:1])
    for c, parts in found.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(x for p in sorted(parts) for x in parts[p])), c
