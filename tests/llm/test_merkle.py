"""The Merkle manifest against SQL and a plain recursion, for odd tables and any cut into partitions."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from quillscan.llm import merkle, queries
from tests.oracle import connect, same

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, g string, part int, leaf string, path string, k long"


def plain(nodes, arity):
    """(root, proofs) by recursion over a list of digests."""
    if len(nodes) == 1:
        return nodes[0], [[]]
    runs = [nodes[k : k + arity] for k in range(0, len(nodes), arity)]
    root, upper = plain([sha256("".join(r).encode()).hexdigest() for r in runs], arity)
    return root, [[x for j, x in enumerate(r) if j != i] + upper[k] for k, r in enumerate(runs) for i in range(len(r))]


def brute(rows, arity):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for r in rows:
        d, text, lang, source, n = r[:5]
        leaf = sha256("".join(map(field, (d, source, lang, n, text))).encode()).hexdigest()
        groups.setdefault(lang, []).append((d is not None, d or 0, leaf, d))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    inner = {x: plain([y[2] for y in sorted(groups[x], key=lambda y: y[:3])], arity) for x in names}
    if not names:
        return []
    root, above = plain([inner[x][0] for x in names], arity)
    out = []
    for x, up in zip(names, above, strict=True):
        for (_, _, leaf, d), way in zip(sorted(groups[x], key=lambda y: y[:3]), inner[x][1], strict=True):
            out.append((d, leaf, inner[x][0], root, sha256("".join(way + up).encode()).hexdigest(), True))
    return sorted(out, key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_duckdb(spark, sf):
    assert same(queries.op12_merkle_manifest(spark, f"/root/testdata/{sf}"), connect(f"/root/testdata/{sf}"), queries.ORACLE["op12_merkle_manifest"]) > 100


TABLES = {
    "none": [],
    "one": [(1, "a", "en", "s", 1)],
    "nulls": [(None, None, None, None, None)] * 3,
    "repeated": [(5, "same", "en", "s", 4)] * 40,
    "one_group": [(k, "t" * k, "en", None, k) for k in range(37)],
    "many_groups": [(k, "x", f"l{k % 23}" if k % 5 else None, "s", 2**63 - 1) for k in range(150)],
    "hot": [(2**62 + k, "é\U0001f600", "en" if k % 3 else f"é{k}", "", -k) for k in range(200)],
    "long": [(1, "ab" * 500_000, "", "s", 7), (2, "", "", "", None)],
}


@pytest.mark.parametrize(("table", "arity"), [*((t, 2) for t in TABLES), ("hot", 3), ("one_group", 4)])
def test_equals_a_plain_recursion(spark, table, arity):
    rows = TABLES[table]
    docs = spark.createDataFrame([(*r, "g", 1, "leaf", "p", 2) for r in rows], SHAPE).repartition(3)
    got = merkle.verified(merkle.manifest(docs, arity=arity))
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["verified"]) for r in got.collect()), key=str) == brute(rows, arity)


def test_every_change_is_noticed(spark):
    docs = spark.createDataFrame([(k, f"text {k}", "en", "s", k, *[None] * 5) for k in range(64)], SHAPE)
    for field, new in (("text", F.concat("text", F.lit(" "))), ("n_chars", F.lit(None)), ("source", F.lit(None)), ("lang", F.lit("de"))):
        rows = merkle.verified(merkle.manifest(docs, changed={field: F.when(F.col("doc_id") % 8 == 3, new).otherwise(F.col(field))})).collect()
        assert {r["doc_id"] for r in rows if not r["verified"]} == {k for k in range(64) if k % 8 == 3}, field


def test_forests_merge_in_any_order():
    leaves = [sha256(bytes([k])).hexdigest() for k in range(53)]
    for arity in (2, 3, 5):
        root, _ = plain(leaves, arity)
        for cuts in ([0, 1, 2, 53], [0, 7, 8, 9, 30, 53], list(range(54)), [0, 26, 53]):
            parts = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                nodes = merkle.forest("g", merkle.stretch("g", a, leaves[a:b], 53, arity), 53, arity)
                parts.append({"open": nodes, "all": nodes})
            for order in (parts, parts[::-1], parts[1::2] + parts[::2]):
                total = {"open": {}, "all": {}}
                for p in order:
                    total = merkle.merge(total, p, {"g": 53}, arity)
                assert list(total["open"].values()) == [root]
