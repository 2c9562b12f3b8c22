"""Operator 12: a Merkle manifest of a dataset. Each row is a leaf; within its group, leaves in order are hashed together in
runs of `arity`, level by level, until one node is left, the group's subroot; the subroots, in order of their groups, give the root
in the same way. A row's proof is what its run lacks at every level.

The work is a monoid of sparse forests. A partition of the ordered leaves holds a stretch of its group's indices; it hashes every run that
lies inside and keeps, by (group, level, index), only the nodes whose run goes beyond it: fewer than 2 * arity a
level. Two forests merge by uniting their nodes and hashing each run that is now complete; the number of leaves of a group tells how
long its last run is. treeReduce merges the forests of the groups that more than one partition holds, at most two a
partition, so that what meets in one place is bounded by partitions * levels * 4 * arity nodes, whatever the number of rows. Groups that lie in one
partition are finished there.

Proofs are lists of (before, after): the digests, as joined hex text, before and after the row's own node in its run. Folding a leaf
over its proof gives the root; that part is native Spark.

H is the lowercase hex SHA-256 of its inputs joined, digests as hex text; a field is `-` if null, else its length in UTF-8
bytes, a colon, its value.

Defined results: an empty table gives no rows. A null group is a group of its own, the first; null ids come first in their group. Rows of one
group and id are ordered by their leaf; equal rows are leaves of their own and as such interchangeable. A group of one
leaf has that leaf as its subroot and adds nothing to a proof. Very long texts are hashed whole. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscan.llm.common import shared_dir, shuffle_partitions

Key = tuple[str | None, int, int]  # group, level, index
PATH = "array<struct<before: string, after: string>>"
#: Groups up to which their proofs (32 levels of digests at most) are sent to every task; more are joined by a shuffle.
FEW = 4096
#: Leaves of a range: some 60 MB of digests, and as much again for the levels above.
RANGE = 500_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(*values: Column) -> Column:
    """H of the values, as fields."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _h(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def level_sizes(leaves: int, arity: int = 2) -> list[int]:
    """The number of nodes at each level, from the leaves to the one that is left."""
    out = [leaves]
    while out[-1] > 1:
        out.append(-(-out[-1] // arity))
    return out


def stretch(group: str | None, start: int, leaves: list[str], total: int, arity: int) -> list[tuple[int, list[str]]]:
    """All nodes that follow from the leaves from index `start` alone: (first index, digests) of each level."""
    out, first, nodes = [(start, leaves)], start, leaves
    for size in level_sizes(total, arity)[:-1]:
        a = -(-first // arity)
        b = (first + len(nodes)) // arity if first + len(nodes) < size else -(-size // arity)
        nodes = [_h(nodes[max(k * arity - first, 0) : (k + 1) * arity - first]) for k in range(a, b)] if b > a else []
        first = a
        out.append((first, nodes))
    return out


def forest(group: str | None, levels: list[tuple[int, list[str]]], total: int, arity: int) -> dict[Key, str]:
    """The nodes of a stretch whose run isn't complete in it."""
    out: dict[Key, str] = {}
    for level, (first, nodes) in enumerate(levels[:-1]):
        above = levels[level + 1]
        low, high = above[0] * arity, (above[0] + len(above[1])) * arity
        near = [k for k in range(first, first + len(nodes)) if not low <= k < high] if above[1] else range(first, first + len(nodes))
        out |= {(group, level, k): nodes[k - first] for k in near}
    top = levels[-1]
    return out | {(group, len(levels) - 1, top[0] + k): d for k, d in enumerate(top[1])}


def merge(a: dict, b: dict, totals: dict[str | None, int], arity: int) -> dict:
    """The forest of two: {"open": nodes whose run is incomplete, "all": every node that was ever open}."""
    free, seen = a["open"] | b["open"], a["all"] | b["all"]
    todo = list(free)
    while todo:
        group, level, k = todo.pop()
        size = level_sizes(totals[group], arity)
        if (group, level, k) not in free or level == len(size) - 1:
            continue
        run = [(group, level, j) for j in range(k - k % arity, min(k - k % arity + arity, size[level]))]
        if all(x in free for x in run):
            above = (group, level + 1, k // arity)
            free[above] = seen[above] = _h([free[x] for x in run])
            for x in run:
                del free[x]
            todo.append(above)
    return {"open": free, "all": seen}


def paths(start: int, levels: list[tuple[int, list[str]]], total: int, arity: int, beyond: dict[tuple[int, int], str]) -> Iterator[list[dict[str, str]]]:
    """The proof of each leaf of a stretch; `beyond` holds the nodes (level, index) that other stretches gave."""
    sizes = level_sizes(total, arity)
    steps: list[dict[int, dict[str, str]]] = [{} for _ in sizes]

    def node(level: int, k: int) -> str:
        first, nodes = levels[level]
        return nodes[k - first] if first <= k < first + len(nodes) else beyond[level, k]

    for leaf in range(start, start + len(levels[0][1])):
        out, k = [], leaf
        for level in range(len(sizes) - 1):
            if k not in steps[level]:
                low = k - k % arity
                run = range(low, min(low + arity, sizes[level]))
                steps[level] = {k: {"before": "".join(node(level, j) for j in run if j < k), "after": "".join(node(level, j) for j in run if j > k)}}
            out.append(steps[level][k])
            k //= arity
        yield out


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str | None, list[pd.DataFrame]]]:
    """The groups of a sorted partition, one after another."""
    held: list[pd.DataFrame] = []
    name: str | None = None
    for b in batches:
        g = [None if pd.isna(x) else x for x in b["g"]]
        cuts = [0, *(k for k in range(1, len(g)) if g[k] != g[k - 1]), len(g)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if x == y:
                continue
            if held and g[x] != name:
                yield name, held
                held = []
            name = g[x]
            held.append(b.iloc[x:y])
    if held:
        yield name, held


@dataclass(frozen=True)
class Proven:
    """`rows`: the leaves with subroot and path; `roots`: (g, subroot), one row for each group; `placed`: the leaves in order, as stored."""

    rows: DataFrame
    roots: DataFrame
    placed: DataFrame


def prove(leaves: DataFrame, group: str, order: list[str], leaf: str, arity: int = 2, ranges: int = 0) -> Proven:
    """The proofs of leaves within their groups, ordered there by `order` (columns that aren't returned) and the digest. The leaves are dealt into `ranges`, but no
    fewer than the session's shuffle partitions; a task holds the digests of one range."""
    spark = leaves.sparkSession
    shared_dir(spark)
    carried = [c for c in leaves.columns if c not in order]
    named = leaves.withColumn("g", F.col(group).cast("string")).withColumn("leaf_", F.col(leaf)).withColumn("tie_", F.monotonically_increasing_id())
    keys = [F.col("g"), *map(F.col, order), F.col("leaf_"), F.col("tie_")]  # tie_ only spreads equal rows, which are interchangeable
    placed = named.repartitionByRange(max(ranges, shuffle_partitions(spark)), *keys).sortWithinPartitions(*keys).drop("tie_", *order).withColumn("part", F.spark_partition_id()).checkpoint()

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, found = None, []
        for b in batches:
            for name, n in b.groupby("g", dropna=False, sort=False).size().items():
                name = None if pd.isna(name) else name
                part = int(b["part"].iat[0])
                if found and found[-1][0] == name:
                    found[-1][1] += n
                else:
                    found = [*found[:1], [name, n]]
        yield pd.DataFrame([(part, name, n, k) for k, (name, n) in enumerate(found)], columns=["part", "g", "n", "k"])

    # At most two groups of each partition, its first and its last, can go beyond it.
    outer = placed.select("part", "g").mapInPandas(ends, "part int, g string, n long, k int").orderBy("part", "k").collect()
    at: dict[str | None, list[tuple[int, int]]] = {}
    for r in outer:
        at.setdefault(r["g"], []).append((r["part"], r["n"]))
    totals = {g: sum(n for _, n in x) for g, x in at.items() if len(x) > 1}
    starts = {(p, g): sum(n for q, n in at[g] if q < p) for g in totals for p, _ in at[g]}

    def forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name, frames in _runs(batches):
            if name in totals:
                digests = [d for f in frames for d in f["leaf_"]]
                start = starts[int(frames[0]["part"].iat[0]), name]
                found = forest(name, stretch(name, start, digests, totals[name], arity), totals[name], arity)
                yield pd.DataFrame([(*k, d) for k, d in found.items()], columns=["g", "level", "k", "digest"])

    beyond: dict[str | None, dict[tuple[int, int], str]] = {g: {} for g in totals}
    if totals:
        spanning = placed.where(_among("g", list(totals))).select("part", "g", "leaf_").mapInPandas(forests, "g string, level int, k long, digest string")

        def as_forest(rows: Iterator) -> Iterator[dict]:
            nodes = {(r["g"], r["level"], r["k"]): r["digest"] for r in rows}
            yield merge({"open": {}, "all": {}}, {"open": nodes, "all": nodes}, totals, arity)

        whole = spanning.rdd.mapPartitions(as_forest).treeReduce(lambda a, b: merge(a, b, totals, arity))
        for (g, level, k), d in whole["all"].items():
            beyond[g][level, k] = d

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """Each group of a partition: name, frames, levels, first index, number of leaves, subroot."""
        for name, frames in _runs(batches):
            digests = [d for f in frames for d in f["leaf_"]]
            total, start = totals.get(name, len(digests)), starts.get((int(frames[0]["part"].iat[0]), name), 0)
            levels = stretch(name, start, digests, total, arity)
            yield name, frames, levels, start, total, beyond[name][len(levels) - 1, 0] if name in totals else levels[-1][1][0]

    def proofs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name, frames, levels, start, total, root in hashed(batches):
            every = paths(start, levels, total, arity, beyond.get(name, {}))
            for f in frames:
                yield f[carried].assign(subroot=root, path=[next(every) for _ in range(len(f))])

    def subroots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name, _, _, start, _, root in hashed(batches):
            if start == 0:
                yield pd.DataFrame({"g": [name], "subroot": [root]})

    kept = {f.name: f.dataType.simpleString() for f in leaves.schema if f.name in carried} | {"subroot": "string", "path": PATH}
    rows = placed.mapInPandas(proofs, ", ".join(f"`{k}` {v}" for k, v in kept.items()))
    return Proven(rows, placed.select("part", "g", "leaf_").mapInPandas(subroots, "g string, subroot string"), placed)


def _among(name: str, values: list[str | None]) -> Column:
    found = F.col(name).isin([v for v in values if v is not None])
    return found | F.col(name).isNull() if None in values else F.coalesce(found, F.lit(False))


def fold(leaf: Column, path: Column) -> Column:
    """The node that a leaf and a proof lead to."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", changed: dict[str, Column] | None = None, arity: int = 2) -> DataFrame:
    """doc_id, leaf, subroot, root, path and given (the leaf of the row as it is now) for every row; `changed` says what
    the row's fields are now, where that isn't what the manifest was made of."""
    leaf = leaf_hash(*map(F.col, fields))
    given = leaf_hash(*[(changed or {}).get(f, F.col(f)) for f in fields])
    by = F.col(order).cast("long")
    rows = docs.select(by.alias("by"), by.cast("string").alias("id"), F.col(group).cast("string").alias("grp"), leaf.alias("leaf"), F.nullif(given, leaf).alias("given"))
    inner = prove(rows, "grp", ["by"], "leaf", arity, docs.count() // RANGE + 1)
    names = inner.roots.select(F.lit("all").alias("one"), F.col("g").isNotNull().alias("known"), F.col("g").alias("by"), F.col("g").alias("name"), F.col("subroot").alias("sub"))
    outer = prove(names, "one", ["known", "by"], "sub", arity)
    above = outer.rows.select("name", F.col("subroot").alias("root"), F.col("path").alias("above"))
    if outer.placed.count() <= FEW:
        above = F.broadcast(above)
    joined = inner.rows.join(above, F.col("grp").eqNullSafe(F.col("name")))
    return joined.select(F.col("id").cast("long").alias("doc_id"), "leaf", "subroot", "root", F.concat("path", "above").alias("path"), F.coalesce("given", "leaf").alias("given"))


def verified(rows: DataFrame) -> DataFrame:
    """manifest's rows with proof_sha256, folded_root and verified instead of the proofs themselves."""
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    rows = rows.withColumn("folded_root", fold(F.col("given"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def tampered(docs: DataFrame) -> dict[str, Column]:
    """The query's damage: where 7 divides the crc32 of the decimal id, n_chars is one more."""
    return {"n_chars": F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.try_add(F.col("n_chars"), F.lit(1))).otherwise(F.col("n_chars"))}


def oracle_sql() -> str:
    """DuckDB SQL for the query: both trees level by level, and each row's way up."""

    def leaf(chars: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", chars, "text")) + ")"

    def tree(rows: str, group: str) -> str:
        return f"""SELECT {group} AS g, 0 AS lv, i, d, n FROM {rows} UNION ALL
          SELECT g, lv + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), any_value((n + 1) // 2) FROM {{}} WHERE n > 1 GROUP BY g, lv, i // 2"""

    def steps(rows: str, group: str, nodes: str) -> str:
        return f"""SELECT b.k, list(CASE WHEN s.i IS NULL THEN 'N' WHEN s.i < t.i THEN 'L' || s.d ELSE 'R' || s.d END ORDER BY t.lv) AS way
          FROM {rows} b JOIN {nodes} t ON t.g IS NOT DISTINCT FROM {group} AND t.i = b.i >> t.lv AND t.n > 1
          LEFT JOIN {nodes} s ON s.g IS NOT DISTINCT FROM t.g AND s.lv = t.lv AND s.i = xor(t.i, 1) GROUP BY b.k"""

    bits = "flatten([[ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] for c in string_split(doc_id::VARCHAR, '')])"
    crc = f"xor(list_reduce({bits}, lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)), 4294967295), 4294967295)"
    return f"""
        WITH RECURSIVE base AS (
          SELECT *, row_number() OVER () AS k, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
          FROM (SELECT doc_id, lang, {leaf("n_chars")} AS d, {leaf("(n_chars + 1)")} AS other, {crc} % 7 = 0 AS damaged FROM documents)),
        tree AS ({tree("base", "lang").format("tree")}),
        subs AS (SELECT g AS lang, d, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n, row_number() OVER () AS k FROM tree WHERE n = 1),
        crown AS ({tree("subs", "NULL").format("crown")}),
        inner_way AS ({steps("base", "b.lang", "tree")}), outer_way AS ({steps("subs", "NULL", "crown")}),
        every AS (
          SELECT b.doc_id, b.d AS leaf, s.d AS subroot, (SELECT d FROM crown WHERE n = 1) AS root, CASE WHEN damaged THEN other ELSE b.d END AS given,
            list_concat(coalesce(w.way, []), coalesce(v.way, [])) AS way
          FROM base b JOIN subs s ON s.lang IS NOT DISTINCT FROM b.lang LEFT JOIN inner_way w ON w.k = b.k LEFT JOIN outer_way v ON v.k = s.k),
        folded AS (
          SELECT *, list_reduce(list_prepend(given, way), lambda a, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || a WHEN 'R' THEN a || x[2:] ELSE a END)) AS folded_root FROM every)
        SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_prepend('', [x[2:] for x in way]), 'string_agg', '')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM folded"""
