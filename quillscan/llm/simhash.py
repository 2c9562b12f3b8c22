"""Operator 9: SimHash near-dedup by BK-trees.

A fingerprint has 64 bits over the XXH64 hashes of a text's word shingles; fingerprints link when they differ in at
most `radius` bits, and linked fingerprints form components.

Search: two fingerprints within the radius agree wholly on at least `pick` of `blocks` bit blocks when
blocks - pick >= radius, so fingerprints are dealt into shards by every choice of `pick` blocks. Shards are small, and a shard above `shard_rows` is cut into
pieces; each piece's BK-tree (children keyed by their Hamming distance to the parent) is sent to the task that asks it
for the fingerprints of that piece or of a later piece of the same shard, following only edges within the radius.
Every pair within the radius thus meets in some tree whatever the size of its shard. A global tree isn't broadcast:
it would grow with the corpus.

Copies never multiply: equal fingerprints are one node, and a tree query only joins the asker to trees' members by
union-find, so a shard emits one link for each member at most, never all its pairs.

Defined results: an empty table gives no rows, and very long texts are read whole; a null text counts as empty; texts without words have fingerprint zero, linked like any other. A null
doc_id is kept: its row gets the component of its fingerprint, null where no row of the component has an id. Repeated rows get one result row each.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.llm.common import group_starts, materialize, whole_groups
from quillscan.llm.graph import components

_SIGN = 1 << 64


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a whole text, as a signed long."""
    data = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not data:
        return 0
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.concatenate([gaps, [len(data)]])
    if len(starts) > words:
        starts, ends = starts[: 1 - words], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(data[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 14):  # memory stays bounded on very long texts
        ones += np.unpackbits(h[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view(np.int64)[0])


class Tree:
    """A BK-tree of distinct 64-bit numbers."""

    def __init__(self, members: list[int]):
        self.members: list[int] = []
        self.children: list[dict[int, int]] = []
        for x in members:
            self.add(x)

    def add(self, x: int) -> None:
        k, at = len(self.members), 0
        self.members.append(x)
        self.children.append({})
        while k:
            nxt = self.children[at].setdefault((self.members[at] ^ x).bit_count(), k)
            if nxt == k:
                break
            at = nxt

    def nearest(self, x: int, radius: int) -> int | None:
        """The position of a member nearest to x, where one is within the radius; what is found narrows the search."""
        best, stack = None, [(0, 0)] if self.members else []
        while stack:
            apart, at = stack.pop()
            if apart > radius:
                continue
            d = (self.members[at] ^ x).bit_count()
            if d <= radius:
                if not d:
                    return at
                best, radius = at, d - 1
            # A child at distance e is at least |d - e| from x, as is all below it; the nearest are looked at first.
            stack += sorted(((abs(d - e), k) for e, k in self.children[at].items() if abs(d - e) <= radius), reverse=True)
        return best

    def near(self, x: int, radius: int) -> Iterator[int]:
        """Positions of the members within the radius of x."""
        stack = [0] if self.members else []
        while stack:
            at = stack.pop()
            d = (self.members[at] ^ x).bit_count()
            if d <= radius:
                yield at
            kids = self.children[at]
            if len(kids) <= 2 * radius + 1:
                stack += [k for e, k in kids.items() if d - radius <= e <= d + radius]
            else:
                stack += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]


def _blocks(radius: int, distinct: int) -> tuple[int, int]:
    """(blocks, pick): as many whole blocks must agree as make shards of a few dozen random fingerprints."""
    pick = 1
    while pick < 4 and (distinct >> (64 * pick // (radius + pick))) > 128:
        pick += 1
    return radius + pick, pick


def _links(members: list[int], askers: list[int], radius: int) -> list[tuple[int, int]]:
    """Links of one task: the members form the tree; they and the askers query it. One link at most for each member,
    one for each tree component that an asker reaches. Numbers are unsigned in here."""
    tree, root = Tree(members), list(range(len(members)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for own, x in enumerate(members):
        for k in tree.near(x, radius):
            if (a := find(k)) != (b := find(own)):
                root[max(a, b)] = min(a, b)
    out = [(members[find(k)], x) for k, x in enumerate(members) if find(k) != k]
    for x in askers:
        out += [(members[k], x) for k in {find(k) for k in tree.near(x, radius)}]
    return [tuple(v - _SIGN if v >= _SIGN >> 1 else v for v in pair) for pair in out]


def fingerprint_links(fps: DataFrame, radius: int, shard_rows: int = 4096) -> DataFrame:
    """links(a, b) between the distinct fingerprints fps(fp), enough to connect all that are within the radius."""
    blocks, pick = _blocks(radius, fps.count())
    cut = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum(((1 << (cut[k + 1] - cut[k])) - 1) << cut[k] for k in chosen) for chosen in combinations(range(blocks), pick)]
    parts = F.array(*[F.col("fp").bitwiseAND(F.lit(m - _SIGN if m >= _SIGN >> 1 else m).cast("long")) for m in masks])
    dealt = fps.select("fp", F.posexplode(parts).alias("choice", "value"))
    sizes = dealt.groupBy("choice", "value").count().where("count > 1")  # a fingerprint alone in its shard goes no further
    held = dealt.join(sizes.withColumn("pieces", F.ceil(F.col("count") / shard_rows)), ["choice", "value"])
    held = held.withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("pieces")))
    tasks = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).select(
        "choice", "value", F.least("piece", "other").alias("tree"), F.greatest("piece", "other").alias("asker"), (F.col("other") < F.col("piece")).alias("asks"), "fp"
    )
    keys = ["choice", "value", "tree", "asker"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches, keys):
            out: list[tuple[int, int]] = []
            fp, asks = b["fp"].to_numpy().astype(np.int64).view(np.uint64).tolist(), b["asks"].to_numpy()
            starts = group_starts(b, keys)
            for i, j in zip(starts, [*starts[1:], len(b)], strict=True):
                side = asks[i:j]
                out += _links([x for x, a in zip(fp[i:j], side, strict=True) if not a], [x for x, a in zip(fp[i:j], side, strict=True) if a], radius)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return tasks.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInPandas(run, "a long, b long")


def with_fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": [fingerprint(t, words, seed) for t in b["text"]]})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, seed: int = 42, shard_rows: int = 4096) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id of the component) for every row of docs."""
    rows = materialize(with_fingerprints(docs, words, seed), "simhash")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(materialize(fingerprint_links(distinct.select("fp"), radius, shard_rows), "simhash-links"))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(placed, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
