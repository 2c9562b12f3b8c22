"""Operator 9 in the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of at least `least`
are linked, linked texts form groups, and one row of each group stays.

4 of 64 bits can't tell such pairs: at a similarity of 0.8 to 0.9 SimHashes differ in about 5 to 10 bits, at times in 20. A BK-tree
with so wide a radius must be small, so the fingerprints are dealt into shards in which similar texts meet: 40 bands of 6
minimum hashes; a pair at 0.8 shares no shard with a chance of 5e-6, and less above. Within a shard pairs come from BK-trees over the SimHashes of the
sets, where they lie within RADIUS bits (beyond it lie pairs at 0.8 of sets of a few shingles with a chance of about 4e-9 by the binomial at 3/16 a bit, as computed), and such a pair
counts when its exact similarity does. First each text is verified against its nearest in each of its shards' trees, of those before it (large shards have several trees, with
their least member in each), and these links make components. Shards that then hold several components get their members' sets, and pairs are verified in the
task that finds them: for the texts outside the shard's largest component, the hashes they have in common with every member are counted, by products of 0/1 matrices where many members
have a hash; where someone is alike and not linked yet, the tree is asked. A text with too few hashes in common with all the others is left out at once. A task returns one link for each two components it joins, never its pairs: rows grow with the texts (40 for each at
most), and no pair is left out by a limit. What is compared inside a task may still be each text outside the largest component against
all others. Shards beyond `shard_rows` or `shard_hashes` are cut into pieces: a member belongs to one, and texts outside the largest component also visit the others' trees.

Equal sets of shingles are one set from the start. Words are lower-cased and split at white space; a text of fewer
words than a shingle is one shingle. Very long texts are hashed whole. Defined results: an empty table gives no rows. A null text counts as empty;
texts without words are one group.
Of a group the row with the least doc_id stays (null last), then the least text hash; exact repeats of it go.
Extra columns are kept, whatever their names; of rows equal in doc_id and text any one stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillscan.llm.common import free_names, group_starts, materialize, sliced, whole_groups
from quillscan.llm.graph import components
from quillscan.llm.simhash import Tree

BANDS, ROWS, RADIUS = 40, 6, 32
#: Askers compared at once; share of the members from which on a hash is a matrix's column.
BLOCK, DENSE = 256, 16


def shingles(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted."""
    data = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not data:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
    if len(starts) > words:
        starts, ends = starts[: 1 - words], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(data[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts)))


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1), rng.integers(0, 2**64, BANDS * ROWS, np.uint64)


def bands(h: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """A hash for each band of the set's minimum hashes."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(h), 512):  # memory stays bounded on very long texts
        np.minimum(low, ((h[k : k + 512, None] ^ factors[1]) * factors[0]).min(0), out=low)
    return [xxhash.xxh64_intdigest(x.tobytes()) for x in low.reshape(BANDS, ROWS)]


def simhash(h: np.ndarray) -> int:
    """The 64-bit SimHash of a set of hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _signed(x: np.ndarray | list[int]) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _unsigned(x: pd.Series) -> list[int]:
    return x.to_numpy().astype(np.int64).view(np.uint64).tolist()


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, h, key, size, fp, bands) of every row: the text's hash, that of its set, the set's size, its SimHash and the hashes of its bands."""
    factors = _factors()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in sliced(batches, "text"):
            sets = [shingles(t, words) for t in b["text"]]
            keys = _signed([xxhash.xxh64_intdigest(s.tobytes()) for s in sets])
            yield pd.DataFrame({"doc_id": b["doc_id"], "h": b["h"], "key": keys, "size": [len(s) for s in sets], "fp": _signed([simhash(s) for s in sets]), "bands": [_signed(bands(s, factors)) for s in sets]})

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(_text()).alias("h"), _text().alias("text")).mapInPandas(run, "doc_id long, h long, key long, size long, fp long, bands array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(key, set) of the texts of docs(text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in sliced(batches, "text"):
            sets = [shingles(t, words) for t in b["text"]]
            yield pd.DataFrame({"key": _signed([xxhash.xxh64_intdigest(s.tobytes()) for s in sets]), "set": [s.view(np.int64) for s in sets]})

    return docs.mapInPandas(run, "key long, set array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets are alike."""
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("set").alias("y")), "b")
    both = both.where(F.least(F.size("x"), F.size("y")) >= F.greatest(F.size("x"), F.size("y")) * least - 1e-9)
    same = F.size(F.array_intersect("x", "y"))
    return both.where(same >= (F.size("x") + F.size("y") - same) * least - 1e-9).select("a", "b")


def _nearest(held: DataFrame, tree_rows: int = 512) -> DataFrame:
    """Candidates (a, b) from the shards held(band, value, key, fp, low, n): each member b and its nearest a of those before it in its BK-tree, where one lies within
    RADIUS bits. Shards beyond `tree_rows` have several trees, the least member in each."""
    task, pieces = ["band", "value", "at"], F.ceil(F.col("n") / tree_rows)
    every = F.sequence(F.lit(0).cast("long"), pieces - 1)
    at = F.explode(F.when(F.col("key") == F.col("low"), every).otherwise(F.array(F.pmod(F.xxhash64("key"), pieces))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches, task):
            out, keys, fps = [], b["key"].tolist(), _unsigned(b["fp"])
            starts = group_starts(b, task)
            for i, j in zip(starts, [*starts[1:], len(b)], strict=True):
                tree, members = Tree([]), []
                for key, fp in zip(keys[i:j], fps[i:j], strict=True):
                    found = tree.nearest(fp, RADIUS)
                    if found is not None:
                        out.append((members[found], key))
                    if found is None or tree.members[found] != fp:  # equal SimHashes are one node
                        tree.add(fp)
                        members.append(key)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return held.select("band", "value", at.alias("at"), "key", "fp").repartition(*task).sortWithinPartitions(*task, "key").mapInPandas(run, "a long, b long")


class _Piece:
    """A piece of a shard: a BK-tree over its members' SimHashes, the members that have each hash, and which roots are linked by now."""

    def __init__(self, b: pd.DataFrame, least: float):
        self.least, self.rows, self.up = least, b, {}
        self.key, self.root, self.asks = b["key"].tolist(), b["root"].tolist(), b["asks"].tolist()
        self.size = np.array([len(s) for s in b["set"]], np.int64)
        at: dict[int, list[int]] = {}
        for k, x in enumerate(_unsigned(b["fp"])):
            at.setdefault(x, []).append(k)
        self.tree, self.members = Tree(list(at)), list(at.values())
        hashes = np.concatenate(b["set"].tolist())
        order = np.argsort(hashes, kind="stable")
        self.owner = np.repeat(np.arange(len(b)), self.size)[order]
        self.hashes, self.first, self.count = np.unique(hashes[order], return_index=True, return_counts=True)
        # Columns of a 0/1 matrix for the hashes that at least a DENSE-th of the members have: no more entries than DENSE times all hashes.
        many = np.flatnonzero(self.count >= max(len(b) / DENSE, 32))
        self.column = np.full(len(self.hashes), -1)
        self.column[many] = np.arange(len(many))
        self.dense = np.zeros((len(many), len(b)), np.uint8)
        for k, c in enumerate(many):
            self.dense[k, self.owner[self.first[c] : self.first[c] + self.count[c]]] = 1

    def find(self, root: int) -> int:
        while (up := self.up.get(root, root)) != root:
            self.up[root] = root = self.up.get(up, up)
        return root

    def _overlaps(self, askers: pd.DataFrame, own: bool) -> Iterator[tuple[int, np.ndarray]]:
        """(place of an asker, hashes it has in common with each member) of the askers that may have a partner. Hashes of many members are counted by products of
        0/1 matrices, for a block of askers at once, the others by the lists of their members."""
        for start in range(0, len(askers), BLOCK):
            kept, rare = [], []
            dense = np.zeros((min(BLOCK, len(askers) - start), len(self.dense)), np.float32)
            for k, s in enumerate(askers["set"].iloc[start : start + BLOCK]):
                at = np.minimum(np.searchsorted(self.hashes, s), len(self.hashes) - 1)
                at = at[(self.hashes[at] == s) & (self.count[at] > own)]
                if len(at) < len(s) * self.least - 1e-9:
                    continue  # too few of its hashes are in any other set
                column = self.column[at]
                dense[len(kept), column[column >= 0]] = 1
                kept.append(start + k)
                rare.append(at[column < 0])
            same = np.zeros((len(kept), len(self.key)), np.float32)
            for c in range(0, len(self.dense), 1024):
                same += dense[: len(kept), c : c + 1024] @ self.dense[c : c + 1024].astype(np.float32)
            for k, at, counted in zip(kept, rare, same, strict=True):
                n = self.count[at]
                yield k, counted.astype(np.int64) + np.bincount(self.owner[np.repeat(self.first[at] - n.cumsum() + n, n) + np.arange(n.sum())], minlength=len(self.key))

    def links(self, askers: pd.DataFrame, own: bool) -> list[tuple[int, int]]:
        """A link for each two roots that a pair of an asker and a member joins; `own`: the askers are members."""
        out, fps = [], _unsigned(askers["fp"])
        keys, roots, sizes = askers["key"].tolist(), askers["root"].tolist(), [len(s) for s in askers["set"]]
        for j, same in self._overlaps(askers, own):
            key, root = keys[j], roots[j]
            alike = np.flatnonzero(same >= (sizes[j] + self.size - same) * self.least - 1e-9).tolist()
            alike = {k for k in alike if self.key[k] != key and (key < self.key[k] or not self.asks[k]) and self.find(self.root[k]) != self.find(root)}
            if not alike:
                continue  # the tree is asked only where someone is alike
            for k in (k for m in self.tree.near(fps[j], RADIUS) for k in self.members[m] if k in alike):
                if (a := self.find(root)) != (b := self.find(self.root[k])):
                    self.up[max(a, b)] = min(a, b)
                    out.append((min(key, self.key[k]), max(key, self.key[k])))
        return out

    def own_links(self) -> list[tuple[int, int]]:
        return self.links(self.rows[self.rows["asks"]], True)


def _tree_links(shards: DataFrame, sets: DataFrame, least: float, shard_rows: int, shard_hashes: int) -> DataFrame:
    """Links (a, b) between keys of shards(band, value, key, root, size, fp) that share a shard, lie within RADIUS bits, are alike and have different
    roots: enough to connect all such, less than one for each root of a piece."""
    shard = ["band", "value"]
    sizes = shards.groupBy(*shard, "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("hashes")).groupBy(*shard)
    sizes = sizes.agg(F.max(F.struct("n", "root"))["root"].alias("most"), F.count(F.lit(1)).alias("roots"), F.sum("n").alias("n"), F.sum("hashes").alias("hashes")).where("roots > 1")
    pieces = F.greatest(F.ceil(F.col("n") / shard_rows), F.ceil(F.col("hashes") / shard_hashes), F.lit(1).cast("long"))
    held = shards.join(sizes.select(*shard, "most", pieces.alias("pieces")), shard)
    held = held.select(*shard, "key", "root", "fp", (F.col("root") != F.col("most")).alias("asks"), "pieces", F.pmod(F.xxhash64("key"), F.col("pieces")).alias("piece")).join(sets, "key")
    every = F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)
    tasks = held.withColumn("at", F.explode(F.when(F.col("asks"), every).otherwise(F.array("piece")))).select(*shard, "at", (F.col("at") != F.col("piece")).alias("visits"), "asks", "key", "root", "fp", "set")
    task = [*shard, "at"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, piece = None, [], None  # members come first; what visits their piece is asked batch by batch
        links = lambda found: pd.DataFrame(found, columns=["a", "b"], dtype="int64")
        for b in batches:
            starts = group_starts(b, [*task, "visits"])
            for i, j in zip(starts, [*starts[1:], len(b)], strict=True):
                part = b.iloc[i:j]
                own, visits = tuple(part[k].iat[0] for k in task), part["visits"].iat[0]
                if held and (own != now or visits):
                    piece, held = _Piece(pd.concat(held, ignore_index=True), least), []
                    yield links(piece.own_links())
                if own != now:
                    now, piece = own, None
                if not visits:
                    held.append(part)
                elif piece:
                    yield links(piece.links(part, False))
        if held:
            yield links(_Piece(pd.concat(held, ignore_index=True), least).own_links())

    return tasks.repartition(*task).sortWithinPartitions(*task, "visits").mapInPandas(run, "a long, b long")


def near_groups(docs: DataFrame, words: int = 5, least: float = 0.8, shard_rows: int = 4096, shard_hashes: int = 1 << 21) -> DataFrame:
    """(doc_id, h, root) of every row of docs: the hash of its text and the group of its set."""
    rows = materialize(_signatures(docs, words), "neardup")
    distinct = rows.groupBy("key").agg(F.min("h").alias("h"), F.min("size").alias("size"), F.min("fp").alias("fp"), F.min("bands").alias("bands"))
    dealt = distinct.select("key", "h", "size", "fp", F.posexplode("bands").alias("band", "value"))
    crowd = dealt.groupBy("band", "value").agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    held = materialize(dealt.join(crowd, ["band", "value"]), "neardup-bands")
    texts = docs.select(F.xxhash64(_text()).alias("h"), _text().alias("text")).join(held.select("h").distinct(), "h", "left_semi")
    texts = texts.groupBy("h").agg(F.min("text").alias("text")).select("text")
    sets = materialize(_sets(texts, words), "neardup-sets")
    first = materialize(_verified(_nearest(held).distinct(), sets, least), "neardup-links")
    roots = components(first).withColumnRenamed("node", "key")
    more = held.where("n > 2")  # the one pair of a shard of two is settled
    placed = materialize(more.join(roots, "key", "left").select("band", "value", "key", "size", "fp", F.coalesce("root", "key").alias("root")), "neardup-bands")
    rest = _tree_links(placed, sets, least, shard_rows, shard_hashes)
    roots = components(materialize(first.unionByName(rest), "neardup-links")).withColumnRenamed("node", "key")
    return rows.select("doc_id", "h", "key").join(roots, "key", "left").select("doc_id", "h", F.coalesce("root", "key").alias("root"))


def drop_near_copies(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """docs with one row of each group."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("i"), F.col("h").alias("h"))
    n, *own = free_names(docs, "__n", "__h", "__i", "__none")  # keys without nulls, so that join and window share one shuffle
    key = lambda h, i: [h, F.coalesce(i, F.lit(0).cast("long")), i.isNull()]
    stay = near_groups(docs, words, least).groupBy("root").agg(F.min(order).alias("o")).select(*[c.alias(x) for c, x in zip(key(F.col("o.h"), F.col("o.i")), own, strict=True)])
    rows = docs.withColumns(dict(zip(own, key(F.xxhash64(_text()), F.col("doc_id").cast("long")), strict=True)))
    one = Window.partitionBy(*own).orderBy(own[0])
    return rows.join(stay, own, "left_semi").withColumn(n, F.row_number().over(one)).where(F.col(n) == 1).select(*docs.columns)
