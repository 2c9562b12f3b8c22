"""Operator 4: removal of repeated byte strings, by a sparse suffix sort.

Every byte covered by a string of `width` bytes that also starts anywhere else goes. Sorting the suffixes at all bytes would
move the corpus hundreds of times over, so only the suffixes at anchors are sorted. The anchor of a window of `width`
bytes is its 32-byte gram with the least hash (the leftmost of equal ones): equal windows have their anchors at the same
place, so they meet when anchors' suffixes are brought together by their leading tokens, and nothing is missed. Consecutive windows with one
anchor form a segment, about one for every 85 bytes.

1. Segments are found where a text is read. A segment's key is its anchor gram: its first three bytes, then a
   hash of all of it. Its digest is BLAKE2b of its bytes under a secret of the run. Segments equal within a batch are settled there; one of them goes on as a witness.
2. Splitters sampled from the keys cut the keys into ranges by their leading bytes; a key that spans several ranges is dealt over them. The
   sample has a fixed bound: beyond MOST_RANGES ranges, each is dealt on by a hash of the key. Each
   range is sorted by key and then segment. Equal neighbours are repeats. A key with different segments (the edges of repeated passages), or one that
   lies in several ranges, goes on to step 3, with one segment for each different one.
3. Of those few segments the bytes are fetched. The suffixes at all their windows are sorted by their first `width` bytes with a
   multikey quicksort over tokens of eight bytes; suffixes that share all of them are repeats. A key with more than `large` segments is
   compared window by window over the whole cluster, by digests of 128 bits.
4. The repeats are gathered for each document, merged and cut out.

Grams' hashes only choose anchors and bring segments together; whatever they are, no repeat is missed and none made up. Step 2 takes segments of one key for equal
whose 64-bit digests agree: the secret is drawn anew for each run, so that no text can be made to collide, and two different segments agree with a chance
of 2^-64. Step 3's crowded keys are judged by digests of the same kind with 128 bits, for windows of the whole cluster meet there. Otherwise step 3 compares bytes. Texts are never cut short: a very long one is handled in overlapping
pieces, which only moves some of its segments to step 3. Matches never cross documents.

Defined results: an empty table gives no rows. A null text counts as empty; texts under `width` bytes are kept whole. A repeated row repeats its
own text, so all copies' bytes go when there are at least `width`; rows with equal id and text, however many, are asked for and told their
repeats once, not once for each pair. Null ids are kept. There are no ties: every copy goes. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.llm.common import group_starts, materialize, range_of, shuffle_partitions, sliced, whole_groups

GRAM = 32
PIECE = 500_000  # bytes hashed at a time
MOST_RANGES = 2048
SEGMENT = "key long, seg long, kind byte, doc_id long, th long, pos int, n int, off int"
COVERED, OPEN, SETTLED = 0, 1, 2

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and its inverse's modulo 2^64, for n places or more."""
    have = next(iter(_POWERS), 0)
    if have < n:
        _POWERS.clear()
        size = max(n, PIECE + 4096)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        up, down = np.full(size, _BASE), np.full(size, inverse)
        up[0] = down[0] = 1
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return next(iter(_POWERS.values()))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A polynomial hash modulo 2^64 of every gram."""
    n = len(data) + 1 - GRAM
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return (sums[GRAM:] - sums[:n]) * down[:n]


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, secret: bytes, size: int) -> Iterator[bytes]:
    """The keyed digest, of so many bytes, of each part of data."""
    raw = data.tobytes()
    return (hashlib.blake2b(raw[a:z], digest_size=size, key=secret).digest() for a, z in zip(start.tolist(), end.tolist(), strict=True))


def find_segments(data: np.ndarray, ends: np.ndarray, width: int, secret: bytes) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor - start, key, digest) of the segments of joined texts that end at the given places."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    if len(data) < width:
        return none
    gram = _mix(gram_hashes(data))
    reach = width - GRAM + 1  # grams in a window
    low = np.uint64(0xFFFFFF)
    value = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    pad = -len(value) % reach
    block = np.concatenate([value, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, reach)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.ascontiguousarray(np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1]).ravel()
    last = len(data) - width + 1
    anchor = (np.minimum(back[:last], ahead[reach - 1 : reach - 1 + last]) & low).astype(np.int64)
    at = np.flatnonzero(np.arange(width, len(data) + 1) <= np.repeat(ends, np.diff(ends, prepend=0))[:last])
    if not len(at):
        return none
    anchor = anchor[at]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
    start, n = at[new], np.diff(new, append=len(at))
    anchor = anchor[new]
    lead = (data[anchor].astype(np.uint64) << np.uint64(56)) | (data[anchor + 1].astype(np.uint64) << np.uint64(48)) | (data[anchor + 2].astype(np.uint64) << np.uint64(40))
    key = ((lead | (gram[anchor] >> np.uint64(24))) ^ np.uint64(1 << 63)).view(np.int64)
    off = anchor - start
    return start, n, off, key, np.frombuffer(b"".join(digests(data, start, start + n - 1 + width, secret, 8)), np.uint64)


def _joined(texts: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends of the parts, part -> text, part -> its place in the text): short texts together, long ones in pieces
    that overlap so that every window lies in exactly one."""
    parts: list[tuple[bytes, int, int]] = []
    size = 0

    def made():
        return np.frombuffer(b"".join(p[0] for p in parts), np.uint8), np.cumsum([len(p[0]) for p in parts]), np.array([p[1] for p in parts]), np.array([p[2] for p in parts])

    for k, t in enumerate(texts):
        for at in range(0, max(len(t), 1), PIECE):
            piece = t[at : at + PIECE + width - 1]
            if parts and size + len(piece) > PIECE:
                yield made()
                parts, size = [], 0
            parts.append((piece, k, at))
            size += len(piece)
    if parts:
        yield made()


def _segments(docs: DataFrame, width: int, secret: bytes) -> DataFrame:
    """Step 1, over docs(doc_id, th, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in sliced(batches, "text"):
            ids, th = b["doc_id"], b["th"].to_numpy()
            for data, ends, owner, place in _joined([t.encode("utf-8", "surrogatepass") for t in b["text"]], width):
                start, n, off, key, seg = find_segments(data, ends, width, secret)
                if not len(start):
                    continue
                part = np.searchsorted(ends, start, side="right")
                row, pos = owner[part], start - np.concatenate([[0], ends])[part] + place[part]
                _, first, inverse, count = np.unique(seg, return_index=True, return_inverse=True, return_counts=True)
                twice = count[inverse] > 1
                kind = np.where(twice, COVERED, OPEN).astype(np.int8)
                kind[first[count > 1]] = SETTLED
                cover = np.flatnonzero(twice)
                if len(cover):  # neighbouring repeats of a text as one
                    new = np.concatenate([[True], (row[cover][1:] != row[cover][:-1]) | (pos[cover][1:] != (pos + n)[cover][:-1])])
                    begin = cover[new]
                    stop = cover[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(cover) - 1]])]
                    yield _frame(th[row[begin]], seg[begin], np.zeros(len(begin), np.int8), ids, row[begin], th, pos[begin], (pos + n)[stop] - pos[begin], off[begin] * 0)
                go = kind != COVERED
                yield _frame(key[go], seg[go], kind[go], ids, row[go], th, pos[go], n[go], off[go])

    return docs.mapInPandas(run, SEGMENT)


def _frame(key, seg, kind, ids, row, th, pos, n, off) -> pd.DataFrame:
    return pd.DataFrame({"key": key, "seg": seg.view(np.int64), "kind": kind, "doc_id": ids.iloc[row].array, "th": th[row], "pos": pos.astype(np.int32), "n": n.astype(np.int32), "off": off.astype(np.int32)})


def _sorted_out(b: pd.DataFrame, several: np.ndarray) -> pd.DataFrame:
    """Step 2 on whole groups of equal keys, sorted by key and segment: what is covered, and what step 3 must compare."""
    done = b["kind"].to_numpy() == COVERED
    out, b = [b[done]], b[~done]
    if len(b):
        key, seg = b["key"].to_numpy(), b["seg"].to_numpy()
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        new = new_key | np.concatenate([[True], seg[1:] != seg[:-1]])
        cls, group = np.cumsum(new) - 1, np.cumsum(new_key) - 1
        twice = np.bincount(cls)[cls] > 1
        classes = np.bincount(group[new])[group]
        kind = b["kind"].to_numpy()
        covered = b[twice & (kind == OPEN)]
        out.append(covered.assign(kind=np.int8(COVERED)))
        onward = new & ((classes > 1) | np.isin(key, several))
        out.append(b[onward].assign(kind=np.where(twice | (kind == SETTLED), SETTLED, OPEN)[onward].astype(np.int8)))
    return pd.concat(out, ignore_index=True)


def _windows(b: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of b, window's place in its segment, its place in the joined bytes) of rows with `context`, and these bytes."""
    n = b["n"].to_numpy(np.int64)
    data = np.frombuffer(b"".join(b["context"]), np.uint8)
    begin = np.concatenate([[0], np.cumsum(n + width - 1)])[:-1]
    row = np.repeat(np.arange(len(b)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return row, k, begin[row] + k, data


def suffix_classes(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """How many of the suffixes of data that start at the given places have the same first `width` bytes as each, itself
    included, by multikey quicksort: a group of suffixes alike so far is split by its next token of eight bytes, and goes on
    until it has one member or its tokens are used up. All groups take a step at once."""
    tokens = np.zeros(len(data), np.uint64)
    for k in range(8):
        tokens[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    many = np.ones(len(at), np.int64)
    group, left = np.zeros(len(at), np.int64), np.arange(len(at))
    for depth in [*range(0, width - 7, 8), width - 8][: width // 8 + (width % 8 > 0)]:
        token = tokens[at[left] + depth]
        order = np.lexsort((token, group))
        left, group, token = left[order], group[order], token[order]
        new = np.ones(len(left), bool)
        new[1:] = (group[1:] != group[:-1]) | (token[1:] != token[:-1])
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        more = size[group] > 1
        left, group = left[more], group[more]
        if not len(left):
            return many
    many[left] = np.bincount(group)[group]
    return many


def _runs(b: pd.DataFrame, row: np.ndarray, k: np.ndarray) -> pd.DataFrame:
    """Covered rows from repeated windows (sorted by row and place)."""
    if not len(row):
        return b.iloc[:0][["doc_id", "th", "pos", "n"]]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (k[1:] != k[:-1] + 1)])
    first = np.flatnonzero(new)
    size = np.diff(first, append=len(row))
    out = b.iloc[row[first]][["doc_id", "th", "pos", "n"]].reset_index(drop=True)
    return out.assign(pos=(out["pos"].to_numpy() + k[first]).astype(np.int32), n=size.astype(np.int32))


def remove_repeats(docs: DataFrame, width: int = 200, rows_per_range: int = 4_000_000, large: int = 20_000, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep_bytes, kept (the remaining bytes) of every row of docs."""
    if not GRAM < width <= 1000:
        raise ValueError("width must be over 32 and at most 1000")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    secret = os.urandom(16)  # part of the plan, so that tasks run again use the same
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    tasks = max(total // (85 * rows_per_range) + 1, shuffle_partitions(docs.sparkSession))
    # Sampled splitters: the keys of about 64 segments for each range, from rows drawn at random (the result doesn't
    # depend on them, only the balance does). Several ranges a task even out their sizes. There are at most MOST_RANGES, so that
    # the driver's sample has a fixed bound; on larger tables each range is dealt on by a hash of the key.
    ranges = min(4 * tasks, MOST_RANGES)
    parts = -(-4 * tasks // ranges)
    share = min(1.0, 64 * 85 * ranges / max(total, 1))
    sample = sorted(r["key"] for r in _segments(rows.where(F.rand(20) < share), width, secret).where(F.col("kind") != COVERED).select("key").collect())
    cuts = [sample[len(sample) * k // ranges] for k in range(1, ranges)] if len(sample) >= ranges else []
    several = np.array(sorted({a for a, b in zip(cuts, cuts[1:], strict=False) if a == b}), np.int64)
    bounds = sorted(set(cuts))
    place = (range_of(F.col("key"), bounds) * parts + F.pmod(F.xxhash64("key"), F.lit(parts))) * 1000
    if len(several):
        spread = F.create_map(*[x for k in several.tolist() for x in (F.lit(k).cast("long"), F.lit(cuts.count(k)))])
        place = place + F.pmod(F.xxhash64("th", "pos"), F.coalesce(F.try_element_at(spread, F.col("key")), F.lit(1)))

    def sort_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches, ["key"]):
            yield _sorted_out(b, several)

    dealt = _segments(rows, width, secret).repartition(tasks, place).sortWithinPartitions("key", "seg")
    found = materialize(dealt.mapInPandas(sort_out, SEGMENT), "segments")
    onward = found.where(F.col("kind") != COVERED)
    crowded = onward.groupBy("key").count().where(F.col("count") > large).select("key", F.lit(True).alias("crowded"))
    onward = onward.join(crowded, "key", "left").select("doc_id", "th", F.struct("key", "kind", "pos", "n", "off", F.coalesce("crowded", F.lit(False)).alias("crowded")).alias("s"))
    asked = onward.distinct().groupBy("doc_id", "th").agg(F.collect_list("s").alias("s"))
    together = lambda a, b, how: a.join(b.withColumnsRenamed({"doc_id": "__i", "th": "__t"}), F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("th") == F.col("__t")), how).drop("__i", "__t")

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, th, text, s in zip(b["doc_id"], b["th"], b["text"], b["s"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                out += [(x["key"], x["kind"], x["crowded"], i, th, x["pos"], x["n"], x["off"], raw[x["pos"] : x["pos"] + x["n"] - 1 + width]) for x in s]
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=fetched)
                    out = []
            yield pd.DataFrame(out, columns=fetched)

    fetched = ["key", "kind", "crowded", "doc_id", "th", "pos", "n", "off", "context"]
    contexts = together(rows, asked, "inner").mapInPandas(fetch, "key long, kind byte, crowded boolean, doc_id long, th long, pos int, n int, off int, context binary")
    # Equal rows are asked alike: what they send is one context.
    contexts = materialize(contexts.groupBy("doc_id", "th", "pos", "n", "off", "key", "crowded").agg(F.max("kind").alias("kind"), F.first("context").alias("context")), "contexts")
    cover = "doc_id long, th long, pos int, n int"

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches, ["key"]):
            starts = group_starts(b, ["key"])
            for i, j in _about(starts, len(b), 5000):
                part = b.iloc[i:j].reset_index(drop=True)
                row, k, at, data = _windows(part, width)
                twice = (suffix_classes(data, at, width) > 1) & (part["kind"].to_numpy() == OPEN)[row]
                yield _runs(part, row[twice], k[twice])

    def spread_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 2000):
                part = b.iloc[i : i + 2000].reset_index(drop=True)
                row, k, at, data = _windows(part, width)
                yield pd.DataFrame({"h": list(digests(data, at, at + width, secret, 16)), "kind": part["kind"].to_numpy()[row], "doc_id": part["doc_id"].iloc[row].array, "th": part["th"].to_numpy()[row], "pos": (part["pos"].to_numpy()[row] + k).astype(np.int32)})

    few = contexts.where("NOT crowded").drop("crowded").repartition(tasks, "key").sortWithinPartitions("key").mapInPandas(compare, cover)
    many = contexts.where("crowded").mapInPandas(spread_windows, "h binary, kind byte, doc_id long, th long, pos int")
    twice = many.groupBy("h").count().where("count > 1")
    many = many.where(F.col("kind") == OPEN).join(twice, "h", "left_semi").select("doc_id", "th", "pos", F.lit(1).alias("n"))
    covered = found.where(F.col("kind") == COVERED).select("doc_id", "th", "pos", "n").unionByName(few).unionByName(many)
    covered = covered.distinct().groupBy("doc_id", "th").agg(F.collect_list(F.struct("pos", "n")).alias("c"))

    shape = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    names = [c.split()[0] for c in shape.split(", ")]

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in sliced(batches, "text"):
            out = []
            for i, text, c in zip(b["doc_id"], b["text"], b["c"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                spans: list[list[int]] = []
                for a, z in sorted((x["pos"], x["pos"] + x["n"] - 1 + width) for x in (c if c is not None else [])):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], z)
                    else:
                        spans.append([a, z])
                at, kept = 0, []
                for a, z in spans:
                    kept.append(raw[at:a])
                    at = z
                left = b"".join([*kept, raw[at:]])
                out.append((i, len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left)[: len(names)])
            yield pd.DataFrame(out, columns=names)

    return together(rows, covered, "left").select("doc_id", "text", "c").mapInPandas(cut_out, shape)


def _about(starts: list[int], n: int, size: int) -> Iterator[tuple[int, int]]:
    """Slices of whole groups with about `size` rows each."""
    at = 0
    for s in [*starts[1:], n]:
        if s - at >= size or s == n:
            yield at, s
            at = s


def oracle_sql(width: int = 200) -> str:
    """Every window compared with every other by its MD5 digest, for DuckDB."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT rid, doc_id, b, h, octet_length(b) AS n FROM d),
w AS (SELECT rid, i, md5(b[i:i + {width - 1}]) AS m FROM (SELECT rid, b, unnest(range(1, n - {width - 2})) AS i FROM n WHERE n >= {width})),
twice AS (SELECT rid, i FROM w JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) USING (m)),
steps AS (SELECT rid, i, sum(gap) OVER (PARTITION BY rid ORDER BY i) AS run FROM (SELECT rid, i, (i > lag(i, 1, -{2 * width}) OVER (PARTITION BY rid ORDER BY i) + {width})::INT AS gap FROM twice)),
spans AS (SELECT rid, min(i) AS a, max(i) + {width - 1} AS z FROM steps GROUP BY rid, run),
edges AS (SELECT rid, a, z, lag(z, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS prior FROM spans UNION ALL SELECT n.rid, n.n + 1, n.n + 1, coalesce(max(z), 0) FROM n LEFT JOIN spans USING (rid) GROUP BY n.rid, n.n),
kept AS (SELECT rid, string_agg(substring(h, 2 * prior + 1, 2 * (a - prior - 1)), '' ORDER BY a) AS k FROM edges JOIN n USING (rid) GROUP BY rid),
total AS (SELECT rid, sum(z - a + 1) AS removed, count(*) AS spans FROM spans GROUP BY rid)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM n JOIN kept USING (rid) LEFT JOIN total USING (rid)"""
