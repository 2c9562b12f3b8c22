"""Operator 11: repair of conversations' structure, by a dynamic program over turns that is vectorised over conversations.

A conversation's role initials must read `(s?(ua)+)?`. Keep costs 0, Rerole (to user or assistant) 2, Delete 3, Insert (an empty
turn of user or assistant, anywhere) 2; a kept truncated turn adds 1, and blank or duplicate turns must be deleted. The cheapest
edits are taken; of equally cheap ones those whose initials come first in ASCII.

The program runs over four states: nothing yet, after `s`, after `u`, after `a`. Conversations are put into buckets by
length, and one NumPy tensor (turn, conversation, state) holds the backward costs of a bucket, filled turn by turn for all its
conversations at once. The edits are then traced forward, again turn by turn for all conversations at once.

Rows are ordered by range, so a conversation of any length is spread over partitions (its stretches, at most two partly
filled ones a partition). Over a stretch the program is a min-plus matrix of four by four and, once the costs beyond it are known, a map of states to
states; both combine associatively. Only conversations that more than one partition holds need that, so that at most two matrices and two
maps a partition reach the driver, and then all stretches are traced independently. Equal rows of one turn are one row with a count.

Faults: a turn is blank if it has no other character than spaces, tabs and line ends; duplicate if its role and text were seen
earlier in the conversation; truncated if its last such character isn't one of `.!?`. The first that holds counts.

Defined results: an empty table gives no rows. Null roles and texts are one space; null turns come first. Rows of one turn are ordered by role, then
text. Repeated rows are duplicates. A null conv_id is a conversation. Very long texts are kept whole. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscan.llm.common import shared_dir, shuffle_partitions, whole_groups

SPACE = r"[\x20\x09-\x0D]"
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 2, 3, 2, 1
FAR = np.int64(1) << 60
#: Stored bytes of a range of turns; the most ranges, which bounds what the driver gets of conversations that lie in several.
RANGE, MOST_RANGES = 32 << 20, 100_000
#: What a new user or assistant turn leads to from each state (nothing, s, u, a), and whether that turn is the user's.
NEXT = np.array([2, 2, 3, 2])
USER = np.array([True, True, False, True])
#: What a kept turn leads to from each state, by its role's initial (s, u, a, other); -1: not allowed.
KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: The costs after the last turn: a conversation may end with nothing or after an assistant; else turns are inserted.
END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
EDITS = np.array(["D", "I", "K", "R"])
FAULTS = ("", "blank", "duplicate", "truncated")
ROWS = "conv_id string, part int, turn string, was string, role string, text string, fault string, edit string, times long"


def damaged(rows: DataFrame) -> DataFrame:
    """The query's damage, by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 removes its sentence
    marks, 3 repeats it, 4 sets its role to user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    role = F.when(kind == 4, "user").otherwise(said("role"))
    return rows.where(kind != 0).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("times"))


@dataclass(frozen=True)
class Placed:
    """`rows` in order, as stored; `spread`: the conversations that more than one partition holds."""

    rows: DataFrame
    spread: list[int | None]


def placed(rows: DataFrame) -> Placed:
    """rows(conv_id, turn, role, text, times) in order, with what the program needs to know of each."""
    spark = rows.sparkSession
    shared_dir(spark)
    none = lambda c: F.coalesce(F.col(c), F.lit(" "))
    one = rows.select("conv_id", "turn", none("role").alias("role"), none("text").alias("text"), "times").groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    said = F.concat("role", F.lit("\0"), "text")
    # Ranges of about RANGE bytes as the rows are stored: a task holds one at most of a conversation.
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # Which turn said a thing first is aggregated by digest, map-side first; the join back is one that adaptive execution splits when skewed.
    same = F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"), said), 256)
    one = one.withColumn("same", same)
    first = one.groupBy("same").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    one = one.join(first, "same").withColumn("new", F.col("first.turn").eqNullSafe(F.col("turn")))
    end = F.regexp_extract("text", rf"([^\x20\x09-\x0D]){SPACE}*\z", 1)
    one = one.select("conv_id", "turn", "role", "text", "times", "new", (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut"))
    ranges = [F.col("conv_id"), F.col("turn"), F.substring(said, 1, 64)]
    done = one.repartitionByRange(min(max(size // RANGE, shuffle_partitions(spark)), MOST_RANGES), *ranges).sortWithinPartitions("conv_id", "turn", said).withColumn("part", F.spark_partition_id()).checkpoint()
    # A sorted partition's first and last conversations: two values for each of a fixed number of partitions.
    known = F.struct(F.col("conv_id").isNotNull().alias("known"), "conv_id")
    bounds = [[r["a"]["conv_id"], r["b"]["conv_id"]] for r in done.groupBy("part").agg(F.min(known).alias("a"), F.max(known).alias("b")).collect()]
    seen: dict[int | None, int] = {}
    for b in bounds:
        for c in set(b):
            seen[c] = seen.get(c, 0) + 1
    return Placed(done, [c for c, n in seen.items() if n > 1])


def _among(convs: list[int | None]) -> Column:
    listed = F.coalesce(F.col("conv_id").cast("long").isin([c for c in convs if c is not None]), F.lit(False))
    return listed | (F.col("conv_id").isNull() & F.lit(None in convs))


def _step(after: np.ndarray, forced: np.ndarray, initial: np.ndarray, cut: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """The costs before one turn of many conversations, from those after it (conversation, state, ...)."""
    shape = (-1, *[1] * (after.ndim - 2))
    out = np.empty_like(after)
    for s in range(4):
        stay = after[:, s] + DELETE
        new = after[:, NEXT[s]] + REROLE + (cut * UNFINISHED).reshape(shape)
        to = KEPT[s][initial]
        kept = np.take_along_axis(after, np.maximum(to, 0).reshape(-1, 1, *[1] * (after.ndim - 2)), 1)[:, 0] + (cut * UNFINISHED).reshape(shape)
        kept = np.where((to < 0).reshape(shape), FAR, kept)
        out[:, s] = np.where(forced.reshape(shape), after[:, s], np.minimum(np.minimum(stay, new), kept))
    out += extra.reshape(-1, *[1] * (after.ndim - 1))
    return np.minimum(_inserted(out), FAR)


def _inserted(costs: np.ndarray) -> np.ndarray:
    """Costs at a place where turns may be inserted first."""
    out = costs.copy()
    out[:, 2] = np.minimum(costs[:, 2], costs[:, 3] + INSERT)
    out[:, 3] = np.minimum(costs[:, 3], costs[:, 2] + INSERT)
    for s in (0, 1):
        out[:, s] = np.minimum(costs[:, s], out[:, 2] + INSERT)
    return out


@dataclass
class Bucket:
    """Conversations (or stretches) of similar length, padded to one: arrays (turn, conversation)."""

    row: np.ndarray  # the row of the frame, -1 where padded
    forced: np.ndarray
    initial: np.ndarray
    cut: np.ndarray
    extra: np.ndarray

    def costs(self, after: np.ndarray) -> np.ndarray:
        """The backward costs (turn, conversation, state, ...), the last being `after`."""
        out = np.empty((len(self.row) + 1, *after.shape), np.int64)
        out[-1] = after
        for t in range(len(self.row) - 1, -1, -1):
            real = (self.row[t] >= 0).reshape(-1, *[1] * (after.ndim - 1))
            out[t] = np.where(real, _step(out[t + 1], self.forced[t], self.initial[t], self.cut[t], self.extra[t]), out[t + 1])
        return out

    def trace(self, costs: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
        """The states after the turns, and the edits as (conversation, turn, edit, user's?, row); `last`: conversations whose
        end this is, where turns may still be inserted."""
        state, edits = state.copy(), []
        every = np.arange(self.row.shape[1])
        for t in range(len(self.row) + 1):
            here = last if t == len(self.row) else self.row[t] >= 0
            todo = here.copy()
            while todo.any():
                c = every[todo]
                s, now = state[c], costs[t][c, state[c]]
                if t == len(self.row):
                    c, s = c[now > 0], s[now > 0]
                    todo[:] = False
                    todo[c] = True
                    pick = np.ones(len(c), int)
                else:
                    row = self.row[t][c]
                    now = now - self.extra[t][c]
                    after, mark = costs[t + 1][c], self.cut[t][c] * UNFINISHED
                    at = np.arange(len(c))
                    to = KEPT[s, self.initial[t][c]]
                    forced = self.forced[t][c]
                    deleted = np.where(forced, after[at, s], after[at, s] + DELETE)
                    kept = np.where(forced | (to < 0), FAR, after[at, np.maximum(to, 0)] + mark)
                    rerole = np.where(forced, FAR, after[at, NEXT[s]] + REROLE + mark)
                    stays = np.minimum(np.minimum(deleted, kept), rerole)
                    pick = np.select([deleted == now, stays > now, kept == now], [0, 1, 2], 3)
                    # An insertion is cheapest where no edit of the turn itself is; where both are, I comes before K and R.
                    tied = (pick > 1) & (costs[t][c, NEXT[s]] - self.extra[t][c] + INSERT == now)
                    pick = np.where(tied, 1, pick)
                if not len(c):
                    break
                row = self.row[t][c] if t < len(self.row) else np.full(len(c), -1)
                edits.append((c, np.full(len(c), t), pick, USER[s], np.where(pick == 1, -1, row)))
                kept_to = KEPT[s, self.initial[t][c]] if t < len(self.row) else s
                state[c] = np.select([pick == 0, pick == 2], [s, kept_to], NEXT[s])
                todo[c] = pick == 1
        return state, edits


def buckets(convs: np.ndarray, b: pd.DataFrame) -> Iterator[tuple[np.ndarray, Bucket]]:
    """(numbers of the conversations, Bucket) of a frame sorted by conversation; `convs` tells where each begins, and the end."""
    lengths = np.diff(convs)
    initial = b["role"].str[:1].map({"s": 0, "u": 1, "a": 2}).fillna(3).to_numpy().astype(int)
    blank, new, times = b["blank"].to_numpy().astype(bool), b["new"].to_numpy().astype(bool), b["times"].to_numpy().astype(np.int64)
    forced = blank | ~new
    extra = DELETE * np.where(forced, times, times - 1)
    power = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for p in np.unique(power):
        which = np.flatnonzero(power == p)
        t = np.arange(lengths[which].max())[:, None]
        row = np.where(t < lengths[which], convs[which] + t, -1)
        pick = lambda a, row=row: a[np.maximum(row, 0)] * (row >= 0)
        yield which, Bucket(row, pick(forced).astype(bool), pick(initial), pick(b["cut"].to_numpy().astype(bool)).astype(np.int64), pick(extra))


def _starts(b: pd.DataFrame) -> np.ndarray:
    """Where each conversation of a frame begins, and its end."""
    c = b["conv_id"]
    new = (c != c.shift()) & ~(c.isna() & c.shift().isna())
    new.iloc[:1] = True
    return np.append(np.flatnonzero(new.to_numpy()), len(b))


def _within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of whole conversations, as far as the partition holds them."""
    for b in whole_groups((x.assign(conv_=x["conv_id"].fillna("")) for x in batches), ["conv_"]):
        yield b.drop(columns="conv_").reset_index(drop=True)


def _key(part: int, conv: str | None) -> tuple[int, str | None]:
    return int(part), None if pd.isna(conv) else str(conv)


def repair(found: Placed) -> DataFrame:
    """One row for each edit, in order within (conv_id, part) and by part: turn, was (the role before; null for insertions), role and
    text (after), fault, edit (D, I, K or R) and times (deleted copies of one row are one row here)."""
    spread = {None if c is None else str(c) for c in found.spread}
    # Ids travel as text, so that nulls don't turn them into floats.
    rows = found.rows.withColumn("conv_id", F.col("conv_id").cast("string"))
    after: dict[tuple[int, str | None], list[int]] = {}
    start: dict[tuple[int, str | None], int] = {}
    if spread:
        narrow = rows.where(_among(found.spread)).select("part", "conv_id", F.substring("role", 1, 1).alias("role"), "blank", "new", "cut", "times")

        def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in _within(batches):
                convs = _starts(b)
                for which, bucket in buckets(convs, b):
                    unit = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, FAR), (len(which), 4, 4)).astype(np.int64)
                    m = bucket.costs(unit)[0].reshape(len(which), 16)
                    yield pd.DataFrame({"part": b["part"].to_numpy()[convs[which]], "conv_id": b["conv_id"].to_numpy()[convs[which]], "m": list(m)})

        stretches: dict[str | None, list[tuple[int, np.ndarray]]] = {}
        for r in narrow.mapInPandas(matrices, "part int, conv_id string, m array<long>").orderBy("part").collect():
            stretches.setdefault(r["conv_id"], []).append((r["part"], np.array(r["m"], np.int64).reshape(4, 4)))
        for conv, parts in stretches.items():
            costs = END
            for part, m in reversed(parts):
                after[part, conv] = costs.tolist()
                costs = np.minimum((m + costs).min(1), FAR)
        lasts = {(parts[-1][0], conv) for conv, parts in stretches.items()}

        def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in _within(batches):
                convs = _starts(b)
                for which, bucket in buckets(convs, b):
                    keys = [_key(b["part"].iat[k], b["conv_id"].iat[k]) for k in convs[which]]
                    costs = bucket.costs(np.array([after[k] for k in keys], np.int64))
                    to = [bucket.trace(costs, np.full(len(which), s), np.zeros(len(which), bool))[0] for s in range(4)]
                    yield pd.DataFrame({"part": [k[0] for k in keys], "conv_id": [k[1] for k in keys], "m": list(np.stack(to, 1))})

        state: dict[str | None, int] = {}
        for r in narrow.mapInPandas(maps, "part int, conv_id string, m array<long>").orderBy("part").collect():
            start[r["part"], r["conv_id"]] = state.get(r["conv_id"], 0)
            state[r["conv_id"]] = r["m"][state.get(r["conv_id"], 0)]
    else:
        lasts = set()

    def edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _within(batches):
            convs = _starts(b)
            keys = [_key(b["part"].iat[k], b["conv_id"].iat[k]) for k in convs[:-1]]
            done = []
            for which, bucket in buckets(convs, b):
                costs = bucket.costs(np.array([after.get(keys[k], END) for k in which], np.int64))
                begin = np.array([start.get(keys[k], 0) for k in which])
                ends = np.array([keys[k] not in after or keys[k] in lasts for k in which])
                _, found = bucket.trace(costs, begin, ends)
                done += [(which[c], t, np.full(len(c), n), *rest) for n, (c, t, *rest) in enumerate(found)]
            conv, turn, order, pick, user, row = (np.concatenate(x) for x in zip(*done, strict=True))
            by = np.lexsort((order, turn, conv))
            conv, pick, user, row = conv[by], pick[by], user[by], row[by]
            real = row >= 0
            at = np.where(real, row, 0)
            take = lambda name: b[name].to_numpy()[at]
            forced = real & (take("blank").astype(bool) | ~take("new").astype(bool))
            fault = np.select([real & take("blank").astype(bool), forced, real & take("cut").astype(bool)], FAULTS[1:], "")
            times = np.where(real, take("times"), 1)
            new_role = np.where(user, "user", "assistant")
            out = pd.DataFrame(
                {
                    "conv_id": b["conv_id"].to_numpy()[convs[conv]],
                    "part": b["part"].to_numpy()[convs[conv]],
                    "turn": pd.Series(take("turn"), dtype=object).where(real, None),
                    "was": pd.Series(take("role"), dtype=object).where(real, None),
                    "role": np.where((pick == 1) | (pick == 3), new_role, take("role")),
                    "text": np.where(real, take("text"), ""),
                    "fault": fault,
                    "edit": EDITS[pick],
                    "times": np.where(forced, times, 1),
                }
            )
            # The other copies of a row that isn't forced out are duplicates, deleted right after it.
            copies = np.flatnonzero(real & ~forced & (times > 1))
            more = out.iloc[copies].assign(edit="D", fault="duplicate", times=times[copies] - 1)
            more["role"] = more["was"]
            yield pd.concat([out, more]).sort_index(kind="stable")

    read = rows.withColumn("turn", F.col("turn").cast("string"))
    return read.mapInPandas(edits, ROWS).withColumns({"conv_id": F.col("conv_id").cast("long"), "turn": F.col("turn").cast("long")})


LEGAL = {"su", "ua", "au"}
PIECE = 1 << 20


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    """Of each conversation's edits in a partition: counts, audit and repaired text, in pieces of some PIECE characters."""
    now: dict | None = None
    for b in batches:
        for conv, part, turn, was, role, text, fault, edit, times in b[["conv_id", "part", "turn", "was", "role", "text", "fault", "edit", "times"]].itertuples(index=False):
            conv, turn, was = (None if pd.isna(x) else x for x in (conv, turn, was))
            if now is None or (conv, part) != (now["conv_id"], now["part"]):
                if now is not None:
                    yield now
                now = {"conv_id": conv, "part": part, "k": 0} | _fresh()
            elif now["size"] > PIECE:
                yield now
                now = {"conv_id": conv, "part": part, "k": now["k"] + 1} | _fresh()
            if was is not None:
                initial = was[:1]
                if now["rows"]:
                    now["illegal"] += now["tail"] + initial not in LEGAL
                else:
                    now["head"] = initial
                now["illegal"] += (times - 1) * (initial * 2 not in LEGAL)
                now["tail"], now["rows"] = initial, now["rows"] + times
                if turn is not None:
                    turn = int(turn)
                    now["turns"] += now["high"] is None or turn != now["high"]
                    now["low"], now["high"] = turn if now["low"] is None else now["low"], turn
            if fault:
                now[fault] += times
            now["cost"] += times * {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + UNFINISHED * (fault == "truncated" and edit != "D")
            now["audit"].append(edit * times)
            if edit != "D":
                said = f"{role}:{text}"
                now["said"].append(said)
                now["size"] += len(said) + 1
            now["size"] += 1
    if now is not None:
        yield now


def _fresh() -> dict:
    return {"rows": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "head": None, "tail": None, "low": None, "high": None, "turns": 0, "cost": 0, "audit": [], "said": [], "size": 0}


RESULT = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns", "cost")
_PIECES = "conv_id string, part int, k int, rows long, blank long, duplicate long, truncated long, illegal long, turns long, cost long, head string, tail string, low string, high string, audit string, said array<string>"


def _whole(pieces: Iterator[dict]) -> Iterator[pd.DataFrame]:
    """The result of each conversation, from its pieces in order."""
    rows: list[tuple] = []
    now: dict = {}

    def close() -> None:
        gaps = 0 if now["low"] is None else min(now["high"] - now["low"] + 1 - now["turns"], (1 << 63) - 1)
        rows.append((now["conv_id"], gaps, now["blank"], now["duplicate"], now["truncated"], now["illegal"], now["cost"], "".join(now["audit"]), now["hash"].hexdigest()))

    for p in pieces:
        if now and p["conv_id"] != now["conv_id"]:
            close()
            now = {}
        if not now:
            now = {"conv_id": p["conv_id"], "hash": sha256(), "any": False} | _fresh()
        for c in _COUNTS:
            now[c] += p[c]
        if p["head"] is not None:
            now["illegal"] += now["tail"] is not None and now["tail"] + p["head"] not in LEGAL
            now["tail"] = p["tail"]
        if p["low"] is not None:
            now["turns"] -= now["high"] is not None and now["high"] == p["low"]
            now["low"], now["high"] = p["low"] if now["low"] is None else now["low"], p["high"]
        now["audit"] += p["audit"]
        for said in p["said"]:
            now["hash"].update(("\n" if now["any"] else "").encode() + said.encode("utf-8", "surrogatepass"))
            now["any"] = True
        if len(rows) >= 5000:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])
            rows = []
    if now:
        close()
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])


def digest(found: Placed, ids: DataFrame) -> DataFrame:
    """The query's row for every conversation of ids(conv_id): counts, cost, audit and the hash of the repaired text. A conversation that several partitions hold is
    put together from pieces read in order; its hash and its audit string are one value each, all else of it is spread."""
    far = _among(found.spread)
    text = {c: F.col(c).cast("string") for c in ("conv_id", "turn")}
    done = repair(Placed(found.rows.where(~far), [])).withColumns(text).mapInPandas(lambda batches: _whole(_pieces(batches)), RESULT)
    if found.spread:
        columns = [c.split()[0] for c in _PIECES.split(", ")]

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in _pieces(batches):
                text = {c: None if p[c] is None else str(p[c]) for c in ("low", "high")}
                yield pd.DataFrame([[(p | text | {"audit": "".join(p["audit"])})[c] for c in columns]], columns=columns)

        def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def each() -> Iterator[dict]:
                for b in batches:
                    for p in b.to_dict("records"):
                        p |= {c: None if pd.isna(p[c]) else p[c] for c in ("conv_id", "head", "tail", "low", "high")}
                        yield p | {c: None if p[c] is None else int(p[c]) for c in ("low", "high")} | {"audit": [p["audit"]]}

            yield from _whole(each())

        pieces = repair(Placed(found.rows.where(far), found.spread)).withColumns(text).mapInPandas(cut, _PIECES)
        done = done.unionByName(pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "k").mapInPandas(join, RESULT))
    done = done.withColumnRenamed("conv_id", "key")
    every = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    joined = every.join(done, F.col("conv_id").cast("string").eqNullSafe(F.col("key")), "left")
    return joined.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256"))


def conversations(rows: DataFrame) -> DataFrame:
    """The general entry: rows(conv_id, turn, role, text) to repair's edits."""
    read = [F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")] + [F.col(c).cast("string").alias(c) for c in ("role", "text")]
    return repair(placed(rows.select(*read, F.lit(1).alias("times"))))


def restored(edits: DataFrame) -> DataFrame:
    """conv_id, part, turn, role, text of the conversations after the edits, whose order within (conv_id, part) is kept."""
    return edits.where("edit <> 'D'").select("conv_id", "part", "turn", "role", "text")
