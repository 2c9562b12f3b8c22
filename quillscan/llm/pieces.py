"""Operator 5: SentencePiece encoding and decoding by a max-plus parallel scan.

A segmentation is a path through the lattice of vocabulary pieces over the normalised text. A giant document is cut
into chunks at fixed code points. Each chunk, on its own, yields a transfer matrix in the max-plus semiring from its
entry states to its exit states; a boundary state says which piece lies over (or ends at) the boundary and how far it
reaches beyond it. The matrices of a document combine associatively, which gives the states its best path takes at every
boundary, and then each chunk is traced back independently of all others.

Unigram models: an edge weighs its piece's score, and a boundary state is the overhang alone. BPE models: an edge
weighs nothing, but two neighbouring pieces are only allowed when merging their joined text gives exactly these two
(weight minus infinity otherwise). A sequence of pieces is the BPE encoding just when all its neighbours are allowed,
so the one finite path is the encoding, and a boundary state also names the piece.

No piece spans from another character to the space sign, so all paths meet before each space sign: there the matrix has rank
one, the words between two such places are solved once (and remembered, up to a bound), and only the word at a
chunk's start is solved for each entry state. Words are cut further where two neighbouring characters stand together in no
piece, as between a letter and a comma: no piece and no merge crosses such a cut. Characters without a piece become their UTF-8
bytes' pieces.

Defined results: an empty table gives no rows. A null or empty text has no tokens. Very long texts are cut into chunks as above,
never short. Of several unigram segmentations with equal weight one is
taken, the same one for equal texts and chunk sizes. Decoding gives the normalised text back: U+2581, the space sign,
returns as a space. Repeated rows get one result row each; null ids are kept. Extra columns are ignored by `encode`.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.llm.common import sliced

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_LOADED: dict[str, Model] = {}
#: Remembered words and neighbour tests of one process; beyond it they are forgotten and found again.
WORDS, PAIRS = 250_000, 500_000
#: Chunks whose matrices one task combines; with two levels that is enough for any string Spark can hold.
GROUP = 256
#: Characters of text encoded before what was found is handed on.
SLICE = 1_000_000
State = tuple[int, int]  # code points a piece reaches beyond the boundary; the piece (0: any)
Matrix = dict[State, dict[State, float]]


class Model:
    """A SentencePiece model's pieces with the lattice's two questions: an edge's weight, and which edges may follow."""

    def __init__(self, proto: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(proto)
        if m.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models")
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or not m.normalizer_spec.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models without a character map that keep and escape white space")
        self.bpe = m.trainer_spec.model_type == 2
        self.prefix = SPACE if m.normalizer_spec.add_dummy_prefix else ""
        kinds = pb.ModelProto.SentencePiece
        normal = [(k, p.piece, p.score) for k, p in enumerate(m.pieces) if p.type == kinds.NORMAL]
        self.ids = {p: k for k, p, _ in normal}
        self.score = {k: s for k, _, s in normal}
        self.text = {k: p for k, p, _ in normal}
        self.longest = max((len(p) for p in self.ids), default=1)
        self.begins = {p[:n] for p in self.ids for n in range(1, len(p) + 1)}
        self.unknown = next((k for k, p in enumerate(m.pieces) if p.type == kinds.UNKNOWN), 0)
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(m.pieces) if p.type == kinds.BYTE}
        self.unknown_score = min(self.score.values(), default=0.0) - 10.0
        self.meet = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.raw = [p.piece.replace(SPACE, " ").encode() if p.type == kinds.NORMAL else b"" for p in m.pieces]
        for b, k in self.bytes.items():
            self.raw[k] = bytes([b])
        self.raw[self.unknown] = " ⁇ ".encode()
        self.sizes = np.array([len(r) for r in self.raw], np.int64)
        self.starts = self.sizes.cumsum() - self.sizes
        self.joined = np.frombuffer(b"".join(self.raw), np.uint8)
        self.pairs: dict[int, bool] = {}
        self.spines: dict[State, list[tuple[str, float, float]]] = {}
        # A node maps a character to the node of what follows, and "" to the (length, piece) of all pieces that begin a
        # text which begins like this, the longest first.
        self.trie: dict = {"": ()}
        for p in sorted(self.begins, key=len):
            node = self.trie
            for c in p[:-1]:
                node = node[c]
            own = ((len(p), self.ids[p]),) if p in self.ids else ((1, -ord(p) - 1),) if len(p) == 1 else ()
            node[p[-1]] = {"": own + node[""]}
        self.parts = self._cutter()
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _cutter(self) -> re.Pattern:
        """Splits text into runs that no piece crosses: each is some space signs and characters which pieces join, directly or by
        way of others. A character that no piece joins to any stands alone."""
        joins: dict[str, str] = {}

        def root(c: str) -> str:
            while (up := joins.setdefault(c, c)) != c:
                joins[c] = joins[up]
                c = up
            return c

        joined: set[str] = set()
        for p in self.ids:
            body = p.lstrip(SPACE)
            for a, b in zip(body, body[1:], strict=False):
                joined |= {a, b}
                joins[root(a)] = root(b)
        groups: dict[str, list[str]] = {}
        for c in sorted(joined):
            groups.setdefault(root(c), []).append(c)
        sets = sorted(groups.values(), key=len, reverse=True)
        sets = [*sets[:8], [c for more in sets[8:] for c in more]] if len(sets) > 8 else sets
        runs = [f"[{''.join(map(re.escape, c))}]+" for c in sets] + [f"[^{SPACE}{''.join(map(re.escape, sorted(joined)))}]"]
        return re.compile(f"{SPACE}*(?:{'|'.join(runs)})|{SPACE}+")

    def follows(self, a: int, b: int) -> bool:
        """Whether piece b may stand after piece a (pieces below 0 are characters without one; 0 is a text's start)."""
        if not self.bpe or a <= 0 or b <= 0:
            return True
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._allowed(a, b)
        return found

    def _merges(self, s: str) -> list[tuple[str, str]]:
        """The merges of the text s in their order, the best pair first, of equal ones the leftmost."""
        parts, done = list(s), []
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                break
            done.append((parts[at], parts[at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return done

    def _spine(self, k: int, side: int) -> list[tuple[str, float, float]]:
        """(piece, its own score, that of the merge that ends it) of what stands at one side of piece k in turn, from k
        down to its outermost character; empty when merging doesn't build k."""
        found = self.spines.get((k, side))
        if found is None:
            found, s, ends = [], self.text[k], -np.inf
            while True:
                own = self.score[self.ids[s]] if s in self.ids and len(s) > 1 else np.inf
                found.append((s, own, ends))
                if len(s) == 1:
                    break
                merges = self._merges(s)
                if len(merges) != len(s) - 1:
                    found = []
                    break
                s, ends = merges[-1][side], own
            self.spines[k, side] = found
        return found

    def _allowed(self, a: int, b: int) -> bool:
        """Whether no merge over the cut between a and b comes before those that end the pieces beside it."""
        if self.text[b][0] == SPACE and self.text[a][-1] != SPACE and self.meet:
            return True
        left, right = self._spine(a, 1), self._spine(b, 0)
        if not left or not right:
            return False
        for x, made_x, ends_x in left:
            for y, made_y, ends_y in right:
                k = self.ids.get(x + y)
                if k is not None and min(made_x, made_y) > max(ends_x, ends_y):
                    r = self.score[k]
                    if r == ends_x or self.score[k] == made_x or r == made_y:  # equal scores: only trying shows
                        return self._tried(a, b)
                    if r > ends_x and r >= ends_y:
                        return False
        return True

    def _tried(self, a: int, b: int) -> bool:
        """Whether merging the joined text of a and b ends in exactly these two."""
        s, n = self.text[a] + self.text[b], len(self.text[a])
        parts = list(s)
        for x, y in self._merges(s):
            at = next(k for k in range(len(parts) - 1) if parts[k] == x and parts[k + 1] == y)
            parts[at : at + 2] = [x + y]
        return parts == [s[:n], s[n:]]

    def edges(self, s: str, i: int) -> list[tuple[int, int, float]]:
        """(end, piece, weight) of the pieces that start at i, shortest first."""
        out, begins, ids = [], self.begins, self.ids
        for j in range(i + 1, min(i + self.longest, len(s)) + 1):
            p = s[i:j]
            if p not in begins:
                break
            k = ids.get(p)
            if k is not None:
                out.append((j, k, 0.0 if self.bpe else self.score[k]))
        if not out or out[0][0] != i + 1:
            out.insert(0, (i + 1, -ord(s[i]) - 1, 0.0 if self.bpe else self.unknown_score))
        return out

    def paths(self, s: str, entries: list[tuple[int, int, float]], stop: int) -> dict[int, tuple[float, int, int]]:
        """position -> (weight, start, piece) of the best path there, from entries (position, last piece, weight), over
        pieces that start before stop. For BPE each call has one entry, and so one allowed path to each position."""
        best = {p: (w, -1, t) for p, t, w in entries}
        at, end = min(best), len(s)
        while at < stop:
            here = best.get(at)
            if here is not None:
                w, _, last = here
                for j, t, e in self.edges(s, at):
                    old = best.get(j)
                    if (old is None or w + e > old[0]) and self.follows(last, t):
                        best[j] = (w + e, at, t)
            at += 1
            if at > end:
                break
        return best

    def trace(self, best: dict[int, tuple[float, int, int]], end: int) -> list[int]:
        out = []
        while best[end][1] >= 0:
            _, start, t = best[end]
            out.append(t)
            end = start
        return out[::-1]

    def word(self, w: str) -> bytes:
        """The ids, as 32-bit numbers, of what stands between two places where all paths meet."""
        got = self.words.get(w)
        if got is None:
            got = self.older.get(w)
            if got is None:
                got = self.spelled(self._bpe_word(w) if self.bpe else self.trace(self.paths(w, [(0, 0, 0.0)], len(w)), len(w)))
            if len(w) <= 64:
                if len(self.words) >= WORDS:
                    self.older, self.words = self.words, {}
                self.words[w] = got
        return got

    def all_words(self, s: str) -> bytes:
        """The ids of a text that ends where all paths meet, word by word."""
        ws = self.parts.findall(s)
        got = list(map(self.words.get, ws))
        if None in got:
            got = [self.word(w) if x is None else x for w, x in zip(ws, got, strict=True)]
        return b"".join(got)

    def _bpe_word(self, w: str) -> list[int]:
        """`paths` and `trace` for a BPE model: as only one path is allowed, it is followed depth first, the longest piece
        first, and a piece's end from which the word's end can't be reached isn't tried again."""
        n, trie, longest, pairs = len(w), self.trie, self.longest, self.pairs
        out: list[int] = []
        tried: list[tuple] = []  # (place, piece before it, pieces there, which was taken) of each step
        dead: set[tuple[int, int]] = set()
        at = last = 0
        while at < n:
            node = trie
            for c in w[at : at + longest]:
                if (nxt := node.get(c)) is None:
                    break
                node = nxt
            found, k = node[""] or ((1, -ord(w[at]) - 1),), 0
            while True:
                size = len(found)
                while k < size:
                    length, piece = found[k]
                    if (last <= 0 or piece <= 0 or (ok := pairs.get(last << 32 | piece)) or (ok is None and self.follows(last, piece))) and (not dead or (at + length, piece) not in dead):
                        break
                    k += 1
                else:
                    dead.add((at, last))
                    out.pop()
                    at, last, found, k = tried.pop()
                    k += 1
                    continue
                break
            tried.append((at, last, found, k))
            out.append(piece)
            at += length
            last = piece
        return out

    def normalised(self, text: str) -> str:
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def spelled(self, tokens: list[int]) -> bytes:
        """Piece ids as 32-bit numbers, characters without a piece as bytes' pieces."""
        if min(tokens, default=1) > 0:
            return array("i", tokens).tobytes()
        out: list[int] = []
        for t in tokens:
            if t > 0:
                out.append(t)
            else:
                known = [self.bytes.get(b) for b in chr(-t - 1).encode("utf-8", "surrogatepass")]
                out += known if None not in known else [self.unknown]
        return array("i", out).tobytes()

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int32)
        size = self.sizes[ids]
        ends = size.cumsum()
        total = int(ends[-1]) if len(ends) else 0
        text = self.joined[np.repeat(self.starts[ids] - ends + size, size) + np.arange(total)].tobytes().decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text

    # A chunk is (left, body, right): up to longest - 1 code points of what stands around the body.

    def _head(self, body: str) -> int:
        """The first place inside the body where all paths meet; the body's length if there is none."""
        if self.meet:
            for k in range(1, len(body)):
                if body[k] == SPACE and body[k - 1] != SPACE:
                    return k
        return len(body)

    def entries(self, left: str, body: str, right: str, first: bool) -> list[State]:
        if first:
            return [(0, 0)]
        s, b, out = left + body + right, len(left), set()
        for i in range(max(0, b - self.longest), b):
            out |= {(j - b, t if self.bpe else 0) for j, t, _ in self.edges(s, i) if j >= b}
        return sorted(out)

    def exits(self, best: dict[int, tuple[float, int, int]], end: int, last: bool) -> dict[State, float]:
        out: dict[State, float] = {}
        for p, (w, _, t) in best.items():
            if p >= end and (p == end or not last):
                out[p - end, t if self.bpe else 0] = w
        return out

    def transfer(self, left: str, body: str, right: str, first: bool, last: bool) -> Matrix:
        """The chunk's max-plus matrix, as rows of its finite cells."""
        s, b = left + body + right, len(left)
        end, meet = b + len(body), b + self._head(body)
        tail, out = None, {}
        for over, t in self.entries(left, body, right, first):
            row: dict[State, float] = {}
            if b + over > meet or meet == end:
                best = self._all_exits(s, b + over, t, end)
                row = {(p - end, q if self.bpe else 0): w for (p, q), w in best.items() if p == end or not last}
            else:
                head = self.paths(s, [(b + over, t, 0.0)], meet)
                if meet in head:
                    if tail is None:
                        tail = self._tail(s, meet, end)
                    row = {(p - end, q if self.bpe else 0): head[meet][0] + w for (p, q), w in tail.items() if p == end or not last}
            if row:
                out[over, t] = row
        return out

    def _tail(self, s: str, meet: int, end: int) -> dict[State, float]:
        """`_all_exits` from a place where all paths meet, by way of the last such place."""
        words = _WORD.findall(s[meet:end])
        inner = 0.0 if self.bpe else sum(self.paths(w, [(0, 0, 0.0)], len(w))[len(w)][0] for w in words[:-1])
        return {k: inner + w for k, w in self._all_exits(s, end - len(words[-1]), 0, end).items()}

    def _all_exits(self, s: str, start: int, piece: int, end: int) -> dict[State, float]:
        """Every (position, piece) at or over the end that a path from start reaches, with the best weight."""
        out: dict[State, float] = {}
        if start >= end:
            return {(start, piece): 0.0}
        best = self.paths(s, [(start, piece, 0.0)], end)
        for i in range(max(start, end - self.longest), end):
            if i in best:
                w, _, last = best[i]
                for j, t, e in self.edges(s, i):
                    if j >= end and self.follows(last, t):
                        key = (j, t if self.bpe else 0)
                        out[key] = max(out.get(key, -np.inf), w + e)
        return out

    def backtrace(self, left: str, body: str, right: str, way: State, out: State) -> bytes:
        """The ids of the pieces that start in the chunk, on the best path from the entry state to the exit state."""
        s, b = left + body + right, len(left)
        end, meet, start, goal = b + len(body), b + self._head(body), b + way[0], b + len(body) + out[0]
        if start >= end:
            return b""
        if start > meet or meet == end:
            return self.spelled(self._to(s, start, way[1], end, goal, out[1]))
        head = self.trace(self.paths(s, [(start, way[1], 0.0)], meet), meet)
        edge = end - len(_WORD.findall(s[meet:end])[-1])
        return self.spelled(head) + self.all_words(s[meet:edge]) + self.spelled(self._to(s, edge, 0, end, goal, out[1]))

    def _to(self, s: str, start: int, last: int, end: int, goal: int, piece: int) -> list[int]:
        best = self.paths(s, [(start, last, 0.0)], end)
        if not self.bpe:
            return self.trace(best, goal)
        return [*self.trace(best, goal - (len(self.text[piece]) if piece > 0 else 1)), piece]

    def encode(self, text: str, chunk_chars: int = 1 << 16) -> list[int]:
        """One whole text in one process: chunks, transfer matrices, scan, backtrace."""
        chunks = cut(self.normalised(text), chunk_chars, self.longest)
        n = len(chunks)
        if not n:
            ids = b""
        elif n > 1:
            plan = scan([self.transfer(*c, k == 0, k == n - 1) for k, c in enumerate(chunks)])
            ids = b"".join(self.backtrace(*c, way, out) for c, (way, out) in zip(chunks, plan, strict=True))
        elif self.meet:
            ids = self.all_words(chunks[0][1])
        else:
            body = chunks[0][1]
            ids = self.spelled(self.trace(self.paths(body, [(0, 0, 0.0)], len(body)), len(body)))
        return np.frombuffer(ids, np.int32)


def cut(s: str, size: int, longest: int) -> list[tuple[str, str, str]]:
    return [(s[max(0, k - longest) : k], s[k : k + size], s[k + size : k + size + longest]) for k in range(0, len(s), size)]


def combine(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product; associative, so that a document's matrices may be combined in any grouping."""
    out: Matrix = {}
    for i, row in a.items():
        got: dict[State, float] = {}
        for m, w in row.items():
            for j, v in b.get(m, {}).items():
                if w + v > got.get(j, -np.inf):
                    got[j] = w + v
        if got:
            out[i] = got
    return out


def combined(matrices: list[Matrix]) -> Matrix:
    """The product of a run of matrices, halves first."""
    half = len(matrices) // 2
    return matrices[0] if len(matrices) == 1 else combine(combined(matrices[:half]), combined(matrices[half:]))


def scan(matrices: list[Matrix], way: State = (0, 0), out: State | None = None) -> list[tuple[State, State]]:
    """The entry and exit state of each chunk in a run of chunks, on the best path from a state to another (none: any)."""
    before: list[dict[State, float]] = [{way: 0.0}]
    for m in matrices:
        row = combine({way: before[-1]}, m)
        before.append(next(iter(row.values()), {}))
    if out is None:
        out = min(before[-1], key=lambda s: -before[-1][s])
    plan = []
    for m, prior in zip(reversed(matrices), reversed(before[:-1]), strict=True):
        ways = [(i, w) for i, w in prior.items() if out in m.get(i, {})]
        way = min(ways, key=lambda x: -(x[1] + m[x[0]][out]))[0]
        plan.append((way, out))
        out = way
    return plan[::-1]


def load(source: str | Broadcast) -> Model:
    """A model from a file's path or from its broadcast bytes, made once in each process."""
    proto = source.value if isinstance(source, Broadcast) else Path(source).read_bytes()
    name = hashlib.sha256(proto).hexdigest()
    if name not in _LOADED:
        _LOADED[name] = Model(proto)
    return _LOADED[name]


def shipped(docs: DataFrame, path: str) -> Broadcast:
    """The model file, read where the driver runs; it is some hundred kilobytes, whatever the corpus."""
    return docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())


def _encoded(pending: list[tuple], ids: list[np.ndarray]) -> pa.RecordBatch:
    """(doc_id, whether the round trip held) and the ids of some rows as one Arrow batch."""
    sizes = np.array([len(x) for x in ids], np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], sizes.cumsum()]), pa.int32()), pa.array(np.concatenate(ids)))
    columns = [pa.array([i for i, _ in pending], pa.int64()), pa.array(sizes), lists, pa.array([g for _, g in pending], pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "round_trip"])


def encode(docs: DataFrame, model: str = MODEL, chunk_chars: int = 1 << 16) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip (decoding the ids gives the normalised text back) for every row of docs.

    A document of one chunk is encoded where it is read. The chunks of the others are spread over the cluster. Their matrices
    are combined in groups of GROUP chunks, each group in a task of its own; the groups' products of a document are scanned, and each
    group then finds the states inside it."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    giant = F.length("text") >= chunk_chars
    shape = "doc_id long, n_tokens long, ids array<int>, round_trip boolean"
    held, group = shipped(docs, model), GROUP

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(held)
        pending, found, size = [], [], 0
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for k in range(len(b)):  # one text at a time becomes a Python string
                text = texts[k].as_py()
                got = m.encode(text, 2 * chunk_chars)
                pending.append((ids[k].as_py(), m.decode(got) == text.replace(SPACE, " ")))
                found.append(got)
                size += len(text) + 64
                if size >= SLICE:
                    yield _encoded(pending, found)
                    pending, found, size = [], [], 0
        if pending:
            yield _encoded(pending, found)

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = load(held)
        for b in batches:
            for key, text in zip(b["key"], b["text"], strict=True):
                parts = cut(m.normalised(text), chunk_chars, m.longest)
                for k in range(0, len(parts), 64):
                    yield pd.DataFrame([(key, i // group, i, len(parts), *c) for i, c in enumerate(parts[k : k + 64], k)], columns=["key", "g", "k", "n", "l", "body", "r"])

    def transfers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = load(held)
        for b in sliced(batches, "body"):
            yield pd.DataFrame({"key": b["key"], "g": b["g"], "k": b["k"], "m": [pickle.dumps(m.transfer(c.l, c.body, c.r, c.k == 0, c.k == c.n - 1)) for c in b.itertuples()]})

    def product(b: pd.DataFrame) -> pd.DataFrame:
        found = [pickle.loads(x) for x in b.sort_values("k")["m"]]
        return pd.DataFrame({"key": b["key"].iloc[:1], "g": b["g"].iloc[:1], "m": [pickle.dumps(combined(found))]})

    def over_groups(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("g")
        return pd.DataFrame({"key": b["key"], "g": b["g"], "way": [pickle.dumps(x) for x in scan([pickle.loads(x) for x in b["m"]])]})

    def inside(b: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("k")
        plan = scan([pickle.loads(x) for x in b["m"]], *pickle.loads(ends["way"].iloc[0])) if len(b) else []
        return pd.DataFrame({"key": b["key"], "k": b["k"], "way": [pickle.dumps(x) for x in plan]})

    def traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = load(held)
        for b in sliced(batches, "body"):
            out = []
            for c in b.itertuples():
                tokens = m.backtrace(c.l, c.body, c.r, *pickle.loads(c.way))
                out.append((c.key, c.k, np.frombuffer(tokens, np.int32)))
            yield pd.DataFrame(out, columns=["key", "k", "ids"])

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = load(held)
        for b in sliced(batches, "text"):
            good = [m.decode(x) == t.replace(SPACE, " ") for x, t in zip(b["ids"], b["text"], strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [len(x) for x in b["ids"]], "ids": b["ids"], "round_trip": good, "copies": b["copies"]})

    small = read.where(~giant).mapInArrow(whole, shape)
    large = read.where(giant).withColumn("key", F.sha2(F.col("text"), 256)).groupBy("key").agg(F.first("text").alias("text"), F.collect_list(F.struct("doc_id")).alias("copies"))
    parts = large.select("key", "text").mapInPandas(chunks, "key string, g int, k int, n int, l string, body string, r string").repartition("key", "k")
    matrices = parts.mapInPandas(transfers, "key string, g int, k int, m binary")
    ends = matrices.groupBy("key", "g").applyInPandas(product, "key string, g int, m binary").groupBy("key").applyInPandas(over_groups, "key string, g int, way binary")
    ways = matrices.groupBy("key", "g").cogroup(ends.groupBy("key", "g")).applyInPandas(inside, "key string, k int, way binary")
    ids = parts.join(ways, ["key", "k"]).mapInPandas(traced, "key string, k int, ids array<int>")
    ids = ids.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    done = large.join(ids, "key").select(F.lit(0).cast("long").alias("doc_id"), "text", "ids", "copies").mapInPandas(decoded, shape + ", copies array<struct<doc_id: bigint>>")
    done = done.select(F.explode("copies").alias("copy"), "n_tokens", "ids", "round_trip").select("copy.doc_id", "n_tokens", "ids", "round_trip")
    return small.unionByName(done)


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and the text of tokens(doc_id, ids)."""

    held = shipped(tokens, model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = load(held)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [m.decode(x) if x is not None else "" for x in b["ids"]]})

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInPandas(run, "doc_id long, text string")
