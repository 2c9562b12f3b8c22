"""Operator 10: token counts by offset-mapped attribution. Each whole document is encoded once; the tokens' character
spans are then interval-joined to the document's sections, and a token that crosses a boundary is allocated by an
explicit rule.

The vocabulary is byte-level, so the tokens' bytes add up to the document's UTF-8 bytes and their spans follow from
the cumulative lengths; a byte offset maps to the code point it lies in. Sections are half-open intervals of code
points. The interval join is a merge of two sorted lists (searchsorted), never a product.

Rules: `start` gives a crossing token to the section that holds its first code point, `end` to that of its last,
`majority` to the section with most of its code points (ties: the earlier one), `shared` splits it in proportion to
its code points in each section. Under every rule a document's counts sum to its tokens.

Defined results: an empty table gives no rows, and very long texts are read whole; a null or empty text has no tokens and no sections. Default sections are lines, a line feed belonging
to the line it ends; text after the last line feed is a section. Special tokens' strings are ordinary text. Repeated
rows count once each. Extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A fixed value: how this vocabulary's texts are cut into words before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict[str, tuple] = {}


def load(path: str) -> tuple:
    """(encoding, length in bytes of each token), once for each process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for k, v in ranks.items():
            lengths[v] = len(k)
        _LOADED[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths
    return _LOADED[path]


def token_spans(text: str, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last code point (inclusive) of every token."""
    encoding, lengths = load(path)
    ends = lengths[np.asarray(encoding.encode_to_numpy(text, disallowed_special=()), np.int64)].cumsum()
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    if not len(raw):
        return ends, ends
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    if len(raw) == len(text):
        return starts, ends - 1
    point = np.cumsum((raw & 0xC0) != 0x80) - 1
    return point[starts], point[ends - 1]


def line_bounds(text: str) -> np.ndarray:
    """The code point after each line."""
    if not text:
        return np.zeros(0, np.int64)
    if text.isascii():
        at = np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 10) + 1
    else:
        at = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10) + 1
    return at if len(at) and at[-1] == len(text) else np.append(at, len(text))


def attribute(first: np.ndarray, last: np.ndarray, ends: np.ndarray, rule: str = "start") -> np.ndarray:
    """Tokens of each section, sections ending before the code points `ends` and starting where the one before ends."""
    a, b = np.searchsorted(ends, first, side="right"), np.searchsorted(ends, last, side="right")
    n = len(ends)
    if rule == "start":
        return np.bincount(a, minlength=n).astype(float)
    if rule == "end":
        return np.bincount(b, minlength=n).astype(float)
    if rule not in ("majority", "shared"):
        raise ValueError(f"unknown rule {rule}")
    out = np.bincount(a[a == b], minlength=n).astype(float)
    begin = np.concatenate([[0], ends[:-1]])
    for k in np.flatnonzero(a != b):
        inside = np.minimum(ends[a[k] : b[k] + 1], last[k] + 1) - np.maximum(begin[a[k] : b[k] + 1], first[k])
        if rule == "shared":
            out[a[k] : b[k] + 1] += inside / inside.sum()
        else:
            out[a[k] + int(inside.argmax())] += 1
    return out


def count_tokens(docs: DataFrame, rule: str = "start", vocabulary: str = VOCABULARY, bounds: Callable[[str], np.ndarray] = line_bounds) -> DataFrame:
    """doc_id, n_tokens, n_sections, n_crossing (tokens over a boundary) and section_tokens for every row of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["text"]:
                t = t or ""
                first, last = token_spans(t, vocabulary)
                ends = bounds(t)
                out.append((len(first), len(ends), int((np.searchsorted(ends, first, "right") != np.searchsorted(ends, last, "right")).sum()), attribute(first, last, ends, rule)))
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [x[0] for x in out], "n_sections": [x[1] for x in out], "n_crossing": [x[2] for x in out], "section_tokens": [x[3] for x in out]})

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return read.mapInPandas(run, "doc_id long, n_tokens long, n_sections long, n_crossing long, section_tokens array<double>")


def section_rows(counts: DataFrame) -> DataFrame:
    """The result of count_tokens with a row for each section."""
    return counts.select("doc_id", F.posexplode("section_tokens").alias("section", "n_tokens"))
