"""Operator 13: license scans. Short notices are searched with a bounded number of edits: each is split into one seed more
than it may have edits, so that a match holds at least one seed unchanged (the pigeonhole principle); exact searches for
the seeds give candidate windows, and the regex library's bounded-error matching verifies each and counts its edits.

Text is compared as words: A-Z lower-cased, runs of anything but ASCII letters, digits and non-ASCII characters are
one space. Edits are of characters of that form. The words that tell one license from another (`core`) must stand unchanged
in the matched words, so that an edit never turns one license into another. Base phrases are found exactly, at every
place where their words stand consecutively, and their labels are always among the results.

Every row is worked on alone, whole, in its own Arrow slice: no shuffle, no state.

Defined results: an empty table gives no rows; a null text counts as empty (no words, null first and last word, empty labels,
score 0). Very long texts are scanned whole. Repeated rows are scanned alike. Matches of one notice don't overlap (the
leftmost counts); those of different notices may, and all are kept. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.llm.common import sliced

# The base phrases with their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


@dataclass(frozen=True)
class Notice:
    """A short notice in words, its label, and the words in it that must stand unchanged; one edit is allowed for each
    `per_edit` characters, and no more than `most`."""

    words: str
    label: str
    core: str
    per_edit: int = 9
    most: int = 4

    @property
    def edits(self) -> int:
        return min(len(self.words) // self.per_edit, self.most)

    def seeds(self) -> list[tuple[int, str]]:
        """(offset, text) of edits + 1 parts of nearly equal length."""
        n, parts = len(self.words), self.edits + 1
        cuts = [n * k // parts for k in range(parts + 1)]
        return [(a, self.words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


#: Well-known short notices and the labels they stand for.
NOTICES = (
    Notice("under the mit license", "mit", "mit"),
    Notice("apache license version 2", "apache-2", "version 2"),
    Notice("gnu general public license version 3", "gpl-3", "version 3"),
    Notice("gnu general public license version 2", "gpl-2", "version 2"),
    Notice("released under the mit license", "mit", "mit"),
    Notice("licensed under the mit license", "mit", "mit"),
    Notice("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", "free of charge"),
    Notice("licensed under the apache license version 2 0", "apache-2", "version 2"),
    Notice("licensed under cc by nc 4 0", "cc-by-nc", "cc by nc"),
    Notice("creative commons attribution noncommercial", "cc-by-nc", "noncommercial"),
    Notice("licensed under the gnu general public license version 3", "gpl-3", "version 3"),
    Notice("licensed under the gnu general public license version 2", "gpl-2", "version 2"),
    Notice("licensed under the gnu lesser general public license", "lgpl", "lesser"),
    Notice("licensed under the gnu affero general public license", "agpl", "affero"),
    Notice("redistribution and use in source and binary forms with or without modification are permitted", "bsd", "binary"),
    Notice("this source code form is subject to the terms of the mozilla public license", "mpl", "mozilla"),
    Notice("permission to use copy modify and or distribute this software for any purpose", "isc", "any purpose"),
    Notice("this is free and unencumbered software released into the public domain", "unlicense", "public domain"),
)


@dataclass(frozen=True)
class Match:
    """Words `first` to `last` (inclusive) hold the notice with so many edits."""

    label: str
    first: int
    last: int
    edits: int
    size: int
    base: bool


@lru_cache(maxsize=8)
def _ready(notices: tuple[Notice, ...]) -> list[tuple]:
    """(notice, byte seeds, verifier, core between spaces) of each."""
    out = []
    for n in notices:
        checked = regex.compile(f"(?e)(?:{regex.escape(n.words, special_only=True)}){{e<={n.edits}}}")
        out.append((n, [(len(n.words[:o].encode()), s.encode()) for o, s in n.seeds()], checked, f" {n.core} "))
    return out


def folded(text: str) -> bytes:
    """The words of a text between single spaces, with a space at each end, as UTF-8."""
    words = text.encode("utf-8", "replace").translate(_FOLD).split()
    return b" %s " % b" ".join(words) if words else b" "


def _places(text: bytes, part: bytes) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


def _windows(text: bytes, size: int, edits: int, seeds: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
    """The stretches around seeds that can hold the notice, overlapping ones merged, at ends of whole words."""
    found = sorted({at - offset for offset, seed in seeds for at in _places(text, seed)})
    out: list[tuple[int, int]] = []
    for start in found:
        # A character of up to four bytes may stand in for each edit.
        a = text.rfind(b" ", 0, max(start - 4 * edits, 0) + 1)
        b = text.find(b" ", start + size + 4 * edits)
        a, b = max(a, 0), len(text) - 1 if b < 0 else b
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def matches(text: bytes, notices: tuple[Notice, ...] = NOTICES, base: tuple[tuple[str, str], ...] = BASE) -> list[Match]:
    """All matches in a folded text: the base phrases' places, then the notices'."""
    out, spaces = [], np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    word = lambda at: int(np.searchsorted(spaces, at))  # noqa: E731  number of the word after the space at `at`
    for phrase, label in base:
        n = phrase.count(" ")
        for at in _places(text, f" {phrase} ".encode()):
            w = word(at)
            out.append(Match(label, w, w + n, 0, len(phrase), True))
    for n, seeds, checked, core in _ready(notices):
        for a, b in _windows(text, len(n.words.encode()), n.edits, seeds):
            piece = text[a : b + 1]
            if core.encode() not in piece:
                continue
            piece = piece.decode("utf-8", "replace")
            before = word(a)
            ends = [k for k, c in enumerate(piece) if c == " "]
            at = 0
            while m := checked.search(piece, at):
                start, end = m.span()
                # The words that the match touches, without spaces at its ends.
                first = bisect_right(ends, start + len(m[0]) - len(m[0].lstrip(" "))) - 1
                last = max(bisect_right(ends, start + len(m[0].rstrip(" ")) - 1), first + 1)
                if core in piece[ends[first] : ends[last] + 1]:
                    out.append(Match(n.label, before + first, before + last - 1, sum(m.fuzzy_counts), len(n.words), False))
                    at = max(end, at + 1)
                else:
                    at = start + 1
    return out


def find(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, base: tuple[tuple[str, str], ...] = BASE) -> DataFrame:
    """doc_id, label, edits, base, and start and end (code points of the whole text, end exclusive) of every match."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in sliced(batches, "text"):
            rows = []
            for d, t in zip(b["doc_id"], b["text"], strict=True):
                found = matches(folded(t or ""), notices, base)
                if found:
                    spans = [m.span() for m in _WORD.finditer(t)]  # only of texts with a match
                    rows += [(d, m.label, m.edits, m.base, spans[m.first][0], spans[m.last][1]) for m in found]
            yield pd.DataFrame(rows, columns=["doc_id", "label", "edits", "base", "start", "end"])

    read = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInPandas(run, "doc_id string, label string, edits int, base boolean, start long, end long").withColumn("doc_id", F.col("doc_id").cast("long"))


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, base: tuple[tuple[str, str], ...] = BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row. The score is the best match's
    share of unedited characters: 1 for a base phrase, 0 without any match."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in sliced(batches, "text"):
            rows = []
            for d, t in zip(b["doc_id"], b["text"], strict=True):
                text = folded(t or "")
                found = matches(text, notices, base)
                at = [m.first for m in found if m.base]
                names = lambda some: ",".join(sorted({m.label for m in some}))
                score = max((1 - m.edits / m.size for m in found), default=0.0)
                rows.append((d, text.count(b" ") - 1, len(at), min(at, default=None), max(at, default=None), names(m for m in found if m.base), names(found), score))
            out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    read = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInPandas(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double").withColumn("doc_id", F.col("doc_id").cast("long"))
