"""Matching of rules against one text: regular expressions with nearby second patterns, syntax shapes, entropy and long
lines. The semantic core; operators.scan applies it to tables."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick

from quillscan.functions import js
from quillscan.functions.catalog import NEAR, Needs, Rule, compiled, needed

DIALECTS = {
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx",
}
#: Comments with which a line is exempted. Substrings, anywhere in a line.
SUPPRESS_NEXT, SUPPRESS_LINE = "scan-ignore-next-line", "scan-ignore-line"
SNIPPET = 120
_QUOTED = re.compile("[\"'][^\n]*")


def dialect(path: str) -> str | None:
    """By the extension, case-sensitive; None: not scanned at all."""
    name = path.rsplit("/", 1)[-1]
    return DIALECTS.get(name.rsplit(".", 1)[1]) if "." in name[1:] else None


@dataclass(frozen=True)
class Hit:
    rule: int  # its place in the catalog
    line: int
    column: int
    snippet: str


@dataclass(frozen=True)
class Ready:
    """A rule with its patterns compiled once."""

    rule: Rule
    primary: re.Pattern | None
    near: re.Pattern | None
    needs: Needs


class Prepared(list):
    """Rules with their patterns compiled, and one automaton (Aho-Corasick) over the literals that their matches must contain: a single pass over
    a text tells which patterns are worth trying."""

    def __init__(self, ready: list[Ready]):
        super().__init__(ready)
        of: dict[str, int] = {}
        self.always = 0
        for k, r in enumerate(ready):
            if r.needs.literals:
                for x in r.needs.literals:
                    of[x.casefold()] = of.get(x.casefold(), 0) | 1 << k
            else:
                self.always |= 1 << k
        self.automaton = ahocorasick.Automaton()
        for x, mask in of.items():
            self.automaton.add_word(x, mask)
        if of:
            self.automaton.make_automaton()

    def worth(self, t: Text) -> int:
        """A bit for each rule whose literals the text may hold, whatever their case, or that has none."""
        found = self.always
        if len(self.automaton):
            for _, mask in self.automaton.iter(t.folded):
                found |= mask
        return found


def prepare(rules: list[Rule]) -> Prepared:
    """An invalid first pattern makes a rule never match, an invalid second one lets all its matches pass."""
    out = []
    for r in rules:
        primary = compiled(r.pattern) if r.kind == "regex" else None
        if primary is not None and primary.match("") and r.kind == "regex":
            raise ValueError(f"{r.id}: its pattern matches the empty text")
        out.append(Ready(r, primary, compiled(r.near) if r.near and r.kind == "regex" else None, needed(r.pattern) if r.kind == "regex" else Needs()))
    return Prepared(out)


class Text:
    """A text with what its positions need; all offsets are code points."""

    def __init__(self, content: str):
        self.content = content
        self.breaks = [m.start() for m in re.finditer("\n", content)]
        self.ascii = content.isascii()
        self._nodes: list[js.Node] | None = None
        self._strings: list[tuple[int, int]] | None = None
        self._folded: str | None = None

    @property
    def folded(self) -> str:
        if self._folded is None:
            self._folded = self.content.casefold()
        return self._folded

    def may_match(self, needs: Needs) -> bool:
        if needs.wide and (self.ascii or needs.beyond and not needs.beyond.search(self.content)):
            return False
        if not all(x in self.content for x in needs.marks):
            return False
        if not needs.literals:
            return True
        text = self.folded if needs.folded else self.content
        return any(x in text for x in needs.literals)

    def may_hold_literal(self, characters: float) -> bool:
        """Whether a string or template may have more than so many different characters: a string ends with its line at the latest, unless a
        backslash goes before the line's end; a template may go on to the text's end."""
        text = self.content
        back = text.find("`")
        if back >= 0 and len(set(text[back:])) > characters:
            return True
        if '"' not in text and "'" not in text:
            return False
        return "\\\n" in text or any(len(m[0]) > characters and len(set(m[0])) > characters for m in _QUOTED.finditer(text))

    @property
    def nodes(self) -> list[js.Node]:
        if self._nodes is None:
            self._nodes = js.nodes(self.content)
        return self._nodes

    @property
    def strings(self) -> list[tuple[int, int]]:
        """The spans of strings and templates. A text without back quotes isn't taken apart for them as a whole."""
        if self._strings is None:
            whole = self._nodes is not None or "`" in self.content
            self._strings = [(n.start, n.end) for n in self.nodes if n.kind in ("string", "template_string")] if whole else js.strings(self.content)
        return self._strings

    def lines(self) -> Iterator[tuple[int, str]]:
        """(number, text without its line end); a line feed at the end begins no further line."""
        parts = self.content.split("\n")
        if parts[-1] == "":
            parts.pop()
        for k, line in enumerate(parts, 1):
            yield k, line.removesuffix("\r")

    def place(self, at: int) -> tuple[int, int]:
        k = bisect_right(self.breaks, at - 1) if at else 0
        return k + 1, at - (self.breaks[k - 1] + 1 if k else 0) + 1

    def snippet(self, line: int) -> str:
        start = self.breaks[line - 2] + 1 if line > 1 else 0
        end = self.breaks[line - 1] if line - 1 < len(self.breaks) else len(self.content)
        text = self.content[start:end].removesuffix("\r")
        return text[:SNIPPET] + "..." if len(text) > SNIPPET else text

    def window(self, start: int, end: int) -> tuple[int, int]:
        """The span widened by NEAR bytes on both sides, outwards to whole characters."""
        if self.ascii:
            return max(0, start - NEAR), min(len(self.content), end + NEAR)
        left = NEAR
        while start and left > 0:
            start -= 1
            left -= len(self.content[start].encode("utf-8", "surrogatepass"))
        left = NEAR
        while end < len(self.content) and left > 0:
            left -= len(self.content[end].encode("utf-8", "surrogatepass"))
            end += 1
        return start, end


def entropy(text: str) -> float:
    """Shannon's, in bits for each character."""
    n = len(text)
    return -sum(k / n * math.log2(k / n) for k in Counter(text).values()) if n else 0.0


def _offsets(t: Text, r: Ready) -> Iterator[int]:
    rule, kind = r.rule, r.rule.kind
    if kind == "regex":
        if r.primary is None or not t.may_match(r.needs):
            return
        for m in r.primary.finditer(t.content):
            if r.near is None or r.near.search(t.content[slice(*t.window(m.start(), m.end()))]):
                yield m.start()
    elif kind == "entropy":
        limit = 4.5 if rule.threshold is None else rule.threshold
        if not t.may_hold_literal(2**limit):
            return
        for start, end in t.strings:
            inner = t.content[start:end].strip("\"'`")
            if len(set(inner)) >= 2**limit and len(inner.encode("utf-8", "surrogatepass")) >= 16 and entropy(inner) > limit:
                yield start
    elif kind == "ast_node_type" and rule.pattern.partition(":")[2] not in t.content:
        return
    elif kind in ("call_expression", "member_expression") and rule.pattern not in t.content:
        return
    elif kind == "subscript_expression" and not all(x in t.content for x in rule.pattern.split(".")):
        return
    elif kind == "call_expression":
        yield from (n.start for n in t.nodes if n.kind == kind and n.head == rule.pattern)
    elif kind == "member_expression":
        for n in t.nodes:
            if n.kind == kind and ((s := t.content[n.start : n.end]) == rule.pattern or s.startswith(rule.pattern + ".")):
                yield n.start
    elif kind == "subscript_expression":
        want = tuple(rule.pattern.split("."))
        yield from (n.start for n in t.nodes if n.kind == kind and n.names == want)
    elif kind == "ast_node_type":
        name, _, head = rule.pattern.partition(":")
        yield from (n.start for n in t.nodes if n.kind == name and (not head or n.head == head))


def hits(content: str, ready: list[Ready]) -> list[Hit]:
    """All matches, rules in catalog order."""
    t, out = Text(content), []
    worth = ready.worth(t) if isinstance(ready, Prepared) else -1
    for k, r in enumerate(ready):
        if not worth >> k & 1:
            continue
        if r.rule.kind == "long_line":
            limit = int(1000 if r.rule.threshold is None else r.rule.threshold)
            out += [Hit(k, n, 1, t.snippet(n)) for n, line in t.lines() if len(line) > limit or len(line) * 4 > limit and len(line.encode("utf-8", "surrogatepass")) > limit]
            continue
        for at in _offsets(t, r):
            line, column = t.place(at)
            out.append(Hit(k, line, column, t.snippet(line)))
    return out


def suppressed(content: str, next_line: str = SUPPRESS_NEXT, same_line: str = SUPPRESS_LINE) -> set[int]:
    """The numbers of exempted lines."""
    if next_line not in content and same_line not in content:
        return set()
    out = set()
    for k, line in enumerate(content.split("\n"), 1):
        if next_line in line:
            out.add(k + 1)
        elif same_line in line:
            out.add(k)
    return out
