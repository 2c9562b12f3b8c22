"""Rewriting of obfuscated JavaScript text: literal decoding, constant folding, unwrapping of evaluated strings and
control-flow simplification, in rounds until nothing changes. Text only: nothing is ever evaluated.

Each rewrite is a row of a table: a pattern, what a match becomes (None: it stays), and how it is applied: to all
matches once, to all matches until nothing changes, or to the first match until nothing changes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

from quillscan.functions.catalog import needed

Become = Callable[[re.Match], str | None]
MAX_ROUNDS = 5
_NUMBERS = r"(\s*\d{1,5}\s*(?:,\s*\d{1,5}\s*)%s)"
_MASK = (1 << 64) - 1


@dataclass(frozen=True)
class Rewrite:
    pattern: re.Pattern
    become: Become
    repeat: str = "once"  # once | stable | first
    holds: tuple[tuple[str, ...], ...] = ()  # a text without one of each of these stays as it is; the pattern's own literals go without saying

    @cached_property
    def needs(self) -> tuple[tuple[str, ...], ...]:
        own = needed(self.pattern.pattern).literals
        return (own, *self.holds) if own else self.holds

    def may_apply(self, text: str) -> bool:
        """Whether the text has what a change takes; most texts skip most patterns by it."""
        for either in self.needs:
            for x in either:
                if x in text:
                    break
            else:
                return False
        return True

    def apply(self, text: str) -> tuple[str, int]:
        total = 0
        if self.repeat == "first":
            at = 0
            while (m := self.pattern.search(text, at)) and (new := self.become(m)) is not None:
                text, at, total = text[: m.start()] + new + text[m.end() :], m.start(), total + 1
            return text, total

        def one(m: re.Match) -> str:
            nonlocal total
            new = self.become(m)
            if new is None:
                return m[0]
            total += 1
            return new

        while True:
            new = self.pattern.sub(one, text)
            if self.repeat == "once" or new == text:
                return new, total
            text = new


def _plain(c: str, more: str = " ") -> bool:
    return "!" <= c <= "~" or c in more


def _escapes(escape: str, quote: str, per_escape: bool = False) -> Callable[[re.Match], str | None]:
    found = re.compile(escape)

    def decode(e: re.Match) -> str:
        code = int(e[1], 16)
        c = chr(code) if code < 0x110000 else "\0"
        return c if _plain(c, " \t\n\r") and c not in ("\\", quote) else e[0]

    def become(m: re.Match) -> str | None:
        inner = found.sub(decode, m[1])
        return f"{quote}{inner}{quote}" if inner != m[1] else None

    return become


class _EscapeCount(Rewrite):
    """Counts the escapes it decodes, not the strings."""

    def apply(self, text: str) -> tuple[str, int]:
        new, _ = super().apply(text)
        return new, len(re.findall(r"\\u\{[0-9a-fA-F]{1,6}\}", text)) - len(re.findall(r"\\u\{[0-9a-fA-F]{1,6}\}", new))


def _codes(m: re.Match) -> str | None:
    codes = [int(n) for n in m[1].split(",")]
    text = "".join(chr(c) for c in codes if c < 0x110000 and not 0xD800 <= c < 0xE000)
    return f'"{text}"' if text and all(map(_plain, text)) else None


def unbase64(text: str) -> str | None:
    """Base64 as scripts use it: padding anywhere is skipped, a last single character is ignored."""
    text = text.replace("=", "")
    text = text[: len(text) - (len(text) % 4 == 1)]
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True).decode("utf-8")
    except ValueError:
        return None


def _decoded(m: re.Match) -> str | None:
    text = unbase64(m[1])
    if text is None or not all(_plain(c, " \t\n\r\f") for c in text):
        return None
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _reversed(quote: str) -> Become:
    return lambda m: f"{quote}{m[1][::-1]}{quote}" if all(map(_plain, m[1])) else None


class _Concat(Rewrite):
    """"a".concat("b", "c"), the first that folds, until none does."""

    def apply(self, text: str) -> tuple[str, int]:
        quote = self.pattern.pattern[0]
        body = rf"(?:[^{quote}\\]|\\.)*+"
        arguments = re.compile(rf"\s*\.concat\s*\(((?:[ \t\n\r]*{quote}{body}{quote}[ \t\n\r]*,?)+)[ \t\n\r]*\)", re.S)
        each, total, at = re.compile(rf"{quote}({body}){quote}", re.S), 0, 0
        while m := self.pattern.search(text, at):
            call = arguments.match(text, m.end())
            if call:
                text = f"{text[: m.start()]}{quote}{m[1]}{''.join(each.findall(call[1]))}{quote}{text[call.end() :]}"
                total += 1
            at = m.start() if call else m.end()
        return text, total


def _strings() -> Iterator[Rewrite]:
    for q in "\"'`":
        yield Rewrite(re.compile(rf"{q}((?:[^{q}\\]|\\.)*+){q}"), _escapes(r"\\x([0-9a-fA-F]{2})", q), holds=(("\\x",), (q,)))
    for q in "\"'":
        yield Rewrite(re.compile(rf"{q}((?:[^{q}\\]|\\.)*+){q}"), _escapes(r"\\u([0-9a-fA-F]{4})", q), holds=(("\\u",), (q,)))
    for q in "\"'":
        yield _EscapeCount(re.compile(rf"{q}([^{q}]*\\u\{{[0-9a-fA-F]{{1,6}}\}}[^{q}]*){q}"), _escapes(r"\\u\{([0-9a-fA-F]{1,6})\}", q))
    # The call shapes that are decoded.
    each = r"(?:\w*\s*=>\s*String\.fromCharCode\s*\(\s*\w*\s*\)|function\s*\(\w*\)\s*\{\s*return\s+String\.fromCharCode\s*\(\s*\w*\s*\)\s*;?\s*\}|String\.fromCharCode)"
    yield Rewrite(re.compile(rf"\[{_NUMBERS % '{2,}'}\]\.map\s*\(\s*{each}\s*\)\.join\s*\(\s*[\"'`][\"'`]\s*\)"), _codes)
    yield Rewrite(re.compile(r"(?:(?:window|self|globalThis)\.)?atob\s*\(\s*[\"'`]([A-Za-z0-9+/=]+)[\"'`]\s*\)"), _decoded)
    yield Rewrite(re.compile(rf"String\.fromCharCode\s*\({_NUMBERS % '+'}\)"), _codes)
    yield Rewrite(re.compile(rf"String\.fromCharCode\s*\.\s*apply\s*\(\s*(?:null|undefined|this|window|globalThis|self)?\s*,\s*\[{_NUMBERS % '*'}\]\s*\)"), _codes)
    yield Rewrite(re.compile(rf"String\.fromCharCode\s*\(\s*\.\.\.\s*\[{_NUMBERS % '*'}\]\s*\)"), _codes)
    yield Rewrite(re.compile(r"Buffer\.from\s*\(\s*[\"']([A-Za-z0-9+/=]+)[\"']\s*,\s*[\"']base64[\"']\s*\)\.toString\s*\(\s*\)"), _decoded)
    for q in "\"'":
        yield Rewrite(re.compile(rf"{q}([^{q}]{{2,}}){q}\.split\s*\(\s*{q}{q}\s*\)\.reverse\s*\(\s*\)\.join\s*\(\s*{q}{q}\s*\)"), _reversed(q))
    for q in "\"'":
        yield _Concat(re.compile(rf"{q}((?:[^{q}\\]|\\.)*+){q}", re.S), lambda m: None, holds=((".concat",), (q,)))


def _arithmetic(m: re.Match) -> str | None:
    a, op, b = int(m[1]), m[2], int(m[3])
    if op in "/%" and not b:
        return None
    value = {"+": a + b, "-": a - b, "*": a * b, "|": a | b, "&": a & b, "^": a ^ b}.get(op)
    if value is None:
        value = a // b if op == "/" else a % b
    value &= _MASK
    return str(value - (1 << 64) if value >> 63 else value)


def _integer(radix: int, group: int = 1) -> Become:
    def become(m: re.Match) -> str | None:
        value = int(m[group], radix)
        return str(value) if value <= _MASK else None

    return become


def _parsed(m: re.Match) -> str | None:
    radix = int(m[2])
    if not 2 <= radix <= 36:
        return None
    try:
        value = int(m[1], radix)
    except ValueError:
        return None
    return str(value) if value <= _MASK else None


def _number(m: re.Match) -> str | None:
    value = int(m[1], 0)
    return str(value) if value <= _MASK else None


def _constant(text: str) -> Become:
    return lambda m: text


def _folds() -> Iterator[Rewrite]:
    for q in "\"'`":
        yield Rewrite(re.compile(rf"{q}([^{q}]*){q}\s*\+\s*{q}([^{q}]*){q}"), lambda m, q=q: f"{q}{m[1]}{m[2]}{q}", "first", (("+",), (q,)))
    for a, b in ('"\'', "'\""):
        yield Rewrite(re.compile(rf"{a}((?:[^{a}\\]|\\.)*+){a}\s*\+\s*{b}((?:[^{b}\\]|\\.)*+){b}"), lambda m, a=a: None if a in m[2] else f"{a}{m[1]}{m[2]}{a}", "first", (("+",), (a,), (b,)))
    yield Rewrite(re.compile(r"\(\s*(\d{1,10})\s*([+\-*/%|&^])\s*(\d{1,10})\s*\)"), _arithmetic, "stable")
    for prefix, digits, radix in (("0x", "0-9a-fA-F", 16), ("0o", "0-7", 8), ("0b", "01", 2)):
        yield Rewrite(re.compile(rf"\b{prefix}([{digits}]+)\b"), _integer(radix))
    yield Rewrite(re.compile(r"parseInt\s*\(\s*['\"]([0-9a-fA-F]+)['\"]\s*,\s*(\d{1,2})\s*\)"), _parsed)
    yield Rewrite(re.compile(r"\bNumber\s*\(\s*(0x[0-9a-fA-F]+|0o[0-7]+|0b[01]+)\s*\)"), _number)
    for pattern, text in (
        (r"typeof\s+undefined\s*===?\s*[\"']undefined[\"']", "true"),
        (r"\bvoid\s+0\b", "undefined"),
        (r"!!\[\]", "true"),
        (r"!!1\b", "true"),
        (r"!!0\b", "false"),
        (r"!\[\]", "false"),
        (r"(?<![^\W_])(?<!!)!0(?![^\W_])", "true"),
        (r"(?<![^\W_])(?<!!)!1(?![^\W_])", "false"),
        (r"\+!!\[\]", "+1"),
        (r"\+\[\]", "+0"),
    ):
        yield Rewrite(re.compile(pattern), _constant(text))


def _unwraps() -> Iterator[Rewrite]:
    body = lambda q: rf"{q}((?:[^{q}\\]|\\.)++){q}"
    for q in "\"'`":
        yield Rewrite(re.compile(rf"eval\s*\(\s*{body(q)}\s*\)"), lambda m: f"/* unwrapped:eval */ {m[1]}")
    for q in "\"'`":
        yield Rewrite(re.compile(rf"new\s+Function\s*\(\s*{body(q)}\s*\)(?:\s*\(\s*\))?"), lambda m: f"/* unwrapped:Function */ {m[1]}")
    for name, word in (("setTimeout", "timeout"), ("setInterval", "interval")):
        for q in "\"'`":
            yield Rewrite(re.compile(rf"{name}\s*\(\s*{body(q)}\s*,\s*(\d+)\s*\)"), lambda m, name=name, word=word: f"{name}(function(){{ /* unwrapped:{word} */ {m[1]} }}, {m[2]})")


_SKIP = re.compile(r"//[^\n]*|/\*(?:.*?\*/|.*)|\"(?:[^\"\\]|\\.)*+\"?|'(?:[^'\\]|\\.)*+'?|[{}`]", re.S)
_TEMPLATE = re.compile(r"\\.|`|\$\{", re.S)
_HOLE = re.compile(r"\"(?:[^\"\\]|\\.)*+\"?|'(?:[^'\\]|\\.)*+'?|[{}]", re.S)


def block_end(text: str, start: int) -> int | None:
    """The place after the brace that closes the one at start; comments, strings and templates don't count."""
    depth, at = 0, start
    while m := _SKIP.search(text, at):
        at = m.end()
        if m[0] == "`":
            at = _template_end(text, at)
        elif m[0] in "{}":
            depth += 1 if m[0] == "{" else -1
            if not depth:
                return at
    return None


def _template_end(text: str, at: int) -> int:
    while m := _TEMPLATE.search(text, at):
        at = m.end()
        if m[0] == "`":
            return at
        if m[0] == "${":
            depth = 1
            while depth and (h := _HOLE.search(text, at)):
                at = h.end()
                depth += {"{": 1, "}": -1}.get(h[0], 0)
            if depth:
                return len(text)
    return len(text)


class _If(Rewrite):
    """if (constant) { ... } [else { ... }]; become(…) is unused: `repeat` says which branch stays."""

    def apply(self, text: str) -> tuple[str, int]:
        total = 0
        while m := self.pattern.search(text):
            end = block_end(text, m.end() - 1)
            if end is None:
                break
            body, after, other = text[m.end() : end - 1], end, ""
            e = re.compile(r"\s*else\s*(?=\{)").match(text, end)
            if e and (stop := block_end(text, e.end())) is not None:
                other, after = text[e.end() + 1 : stop - 1], stop
            kept = body if self.repeat == "then" else other
            text, total = text[: m.start()] + kept.strip() + text[after:], total + 1
        return text, total


class _Ternary(Rewrite):
    """constant ? a : b. The first branch is the shortest run of quoted strings and characters other than : , ; before a
    colon; every place is visited once, so the search is linear."""

    _tail = re.compile(r"\s*:\s*([^,;\n]+)")

    def _first(self, text: str, start: int) -> re.Match | None:
        stack, seen = [start], set()
        while stack:
            at = stack.pop()
            if at in seen:
                continue
            seen.add(at)
            if at > start and (tail := self._tail.match(text, at)):
                self._stop = at
                return tail
            if at < len(text):
                if text[at] not in ":,;":
                    stack.append(at + 1)
                if text[at] in "\"'" and (close := text.find(text[at], at + 1)) >= 0:
                    stack.append(close + 1)
        return None

    def apply(self, text: str) -> tuple[str, int]:
        out, at, total = [], 0, 0
        while m := self.pattern.search(text, at):
            tail = self._first(text, m.end())
            if tail is None:
                out.append(text[at : m.end()])
                at = m.end()
                continue
            kept = text[m.end() : self._stop] if self.repeat == "then" else tail[1]
            out += [text[at : m.start()], kept.strip()]
            at, total = tail.end(), total + 1
        return "".join([*out, text[at:]]), total


def _flows() -> Iterator[Rewrite]:
    none = lambda m: None
    yield _If(re.compile(r"if\s*\(\s*(?:false|0|!1)\s*\)\s*\{"), none, "else")
    yield _If(re.compile(r"if\s*\(\s*(?:true|1|!0)\s*\)\s*\{"), none, "then")
    yield _Ternary(re.compile(r"(?:true|!0)\s*\?\s*"), none, "then", (("?",),))
    yield _Ternary(re.compile(r"(?:false|!1)\s*\?\s*"), none, "else", (("?",),))
    yield Rewrite(re.compile(r"(?:\"\"|''|false|null)\s*\|\|\s*([^,;\n]+)"), lambda m: m[1].strip(), holds=(("||",),))
    yield Rewrite(re.compile(r"\(\s*(?:0|void\s+0|undefined|null)\s*,\s*(\w+(?:\.\w+)*)\s*\)"), lambda m: m[1])


PASSES: tuple[tuple[str, tuple[Rewrite, ...]], ...] = (
    ("string_decode", tuple(_strings())),
    ("constant_fold", tuple(_folds())),
    ("eval_unwrap", tuple(_unwraps())),
    ("control_flow", tuple(_flows())),
)


def run_pass(name: str, text: str) -> tuple[str, int]:
    """One pass over the text: (new text, number of changes)."""
    total = 0
    for step in dict(PASSES)[name]:
        if step.may_apply(text):
            text, n = step.apply(text)
            total += n
    return text, total


def rewrite(text: str) -> tuple[str, list[tuple[str, int]]]:
    """All passes in rounds: (new text, [(pass, changes) of each pass that changed something])."""
    record: list[tuple[str, int]] = []
    for _ in range(MAX_ROUNDS):
        before = len(record)
        for name, _ in PASSES:
            text, n = run_pass(name, text)
            if n:
                record.append((name, n))
        if len(record) == before:
            return text, record
    return text, [*record, ("iteration_limit", 0)]
