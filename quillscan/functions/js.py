"""A tolerant JavaScript / TypeScript tokenizer and a recogniser of postfix chains, for the rules that look at syntax:
calls, member and subscript accesses, constructions and string literals. Works on code as data, in linear time."""

from __future__ import annotations

import re
from typing import NamedTuple

_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*(?:.*?\*/|.*)|\#![^\n]*)
    |(?P<string>"(?:[^"\\\n]|\\.)*+"?|'(?:[^'\\\n]|\\.)*+'?)
    |(?P<template>`)
    |(?P<number>(?:0[xXoObB][\w]+|\.?\d(?:[eE][+-]?|[\w.])*))
    |(?P<name>\#?[^\W\d](?:[\w$]|\\u\{?[0-9a-fA-F]+\}?)*|\#?\$[\w$]*)
    |(?P<regex>/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[A-Za-z]*)
    |(?P<mark>\?\.(?!\d)|\.\.\.|=>|[{}()\[\].;,<>+\-*/%&|^!~?:=@\\]|.)""",
    re.X | re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[A-Za-z]*", re.S)
#: What a quote can stand in, and slashes: no other token holds any of these.
_QUOTES = re.compile(r"""//[^\n]*|/\*(?:.*?\*/|.*)|\#![^\n]*|(?P<string>"(?:[^"\\\n]|\\.)*+"?|'(?:[^'\\\n]|\\.)*+'?)|(?P<slash>/)""", re.S)
#: Marks that end no value and no longer token of another kind.
_OPEN_MARKS = frozenset("<>,(=;:!?&|{[*~^%@")
_STEPS = frozenset((".", "?.", "[", "("))
_OPERATOR_WORDS = frozenset("return typeof instanceof in of new delete void throw case do else yield await".split())
_NOT_CALLED = frozenset("if for while switch catch with function return typeof await yield void delete throw new in of instanceof do else case".split())


class Token(NamedTuple):
    kind: str  # string template number name regex mark
    start: int
    end: int
    text: str


def tokens(text: str) -> list[Token]:
    """The tokens of a text without white space and comments. A template is one token from back quote to back quote; the
    tokens of its substitutions follow it."""
    out: list[Token] = []
    holes: list[tuple[int, int]] = []  # brace depth at which a template goes on, its start
    depth, at, n, templates, match = 0, 0, len(text), False, _TOKEN.match

    def template(start: int, at: int) -> int:
        """Reads template text; the place after its end, or after the ${ of its next substitution."""
        while at < n:
            c = text[at]
            if c == "\\":
                at += 2
            elif c == "`":
                out.append(Token("template", start, at + 1, text[start : at + 1]))
                return at + 1
            elif c == "$" and text[at + 1 : at + 2] == "{":
                holes.append((depth, start))
                return at + 2
            else:
                at += 1
        out.append(Token("template", start, n, text[start:]))
        return n

    while at < n:
        m = match(text, at)
        kind, s = m.lastgroup, m[0]
        if kind == "space":
            at = m.end()
            continue
        if kind == "regex" and _ends_value(out[-1] if out else None):
            kind, s = "mark", "/"
        end = at + len(s)
        if kind == "template":
            templates = True
            at = template(at, end)
            continue
        if s == "{":
            depth += 1
        elif s == "}":
            if holes and holes[-1][0] == depth:
                _, start = holes.pop()
                at = template(start, end)
                continue
            depth -= 1
        out.append(Token(kind, at, end, s))
        at = end
    return sorted(out, key=lambda t: (t.start, -t.end)) if templates else out


def _ends_value(t: Token | None) -> bool:
    """Whether a slash after this token divides (else it begins a regular expression)."""
    if t is None:
        return False
    if t.kind == "name":
        return t.text not in _OPERATOR_WORDS
    return t.kind in ("string", "template", "number", "regex") or t.text in (")", "]", "}")


def strings(text: str) -> list[tuple[int, int]]:
    """The spans of the string tokens of a text without back quotes, as `tokens` finds them. What lies between is only taken apart where it
    tells whether a slash divides."""
    out: list[tuple[int, int]] = []
    at, since, last = 0, 0, None  # `last` is the token before `since`; strings and regular expressions end there
    while m := _QUOTES.search(text, at):
        start, at = m.span()
        if m.lastgroup == "string":
            out.append((start, at))
            since, last = at, Token("string", start, at, '"')
        elif m.lastgroup == "slash":
            kind, found = "mark", _REGEX.match(text, start)
            if found and not (start > since and text[start - 1] in _OPEN_MARKS):
                while since < start:
                    t = _TOKEN.match(text, since, start)
                    if t.lastgroup != "space":
                        last = Token(t.lastgroup, since, t.end(), t[0])
                    since = t.end()
                found = None if _ends_value(last) else found
            if found:
                kind, at = "regex", found.end()
            since, last = at, Token(kind, start, at, "/")
    return out


class Node(NamedTuple):
    """A postfix expression: kind as in the usual grammars, its span, what stands before its last step (`head`: callee,
    object or constructor) and the names along the chain (None where they aren't plain)."""

    kind: str  # call_expression member_expression subscript_expression new_expression string template_string
    start: int
    end: int
    head: str
    names: tuple[str | None, ...] = ()


def nodes(text: str) -> list[Node]:
    """All recognised nodes in order of their start, outer ones first."""
    ts = tokens(text)
    close: dict[int, int] = {}
    stack: list[int] = []
    for k, t in enumerate(ts):
        if t.kind == "mark" and t.text in "([{":
            stack.append(k)
        elif t.kind == "mark" and t.text in ")]}" and stack:
            close[stack.pop()] = k
    out: list[Node] = []
    for k, t in enumerate(ts):
        before = ts[k - 1] if k else None
        if t.kind in ("string", "template"):
            out.append(Node("string" if t.kind == "string" else "template_string", t.start, t.end, ""))
        if t.kind == "name" and t.text == "new" and not (before and before.text in (".", "?.")):
            end = _constructor(ts, close, k + 1)
            if end > k + 1:
                last = close.get(end, end - 1) if end < len(ts) and ts[end].text == "(" else end - 1
                out.append(Node("new_expression", t.start, ts[last].end, text[ts[k + 1].start : ts[end - 1].end]))
        if t.kind == "name" and k + 1 < len(ts) and ts[k + 1].text in _STEPS and not (before and before.text in (".", "?.")):
            out += _chain(text, ts, close, k)
    return sorted(out, key=lambda x: (x.start, -x.end))


def _constructor(ts: list[Token], close: dict[int, int], k: int) -> int:
    """The place after a constructor's name or dotted chain."""
    if k >= len(ts) or ts[k].kind != "name":
        return k
    k += 1
    while k < len(ts):
        if ts[k].text == "." and k + 1 < len(ts) and ts[k + 1].kind == "name":
            k += 2
        elif ts[k].text == "[" and k in close:
            k = close[k] + 1
        else:
            break
    return k


def _chain(text: str, ts: list[Token], close: dict[int, int], k: int) -> list[Node]:
    """The nodes of the postfix chain that starts with the name at k."""
    first, before = ts[k], ts[k - 1] if k else None
    if first.text in _NOT_CALLED:
        return []
    built = bool(before and before.kind == "name" and before.text == "new")
    declared = bool(before and before.kind == "name" and before.text in ("function", "class"))
    if declared or (before and before.text == "*" and k > 1 and ts[k - 2].text == "function"):
        return []
    out: list[Node] = []
    names: tuple[str | None, ...] = (first.text,)
    at, end = k + 1, first.end
    while at < len(ts):
        t, head = ts[at], text[first.start : end]
        if t.text in (".", "?.") and at + 1 < len(ts) and ts[at + 1].kind == "name":
            names, end = (*names, ts[at + 1].text), ts[at + 1].end
            out.append(Node("member_expression", first.start, end, head, names))
            at += 2
            continue
        step = at + 1 if t.text == "?." and at + 1 < len(ts) and ts[at + 1].text in ("(", "[") else at
        t = ts[step]
        if t.text == "[" and t.kind == "mark" and step in close:
            stop = close[step]
            inner = text[t.end : ts[stop].start].strip().strip("\"'`")
            names, end = (*names, inner or None), ts[stop].end
            out.append(Node("subscript_expression", first.start, end, head, names))
        elif t.text == "(" and t.kind == "mark" and step in close:
            stop = close[step]
            if at == k + 1 and stop + 1 < len(ts) and ts[stop + 1].text == "{" and (before is None or before.text in ("{", "}", ",", ";", "async", "get", "set", "static", "*")):
                return out  # a method's definition
            end = ts[stop].end
            if not built:
                out.append(Node("call_expression", first.start, end, head, names))
            built, names = False, (None,)
        else:
            break
        at = stop + 1
    return out
