"""JSON texts by the rules of DuckDB's json_valid: the whole text is one value. Repeated names, commas before an end, NaN and infinities pass, as do
numbers, names and depths of any size; halves of surrogate pairs don't. Spark's own parsers stop after the first value, or fail on some of these."""

from __future__ import annotations

import json
import re

_PAIR = r"u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}"
_STRING = rf'"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|{_PAIR}|u(?![dD][89a-fA-F])[0-9a-fA-F]{{4}}))*+"'
_OTHER = r"true|false|null|-?(?:(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|(?i:inf(?:inity)?|nan))"
_TOKEN = re.compile(rf"[ \t\n\r]*+(?:([\[\]{{}},:])|({_STRING})|({_OTHER}))")
_END = re.compile(r"[ \t\n\r]*+\Z")
_SURROGATE = re.compile(r"\\u[dD][89a-fA-F]")


def _members(pairs: list) -> dict:
    """An object's members; of a repeated name the first, as json_extract takes it."""
    found = dict(pairs)
    return found if len(found) == len(pairs) else dict(reversed(pairs))


_FAST = json.JSONDecoder(object_pairs_hook=_members)


def value(text: str):
    """What a JSON text stands for; ValueError where it is none."""
    try:
        if not _SURROGATE.search(text):
            return _FAST.decode(text)
    except (ValueError, RecursionError):
        pass  # the library's rules are narrower
    return _walk(text)


def _walk(text: str):
    """`value` token by token, without recursion. Numbers, true, false and null are all 0."""
    root: list = []
    around: list = [root]  # the root, and the lists and objects that are open
    at, state, name = 0, "value", ""
    while state != "end":
        m = _TOKEN.match(text, at)
        mark, string, other = m.groups() if m else (None, None, None)
        last = around[-1]
        if state in ("value", "item") and (string or other or mark in ("{", "[")):
            new = json.loads(string) if string else 0 if other else {} if mark == "{" else []
            if isinstance(last, dict):
                last.setdefault(name, new)
            else:
                last.append(new)
            if mark:
                around.append(new)
            state = {"{": "name", "[": "item", None: "after"}[mark]
        elif state == "name" and string:
            name, state = json.loads(string), ":"
        elif state == ":" and mark == ":":
            state = "value"
        elif state == "after" and mark == ",":
            state = "name" if isinstance(last, dict) else "item"
        elif mark == ("}" if isinstance(last, dict) else "]") and state in ("name", "item", "after"):
            around.pop()
            state = "after"
        else:
            raise ValueError(f"no JSON at {at}")
        at = m.end()
        if state == "after" and len(around) == 1:
            state = "end"
    if not _END.match(text, at):
        raise ValueError(f"more than one value at {at}")
    return root[0]


def outline(text: str, names: frozenset[str]) -> str | None:
    """A JSON object's members of these names as JSON that Spark reads: texts, and lists and objects of texts, with 0 for all else. "[]" for another
    value; null where the text is no JSON."""
    try:
        found = value(text)
    except ValueError:
        return None
    if not isinstance(found, dict):
        return "[]"
    return json.dumps({k: _outlined(v) for k, v in found.items() if k in names}, ensure_ascii=False)


def _outlined(v):
    of = lambda x: x if isinstance(x, str) else 0
    return {k: of(x) for k, x in v.items()} if isinstance(v, dict) else [of(x) for x in v] if isinstance(v, list) else of(v)
