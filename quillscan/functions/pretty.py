"""Laying out JavaScript text for reading: one statement a line, blocks indented by two spaces. Strings, templates,
comments and regular expressions stay as they are; only the white space between tokens changes."""

from __future__ import annotations

import re

_PART = re.compile(r"//[^\n]*|/\*(?:.*?\*/|.*)|\"(?:[^\"\\]|\\.)*+\"?|'(?:[^'\\]|\\.)*+'?|`(?:[^`\\]|\\.)*+`?|\s+|[{}();,]|[^\s{}();,\"'`/]+|.", re.S)
_AFTER_BLOCK = re.compile(r"\s*(?:else|catch|finally)\b")
_TAIL = re.compile(r"[ \t]*([);,]*)")


def pretty(text: str) -> str:
    lines, line, depth, parens, at = [], "", 0, [0], 0

    def flush() -> None:
        nonlocal line
        lines.append(line.rstrip())
        line = ""

    def add(s: str) -> None:
        nonlocal line
        line = (line or "  " * depth) + s

    while at < len(text):
        m = _PART.match(text, at)
        s, at = m[0], m.end()
        if s.isspace():
            if line.strip():
                line += " " * (not line.endswith(" "))
        elif s == "{":
            add(s)
            flush()
            depth += 1
            parens.append(0)
        elif s == "}":
            if line.strip():
                flush()
            line, depth = "", max(0, depth - 1)
            if len(parens) > 1:
                parens.pop()
            tail = _TAIL.match(text, at)
            parens[-1] = max(0, parens[-1] - tail[1].count(")"))
            add("}" + tail[1])
            at = tail.end()
            if _AFTER_BLOCK.match(text, at):
                line += " "
            else:
                flush()
        elif s.startswith("//"):
            add(s)
            flush()
        else:
            parens[-1] += (s == "(") - (s == ")" and parens[-1] > 0)
            add(s)
            if s == ";" and not parens[-1] or s == "," and depth and not parens[-1]:
                flush()
    if line.strip():
        flush()
    out = [x for k, x in enumerate(lines) if x.strip() or (k and lines[k - 1].strip())]
    return "\n".join(out).rstrip()
