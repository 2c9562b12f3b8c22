"""Rules: their model, the built-in catalog, user catalogs in TOML, and the translation of patterns to the two regular
expression dialects in use."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from importlib import resources

SEVERITIES = ("low", "medium", "high", "critical")
KINDS = ("regex", "ast_node_type", "call_expression", "member_expression", "subscript_expression", "entropy", "long_line")
NODE_KINDS = ("call_expression", "new_expression", "member_expression", "subscript_expression", "string", "template_string")
#: Bytes around a match in which a rule's second pattern must match.
NEAR = 150
_CYRILLIC = "\u0400-\u052f\u1c80-\u1c8a\u1d2b\u1d78\u2de0-\u2dff\ua640-\ua69f\ufe2e\ufe2f"
_GREEK = "\u0370-\u0373\u0375-\u0377\u037a-\u037d\u037f\u0384\u0386\u0388-\u038a\u038c\u038e-\u03a1\u03a3-\u03e1\u03f0-\u03ff\u1d26-\u1d2a\u1f00-\u1ffe"


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    description: str
    severity: str
    kind: str
    pattern: str = ""
    near: str | None = None
    threshold: float | None = None
    tags: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if self.severity not in SEVERITIES:
            raise ValueError(f"{self.id}: unknown severity {self.severity}")
        if self.kind not in KINDS:
            raise ValueError(f"{self.id}: unknown kind {self.kind}")
        if self.kind == "ast_node_type" and self.pattern.split(":")[0] not in NODE_KINDS:
            raise ValueError(f"{self.id}: node kinds are {', '.join(NODE_KINDS)}")

    @property
    def rank(self) -> int:
        return severity_rank(self.severity)


def severity_rank(name: str) -> int:
    """1 (low) to 4 (critical)."""
    if name.lower() not in SEVERITIES:
        raise ValueError(f"unknown severity {name}")
    return SEVERITIES.index(name.lower()) + 1


def parse_rules(toml: str) -> list[Rule]:
    """Rules from TOML: an array of tables named rule; a second pattern may be called near or pattern2."""
    out = []
    for r in tomllib.loads(toml).get("rule", []):
        near = r.get("near", r.get("pattern2"))
        out.append(Rule(r["id"], r["name"], r["description"], r["severity"].lower(), r["kind"], r.get("pattern", ""), near, r.get("threshold"), tuple(r.get("tags", ()))))
    return out


def builtin_rules() -> list[Rule]:
    return parse_rules(resources.files(__package__).joinpath("rules.toml").read_text(encoding="utf-8"))


def load_rules(path: str | None = None, extend: bool = False) -> list[Rule]:
    """A user's rules replace the built-in ones, or extend them. Patterns that could take exponential time are refused."""
    if path is None:
        return builtin_rules()
    with open(path, encoding="utf-8") as f:
        own = parse_rules(f.read())
    for r in own:
        if r.kind == "regex" and any(map(explosive, filter(None, (r.pattern, r.near)))):
            raise ValueError(f"{r.id}: its pattern repeats without bound what is itself only repetition, so some texts would never end")
    return builtin_rules() + own if extend else own


def to_python(pattern: str) -> str:
    """A pattern of a Unicode-aware linear-time dialect for Python's re."""
    pattern = re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern)
    pattern = pattern.replace(r"\p{Cyrillic}", _CYRILLIC).replace(r"\p{Greek}", _GREEK)
    return re.sub(r"(?<!\\)\$(?=$|\))", r"\\Z", pattern)


def to_java(pattern: str) -> str:
    """The same for Java: Unicode classes, a line end is \\n alone, $ is the text's end."""
    fold = pattern.startswith("(?i)")
    pattern = pattern.removeprefix("(?i)").replace(r"\p{Cyrillic}", r"\p{IsCyrillic}").replace(r"\p{Greek}", r"\p{IsGreek}")
    pattern = re.sub(r"(?<!\\)\$(?=$|\))", r"\\z", pattern)
    return ("(?diuU)" if fold else "(?dU)") + pattern


def compiled(pattern: str) -> re.Pattern | None:
    """None when the pattern isn't valid: such a rule never matches."""
    try:
        return re.compile(to_python(pattern))
    except re.error:
        return None


@dataclass(frozen=True)
class Needs:
    """What a text must have for a pattern to match: one of the literals (empty: unknown), compared case-folded where the
    pattern ignores case; one of some characters that aren't ASCII; and each of some marks."""

    literals: tuple[str, ...] = ()
    folded: bool = False
    wide: bool = False
    beyond: re.Pattern | None = None  # the characters, where wide
    marks: tuple[str, ...] = ()


def needed(pattern: str) -> Needs:
    """The needs of a pattern, from its syntax tree. Lets most texts skip most patterns."""
    from re import _constants as c
    from re import _parser

    def literals(seq) -> tuple[str, ...]:
        best: tuple[str, ...] = ()
        run = ""

        def worth(found: tuple[str, ...]) -> tuple[int, bool]:  # of two as short, the one with marks is rarer in prose
            return min(map(len, found)), not any(map(str.isalpha, found))

        def better(found: tuple[str, ...]) -> None:
            nonlocal best
            if found and min(map(len, found)) >= 2 and (not best or worth(found) > worth(best)):
                best = found

        for op, arg in seq:
            if op is c.LITERAL:
                run += chr(arg)
                continue
            better((run,))
            run = ""
            if op is c.SUBPATTERN:
                better(literals(arg[3]))
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and arg[0] > 0:
                better(literals(arg[2]))
            elif op is c.BRANCH:
                parts = [literals(x) for x in arg[1]]
                if all(parts):
                    better(tuple({x for p in parts for x in p}))
        better((run,))
        return best

    def wide(seq) -> list[tuple[int, int]]:
        """Ranges of characters beyond ASCII; every match has one of them. Empty: unknown."""
        for op, arg in seq:
            found: list[tuple[int, int]] = []
            if op is c.LITERAL and arg > 127:
                found = [(arg, arg)]
            elif op is c.IN and all((o is c.LITERAL and v > 127) or (o is c.RANGE and v[0] > 127) for o, v in arg):
                found = [(v, v) if o is c.LITERAL else v for o, v in arg]
            elif op is c.SUBPATTERN:
                found = wide(arg[3])
            elif op is c.BRANCH and all(parts := [wide(x) for x in arg[1]]):
                found = [r for p in parts for r in p]
            if found:
                return found
        return []

    def marks(seq) -> set[str]:
        """Characters other than letters and digits that every match has."""
        found: set[str] = set()
        for op, arg in seq:
            if op is c.LITERAL and arg < 128 and not chr(arg).isalnum():
                found.add(chr(arg))
            elif op is c.SUBPATTERN:
                found |= marks(arg[3])
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and arg[0] > 0:
                found |= marks(arg[2])
        return found

    try:
        tree = _parser.parse(to_python(pattern))
    except re.error:
        return Needs()
    folded = bool(tree.state.flags & re.I)
    found, ranges = literals(tree), [] if folded else wide(tree)
    beyond = re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]") if ranges else None
    return Needs(tuple(x.casefold() for x in found) if folded else found, folded, beyond is not None, beyond, tuple(sorted(marks(tree))))


def explosive(pattern: str) -> bool:
    """Whether a pattern repeats without bound what may itself be nothing but repetitions or options, such as (a+)+ or (\\w*\\s?)*: a backtracking
    engine may then need time exponential in the text."""
    from re import _constants as c
    from re import _parser

    repeats = (c.MAX_REPEAT, c.MIN_REPEAT)

    def loose(seq) -> bool:
        """Whether a match of seq may consist of repeated or optional parts alone, with at least one unbounded one."""
        unbounded = False
        for op, arg in seq:
            if op is c.SUBPATTERN:
                if not loose(arg[3]):
                    return False
                unbounded = True
            elif op is c.BRANCH:
                if not any(map(loose, arg[1])):
                    return False
                unbounded = True
            elif op in repeats:
                unbounded |= arg[1] is c.MAXREPEAT
                if arg[1] is not c.MAXREPEAT and arg[0] > 0:
                    return False
            elif op is not c.AT:
                return False
        return unbounded

    def search(seq) -> bool:
        for op, arg in seq:
            if op in repeats and (arg[1] is c.MAXREPEAT and loose(arg[2]) or search(arg[2])):
                return True
            if op is c.SUBPATTERN and search(arg[3]) or op is c.BRANCH and any(map(search, arg[1])) or op in (c.ATOMIC_GROUP,) and search(arg):
                return True
            if op in (c.ASSERT, c.ASSERT_NOT) and search(arg[1]):
                return True
        return False

    try:
        return search(_parser.parse(to_python(pattern)))
    except re.error:
        return False


# A finding's category is that of its first tag found here.
CATEGORIES = {
    "obfuscation": "Obfuscation",
    "execution": "Execution",
    "exfiltration": "Exfiltration",
    "network": "Network",
    "c2": "Network",
    "filesystem": "Filesystem",
    "manifest": "Manifest",
    "recon": "Recon",
    "encoding": "Obfuscation",
    "structure": "Obfuscation",
    "prototype-pollution": "Execution",
    "crypto": "Execution",
}
POINTS = {"critical": 25, "high": 10, "medium": 4, "low": 1}
