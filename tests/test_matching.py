import math
from string import ascii_letters, digits

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillscan.functions import js, matching
from quillscan.functions.catalog import Rule, builtin_rules, explosive, load_rules, parse_rules, to_java, to_python
from quillscan.functions.matching import Text, dialect, entropy, hits, prepare, suppressed
from quillscan.plans.samples import RULES

ALL = prepare(builtin_rules())


def one(kind, pattern="", content="", **more):
    return [(h.line, h.column) for h in hits(content, prepare([Rule("X", "x", "x", "low", kind, pattern, **more)]))]


def test_catalog():
    rules = builtin_rules()
    assert len(rules) == 102 and len({r.id for r in rules}) == 102
    assert sum(r.kind == "regex" for r in rules) == 95 and sum(r.near is not None for r in rules) == 30
    assert not [r.rule.id for r in ALL if r.rule.kind == "regex" and r.primary is None]


@pytest.mark.parametrize("rule_id", list(RULES))
def test_every_rule_finds_its_sample_and_leaves_plain_code(rule_id):
    found = {ALL[h.rule].rule.id for h in hits(RULES[rule_id], ALL)}
    assert rule_id in found
    plain = {ALL[h.rule].rule.id for h in hits("export const add = (a, b) => a + b;\nmodule.exports = { add };\n", ALL)}
    assert rule_id not in plain


def test_needs_never_hide_a_match():
    texts = [*RULES.values(), *(v.upper() for v in RULES.values()), *(v.swapcase() for v in RULES.values())]
    for r in ALL:
        for t in texts:
            if r.rule.kind == "regex" and r.primary.search(t):
                assert Text(t).may_match(r.needs), (r.rule.id, t)
    assert sum(bool(r.needs.literals) or r.needs.wide for r in ALL) >= 92


def test_places_and_snippets():
    assert one("regex", "b", "a\r\nébb\n𝕏b") == [(2, 2), (2, 3), (3, 2)]
    assert one("regex", "x$", "x\nx") == [(2, 1)]
    t = Text("ab\r\n" + "c" * 130)
    assert t.snippet(1) == "ab" and t.snippet(2) == "c" * 120 + "..."


@pytest.mark.parametrize(("gap", "hit"), [(149, True), (150, False)])
def test_near_is_counted_in_bytes(gap, hit):
    assert bool(one("regex", "AA", "AA" + "." * gap + "B", near="B")) is hit
    assert bool(one("regex", "AA", "B" + "." * gap + "AA", near="B")) is hit
    assert one("regex", "AA", "AA" + "é" * 74 + "..B", near="B") == []
    assert one("regex", "AA", "AA" + "é" * 75 + "é", near="é{75}$") == [(1, 1)]


def test_straddling_characters_widen_the_window():
    assert one("regex", "AA", "AA" + "." * 149 + "é", near="é") == [(1, 1)]


def test_long_lines_and_entropy():
    assert one("long_line", content="x" * 1000 + "\r\n" + "x" * 1001 + "\n" + "é" * 501, threshold=1000.0) == [(2, 1), (3, 1)]
    assert one("entropy", content="a = 'abcdefghijklmno'; b = 'abcdefghijklmnop'", threshold=3.9) == [(1, 28)]
    assert entropy("aabb") == 1.0 and entropy("") == 0.0 and math.isclose(entropy("abcd"), 2.0)


def test_syntax_rules():
    assert one("call_expression", "eval", "eval(x); a.eval(y); new eval(); f(eval); 'eval(z)'; `${eval(1)}`; /eval(2)/") == [(1, 1), (1, 56)]
    assert one("member_expression", "process.env", "process.env.A; process?.env; x.process.env; process.environment") == [(1, 1), (1, 1)]
    assert one("subscript_expression", "process.env", "process['env']; process[env]; process['x']") == [(1, 1), (1, 17)]
    assert one("ast_node_type", "new_expression:Function", "new Function(); new Other(); x = new Function") == [(1, 1), (1, 34)]
    assert one("call_expression", "a.b", "a.b(1); a . b(2)") == [(1, 1)]
    assert one("call_expression", "eval", "function eval(a) {} class A { eval(b) { return 1 } static eval(c) {} }") == []
    assert one("call_expression", "f", "a = b / f(1) / c; return /f(2)/.test(x)") == [(1, 9)]


def test_tokens_cover_odd_texts():
    for text in ("`a${`b${c}`}d`", "'unterminated", "`open ${x", "/* open", "#!/bin/x\na", "}}}", "a ? b : c", "x = y => ({a: 1})[0]", "1..toString()", "\\u0061b"):
        ts = js.tokens(text)
        assert all(text[t.start : t.end] == t.text for t in ts)
        js.nodes(text)


def test_suppression_and_dialects():
    assert suppressed("a\n// scan-ignore-next-line\nb\nc // scan-ignore-line") == {3, 4}
    assert [dialect(p) for p in ("a.js", "b/c.tsx", "d.mts", "e.JS", "f", ".js")] == ["javascript", "tsx", "typescript", None, None, None]


def test_user_rules():
    own = parse_rules('[[rule]]\nid = "U-1"\nname = "n"\ndescription = "d"\nseverity = "High"\nkind = "regex"\npattern = "a+"\npattern2 = "b"\ntags = ["c2"]')
    assert own == [Rule("U-1", "n", "d", "high", "regex", "a+", "b", None, ("c2",))]
    assert one("regex", "(", "(") == []  # an invalid pattern never matches
    assert one("regex", "a", "a", near="(") == [(1, 1)]
    with pytest.raises(ValueError):
        prepare([Rule("X", "x", "x", "low", "regex", "a*")])
    with pytest.raises(ValueError):
        Rule("X", "x", "x", "low", "ast_node_type", "if_statement")
    assert to_python(r"[\x{200B}]a$") == "[​]a\\Z" and to_java(r"(?i)\p{Greek}$") == r"(?diuU)\p{IsGreek}\z"


def test_native_form_gives_the_same_places(spark):
    from pyspark.sql import functions as F

    from quillscan.functions import native

    content = "ip 10.0.0.1\nétoken 10.0.0.2 " + "." * 200 + "\r\n10.0.0.3"
    rule = Rule("X", "x", "x", "low", "regex", r"\d+\.\d+\.\d+\.\d+", r"\btoken\b|étoken")
    want = [(h.line, h.column, h.snippet) for h in hits(content, prepare([rule]))]
    df = native.matches(spark.createDataFrame([(content,)], "content string"), "content", rule.pattern)
    df = df.where(native.near(F.col("content"), F.col("offset"), F.col("matched"), rule.near))
    df = df.withColumn("line", native.line_of(F.col("content"), F.col("offset")))
    got = df.select("line", native.column_of(F.col("content"), F.col("offset")), native.snippet_of(F.col("content"), F.col("line"))).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 2


def test_the_automaton_and_the_literal_test_hide_no_match(monkeypatch):
    import pandas as pd

    ready = prepare(builtin_rules())
    sf = "/root/testdata/sf0.001"
    texts = [*RULES.values(), *(x + "\n" + y for x, y in zip(RULES.values(), reversed(RULES.values()), strict=True)), *pd.read_parquet(f"{sf}/documents.parquet").text.dropna(), *pd.read_parquet(f"{sf}/pages.parquet").html.dropna()]
    texts += ["x = '" + "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7cF0xLrUoIi!@#%^&*()" + end for end in ("'", "", "\\\n z'", "\n'")] + ["`a\nB3dE6gH9jK2mN5pQ8sT1v\nW4yZ7cF0xLrUoIi!@#%^&*()`", "EVAL(x) ßſeval(y)"]
    fast = [hits(t, ready) for t in texts]
    monkeypatch.setattr(Text, "may_hold_literal", lambda self, n: True)
    assert fast == [hits(t, list(ready)) for t in texts] and sum(map(len, fast)) > 150


@pytest.mark.parametrize("pattern", ["(a+)+$", r"(?:\w*\s?)*!", "(x|[a-z]+)*y", "a(?:(?:b*)*)c", "(?=(a+)+b)"])
def test_patterns_that_may_never_end_are_refused(tmp_path, pattern):
    path = tmp_path / "r.toml"
    path.write_text(f"[[rule]]\nid = 'X'\nname = 'x'\ndescription = 'x'\nseverity = 'low'\nkind = 'regex'\npattern = '''{pattern}'''\n")
    with pytest.raises(ValueError, match="X: its pattern repeats"):
        load_rules(str(path))


def test_ordinary_patterns_are_kept():
    assert not [r.id for r in builtin_rules() if r.kind == "regex" and (explosive(r.pattern) or r.near and explosive(r.near))]
    assert not any(map(explosive, [r"(?:,\s*\w+\s*)+", "(ab+)*", "[a-z]+(?:-[a-z]+)*", "(?:a{1,3}){2}", "("]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["'", '"', "/", "//", "/*", "*/", "#!", "\\", "\n", " ", "return", "a", "1e+", "$", ")", "]", "}", "<", ">", "=", "[", ".", "é", "'x y'", "/[/']/g", "\\u{41}"]), max_size=14).map("".join))
def test_strings_are_those_of_the_tokenizer(text):
    assert js.strings(text) == [(n.start, n.end) for n in js.nodes(text) if n.kind == "string"]


def test_pages_and_prose_are_not_taken_apart(monkeypatch):
    """Long attributes are judged by their strings alone, and prose with a word of process.env isn't code."""
    page = '<p class="' + ascii_letters + digits + '">the environment\'s text</p>\n<br />'
    want = hits(page * 20, ALL)
    monkeypatch.setattr(js, "nodes", lambda text: pytest.fail("tokenized"))
    assert hits(page * 20, ALL) == want and [ALL[h.rule].rule.id for h in want] == ["OBF-006"] * 20


def test_patterns_wait_for_their_marks_and_characters():
    near = {r.rule.id: r.needs for r in ALL}
    assert not Text("a call (of) words, (and) such").may_match(near["OBF-010"]) and Text("a[b](c)(").may_match(near["OBF-010"])
    assert not Text("été naïve – “quoted”").may_match(near["GD-005"]) and Text("pаypal").may_match(near["GD-005"])
    assert not Text("she ran: her nc machine").may_match(near["SC-023"])
