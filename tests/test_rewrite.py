import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillscan.functions.pretty import pretty
from quillscan.functions.rewrite import PASSES, block_end, rewrite, run_pass, unbase64
from quillscan.plans.samples import REWRITES


@pytest.mark.parametrize(("name", "text", "want", "changes"), [c for c in REWRITES if c[0] != "pretty"])
def test_single_pass(name, text, want, changes):
    assert run_pass(name, text) == (want, changes)


def test_rounds_build_on_each_other():
    text, record = rewrite("eval(atob('YSgp'))")
    assert text == "/* unwrapped:eval */ a()" and [p for p, _ in record] == ["string_decode", "eval_unwrap"]
    nested = "x"
    for _ in range(9):
        nested = f'eval("{nested}")' if '"' not in nested else f"eval('{nested}')" if "'" not in nested else nested
    assert rewrite(nested)[0].endswith("x")


def test_base64_as_scripts_use_it():
    assert unbase64("aGk=") == unbase64("aGk") == unbase64("aG=k") == "hi"
    assert unbase64("////") is None and unbase64("=") == ""


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab01+-*/()[]{}'\"`\\ \n!?:;,evalxuif", max_size=60))
def test_any_text_reaches_an_end(text):
    once, record = rewrite(text)
    if not record or record[-1][0] != "iteration_limit":
        assert rewrite(once) == (once, [])
    assert isinstance(pretty(text), str)


def test_hard_texts_stay_fast():
    rewrite("true ? " + '"a" ' * 3000)
    rewrite('"' + "\\x41" * 20_000 + '"')
    assert block_end("{" * 5000, 0) is None


def test_layout():
    assert pretty('function f(){a();for(i=0;i<2;i++){b("x;y")}}else1') == 'function f(){\n  a();\n  for(i=0;i<2;i++){\n    b("x;y")\n  }\n}\nelse1'
    assert pretty("if(a){b}else{c}") == "if(a){\n  b\n} else{\n  c\n}"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*(c[1] for c in REWRITES if c[0] != "pretty"), " ", "+", '"', "'", "a", "?", "b:c", "||", "\\x41", "\\u0041", "(", ")", "!0", "`"]), max_size=6).map("".join))
def test_steps_left_out_would_change_nothing(text):
    for name, steps in PASSES:
        whole, total = text, 0
        for step in steps:
            whole, n = step.apply(whole)
            total += n
        assert run_pass(name, text) == (whole, total)


def test_prose_is_left_to_few_steps():
    prose = "It's true that \"one\" was if not void of (some) sense, 1 + 1 = 2; she said 'no'.\n" * 5
    assert sum(step.may_apply(prose) for _, steps in PASSES for step in steps) <= 12
    assert rewrite(prose) == (prose, [])
