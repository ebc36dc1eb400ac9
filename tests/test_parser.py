import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.plans.syntax import INTRINSICS, STRUCTURAL, Aggregate, Attribute, Binary, Exists, Filter, Intrinsic, Literal, Metric, Pipeline, QueryError, ScalarFilter, Select, SpansetOp, TopK, Unary, nanoseconds, parse


def only(text):
    return parse(text).pipeline.stages[0]


def cond(text):
    return only("{ " + text + " }").expression


def test_precedence():
    assert cond(".a = 1 || .b = 2 && .c = 3").op == "||"
    assert cond("!.a = 1") == Binary("=", Unary("!", Attribute("", "a")), Literal("int", 1))
    assert cond("1 + 2 * 3 > 4").left == Binary("+", Literal("int", 1), Binary("*", Literal("int", 2), Literal("int", 3)))
    power = cond(".x = 2 ^ 3 ^ 2").right
    assert power.right.op == "^" and power.left == Literal("int", 2)
    assert cond("(1 + 2) * 3 > 4").left.op == "*"


@pytest.mark.parametrize("name", sorted(INTRINSICS))
def test_every_intrinsic(name):
    if name != "parent":
        assert cond(f"{name} != nil") == Exists(Intrinsic(INTRINSICS[name]))


def test_attributes_and_scopes():
    assert cond(".error = true").left == Attribute("", "error")
    assert cond("resource.service.name = nil") == Exists(Attribute("resource", "service.name"), True)
    assert cond("parent.span.x = 1").left == Attribute("span", "x", True)
    assert cond("foo = 1").left == Attribute("", "foo")
    assert cond(".rate = 1").left == Attribute("", "rate")
    assert cond(".http.user-agent = 1").left.op == "-"
    assert cond("status = error").right == Literal("status", "STATUS_CODE_ERROR")
    assert cond("kind = server").right == Literal("spankind", "SPAN_KIND_SERVER")


def test_literals():
    assert nanoseconds("1h30m") == 5_400_000_000_000
    assert nanoseconds("1.5s") == 1_500_000_000
    assert nanoseconds("2d") == 172_800_000_000_000
    assert nanoseconds("3µs") == 3000
    assert cond(r'.a = "q\"\\\n\x"').right.value == 'q"\\\n\\x'
    assert cond(".a = -1.5").right == Literal("float", -1.5)
    assert cond("-5 < .a").left == Literal("int", -5)


@pytest.mark.parametrize("op", ["&&", "||", *STRUCTURAL])
def test_every_spanset_operator(op):
    for rhs in ("{ .b = 1 }", "({ .b = 1 } | count() > 1)"):
        e = only("{ .a = 1 } " + op + " " + rhs)
        assert isinstance(e, SpansetOp) and e.op == op


def test_chains_are_left_associative():
    e = only("{ .a = 1 } > { .b = 1 } >> { .c = 1 }")
    assert e.op == ">>" and e.left.op == ">"


def test_pipelines():
    stages = parse("{ } | count() > 3 | select(.a, span.b) | by(name) | coalesce()").pipeline.stages
    assert isinstance(stages[1], ScalarFilter) and stages[1].left == Aggregate("count")
    assert isinstance(stages[2], Select) and len(stages[2].columns) == 2
    wrapped = only("({ .a = 1 } | avg(duration)) >= 1s")
    assert isinstance(wrapped, Pipeline) and isinstance(wrapped.stages[-1], ScalarFilter)
    m, top = parse("{ } | quantile_over_time(duration, 0.5, .9) by (name, .a) | topk(3)").pipeline.stages[1:]
    assert isinstance(m, Metric) and m.numbers == (0.5, 0.9) and len(m.by) == 2
    assert top == TopK(3)


def test_hints_and_empty():
    q = parse("{ } with(sample=0.1, prewhere=true)")
    assert q.hints["sample"] == Literal("float", 0.1)
    assert parse("  ").pipeline.stages == (Filter(),)
    assert cond("&& status = ok").op == "&&"
    assert cond("|| status = ok").op == "||"


@pytest.mark.parametrize("bad", ["{", "}", "{ .a = }", "{ .a = 1 = 2 }", "{ } |", "{ } { }", "{ foo:bar = 1 }", '{ .a = "x }', "rate(", "{ } | topk(.a)", "#", "{ } | select(1)", "({ }) > 3", "{ .a > }", "by()"])
def test_errors(bad):
    with pytest.raises(QueryError):
        parse(bad)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='{}()|&<>!~=.,"+-*/^ abcount1rate5sbyz', max_size=30))
def test_any_text_parses_or_is_refused(text):
    try:
        parse(text)
    except QueryError:
        pass
