"""TraceQL text to syntax trees: one regular expression for tokens, binding powers for operators.

Trees are frozen dataclasses; nothing here knows Spark. ``parse`` raises ``QueryError`` with the position for any text that
isn't a query.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class QueryError(ValueError):
    """The query can't be parsed or makes no sense."""


# ---------------------------------------------------------------- trees


@dataclass(frozen=True)
class Literal:
    """kind: int, float, string, bool, duration (ns), status, spankind, nil."""

    kind: str
    value: object


@dataclass(frozen=True)
class Attribute:
    """scope: "", resource, span, event, link, instrumentation; parent: of the parent span."""

    scope: str
    name: str
    parent: bool = False


@dataclass(frozen=True)
class Intrinsic:
    name: str
    parent: bool = False


@dataclass(frozen=True)
class Unary:
    op: str
    value: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Exists:
    """``x != nil``; negated: ``x = nil``."""

    value: object
    negated: bool = False


@dataclass(frozen=True)
class Filter:
    """``{ expression }``; None matches every span."""

    expression: object = None


@dataclass(frozen=True)
class SpansetOp:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Aggregate:
    fn: str
    argument: object = None


@dataclass(frozen=True)
class ScalarMath:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class ScalarFilter:
    op: str
    left: object
    right: Literal


@dataclass(frozen=True)
class GroupBy:
    expression: object


@dataclass(frozen=True)
class Coalesce:
    pass


@dataclass(frozen=True)
class Select:
    columns: tuple


@dataclass(frozen=True)
class Metric:
    fn: str
    argument: object = None
    numbers: tuple[float, ...] = ()
    by: tuple = ()


@dataclass(frozen=True)
class TopK:
    n: int
    bottom: bool = False


@dataclass(frozen=True)
class Pipeline:
    stages: tuple


@dataclass(frozen=True)
class Query:
    pipeline: Pipeline
    hints: dict = field(default_factory=dict)


# ---------------------------------------------------------------- words of the language (fixed values)

SCOPES = ("resource", "span", "event", "link", "instrumentation")
STATUSES = {"error": "STATUS_CODE_ERROR", "ok": "STATUS_CODE_OK", "unset": "STATUS_CODE_UNSET"}
KINDS = {k: f"SPAN_KIND_{k.upper()}" for k in ("unspecified", "internal", "client", "server", "producer", "consumer")}
#: Spelling to intrinsic.
INTRINSICS = {
    "duration": "duration", "span:duration": "duration", "name": "name", "span:name": "name", "status": "status", "span:status": "status",
    "statusMessage": "statusMessage", "span:statusMessage": "statusMessage", "kind": "kind", "span:kind": "kind", "childCount": "childCount", "span:childCount": "childCount",
    "trace:id": "traceID", "span:id": "spanID", "span:parentID": "parentID", "instrumentation:name": "scopeName", "instrumentation:version": "scopeVersion",
    "rootServiceName": "rootServiceName", "trace:rootService": "rootServiceName", "rootName": "rootName", "trace:rootName": "rootName",
    "traceDuration": "traceDuration", "trace:duration": "traceDuration", "nestedSetParent": "nestedSetParent", "spanStartTime": "spanStartTime",
    "event:name": "eventName", "event:timeSinceStart": "eventTime", "link:spanID": "linkSpanID", "link:traceID": "linkTraceID", "parent": "parent",
}
AGGREGATES = ("count", "min", "max", "sum", "avg")
METRICS = ("rate", "count_over_time", "min_over_time", "max_over_time", "avg_over_time", "sum_over_time", "quantile_over_time", "histogram_over_time")
#: Spanset operators after the boolean ones: structure, its negation, its union with the left side.
STRUCTURAL = tuple(p + o for p in ("", "!", "&") for o in (">", "<", ">>", "<<", "~"))
_UNITS = {"ns": 1, "us": 10**3, "µs": 10**3, "μs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86_400 * 10**9}

_TOKEN = re.compile(
    r"""(?P<space>\s+)
    |(?P<duration>(?:\d+(?:\.\d+)?(?:ns|us|µs|μs|ms|s|m|h|d))+(?![A-Za-z0-9_]))
    |(?P<float>\d+\.\d+|(?<![\w)\]])\.\d+(?![\w.]))|(?P<int>\d+)
    |(?P<string>"(?:[^"\\]|\\.)*")
    |(?P<word>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<sign>!>>|!<<|&>>|&<<|!>|!<|!~|&>|&<|&~|&&|\|\||=~|!=|<=|>=|>>|<<|[{}()|,.:=<>~!+\-*/%^])""",
    re.X | re.S,
)
_ESCAPES = {'"': '"', "\\": "\\", "n": "\n", "t": "\t", "r": "\r"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int

    @property
    def end(self) -> int:
        return self.at + len(self.text)


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected character {text[at]!r} at position {at}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    return [*out, Token("end", "", at)]


def nanoseconds(text: str) -> int:
    """Of a duration such as 1h30m or 1.5s."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|μs|ms|s|m|h|d)", text)
    return sum(int(n) * _UNITS[u] if n.isdigit() else round(float(n) * _UNITS[u]) for n, u in parts)


#: Binding power and whether the operator is right-associative; comparisons don't associate.
_POWER = {"||": 1, "&&": 2, **dict.fromkeys(("=", "!=", "<", "<=", ">", ">=", "=~", "!~"), 3), "+": 4, "-": 4, "*": 5, "/": 5, "%": 5, "^": 6}
_COMPARE = ("=", "!=", "<", "<=", ">", ">=")


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokenize(text), 0

    # -- tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def take(self, *texts: str) -> Token | None:
        """The token if it is one of these signs or words."""
        t = self.now
        if t.text in texts and t.kind in ("sign", "word"):
            self.at += 1
            return t
        return None

    def need(self, *texts: str) -> Token:
        if (t := self.take(*texts)) is None:
            self.fail(" or ".join(map(repr, texts)))
        return t

    def fail(self, wanted: str):
        raise QueryError(f"expected {wanted} at position {self.now.at}, found {self.now.text or 'the end'!r}")

    # -- pipelines

    def query(self) -> Query:
        pipeline, hints = self.pipeline(), {}
        if self.take("with"):
            self.need("(")
            while not self.take(")"):
                name = self.now.text
                if self.now.kind != "word":
                    self.fail("a hint's name")
                self.at += 1
                self.need("=")
                hints[name] = self.literal()
                if not self.take(","):
                    self.need(")")
                    break
        if self.now.kind != "end":
            self.fail("the end of the query")
        return Query(pipeline, hints)

    def pipeline(self) -> Pipeline:
        stages = [self.stage()]
        while self.take("|"):
            stages.append(self.stage())
        return Pipeline(tuple(stages))

    def stage(self):
        t = self.now
        if t.text in ("{", "(") and t.kind == "sign":
            left = self.operand()
            while op := self.spanset_operator():
                left = SpansetOp(op, left, self.operand())
            return left
        if t.kind == "word":
            if t.text in AGGREGATES:
                return self.compared(self.aggregate())
            if t.text in METRICS:
                return self.metric()
            if self.take("by"):
                self.need("(")
                e = self.field()
                self.need(")")
                return GroupBy(e)
            if self.take("coalesce"):
                self.need("(")
                self.need(")")
                return Coalesce()
            if self.take("select"):
                return Select(self.listed())
            if self.take("topk", "bottomk"):
                self.need("(")
                n = self.literal()
                self.need(")")
                if n.kind != "int":
                    raise QueryError(f"{t.text} takes a whole number")
                return TopK(n.value, t.text == "bottomk")
        self.fail("a pipeline stage")

    def operand(self):
        if self.take("("):
            inner = self.pipeline()
            self.need(")")
            if self.now.text in _COMPARE and not (self.now.text in "<>" and self.ahead().text in ("{", "(")):
                *before, last = inner.stages
                if not isinstance(last, Aggregate | ScalarMath):
                    raise QueryError("only an aggregate can be compared")
                last = self.compared(last)
                return Pipeline((*before, last)) if before else last
            return inner.stages[0] if len(inner.stages) == 1 else inner
        self.need("{")
        if self.take("}"):
            return Filter()
        if self.now.text in ("&&", "||"):  # the left side is implied to be true
            e = self.infix(Literal("bool", True), 0)
        else:
            e = self.field()
        self.need("}")
        return Filter(e)

    def spanset_operator(self) -> str | None:
        t, nxt = self.now, self.ahead().text
        if t.kind != "sign" or t.text not in ("&&", "||", *STRUCTURAL):
            return None
        if t.text in ("<", ">", "!~") and nxt not in ("{", "("):
            return None
        self.at += 1
        return t.text

    def aggregate(self) -> Aggregate:
        fn = self.need(*AGGREGATES).text
        self.need("(")
        arg = None if self.now.text == ")" else self.field()
        self.need(")")
        return Aggregate(fn, arg)

    def compared(self, left):
        while t := self.take("+", "-", "*", "/"):
            left = ScalarMath(t.text, left, self.aggregate() if self.now.text in AGGREGATES else self.literal())
        if t := self.take(*_COMPARE):
            return ScalarFilter(t.text, left, self.literal())
        return left

    def metric(self) -> Metric:
        fn = self.need(*METRICS).text
        self.need("(")
        arg, numbers = None, []
        while not self.take(")"):
            if self.now.kind in ("int", "float"):
                numbers.append(float(self.now.text))
                self.at += 1
            else:
                arg = self.field()
            if not self.take(","):
                self.need(")")
                break
        return Metric(fn, arg, tuple(numbers), self.listed() if self.take("by") else ())

    def listed(self) -> tuple:
        self.need("(")
        out = [self.reference()]
        while self.take(","):
            out.append(self.reference())
        self.need(")")
        return tuple(out)

    def reference(self):
        e = self.primary()
        if not isinstance(e, Attribute | Intrinsic):
            raise QueryError("an attribute is expected")
        return e

    # -- field expressions

    def field(self):
        return self.infix(self.unary(), 0)

    def infix(self, left, least: int):
        while (power := _POWER.get(self.now.text, 0)) > least and self.now.kind == "sign":
            op = self.now.text
            self.at += 1
            if op in ("=", "!=") and self.take("nil"):
                left = Exists(left, op == "=")
            else:
                right = self.infix(self.unary(), power - (op == "^"))
                left = Binary(op, left, right)
            if power == 3 and _POWER.get(self.now.text) == 3:
                self.fail("no second comparison")
        return left

    def unary(self):
        if t := self.take("!", "-"):
            v = self.unary()
            if t.text == "-" and isinstance(v, Literal) and v.kind in ("int", "float", "duration"):
                return Literal(v.kind, -v.value)
            return Unary(t.text, v)
        return self.primary()

    def literal(self) -> Literal:
        negative = bool(self.take("-"))
        v = self.primary()
        if isinstance(v, Attribute | Intrinsic):
            raise QueryError("a literal is expected")
        if negative:
            if not isinstance(v, Literal) or v.kind not in ("int", "float", "duration"):
                raise QueryError("only numbers can be negative")
            return Literal(v.kind, -v.value)
        if not isinstance(v, Literal):
            raise QueryError("a literal is expected")
        return v

    def primary(self):
        t = self.now
        if self.take("("):
            e = self.field()
            self.need(")")
            return e
        if self.take("."):
            return Attribute("", self.dotted())
        self.at += 1
        if t.kind == "int":
            return Literal("int", int(t.text))
        if t.kind == "float":
            return Literal("float", float(t.text))
        if t.kind == "duration":
            return Literal("duration", nanoseconds(t.text))
        if t.kind == "string":
            return Literal("string", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), t.text[1:-1], flags=re.S))
        if t.kind != "word":
            self.at -= 1
            self.fail("a value")
        return self.named(t)

    def named(self, t: Token):
        word, follows = t.text, self.now.text if self.now.kind == "sign" and self.now.at == t.end else ""
        if follows == ":":
            self.at += 1
            if self.now.kind != "word":
                self.fail("a name")
            full = f"{word}:{self.now.text}"
            if full not in INTRINSICS:
                raise QueryError(f"unknown intrinsic {full!r} at position {t.at}")
            self.at += 1
            return Intrinsic(INTRINSICS[full])
        if follows == ".":
            self.at += 1
            if word == "parent":
                return self.of_parent()
            if word in SCOPES:
                return Attribute(word, self.dotted())
            return Attribute("", f"{word}.{self.dotted()}")
        if word in ("true", "false"):
            return Literal("bool", word == "true")
        if word == "nil":
            return Literal("nil", None)
        if word in STATUSES:
            return Literal("status", STATUSES[word])
        if word in KINDS:
            return Literal("spankind", KINDS[word])
        if word in INTRINSICS:
            return Intrinsic(INTRINSICS[word])
        return Attribute("", word)

    def of_parent(self):
        """After ``parent.``: an attribute with or without a scope."""
        name = self.dotted()
        scope, _, rest = name.partition(".")
        if scope in SCOPES and rest:
            return Attribute(scope, rest, True)
        return Intrinsic(INTRINSICS[name], True) if name in INTRINSICS and name != "parent" else Attribute("", name, True)

    def dotted(self) -> str:
        parts = []
        while True:
            if self.now.kind not in ("word", "int") or parts and self.now.at != self.tokens[self.at - 1].end:
                self.fail("a name")
            parts.append(self.now.text)
            self.at += 1
            if not (self.now.text == "." and self.now.at == self.tokens[self.at - 1].end):
                return ".".join(parts)
            self.at += 1


def parse(text: str) -> Query:
    """The query; blank text is ``{ }``."""
    return _Parser(text if text.strip() else "{ }").query()


def walk(node):
    """The node and all nodes below it."""
    yield node
    for value in vars(node).values() if hasattr(node, "__dataclass_fields__") else ():
        for x in value if isinstance(value, tuple) else (value,):
            if hasattr(x, "__dataclass_fields__"):
                yield from walk(x)
