"""Field expressions to columns, JVM-side throughout.

A missing attribute reads as the empty string, or as zero where a number is asked for; so ``span.x != "a"`` holds for spans
without x and ``span.x < 5`` too. Literals decide the coercion: whole numbers and durations read an attribute as a long,
decimals as a double, all else as a string.

``Fields`` says how spans must be prepared: ``needs`` names what a query refers to beyond a span's own row (its parent, its
trace, its children), which ``spanloom.operators.context`` adds by joins, and only then.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.plans.syntax import Attribute, Binary, Exists, Intrinsic, Literal, QueryError, Unary, walk

_COLUMNS = {
    "duration": "duration_ns", "name": "name", "status": "status", "statusMessage": "status_message", "kind": "kind", "traceID": "trace_id", "spanID": "span_id",
    "parentID": "parent_span_id", "scopeName": "scope_name", "scopeVersion": "scope_version", "spanStartTime": "start_ns",
}
#: Of the whole trace; at span level they read the span's own value instead.
_TRACE = {"rootServiceName": ("root_service", "service"), "rootName": ("root_name", "name"), "traceDuration": ("trace_duration_ns", "duration_ns")}
_NUMERIC = {"duration", "traceDuration", "spanStartTime", "childCount", "eventTime"}
_FLIP = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
_COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
_ARITHMETIC = ("+", "-", "*", "/", "%", "^")


def as_long(text: Column) -> Column:
    """Whole numbers as they are, all else 0."""
    return F.coalesce(F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long")), F.lit(0).cast("long"))


def as_double(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def needs(*nodes) -> set[str]:
    """Of parent, trace and children, what expressions refer to."""
    out = set()
    for node in nodes:
        for x in walk(node) if hasattr(node, "__dataclass_fields__") else ():
            if isinstance(x, Attribute | Intrinsic) and x.parent:
                out.add("parent")
            if isinstance(x, Intrinsic) and x.name in _TRACE:
                out.add("trace")
            if isinstance(x, Intrinsic) and x.name == "childCount":
                out.add("children")
    return out


@dataclass(frozen=True)
class Fields:
    """``trace_level``: trace intrinsics are the trace's own (else the span's, as some engines have it)."""

    trace_level: bool = True

    # -- predicates

    def predicate(self, e) -> Column:
        if e is None:
            return F.lit(True)
        if isinstance(e, Literal) and e.kind == "bool":
            return F.lit(e.value)
        if isinstance(e, Unary) and e.op == "!":
            return ~self.predicate(e.value)
        if isinstance(e, Exists):
            return ~self.exists(e.value) if e.negated else self.exists(e.value)
        if isinstance(e, Binary):
            if e.op in ("&&", "||"):
                a, b = self.predicate(e.left), self.predicate(e.right)
                return a & b if e.op == "&&" else a | b
            if e.op not in _ARITHMETIC:
                return self.comparison(e)
        raise QueryError("the expression is no condition")

    def comparison(self, e: Binary) -> Column:
        op, left, right = e.op, e.left, e.right
        if isinstance(left, Literal) and not isinstance(right, Literal) and op in _FLIP:
            op, left, right = _FLIP[op], right, left
        if isinstance(right, Literal):
            if isinstance(left, Attribute):
                return self.attribute(left, op, right)
            if isinstance(left, Intrinsic):
                return self.intrinsic(left, op, right)
        if op in ("=~", "!~"):
            pattern = self._pattern(right)
            found = self.text(left).rlike(pattern)
            return ~found if op == "!~" else found
        if _is_bool(left) and _is_bool(right):
            return _COMPARE[op](self.predicate(left), self.predicate(right))
        if self.numeric(left) or self.numeric(right):
            return _COMPARE[op](self.number(left), self.number(right))
        return _COMPARE[op](self.text(left), self.text(right))

    @staticmethod
    def _pattern(e) -> str:
        if not isinstance(e, Literal) or e.kind != "string":
            raise QueryError("a pattern must be a string")
        return e.value

    def test(self, text: Column, op: str, v: Literal) -> Column:
        """An attribute's text against a literal."""
        if v.kind == "nil":
            raise QueryError("nil can only be compared by = and !=")
        text = F.coalesce(text, F.lit(""))
        if op in ("=~", "!~"):
            found = text.rlike(self._pattern(v))
            return ~found if op == "!~" else found
        if v.kind in ("int", "duration"):
            return _COMPARE[op](as_long(text), F.lit(v.value).cast("long"))
        if v.kind == "float":
            return _COMPARE[op](as_double(text), F.lit(v.value))
        value = {True: "true", False: "false"}[v.value] if v.kind == "bool" else v.value
        return _COMPARE[op](text, F.lit(value))

    def attribute(self, a: Attribute, op: str, v: Literal) -> Column:
        if a.scope in ("event", "link"):
            return F.exists(F.col(f"{a.scope}s"), lambda x: self.test(x["attributes"][a.name], op, v))
        if a.scope == "":
            span = self.test(self.cell(a, "span_attributes")[a.name], op, v)
            own = self.cell(a, "service") if a.name == "service.name" else self.cell(a, "resource_attributes")[a.name]
            resource = self.test(own, op, v)
            return span & resource if op == "!~" else span | resource
        return self.test(self.text_of(a), op, v)

    def intrinsic(self, i: Intrinsic, op: str, v: Literal) -> Column:
        if i.name == "nestedSetParent":
            return self.nested_set(op, v, i.parent)
        if i.name in ("eventName", "eventTime"):
            value = (lambda x: x["name"]) if i.name == "eventName" else (lambda x: x["time_ns"] - F.col("start_ns"))
            return F.exists("events", lambda x: self._against(value(x), op, v, i.name == "eventTime"))
        if i.name in ("linkSpanID", "linkTraceID"):
            part = "span_id" if i.name == "linkSpanID" else "trace_id"
            return F.exists("links", lambda x: self._against(x[part], op, v, False))
        return self._against(self.value(i), op, v, i.name in _NUMERIC)

    def _against(self, value: Column, op: str, v: Literal, number: bool) -> Column:
        if not number:
            return self.test(value, op, v) if v.kind not in ("int", "float", "duration") else _COMPARE[op](as_double(value), F.lit(float(v.value)))
        if v.kind not in ("int", "float", "duration") or op in ("=~", "!~"):
            raise QueryError("a number is compared with a number")
        return _COMPARE[op](value, F.lit(v.value))

    def nested_set(self, op: str, v: Literal, of_parent: bool) -> Column:
        """The root's number is -1, all others' 0 or more: only which side of the literal these lie on is known."""
        if v.kind != "int" or op not in _COMPARE:
            return F.lit(True)
        r, root = v.value, self.cell(Intrinsic("nestedSetParent", of_parent), "parent_span_id") == ""
        if op in ("<", "<=", "=") and r < -1 or op == "<" and r == -1:
            return F.lit(False)
        if op in ("<=", "=") and r == -1 or op == "<" and r == 0:
            return root
        if op in (">", "!=") and r == -1 or op == ">=" and r == 0:
            return ~root
        return F.lit(True)

    def exists(self, x) -> Column:
        if isinstance(x, Attribute):
            if x.scope in ("event", "link"):
                return F.exists(F.col(f"{x.scope}s"), lambda e: F.coalesce(F.map_contains_key(e["attributes"], x.name), F.lit(False)))
            held = lambda m: F.coalesce(F.map_contains_key(self.cell(x, m), x.name), F.lit(False))
            if x.scope == "resource":
                return held("resource_attributes")
            return held("span_attributes") | held("resource_attributes") if x.scope == "" else held("span_attributes")
        if isinstance(x, Intrinsic):
            if x.name in ("eventName", "eventTime", "linkSpanID", "linkTraceID"):
                return F.array_size("events" if x.name.startswith("event") else "links") > 0
            value = self.value(x) if x.name != "nestedSetParent" else self.cell(x, "parent_span_id")
            return value.isNotNull() if x.name in _NUMERIC else F.coalesce(value, F.lit("")) != ""
        raise QueryError("only an attribute can be compared with nil")

    # -- values

    def cell(self, of, column: str) -> Column:
        """A column of the span, or of its parent."""
        return F.col(f"_parent_{column}") if of.parent else F.col(column)

    def text_of(self, a: Attribute) -> Column:
        """An attribute as text, '' if missing; without a scope the span's before the resource's."""
        if a.scope in ("event", "link"):
            held = F.filter(F.col(f"{a.scope}s"), lambda x: F.coalesce(F.map_contains_key(x["attributes"], a.name), F.lit(False)))
            return F.coalesce(F.get(held, 0)["attributes"][a.name], F.lit(""))
        span = self.cell(a, "span_attributes")[a.name]
        if a.name == "service.name" and a.scope in ("", "resource"):
            return F.coalesce(self.cell(a, "service"), F.lit(""))
        resource = self.cell(a, "resource_attributes")[a.name]
        if a.scope == "resource":
            return F.coalesce(resource, F.lit(""))
        if a.scope == "":
            return F.coalesce(F.nullif(span, F.lit("")), resource, F.lit(""))
        return F.coalesce(span, F.lit(""))

    def value(self, i: Intrinsic) -> Column:
        if i.name in _TRACE:
            whole, own = _TRACE[i.name]
            return F.col(whole) if self.trace_level else self.cell(i, own)
        if i.name == "childCount":
            return F.col("child_count")
        if i.name == "parent":
            return F.col("parent_span_id")
        if i.name == "nestedSetParent":
            return F.when(self.cell(i, "parent_span_id") == "", -1).otherwise(0)
        if i.name == "eventName":
            return F.coalesce(F.get("events", 0)["name"], F.lit(""))
        if i.name == "eventTime":
            return F.get("events", 0)["time_ns"] - F.col("start_ns")
        if i.name in ("linkSpanID", "linkTraceID"):
            return F.coalesce(F.get("links", 0)["span_id" if i.name == "linkSpanID" else "trace_id"], F.lit(""))
        return self.cell(i, _COLUMNS[i.name])

    def numeric(self, e) -> bool:
        if isinstance(e, Literal):
            return e.kind in ("int", "float", "duration")
        if isinstance(e, Intrinsic):
            return e.name in _NUMERIC or e.name == "nestedSetParent"
        return isinstance(e, Unary) and e.op == "-" or isinstance(e, Binary) and e.op in _ARITHMETIC

    def text(self, e) -> Column:
        if isinstance(e, Literal):
            return F.lit({True: "true", False: "false"}.get(e.value, e.value) if e.kind == "bool" else str(e.value))
        if isinstance(e, Attribute):
            return self.text_of(e)
        if isinstance(e, Intrinsic):
            return self.value(e).cast("string")
        return self.number(e).cast("string")

    def number(self, e, missing: Column | None = None) -> Column:
        """``missing``: what an attribute that is no number counts as, 0 by default."""
        if isinstance(e, Literal):
            if e.kind in ("int", "float", "duration"):
                return F.lit(e.value)
            raise QueryError("a number is expected")
        if isinstance(e, Intrinsic):
            return self.value(e) if self.numeric(e) else self.value(e).try_cast("double")
        if isinstance(e, Attribute):
            value = self.text_of(e).try_cast("double")
            return F.coalesce(value, F.lit(0.0) if missing is None else missing)
        if isinstance(e, Unary) and e.op == "-":
            return -self.number(e.value, missing)
        if isinstance(e, Binary) and e.op in _ARITHMETIC:
            a, b = self.number(e.left, missing), self.number(e.right, missing)
            if e.op in ("/", "%"):
                return F.try_divide(a.cast("double"), b.cast("double")) if e.op == "/" else F.try_mod(a, b)
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "^": lambda: F.pow(a, b)}[e.op]()
        raise QueryError("a number is expected")


def _is_bool(e) -> bool:
    return isinstance(e, Exists) or isinstance(e, Literal) and e.kind == "bool" or isinstance(e, Unary) and e.op == "!" or isinstance(e, Binary) and e.op not in _ARITHMETIC
