"""Pipelines of spanset stages over the span relation.

A ``Spanset`` is what a stage hands on: the matching spans, lazily. Filters stay one scan with one condition; a set
operation or a structural operator between two plain filters reads the spans once, marked by both conditions. Only the
trace ids are shuffled where only they are asked for. Limits are applied once, at the end, by the callers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.predicates import Fields, needs
from spanloom.operators import structural
from spanloom.operators.context import enrich
from spanloom.plans.syntax import Aggregate, Coalesce, Filter, GroupBy, Literal, Metric, Pipeline, Query, QueryError, ScalarFilter, ScalarMath, Select, SpansetOp, TopK
from spanloom.sources.scratch import kept
from spanloom.sources.spans import in_range

_KEYS = ["trace_id", "span_id", "parent_span_id"]
_COMPARE = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


@dataclass(frozen=True)
class Spanset:
    """``found``: matching spans, or how to get them, where ids may do. ``condition``: set if they are those of the base that meet it. ``groups``: names of
    grouping columns. ``scalars``: an aggregate stands for the spans, with these columns per trace (and group). ``ids``: the
    traces, where they can be had for less than by way of the spans."""

    found: DataFrame | Callable[[], DataFrame]
    condition: Column | None = None
    groups: tuple[str, ...] = ()
    scalars: DataFrame | None = None
    columns: tuple = ()
    ids: DataFrame | None = None

    @property
    def spans(self) -> DataFrame:
        if not isinstance(self.found, DataFrame):
            object.__setattr__(self, "found", self.found())
        return self.found

    def traces(self) -> DataFrame:
        """trace_id, each once."""
        source = self.scalars if self.scalars is not None else self.ids if self.ids is not None else self.spans
        return source.select("trace_id").distinct()


class Evaluator:
    """Evaluates pipelines over ``spans``; the time range (inclusive, ns) holds for what is matched, not for what is walked."""

    def __init__(self, spans: DataFrame, query: Query, fields: Fields | None = None, walk_limit: int = structural.WALK_LIMIT, start_ns: int | None = None, end_ns: int | None = None, also: tuple = ()):
        """``also``: expressions that will be asked of the matching spans."""
        self.fields = fields or Fields()
        wanted = needs(query, *also)
        if not self.fields.trace_level:
            wanted -= {"trace"}
        self.all = spans
        self.base = enrich(in_range(_sampled(spans, query), start_ns, end_ns), spans, wanted)
        self.walk_limit = walk_limit

    def run(self, pipeline: Pipeline) -> Spanset:
        return self._pipeline(pipeline, None)

    def _pipeline(self, pipeline: Pipeline, before: Spanset | None) -> Spanset:
        for stage in pipeline.stages:
            before = self._stage(stage, before)
        return before

    def _stage(self, stage, before: Spanset | None) -> Spanset:
        if isinstance(stage, Pipeline):
            return self._pipeline(stage, before)
        if isinstance(stage, Filter):
            own = self._filter(stage)
            return own if before is None else Spanset(own.spans.join(before.traces(), "trace_id", "left_semi"))
        if isinstance(stage, SpansetOp):
            out = self._operation(stage)
            return out if before is None else Spanset(out.spans.join(before.traces(), "trace_id", "left_semi"))
        if isinstance(stage, Coalesce):
            return self._needed(before)
        if isinstance(stage, GroupBy):
            before = self._needed(before)
            name = f"by_{len(before.groups)}"
            return Spanset(before.spans.withColumn(name, self.fields.text(stage.expression)), groups=(*before.groups, name))
        if isinstance(stage, Select):
            return replace(self._needed(before), columns=stage.columns)
        if isinstance(stage, Aggregate | ScalarMath):
            before = self._needed(before)
            return replace(before, condition=None, scalars=self._aggregated(before, stage, "agg_value"))
        if isinstance(stage, ScalarFilter):
            return self._scalar_filter(stage, self._needed(before))
        if isinstance(stage, Metric | TopK):
            raise QueryError("metrics are asked for by range or instant queries")
        raise QueryError(f"no such stage: {type(stage).__name__}")

    def _needed(self, before: Spanset | None) -> Spanset:
        return before or Spanset(self.base, F.lit(True))

    def _filter(self, f: Filter) -> Spanset:
        if f.expression is None:
            return Spanset(self.base, F.lit(True))
        condition = self.fields.predicate(f.expression)
        return Spanset(self.base.where(condition), condition)

    # -- set and structural operators

    def _operand(self, e) -> Spanset:
        return self._stage(e, None)

    def _operation(self, e: SpansetOp) -> Spanset:
        a, b = self._operand(e.left), self._operand(e.right)
        if e.op == "||":
            return self._either(a, b)
        if e.op == "&&":
            marks = self._marks(a, b)
            both = marks.groupBy("trace_id").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b")).where("a and b").select("trace_id")
            return Spanset(self._either(a, b).spans.join(both, "trace_id", "left_semi"), ids=both)
        plain, negated, united = e.op.lstrip("!&"), e.op[0] == "!", e.op[0] == "&"
        if united:  # the traces of a and those of a that also match: the traces of a
            return Spanset(lambda: a.spans.unionByName(self._whole(self._found(plain, a, b)), allowMissingColumns=True).dropDuplicates(["trace_id", "span_id"]), ids=a.traces())
        walked = plain in (">>", "<<")
        found = self._found(plain, a, b) if walked else None
        ids = found.select("trace_id") if walked else structural.traces(plain, self._marks(a, b))
        if negated:
            return Spanset(a.spans.join(ids.distinct(), "trace_id", "left_anti"), ids=a.traces().join(ids.distinct(), "trace_id", "left_anti"))
        return Spanset(lambda: self._whole(found if walked else self._found(plain, a, b)), ids=ids)

    def _found(self, op: str, a: Spanset, b: Spanset) -> DataFrame:
        """The keys of the b spans that stand in the relation to an a."""
        marks = self._marks(a, b)
        if op not in (">>", "<<"):
            return structural.RELATIONS[op](marks)
        # Walking needs all spans of the traces that have both sides, in the time range or not. Which traces these are is
        # written down at once: it decides how they are walked, and is read again for the walk.
        if a.condition is not None and b.condition is not None and self.base is self.all:
            yes = lambda c: F.coalesce(c, F.lit(False))
            everything = self.base.select(*_KEYS, yes(a.condition).alias("a"), yes(b.condition).alias("b"))
            sizes = kept(structural.candidates(everything), "candidates")
        else:
            both = kept(structural.candidates(marks).select("trace_id"), "candidates")
            everything = self.all.select(*_KEYS).distinct().join(marks, _KEYS, "left").na.fill(False, ["a", "b"])
            sizes = kept(self.all.join(both, "trace_id", "left_semi").groupBy("trace_id").agg(F.count("*").alias("n")), "sizes")
        return structural.RELATIONS[op](everything, sizes, self.walk_limit)

    def _either(self, a: Spanset, b: Spanset) -> Spanset:
        if a.condition is not None and b.condition is not None:
            both = a.condition | b.condition
            return Spanset(self.base.where(both), both)
        return Spanset(a.spans.unionByName(b.spans, allowMissingColumns=True).dropDuplicates(["trace_id", "span_id"]))

    def _marks(self, a: Spanset, b: Spanset) -> DataFrame:
        """Keys of the spans in either set, with the marks a and b."""
        if a.condition is not None and b.condition is not None:
            yes = lambda c: F.coalesce(c, F.lit(False))
            return self.base.select(*_KEYS, yes(a.condition).alias("a"), yes(b.condition).alias("b")).where("a or b")
        left = a.spans.select(*_KEYS, F.lit(True).alias("a"), F.lit(False).alias("b"))
        return left.union(b.spans.select(*_KEYS, F.lit(False), F.lit(True))).groupBy(*_KEYS).agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))

    def _whole(self, keys: DataFrame) -> DataFrame:
        return self.base.join(keys.select("trace_id", "span_id").distinct(), ["trace_id", "span_id"], "left_semi")

    # -- aggregates per trace

    def _aggregated(self, before: Spanset, e, name: str) -> DataFrame:
        parts: list[Column] = []

        def scalar(x) -> Column:
            if isinstance(x, Literal):
                return self.fields.number(x)
            if isinstance(x, ScalarMath):
                a, b = scalar(x.left), scalar(x.right)
                return F.try_divide(a, b) if x.op == "/" else {"+": a + b, "-": a - b, "*": a * b}[x.op]
            parts.append(self.aggregate(x).alias(f"_agg{len(parts)}"))
            return F.col(f"_agg{len(parts) - 1}")

        value = scalar(e)
        keys = ["trace_id", *before.groups]
        return before.spans.groupBy(*keys).agg(*parts).select(*keys, value.alias(name))

    def aggregate(self, x: Aggregate) -> Column:
        if x.fn == "count":
            return F.count("*")
        value = F.col("duration_ns") if x.argument is None else self.fields.number(x.argument, F.lit(None).cast("double"))
        return {"min": F.min, "max": F.max, "sum": F.sum, "avg": F.avg}[x.fn](value)

    def _scalar_filter(self, e: ScalarFilter, before: Spanset) -> Spanset:
        if e.left is None:
            raise QueryError("an aggregate is expected")
        passed = self._aggregated(before, e.left, "_value").where(getattr(F.col("_value"), _COMPARE[e.op])(self.fields.number(e.right))).drop("_value")
        return Spanset(before.spans.join(passed, ["trace_id", *before.groups], "left_semi"), groups=before.groups)


def _sampled(spans: DataFrame, query: Query) -> DataFrame:
    """The hint ``sample``: a share (or a whole number of per cent) of traces, whole, chosen by a hash of their id."""
    hint = query.hints.get("sample")
    if not isinstance(hint, Literal) or hint.kind not in ("int", "float"):
        return spans
    rate = hint.value / 100 if hint.kind == "int" else hint.value
    share = F.conv(F.substring(F.md5(F.col("trace_id").cast("binary")), 1, 8), 16, 10).cast("long")  # of 2**32
    return spans.where(share < int(rate * (1 << 32))) if 0 < rate < 1 else spans


def matching(spans: DataFrame, pipeline: Pipeline | None, fields: Fields, start_ns: int | None = None, end_ns: int | None = None, also: tuple = (), walk_limit: int = structural.WALK_LIMIT) -> DataFrame:
    """The spans that a pipeline hands on, with what the expressions ``also`` refer to; of a single filter, one scan."""
    query = Query(pipeline or Pipeline(()))
    e = Evaluator(spans, query, fields, walk_limit, start_ns, end_ns, also)
    return e.run(query.pipeline).spans if query.pipeline.stages else e.base
