"""The engine: a span relation and the questions that can be asked of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.predicates import Fields
from spanloom.operators import metrics
from spanloom.operators.context import trace_facts
from spanloom.operators.spansets import Evaluator, Spanset
from spanloom.operators.structural import WALK_LIMIT
from spanloom.plans.syntax import Query, parse
from spanloom.sources.spans import in_range


@dataclass(frozen=True)
class Engine:
    """``spans``: the relation, usually from ``read_spans``. Answers are lazy DataFrames."""

    spans: DataFrame
    fields: Fields = Fields()
    walk_limit: int = WALK_LIMIT

    def evaluate(self, text: str | Query, start_ns: int | None = None, end_ns: int | None = None) -> Spanset:
        query = parse(text) if isinstance(text, str) else text
        return Evaluator(self.spans, query, self.fields, self.walk_limit, start_ns, end_ns).run(query.pipeline)

    def trace_ids(self, text: str | Query, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
        """trace_id of every trace that the query matches."""
        return self.evaluate(text, start_ns, end_ns).traces()

    def matching_spans(self, text: str | Query, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
        """The matching spans; after ``select`` only their ids and the selected attributes."""
        out = self.evaluate(text, start_ns, end_ns)
        if not out.columns:
            return out.spans
        return out.spans.select("trace_id", "span_id", *[self.fields.text(x).alias(metrics.label_name(x).replace(".", "_")) for x in out.columns])

    def aggregates(self, text: str | Query, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
        """trace_id, grouping columns, agg_value of a query that ends in an aggregate."""
        out = self.evaluate(text, start_ns, end_ns)
        if out.scalars is None:
            raise ValueError("the query does not end in an aggregate")
        return out.scalars

    def newest(self, text: str | Query, start_ns: int | None = None, end_ns: int | None = None, limit: int = 20) -> DataFrame:
        """trace_id, start_ns of the matching traces that started last; ties by id."""
        ids = self.trace_ids(text, start_ns, end_ns)
        starts = in_range(self.spans, start_ns, end_ns).groupBy("trace_id").agg(F.min("start_ns").alias("start_ns"))
        return starts.join(ids, "trace_id", "left_semi").orderBy(F.desc("start_ns"), "trace_id").limit(limit)

    def range(self, text: str, start_ns: int | None, end_ns: int | None, step_ns: int, approximate: bool = False) -> DataFrame:
        return metrics.range_metric(self.spans, parse(text), start_ns, end_ns, step_ns, self.fields, approximate)

    def instant(self, text: str, start_ns: int | None = None, end_ns: int | None = None, per_second: bool = False, approximate: bool = False) -> DataFrame:
        return metrics.instant_metric(self.spans, parse(text), start_ns, end_ns, self.fields, per_second, approximate)

    def summary(self, text: str = "", by: tuple[str, ...] = (), start_ns: int | None = None, end_ns: int | None = None, limit: int | None = 10, approximate: bool = False) -> DataFrame:
        keys = [x for x in (parse_reference(b) for b in by if b.strip())]
        return metrics.summary(self.spans, parse(text) if text.strip() else None, keys, start_ns, end_ns, limit, self.fields, approximate)

    def facts(self) -> DataFrame:
        return trace_facts(self.spans)


def parse_reference(text: str):
    """An attribute's name as it is written in a query; a bare name with dots is an attribute without a scope."""
    query = parse(f"{{ }} | select({text.strip()})")
    return query.pipeline.stages[1].columns[0]
