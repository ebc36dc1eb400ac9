"""Trace search: the matching traces with root, times, counts by service and their first spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.context import trace_facts
from spanloom.plans.engine import Engine
from spanloom.sources.spans import in_range

_LISTED = ("trace_id", "span_id", "name", "start_ns", "duration_ns")


def service_stats(spans: DataFrame) -> DataFrame:
    """trace_id, service, span_count, error_count."""
    return spans.groupBy("trace_id", "service").agg(F.count("*").alias("span_count"), F.count_if(F.col("status") == "STATUS_CODE_ERROR").alias("error_count"))


def _traces(spans: DataFrame, ids: DataFrame, views: dict[str, DataFrame] | None) -> DataFrame:
    """Facts of the traces in ``ids``, from the derived table ``trace_metadata`` if there is one."""
    if views is None:
        return trace_facts(spans.join(ids, "trace_id", "left_semi"))
    return views["trace_metadata"].join(ids, "trace_id", "left_semi").withColumn("trace_duration_ns", F.col("end_ns") - F.col("start_ns"))


def search(
    engine: Engine, text: str = "", start_ns: int | None = None, end_ns: int | None = None, limit: int | None = 20, spans_each: int = 3, min_ms: int | None = None, max_ms: int | None = None,
    views: dict[str, DataFrame] | None = None, matching_only: bool = False,
) -> DataFrame:
    """traceID, rootServiceName, rootTraceName, startTimeUnixNano, durationMs, serviceStats, spanSets; newest first.

    Durations are filtered before the limit. With a limit, the traces within it are fetched at once (no more rows than that), and their details are read only
    from the days on which they have spans. ``views``: the derived table ``trace_metadata`` gives roots, bounds and
    durations without a scan of the spans. ``matching_only``: span sets list and count the matching spans, not the trace's first ones.
    """
    spark, found = engine.spans.sparkSession, engine.evaluate(text, start_ns, end_ns)
    facts = _traces(engine.spans, found.traces(), views).withColumn("durationMs", F.expr("trace_duration_ns div 1000000"))
    if min_ms is not None:
        facts = facts.where(F.col("durationMs") >= min_ms)
    if max_ms is not None:
        facts = facts.where(F.col("durationMs") <= max_ms)
    facts = facts.select("trace_id", "root_service", "root_name", "start_ns", "end_ns", "span_count", "durationMs")
    spans = engine.spans
    if limit is not None:
        rows = facts.orderBy(F.desc("start_ns"), "trace_id").limit(limit).collect()
        facts = F.broadcast(spark.createDataFrame(rows, facts.schema))  # at most ``limit`` rows
        spans = in_range(spans, min((r.start_ns for r in rows), default=0), max((r.end_ns for r in rows), default=0))
        spans = spans.where(F.col("trace_id").isin([r.trace_id for r in rows]))
    else:
        spans = spans.join(facts.select("trace_id"), "trace_id", "left_semi")
    stats = service_stats(spans).groupBy("trace_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("service", F.struct(F.col("span_count").alias("spanCount"), F.col("error_count").alias("errorCount")))))).alias("serviceStats"))
    listed = found.spans.select(*_LISTED).join(facts.select("trace_id"), "trace_id", "left_semi") if matching_only else spans.select(*_LISTED)
    w = Window.partitionBy("trace_id")
    numbered = listed.withColumn("n", F.row_number().over(w.orderBy("start_ns", "span_id"))).withColumn("matched", F.count("*").over(w)).where(F.col("n") <= spans_each)
    each = F.array_sort(F.collect_list(F.struct("n", F.col("span_id").alias("spanID"), "name", F.col("start_ns").alias("startTimeUnixNano"), F.col("duration_ns").alias("durationNanos"))))
    sets = numbered.groupBy("trace_id").agg(F.transform(each, lambda s: s.dropFields("n")).alias("spans"), F.first("matched").cast("int").alias("matched"))
    out = stats.join(sets, "trace_id").join(facts, "trace_id")
    return out.select(F.col("trace_id").alias("traceID"), F.col("root_service").alias("rootServiceName"), F.col("root_name").alias("rootTraceName"), F.col("start_ns").alias("startTimeUnixNano"), F.col("durationMs").cast("int").alias("durationMs"), "serviceStats", F.array(F.struct("spans", "matched")).alias("spanSets")).orderBy(F.desc("startTimeUnixNano"), "traceID")


def inspected(engine: Engine, text: str = "", start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """inspectedTraces, inspectedSpans: how much a search looks at."""
    ids = engine.trace_ids(text, start_ns, end_ns)
    return in_range(engine.spans, start_ns, end_ns).join(ids, "trace_id", "left_semi").agg(F.countDistinct("trace_id").alias("inspectedTraces"), F.count("*").alias("inspectedSpans"))
