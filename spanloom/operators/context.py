"""What a span's own row doesn't hold: its parent, its trace's root and duration, its number of children."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trace_facts(spans: DataFrame) -> DataFrame:
    """A row for each trace: root (the earliest span without a parent, else the earliest span), bounds and counts.

    One aggregation with partial sums on each task; a trace is never gathered in one place.
    """
    first = F.struct((F.col("parent_span_id") != "").alias("not_root"), F.col("start_ns"), F.col("span_id"))
    facts = spans.groupBy("trace_id").agg(
        F.min_by(F.struct("service", "name"), first).alias("root"),
        F.min("start_ns").alias("start_ns"),
        F.max(F.col("start_ns") + F.col("duration_ns")).alias("end_ns"),
        F.count("*").alias("span_count"),
        F.count_if(F.col("status") == "STATUS_CODE_ERROR").alias("error_count"),
    )
    return facts.select("trace_id", F.col("root.service").alias("root_service"), F.col("root.name").alias("root_name"), "start_ns", "end_ns", (F.col("end_ns") - F.col("start_ns")).alias("trace_duration_ns"), "span_count", "error_count")


def enrich(spans: DataFrame, all_spans: DataFrame, needs: set[str]) -> DataFrame:
    """``spans`` with ``_parent_*``, trace facts or ``child_count`` as far as needed, computed over ``all_spans``."""
    if "parent" in needs:
        # A column for each of the parent's: those that nobody refers to are neither read nor aggregated.
        kept = ["name", "kind", "service", "resource_attributes", "span_attributes", "start_ns", "duration_ns", "status", "status_message", "scope_name", "scope_version", "parent_span_id"]
        parents = all_spans.groupBy(F.col("trace_id").alias("_trace"), F.col("span_id").alias("_span")).agg(*[F.first(c).alias(f"_parent_{c}") for c in kept])
        parents = parents.withColumns({"_parent_trace_id": F.col("_trace"), "_parent_span_id": F.col("_span")})
        spans = spans.join(parents, (spans.trace_id == parents._trace) & (spans.parent_span_id == parents._span), "left").drop("_trace", "_span")
    if "trace" in needs:
        spans = spans.join(trace_facts(all_spans).select("trace_id", "root_service", "root_name", "trace_duration_ns"), "trace_id")
    if "children" in needs:
        counts = all_spans.where("parent_span_id <> ''").groupBy("trace_id", F.col("parent_span_id").alias("span_id")).agg(F.count("*").alias("child_count"))
        spans = spans.join(counts, ["trace_id", "span_id"], "left").withColumn("child_count", F.coalesce("child_count", F.lit(0)))
    return spans
