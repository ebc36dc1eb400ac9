"""Derived relations, kept as partial aggregates that are added up when read.

Each batch of spans gives partial rows; appending them is all an update takes, late spans are just further partials, and a
reader aggregates once more. The same functions serve batch and streaming.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_NS = 300_000_000_000


def bucket(ns: Column) -> Column:
    """The start of the five minutes that ``ns`` lies in."""
    return F.expr("0L") + ns - F.pmod(ns, F.lit(BUCKET_NS))


def snap(start_ns: int, end_ns: int) -> tuple[int, int]:
    """The range widened to whole buckets; the end is exclusive."""
    return start_ns // BUCKET_NS * BUCKET_NS, -(-end_ns // BUCKET_NS) * BUCKET_NS


def trace_partials(spans: DataFrame) -> DataFrame:
    """trace_id, root (order, service and name of the best root candidate), start_ns, end_ns, span_count, error_count."""
    best = F.min(F.struct((F.col("parent_span_id") != "").alias("not_root"), "start_ns", "span_id", "service", "name"))
    return spans.groupBy("trace_id").agg(best.alias("root"), F.min("start_ns").alias("start_ns"), F.max(F.col("start_ns") + F.col("duration_ns")).alias("end_ns"), F.count("*").alias("span_count"), F.count_if(F.col("status") == "STATUS_CODE_ERROR").alias("error_count"))


def merge_traces(partials: DataFrame) -> DataFrame:
    """A row for each trace: root_service, root_name, start_ns, end_ns, span_count, error_count."""
    out = partials.groupBy("trace_id").agg(F.min("root").alias("root"), F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.sum("span_count").alias("span_count"), F.sum("error_count").alias("error_count"))
    return out.select("trace_id", F.col("root.service").alias("root_service"), F.col("root.name").alias("root_name"), "start_ns", "end_ns", "span_count", "error_count")


def tag_partials(spans: DataFrame, attributes: str) -> DataFrame:
    """bucket_ns, tag, count for the keys of ``span_attributes`` or ``resource_attributes``."""
    keys = spans.select(bucket(F.col("start_ns")).alias("bucket_ns"), F.explode(F.map_keys(attributes)).alias("tag"))
    return keys.groupBy("bucket_ns", "tag").agg(F.count("*").alias("count"))


def service_partials(spans: DataFrame) -> DataFrame:
    """bucket_ns, service, span_count."""
    return spans.groupBy(bucket(F.col("start_ns")).alias("bucket_ns"), "service").agg(F.count("*").alias("span_count"))


def merge_buckets(partials: DataFrame) -> DataFrame:
    """Counts added up by bucket and name."""
    *keys, count = partials.columns
    return partials.groupBy(*keys).agg(F.sum(count).alias(count))


def names_between(partials: DataFrame, start_ns: int | None = None, end_ns: int | None = None, limit: int | None = 1000) -> DataFrame:
    """Distinct names in the buckets that the range touches, ascending; open ends are None."""
    name = partials.columns[1]
    if start_ns is not None:
        partials = partials.where(F.col("bucket_ns") >= snap(start_ns, start_ns)[0])
    if end_ns is not None:
        partials = partials.where(F.col("bucket_ns") < snap(end_ns, end_ns)[1])
    out = partials.select(name).distinct().orderBy(name)
    return out if limit is None else out.limit(limit)


#: View to (partials of a batch of spans, merge of stored partials).
VIEWS = {
    "trace_metadata": (trace_partials, merge_traces),
    "span_tag_names": (lambda s: tag_partials(s, "span_attributes"), merge_buckets),
    "resource_tag_names": (lambda s: tag_partials(s, "resource_attributes"), merge_buckets),
    "service_names": (service_partials, merge_buckets),
}
