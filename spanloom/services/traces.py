"""A trace by id, as an OTLP tree: batches by service, scopes in them, spans in those."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.plans.engine import Engine
from spanloom.plans.syntax import KINDS
from spanloom.services.params import trace_id as checked

_KINDS = {name: i for i, name in enumerate(KINDS)}
_STATUS = {"unset": 0, "ok": 1, "error": 2}


def trace_spans(engine: Engine, trace_id: str) -> DataFrame:
    """The spans of a trace in order of time; the id is checked first."""
    return engine.spans.where(F.col("trace_id") == checked(trace_id)).orderBy("start_ns", "span_id")


def spans_of(engine: Engine, ids: DataFrame) -> DataFrame:
    """The spans of a set of traces (column trace_id), by trace and time."""
    return engine.spans.join(ids.select("trace_id").distinct(), "trace_id", "left_semi").orderBy("trace_id", "start_ns", "span_id")


def _number(c: Column, names: dict[str, int], prefix: str) -> Column:
    word = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"^{prefix}", "")
    out = F.lit(0)
    for name, n in names.items():
        out = F.when(word == name, n).otherwise(out)
    return out


def _attributes(m: Column) -> Column:
    """Key and value pairs by key."""
    return F.transform(F.array_sort(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>")))), lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))


def otlp_batches(spans: DataFrame) -> DataFrame:
    """trace_id, batches: an array by service of resource and scopeSpans. The earliest span's resource attributes stand for its service."""
    events = F.transform("events", lambda e: F.struct(e["time_ns"].cast("string").alias("timeUnixNano"), e["name"].alias("name"), _attributes(e["attributes"]).alias("attributes")))
    links = F.transform("links", lambda x: F.struct(x["trace_id"].alias("traceId"), x["span_id"].alias("spanId"), x["trace_state"].alias("traceState"), _attributes(x["attributes"]).alias("attributes")))
    span = F.struct(
        F.col("start_ns").alias("_at"),
        F.col("trace_id").alias("traceId"),
        F.col("span_id").alias("spanId"),
        F.col("parent_span_id").alias("parentSpanId"),
        "name",
        _number(F.col("kind"), _KINDS, "span_kind_").alias("kind"),
        F.col("start_ns").cast("string").alias("startTimeUnixNano"),
        (F.col("start_ns") + F.col("duration_ns")).cast("string").alias("endTimeUnixNano"),
        _attributes(F.col("span_attributes")).alias("attributes"),
        F.coalesce(events, F.array()).alias("events"),
        F.coalesce(links, F.array()).alias("links"),
        F.struct(_number(F.col("status"), _STATUS, "status_code_").alias("code"), F.col("status_message").alias("message")).alias("status"),
    )
    named = F.when(F.coalesce(F.map_contains_key("resource_attributes", "service.name"), F.lit(False)), F.col("resource_attributes")).otherwise(F.map_concat(F.create_map(F.lit("service.name"), F.col("service")), F.coalesce("resource_attributes", F.create_map().cast("map<string,string>"))))
    own = F.transform(F.map_entries(named), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    scopes = spans.groupBy("trace_id", "service", "scope_name", "scope_version").agg(F.array_sort(F.collect_list(span)).alias("s"), F.min_by(own, F.struct("start_ns", "span_id")).alias("r"), F.min(F.struct("start_ns", "span_id")).alias("at"))
    scope = F.struct(F.col("scope_name").alias("_n"), F.col("scope_version").alias("_v"), F.struct(F.col("scope_name").alias("name"), F.col("scope_version").alias("version")).alias("scope"), F.transform("s", lambda x: x.dropFields("_at")).alias("spans"))
    services = scopes.groupBy("trace_id", "service").agg(F.array_sort(F.collect_list(scope)).alias("c"), F.min_by("r", "at").alias("r"))
    resource = F.transform(F.array_sort("r"), lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))
    batch = F.struct(F.col("service").alias("_s"), F.struct(resource.alias("attributes")).alias("resource"), F.transform("c", lambda x: x.dropFields("_n", "_v")).alias("scopeSpans"))
    out = services.groupBy("trace_id").agg(F.array_sort(F.collect_list(batch)).alias("b"))
    return out.select("trace_id", F.transform("b", lambda x: x.dropFields("_s")).alias("batches"))


def trace_json(engine: Engine, trace_id: str, v2: bool = False) -> str | None:
    """The trace as JSON; None (v1) or a complete status without a trace (v2) if there is none."""
    row = otlp_batches(trace_spans(engine, trace_id)).select(F.to_json(F.struct("batches")).alias("j")).first()
    if not v2:
        return row.j if row else None
    return json.dumps({"status": "complete"} | ({"trace": json.loads(row.j)} if row else {}))


def trace_overview(engine: Engine, trace_id: str, first: int = 50) -> dict:
    """Totals, services, errors, root and the first spans of a trace, for clients that can't take it whole."""
    spans = engine.spans.where(F.col("trace_id") == checked(trace_id))
    order = F.struct((F.col("parent_span_id") != "").alias("not_root"), "start_ns", "span_id")
    facts = spans.agg(F.count("*").alias("spans"), F.count_if(F.col("status") == "STATUS_CODE_ERROR").alias("errors"), F.array_sort(F.collect_set("service")).alias("services"), F.min_by("name", order).alias("root"), F.expr("(max(start_ns + duration_ns) - min(start_ns)) div 1000000").alias("duration_ms")).first()
    listed = spans.orderBy("start_ns", "span_id").select("span_id", "parent_span_id", "service", "name", "duration_ns", "status").limit(first).collect()
    return facts.asDict() | {"truncated": facts.spans > first, "first": [r.asDict() for r in listed]}
