"""The registered queries over spans derived from the order tables, and the DuckDB SQL that each is held against.

An entry is (callable of session and folder, SQL or None). Only what SQL can't state the same way has none: adaptive histograms.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import metrics as m
from spanloom.operators import views
from spanloom.plans.engine import Engine
from spanloom.plans.syntax import QueryError
from spanloom.services import params, respond, search, tags, traces, wire
from spanloom.sources.scratch import new_path
from spanloom.sources.spans import ORDER_SPANS_SQL, SPAN_SCHEMA, order_spans, read_spans, write_spans
from spanloom.streaming import views as live

Query = Callable[[SparkSession, str], DataFrame]
_held: dict[tuple[str, str], DataFrame] = {}
_views: dict[tuple[str, str], str] = {}
#: 1995-01-01 to 1996-12-31, in ns, and a step of thirty days.
START, END, STEP = 788_918_400_000_000_000, 852_076_799_999_999_999, 30 * 86_400_000_000_000


def span_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived spans, written once for the session as a deployment would ingest them: queries read them from Parquet."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _held:
        path = new_path(spark, "spans")
        write_spans(order_spans(spark, sf_dir), path)
        _held[key] = read_spans(spark, path)
    return _held[key]


def view_store(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The derived tables of these spans, written once for the session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _views:
        path = new_path(spark, "views")
        live.backfill(span_store(spark, sf_dir), path)
        _views[key] = path
    return {name: live.read_view(spark, _views[key], name) for name in views.VIEWS}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(span_store(spark, sf_dir))


WITH = f"WITH RECURSIVE {ORDER_SPANS_SQL}"
_OUT: dict[str, tuple[Query, str | None]] = {}


def _int(c: str) -> str:
    return f"coalesce(TRY_CAST({c} AS BIGINT), 0)"


def _num(c: str) -> str:
    return f"coalesce(TRY_CAST({c} AS DOUBLE), 0.0)"


def _text(c: str) -> str:
    return f"coalesce({c}, '')"


# ---------------------------------------------------------------- filters

R, S = "STATUS_CODE_ERROR", "SPAN_KIND_SERVER"
#: name: (query, condition in SQL)
FILTERS = {
    "filter_status": ("{ status = error }", f"status = '{R}'"),
    "filter_duration": ("{ duration > 500ms }", "duration_ns > 500000000"),
    "filter_status_and_duration": ("{ status = error && duration > 100ms }", f"status = '{R}' AND duration_ns > 100000000"),
    "filter_string": ('{ span.http.method = "GET" }', f"{_text('http_method')} = 'GET'"),
    "filter_not_equal_counts_missing": ('{ span.http.method != "GET" }', f"{_text('http_method')} <> 'GET'"),
    "filter_int": ("{ span.quantity > 48 }", f"{_int('quantity')} > 48"),
    "filter_int_counts_missing": ("{ span.quantity < 3 }", f"{_int('quantity')} < 3"),
    "filter_float": ("{ span.discount >= 0.08 }", f"{_num('discount')} >= 0.08"),
    "filter_duration_literal_on_attribute": ("{ span.quantity = 30ns }", f"{_int('quantity')} = 30"),
    "filter_kind": ("{ kind = client }", "kind = 'SPAN_KIND_CLIENT'"),
    "filter_regex": ('{ name =~ "^GET" }', "regexp_matches(name, '^GET')"),
    "filter_not_regex": ('{ resource.service.name !~ "svc-[0-5]|gateway" }', "NOT regexp_matches(service, 'svc-[0-5]|gateway')"),
    "filter_unscoped": ('{ .returnflag = "R" }', f"{_text('returnflag')} = 'R' OR '' = 'R'"),
    "filter_unscoped_service": ('{ .service.name = "svc-3" }', "service = 'svc-3'"),
    "filter_unscoped_not_regex": ('{ .priority !~ "URGENT|HIGH" && nestedSetParent < 0 }', f"NOT regexp_matches({_text('priority')}, 'URGENT|HIGH') AND parent_span_id = ''"),
    "filter_resource": ('{ resource.deployment.environment = "staging" && status = error }', f"env = 'staging' AND status = '{R}'"),
    "filter_exists": ("{ span.discount != nil }", "discount IS NOT NULL"),
    "filter_missing": ("{ span.discount = nil && kind = client }", "discount IS NULL AND kind = 'SPAN_KIND_CLIENT'"),
    "filter_reversed": ("{ 48 < span.quantity }", f"{_int('quantity')} > 48"),
    "filter_or": ("{ status = unset || span.quantity = 1 }", f"status = 'STATUS_CODE_UNSET' OR {_int('quantity')} = 1"),
    "filter_not": ("{ !(status = ok || status = unset) }", "NOT (status IN ('STATUS_CODE_OK', 'STATUS_CODE_UNSET'))"),
    "filter_arithmetic": ("{ span.quantity * 2 + 1 > 99 }", f"{_num('quantity')} * 2 + 1 > 99"),
    "filter_power": ("{ span.quantity ^ 2 >= 2401 }", f"pow({_num('quantity')}, 2) >= 2401"),
    "filter_modulo": ("{ duration % 1000 = 0 && duration / 2 > 400ms }", "duration_ns % 1000 = 0 AND duration_ns / 2 > 400000000"),
    "filter_two_attributes": ("{ span.linenumber = span.quantity }", f"{_text('linenumber')} = {_text('quantity')}"),
    "filter_negative": ("{ -span.quantity < -49 }", f"-{_num('quantity')} < -49"),
    "filter_true": ("{ true }", "true"),
    "filter_false": ("{ false }", "false"),
    "filter_empty": ("{ }", "true"),
    "filter_leading_and": ("{ && status = error }", f"status = '{R}'"),
    "filter_root": ("{ nestedSetParent < 0 && status = error }", f"parent_span_id = '' AND status = '{R}'"),
    "filter_not_root": ("{ nestedSetParent >= 0 && duration > 1s }", "parent_span_id <> '' AND duration_ns > 1000000000"),
    "filter_status_message": ('{ statusMessage = "order failed" }', "status_message = 'order failed'"),
    "filter_ids": (f'{{ trace:id = "{7:032x}" && span:id != "" && span:parentID = "" }}', f"trace_id = '{7:032x}' AND parent_span_id = ''"),
    "filter_scope": ('{ instrumentation:name = "db" && instrumentation:version = "2.0" }', "scope_name = 'db' AND scope_version = '2.0'"),
    "filter_event_name": ('{ event:name = "exception" }', "event_ns IS NOT NULL"),
    "filter_event_time": ("{ event:timeSinceStart > 5us }", "event_ns - start_ns > 5000"),
    "filter_event_attribute": ('{ event.exception.type = "Returned" }', "event_ns IS NOT NULL"),
    "filter_link": ("{ link:traceID != nil }", "link_trace_id IS NOT NULL"),
    "filter_link_attribute": ('{ link.link.reason = "previous" }', "link_trace_id IS NOT NULL"),
    "filter_name_exists": ("{ statusMessage != nil }", "status_message <> ''"),
}

# ---------------------------------------------------------------- structure

_A, _B = "{ resource.service.name = \"svc-1\" }", "{ status = error }"
_SQL_A, _SQL_B = "service = 'svc-1'", f"status = '{R}'"
#: Operator to the SQL of traces in which some b stands in the relation to some a.
RELATIONS = {
    ">": "SELECT DISTINCT b.trace_id FROM a JOIN b ON a.trace_id = b.trace_id AND b.parent_span_id = a.span_id",
    "<": "SELECT DISTINCT b.trace_id FROM a JOIN b ON a.trace_id = b.trace_id AND a.parent_span_id = b.span_id",
    "~": "SELECT DISTINCT b.trace_id FROM a JOIN b ON a.trace_id = b.trace_id AND a.parent_span_id = b.parent_span_id AND a.span_id <> b.span_id AND a.parent_span_id <> ''",
    ">>": "SELECT DISTINCT d.trace_id FROM d JOIN b ON d.trace_id = b.trace_id AND d.span_id = b.span_id",
    "<<": "SELECT DISTINCT u.trace_id FROM u JOIN b ON u.trace_id = b.trace_id AND u.span_id = b.span_id",
}
_NAMES = {">": "child", "<": "parent", "~": "sibling", ">>": "descendant", "<<": "ancestor"}


def _structure_sql(op: str, a: str = _SQL_A, b: str = _SQL_B) -> str:
    walk = ""
    if op == ">>":
        walk = ", d AS (SELECT s.trace_id, s.span_id FROM spans s JOIN a ON s.trace_id = a.trace_id AND s.parent_span_id = a.span_id UNION SELECT s.trace_id, s.span_id FROM spans s JOIN d ON s.trace_id = d.trace_id AND s.parent_span_id = d.span_id)"
    if op == "<<":
        walk = ", u AS (SELECT trace_id, parent_span_id AS span_id FROM a WHERE parent_span_id <> '' UNION SELECT s.trace_id, s.parent_span_id FROM spans s JOIN u ON s.trace_id = u.trace_id AND s.span_id = u.span_id WHERE s.parent_span_id <> '')"
    return f"{WITH}, a AS (SELECT * FROM spans WHERE {a}), b AS (SELECT * FROM spans WHERE {b}){walk}, found AS ({RELATIONS[op]}) "


def _ids(text: str, **times) -> Query:
    return lambda spark, d: engine(spark, d).trace_ids(text, **times)


for _name, (_q, _c) in FILTERS.items():
    _OUT[_name] = (_ids(_q), f"{WITH} SELECT DISTINCT trace_id FROM spans WHERE {_c}")
_OUT["filter_time_range"] = (_ids(_B, start_ns=START, end_ns=END), f"{WITH} SELECT DISTINCT trace_id FROM spans WHERE {_SQL_B} AND start_ns BETWEEN {START} AND {END}")
for _op, _name in _NAMES.items():
    _OUT[f"struct_{_name}"] = (_ids(f"{_A} {_op} {_B}"), _structure_sql(_op) + "SELECT trace_id FROM found")
    _OUT[f"struct_not_{_name}"] = (_ids(f"{_A} !{_op} {_B}"), _structure_sql(_op) + "SELECT DISTINCT trace_id FROM a WHERE trace_id NOT IN (SELECT trace_id FROM found)")
    _OUT[f"struct_union_{_name}"] = (_ids(f"{_A} &{_op} {_B}"), _structure_sql(_op) + "SELECT trace_id FROM a UNION SELECT trace_id FROM found")

_FACTS = f"facts AS (SELECT trace_id, arg_min(struct_pack(service := service, name := name), (CASE WHEN parent_span_id = '' THEN 0 ELSE 1 END, start_ns, span_id)) AS root, min(start_ns) AS start_ns, max(start_ns + duration_ns) AS end_ns, count(*) AS span_count, count(*) FILTER (WHERE status = '{R}') AS error_count FROM spans GROUP BY trace_id)"
_IN = "SELECT DISTINCT trace_id FROM spans WHERE"
_OUT |= {
    "filter_root_name": (_ids('{ rootName = "PUT /orders" && kind = client }'), f"{WITH}, {_FACTS} SELECT DISTINCT s.trace_id FROM spans s JOIN facts f ON s.trace_id = f.trace_id WHERE f.root.name = 'PUT /orders' AND kind = 'SPAN_KIND_CLIENT'"),
    "filter_root_service": (_ids('{ rootServiceName = "gateway" && status = error }'), f"{WITH} {_IN} {_SQL_B}"),
    "filter_trace_duration": (_ids("{ traceDuration > 4s && kind = client }"), f"{WITH}, {_FACTS} SELECT DISTINCT s.trace_id FROM spans s JOIN facts f ON s.trace_id = f.trace_id WHERE f.end_ns - f.start_ns > 4000000000 AND kind = 'SPAN_KIND_CLIENT'"),
    "filter_child_count": (_ids("{ childCount > 1 && status = error }"), f"{WITH} SELECT DISTINCT s.trace_id FROM spans s JOIN (SELECT trace_id, parent_span_id, count(*) AS n FROM spans WHERE parent_span_id <> '' GROUP BY ALL) c ON s.trace_id = c.trace_id AND s.span_id = c.parent_span_id WHERE n > 1 AND {_SQL_B}"),
    "filter_parent": (_ids('{ parent.span.http.method = "GET" && parent.status = error && status = ok }'), f"{WITH} SELECT DISTINCT s.trace_id FROM spans s JOIN spans p ON s.trace_id = p.trace_id AND s.parent_span_id = p.span_id WHERE p.http_method = 'GET' AND p.status = '{R}' AND s.status = 'STATUS_CODE_OK'"),
    "spanset_and": (_ids(f"{_A} && {_B}"), f"{WITH} {_IN} {_SQL_A} INTERSECT {_IN} {_SQL_B}"),
    "spanset_or": (_ids(f"{_A} || {_B}"), f"{WITH} {_IN} {_SQL_A} UNION {_IN} {_SQL_B}"),
    "spanset_chain": (_ids(f"({_A} || {_B}) && {{ kind = client }}"), f"{WITH} ({_IN} {_SQL_A} UNION {_IN} {_SQL_B}) INTERSECT {_IN} kind = 'SPAN_KIND_CLIENT'"),
    "struct_chain": (_ids("{ kind = server } > { kind = client } > { status = error }"), f"{WITH} SELECT DISTINCT c.trace_id FROM spans a JOIN spans b ON a.trace_id = b.trace_id AND b.parent_span_id = a.span_id JOIN spans c ON b.trace_id = c.trace_id AND c.parent_span_id = b.span_id WHERE a.kind = '{S}' AND b.kind = 'SPAN_KIND_CLIENT' AND c.{_SQL_B}"),
    "struct_of_pipeline": (_ids(f"({{ kind = client }} | count() > 2) >> {_B}"), f"{WITH}, a AS (SELECT * FROM spans WHERE kind = 'SPAN_KIND_CLIENT' AND trace_id IN (SELECT trace_id FROM spans WHERE kind = 'SPAN_KIND_CLIENT' GROUP BY 1 HAVING count(*) > 2)), b AS (SELECT * FROM spans WHERE {_SQL_B}), d AS (SELECT s.trace_id, s.span_id FROM spans s JOIN a ON s.trace_id = a.trace_id AND s.parent_span_id = a.span_id UNION SELECT s.trace_id, s.span_id FROM spans s JOIN d ON s.trace_id = d.trace_id AND s.parent_span_id = d.span_id) {RELATIONS['>>']}"),
    "struct_time_range": (_ids(f"{_A} >> {_B}", start_ns=START, end_ns=END), _structure_sql(">>", f"{_SQL_A} AND start_ns BETWEEN {START} AND {END}", f"{_SQL_B} AND start_ns BETWEEN {START} AND {END}") + "SELECT trace_id FROM found"),
}

# ---------------------------------------------------------------- pipelines and aggregates

for _name, _call, _sql in (
    ("count", "count() > 4", "count(*) > 4"),
    ("min", "min(duration) > 200ms", "min(duration_ns) > 200000000"),
    ("max", "max(span.quantity) >= 50", "max(TRY_CAST(quantity AS DOUBLE)) >= 50"),
    ("sum", "sum(.quantity) > 150", "sum(TRY_CAST(quantity AS DOUBLE)) > 150"),
    ("avg", "avg(duration) < 200ms", "avg(duration_ns) < 200000000"),
    ("arithmetic", "sum(duration) / count() > 700ms", "sum(duration_ns) / count(*) > 700000000"),
):
    _OUT[f"agg_{_name}_filter"] = (_ids(f"{{ }} | {_call}"), f"{WITH} SELECT trace_id FROM spans GROUP BY trace_id HAVING {_sql}")


def _aggregates(text: str) -> Query:
    return lambda spark, d: engine(spark, d).aggregates(text).withColumn("agg_value", F.round(F.col("agg_value").cast("double"), 4))


_OUT |= {
    "pipeline_filter": (_ids("{ status = error } | { status = ok }"), f"{WITH} {_IN} status = 'STATUS_CODE_OK' AND trace_id IN (SELECT trace_id FROM spans WHERE {_SQL_B})"),
    "pipeline_coalesce": (_ids("{ status = error } | coalesce()"), f"{WITH} {_IN} {_SQL_B}"),
    "agg_wrapped_filter": (_ids("({ kind = client } | count()) > 2"), f"{WITH} SELECT trace_id FROM spans WHERE kind = 'SPAN_KIND_CLIENT' GROUP BY 1 HAVING count(*) > 2"),
    "agg_by_filter": (_ids("{ } | by(resource.service.name) | count() > 2"), f"{WITH} SELECT DISTINCT trace_id FROM (SELECT trace_id, service FROM spans GROUP BY ALL HAVING count(*) > 2)"),
    "agg_count": (_aggregates("{ kind = client } | count()"), f"{WITH} SELECT trace_id, CAST(count(*) AS DOUBLE) AS agg_value FROM spans WHERE kind = 'SPAN_KIND_CLIENT' GROUP BY 1"),
    "agg_avg_attribute": (_aggregates("{ kind = client } | avg(span.quantity)"), f"{WITH} SELECT trace_id, round(avg(TRY_CAST(quantity AS DOUBLE)), 4) AS agg_value FROM spans WHERE kind = 'SPAN_KIND_CLIENT' GROUP BY 1"),
    "agg_by": (_aggregates("{ } | by(resource.service.name) | max(duration)"), f"{WITH} SELECT trace_id, service AS by_0, CAST(max(duration_ns) AS DOUBLE) AS agg_value FROM spans GROUP BY 1, 2"),
    "agg_after_spanset": (_aggregates(f"({_A} && {_B}) | count()"), f"{WITH} SELECT trace_id, CAST(count(*) AS DOUBLE) AS agg_value FROM spans WHERE ({_SQL_A} OR {_SQL_B}) AND trace_id IN ({_IN} {_SQL_A} INTERSECT {_IN} {_SQL_B}) GROUP BY 1"),
    "select_attributes": (lambda spark, d: engine(spark, d).matching_spans("{ nestedSetParent < 0 && status = error } | select(.priority, name, resource.host.name)"), f"{WITH} SELECT trace_id, span_id, priority, name, host AS resource_host_name FROM spans WHERE parent_span_id = '' AND {_SQL_B}"),
    "matching_spans": (lambda spark, d: engine(spark, d).matching_spans(_B).select("trace_id", "span_id", "service", "duration_ns"), f"{WITH} SELECT trace_id, span_id, service, duration_ns FROM spans WHERE {_SQL_B}"),
    "sampled_traces": (_ids("{ status = error } with(sample=0.5)"), f"{WITH} {_IN} {_SQL_B} AND CAST('0x' || substr(md5(trace_id), 1, 8) AS BIGINT) < {1 << 31}"),
    "newest_traces": (lambda spark, d: engine(spark, d).newest(_B, limit=20), f"{WITH} SELECT trace_id, min(start_ns) AS start_ns FROM spans WHERE trace_id IN (SELECT trace_id FROM spans WHERE {_SQL_B}) GROUP BY 1 ORDER BY start_ns DESC, trace_id LIMIT 20"),
}

# ---------------------------------------------------------------- metrics


def _range(text: str) -> Query:
    return lambda spark, d: engine(spark, d).range(text, START, END, STEP).withColumn("value", F.round("value", 6))


def _instant(text: str, **kw) -> Query:
    return lambda spark, d: engine(spark, d).instant(text, START, END, **kw).withColumn("value", F.round("value", 6))


_WHEN = f"start_ns BETWEEN {START} AND {END}"
_TS = f"(start_ns // {STEP}) * {STEP // 1_000_000} AS ts_ms"
_LE = "CASE " + " ".join(f"WHEN duration_ns <= {ms * 1_000_000} THEN '{m.bucket_label(ms)}'" for ms in m.BUCKETS_MS) + " ELSE '+Inf' END"
#: name: (call, range SQL, instant SQL)
METRICS = {
    "rate": ("rate()", f"count(*) / {STEP // 1_000_000_000}.0", "CAST(count(*) AS DOUBLE)"),
    "count": ("count_over_time()", "CAST(count(*) AS DOUBLE)", "CAST(count(*) AS DOUBLE)"),
    "min": ("min_over_time(duration)", "CAST(min(duration_ns) AS DOUBLE)", "CAST(min(duration_ns) AS DOUBLE)"),
    "max": ("max_over_time(span.quantity)", "max(TRY_CAST(quantity AS DOUBLE))", "max(TRY_CAST(quantity AS DOUBLE))"),
    "avg": ("avg_over_time(duration)", "avg(duration_ns)", "avg(duration_ns)"),
    "sum": ("sum_over_time(span.quantity)", "sum(TRY_CAST(quantity AS DOUBLE))", "sum(TRY_CAST(quantity AS DOUBLE))"),
    "quantile": ("quantile_over_time(duration, 0.9)", "quantile_cont(CAST(duration_ns AS DOUBLE), 0.9)", "quantile_cont(CAST(duration_ns AS DOUBLE), 0.9)"),
}
for _name, (_call, _r, _i) in METRICS.items():
    _by = f"{{ kind = client }} | {_call} by (resource.service.name)"
    _OUT[f"metrics_{_name}_range"] = (_range(_by), f"{WITH} SELECT {_TS}, service AS label_resource_service_name, round({_r}, 6) AS value FROM spans WHERE {_WHEN} AND kind = 'SPAN_KIND_CLIENT' GROUP BY 1, 2")
    _OUT[f"metrics_{_name}_instant"] = (_instant(_by), f"{WITH} SELECT service AS label_resource_service_name, round({_i}, 6) AS value FROM spans WHERE {_WHEN} AND kind = 'SPAN_KIND_CLIENT' GROUP BY 1")


def _topk(order: str, n: int) -> str:
    return f"{WITH}, v AS (SELECT {_TS}, service AS label_resource_service_name, CAST(count(*) AS DOUBLE) AS value FROM spans WHERE {_WHEN} GROUP BY 1, 2) SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY ts_ms ORDER BY value {order}, label_resource_service_name) <= {n}"


def _series(spark: SparkSession, d: str) -> DataFrame:
    rows = m.series(engine(spark, d).range("{ } | count_over_time() by (kind, status)", START, END, STEP))
    return rows.select("prom_labels", F.array_size("samples").alias("n_samples"), F.col("samples")[0]["timestampMs"].alias("first_ms"), F.aggregate("samples", F.lit(0.0), lambda a, x: a + x["value"]).alias("total"))


_SUMMARY = "CAST(count(*) AS BIGINT) AS span_count, CAST(count(*) FILTER (WHERE status = 'STATUS_CODE_ERROR') AS BIGINT) AS error_span_count, " + ", ".join(f"round(quantile_cont(CAST(duration_ns AS DOUBLE), {q}) / 1e6, 6) AS {p}" for p, q in (("p99", 0.99), ("p95", 0.95), ("p90", 0.9), ("p50", 0.5)))


def _summary(text: str, by: tuple[str, ...]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = engine(spark, d).summary(text, by, limit=None)
        return out.select(*[F.round(c, 6).alias(c) if c.startswith("p") and c[1:].isdigit() else F.col(c) for c in out.columns])

    return run


_OUT |= {
    "metrics_count_range_plain": (_range("{ } | count_over_time()"), f"{WITH} SELECT {_TS}, CAST(count(*) AS DOUBLE) AS value FROM spans WHERE {_WHEN} GROUP BY 1"),
    "metrics_two_labels_range": (_range("{ status = error } | rate() by (kind, .returnflag)"), f"{WITH} SELECT {_TS}, kind AS label_kind, {_text('returnflag')} AS label_returnflag, round(count(*) / {STEP // 1_000_000_000}.0, 6) AS value FROM spans WHERE {_WHEN} AND {_SQL_B} GROUP BY 1, 2, 3"),
    "metrics_histogram_range": (_range("{ } | histogram_over_time(duration)"), f"{WITH} SELECT {_TS}, {_LE} AS le, CAST(count(*) AS DOUBLE) AS value FROM spans WHERE {_WHEN} GROUP BY 1, 2"),
    "metrics_histogram_by": (_range("{ status = error } | histogram_over_time(duration) by (resource.service.name)"), f"{WITH} SELECT {_TS}, service AS label_resource_service_name, {_LE} AS le, CAST(count(*) AS DOUBLE) AS value FROM spans WHERE {_WHEN} AND {_SQL_B} GROUP BY 1, 2, 3"),
    "metrics_after_structure": (_range(f"{_A} > {_B} | count_over_time() by (kind)"), _structure_sql(">", f"{_SQL_A} AND {_WHEN}", f"{_SQL_B} AND {_WHEN}") + f"SELECT {_TS.replace('start_ns', 'b.start_ns')}, b.kind AS label_kind, CAST(count(DISTINCT b.span_id) AS DOUBLE) AS value FROM a JOIN b ON a.trace_id = b.trace_id AND b.parent_span_id = a.span_id GROUP BY 1, 2"),
    "metrics_after_descent": (_instant(f"{_A} >> {_B} | count_over_time()"), _structure_sql(">>", f"{_SQL_A} AND {_WHEN}", f"{_SQL_B} AND {_WHEN}") + "SELECT CAST(count(*) AS DOUBLE) AS value FROM b WHERE (trace_id, span_id) IN (SELECT trace_id, span_id FROM d)"),
    "metrics_after_spanset_and": (_range(f"({_A} && {_B}) | count_over_time()"), f"{WITH}, s AS (SELECT * FROM spans WHERE {_WHEN}) SELECT {_TS}, CAST(count(*) AS DOUBLE) AS value FROM s WHERE ({_SQL_A} OR {_SQL_B}) AND trace_id IN (SELECT trace_id FROM s WHERE {_SQL_A} INTERSECT SELECT trace_id FROM s WHERE {_SQL_B}) GROUP BY 1"),
    "metrics_after_aggregate": (_range(f"{_B} | count() > 3 | count_over_time() by (status)"), f"{WITH}, s AS (SELECT * FROM spans WHERE {_WHEN} AND {_SQL_B}) SELECT {_TS}, status AS label_status, CAST(count(*) AS DOUBLE) AS value FROM s WHERE trace_id IN (SELECT trace_id FROM s GROUP BY 1 HAVING count(*) > 3) GROUP BY 1, 2"),
    "metrics_after_two_filters": (_range(f"{_A} | {_B} | max_over_time(duration)"), f"{WITH}, s AS (SELECT * FROM spans WHERE {_WHEN}) SELECT {_TS}, CAST(max(duration_ns) AS DOUBLE) AS value FROM s WHERE {_SQL_B} AND trace_id IN (SELECT trace_id FROM s WHERE {_SQL_A}) GROUP BY 1"),
    "metrics_summary_after_structure": (_summary(f"{_A} > {_B}", ()), _structure_sql(">") + f"SELECT {_SUMMARY} FROM b WHERE (trace_id, parent_span_id) IN (SELECT trace_id, span_id FROM a)"),
    "metrics_histogram_instant": (lambda spark, d: engine(spark, d).instant("{ } | histogram_over_time(duration)", START, END), None),
    "metrics_rate_per_second_instant": (_instant("{ } | rate()", per_second=True), f"{WITH} SELECT round(count(*) / {(END - START) // 1_000_000_000}.0, 6) AS value FROM spans WHERE {_WHEN}"),
    "metrics_topk_range": (_range("{ } | count_over_time() by (resource.service.name) | topk(3)"), _topk("DESC", 3)),
    "metrics_bottomk_range": (_range("{ } | count_over_time() by (resource.service.name) | bottomk(2)"), _topk("ASC", 2)),
    "metrics_topk_instant": (_instant("{ } | count_over_time() by (resource.host.name) | topk(4)"), f"{WITH} SELECT host AS label_resource_host_name, CAST(count(*) AS DOUBLE) AS value FROM spans WHERE {_WHEN} GROUP BY 1 ORDER BY value DESC, 1 LIMIT 4"),
    "metrics_series": (_series, f"{WITH}, v AS (SELECT {_TS}, kind, status, count(*) AS value FROM spans WHERE {_WHEN} GROUP BY 1, 2, 3) SELECT '{{kind=\"' || kind || '\", status=\"' || status || '\"}}' AS prom_labels, CAST(count(*) AS INTEGER) AS n_samples, min(ts_ms) AS first_ms, CAST(sum(value) AS DOUBLE) AS total FROM v GROUP BY kind, status"),
    "metrics_summary": (_summary("", ()), f"{WITH} SELECT {_SUMMARY} FROM spans"),
    "metrics_summary_by": (_summary("{ kind = client }", ("resource.service.name",)), f"{WITH} SELECT {_SUMMARY}, service AS label_resource_service_name FROM spans WHERE kind = 'SPAN_KIND_CLIENT' GROUP BY service"),
}

# ---------------------------------------------------------------- discovery, search, traces, views


def _search(spark: SparkSession, d: str, held: dict[str, DataFrame] | None = None) -> DataFrame:
    found = search.search(engine(spark, d), "{ status = error }", limit=50, min_ms=100, max_ms=5000, views=held)
    return found.select("traceID", "rootServiceName", "rootTraceName", "startTimeUnixNano", "durationMs", F.map_keys("serviceStats")[0].alias("first_service"), F.map_values("serviceStats")[0]["spanCount"].alias("first_count"), F.col("spanSets")[0]["matched"].alias("matched"), F.col("spanSets")[0]["spans"][0]["spanID"].alias("first_span"))


_SEARCH = f"""{WITH}, {_FACTS}, hit AS (
  SELECT f.*, (end_ns - start_ns) // 1000000 AS ms FROM facts f
  WHERE trace_id IN (SELECT trace_id FROM spans WHERE {_SQL_B}) AND (end_ns - start_ns) // 1000000 BETWEEN 100 AND 5000 ORDER BY start_ns DESC, trace_id LIMIT 50),
stats AS (SELECT trace_id, service, count(*) AS n FROM spans GROUP BY 1, 2)
SELECT h.trace_id AS "traceID", h.root.service AS "rootServiceName", h.root.name AS "rootTraceName", h.start_ns AS "startTimeUnixNano", CAST(h.ms AS INTEGER) AS "durationMs",
  (SELECT min(service) FROM stats s WHERE s.trace_id = h.trace_id) AS first_service, (SELECT arg_min(n, service) FROM stats s WHERE s.trace_id = h.trace_id) AS first_count,
  CAST(h.span_count AS INTEGER) AS matched, (SELECT arg_min(span_id, (start_ns, span_id)) FROM spans s WHERE s.trace_id = h.trace_id) AS first_span
FROM hit h"""


def _search_matching(spark: SparkSession, d: str) -> DataFrame:
    found = search.search(engine(spark, d), _B, START, END, limit=30, matching_only=True).select("traceID", F.col("spanSets")[0].alias("s"))
    return found.select("traceID", F.col("s.matched").alias("matched"), F.array_size("s.spans").alias("listed"), F.col("s.spans")[0]["spanID"].alias("first_span"))


_SEARCH_MATCHING = f"""{WITH}, {_FACTS}, m AS (SELECT * FROM spans WHERE {_SQL_B} AND start_ns BETWEEN {START} AND {END}),
t AS (SELECT trace_id FROM facts WHERE trace_id IN (SELECT trace_id FROM m) ORDER BY start_ns DESC, trace_id LIMIT 30)
SELECT trace_id AS "traceID", CAST(count(*) AS INTEGER) AS matched, CAST(least(count(*), 3) AS INTEGER) AS listed, arg_min(span_id, (start_ns, span_id)) AS first_span
FROM m WHERE trace_id IN (SELECT trace_id FROM t) GROUP BY 1"""
#: The range in whole buckets of the derived tables.
_BUCKETS = f"start_ns >= {views.snap(START, END)[0]} AND start_ns < {views.snap(START, END)[1]}"


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """The OTLP tree of a trace, one row for each span in it."""
    rows = traces.otlp_batches(traces.trace_spans(engine(spark, d), f"{7:032x}")).select(F.explode("batches").alias("b")).select("b", F.explode("b.scopeSpans").alias("c")).select("b", "c", F.explode("c.spans").alias("s"))
    service = F.filter("b.resource.attributes", lambda a: a["key"] == "service.name")[0]["value"]["stringValue"]
    return rows.select(service.alias("service"), F.col("c.scope.name").alias("scope"), F.col("s.spanId").alias("span_id"), F.col("s.kind").alias("kind"), F.col("s.startTimeUnixNano").alias("start"), F.col("s.status.code").alias("code"), F.array_size("s.attributes").alias("n_attributes"))


def _view(name: str, *rename: str) -> Query:
    partials, merge = views.VIEWS[name]
    return lambda spark, d: merge(partials(span_store(spark, d)))


def _streamed(name: str) -> Query:
    """The view as a stream of files maintains it."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        base = new_path(spark, f"stream-{name}")  # of its own for each call: files, views and checkpoint belong together
        span_store(spark, d).select([F.col(f.name).cast(f.dataType).alias(f.name) for f in SPAN_SCHEMA]).repartition(4).write.parquet(f"{base}/spans")
        live.maintain(live.stream_spans(spark, f"{base}/spans", files_per_batch=2), f"{base}/views", f"{base}/checkpoint", once=True).awaitTermination()
        return live.read_view(spark, f"{base}/views", name)

    return run


def _tag_sql(scope: str) -> str:
    pairs = {"span": ["http_method:http.method", "http_status_code:http.status_code", "priority:priority", "quantity:quantity", "linenumber:linenumber", "returnflag:returnflag", "discount:discount"], "resource": ["service:service.name", "env:deployment.environment", "host:host.name"]}[scope]
    return " UNION ALL ".join(f"SELECT start_ns, '{p.split(':')[1]}' AS tag FROM spans WHERE {p.split(':')[0]} IS NOT NULL" for p in pairs)


_META = f"{WITH}, {_FACTS} SELECT trace_id, root.service AS root_service, root.name AS root_name, start_ns, end_ns, span_count, error_count FROM facts"
_SERVICES = f"{WITH} SELECT start_ns - start_ns % {views.BUCKET_NS} AS bucket_ns, service, count(*) AS span_count FROM spans GROUP BY 1, 2"
_OUT |= {
    "search_traces": (_search, _SEARCH),
    "search_traces_views": (lambda spark, d: _search(spark, d, view_store(spark, d)), _SEARCH),
    "search_matching_spans": (_search_matching, _SEARCH_MATCHING),
    "tag_names_views": (lambda spark, d: tags.tag_names(engine(spark, d), "all", START, END, views=view_store(spark, d)), f"{WITH}, t AS (SELECT 'span' AS scope, * FROM ({_tag_sql('span')}) UNION ALL SELECT 'resource', * FROM ({_tag_sql('resource')})) SELECT DISTINCT scope, tag FROM t WHERE {_BUCKETS} UNION SELECT 'intrinsic', unnest([" + ", ".join(f"'{t}'" for t in tags.INTRINSIC_TAGS) + "])"),
    "service_names": (lambda spark, d: tags.service_names(engine(spark, d), START, END), f"{WITH} SELECT DISTINCT service FROM spans WHERE {_WHEN}"),
    "service_names_views": (lambda spark, d: tags.service_names(engine(spark, d), START, END, views=view_store(spark, d)), f"{WITH} SELECT DISTINCT service FROM spans WHERE {_BUCKETS}"),
    "search_inspected": (lambda spark, d: search.inspected(engine(spark, d), _B), f'{WITH} SELECT count(DISTINCT trace_id) AS "inspectedTraces", count(*) AS "inspectedSpans" FROM spans WHERE trace_id IN (SELECT trace_id FROM spans WHERE {_SQL_B})'),
    "service_stats": (lambda spark, d: search.service_stats(span_store(spark, d)), f"{WITH} SELECT trace_id, service, count(*) AS span_count, count(*) FILTER (WHERE {_SQL_B}) AS error_count FROM spans GROUP BY 1, 2"),
    "trace_spans": (lambda spark, d: traces.trace_spans(engine(spark, d), f"{7:032x}").select("trace_id", "span_id", "parent_span_id", "start_ns", "duration_ns", "status"), f"{WITH} SELECT trace_id, span_id, parent_span_id, start_ns, duration_ns, status FROM spans WHERE trace_id = '{7:032x}'"),
    "trace_tree": (_tree, f"{WITH} SELECT service, scope_name AS scope, span_id, CASE kind WHEN 'SPAN_KIND_INTERNAL' THEN 1 WHEN 'SPAN_KIND_CLIENT' THEN 2 ELSE 3 END AS kind, CAST(start_ns AS VARCHAR) AS start, CASE status WHEN 'STATUS_CODE_OK' THEN 1 WHEN 'STATUS_CODE_ERROR' THEN 2 ELSE 0 END AS code, CAST(CASE WHEN discount IS NULL THEN 3 ELSE 4 END AS INTEGER) AS n_attributes FROM spans WHERE trace_id = '{7:032x}'"),
    "spans_of_traces": (lambda spark, d: traces.spans_of(engine(spark, d), engine(spark, d).trace_ids("{ duration > 4s }")).select("trace_id", "span_id"), f"{WITH}, hit AS (SELECT trace_id, span_id, bool_or(duration_ns > 4000000000) OVER (PARTITION BY trace_id) AS yes FROM spans) SELECT trace_id, span_id FROM hit WHERE yes"),
    "tag_names_span": (lambda spark, d: tags.tag_names(engine(spark, d), "span"), f"{WITH}, t AS ({_tag_sql('span')}) SELECT DISTINCT 'span' AS scope, tag FROM t"),
    "tag_names_resource": (lambda spark, d: tags.tag_names(engine(spark, d), "resource"), f"{WITH}, t AS ({_tag_sql('resource')}) SELECT DISTINCT 'resource' AS scope, tag FROM t"),
    "tag_names_intrinsic": (lambda spark, d: tags.tag_names(engine(spark, d), "intrinsic"), "SELECT 'intrinsic' AS scope, unnest([" + ", ".join(f"'{t}'" for t in tags.INTRINSIC_TAGS) + "]) AS tag"),
    "tag_names_flat": (lambda spark, d: tags.tag_names_flat(engine(spark, d)), f"{WITH}, t AS ({_tag_sql('span')} UNION ALL {_tag_sql('resource')}) SELECT DISTINCT tag FROM t UNION SELECT unnest([" + ", ".join(f"'{t}'" for t in tags.INTRINSIC_TAGS) + "])"),
    "tag_values_attribute": (lambda spark, d: tags.tag_values(engine(spark, d), "priority"), f"{WITH} SELECT DISTINCT priority AS value FROM spans WHERE priority <> ''"),
    "tag_values_scoped": (lambda spark, d: tags.tag_values(engine(spark, d), "span.http.method"), f"{WITH} SELECT DISTINCT http_method AS value FROM spans WHERE http_method <> ''"),
    "tag_values_service": (lambda spark, d: tags.tag_values(engine(spark, d), "service.name"), f"{WITH} SELECT DISTINCT service AS value FROM spans"),
    "tag_values_filtered": (lambda spark, d: tags.tag_values(engine(spark, d), "quantity", "{ status = error && duration > 900ms }"), f"{WITH} SELECT DISTINCT quantity AS value FROM spans WHERE quantity <> '' AND {_SQL_B} AND duration_ns > 900000000"),
    "tag_values_after_structure": (lambda spark, d: tags.tag_values(engine(spark, d), "quantity", f"{_A} > {_B}"), _structure_sql(">") + "SELECT DISTINCT quantity AS value FROM b WHERE quantity <> '' AND (trace_id, parent_span_id) IN (SELECT trace_id, span_id FROM a)"),
    "tag_values_status": (lambda spark, d: tags.tag_values(engine(spark, d), "status"), "SELECT unnest(['error', 'ok', 'unset']) AS value"),
    "view_trace_metadata": (_view("trace_metadata"), _META),
    "view_span_tag_names": (_view("span_tag_names"), f"{WITH}, t AS ({_tag_sql('span')}) SELECT start_ns - start_ns % {views.BUCKET_NS} AS bucket_ns, tag, count(*) AS count FROM t GROUP BY 1, 2"),
    "view_resource_tag_names": (_view("resource_tag_names"), f"{WITH}, t AS ({_tag_sql('resource')}) SELECT start_ns - start_ns % {views.BUCKET_NS} AS bucket_ns, tag, count(*) AS count FROM t GROUP BY 1, 2"),
    "view_service_names": (_view("service_names"), _SERVICES),
    "view_names_between": (lambda spark, d: views.names_between(views.service_partials(span_store(spark, d)), START, START + 86_400_000_000_000), f"{WITH} SELECT DISTINCT service FROM spans WHERE start_ns >= {START} AND start_ns < {START + 86_400_000_000_000}"),
    "stream_trace_metadata": (_streamed("trace_metadata"), _META),
    "stream_service_names": (_streamed("service_names"), _SERVICES),
}

# ---------------------------------------------------------------- requests and answers


def _rows(schema: str, make: Callable[[SparkSession, str], list[tuple]]) -> Query:
    """What a service gives as text or bytes, as rows."""
    return lambda spark, d: spark.createDataFrame(make(spark, d), schema)


_TRACE = f"{7:032x}"
_STEPS = [(0, 10), (0, 3_600), (100, 86_500), (5, 1_000_005)]
_LIMITS = [-1, 0, 1, 20, 99, 100, 101, 5000]
_IDS = ["0AF7651916CD43DD8448EB211C80319C", "0af76519-16cd-43dd-8448-eb211c80319c", "00F067AA0BA902B7"]
_TIMES = [("1700000000", "1700003600"), ("2024-01-02T03:04:05Z", "2024-01-02T05:04:05+01:00"), ("1999-12-31T23:59:59.5Z", "2000-01-01T00:00:00Z")]


def _tree_counts(trace: dict) -> list[tuple]:
    """(service, scope, spans) of a trace's JSON."""
    service = lambda b: next(a["value"]["stringValue"] for a in b["resource"]["attributes"] if a["key"] == "service.name")
    return [(service(b), c["scope"]["name"], len(c["spans"])) for b in trace["batches"] for c in b["scopeSpans"]]


def _fields_of(raw: bytes) -> list[tuple[int, bytes | int]]:
    """Field numbers and values of a protocol buffer message."""
    out, at = [], 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            byte = raw[at]
            at, n, shift = at + 1, n | (byte & 0x7F) << shift, shift + 7
            if byte < 0x80:
                return n

    while at < len(raw):
        key = varint()
        n = {0: 0, 1: 8}.get(key & 7)
        if n == 0:
            out.append((key >> 3, varint()))
            continue
        n = varint() if n is None else n
        out.append((key >> 3, raw[at : at + n]))
        at += n
    return out


def _wire_spans(spark: SparkSession, d: str) -> list[tuple]:
    """(span id, name, start) of a trace, read back from its protocol buffer."""
    raw = wire.trace_message(json.loads(traces.trace_json(engine(spark, d), _TRACE)))
    spans = [dict(_fields_of(s)) for _, b in _fields_of(raw) for n, c in _fields_of(b) if n == 2 for m, s in _fields_of(c) if m == 2]
    return [(s[2].hex(), s[5].decode(), int.from_bytes(s[7], "little")) for s in spans]


def _overview(spark: SparkSession, d: str) -> list[tuple]:
    o = traces.trace_overview(engine(spark, d), _TRACE, first=2)
    return [(o["spans"], o["errors"], ",".join(o["services"]), o["root"], o["duration_ms"], o["truncated"], len(o["first"]))]


def _found(spark: SparkSession, d: str) -> list[tuple]:
    out = json.loads(respond.search_response(engine(spark, d), _B, START, END, 10))
    return [(t["traceID"], t["startTimeUnixNano"], out["metrics"]["inspectedTraces"], out["metrics"]["inspectedSpans"]) for t in out["traces"]]


def _ranged(spark: SparkSession, d: str) -> list[tuple]:
    out = json.loads(respond.range_response(engine(spark, d), f"{_B} | count_over_time() by (kind)", START, END, str(STEP // 1_000_000_000)))
    return [(s["labels"]["kind"], len(s["samples"]), float(sum(x["value"] for x in s["samples"]))) for s in out["series"]]


def _refused(text: str, call: Callable[[], object]) -> tuple:
    try:
        call()
    except QueryError as e:
        return text, list(json.loads(respond.error(e)))[0]
    return text, ""


def _values(rows: list) -> str:
    return ", ".join(f"({', '.join(map(repr, r))})" if isinstance(r, tuple) else f"({r!r})" for r in rows)


_TREE_SQL = f"{WITH} SELECT service, scope_name AS scope, count(*) AS spans FROM spans WHERE trace_id = '{_TRACE}' GROUP BY 1, 2"
_BAD = {"no such stage": "{ } | nothing()", "open brace": "{ status = error", "no metric": "{ }"}
_OUT |= {
    "trace_json_v1": (_rows("service string, scope string, spans long", lambda spark, d: _tree_counts(json.loads(traces.trace_json(engine(spark, d), _TRACE)))), _TREE_SQL),
    "trace_json_v2": (_rows("service string, scope string, spans long", lambda spark, d: _tree_counts(json.loads(traces.trace_json(engine(spark, d), _TRACE, v2=True))["trace"])), _TREE_SQL),
    "trace_protobuf": (_rows("span_id string, name string, start_ns long", _wire_spans), f"{WITH} SELECT span_id, name, start_ns FROM spans WHERE trace_id = '{_TRACE}'"),
    "trace_overview": (_rows("spans long, errors long, services string, root string, duration_ms long, truncated boolean, listed long", _overview), f"{WITH} SELECT count(*) AS spans, count(*) FILTER (WHERE {_SQL_B}) AS errors, string_agg(DISTINCT service, ',' ORDER BY service) AS services, arg_min(name, (CASE WHEN parent_span_id = '' THEN 0 ELSE 1 END, start_ns, span_id)) AS root, (max(start_ns + duration_ns) - min(start_ns)) // 1000000 AS duration_ms, count(*) > 2 AS truncated, least(count(*), 2) AS listed FROM spans WHERE trace_id = '{_TRACE}'"),
    "search_json": (_rows("traceID string, start string, traces long, spans long", _found), f"{WITH}, {_FACTS}, s AS (SELECT * FROM spans WHERE {_WHEN}), m AS (SELECT DISTINCT trace_id FROM s WHERE {_SQL_B}) SELECT trace_id AS \"traceID\", CAST(start_ns AS VARCHAR) AS start, (SELECT count(*) FROM m) AS traces, (SELECT count(*) FROM s WHERE trace_id IN (SELECT trace_id FROM m)) AS spans FROM facts WHERE trace_id IN (SELECT trace_id FROM m) ORDER BY start_ns DESC, trace_id LIMIT 10"),
    "range_json": (_rows("kind string, samples long, total double", _ranged), f"{WITH}, v AS (SELECT {_TS}, kind, count(*) AS n FROM spans WHERE {_WHEN} AND {_SQL_B} GROUP BY 1, 2) SELECT kind, count(*) AS samples, CAST(sum(n) AS DOUBLE) AS total FROM v GROUP BY kind"),
    "errors_json": (_rows("request string, key string", lambda spark, d: [_refused(k, lambda q=q: engine(spark, d).instant(q)) for k, q in _BAD.items()]), f"SELECT request, 'error' AS key FROM (VALUES {_values(list(_BAD))}) t(request)"),
    "steps": (_rows("first long, last long, step_ns long", lambda spark, d: [(a, b, params.step(None, a * 10**9, b * 10**9)) for a, b in _STEPS]), f"SELECT CAST(a AS BIGINT) AS first, CAST(b AS BIGINT) AS last, greatest(1, (b - a) // 100)::BIGINT * 1000000000 AS step_ns FROM (VALUES {_values(_STEPS)}) t(a, b)"),
    "limits": (_rows("asked long, given long", lambda spark, d: [(n, params.limit(n)) for n in _LIMITS]), f"SELECT CAST(n AS BIGINT) AS asked, CAST(CASE WHEN n <= 0 THEN 20 ELSE least(n, 100) END AS BIGINT) AS given FROM (VALUES {_values(_LIMITS)}) t(n)"),
    "ids": (_rows("asked string, given string", lambda spark, d: [(t, params.trace_id(t)) for t in _IDS]), f"SELECT t AS asked, lower(replace(t, '-', '')) AS given FROM (VALUES {_values(_IDS)}) v(t)"),
    "time_ranges": (_rows("asked string, first_ns long, last_ns long", lambda spark, d: [(a, *params.time_range(a, b)) for a, b in _TIMES]), "WITH t(a, b) AS (VALUES " + _values(_TIMES) + "), p AS (SELECT a, CASE WHEN regexp_full_match(a, '[0-9]+') THEN TRY_CAST(a AS BIGINT) * 1000000000 ELSE epoch_us(TRY_CAST(a AS TIMESTAMPTZ)) * 1000 END AS x, CASE WHEN regexp_full_match(b, '[0-9]+') THEN TRY_CAST(b AS BIGINT) * 1000000000 ELSE epoch_us(TRY_CAST(b AS TIMESTAMPTZ)) * 1000 END AS y FROM t) SELECT a AS asked, CAST(x AS BIGINT) AS first_ns, CAST(y AS BIGINT) AS last_ns FROM p"),
    "spans_by_date": (lambda spark, d: span_store(spark, d).groupBy(F.col("date").cast("string").alias("day")).agg(F.count("*").alias("spans")), f"{WITH} SELECT CAST(CAST(make_timestamp(start_ns // 1000) AS DATE) AS VARCHAR) AS day, count(*) AS spans FROM spans GROUP BY 1"),
    "windowed_counts": (lambda spark, d: live.windowed_counts(span_store(spark, d)).select(F.unix_seconds("window_start").alias("window_start"), "service", "span_count"), f"{WITH} SELECT CAST(start_ns // 300000000000 * 300 AS BIGINT) AS window_start, service, count(*) AS span_count FROM spans GROUP BY 1, 2"),
}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _OUT.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _OUT.items() if sql}
