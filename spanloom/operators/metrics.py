"""Time-series metrics over the spans of a pipeline: one grouped aggregation, with partial sums wherever the function allows it.

Quantiles are exact without holding a group's values in one place: spans are counted by group and bucket of value, which
tells the buckets that hold the wanted ranks; only their values are ranked. ``approximate`` takes them from a bounded sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.predicates import Fields
from spanloom.operators.spansets import matching
from spanloom.plans.syntax import Attribute, Intrinsic, Metric, Pipeline, Query, QueryError, TopK

#: Upper bounds of the duration histogram: powers of two from 2 ms; fixed values.
BUCKETS_MS = tuple(2**i for i in range(1, 15))


def split(query: Query) -> tuple[Metric, Pipeline | None, list[TopK]]:
    """The last metric, the stages before it (the filter), and what selects series after it."""
    stages = query.pipeline.stages
    at = max((i for i, s in enumerate(stages) if isinstance(s, Metric)), default=None)
    if at is None:
        raise QueryError("the query has no metric")
    return stages[at], Pipeline(stages[:at]) if at else None, [s for s in stages[at + 1 :] if isinstance(s, TopK)]


def label_name(x: Attribute | Intrinsic) -> str:
    """The name of a grouping attribute as it is written in results."""
    if isinstance(x, Attribute):
        return ".".join(p for p in ("parent" if x.parent else "", x.scope, x.name) if p)
    return ("parent." if x.parent else "") + x.name


def label_column(name: str) -> str:
    for c in ".: ":
        name = name.replace(c, "_")
    return f"label_{name}"


def bucket_label(ms: int) -> str:
    return f"{ms}ms" if ms < 1000 else f"{ms / 1000:g}s"


def _labels(metric: Metric, fields: Fields) -> list[Column]:
    return [fields.text(x).alias(label_column(label_name(x))) for x in metric.by]


def _measured(metric: Metric, fields: Fields) -> Column:
    """What is measured of a span; an attribute that is no number is left out."""
    return F.col("duration_ns") if metric.argument is None else fields.number(metric.argument, F.lit(None).cast("double"))


def _grouped(rows: DataFrame, metric: Metric, fields: Fields, names: list[str], step_seconds: int | None, approximate: bool) -> DataFrame:
    """``names`` and value. ``step_seconds`` None: over the whole range."""
    x = _measured(metric, fields)
    if metric.fn == "quantile_over_time":
        q = metric.numbers[0] if metric.numbers else 0.5
        rows = rows.select(*names, x.cast("double").alias("x"))
        if approximate:
            return rows.groupBy(*names).agg(F.percentile_approx("x", q, 10_000).alias("value"))
        return quantiles(rows, names, "x", [q]).select(*names, F.col("q")[0].alias("value"))
    if metric.fn == "rate":
        value = F.count("*") / F.lit(step_seconds) if step_seconds else F.count("*").cast("double")
    elif metric.fn == "count_over_time":
        value = F.count("*").cast("double")
    else:
        value = {"min_over_time": F.min, "max_over_time": F.max, "avg_over_time": F.avg, "sum_over_time": F.sum}[metric.fn](x).cast("double")
    return rows.groupBy(*names).agg(value.alias("value"))


def quantiles(rows: DataFrame, names: list[str], x: str, shares: list[float]) -> DataFrame:
    """``names`` and q (array, by ``shares``), interpolated between ranks; null where a group has no value of ``x`` (double).

    Sixteen buckets for each factor of e, so a group has some hundreds at most, and a bucket is a small part of it.
    """
    size = F.floor(F.log1p(F.abs(x)) * 16)
    bucketed = rows.withColumn("_bucket", F.when(F.col(x) < 0, -size).otherwise(size))
    counts = bucketed.groupBy(*names, "_bucket").agg(F.count(x).alias("_n"))
    group, by_bucket = Window.partitionBy(*names), Window.partitionBy(*names).orderBy(F.col("_bucket").asc_nulls_first())
    counts = counts.withColumn("_all", F.sum("_n").over(group)).withColumn("_before", F.sum("_n").over(by_bucket) - F.col("_n"))
    at = [F.lit(q) * (F.col("_all") - 1) for q in shares]
    ranks = F.array(*[f(a).cast("long") for a in at for f in (F.floor, F.ceil)])
    wanted = counts.withColumn("_ranks", F.array_distinct(F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))))
    wanted = wanted.where("_bucket is not null and size(_ranks) > 0").select(*[F.col(n).alias(f"_k{i}") for i, n in enumerate(names)], F.col("_bucket").alias("_b"), "_before", "_ranks")
    same = F.col("_bucket") == F.col("_b")
    for i, n in enumerate(names):
        same = same & F.col(n).eqNullSafe(F.col(f"_k{i}"))
    values = bucketed.select(*names, "_bucket", F.col(x).alias("_x")).join(wanted, same).groupBy(*names, "_bucket", "_before", "_ranks", "_x").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*names, "_bucket").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    values = values.withColumn("_upto", upto).withColumn("_ranks", F.filter("_ranks", lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_n")))).where("size(_ranks) > 0")
    found = values.select(*names, F.explode("_ranks").alias("_r"), "_x").groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("_r", "_x"))).alias("_v"))
    groups = counts.groupBy(*names).agg(F.first("_all").alias("_all"))
    same = F.lit(True)
    for i, n in enumerate(names):
        same = same & F.col(n).eqNullSafe(F.col(f"_k{i}"))
    both = groups.join(found.select(*[F.col(n).alias(f"_k{i}") for i, n in enumerate(names)], "_v"), same, "left")
    low, high = [F.element_at("_v", F.floor(a).cast("long")) for a in at], [F.element_at("_v", F.ceil(a).cast("long")) for a in at]
    return both.select(*names, F.array(*[lo + (hi - lo) * (a - F.floor(a)) for lo, hi, a in zip(low, high, at, strict=True)]).alias("q"))


def range_metric(spans: DataFrame, query: Query, start_ns: int | None, end_ns: int | None, step_ns: int, fields: Fields | None = None, approximate: bool = False) -> DataFrame:
    """ts_ms, label_* (le for histograms), value: a row for each step, from the epoch on, and series that has spans.

    Steps are whole seconds, one at least. ``approximate`` takes quantiles from a bounded sketch instead of all values.
    """
    fields = fields or Fields()
    metric, pipeline, tops = split(query)
    seconds = max(1, step_ns // 1_000_000_000)
    step = seconds * 1_000_000_000
    rows = matching(spans, pipeline, fields, start_ns, end_ns, (metric,))
    ts = (F.expr(f"start_ns div {step}") * (seconds * 1000)).cast("long")
    names = ["ts_ms", *[label_column(label_name(x)) for x in metric.by]]
    rows = rows.select(ts.alias("ts_ms"), *_labels(metric, fields), "*")
    if metric.fn == "histogram_over_time":
        x = F.col("duration_ns") if metric.argument is None else fields.number(metric.argument)
        le = F.lit("+Inf")
        for ms in reversed(BUCKETS_MS):
            le = F.when(x <= ms * 1_000_000, bucket_label(ms)).otherwise(le)
        return rows.groupBy(*names, le.alias("le")).agg(F.count("*").cast("double").alias("value"))
    out = _grouped(rows, metric, fields, names, seconds, approximate)
    for t in tops:
        out = top_series(out, t, ["ts_ms"], names[1:])
    return out


def top_series(rows: DataFrame, top: TopK, keys: list[str], names: list[str]) -> DataFrame:
    """The n largest (or smallest) values at each time; ties go by the labels. Values are aggregates already, so few."""
    value = F.asc("value") if top.bottom else F.desc("value")
    w = Window.partitionBy(*keys).orderBy(value, *names) if keys else Window.orderBy(value, *names)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= top.n).drop("_rank")


def instant_metric(spans: DataFrame, query: Query, start_ns: int | None, end_ns: int | None, fields: Fields | None = None, per_second: bool = False, approximate: bool = False) -> DataFrame:
    """label_*, value over the whole range. ``per_second`` divides a rate by the range's length.

    A histogram gives an array of up to ten (x, y) bins, widths adapted to the values.
    """
    fields = fields or Fields()
    metric, pipeline, tops = split(query)
    rows = matching(spans, pipeline, fields, start_ns, end_ns, (metric,)).select(*_labels(metric, fields), "*")
    names = [label_column(label_name(x)) for x in metric.by]
    seconds = (end_ns - start_ns) // 1_000_000_000 if per_second and start_ns is not None and end_ns is not None else None
    if metric.fn == "histogram_over_time":
        out = rows.groupBy(*names).agg(F.histogram_numeric(_measured(metric, fields).cast("double"), F.lit(10)).alias("value"))
    else:
        out = _grouped(rows, metric, fields, names, seconds, approximate)
    for t in tops:
        # Two steps: first in buckets of series, so that no task ranks all of them.
        if names:
            out = top_series(out.withColumn("_b", F.pmod(F.xxhash64(*names), F.lit(64))), t, ["_b"], names).drop("_b")
        out = top_series(out, t, [], names)
    return out


def series(rows: DataFrame) -> DataFrame:
    """Rows of a range metric to labels (map), prom_labels, samples (array of timestampMs and value, ascending)."""
    names = [c for c in rows.columns if c.startswith("label_") or c == "le"]
    pairs = [F.struct(F.lit(n.removeprefix("label_")).alias("key"), F.col(n).alias("value")) for n in names]
    labels = F.map_from_entries(F.array(*pairs)) if pairs else F.create_map().cast("map<string,string>")
    prom = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(n.removeprefix("label_") + '="'), F.col(n), F.lit('"')) for n in names]), F.lit("}"))
    grouped = rows.groupBy(*names) if names else rows.groupBy()
    out = grouped.agg(F.array_sort(F.collect_list(F.struct(F.col("ts_ms").alias("timestampMs"), "value"))).alias("samples"))
    return out.select(labels.alias("labels"), prom.alias("prom_labels"), "samples").where(F.array_size("samples") > 0)


def summary(spans: DataFrame, query: Query | None, by: list, start_ns: int | None = None, end_ns: int | None = None, limit: int | None = 10, fields: Fields | None = None, approximate: bool = False) -> DataFrame:
    """span_count, error_span_count, p99, p95, p90, p50 (ms) and label_* of the spans that pass the filters.

    With a limit, the groups with the most spans come first. ``approximate`` takes percentiles from a bounded sketch.
    """
    fields = fields or Fields()
    rows = matching(spans, query.pipeline if query else None, fields, start_ns, end_ns, tuple(by))
    names = [label_column(label_name(x)) for x in by]
    shares = [0.99, 0.95, 0.9, 0.5]
    rows = rows.select(*[fields.text(x).alias(n) for x, n in zip(by, names, strict=True)], F.col("duration_ns").cast("double").alias("_x"), "status")
    counted = [F.count("*").alias("span_count"), F.count_if(F.col("status") == "STATUS_CODE_ERROR").alias("error_span_count")]
    if approximate:
        out = rows.groupBy(*names).agg(*counted, F.percentile_approx("_x", shares, 10_000).alias("q"))
    else:
        out = rows.groupBy(*names).agg(*counted)
        same, q = F.lit(True), quantiles(rows, names, "_x", shares)
        for i, n in enumerate(names):
            q = q.withColumnRenamed(n, f"_g{i}")
            same = same & F.col(n).eqNullSafe(F.col(f"_g{i}"))
        out = out.join(q, same, "left")
    out = out.select("span_count", "error_span_count", *[(F.col("q")[i] / 1e6).alias(p) for i, p in enumerate(("p99", "p95", "p90", "p50"))], *names)
    return out if limit is None else out.orderBy(F.desc("span_count"), *names).limit(limit)
