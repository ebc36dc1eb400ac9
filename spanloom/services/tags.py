"""Discovery of attribute names and values."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.spansets import matching
from spanloom.operators.views import names_between
from spanloom.plans.engine import Engine
from spanloom.plans.syntax import KINDS, SCOPES, QueryError, parse
from spanloom.sources.spans import in_range

#: How many names or values are listed unless asked otherwise; None lists all.
LIMIT = 1000
#: Intrinsics that are offered as tags; fixed values.
INTRINSIC_TAGS = ("duration", "kind", "name", "rootName", "rootServiceName", "status", "statusMessage", "traceDuration")
#: What an attribute's name may be; a fixed value.
_NAME = re.compile(r"[a-zA-Z_][a-zA-Z0-9_.]*")


def tag_names(engine: Engine, scope: str = "", start_ns: int | None = None, end_ns: int | None = None, limit: int | None = LIMIT, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """scope, tag: names in use, for each scope up to ``limit`` in ascending order. ``scope``: intrinsic, resource, span or all.

    ``views``: the derived tables ``resource_tag_names`` and ``span_tag_names``, read instead of the spans; a range is then
    widened to their buckets.
    """
    spark = engine.spans.sparkSession
    parts = []
    if scope not in ("resource", "span"):
        parts.append(spark.createDataFrame([("intrinsic", t) for t in INTRINSIC_TAGS], "scope string, tag string"))
    for s in ("resource", "span"):
        if scope in (s, "", "all") or scope not in ("intrinsic", "resource", "span"):
            if views is not None:
                names = names_between(views[f"{s}_tag_names"], start_ns, end_ns, limit)
            else:
                names = _listed(in_range(engine.spans, start_ns, end_ns).select(F.explode(F.map_keys(f"{s}_attributes")).alias("tag")), limit)
            parts.append(names.select(F.lit(s).alias("scope"), "tag"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _listed(names: DataFrame, limit: int | None) -> DataFrame:
    """Each once, ascending."""
    out = names.distinct().orderBy(*names.columns)
    return out if limit is None else out.limit(limit)


def tag_names_flat(engine: Engine, start_ns: int | None = None, end_ns: int | None = None, limit: int | None = LIMIT, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """tag: all names once, ascending."""
    return tag_names(engine, "", start_ns, end_ns, limit, views).select("tag").distinct().orderBy("tag")


def service_names(engine: Engine, start_ns: int | None = None, end_ns: int | None = None, limit: int | None = LIMIT, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """service: names in use, ascending; from the derived table ``service_names`` if ``views`` are given."""
    if views is not None:
        return names_between(views["service_names"], start_ns, end_ns, limit)
    return _listed(in_range(engine.spans, start_ns, end_ns).select("service").where("service <> ''"), limit)


def tag_values(engine: Engine, name: str, filter_query: str = "", start_ns: int | None = None, end_ns: int | None = None, limit: int | None = LIMIT) -> DataFrame:
    """value: distinct non-empty values, ascending, up to ``limit``, of the spans that the filter query hands on.

    A scope before the name (``span.``, ``resource.``) narrows it to that scope.
    """
    if not _NAME.fullmatch(name):
        raise QueryError(f"invalid attribute name {name!r}")
    spark = engine.spans.sparkSession
    fixed = {"status": ["error", "ok", "unset"], "kind": list(KINDS)}.get(name)
    if fixed:
        return spark.createDataFrame([(v,) for v in fixed], "value string")
    spans = matching(engine.spans, parse(filter_query).pipeline, engine.fields, start_ns, end_ns, walk_limit=engine.walk_limit)
    scope, _, rest = name.partition(".")
    scope, key = (scope, rest) if scope in SCOPES[:2] and rest else ("", name)
    if name == "service.name" or scope == "resource" and key == "service.name":
        values = spans.select(F.col("service").alias("value"))
    else:
        parts = [spans.select(F.col(f"{s}_attributes")[key].alias("value")) for s in ("span", "resource") if scope in ("", s)]
        values = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return _listed(values.where("value <> ''"), limit)
