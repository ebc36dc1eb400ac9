"""Answers as JSON, in the shapes that trace clients expect. Limits have been applied by then; a range answer is refused where it has too many series."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.metrics import series
from spanloom.plans.engine import Engine
from spanloom.plans.syntax import QueryError
from spanloom.services import params, search, tags


def _rows(df: DataFrame) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().collect()]


def error(message: object) -> str:
    return json.dumps({"error": str(message)})


def search_response(engine: Engine, text: str, start_ns: int | None = None, end_ns: int | None = None, limit: int | None = None, **options) -> str:
    """Traces with their start as a string, and how much was looked at."""
    found = _rows(search.search(engine, text, start_ns, end_ns, params.limit(limit), **options))
    for t in found:
        t["startTimeUnixNano"] = str(t["startTimeUnixNano"])
        for s in t.get("spanSets", ()):
            for x in s.get("spans", ()):
                x |= {k: str(x[k]) for k in ("startTimeUnixNano", "durationNanos")}
    seen = search.inspected(engine, text, start_ns, end_ns).first()
    return json.dumps({"traces": found, "metrics": {"inspectedTraces": seen.inspectedTraces, "inspectedSpans": seen.inspectedSpans}})


def tags_v1(engine: Engine, start_ns: int | None = None, end_ns: int | None = None) -> str:
    return json.dumps({"tagNames": [r.tag for r in tags.tag_names_flat(engine, start_ns, end_ns).collect()]})


def tags_v2(engine: Engine, scope: str = "", start_ns: int | None = None, end_ns: int | None = None) -> str:
    rows = tags.tag_names(engine, scope, start_ns, end_ns).groupBy("scope").agg(F.sort_array(F.collect_list("tag")).alias("tags")).collect()
    by = {r["scope"]: r.tags for r in rows}
    wanted = [scope] if scope in ("intrinsic", "resource", "span") else ["intrinsic", "resource", "span"]
    return json.dumps({"scopes": [{"name": s, "tags": by.get(s, [])} for s in wanted]})


def tag_values(engine: Engine, name: str, filter_query: str = "", start_ns: int | None = None, end_ns: int | None = None, v2: bool = True) -> str:
    values = [r.value for r in tags.tag_values(engine, name, filter_query, start_ns, end_ns).collect()]
    return json.dumps({"tagValues": [{"type": "string", "value": v} for v in values] if v2 else values})


def range_response(engine: Engine, text: str, start_ns: int, end_ns: int, step: str | None = None, most_series: int = 10_000) -> str:
    """More than ``most_series`` series are an error, not a part of the answer: such a query should group by less or end in topk."""
    rows = series(engine.range(text, start_ns, end_ns, params.step(step, start_ns, end_ns)))
    found = _rows(rows.limit(most_series + 1))
    if len(found) > most_series:
        raise QueryError(f"the answer has more than {most_series} series")
    return json.dumps({"series": [{"labels": r.get("labels", {}), "promLabels": r["prom_labels"], "samples": [{"timestampMs": str(s["timestampMs"]), "value": s["value"]} for s in r["samples"]]} for r in found]})


def instant_response(engine: Engine, text: str, start_ns: int, end_ns: int, limit: int = 100) -> str:
    rows = engine.instant(text, start_ns, end_ns)
    names = [c for c in rows.columns if c.startswith("label_")]
    out = []
    for r in _rows(rows.orderBy(F.desc("value"), *names).limit(limit)):
        labels = {n.removeprefix("label_"): r.get(n, "") for n in names}
        out.append({"labels": labels, "promLabels": "{" + ", ".join(f'{k}="{v}"' for k, v in labels.items()) + "}", "value": r.get("value")})
    return json.dumps({"series": out})


def summary_response(engine: Engine, text: str = "", by: tuple[str, ...] = (), start_ns: int | None = None, end_ns: int | None = None, limit: int = 10) -> str:
    out = []
    for r in _rows(engine.summary(text, by, start_ns, end_ns, limit)):
        labels = [{"key": k.removeprefix("label_"), "value": v} for k, v in r.items() if k.startswith("label_")]
        out.append({"spanCount": r["span_count"], "errorSpanCount": r["error_span_count"], **{p: r[p] for p in ("p99", "p95", "p90", "p50")}, "series": labels})
    return json.dumps({"summaries": out})
