"""The 26 spans and the expected answers that FIXTURES.md lists, read from its tables."""

from __future__ import annotations

import re
from datetime import UTC, datetime
from pathlib import Path

from spanloom.sources.spans import SPAN_SCHEMA

TEXT = (Path(__file__).parents[1] / "FIXTURES.md").read_text()


def _table(first_cell: str) -> list[list[str]]:
    lines = TEXT.split("\n")
    at = next(i for i, x in enumerate(lines) if x.startswith(f"| {first_cell} |"))
    rows = []
    for line in lines[at + 2 :]:
        if not line.startswith("|"):
            break
        rows.append([c.strip().replace("\\|", "|").strip("`") for c in re.split(r"(?<!\\)\|", line)[1:-1]])
    return rows


def _ns(text: str, ms: int = 0) -> int:
    t = datetime.fromisoformat(f"2025-01-15T{text}").replace(tzinfo=UTC)
    return (int(t.timestamp() * 1000) + ms) * 1_000_000


def rows() -> list[tuple]:
    out = []
    for n, _, start, trace, span, parent, name, kind, service, ms, status, message, attributes, where in _table("#"):
        letter, length = trace[0], int(re.search(r"\((\d+)\)", trace)[1])
        env, host = where.split(" / ")
        pairs = dict(a.split("=", 1) for a in attributes.split("; "))
        resource = {"service.name": service, "service.version": "1", "deployment.environment": env, "host.name": host}
        begin = _ns(start)
        events, links = [], []
        if n == "9":
            events = [(_ns("11:00:01.800"), "exception", {"exception.type": "PaymentDeclined"})]
        if n == "16":
            events = [(_ns("11:45:03"), "db.slow_query", {})]
        if n == "18":
            links = [("b" * 32, "2000000000000003", "", {"link.reason": "retry"})]
        out.append((letter * length, span, "" if parent == "root" else parent, "", name, f"SPAN_KIND_{kind}", service, resource, "scope", "1", pairs, begin, int(ms) * 1_000_000, f"STATUS_CODE_{status}", message, events, links, datetime.fromtimestamp(begin / 1e9, UTC).date()))
    return out


def spans(spark):
    return spark.createDataFrame(rows(), SPAN_SCHEMA)


def answers() -> list[tuple[str, set[str]]]:
    """Query and the letters of the traces it finds."""
    out = []
    for query, traces in _table("query"):
        query = re.sub(r"` \(.*", "", query).strip("`")
        query = re.sub(r"\{ (frontend|api-gateway|order-service) \}", r'{ resource.service.name = "\1" }', query)
        out.append((query, {t.strip()[0] for t in traces.split(",")} - {"∅"}))
    return out
