"""Request parameters: times, steps, limits, ids."""

from __future__ import annotations

import re
import time
from datetime import datetime

from spanloom.plans.syntax import QueryError, nanoseconds

DEFAULT_LIMIT, MAX_LIMIT = 20, 100
_NS = 1_000_000_000


def trace_id(text: str) -> str:
    """Without dashes, lower case; 16 or 32 hex digits."""
    t = text.replace("-", "").lower()
    if not re.fullmatch(r"[0-9a-f]{16}|[0-9a-f]{32}", t):
        raise QueryError(f"invalid trace id {text!r}")
    return t


def moment(text: str) -> int:
    """RFC 3339 or unix seconds, to nanoseconds."""
    if re.fullmatch(r"\d+", text):
        return int(text) * _NS
    try:
        t = datetime.fromisoformat(text)
    except ValueError as e:
        raise QueryError(f"invalid time {text!r}") from e
    if t.tzinfo is None:
        raise QueryError(f"time without a zone: {text!r}")
    whole = int(t.replace(microsecond=0).timestamp())
    return whole * _NS + t.microsecond * 1000


def time_range(start: str | None = None, end: str | None = None, now_ns: int | None = None) -> tuple[int, int]:
    """The last hour by default."""
    last = moment(end) if end else now_ns or time.time_ns()
    first = moment(start) if start else last - 3600 * _NS
    if first > last:
        raise QueryError("the range ends before it begins")
    return first, last


def step(text: str | None, start_ns: int, end_ns: int) -> int:
    """A duration, whole seconds, or about a hundred points over the range; in ns, a second at least."""
    if text:
        if re.fullmatch(r"\d+", text):
            return max(1, int(text)) * _NS
        if re.fullmatch(r"(?:\d+(?:\.\d+)?(?:ns|us|µs|ms|s|m|h|d))+", text):
            return max(_NS, nanoseconds(text))
        raise QueryError(f"invalid step {text!r}")
    return max(1, (end_ns - start_ns) // 100 // _NS) * _NS


def limit(n: int | None) -> int:
    return min(n, MAX_LIMIT) if n and n > 0 else DEFAULT_LIMIT
