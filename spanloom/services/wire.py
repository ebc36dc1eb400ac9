"""Traces as protocol buffers: the OTLP trace message, written without a generated class.

A message is a list of (field number, value): bytes and str are length-delimited, int a varint, ``Fixed`` eight bytes, and a
list of pairs a nested message. Field numbers are those of the public OTLP definitions.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Fixed:
    value: int


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def encode(fields: list[tuple[int, object]]) -> bytes:
    out = []
    for number, v in fields:
        if v in ("", b"", 0, None):
            continue  # defaults are not written
        if isinstance(v, Fixed):
            out.append(varint(number << 3 | 1) + v.value.to_bytes(8, "little"))
        elif isinstance(v, int):
            out.append(varint(number << 3) + varint(v))
        else:
            raw = v.encode() if isinstance(v, str) else v if isinstance(v, bytes) else encode(v)
            out.append(varint(number << 3 | 2) + varint(len(raw)) + raw)
    return b"".join(out)


def _id(text: str) -> bytes:
    return bytes.fromhex(text) if len(text) % 2 == 0 else text.encode()


def _attributes(number: int, pairs: list) -> list[tuple[int, object]]:
    return [(number, [(1, p["key"]), (2, [(1, p["value"]["stringValue"])])]) for p in pairs or ()]


def span_message(s: dict) -> list[tuple[int, object]]:
    events = [(11, [(1, Fixed(int(e["timeUnixNano"]))), (2, e["name"]), *_attributes(3, e["attributes"])]) for e in s.get("events") or ()]
    links = [(13, [(1, _id(x["traceId"])), (2, _id(x["spanId"])), (3, x["traceState"]), *_attributes(4, x["attributes"])]) for x in s.get("links") or ()]
    return [
        (1, _id(s["traceId"])),
        (2, _id(s["spanId"])),
        (4, _id(s["parentSpanId"])),
        (5, s["name"]),
        (6, s["kind"]),
        (7, Fixed(int(s["startTimeUnixNano"]))),
        (8, Fixed(int(s["endTimeUnixNano"]))),
        *_attributes(9, s["attributes"]),
        *events,
        *links,
        (15, [(2, s["status"]["message"]), (3, s["status"]["code"])]),
    ]


def trace_message(trace: dict, v2: bool = False) -> bytes:
    """``trace``: the tree of ``trace_json`` as a dict. v2 wraps it in a response whose status is complete (0)."""
    batches = []
    for b in trace["batches"]:
        scopes = [(2, [(1, [(1, c["scope"]["name"]), (2, c["scope"]["version"])]), *[(2, span_message(s)) for s in c["spans"]]]) for c in b["scopeSpans"]]
        batches.append((1, [(1, _attributes(1, b["resource"]["attributes"])), *scopes]))
    return encode([(1, batches)]) if v2 else encode(batches)
