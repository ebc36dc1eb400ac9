"""Packing by non-negative least squares over short combinations of lengths.

A document's ids and its end id are cut into full windows and a remainder. Remainders are counted by length: at most
``window`` - 1 numbers, the only thing the driver gets. All pairs and triples of lengths that fill a window exactly are
enumerated; how often each is to be used is solved as non-negative least squares against the histogram (projected gradient
steps, Barzilai and Borwein's step length), rounded down and held to what is there. What is left is packed greedily, longest first, each
sequence filled to the brim by cutting a document at its end. The last sequence is split at powers of two, which need no
padding.

Which copy of a length goes where depends on its rank among the remainders of that length. Ranks are counted within
buckets of rows and buckets are then added up, so a length that a third of all rows have is no single task's work.

Null text: just the end id. Rows that share an id are packed each for itself. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import arrow_schema, map_arrow, record_batch, release, spread_join, table
from spanloom.llm.tokens import encoder, id_bytes, packed


def combinations_filling(window: int, lengths: np.ndarray, most: int = 2_000_000) -> np.ndarray:
    """Pairs and triples of the given lengths that sum to ``window``, as rows of three with 0 for none.

    All pairs; triples for the longest first length first, as long as there are fewer than ``most`` (a window of 1024 has 87,000).
    Beyond, remainders that would need other triples are packed with the residuals, which pads nothing either.
    """
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    a = np.arange(window // 2, window)
    pairs = a[have[a] & have[window - a]]
    out, n = [np.c_[pairs, window - pairs, np.zeros_like(pairs)]], 0
    for a in sorted(lengths[lengths * 3 >= window], reverse=True):
        b = np.arange(max(1, -(-(window - a) // 2)), min(a, window - a - 1) + 1)
        b = b[have[b] & have[window - a - b]]
        out.append(np.c_[np.full_like(b, a), b, window - a - b])
        if (n := n + len(b)) >= most:
            break
    return np.concatenate(out)


def solve_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 150) -> np.ndarray:
    """x >= 0 that makes the lengths used by x close to the histogram in least squares."""
    x = np.zeros(len(patterns))
    apply = lambda x: sum(np.bincount(patterns[:, k], x, len(histogram)) for k in range(3))
    target = histogram.astype(float)
    target[0] = 0

    def gradient(x: np.ndarray) -> np.ndarray:
        r = apply(x) - target
        r[0] = 0
        return r[patterns].sum(1)

    g, step = gradient(x), 1e-3
    for _ in range(rounds):
        new = np.maximum(0, x - step * g)
        dx, h = new - x, gradient(new)
        dg = h - g
        step = float(dx @ dx / d) if (d := float(dx @ dg)) > 0 else 1e-3
        x, g = new, h
        if not dx.any():
            break
    return x


@dataclass(frozen=True)
class Plan:
    """Slots for remainders by (length, first rank): pattern sequences, then the position at which the residual begins."""

    key: np.ndarray  # length << 40 | first rank of a run
    sequence: np.ndarray  # of the run's first rank; the next ranks take the next sequences
    offset: np.ndarray
    residual_rank: np.ndarray  # by length: from this rank on, residual
    residual_start: np.ndarray  # by length: position of the first residual one
    sequences: int
    residual: int


def make_plan(histogram: np.ndarray, window: int) -> Plan:
    """``histogram[n]``: remainders of n ids."""
    left = histogram.astype(np.int64).copy()
    used = np.zeros_like(left)
    runs, at = [], 0
    lengths = np.flatnonzero(left)
    patterns = combinations_filling(window, lengths[lengths > 0])
    if len(patterns):
        x = solve_counts(patterns, left)
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 0.5:
                break
            p = [int(n) for n in patterns[k] if n]
            times = min(int(left[n]) // p.count(n) for n in p)
            times = min(times, max(1, int(x[k])))
            offset = 0
            for n in p if times else ():
                runs.append(((n << 40) | int(used[n]), at, offset))
                used[n] += times
                left[n] -= times
                offset += n
            at += times
    runs.sort()
    start = np.zeros(len(left), np.int64)
    position = 0
    for n in range(len(left) - 1, 0, -1):
        start[n] = position
        position += n * int(left[n])
    return Plan(*(np.array([r[i] for r in runs], np.int64) for i in range(3)), used, start, at, position)


def tail_cuts(residual: int, window: int) -> list[int]:
    """Where sequences begin after the last full one: at powers of two, largest first."""
    at, out, rest = residual - residual % window, [], residual % window
    for b in range(window.bit_length() - 1, -1, -1):
        if rest & (1 << b):
            out.append(at)
            at += 1 << b
    return out


def place(plan: Plan, window: int, length: int, rank: int) -> list[tuple[int, int, int]]:
    """(sequence, offset, ids) of each piece of the remainder with this length and rank; sequences count from 0."""
    if rank < plan.residual_rank[length]:
        k = int(np.searchsorted(plan.key, (length << 40) | rank, "right")) - 1
        return [(int(plan.sequence[k]) + rank - (int(plan.key[k]) & ((1 << 40) - 1)), int(plan.offset[k]), length)]
    at = int(plan.residual_start[length]) + (rank - int(plan.residual_rank[length])) * length
    full, cuts = plan.residual - plan.residual % window, tail_cuts(plan.residual, window)
    out, end = [], at + length
    while at < end:
        if at < full:
            first = at - at % window
            stop, seq = first + window, first // window
        else:
            k = sum(c <= at for c in cuts) - 1
            first, stop, seq = cuts[k], cuts[k + 1] if k + 1 < len(cuts) else plan.residual, full // window + k
        n = min(end, stop) - at
        out.append((plan.sequences + seq, at - first, n))
        at += n
    return out


def tokenize(docs: DataFrame, path: str, end_id: int, buckets: int) -> DataFrame:
    """rid, bucket, doc_id, n, ids (``id_bytes`` each), written to the shared folder."""
    schema = arrow_schema("doc_id long, n long, ids binary")
    size = id_bytes(path, end_id)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = [packed(x, end_id, size) for x in encoder(path).encode(b.column(1).to_pylist())]
        return record_batch(schema, b.column(0), [len(x) // size for x in ids], ids)

    rows = map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run, "doc_id long, n long, ids binary")
    rows = rows.withColumn("rid", F.monotonically_increasing_id())
    return table(rows.withColumn("bucket", F.pmod(F.xxhash64("rid"), F.lit(buckets)).cast("int")), "tokens")


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, window: int = 1024, fn=None, extra: str = "ids_crc32 long") -> DataFrame:
    """A row for each piece: doc_id, start, length, ``extra`` (by ``fn(ids of the piece)``), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    fn = fn or (lambda a: (zlib.crc32(a.tobytes()),))
    buckets = max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tokens = tokenize(docs, path, end_id, buckets)
    release(spark)
    lens = tokens.select("rid", "bucket", F.expr(f"n div {window}").alias("full"), F.expr(f"n % {window}").cast("int").alias("rest"))
    histogram = np.zeros(window, np.int64)
    counts = table(lens.groupBy("bucket", "rest").agg(F.count("*").alias("c"), F.sum("full").alias("f")), "lengths")
    for r in counts.groupBy("rest").agg(F.sum("c").alias("c")).collect():  # at most ``window`` rows
        histogram[r.rest] = r.c
    plan = make_plan(histogram, window)
    full_base = plan.sequences + plan.residual // window + len(tail_cuts(plan.residual, window))
    per_bucket = counts.groupBy("bucket").agg(F.sum("f").alias("f"))
    per_bucket = per_bucket.select("bucket", (F.sum("f").over(Window.orderBy("bucket")) - F.col("f")).alias("full_base"))  # one row for each bucket
    per_rest = counts.select("bucket", "rest", (F.sum("c").over(Window.partitionBy("rest").orderBy("bucket")) - F.col("c")).alias("rank_base"))
    inner = Window.partitionBy("bucket").orderBy("rest", "rid")
    ranked = lens.select("rid", "bucket", "rest", (F.sum("full").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("full")).alias("full_at"), (F.row_number().over(Window.partitionBy("bucket", "rest").orderBy("rid")) - 1).alias("rank_at"))
    placed = ranked.join(per_bucket, "bucket").join(per_rest, ["bucket", "rest"]).select("rid", (F.col("full_base") + F.col("full_at")).alias("full_at"), (F.col("rank_base") + F.col("rank_at")).alias("rank"))
    ddl = f"doc_id long, start long, length long, {extra}, doc_tokens long, sequence_id long, offset long"
    schema = arrow_schema(ddl)
    narrow = f"<u{id_bytes(path, end_id)}"

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, n, ids, full_at, rank in zip(*(c.to_pylist() for c in b.columns), strict=True):
            a, at = np.frombuffer(ids, narrow).astype("<u4"), 0
            pieces = [(full_base + full_at + k, 0, window) for k in range(n // window)]
            if n % window:
                pieces += place(plan, window, n % window, rank)
            for seq, offset, k in pieces:
                rows.append((doc_id, at, k, *fn(a[at : at + k]), n, seq, offset))
                at += k
        return record_batch(schema, *zip(*rows, strict=True))

    joined = spread_join(tokens.select("rid", "doc_id", "n", "ids"), placed, ["rid"]).select("doc_id", "n", "ids", "full_at", "rank")
    return map_arrow(joined, cut, ddl)
