"""Document fingerprints from content-defined chunks: normalised gear hashing, digests weighted by length.

A gear hash rolls over the bytes of a text. A chunk ends where the hash has ``strict`` zero bits before the normal size and
where it has only ``loose`` zero bits after it (normalised chunking), between a least and a largest size. A chunk is known
by 32 bits of XXH64 and its length; the set of them is the fingerprint, written in ascending order. As boundaries depend on
the bytes near them only, an insertion changes the chunks around it and no others. Likeness is containment: the bytes of
shared chunks over those of the smaller set.

Blank and null texts have the empty fingerprint; it is like itself (1.0) and nothing else (0.0). Equal texts have equal
fingerprints. Rows that share an id follow one another by the hash of their text; rows without an id come first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import arrow_schema, record_batch, table, tune
from spanloom.llm.ranges import range_parts

LEAST, NORMAL, MOST = 12, 32, 128
_TURN = 16  # bytes a hash looks back
_STRICT, _LOOSE = np.uint32(0b1111110 << 9), np.uint32(0b111100 << 9)


def _gear() -> np.ndarray:
    from spanloom.llm.common import mix64

    return np.append(mix64(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32), np.uint32(0))


_GEAR = _gear()


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8):  # after these, each position holds the hash of the _TURN bytes up to it
        h[k:] += h[:-k] << np.uint32(k)
    far = np.int32(n + MOST)
    spots = np.arange(1, n + 1, dtype=np.int32)

    def following(mask: np.uint32) -> np.ndarray:
        """By position: the first end at or after it."""
        ends = np.full(n + 1 + MOST, far, np.int32)
        ends[1 : n + 1] = np.where(h & mask == 0, spots, far)
        return np.minimum.accumulate(ends[::-1])[::-1]

    strict, loose = following(_STRICT), following(_LOOSE)
    at = np.arange(n, dtype=np.int32)
    s, l = strict[LEAST : LEAST + n], loose[NORMAL : NORMAL + n]
    after = memoryview(np.minimum(np.where(s < at + NORMAL, s, np.minimum(l, at + MOST)), n))
    out, p = [], 0
    while p < n:
        p = after[p]
        out.append(p)
    return out


def chunk_set(text: str | bytes | None) -> dict[int, int]:
    """Digest to length."""
    import xxhash

    data = text.encode() if isinstance(text, str) else text or b""
    out, start, view, digest = {}, 0, memoryview(data), xxhash.xxh64_intdigest
    for end in boundaries(data):
        out[digest(view[start:end]) & 0xFFFFFFFF] = end - start
        start = end
    return out


def to_string(chunks: dict[int, int]) -> str:
    """Eight hex digits of digest and two of length for each chunk, ascending."""
    return b"".join(((d << 8) | n).to_bytes(5, "big") for d, n in sorted(chunks.items())).hex()


def from_string(fingerprint: str) -> dict[int, int]:
    raw = bytes.fromhex(fingerprint)
    return {int.from_bytes(raw[i : i + 4], "big"): raw[i + 4] for i in range(0, len(raw), 5)}


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Bytes in shared chunks over the bytes of the smaller set."""
    if not a or not b:
        return float(a == b)
    shared = sum(a[d] for d in a.keys() & b.keys())
    return min(1.0, shared / min(sum(a.values()), sum(b.values())))


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many (or all) of the following text's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, fn, ddl: str, part_docs: int = 1000) -> DataFrame:
    """``fn(doc_id, text, next text)`` gives a row of ``ddl``; the next document by ascending id, after the last the first.

    Texts are dealt out once, by ranges of ids and, where many rows share an id, of hashes. The first document of each range goes to
    the range before it as well, there to follow its last; so no window runs over the whole table, only one over the ranges.
    """
    spark = docs.sparkSession
    tune(spark)
    keyed = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(text as string), '') text").withColumn("h", F.xxhash64("text")).select("doc_id", "h", "text")
    parts = range_parts(keyed.select("doc_id", "h"), part_docs)
    keyed = parts.add(keyed)
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")
    firsts = keyed.select("part", order.alias("o")).groupBy("part").agg(F.min("o").alias("o"))
    firsts = table(firsts.select("part", F.col("o.doc_id").alias("first_id"), F.col("o.h").alias("first_h")), "firsts")  # at most two times MOST_PARTS rows
    last = F.max("part").over(Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    to = F.coalesce(F.lag("part").over(Window.partitionBy(F.lit(0)).orderBy("part")), last)  # before the first part comes the last
    marks = keyed.drop("part").join(F.broadcast(firsts.select("first_id", "first_h", to.alias("part"))), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h")))
    marks = marks.groupBy("part").agg(F.first(F.struct("doc_id", "h", "text")).alias("x"))  # rows equal in id and text are one mark
    marks = marks.select("part", "x.doc_id", "x.h", "x.text", F.lit(1).alias("mark"))
    rows = keyed.select("part", "doc_id", "h", "text", F.lit(0).alias("mark")).union(marks)
    n = max(1, min(parts.count, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = rows.repartition(n, "part").sortWithinPartitions("part", "mark", F.col("doc_id").asc_nulls_first(), "h")
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the document whose next one is not yet known
        for b in batches:
            out = []
            for part, doc_id, text, mark in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[0] == part:
                    out.append(fn(held[1], held[2], text))
                held = None if mark else (part, doc_id, text)
            if out:
                yield record_batch(schema, *zip(*out, strict=True))

    return rows.select("part", "doc_id", "text", "mark").mapInArrow(run, ddl)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    known: dict[str, dict[int, int]] = {}  # of the next text, which is the following row's own

    def row(doc_id: int | None, text: str, following: str) -> tuple:
        changed = edited(text, following)
        own = known.pop(text, None)
        known.clear()
        own = chunk_set(text) if own is None else own
        known[following] = after = own if following == text else chunk_set(following)
        new = chunk_set(changed)
        return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), to_string(own), to_string(new), containment(own, new), containment(own, after)

    return with_next(docs, row, ddl)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each row."""
    from spanloom.llm.common import map_arrow

    schema = arrow_schema("doc_id long, fingerprint string")
    run = lambda b: record_batch(schema, b.column(0), [to_string(chunk_set(t)) for t in b.column(1).to_pylist()])
    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run, "doc_id long, fingerprint string")
