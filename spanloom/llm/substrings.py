"""Substring deduplication by relative Lempel-Ziv parsing: documents are factored greedily against indexed reference blocks.

Every document is a reference for those with larger ids. Each window of ``window`` words has an anchor, the leftmost of
its runs of ``gram`` words with the least hash; successive windows with one anchor form a block. Equal windows have equal
anchors, wherever they stand, so blocks are cut the same way in any document (on the average one in 21 windows begins a
block). The index maps a block's hash to its reference: the first document that holds it, and where.

1. Anchors that occur in one document only can't be part of a repeated window; their blocks go no further.
2. Seeds: a block that an earlier document holds is looked up in the index and names its reference document and place there.
3. Ends of factors: what differs in a block's context, at the edge of a copy or near an edit, leaves blocks that no
   earlier document holds as a whole although some of their windows are in one. Of the blocks with such an anchor, the
   first holder's are looked up window by window, each window naming its own first holder and place.
4. Parse: from left to right, a factor takes the next seed and is extended greedily over all that follows it in the document, block by
   block and then window by window, for as long as what follows names the same reference and the place next in it. A factor is (start, length,
   reference document, reference start). All are ``window`` words or longer, which makes them duplicate spans. As a seed names its first holder
   only, a factor also ends where that is another document, although its own reference may go on; the words covered are the same.

Each window that an earlier document holds is in one seed, so the factors cover exactly the words under such windows, also where two
factors meet within a window. Hot passages are summed up by block before anything is joined, and no two documents are ever paired. Hashes are of 64 bits, anchors and blocks or windows are compared
together (128 bits).

Null text: no words. Documents without an id keep all words and are no reference. Rows that share an id are no reference
for each other; rows equal in id and text are parsed as one. Fewer than ``window`` words: nothing to remove. Other columns stay, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Rolling, arrow_schema, as_bytes, beside, fresh, hash_words, map_arrow, mix64, record_batch, release, row_key, spread_join, table, tune, word_hashes

WINDOW, GRAM = 50, 10
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def blocks_of(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """anchor, block, first window and number of windows of each block; the anchors' positions; the hash of each window."""
    n = len(hashes) - window + 1
    if n <= 0:
        e = np.zeros(0, np.int64)
        return e, e, e, e, e, e
    r = Rolling(hashes)
    g = r.windows(gram)
    at = np.arange(len(g))

    def less(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.where(g[j] < g[i], j, i)

    span, k = window - gram + 1, 1
    while 2 * k <= span:  # at[i]: the least of k grams from i on
        at = less(at[:-k], at[k:])
        k *= 2
    if k < span:
        at = less(at[: n], at[span - k : span - k + n])
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    count = np.diff(np.r_[first, n])
    anchor = at[first]
    block = r.ranges(first, first + count + window - 1)
    block = mix64(block ^ ((anchor - first).astype(np.uint64) << np.uint64(32)) ^ count.astype(np.uint64))
    return g[anchor].view(np.int64), block.view(np.int64), first, count, anchor, r.windows(window).view(np.int64)


def covered(n: int, start: list[int], length: list[int]) -> np.ndarray:
    """Words under any of the spans."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, np.asarray(start, np.int64), 1)
    np.add.at(d, np.asarray(start, np.int64) + np.asarray(length, np.int64), -1)
    return np.cumsum(d[:n]) > 0


def parse(first: np.ndarray, count: np.ndarray, ref: np.ndarray, ref_first: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Seeds of one document (runs of ``count`` windows from ``first``, found in ``ref`` from ``ref_first``) to factors: start, length, reference, its start.

    Seeds don't overlap. A factor goes on with the next seed if that follows at once, in the document and in the reference.
    """
    order = np.argsort(first, kind="stable")
    first, count, ref, ref_first = (x[order] for x in (first, count, ref, ref_first))
    end = first + count
    goes_on = (first[1:] == end[:-1]) & (ref[1:] == ref[:-1]) & (ref_first[1:] == (ref_first + count)[:-1])
    begins = np.flatnonzero(np.r_[True, ~goes_on])
    ends = np.r_[begins[1:], len(first)] - 1
    return first[begins], end[ends] - first[begins] + window - 1, ref[begins], ref_first[begins]


def _seeds(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, row, first, count, ref, ref_first: runs of windows that an earlier document holds, and where its first holder has them."""
    spark = docs.sparkSession
    ddl = "anchor long, block long, doc_id long, row int, first int, count int"
    schema = arrow_schema(ddl)

    def cut(batches):
        known = word_hashes()
        for b in batches:
            parts = []
            for doc_id, row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), strict=True):
                words = text.split()
                if len(words) >= window:
                    a, k, f, c, _, _ = blocks_of(hash_words(words, known), window, gram)
                    parts.append((a, k, np.full(len(a), doc_id), np.full(len(a), row), f, c))
            if parts:
                yield record_batch(schema, *(np.concatenate(x) for x in zip(*parts, strict=True)))

    keyed = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").select("doc_id", row_key().alias("row"), "text").where("doc_id is not null and text is not null")
    tune(spark)
    blocks = table(keyed.mapInArrow(cut, ddl), "blocks")
    repeated = blocks.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("anchor")
    shared = table(spread_join(blocks, repeated, ["anchor"]), "shared-blocks")
    release(spark)

    place = F.min(F.struct("doc_id", "row", "first")).alias("p")
    index = table(shared.groupBy("anchor", "block").agg(place, F.max("doc_id").alias("most")).select("anchor", "block", F.col("p.doc_id").alias("ref"), F.col("p.first").alias("ref_first"), "most"), "index")
    seeds = spread_join(shared, index.where("ref < most"), ["anchor", "block"]).where("doc_id > ref").select("doc_id", "row", "first", "count", "ref", "ref_first")
    contested = index.groupBy("anchor").agg(F.min("ref").alias("least"), F.max("ref").alias("most")).where("least < most").select("anchor")
    edges = spread_join(index.select("anchor", "block", "ref"), contested, ["anchor"])
    edges = spread_join(shared, edges, ["anchor", "block"]).where("doc_id = ref").select("doc_id", "row", "anchor", "first", "count")
    listed = edges.groupBy("doc_id", "row").agg(F.collect_set(F.struct("anchor", "first", "count")).alias("at"))
    wddl = "anchor long, hash long, doc_id long, row int, first int"
    wschema = arrow_schema(wddl)

    def windows(batches):
        known = word_hashes()
        for b in batches:
            parts = []
            for doc_id, row, text, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), b.column(3).to_pylist(), strict=True):
                h = Rolling(hash_words(text.split(), known)).windows(window).view(np.int64)
                count = np.array([x["count"] for x in at])
                first = np.repeat([x["first"] for x in at], count) + np.concatenate([np.arange(c) for c in count])
                parts.append((np.repeat([x["anchor"] for x in at], count), h[first], np.full(len(first), doc_id), np.full(len(first), row), first))
            if parts:
                yield record_batch(wschema, *(np.concatenate(x) for x in zip(*parts, strict=True)))

    judged = table(keyed.join(listed, ["doc_id", "row"]).mapInArrow(windows, wddl), "windows")
    known = judged.groupBy("anchor", "hash").agg(place, F.max("doc_id").alias("most")).where("p.doc_id < most").select("anchor", "hash", F.col("p.doc_id").alias("ref"), F.col("p.first").alias("ref_first"))
    ends = spread_join(judged, known, ["anchor", "hash"]).where("doc_id > ref").select("doc_id", "row", "first", F.lit(1).alias("count"), "ref", "ref_first")
    return seeds.union(ends)


def factors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, row, starts, lengths, refs, ref_starts (in words): the factors of each document that has any, in ascending order."""
    ddl = "doc_id long, row int, starts array<int>, lengths array<int>, refs array<long>, ref_starts array<int>"
    schema = arrow_schema(ddl)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, row, *seeds in zip(*(c.to_pylist() for c in b.columns), strict=True):
            found = parse(*(np.array(x, np.int64) for x in seeds), window)
            rows.append((doc_id, row, *(x.tolist() for x in found)))
        return record_batch(schema, *zip(*rows, strict=True))

    seeds = _seeds(docs, window, gram).groupBy("doc_id", "row").agg(F.collect_set(F.struct("first", "count", "ref", "ref_first")).alias("s"))
    out = table(map_arrow(seeds.select("doc_id", "row", *[f"s.{c}" for c in ("first", "count", "ref", "ref_first")]), run, ddl), "factors")
    release(docs.sparkSession)
    return out


def _with_spans(docs: DataFrame, window: int, gram: int) -> tuple[DataFrame, str, str]:
    """``docs`` with the starts and lengths of duplicate spans, null for none, and the names of these two columns."""
    start, length = fresh(docs, "starts"), fresh(docs, "lengths")
    keys = {"doc_id": F.col("doc_id").cast("long"), "row": row_key()}
    return beside(docs, factors(docs, window, gram), keys, values={"starts": start, "lengths": length}), start, length


def removal_digests(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space)."""
    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    schema = arrow_schema(ddl)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc_id, text, first, count in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            words = (text or b"").split()
            gone = covered(len(words), first, count) if first else np.zeros(len(words), bool)
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if first else words
            out.append((doc_id, len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
        return record_batch(schema, *zip(*out, strict=True))

    joined, start, length = _with_spans(docs.select("doc_id", "text"), window, gram)
    return map_arrow(joined.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), start, length), run, ddl)


def remove_spans(text: bytes, start: list[int], length: list[int]) -> bytes:
    """The text without the covered words and the white space before each of them."""
    spots = [m.span() for m in _WORD.finditer(text)]
    gone = covered(len(spots), start, length)
    out, at = [], 0
    for (begin, end), g in zip(spots, gone.tolist(), strict=True):
        if not g:
            out.append(text[at:end])
        at = end
    out.append(text[at:])
    return b"".join(out).strip(b" \t\n\x0b\x0c\r")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; other columns stay. Documents of which nothing is left go."""
    names = docs.columns
    joined, start, length = _with_spans(docs, window, gram)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series([remove_spans(t.encode(), list(s), list(n)).decode() for t, s, n in zip(texts, starts, lengths, strict=True)])

    some = joined.where(F.col(start).isNotNull()).withColumn("text", cut("text", start, length)).where("text <> ''")
    return joined.where(F.col(start).isNull()).select(*names).union(some.select(*names))
