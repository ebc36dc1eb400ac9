"""Token ids in files: each document is one Zstandard frame under a dictionary trained on serialised id arrays.

Format. A folder of Parquet files whose rows are blocks: part and block number, the first and last document id, the
dictionary's hash, an index (ids, ends of frames in the payload, counts of token ids) and the payload, the documents'
frames one after another. Parts are ranges of document ids in ascending order, blocks follow one another in a part. The
dictionaries are a table ``dictionary`` beside it, keyed by hash. To read one short document, its block's row is found by
the id range (a pushed-down filter) and one frame is decompressed. Ids are little-endian unsigned 16-bit integers if all
of the vocabulary's are below 65,536, else 32-bit; the dictionary's row says which.

The dictionary is trained on a bounded sample (``sample_docs`` documents picked by a hash of their id, of each the ``sample_bytes``
from a place the hash picks): it only affects the size. All documents are encoded and written whole. A null text is an empty one;
each document ends with ``end_id``. Documents without an id come first. Rows that share an id stay in the order of their
hash, each with its own frame; a part is a range of (id, hash), so an id that many rows share is dealt to many parts. An empty
table gives no blocks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import arrow_schema, map_arrow, record_batch, release, spread_join, tune
from spanloom.llm.ranges import range_parts
from spanloom.llm.tokens import encoder, id_bytes, packed
from spanloom.sources.scratch import new_path

BLOCK = "part long, block int, first_id long, last_id long, dict_hash string, ids array<long>, ends array<long>, counts array<long>, n_ids long, payload binary"


def train_dictionary(docs: DataFrame, path: str, end_id: int, sample_docs: int = 1000, sample_bytes: int = 4096, size: int = 65_536) -> bytes:
    """At most ``size`` bytes; empty if there is too little to train on."""
    import zstandard

    n, width = docs.count(), id_bytes(path, end_id)
    h = F.xxhash64("doc_id", F.lit("sample"))
    few = docs.where(F.pmod(h, F.lit(1 << 40)) <= int(min(1.0, 1.5 * sample_docs / max(n, 1)) * (1 << 40)))  # else each task would send its smallest
    spot = F.pmod(F.xxhash64("doc_id", F.lit("spot")), F.greatest(F.length("text") - sample_bytes, F.lit(1))).cast("int")
    some = few.where("text <> ''").select(F.substring("text", spot + 1, F.lit(sample_bytes)).alias("text"), h.alias("h"))
    rows = some.orderBy("h", "text").limit(sample_docs).collect()
    samples = [packed(x, end_id, width) for x in encoder(path).encode([r[0] for r in rows])]
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples).as_bytes()
    except (zstandard.ZstdError, ValueError, ZeroDivisionError):
        return b""


def write_ids(docs: DataFrame, out: str, path: str, end_id: int, block_bytes: int = 1 << 20, part_docs: int = 2000, level: int = 3) -> None:
    """Encodes ``text`` of every row of ``docs`` (doc_id, text) and writes the files to the folder ``out``."""
    import zstandard

    spark = docs.sparkSession
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    tune(spark)
    raw = train_dictionary(docs, path, end_id)
    width = id_bytes(path, end_id)
    wide = width == 4
    name = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(name, wide, bytearray(raw))], "dict_hash string, wide boolean, dictionary binary").coalesce(1).write.parquet(f"{out}/dictionary")
    frame = arrow_schema("doc_id long, h long, n long, frame binary")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        for b in batches:
            ids = encoder(path).encode(b.column(2).to_pylist())
            yield record_batch(frame, b.column(0), b.column(1), [len(x) // 4 + 1 for x in ids], [z.compress(packed(x, end_id, width)) for x in ids])

    block = arrow_schema(BLOCK)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, ids, counts, frames, size = None, 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            ends = np.cumsum([len(f) for f in frames])
            return record_batch(block, [part], [number], [ids[0]], [ids[-1]], [name], [ids], [ends.tolist()], [counts], [sum(counts)], [b"".join(frames)])

        for b in batches:
            for p, i, n, f in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if frames and (p != part or size + len(f) > block_bytes):
                    yield flush()
                    number, ids, counts, frames, size = (number + 1 if p == part else 0), [], [], [], 0
                elif not frames:
                    number = 0
                part, size = p, size + len(f)
                ids.append(i)
                counts.append(n)
                frames.append(f)
        if frames:
            yield flush()

    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    parts = range_parts(keyed.select("doc_id", "h"), part_docs)
    frames = keyed.mapInArrow(encode, "doc_id long, h long, n long, frame binary")
    dealt = parts.add(frames).repartition(max(1, min(parts.count, int(spark.conf.get("spark.sql.shuffle.partitions")))), "part")
    dealt.sortWithinPartitions("part", "doc_id", "h").select("part", "doc_id", "n", "frame").mapInArrow(gather, BLOCK).write.option("parquet.block.size", 16 << 20).parquet(f"{out}/blocks")


class Reader:
    """Reads the folder again. ``documents``: a row for each document with its ids; ``one``: the ids of a single document."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark = spark
        self.blocks = spark.read.parquet(f"{out}/blocks")
        self.dictionaries = {r.dict_hash: (r.wide, bytes(r.dictionary)) for r in spark.read.parquet(f"{out}/dictionary").collect()}  # one for each writing

    def _opener(self):
        held = self.dictionaries

        def open_frames(name: str, ends: list[int], payload: bytes) -> Iterator[np.ndarray]:
            import zstandard

            wide, raw = held[name]
            if hashlib.sha256(raw).hexdigest() != name:
                raise ValueError("the dictionary is not the one that the block names")
            z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
            start = 0
            for end in ends:
                yield np.frombuffer(z.decompress(payload[start:end]), "<u4" if wide else "<u2").astype("<u4")
                start = end

        return open_frames

    def map_documents(self, fn, ddl: str) -> DataFrame:
        """``fn(ids as little-endian u32 array)`` gives the values of ``ddl``; returned with part, block, nth, doc_id, rel_start, n_tokens."""
        full = f"part long, block int, nth int, doc_id long, rel_start long, n_tokens long, {ddl}"
        schema, opener = arrow_schema(full), self._opener()

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for part, number, name, ids, ends, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = 0
                for k, (i, a) in enumerate(zip(ids, opener(name, ends, payload), strict=True)):
                    rows.append((part, number, k, i, at, len(a), *fn(a)))
                    at += len(a)
            return record_batch(schema, *zip(*rows, strict=True)) if rows else None

        return map_arrow(self.blocks.select("part", "block", "dict_hash", "ids", "ends", "payload"), run, full)

    def starts(self) -> DataFrame:
        """part, block, base: token ids in all blocks before. Blocks are added up within their part, then parts."""
        sizes = self.blocks.select("part", "block", "n_ids")
        per_part = sizes.groupBy("part").agg(F.sum("n_ids").alias("s"))
        before = per_part.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("part_base"))
        inner = sizes.select("part", "block", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")).alias("b"))
        return inner.join(before, "part").select("part", "block", (F.col("b") + F.col("part_base")).alias("base"))

    def one(self, doc_id: int) -> list[list[int]]:
        """The ids of each document with that id; only its block is read and only its frames are decompressed."""
        opener = self._opener()
        found = []
        for r in self.blocks.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).orderBy("part", "block").toLocalIterator():
            for k, i in enumerate(r.ids):
                if i == doc_id:
                    start = r.ends[k - 1] if k else 0
                    found += [a.tolist() for a in opener(r.dict_hash, [r.ends[k] - start], bytes(r.payload)[start : r.ends[k]])]
        return found


def id_digests(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Writes the ids of ``docs`` to files in the shared folder and returns, from the files, doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    out = new_path(spark, "ids")
    write_ids(docs, out, path, end_id)
    release(spark)
    reader = Reader(spark, out)
    rows = reader.map_documents(lambda a: (zlib.crc32(a.tobytes()),), "ids_crc32 long")
    return spread_join(rows, reader.starts(), ["part", "block"]).select("doc_id", (F.col("base") + F.col("rel_start")).alias("start"), "n_tokens", "ids_crc32")
