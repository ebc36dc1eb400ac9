"""What the training-data operators share: tables in the shared folder, joins that survive hot keys, Arrow batches, hashing.

Nothing here keeps state that grows with the data on the driver. Intermediate results are written as Parquet below
``spark.checkpoint.dir`` (a folder that driver and executors share), so a lost executor costs only its running tasks.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.sources.scratch import dropped
from spanloom.sources.scratch import kept as table

_MASK64 = (1 << 64) - 1


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tune(spark: SparkSession) -> None:
    """Arrow batches stay small even if all their texts are long; set for the session, as plans read it when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which both sides are dealt out just before it, so that adaptive execution can split a hot key.

    ``right`` is often an aggregate by the same keys; joined directly, its partitioning would be kept and the rows of a
    hot key would meet in one task. The extra key, a hash of the others, makes Spark deal both sides anew.
    """
    mixed = lambda df: df.withColumn("_mix", F.xxhash64(*keys))
    return mixed(left).join(mixed(right), [*keys, "_mix"], how).drop("_mix")


def fresh(docs: DataFrame, name: str) -> str:
    """A name that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def beside(docs: DataFrame, other: DataFrame, keys: dict[str, F.Column], how: str = "left", values: dict[str, str] | None = None) -> DataFrame:
    """``docs`` joined with ``other`` by ``keys`` (column of ``other`` to expression over ``docs``; nulls are equal).

    ``values`` are columns that ``other`` adds: its name for each and the name in the result, which ``docs`` mustn't have. The columns
    of ``docs`` may have any names, even those of ``other``: inside, they lie in one struct. Both sides are dealt out just
    before the join, so a hot key can be split.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), *[e.alias(f"k_{k}") for k, e in keys.items()])
    mix = F.xxhash64(*[F.col(f"k_{k}") for k in keys]).alias("k_mix")
    left = whole.select("*", mix)
    right = other.select(*[F.col(k).alias(f"k_{k}") for k in keys], *[F.col(c).alias(f"v_{c}") for c in values or {}]).select("*", mix)
    left, right = left.alias("l"), right.alias("r")
    on = F.col("l.k_mix") == F.col("r.k_mix")
    for k in keys:
        on = on & F.col(f"l.k_{k}").eqNullSafe(F.col(f"r.k_{k}"))
    joined = left.join(right, on, how)
    back = [F.col("d").getField(c).alias(c) for c in docs.columns]
    return joined.select(*back, *[F.col(f"v_{c}").alias(name) for c, name in (values or {}).items()])


def row_key(text: str = "text") -> F.Column:
    """Tells apart rows that share a document id; rows equal in id and text get equal answers."""
    return F.hash(F.col(text))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` for each Arrow batch; ``schema`` as DDL."""
    tune(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """Texts as UTF-8."""
    return column.cast(pa.binary()).to_pylist()


class Bounded(dict):
    """A cache that starts anew when it is full; ``make`` computes what is missing."""

    def __init__(self, make: Callable, size: int):
        super().__init__()
        self.make, self.size = make, size

    def __missing__(self, key):
        if len(self) >= self.size:
            self.clear()
        self[key] = value = self.make(key)
        return value


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (multiply and shift)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes modulo 2**64 of any ranges of a sequence of 64-bit word hashes, from one cumulative sum."""

    BASE = 0x9E3779B97F4A7C15 | 1
    _pow = np.ones(1, np.uint64)
    _inv = np.ones(1, np.uint64)

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        if len(Rolling._pow) <= n:
            size = 1 << (n + 1).bit_length()
            for name, base in (("_pow", self.BASE), ("_inv", pow(self.BASE, -1, 1 << 64))):
                a = np.full(size, base & _MASK64, np.uint64)
                a[0] = 1
                setattr(Rolling, name, np.multiply.accumulate(a))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * Rolling._pow[:n], out=self.sums[1:])

    def windows(self, width: int) -> np.ndarray:
        """The hash of each run of ``width`` words."""
        d = self.sums[width:] - self.sums[:-width]
        return mix64(d * Rolling._inv[: len(d)])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * Rolling._inv[start] + (end - start).astype(np.uint64))


def word_hashes() -> Bounded:
    import xxhash

    return Bounded(xxhash.xxh64_intdigest, 400_000)


def hash_words(words: list[bytes], cache: Bounded) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
