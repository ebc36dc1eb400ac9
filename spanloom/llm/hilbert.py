"""Sharding along a Hilbert curve over quantised metadata.

Each of several dimensions (here language, source and text size) is cut into 2**bits cells with about as many rows each,
in the order of its whole values. The cells' Hilbert index orders the rows; in a cell they go by a hash of id and text, then by
these themselves. The order is cut into runs of equal count (law ``rows``: counts differ by one at most). Neighbours on the
curve are neighbours in every dimension, so a shard spans a small box and a reader can skip files by min and max of each.

All of it is DataFrame code. Cells come from the counts of all values, added up in ranges of values. Rows equal in id and text are one row with a
count until the end. The rank of a row is found from counts: rows by cell and by ranges of the hash (as many as the table's
size asks for, so that a cell with a third of all rows is many small groups; the order doesn't depend on how many), added up over at
most 2**(bits * dimensions) cells. Texts are never shuffled to find the shards.

Nulls are least in their dimension; a null text has size 16. Rows that share an id are separate rows. Other columns aren't
looked at. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import beside, fresh, table


def cuts(df: DataFrame, dim: str, weight: str, bits: int) -> list:
    """The values at which cells of about equal weight begin, ascending, at most 2**bits - 1; from the counts of all values."""
    values = df.groupBy(dim).agg(F.sum(weight).alias("n"))
    values = table(values.repartitionByRange(F.col(dim).asc_nulls_first()).select(F.col(dim).alias("value"), "n", F.spark_partition_id().alias("part")), "values")
    per_part = values.groupBy("part").agg(F.sum("n").alias("s"))  # one row for each range of values
    before = per_part.select("part", (F.sum("s").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("s")).alias("base"))
    total = per_part.agg(F.sum("s")).first()[0]
    if not total:
        return []
    upto = F.sum("n").over(Window.partitionBy("part").orderBy(F.col("value").asc_nulls_first())) + F.col("base")
    middle = values.join(before, "part").select("value", (upto - F.col("n") / 2).alias("at"))
    cell = F.floor(F.col("at") * (1 << bits) / total)
    firsts = middle.where("value is not null").groupBy(cell.alias("cell")).agg(F.min("value").alias("value")).where("cell > 0")
    return sorted(r.value for r in firsts.collect())  # at most one for each cell


def quantise(df: DataFrame, dims: list[str], bits: int, weight: str) -> DataFrame:
    """Adds ``q_<dim>`` in 0 .. 2**bits - 1; nulls are 0."""
    for d in dims:
        q = sum((F.when(F.col(d) >= F.lit(b), 1).otherwise(0) for b in cuts(df, d, weight, bits)), F.lit(0))
        df = df.withColumn(f"q_{d}", F.coalesce(q, F.lit(0)).cast("int"))
    return df


def hilbert_index(coordinates: list[Column], bits: int) -> Column:
    """The index of a cell on the curve, in JVM code: undo the rotations bit by bit, then Gray decode (Skilling, 2004)."""
    state = F.array(*[c.cast("int") for c in coordinates])
    n = len(coordinates)

    def swap(s: Column, i: int, q: int) -> Column:
        """If bit q of x[i] is set, invert the bits of x[0] below it, else exchange those of x[0] and x[i]."""
        p = q - 1
        x0, xi = s[0], s[i]
        t = x0.bitwiseXOR(xi).bitwiseAND(F.lit(p))
        on = xi.bitwiseAND(F.lit(q)) != 0
        first = F.when(on, x0.bitwiseXOR(F.lit(p))).otherwise(x0.bitwiseXOR(t))
        other = F.when(on, xi).otherwise(xi.bitwiseXOR(t))
        return F.array(*[first if k == 0 else other if k == i else s[k] for k in range(n)])

    def bind(s: Column, f) -> Column:
        """One evaluation of ``s`` for all uses of it in ``f(s)``."""
        return F.transform(F.array(s), f)[0]

    def step(i: int, q: int):
        """The exchange for dimension i and bit q; for the first dimension there is only the inversion."""

        def first(s: Column) -> Column:
            x0 = F.when(s[0].bitwiseAND(F.lit(q)) != 0, s[0].bitwiseXOR(F.lit(q - 1))).otherwise(s[0])
            return F.array(x0, *[s[k] for k in range(1, n)])

        return (lambda s: swap(s, i, q)) if i else first

    for b in range(bits - 1, 0, -1):
        for i in range(n):
            state = bind(state, step(i, 1 << b))

    def gray(s: Column) -> Column:
        xs = [s[0]]
        for k in range(1, n):
            xs.append(s[k].bitwiseXOR(xs[-1]))
        t = F.lit(0)
        for b in range(bits - 1, 0, -1):
            t = F.when(xs[-1].bitwiseAND(F.lit(1 << b)) != 0, t.bitwiseXOR(F.lit((1 << b) - 1))).otherwise(t)
        return F.array(*[x.bitwiseXOR(t) for x in xs])

    def interleave(s: Column) -> Column:
        h = F.lit(0)
        for b in range(bits - 1, -1, -1):
            for k in range(n):
                h = h * 2 + F.shiftright(s[k], b).bitwiseAND(F.lit(1))
        return h

    return bind(bind(state, gray), interleave).cast("long")


def ranked(df: DataFrame, cell: str, order: list[str], weight: str, bucket_rows: int = 20_000) -> DataFrame:
    """Adds ``rank``, the weight of all rows before, by ``cell``, then a hash of ``order``, then ``order``; rows are distinct in that."""
    n = df.count()
    subs = max(1, -(-n // bucket_rows))
    df = df.withColumn("_h", F.xxhash64(*order))
    df = df.withColumn("_sub", F.least(F.floor((F.col("_h").cast("double") / float(1 << 64) + 0.5) * subs), F.lit(subs - 1)))
    counts = df.groupBy(cell, "_sub").agg(F.sum(weight).alias("_n"))
    per_cell = counts.groupBy(cell).agg(F.sum("_n").alias("_s"))
    cells = per_cell.select(cell, (F.sum("_s").over(Window.partitionBy(F.lit(0)).orderBy(cell)) - F.col("_s")).alias("_before"))  # one row for each cell
    inner = counts.select(cell, "_sub", (F.sum("_n").over(Window.partitionBy(cell).orderBy("_sub")) - F.col("_n")).alias("_in"))
    base = inner.join(cells, cell).select(cell, "_sub", (F.col("_before") + F.col("_in")).alias("_base"))
    upto = F.sum(weight).over(Window.partitionBy(cell, "_sub").orderBy("_h", *order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_at", upto).join(base, [cell, "_sub"]).withColumn("rank", F.col("_base") + F.col("_at") - F.col(weight)).drop("_h", "_sub", "_base", "_at")


def assign_shards(docs: DataFrame, shards: int = 40, bits: int = 4) -> DataFrame:
    """doc_id, row, size, text_crc32, law, shard, slot, grown_shard, curve (the Hilbert index): a row for each row of ``docs``."""
    text = F.col("text").cast("string")
    meta = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.hash("text").alias("row"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "utf-8")).alias("text_crc32"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
    )
    same = meta.columns
    meta = table(meta.groupBy(*same).agg(F.count("*").alias("copies")), "shard-meta")
    n = meta.agg(F.sum("copies")).first()[0] or 0
    dims = ["lang", "source", "size"]
    cells = quantise(meta, dims, bits, "copies")
    cells = cells.withColumn("curve", hilbert_index([F.col(f"q_{d}") for d in dims], bits))
    r = ranked(cells.select(*same, "copies", "curve"), "curve", ["doc_id", "row", "size", "text_crc32", "lang", "source"], "copies")
    # One row again for each copy, in blocks so that no array is long.
    block = 4096
    r = r.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(copies - 1) div {block}"))).alias("b"))
    nth = F.explode(F.sequence(F.col("b") * block, F.least(F.col("copies"), (F.col("b") + 1) * block) - 1))
    r = r.select("doc_id", "row", "size", "text_crc32", "curve", "rank", nth.alias("nth")).withColumn("rank", F.col("rank") + F.col("nth"))
    small, large = divmod(n, shards)  # the first ``large`` shards hold one more
    edge = large * (small + 1)
    first = F.col("rank") < edge
    shard = F.when(first, F.expr(f"rank div {small + 1}")).otherwise(F.expr(f"(rank - {edge}) div {max(1, small)}") + large)
    slot = F.when(first, F.expr(f"rank % {small + 1}")).otherwise(F.expr(f"(rank - {edge}) % {max(1, small)}"))
    return r.select("doc_id", "row", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, out: str, shards: int = 40, bits: int = 4) -> None:
    """Writes ``docs`` to ``out``/shard=N, sorted along the curve in each; rows equal in id and text go together.

    Where ``docs`` has a column ``shard``, the folders are named ``shard_``.
    """
    at = assign_shards(docs, shards, bits).groupBy("doc_id", "row").agg(F.min(F.struct("shard", "slot")).alias("at")).select("doc_id", "row", "at.shard", "at.slot")
    shard, slot = fresh(docs, "shard"), fresh(docs, "slot")
    joined = beside(docs, at, {"doc_id": F.col("doc_id").cast("long"), "row": F.hash("text")}, values={"shard": shard, "slot": slot})
    joined.repartition(shards, shard).sortWithinPartitions(shard, slot).drop(slot).write.partitionBy(shard).parquet(out)
