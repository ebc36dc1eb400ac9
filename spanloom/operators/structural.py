"""Structural operators between two marked sets of spans.

Input is one relation of marks: trace_id, span_id, parent_span_id, a, b (in the left set, in the right set); spans in
neither are absent, except for descent, which needs every span of a trace to walk along. Output is the right-hand spans
that stand in the relation to some left-hand span of their trace: trace_id, span_id, parent_span_id.

Child, parent and sibling need no join of spans with spans: both sides are keyed by the id they must share, and one
aggregation with partial sums tells which keys both sides reach.

Descent and ascent take the spans of the traces that have both sides, with the traces' sizes, which the caller has written
down already: so the plans are made without running anything twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.sources.scratch import kept

#: Traces of up to this many spans are walked within one row; larger ones by pointer doubling, a join for each doubling.
WALK_LIMIT = 64


def _keyed(marks: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """Keys (trace_id, id) that an ``a`` span has as ``a_key`` and a ``b`` span as ``b_key``."""
    ends = F.array(F.struct(F.col(a_key).alias("id"), F.col("a").alias("a"), F.lit(False).alias("b")), F.struct(F.col(b_key).alias("id"), F.lit(False).alias("a"), F.col("b").alias("b")))
    rows = marks.select("trace_id", F.explode(ends).alias("e")).select("trace_id", "e.*").where("(a or b) and id <> ''")
    return rows.groupBy("trace_id", "id").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b")).where("a and b").select("trace_id", "id")


def _right(marks: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    return marks.where("b").join(keys.withColumnRenamed("id", column), ["trace_id", column], "left_semi").select("trace_id", "span_id", "parent_span_id")


def child(marks: DataFrame) -> DataFrame:
    """b whose parent is an a."""
    return _right(marks, _keyed(marks, "span_id", "parent_span_id"), "parent_span_id")


def parent(marks: DataFrame) -> DataFrame:
    """b that is the parent of an a."""
    return _right(marks, _keyed(marks, "parent_span_id", "span_id"), "span_id")


def sibling(marks: DataFrame) -> DataFrame:
    """b that shares its parent with another span that is an a."""
    least, most = F.min(F.when(F.col("a"), F.col("span_id"))), F.max(F.when(F.col("a"), F.col("span_id")))
    groups = marks.where("parent_span_id <> ''").groupBy("trace_id", "parent_span_id").agg(least.alias("lo"), most.alias("hi"), F.bool_or("b").alias("any_b")).where("lo is not null and any_b")
    return marks.where("b").join(groups.drop("any_b"), ["trace_id", "parent_span_id"]).where("lo <> span_id or hi <> span_id").select("trace_id", "span_id", "parent_span_id")


def candidates(marks: DataFrame) -> DataFrame:
    """Traces with both an a and a b, and how many spans ``marks`` has of them."""
    return marks.groupBy("trace_id").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"), F.count("*").alias("n")).where("a and b").select("trace_id", "n")


def descent(marks: DataFrame, sizes: DataFrame, walk_limit: int = WALK_LIMIT) -> DataFrame:
    """b strictly below an a at any depth. ``marks`` holds all spans of the traces in ``sizes`` (trace_id, n), a written table; cycles
    and repeated ids are harmless."""
    return _related(marks, sizes, walk_limit, "parent_span_id", "span_id")


def ascent(marks: DataFrame, sizes: DataFrame, walk_limit: int = WALK_LIMIT) -> DataFrame:
    """b strictly above an a: the same with the ends of each step exchanged."""
    return _related(marks, sizes, walk_limit, "span_id", "parent_span_id")


def _related(marks: DataFrame, sizes: DataFrame, walk_limit: int, start: str, end: str) -> DataFrame:
    big = sizes.where(F.col("n") > walk_limit).select("trace_id")
    any_big = bool(big.limit(1).count())
    small = sizes.where(F.col("n") <= walk_limit).select("trace_id") if any_big else sizes.select("trace_id")
    near = _walked(marks.join(small, "trace_id", "left_semi"), start, end)
    return near.unionByName(_doubled(marks.join(big, "trace_id", "left_semi"), start, end)) if any_big else near


def _walked(marks: DataFrame, start: str, end: str) -> DataFrame:
    """The spans of a trace in one array, walked step by step from all a at once until no new span is met."""
    rows = marks.groupBy("trace_id").agg(F.collect_list(F.struct("span_id", "parent_span_id", "a", "b")).alias("s"))
    first = F.transform(F.filter("s", lambda x: x["a"]), lambda x: x["span_id"])
    state = F.struct(first.alias("front"), F.array().cast("array<string>").alias("seen"))

    def step(acc: Column, _: Column) -> Column:
        # Down, a span is reached if its parent is in front; up, the parents of those in front are, if they are in the trace or not.
        met = F.transform(F.filter(F.col("s"), lambda x: F.array_contains(acc["front"], x[start])), lambda x: x[end])
        further = F.struct(F.array_except(met, acc["seen"]).alias("front"), F.array_union(acc["seen"], met).alias("seen"))
        return F.when(F.array_size(acc["front"]) == 0, acc).otherwise(further)

    seen = F.aggregate(F.sequence(F.lit(1), F.array_size("s")), state, step, lambda acc: acc["seen"])
    hits = rows.withColumn("seen", seen).select("trace_id", F.explode(F.expr("filter(s, x -> x.b and array_contains(seen, x.span_id))")).alias("x"))
    return hits.select("trace_id", "x.span_id", "x.parent_span_id")


def _doubled(marks: DataFrame, start: str, end: str) -> DataFrame:
    """Pointers from each span to an ancestor, twice as far each round; what is reached within that distance is doubled with them.

    Rounds are written to the shared folder, so plans stay short. They end when all pointers have left the trace, at the
    latest after log2 of the largest trace's size, which also ends cycles.
    """
    steps = marks.select("trace_id", "span_id", "parent_span_id")
    inside = marks.select("trace_id", F.col("span_id").alias("parent_span_id")).distinct()
    pointers = kept(steps.join(inside, ["trace_id", "parent_span_id"], "left_semi").select("trace_id", "span_id", "parent_span_id").distinct(), "pointers")
    origin = marks.where("a").select("trace_id", F.col("span_id").alias("at"))

    def step(met: DataFrame) -> DataFrame:
        return pointers.withColumnRenamed(start, "at").join(met, ["trace_id", "at"], "left_semi").select("trace_id", F.col(end).alias("at"))

    met = kept(step(origin).distinct(), "met")  # within one step
    most = marks.groupBy("trace_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    for _ in range(most.bit_length()):
        met = kept(met.union(step(met)).distinct(), "met")
        far = pointers.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("parent_span_id").alias("far"))
        pointers = kept(pointers.join(far, ["trace_id", "parent_span_id"]).select("trace_id", "span_id", F.col("far").alias("parent_span_id")).distinct(), "pointers")
        if not pointers.limit(1).count():
            break
    return marks.where("b").join(met.withColumnRenamed("at", "span_id"), ["trace_id", "span_id"], "left_semi").select("trace_id", "span_id", "parent_span_id")


def traces(op: str, marks: DataFrame) -> DataFrame:
    """trace_id (perhaps repeated) of the traces in which the relation holds, by one aggregation; for the relations of one step."""
    if op != "~":
        return (_keyed(marks, "span_id", "parent_span_id") if op == ">" else _keyed(marks, "parent_span_id", "span_id")).select("trace_id")
    ends = [f(F.when(F.col(x), F.col("span_id"))).alias(n) for f, x, n in ((F.min, "a", "al"), (F.max, "a", "ah"), (F.min, "b", "bl"), (F.max, "b", "bh"))]
    groups = marks.where("parent_span_id <> ''").groupBy("trace_id", "parent_span_id").agg(*ends)
    return groups.where("al is not null and bl is not null and not (al = ah and bl = bh and al = bl)").select("trace_id")


RELATIONS = {">": child, "<": parent, "~": sibling, ">>": descent, "<<": ascent}
