"""Ranges of (document id, hash of the text) with about as many rows each, found without a sort.

Bounds come from a bounded sample of the ids, picked by a hash: they only affect how even the parts are. An id that many rows
share, or none (null, which is least), is cut into several parts by the hash, so no part holds all its rows.
"""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most parts; what the driver gets and the plan holds is bounded by it. Of 100 TB, a part is 1.5 GB.
MOST_PARTS = 1 << 16
_SAMPLED, _GROUP = 30, 256


@dataclass(frozen=True)
class Parts:
    """The first ``nulls`` parts hold the rows without an id; then part k holds the ids from ``firsts[k]`` on. An id that is in ``firsts``
    several times has as many parts."""

    nulls: int
    firsts: tuple[int, ...]

    @property
    def count(self) -> int:
        return max(1, self.nulls + len(self.firsts))

    def of(self, key: Column, h: Column) -> Column:
        """The part of an id and a hash, in JVM code: the group of bounds, then the bound in the group."""
        share = lambda n: F.least(F.floor((h.cast("double") / float(1 << 64) + 0.5) * n), n - 1)
        at = F.lit(0).cast("long")
        if len(self.firsts) > 1:
            groups = [list(self.firsts[i : i + _GROUP]) for i in range(0, len(self.firsts), _GROUP)]
            heads = F.from_json(F.lit(json.dumps([g[0] for g in groups])), "array<bigint>")
            inner = F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>")
            below = lambda bounds: F.greatest(F.array_size(F.filter(bounds, lambda x: x <= key)) - 1, F.lit(0))
            group = below(heads)
            at = (group * _GROUP + below(F.element_at(inner, group + 1))).cast("long")
            hot = {k: n for k, n in Counter(self.firsts).items() if n > 1}
            if hot:
                copies = F.coalesce(F.element_at(F.from_json(F.lit(json.dumps({str(k): n for k, n in hot.items()})), "map<string,bigint>"), key.cast("string")), F.lit(1))
                at = at - copies + 1 + share(copies)
        return F.when(key.isNull(), share(F.lit(self.nulls)) if self.nulls else F.lit(0)).otherwise(self.nulls + at).cast("long")

    def add(self, df: DataFrame) -> DataFrame:
        """``df`` (doc_id, h) with its part."""
        return df.withColumn("part", self.of(F.col("doc_id"), F.col("h")))


def range_parts(keys: DataFrame, rows_each: int) -> Parts:
    """Bounds for ``keys`` (doc_id, h); each is an id that occurs, so that parts are seldom empty."""
    n, none = keys.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    k = max(1, min(MOST_PARTS, -(-(n - none) // rows_each)))
    nulls = min(MOST_PARTS, -(-none // rows_each))
    if n == none or k == 1:
        least = keys.agg(F.min("doc_id")).first()[0]
        return Parts(nulls, () if least is None else (least,))
    share = int(min(1.0, _SAMPLED * k / (n - none)) * (1 << 40))
    some = keys.where("doc_id is not null").where(F.pmod(F.xxhash64("doc_id", "h", F.lit("bounds")), F.lit(1 << 40)) < share)
    ids = np.sort(some.select("doc_id").toArrow().column(0).to_numpy())  # about _SAMPLED for each part
    if not len(ids):
        return Parts(nulls, (keys.agg(F.min("doc_id")).first()[0],))
    return Parts(nulls, tuple(ids[(np.arange(k) * len(ids)) // k].tolist()))
