"""Quality classifier with hierarchical empirical Bayes over sites.

Evidence of the document: naive Bayes over hashed words and word shapes (letters, capitals, digits and other signs in runs),
averaged over the words of the text, brought to log odds by a logistic fit on held-out halves. Sites: a host has paths, and
each path many documents. The documents' probabilities are added up by path and by host (grouped aggregation); the share of
good documents of all is the prior, hosts are shrunk toward it and paths toward their host. How strongly follows from the
spread between sites beyond what their sizes explain (method of moments), so a site with few documents hardly moves and a
large one speaks for itself. A document's own share is taken out of its path before its posterior is used.

Fit on a bounded sample: the ``max_labelled`` labelled documents with the smallest hash of their id (of texts that share an id, the least). Everything else, the
posteriors and the decision, covers all documents. Without labels of both kinds evidence is 0 and all are kept.

Null text: no words, evidence from the intercept. Null host or path: a site of its own. Rows that share an id count each;
a label that is given twice is averaged. An empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Bounded, arrow_schema, as_bytes, map_arrow, record_batch, spread_join, table

BUCKETS = 1 << 16
_RUNS = ((re.compile(rb"[a-z]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"[\x80-\xff]+"), b"a"), (re.compile(rb"aa+"), b"a"))


def word_buckets() -> Bounded:
    """Word to the buckets of itself and of its shape."""
    import xxhash

    def make(word: bytes) -> tuple[int, int]:
        shape = word
        for pattern, sign in _RUNS:
            shape = pattern.sub(sign, shape)
        return xxhash.xxh64_intdigest(word, 7) % BUCKETS, xxhash.xxh64_intdigest(shape[:16], 8) % BUCKETS

    return Bounded(make, 300_000)


def _counts(labelled: DataFrame) -> np.ndarray:
    """[fold, label, bucket]: how often each bucket is met; at most 4 * BUCKETS numbers come to the driver."""
    ddl = "fold int, label int, bucket int, n long"
    schema = arrow_schema(ddl)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        cache = word_buckets()
        out = np.zeros((4, BUCKETS), np.int64)
        for fold, label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), strict=True):
            at = np.array([x for w in (text or b"").split() for x in cache[w]], np.int64)
            if len(at):
                out[2 * fold + label] += np.bincount(at, minlength=BUCKETS)
        k, bucket = np.nonzero(out)
        return record_batch(schema, k // 2, k % 2, bucket, out[k, bucket])

    rows = map_arrow(labelled.select("fold", "label", "text"), run, ddl).groupBy("fold", "label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((2, 2, BUCKETS))
    out[rows.fold, rows.label, rows.bucket] = rows.n
    return out


def _weights(counts: np.ndarray) -> np.ndarray:
    """Log ratio of each bucket's smoothed shares, good over bad."""
    share = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)
    return np.log(share[1] / share[0])


def scores(docs: DataFrame, weights: list[np.ndarray], keep: list[str]) -> DataFrame:
    """``keep`` and score: the mean weight of the text's words; ``weights`` by fold (column fold, where there are two)."""
    fields = ", ".join(f"{c} {t}" for c, t in docs.select(*keep).dtypes)
    ddl = f"{fields}, score double"
    schema = arrow_schema(ddl)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        cache = word_buckets()
        out = []
        for fold, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
            at = [x for w in (text or b"").split() for x in cache[w]]
            out.append(float(weights[fold][at].mean()) if at else 0.0)
        return record_batch(schema, *b.columns[2:], out)

    fold = F.col("fold") if len(weights) > 1 else F.lit(0)
    return map_arrow(docs.select(fold.alias("_fold"), F.col("text").cast("string").alias("_text"), *keep), run, ddl)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps, lightly held back."""
    w, design = np.zeros(2), np.c_[x, np.ones_like(x)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        h = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(h, design.T @ (y - p) - np.array([1e-3, 1e-6]) * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> tuple[np.ndarray, float, float, float]:
    """Bucket weights, slope, intercept, and the accuracy on held-out halves (nan without labels of both kinds)."""
    known = labels.selectExpr("cast(doc_id as long) _id", "cast(quality as double) q").where("_id is not null and q is not null")
    known = known.groupBy("_id").agg((F.avg("q") >= 0.5).cast("int").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    own = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    # At most max_labelled ids, and one text for each.
    labelled = own.join(F.broadcast(known), "_id").groupBy("_id", "label").agg(F.min("text").alias("text")).withColumn("fold", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(2)).cast("int"))
    labelled = table(labelled, "labelled")
    c = _counts(labelled)
    if not (c.sum(2) > 0).all():
        return np.zeros(BUCKETS), 0.0, 0.0, float("nan")
    held = scores(labelled, [_weights(c[1]), _weights(c[0])], ["label"]).toPandas()
    slope, intercept = logistic(held.score.to_numpy(), held.label.to_numpy(float))
    accuracy = float(((slope * held.score + intercept > 0) == (held.label == 1)).mean())
    return _weights(c.sum(0)), slope, intercept, accuracy


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Pseudo-documents of the prior: the spread of the groups' means about ``mean`` against what their sizes explain."""
    d = F.col("s") / F.col("n") - mean
    r = groups.agg(F.sum(F.col("n") * d * d).alias("v"), F.sum(mean * (1 - mean)).alias("e"), F.sum("n").alias("n"), F.sum(F.col("n") * mean * (1 - mean)).alias("m")).first()
    if not r.n:
        return 1.0
    between = max((r.v - r.e) / r.n, 1e-6)
    return float(min(max(r.m / r.n / between - 1, 1.0), 1e5))


def rate(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, max_labelled: int = 20_000, site_weight: float = 0.5, least: float = 0.5) -> DataFrame:
    """doc_id, host, path, evidence, host_posterior, path_posterior, quality, kept: a row for each row of ``docs``."""
    host, path = (F.col("source") if host is None else host), (F.col("lang") if path is None else path)
    weights, slope, intercept, _ = fit(docs, labels, max_labelled)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    scored = scores(named, [weights], ["doc_id", "host", "path"])
    evidence = F.col("score") * slope + intercept if slope else F.lit(0.0)
    scored = scored.withColumn("evidence", evidence).withColumn("p", 1 / (1 + F.exp(-F.col("evidence"))))
    scored = table(scored.withColumn("site", F.xxhash64(F.col("host").isNull(), "host", F.lit(0))).withColumn("place", F.xxhash64("site", F.col("path").isNull(), "path")), "scored")
    paths = table(scored.groupBy("site", "place").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = paths.groupBy("site").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    prior = total.s / total.n if total.n else 0.5
    k = _strength(hosts, F.lit(prior))
    hosts = hosts.select("site", ((F.col("s") + k * prior) / (F.col("n") + k)).alias("host_posterior"))
    paths = table(spread_join(paths, hosts, ["site"]), "path-posteriors")
    kp = _strength(paths, F.col("host_posterior"))
    j = spread_join(scored, paths.select("place", "n", "s", "host_posterior"), ["place"])
    own = (F.col("s") - F.col("p") + kp * F.col("host_posterior")) / (F.col("n") - 1 + kp)
    j = j.withColumn("path_posterior", own)
    quality = 1 / (1 + F.exp(-(F.col("evidence") + site_weight * (_logit(F.col("path_posterior")) - _logit(F.lit(prior))))))
    j = j.withColumn("quality", quality)
    return j.select("doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", "quality", (F.col("quality") >= least).alias("kept"))
