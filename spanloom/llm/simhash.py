"""SimHash near-duplicates through an inverted index on byte positions, with count filtering.

A fingerprint has eight positional bytes. Two fingerprints at ``bits`` = 2 differing bits or fewer differ in two bytes at
most, so at least six positional bytes are shared: the guaranteed minimum. A posting for each single byte would hold a 256th of
the table and more; but whichever six bytes a pair shares, three of them are among the first five positions. So the index
has ten postings for each fingerprint, one for each choice of three of those positions, and each pair that can reach the minimum meets in one.

In a posting's list, shared positional bytes are tallied for each pair; pairs with at least the minimum are retained and
verified by their differing bits. A list of more than ``most`` members is not tallied: it is dealt out again by one further byte, one posting for
each of three of its remaining positions, of which a pair within reach shares at least one. So it goes on until lists are short
enough or six bytes are fixed; then only two bytes are left free, at most 65,536 members differ, and each looks up the 136 values
within two bits of its own. No list costs more than its length times ``most``, and none is gathered that is too long.

Texts: ASCII letters are lower-cased, words are split at ASCII white space, shingles overlap. A null or blank text has the
fingerprint zero, which links like any other. Repeated rows and equal texts share a fingerprint. Extra columns are not
looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Rolling, arrow_schema, as_bytes, beside, dropped, hash_words, map_arrow, mix64, record_batch, release, spread_join, table, tune, word_hashes
from spanloom.llm.components import components

_FLIPS = np.array([0, *(1 << i for i in range(16)), *((1 << i) | (1 << j) for i, j in combinations(range(16), 2))], np.int64)


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The fingerprint as a signed 64-bit integer."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        h = [digest(b" ".join(words), 42)]
    else:
        h = [digest(b" ".join(t), 42) for t in zip(*(words[i:] for i in range(width)), strict=False)]
    bits = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = np.array(h[i : i + (1 << 16)], "<u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fp (long)."""
    schema = arrow_schema("doc_id long, fp long")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return record_batch(schema, b.column(0), [fingerprint(t, width) for t in as_bytes(b.column(1))])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, fp long")


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many positional bytes two fingerprints share, given the bits in which they differ."""
    return (np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8) == 0).sum(1)


def posting_keys(fp: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """A list's name: the positions that are fixed (a bit each) and the bytes there, mixed."""
    mask = np.zeros(256, np.uint64)
    for k in range(8):
        mask[(np.arange(256) >> k & 1).astype(bool)] |= np.uint64(0xFF) << np.uint64(8 * k)
    return mix64(mix64(fp.view(np.uint64) & mask[fixed]) ^ fixed.astype(np.uint64)).view(np.int64)


def first_postings(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fixed positions, fingerprint) of the ten postings of each fingerprint."""
    choices = [sum(1 << k for k in c) for c in combinations(range(5), 3)]
    return np.repeat(np.array(choices, np.int16), len(fp)), np.tile(fp, len(choices))


def further_postings(fixed: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three postings for each, with one of its first three free positions fixed as well."""
    taken, out = fixed, []
    for _ in range(3):
        lowest = ~taken & (taken + 1)
        out.append(fixed | lowest)
        taken = taken | lowest
    return np.concatenate(out).astype(np.int16), np.tile(fp, 3)


def tally(key: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a list's members that share the minimum of positional bytes and differ in ``bits`` bits or fewer; lists are whole and adjacent."""
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    end = np.repeat(starts + sizes, sizes)
    i = np.arange(len(key))
    for d in range(1, int(sizes.max(initial=1))):
        i = i[i + d < end[i]]
        x = fp[i] ^ fp[i + d]
        near = i[(shared_bytes(x) >= 8 - bits) & (x != 0)]
        near = near[np.bitwise_count((fp[near] ^ fp[near + d]).view(np.uint64)) <= bits]
        us.append(fp[near])
        vs.append(fp[near + d])
    return np.concatenate(us), np.concatenate(vs)


def look_up(fp: np.ndarray, fixed: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one long list with six positions fixed: each member to the smallest of those it reaches within the list."""
    free = [k for k in range(8) if not fixed >> k & 1]
    b = fp.view(np.uint8).reshape(-1, 8).astype(np.int64)
    rest = (b[:, free[0]] << 8) | b[:, free[1]]
    rest, first = np.unique(rest, return_index=True)
    fp = fp[first]
    flips = _FLIPS[np.array([int(x).bit_count() <= bits for x in _FLIPS])]
    at = np.full(1 << 16, -1, np.int64)
    at[rest] = np.arange(len(rest))
    a, b = [], []
    for f in flips[1:]:
        to = at[rest ^ f]
        hit = np.flatnonzero(to >= 0)
        a.append(hit)
        b.append(to[hit])
    a, b = np.concatenate(a), np.concatenate(b)
    order = np.argsort(np.argsort(fp))
    low = order.copy()
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        new = np.minimum(new, new[np.argsort(order)[new]])
        if (new == low).all():
            break
        low = new
    u, v = fp, np.sort(fp)[low]
    return u[u != v], v[u != v]


def whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of batches sorted by their first column, cut so that no run of equal values is split."""
    kept: list[np.ndarray] = []  # the last run so far, which the next batch may continue
    for b in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not len(rows[0]):
            continue
        rows = [np.concatenate(x) for x in zip(kept, rows, strict=True)] if kept else rows
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        kept = [x[cut:] for x in rows]
        if cut:
            yield [x[:cut] for x in rows]
    if kept:
        yield kept


def links(nodes: DataFrame, bits: int = 2, most: int = 2000) -> DataFrame:
    """Distinct fingerprints (fp) to edges (u, v) that connect all at ``bits`` differing bits or fewer."""
    if not 0 <= bits <= 2:
        raise ValueError("six shared bytes are guaranteed for up to 2 differing bits")
    tune(nodes.sparkSession)
    ddl, posting = "u long, v long", "key long, fixed short, fp long"
    edges, out = arrow_schema(ddl), arrow_schema(posting)

    def post(b: pa.RecordBatch) -> pa.RecordBatch:
        fixed, fp = first_postings(b.column(0).to_numpy(zero_copy_only=False).astype("<i8"))
        return record_batch(out, posting_keys(fp, fixed), fixed, fp)

    def again(b: pa.RecordBatch) -> pa.RecordBatch:
        fixed, fp = further_postings(*(c.to_numpy(zero_copy_only=False) for c in b.columns[1:]))
        return record_batch(out, posting_keys(fp, fixed), fixed, fp)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, fp in whole_lists(batches):
            yield record_batch(edges, *tally(key, fp, bits))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fixed, fp in whole_lists(batches):
            for part in np.split(np.arange(len(key)), np.flatnonzero(key[1:] != key[:-1]) + 1):
                yield record_batch(edges, *look_up(fp[part], int(fixed[part[0]]), bits))

    dealt = lambda df: df.repartition("key").sortWithinPartitions("key")
    lists = map_arrow(nodes.select("fp"), post, posting)
    found = None
    for n in (3, 4, 5, 6):
        long = table(lists.groupBy("key").count().where(F.col("count") > most).select("key"), "long-lists")
        some = long.limit(1).count() > 0
        short = spread_join(lists, long, ["key"], "left_anti") if some else lists
        pairs = dealt(short).mapInArrow(count, ddl)
        found = pairs if found is None else found.union(pairs)
        if not some:
            break
        rest = spread_join(lists, long, ["key"])
        if n == 6:
            found = found.union(dealt(rest.select("key", "fixed", "fp").distinct()).mapInArrow(reach, ddl))
        else:
            lists = table(map_arrow(rest.select("key", "fixed", "fp"), again, posting), "further-postings")
    return found.distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, fp, component_id (the smallest id reachable over links), a row for each row of ``docs``.

    Null ids keep their row and never name a component unless nothing else is in it.
    """
    return fingerprint_groups(table(fingerprints(docs, id_col, text_col, width), "simhash"), bits)


def fingerprint_groups(fps: DataFrame, bits: int = 2) -> DataFrame:
    """doc_id, fp to doc_id, fp, component_id (the smallest id reachable over links)."""
    nodes = table(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = components(links(nodes, bits)).withColumnRenamed("node", "fp")
    roots = nodes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = table(spread_join(roots.select("fp", "root"), least, ["root"]).select("fp", "component_id"), "simhash-classes")
    release(fps.sparkSession)
    return spread_join(fps, classes, ["fp"]).select("doc_id", "fp", "component_id")


SKETCH = 256  # bins of the shingle sketch; the standard error of a similarity near 0.8 is 0.025


def sketch(shingles: np.ndarray) -> bytes:
    """One-permutation minima of shingle hashes, a byte for each bin; 0: no shingle fell into it."""
    bins = (shingles & np.uint64(SKETCH - 1)).astype(np.int64)
    order = np.lexsort((shingles, bins))
    bins, shingles = bins[order], shingles[order]
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    out = np.zeros(SKETCH, np.uint8)
    out[bins[first]] = 1 + (mix64(shingles[first]) % np.uint64(255)).astype(np.uint8)
    return out.tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Jaccard similarity of the two shingle sets, estimated from their sketches."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    used = int(((x > 0) | (y > 0)).sum())
    same = int(((x == y) & (x > 0)).sum()) / used if used else 1.0
    return same


def shingle_set(words: list[bytes], width: int, known) -> tuple[int, np.ndarray]:
    """A hash of all words, and the distinct hashes of the shingles; a text of fewer than ``width`` words is one shingle."""
    r, n = Rolling(hash_words(words, known)), len(words)
    whole = r.ranges(np.array([0]), np.array([n]))
    return int(whole.view(np.int64)[0]), np.unique(r.windows(width)) if n >= width else whole


def prefix_length(n: int, similarity: float) -> int:
    """Two sets at ``similarity`` or above share one of the first so many of each one's ``n`` elements, in any common order."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def common_shingles(texts: DataFrame, width: int, sample_docs: int = 20_000, most: int = 100_000) -> np.ndarray:
    """Shingles met three times or more in a sample, the most frequent last. Only the speed depends on it: any order finds all pairs."""
    n = texts.count()
    share = min(1.0, sample_docs / max(n, 1))
    some = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    schema = arrow_schema("shingle long")

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        known = word_hashes()
        sets = [shingle_set(w, width, known)[1] for t in as_bytes(b.column(1)) if (w := (t or b"").lower().split())]
        return record_batch(schema, np.concatenate(sets).view(np.int64)) if sets else None

    found = map_arrow(some, run, "shingle long").groupBy("shingle").count().where("count > 2").orderBy(F.desc("count"), "shingle").limit(most)
    rows = found.toArrow().column("shingle").to_numpy().astype("<i8").view(np.uint64)
    return rows[::-1].copy()


def text_features(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """doc_id, content (hash of the words), fp (of the same shingles), n (distinct shingles), sketch, prefix (rarest shingles first); blank texts are left out."""
    ddl = "doc_id long, content long, fp long, n int, sketch binary, prefix binary"
    schema = arrow_schema(ddl)
    common = common_shingles(texts, width)
    by_value = np.argsort(common)
    values = common[by_value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_hashes()
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                words = (text or b"").lower().split()
                if words:
                    content, s = shingle_set(words, width, known)
                    rank = np.zeros(len(s), np.int64)
                    if len(values):
                        at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                        rank = np.where(values[at] == s, by_value[at] + 1, 0)
                    first = s[np.lexsort((s, rank))][: prefix_length(len(s), similarity)]
                    rows.append((doc_id, content, fingerprint(text, width), len(s), sketch(s), first.tobytes()))
            if rows:
                yield record_batch(schema, *zip(*rows, strict=True))

    tune(texts.sparkSession)
    return texts.mapInArrow(run, ddl)


def close_pairs(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (u, v) at ``similarity`` or above, by the exact shingle sets; the sketch discards those six standard errors below."""
    ddl = "u long, v long"
    edges = arrow_schema(ddl)
    held = {}

    def rough(b: pa.RecordBatch) -> pa.RecordBatch | None:
        u, v, su, sv = (c.to_pylist() for c in b.columns)
        ok = [(x, y) for x, y, p, q in zip(u, v, su, sv, strict=True) if likeness(p, q) >= similarity - 0.15]
        return record_batch(edges, *zip(*ok, strict=True)) if ok else None

    def exact(b: pa.RecordBatch) -> pa.RecordBatch | None:
        known = held.setdefault("known", word_hashes())
        ok = []
        for u, v, tu, tv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), as_bytes(b.column(3)), strict=True):
            x, y = (shingle_set(t.lower().split(), width, known)[1] for t in (tu, tv))
            same = len(np.intersect1d(x, y, assume_unique=True))
            if same >= similarity * (len(x) + len(y) - same) - 1e-9:
                ok.append((u, v))
        return record_batch(edges, *zip(*ok, strict=True)) if ok else None

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    both = spread_join(spread_join(pairs, side("u"), ["u"]), side("v"), ["v"])
    both = both.where(f"least(nu, nv) >= {similarity} * greatest(nu, nv) - 1e-9").select("u", "v", "su", "sv")
    near = table(map_arrow(both, rough, ddl).distinct(), "near")
    release(nodes.sparkSession)
    wanted = near.select(F.col("u").alias("doc_id")).union(near.select("v")).distinct()
    own = table(spread_join(texts, wanted, ["doc_id"]).where("trim(text) <> ''").distinct(), "near-texts")
    side = lambda c: own.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}"))
    both = spread_join(spread_join(near, side("u"), ["u"]), side("v"), ["v"]).select("u", "v", "tu", "tv")
    close = table(map_arrow(both, exact, ddl).distinct(), "close")
    dropped(own, near)
    release(nodes.sparkSession)
    return close


def list_pairs(key: list[np.ndarray], node: np.ndarray, root: np.ndarray, n: np.ndarray, at: np.ndarray, block: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within each list (rows of equal ``key``, adjacent) that different roots, their sizes and the places of the shared shingle allow."""
    new = np.zeros(len(node), bool)
    new[:1] = True
    for k in key:
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.r_[starts, len(node)])
    end = np.repeat(starts + sizes, sizes)
    i = np.arange(len(node))
    cross = key[1] != key[2]  # of two blocks: only pairs with one row in each
    for d in range(1, int(sizes.max(initial=1))):
        i = i[i + d < end[i]]
        if not len(i):
            return
        j = i + d
        most = np.minimum(n[i] - at[i], n[j] - at[j])
        ok = (root[i] != root[j]) & (node[i] != node[j]) & ((1 + similarity) * most >= similarity * (n[i] + n[j]) - 1e-6) & (~cross[i] | (block[i] != block[j]))
        if ok.any():
            yield np.maximum(node[i[ok]], node[j[ok]]), np.minimum(node[i[ok]], node[j[ok]])


def member_pairs(members: DataFrame, similarity: float, block_rows: int = 1000) -> DataFrame:
    """(key, node, n, at, root, m) to pairs (u, v) of different roots; a list of ``m`` rows is dealt out by pairs of blocks."""
    ddl = "u long, v long"
    edges = arrow_schema(ddl)
    blocks = F.ceil(F.col("m") / block_rows)
    dealt = members.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    dealt = dealt.select("key", F.least("block", "other").alias("b0"), F.greatest("block", "other").alias("b1"), "node", "root", "n", "at", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []  # the last list so far, which the next batch may continue
        for b in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if not len(rows[0]):
                continue
            rows = [np.concatenate(x) for x in zip(kept, rows, strict=True)] if kept else rows
            last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]) & (rows[2] == rows[2][-1])
            cut = int(np.argmax(last))
            kept = [x[cut:] for x in rows]
            for u, v in list_pairs([x[:cut] for x in rows[:3]], *[x[:cut] for x in rows[3:]], similarity):
                yield record_batch(edges, u, v)
        if kept:
            for u, v in list_pairs(kept[:3], *kept[3:], similarity):
                yield record_batch(edges, u, v)

    return dealt.repartition("key", "b0", "b1").sortWithinPartitions("key", "b0", "b1").mapInArrow(run, ddl).distinct()


def fingerprint_links(nodes: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Pairs (u, v) at ``similarity`` or above of a node and the smallest one of its component by fingerprints."""
    groups = fingerprint_groups(nodes.select(F.col("node").alias("doc_id"), "fp"))
    pairs = table(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("u"), F.col("component_id").alias("v")), "simhash-pairs")
    return close_pairs(pairs, nodes, texts, width, similarity)


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (u, v) whose roots (node, root) differ."""
    side = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    both = pairs.join(side("u"), "u", "left").join(side("v"), "v", "left")
    return both.where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v")


def near_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id: near-duplicates by ``width``-word shingles, for documents with an id and a word.

    Exact: all pairs at ``similarity`` or above are connected, and no others. Fingerprints over the same shingles are linked by the
    byte-position index, as in ``simhash_groups``; each member is compared with the smallest of its component, and what this joins
    is not compared again. The index guarantees 2 differing bits, which pairs at ``similarity`` often exceed, so the rest is found exactly:
    in one order of all shingles, the rare ones first, such a pair shares one of the first fifth of either set (prefix filter), so
    these are the postings. First each posting's members are compared with its first and its most copied one, which joins large
    groups without their square. Then all members that are still in different groups are compared with each other, long postings in
    pairs of blocks; sizes and places of the shared shingle rule most pairs out. All pairs are verified by their shingle sets. Equal texts are one node.
    """
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").where("doc_id is not null and text is not null")
    wide = table(text_features(texts, width, similarity), "features")
    one = lambda c: F.min(c).alias(c)
    nodes = table(wide.groupBy("content").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), one("fp"), one("n"), one("sketch"), one("prefix")), "nodes")
    f = table(wide.select("doc_id", "content"), "contents")
    dropped(wide)
    release(docs.sparkSession)
    alike = fingerprint_links(nodes, texts, width, similarity)
    joined = table(components(alike), "simhash-roots")
    ddl = "key long, node long, copies long, n int, at int"
    out = arrow_schema(ddl)

    def post(b: pa.RecordBatch) -> pa.RecordBatch:
        keys = [np.frombuffer(x, "<i8") for x in b.column(0).to_pylist()]
        size = [len(k) for k in keys]
        own = [np.repeat(c.to_numpy(zero_copy_only=False), size) for c in b.columns[1:]]
        return record_batch(out, np.concatenate(keys), *own, np.concatenate([np.arange(k, dtype=np.int32) for k in size]))

    posts = map_arrow(nodes.select("prefix", "node", "copies", "n"), post, ddl)
    heads = posts.groupBy("key").agg(F.min("node").alias("a"), F.max(F.struct("copies", (-F.col("node")).alias("m"))).alias("c"), F.max("node").alias("z"), F.count("*").alias("m")).where("a < z")
    heads = table(heads.select("key", "a", (-F.col("c.m")).alias("c"), "m"), "heads")
    release(docs.sparkSession)
    members = table(posts.select("key", "node", "n", "at").join(heads, "key"), "members")  # heads are a file, so both sides are dealt out anew
    release(docs.sparkSession)
    pairs = members.select("node", F.explode(F.array("a", "c")).alias("to")).where("node <> to").select(F.greatest("node", "to").alias("u"), F.least("node", "to").alias("v")).distinct()
    pairs = table(apart(pairs, joined), "pairs")
    first = table(components(close_pairs(pairs, nodes, texts, width, similarity).union(alike)), "first-roots")
    dropped(joined, pairs)
    rest = spread_join(members.where("m > 2").select("key", "node", "n", "at", "m"), first, ["node"], "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rest.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("key")
    pairs = table(member_pairs(spread_join(rest, table(mixed, "mixed"), ["key"]), similarity), "member-pairs")
    dropped(members, heads)
    release(docs.sparkSession)
    close = close_pairs(pairs, nodes, texts, width, similarity)
    roots = lambda c: first.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    between = close.join(roots("u"), "u", "left").join(roots("v"), "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
    second = components(between).select(F.col("node").alias("root"), F.col("root").alias("least"))
    found = nodes.select("content", "node").join(first, "node", "left").withColumn("root", F.coalesce("root", "node")).join(second, "root", "left")
    classes = found.select("content", F.coalesce("least", "root").alias("component_id"))
    return spread_join(f.select("doc_id", "content"), table(classes, "classes"), ["content"]).select("doc_id", "component_id")


def near_dedup(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one with the smallest id; all columns stay.

    Rows without an id or without a word stay, and so do rows that share the kept id.
    """
    gone = near_groups(docs, width, similarity).where("doc_id <> component_id").select("doc_id").distinct()
    return beside(docs, gone, {"doc_id": F.col("doc_id").cast("long")}, "left_anti")
