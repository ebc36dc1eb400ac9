"""Line deduplication by log templates: a tree of fixed depth over token count and leading tokens. DataFrame code only.

Parsing. A line's tokens (split at white space) that hold a digit become ``<*>``. The line goes to the leaf named by its number of
tokens and its first ``depth`` tokens. In a leaf, a token in a later position stays if at least ``min_docs`` of the leaf's
(document, line) pairs and at least ``field_share`` of them have it there, else it is a value of a variable field and becomes
``<*>`` too. A template that keeps fewer than ``min_constant`` of its tokens says too little, and the masked line stands for itself instead.

Dropping. A template recurs if it is in ``min_docs`` documents or more. Documents are told apart by their whole text, so exact copies
count once. Neither does a document count that is itself a near copy: ``copied_share`` or more of its bytes are lines that stand word for word in other
documents; else every line of a document that was copied and edited five times would be lost with the original. All lines
of recurring templates are dropped, in all documents, first ones as well.

Lines are parsed where texts are read; all that follows is done once for each distinct text. Null or blank text: no lines.
Lines of fewer than ``min_tokens`` tokens are never dropped. A line that a document repeats counts once. Ids aren't looked
at: rows without one, or with the same, are documents like others. Equal texts are cut alike. Other columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import beside, fresh, release, spread_join, table

_SPACE = "[ \\t\\x0B\\f\\r]+"


def _spaces(c: str) -> Column:
    """How many spaces a string holds, from its length in bytes."""
    return F.octet_length(c) - F.octet_length(F.replace(F.col(c), F.lit(" "), F.lit("")))


def _text_keys() -> dict[str, Column]:
    """What a text is known by: a hash and its length in bytes."""
    text = F.col("text").cast("string")
    return {"content": F.xxhash64(text), "size": F.octet_length(text)}


def parsed(docs: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """content, size, nth (0 first), line, masked (its digits' tokens masked), leaf, key: each line with ``min_tokens`` tokens or more."""
    keys = [e.alias(k) for k, e in _text_keys().items()]
    rows = docs.where("text is not null").select(*keys, F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("nth", "raw"))
    odd = F.lit(False)
    for c in ("  ", "\t", "\x0b", "\f", "\r"):
        odd = odd | F.contains("raw", F.lit(c))
    line = F.trim(F.when(odd, F.regexp_replace("raw", _SPACE, " ")).otherwise(F.col("raw")))
    out = rows.select("content", "size", "nth", line.alias("line")).where(_spaces("line") >= min_tokens - 1)
    masked = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", "[^ ]*[0-9][^ ]*", "<*>")).otherwise(F.col("line"))
    out = out.withColumn("masked", masked)
    return out.withColumn("leaf", F.xxhash64(_spaces("masked"), F.substring_index("masked", " ", depth))).withColumn("key", F.xxhash64("masked", F.lit(1)))


def recurring_lines(docs: DataFrame, depth: int = 3, min_docs: int = 5, min_constant: float = 0.6, min_tokens: int = 3, field_share: float = 0.05, copied_share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The lines of each distinct text as content, size, nth, leaf, key; and leaf, key of the masked lines whose templates recur."""
    some = lambda c: F.first(c).alias(c)
    lines = parsed(docs, depth, min_tokens).select("content", "size", "nth", "leaf", "key", F.xxhash64("line").alias("whole"), F.octet_length("line").alias("bytes"))
    lines = table(lines.groupBy("content", "size", "nth").agg(some("leaf"), some("key"), some("whole"), some("bytes")), "lines")
    shared = lines.groupBy("whole").agg(F.min("content").alias("a"), F.max("content").alias("b")).where("a < b").select("whole")
    copied = spread_join(lines.select("content", "size", "whole", "bytes"), shared, ["whole"]).groupBy("content", "size").agg(F.sum("bytes").alias("s"))
    copied = table(copied.where(F.col("s") >= copied_share * F.col("size")).select("content", "size"), "copied")
    leaves = lines.groupBy("leaf").agg(F.min("content").alias("a"), F.max("content").alias("b"), F.min("key").alias("k0"), F.max("key").alias("k1")).where("a < b")
    leaves = table(leaves.select("leaf", (F.col("k0") < F.col("k1")).alias("varied")), "leaves")
    held = spread_join(lines.select("leaf", "key", "content", "size"), leaves, ["leaf"]).groupBy("leaf", "varied", "key", "content", "size").agg(F.count("*").alias("c")).drop("c")
    held = table(held, "held")
    seen = spread_join(held, copied, ["content", "size"], "left_anti")
    pairs = table(seen.groupBy("leaf", "varied", "key").agg(F.count("*").alias("pairs")), "pairs")
    # Leaves that can reach min_docs at all and hold more than one line: their tokens are looked at.
    wide = table(pairs.groupBy("leaf").agg(F.sum("pairs").alias("leaf_pairs"), F.first("varied").alias("varied")).where(f"varied and leaf_pairs >= {min_docs}").select("leaf", "leaf_pairs"), "varied-leaves")
    again = parsed(docs, depth, min_tokens).select("leaf", "key", "masked")
    texts = spread_join(again, wide, ["leaf"]).groupBy("leaf", "leaf_pairs", "key").agg(F.min("masked").alias("masked"))
    texts = table(spread_join(texts, pairs.select("leaf", "key", "pairs"), ["leaf", "key"], "left"), "variants")
    tokens = texts.select("leaf", "leaf_pairs", "key", F.coalesce("pairs", F.lit(0)).alias("pairs"), F.posexplode(F.split("masked", " ")).alias("at", "token"))
    support = tokens.groupBy("leaf", "at", "token").agg(F.sum("pairs").alias("support"))
    enough = F.greatest(F.lit(float(min_docs)), field_share * F.col("leaf_pairs"))
    judged = spread_join(tokens, support, ["leaf", "at", "token"]).withColumn("stays", (F.col("at") < depth) | (F.col("support") >= enough))
    kept = F.col("stays") & (F.col("token") != "<*>")
    shapes = judged.groupBy("leaf", "key").agg(
        F.count("*").alias("n"),
        F.count_if(kept).alias("constant"),
        F.bit_xor(F.xxhash64("at", F.when(F.col("stays"), F.col("token")).otherwise(F.lit("<*>")))).alias("shape"),
    )
    shapes = table(shapes.where(F.col("constant") >= min_constant * F.col("n")).select("leaf", "key", "shape"), "shapes")
    named = lambda df: spread_join(df, shapes, ["leaf", "key"], "left").withColumn("template", F.coalesce("shape", "key"))
    found = named(spread_join(held.drop("varied"), copied, ["content", "size"], "left_anti")).groupBy("leaf", "template", "content", "size").agg(F.count("*").alias("c"))
    found = found.groupBy("leaf", "template").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select("leaf", "template")
    keys = spread_join(named(held.select("leaf", "key").distinct()), found, ["leaf", "template"]).select("leaf", "key").distinct()
    return lines.select("content", "size", "nth", "leaf", "key"), table(keys, "recurring")


def _with_gone(docs: DataFrame, options: dict) -> tuple[DataFrame, str]:
    """``docs`` and, in a column of the name returned, the positions of the lines to be dropped; null for none."""
    lines, keys = recurring_lines(docs.select("text"), **options)
    release(docs.sparkSession)
    gone = spread_join(lines, keys, ["leaf", "key"]).groupBy("content", "size").agg(F.collect_set("nth").alias("gone"))
    name = fresh(docs, "gone")
    return beside(docs, gone, _text_keys(), values={"gone": name}), name


def _kept(gone: str) -> Column:
    """The text without its dropped lines."""
    text = F.col("text").cast("string")
    return F.when(F.col(gone).isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(gone, i)), "\n"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without recurring lines; documents of which no line is left go, those that had none before stay."""
    cut, gone = _with_gone(docs, options)
    return cut.withColumn("text", _kept(gone)).where(F.col(gone).isNull() | (F.trim("text") != "")).select(*docs.columns)


def line_digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each row."""
    cut, gone = _with_gone(docs.select("doc_id", "text"), options)
    text = F.col("text").cast("string")
    n = F.when(text.isNull(), F.lit(0)).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    dropped = F.coalesce(F.array_size(gone), F.lit(0)).cast("long")
    return cut.select(F.col("doc_id").cast("long").alias("doc_id"), n.cast("long").alias("n_lines"), dropped.alias("n_dropped"), F.sha2(F.coalesce(_kept(gone), F.lit("")), 256).alias("kept_sha256"))


#: DuckDB SQL for the rows of ``line_digests`` with its defaults.
DIGESTS_SQL = r"""
WITH texts AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
raw AS (SELECT text, unnest(range(len(string_split(text, chr(10))))) AS nth, unnest(string_split(text, chr(10))) AS raw FROM texts),
lines AS (SELECT text, nth, trim(regexp_replace(raw, '[ \t\x0B\f\r]+', ' ', 'g'), ' ') AS line FROM raw),
masked AS (SELECT *, string_split(regexp_replace(line, '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' ') AS tokens FROM lines WHERE len(string_split(line, ' ')) >= 3),
leafed AS (SELECT *, (len(tokens), tokens[1:3]) AS leaf FROM masked),
shared AS (SELECT line FROM leafed GROUP BY line HAVING count(DISTINCT text) > 1),
copied AS (SELECT text FROM leafed JOIN shared USING (line) GROUP BY text HAVING sum(strlen(line)) >= 0.8 * strlen(text)),
pairs AS (SELECT DISTINCT leaf, tokens, text FROM leafed WHERE text NOT IN (SELECT text FROM copied)),
leaves AS (SELECT leaf, count(*) AS leaf_pairs FROM pairs GROUP BY leaf),
variants AS (SELECT DISTINCT leaf, tokens FROM leafed),
counted AS (SELECT leaf, tokens, count(text) AS n FROM variants LEFT JOIN pairs USING (leaf, tokens) GROUP BY leaf, tokens),
spread AS (SELECT leaf, tokens, n, unnest(range(len(tokens))) AS spot, unnest(tokens) AS token FROM counted),
support AS (SELECT leaf, spot, token, sum(n) AS support FROM spread GROUP BY leaf, spot, token),
judged AS (SELECT s.*, s.spot < 3 OR p.support >= greatest(5.0, 0.05 * l.leaf_pairs) AS stays
           FROM spread s JOIN support p USING (leaf, spot, token) JOIN leaves l USING (leaf)),
shapes AS (SELECT leaf, tokens, list(CASE WHEN stays THEN token ELSE '<*>' END ORDER BY spot) AS shape FROM judged GROUP BY leaf, tokens
           HAVING count(*) FILTER (stays AND token <> '<*>') >= 0.6 * count(*)),
named AS (SELECT v.leaf, v.tokens, coalesce(s.shape, v.tokens) AS template FROM variants v LEFT JOIN shapes s USING (leaf, tokens)),
recurring AS (SELECT leaf, template FROM pairs JOIN named USING (leaf, tokens) GROUP BY leaf, template HAVING count(DISTINCT text) >= 5),
gone AS (SELECT DISTINCT f.text, f.nth FROM leafed f JOIN named n USING (leaf, tokens) JOIN recurring r ON r.leaf = n.leaf AND r.template = n.template),
kept AS (SELECT r.text, count(g.nth) AS n_dropped, coalesce(string_agg(r.raw, chr(10) ORDER BY r.nth) FILTER (g.nth IS NULL), '') AS kept
         FROM raw r LEFT JOIN gone g ON g.text = r.text AND g.nth = r.nth GROUP BY r.text)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.text = d.text
"""
