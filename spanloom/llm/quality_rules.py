"""Quality rules: base counts, then Jensen-Shannon distance from references of the document's language.

Each document gives two histograms: characters (code points) by class, and words by whether they are one of its language's common words
(one bin each) or another. The common words are fitted: those that most documents of the language hold. A language's
reference is the mean histogram of all its documents that pass the base rules and are long enough. A document is rejected if either
distance (the root of the divergence in base 2, 0 to 1) exceeds its limit. The word limit allows for length, since a sample of n
words from the reference itself diverges by about bins / (5.5 * n); below ``min_words`` words nothing is compared (guard).

A document that its own language's reference doesn't fit may fit another's: labels err, and rows without a language have no
own one but the mean of the unlabelled. The reference with the least excess over the limits counts. Words are held against the mean over all documents
as well, with all languages' common words, and the lesser distance counts, so that a text in two languages isn't rejected for
it. The rule is the same for languages and tables of any size. Where there is no reference at all, nothing is compared.

A language is a code of two or three letters; a region or script after it is left out, and any other value is no
language. So there are at most 26**2 + 26**3, which bounds what is sent to each task; references are tried one after another.

Null text: no words, so it fails the base rules. Repeated rows are judged alike. Other columns are not looked at, whatever their names.
An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import Rolling, arrow_schema, as_bytes, beside, hash_words, map_arrow, record_batch, table, tune, word_hashes

SYMBOLS = "#*$%&|<>"
N_CLASSES = 8
_STRIP = b".,;:!?'\"()-"


def _class_table() -> np.ndarray:
    """Class of each byte: 0 a-z, 1 A-Z, 2 digits, 3 white space, 4 sentence marks, 5 SYMBOLS, 6 other ASCII, 7 first of a character
    beyond ASCII, 8 its other bytes, which don't count."""
    t = np.full(256, 6, np.int64)
    t[128:192], t[192:] = 8, 7
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\x0b\x0c\r", ".,;:!?'\"()-", SYMBOLS)):
        t[list(chars.encode())] = k
    return t


_CLASS = _class_table()


_NO_LANGUAGE = "?"


class Bins(dict):
    """Language to its words' bins; a language without words has none."""

    def __missing__(self, lang: str) -> np.ndarray:
        return np.zeros(0, np.int64)


def base_counts(text: bytes, hashes=None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    chars = sum(len(w.decode("utf-8", "replace")) for w in words) if not text.isascii() else sum(map(len, words))
    symbols = sum(text.count(s.encode()) for s in SYMBOLS)
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line.split(None, 1):
            dup += line in seen
            seen.add(line)
    repeat = 0
    if len(words) > 5:
        h = Rolling(hash_words(words, hashes if hashes is not None else word_hashes())).windows(5)
        _, back, count = np.unique(h, return_inverse=True, return_counts=True)
        at = np.flatnonzero(count[back] > 1)
        if len(at):
            d = np.zeros(len(words) + 1, np.int64)
            np.add.at(d, at, 1)
            np.add.at(d, at + 5, -1)
            repeat = int((np.cumsum(d)[:-1] > 0).sum())
    return len(words), chars, symbols, dup, repeat


def character_classes(text: bytes) -> np.ndarray:
    """Code points by class."""
    return np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=N_CLASSES + 1)[:N_CLASSES]


def common_words(docs: DataFrame, most: int = 100, held_words: int = 300_000) -> dict[str, list[bytes]]:
    """For each language of ``docs`` (lang, text): the words that most of its documents hold, at most ``most``; ties by word."""
    ddl = "lang string, word binary, n long"
    schema = arrow_schema(ddl)
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            langs, words, counts = [], [], []
            for lang, c in held.items():
                langs += [lang] * len(c)
                words += c.keys()
                counts += c.values()
            held.clear()
            return record_batch(schema, langs, words, counts)

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                held.setdefault(lang, Counter()).update({w.strip(_STRIP) for w in set((text or b"").lower().split())})
            if sum(map(len, held.values())) > held_words:
                yield flush()
        if held:
            yield flush()

    found = docs.mapInArrow(run, ddl).where("length(word) > 0").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # The best of each of 64 shares of a language's words first, so that no task sorts all of them.
    order = [F.desc("n"), "word"]
    best = found.withColumn("share", F.pmod(F.xxhash64("word"), F.lit(64))).withColumn("at", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(f"at <= {most}")
    best = best.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(f"at <= {most}")
    out: dict[str, list[bytes]] = {}
    for r in best.select("lang", "word").orderBy("lang", "at").collect():  # at most ``most`` for each language code
        out.setdefault(r.lang, []).append(bytes(r.word))
    return out


@dataclass
class Reference:
    """A language's histogram of shares: ``own`` are its words' bins, ascending; the last of ``words`` is any other word."""

    own: np.ndarray
    classes: np.ndarray
    words: np.ndarray
    spread: float = field(init=False)  # how many bins count when a sample's own divergence is estimated

    def __post_init__(self):
        self.spread = float((self.words >= 0.002).sum())


FEATURES = "doc_id long, lang string, row int, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes binary, bins binary, hits binary"


def features(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """Base counts, base_failed, character classes and word bins (numbers of ``words``, and how often each is met) of each row."""
    schema = arrow_schema(FEATURES)
    number = {w: i + 1 for i, w in enumerate(words)}
    held: dict = {}

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        cache, get, rows = held.setdefault("cache", word_hashes()), number.get, []
        for doc_id, lang, row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), as_bytes(b.column(3)), strict=True):
            text = text or b""
            bins, hits = np.unique([get(w.strip(_STRIP), 0) for w in text.lower().split()], return_counts=True)
            known = bins > 0
            packed = (character_classes(text).astype("<u4").tobytes(), (bins[known] - 1).astype("<u4").tobytes(), hits[known].astype("<u4").tobytes())
            rows.append((doc_id, lang, row, *base_counts(text, cache), *packed))
        return record_batch(schema, *zip(*rows, strict=True))

    return map_arrow(docs, run, FEATURES).withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


class Histograms:
    """The histograms of the rows of a batch, as shares."""

    def __init__(self, n_words: pa.Array, classes: pa.Array, bins: pa.Array, hits: pa.Array):
        n, bins = len(n_words), [np.frombuffer(x, "<u4") for x in bins.to_pylist()]
        self.classes = np.frombuffer(b"".join(classes.to_pylist()), "<u4").reshape(n, N_CLASSES).astype(float)
        self.classes /= np.maximum(self.classes.sum(1, keepdims=True), 1)
        self.total = np.maximum(n_words.to_numpy(zero_copy_only=False).astype(float), 1)
        self.row = np.repeat(np.arange(n), list(map(len, bins)))
        self.bin = np.concatenate([*bins, np.zeros(0, "<u4")]).astype(np.int64)
        self.share = np.frombuffer(b"".join(hits.to_pylist()), "<u4") / self.total[self.row]

    def words(self, own: np.ndarray) -> np.ndarray:
        """Shares of the words ``own`` and, last, of any other word."""
        out = np.zeros((len(self.total), len(own) + 1))
        if len(own):
            at = np.minimum(np.searchsorted(own, self.bin), len(own) - 1)
            ok = own[at] == self.bin
            out[self.row[ok], at[ok]] = self.share[ok]
        out[:, -1] = 1 - out[:, :-1].sum(1)
        return out

    def mixed(self, overall: np.ndarray) -> np.ndarray:
        """Divergence of the words of all languages from their overall shares; ``overall[-1]`` is of any other word."""
        n = len(self.total)
        other = 1 - np.bincount(self.row, self.share, n)
        row, p = np.r_[self.row, np.arange(n)], np.r_[self.share, np.maximum(other, 0)]
        q = overall[np.r_[self.bin, np.full(n, len(overall) - 1)]]
        met = p > 0
        row, p, q = row[met], p[met], q[met]
        m = (p + q) / 2
        part = p * np.log2(p / m) + np.where(q > 0, q * np.log2(np.where(q > 0, q, 1) / m), 0)
        return np.maximum(0, (np.bincount(row, part, n) + overall.sum() - np.bincount(row, q, n)) / 2)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence, base 2, of each row of shares ``p`` from the shares ``q``."""
    m = (p + q) / 2
    log = lambda a: np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0)
    return np.maximum(0, (log(p).sum(1) + log(np.broadcast_to(q, p.shape)).sum(1)) / 2)


def references(f: DataFrame, own: dict[str, np.ndarray], n_bins: int, min_words: int) -> tuple[dict[str, Reference], np.ndarray | None]:
    """The mean histograms of each language's sound documents, however few, and of the words of all of them.

    Sums are formed in each batch and added up by Spark: for each language its number of documents (slot 0), its classes and its own words;
    for all (an empty name) every word. That is what the driver gets.
    """
    ddl = "lang string, slot int, s double"
    schema = arrow_schema(ddl)
    first_word = 1 + N_CLASSES

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        langs = np.array(b.column(0).to_pylist(), object)
        names, slots, sums = [], [], []
        h = Histograms(*b.columns[1:])

        def add(name: str, values: np.ndarray) -> None:
            at = np.flatnonzero(values)
            names.extend([name] * len(at))
            slots.extend(at.tolist())
            sums.extend(values[at].tolist())

        for lang in set(langs.tolist()):
            mine = langs == lang
            add(lang, np.r_[mine.sum(), h.classes[mine].sum(0), h.words(own[lang])[mine].sum(0)])
        add("", np.r_[len(langs), np.zeros(N_CLASSES), np.bincount(h.bin, h.share, n_bins), len(langs) - h.share.sum()])
        return record_batch(schema, names, slots, sums)

    sound = f.where(f"not base_failed and n_words >= {min_words}").select("lang", "n_words", "classes", "bins", "hits")
    sums: dict[str, np.ndarray] = {}
    for r in map_arrow(sound, run, ddl).groupBy("lang", "slot").agg(F.sum("s").alias("s")).collect():
        sums.setdefault(r.lang, np.zeros(first_word + 1 + (len(own[r.lang]) if r.lang else n_bins)))[r.slot] = r.s
    overall = sums.pop("", None)
    found = {lang: Reference(own[lang], s[1:first_word] / s[0], s[first_word:] / s[0]) for lang, s in sums.items()}
    return found, None if overall is None else overall[first_word:] / overall[0]


def judge(docs: DataFrame, class_limit: float = 0.245, word_limit: float = 0.27, min_words: int = 50, most_words: int = 100) -> DataFrame:
    """doc_id, row, the base counts, base_failed, class_distance, word_distance (null where guarded), kept."""
    code = F.lower(F.regexp_extract(F.col("lang").cast("string"), "^\\s*([A-Za-z]{2,3})([-_].*)?\\s*$", 1))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(code == "", None).otherwise(code).alias("lang"), F.hash("text").alias("row"), F.col("text").cast("string").alias("text"))
    keyed = keyed.fillna(_NO_LANGUAGE, ["lang"])
    fitted = common_words(keyed.select("lang", "text"), most_words)
    words = sorted({w for x in fitted.values() for w in x})
    number = {w: i for i, w in enumerate(words)}
    own = Bins({lang: np.array(sorted(number[w] for w in x), np.int64) for lang, x in fitted.items()})
    f = table(features(keyed, words), "quality")
    refs, overall = references(f, own, len(words), min_words)
    ddl = "doc_id long, row int, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean"
    schema = arrow_schema(ddl)

    def fit(h: Histograms, r: Reference) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Divergences by class and by word, each as a multiple of its limit, and the word limit."""
        limit = word_limit**2 + 1.25 * r.spread / (5.5 * h.total)
        return divergence(h.classes, r.classes), divergence(h.words(r.own), r.words), limit

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n_words, failed = b.column("n_words").to_numpy(zero_copy_only=False), b.column("base_failed").to_numpy(zero_copy_only=False).astype(bool)
        lang = np.array(b.column("lang").to_pylist(), object)
        by_class, by_word, limit, least = (np.full(len(lang), x) for x in (np.nan, np.nan, 1.0, np.inf))
        long = n_words >= min_words

        def attempt(rows: np.ndarray, r: Reference) -> None:
            """Takes the reference for those of ``rows`` that it fits better than what was tried before."""
            if not len(rows):
                return
            c, w, limits = fit(Histograms(*(b.column(x).take(pa.array(rows)) for x in ("n_words", "classes", "bins", "hits"))), r)
            excess = np.maximum(c / class_limit**2, w / limits)
            better = excess < least[rows]
            at = rows[better]
            by_class[at], by_word[at], limit[at], least[at] = c[better], w[better], limits[better], excess[better]

        for name in set(lang[long].tolist()) & refs.keys():
            attempt(np.flatnonzero(long & (lang == name)), refs[name])
        for name, r in refs.items():
            attempt(np.flatnonzero(long & (least > 1) & (lang != name)), r)
        if overall is not None:
            rows = np.flatnonzero(long & (by_word > limit))
            if len(rows):
                by_word[rows] = np.minimum(by_word[rows], Histograms(*(b.column(x).take(pa.array(rows)) for x in ("n_words", "classes", "bins", "hits"))).mixed(overall))
        far = (by_class > class_limit**2) | (by_word > limit)
        seen = np.isfinite(least)
        distance = lambda d: pa.array(np.sqrt(d), mask=~seen)
        return pa.RecordBatch.from_arrays([*(b.column(x) for x in schema.names[:8]), distance(by_class), distance(by_word), pa.array(~failed & ~far)], schema=schema)

    # Features are much smaller than their texts: without new partitions, few tasks would do all the comparing.
    tasks = max(1, int(f.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return map_arrow(f.repartition(tasks), run, ddl)


def keep_sound(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; rows without an id are judged like the others."""
    verdict = judge(docs, **limits).where("not kept").select("doc_id", "row").distinct()
    return beside(docs, verdict, {"doc_id": F.col("doc_id").cast("long"), "row": F.hash("text")}, "left_anti")
