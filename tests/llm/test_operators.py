"""Every operator against a plain brute-force version on a small corpus, and its defined results for odd tables."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanloom.llm import bpe, chunks, hilbert, idfiles, line_templates, packing, quality_rules, simhash, site_quality, substrings
from spanloom.llm.components import components
from spanloom.llm.ranges import range_parts
from spanloom.llm.tokens import encoder, id_bytes, packed, vocabulary_path
from spanloom.sources.scratch import new_path

from tests.llm.conftest import ODD, SCHEMA

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = vocabulary_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def library_ids(library, texts, end=None):
    out = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    return [np.array(x + ([] if end is None else [end]), "<u4") for x in out]


# ---------------------------------------------------------------- tokens


PIECES = ["a", "the", " ", "  ", "\n", "\t", "é", "ß", "'s", "'ll", "'", "!", "..", "12", "　", "\xa0", "日本", "😀", "<|endoftext|>", "\x1c", "​", "x" * 50, "Ġ", "\r\n", "|", "_", "ing", "́", "$$$"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=1, max_size=8))
def test_ids_equal_the_library(texts):
    library = Tokenizer.from_file(PATH) if not hasattr(test_ids_equal_the_library, "t") else test_ids_equal_the_library.t
    test_ids_equal_the_library.t = library
    want = [x.tolist() for x in library_ids(library, texts)]
    for coder in (encoder(PATH), bpe.bpe(PATH).fast):
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == want
    b = bpe.bpe(PATH)
    assert [b.decode(np.array(x, "<u4").tobytes()) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_cache_turns_over(library):
    e = encoder(PATH)
    small = type(e)(e.encode_many, cached=20)
    rng = random.Random(1)
    texts = [" ".join(f"{rng.choice('abcdef')}{rng.randrange(99)}x" for _ in range(30)) for _ in range(40)]
    for i in range(0, 40, 5):
        assert [np.frombuffer(x, "<u4").tolist() for x in small.encode(texts[i : i + 5])] == [x.tolist() for x in library_ids(library, texts[i : i + 5])]


def test_pieces_met_one_by_one(library):
    e = encoder(PATH)
    words = ["Ärger,", "naïve", "x.\nUnd", "don't.", "a--", "42,", "über...\nso", "日本,", "tab\tin", "a\n\nb", "<|endoftext|>", "e<|endoftext|>.", "'s"]
    rng = random.Random(2)
    texts = [" ".join(rng.choice(words) + rng.choice(["", "q", "é!"]) for _ in range(30)) for _ in range(60)] + ["", None, " "]
    for small in (type(e)(e.encode_many, 20, e.encode_word), type(e)(e.encode_many, 20)):
        for i in range(0, len(texts), 7):
            assert [np.frombuffer(x, "<u4").tolist() for x in small.encode(texts[i : i + 7])] == [x.tolist() for x in library_ids(library, texts[i : i + 7])]


def test_parts_of_a_piece_are_not_kept():
    e = encoder(PATH)
    new = type(e)(e.encode_many, encode_word=e.encode_word)
    new.encode(["and alpha, beta.\nGamma"])
    assert {*new.young} == {" and", "alpha,", "beta.\nGamma", " ,", " ."}


def test_speculation_and_merging_agree():
    b, rng = bpe.bpe(PATH), random.Random(3)
    words = ["".join(rng.choices("thenadionsr ", k=rng.randint(1, 25))).encode() for _ in range(4000)] + [b"a" * 3000]
    said, exact = b.encode_words(words), [b.merge(w) for w in words]
    assert said == exact
    assert sum(b.propose(w) != e for w, e in zip(words, exact, strict=True)) > 10  # some proposals did fail


def test_op4(docs, rows, library):
    got = by_id(bpe.digests(docs, PATH))
    for r, ids in zip(rows, library_ids(library, [r[1] for r in rows]), strict=True):
        assert got[r[0]].n_tokens == len(ids)
        assert got[r[0]].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[r[0]].decoded_sha256 == hashlib.sha256((r[1] or "").encode()).hexdigest()


# ---------------------------------------------------------------- 5: SimHash


def plain_fingerprint(text, width):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_op5(docs, rows):
    f = {r[0]: plain_fingerprint(r[1], 3) for r in rows}
    want = plain_components(f, [(a, b) for a, b in itertools.combinations(f, 2) if (f[a] ^ f[b]).bit_count() <= 2])
    got = by_id(simhash.simhash_groups(docs, width=3))
    assert {k: r.fp & (2**64 - 1) for k, r in got.items()} == f
    assert {k: r.component_id for k, r in got.items()} == want
    assert any(k != v for k, v in want.items())


def test_pairs_within_reach_share_a_posting():
    rng = np.random.default_rng(4)
    fp = rng.integers(-(2**63), 2**63 - 1, 500, np.int64)
    flips = np.array([(1 << int(i)) | (1 << int(j)) for i, j in rng.integers(0, 64, (500, 2))], np.uint64).view(np.int64)
    lists = [simhash.first_postings(x) for x in (fp, fp ^ flips)]
    for n in (3, 4, 5, 6):
        assert set(np.bitwise_count(lists[0][0].astype(np.uint16)).tolist()) == {n} and lists[0][0].max() < 256
        keys = [simhash.posting_keys(f, fixed).reshape(-1, 500) for fixed, f in lists]
        assert (keys[0] == keys[1]).any(0).all()
        lists = [simhash.further_postings(*x) for x in lists]


def test_tally_counts_shared_bytes():
    x = np.array([0, 1, 0xFF00FF, -1, 1 << 63 | 1], object)
    assert simhash.shared_bytes(np.array([int(v) & (2**64 - 1) for v in x], np.uint64)).tolist() == [8, 7, 6, 0, 6]
    rng = random.Random(1)
    fp = np.array([rng.getrandbits(5) | rng.getrandbits(4) << 30 | rng.getrandbits(3) << 60 for _ in range(300)], np.uint64).view(np.int64)
    key = np.sort(np.array([rng.randrange(12) for _ in fp]))
    want = {(int(a), int(b)) for i, a in enumerate(fp) for j, b in enumerate(fp) if i < j and key[i] == key[j] and 0 < int(a ^ b).bit_count() <= 2}
    assert {(u, v) for u, v in zip(*(x.tolist() for x in simhash.tally(key, fp, 2)), strict=True)} == want


@pytest.mark.parametrize(("spread", "most"), [(6, 2000), (16, 2000), (16, 40), (10, 3)])
def test_links_in_long_lists(spark, spread, most):
    """Fingerprints crowded into few bits, so that lists are long; all links count."""
    rng = random.Random(spread)
    fps = sorted({rng.getrandbits(spread) << 20 | 0xABC << 50 for _ in range(500)})
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r.node: r.root for r in components(simhash.links(nodes, most=most)).collect()}
    want = plain_components(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 2])
    assert all(got.get(k, k) == v for k, v in want.items())


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(5, 5), (None, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = plain_components({x for e in edges for x in e if x is not None}, [e for e in edges if None not in e])
    assert all(got.get(k, k) == v for k, v in want.items())
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_near_groups(texts, similarity=0.8):
    """Document to the smallest of its group, from the shingle sets of all pairs; for texts with a word."""
    words = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    s = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items() if w}
    return plain_components(s, [(a, b) for a, b in itertools.combinations(s, 2) if len(s[a] & s[b]) >= similarity * len(s[a] | s[b]) - 1e-9])


def test_near_groups(docs, rows):
    got = {r.doc_id: r.component_id for r in simhash.near_groups(docs).collect()}
    assert got == plain_near_groups({r[0]: r[1] for r in rows})
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {k for k, v in got.items() if k != v}


def test_near_groups_go_through_the_fingerprint_index(spark, monkeypatch, tmp_path):
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(600)]
    texts = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in range(0, 600, 15)] + [" ".join(rng.sample(base, 300)) for _ in range(20)] + [" ".join(base)] * 3
    fps, seen, links, seen_pairs = [simhash.fingerprint(t.encode(), 5) for t in texts], [], simhash.links, []
    root = plain_components(range(len(texts)), [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 2])

    def recorded(nodes, *args):
        seen.append({r.fp for r in nodes.collect()})
        return links(nodes, *args)

    def kept(nodes, *args, f=simhash.fingerprint_links):
        out = f(nodes, *args)
        seen_pairs.append({(r.u, r.v) for r in out.collect()})
        return out

    monkeypatch.setattr(simhash, "links", recorded)
    monkeypatch.setattr(simhash, "fingerprint_links", kept)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_groups(docs).collect()}
    assert got == plain_near_groups(dict(enumerate(texts)))
    assert seen == [set(fps)]
    first = {t: texts.index(t) for t in texts}
    assert seen_pairs == [{(i, j) for i, j in root.items() if i != j and i in first.values()}] and len(seen_pairs[0]) > 3


def test_near_groups_remove_their_wide_tables(spark, docs):
    from spanloom.sources import scratch

    before = len(scratch._made)
    simhash.near_groups(docs).collect()
    left = [p.rsplit("/", 1)[1].split("-")[0] for _, p in scratch._made[before:] if spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p))]
    assert "nodes" in left and not {"features", "members", "heads", "near"} & set(left)


def test_near_sets_share_a_prefix():
    rng = np.random.default_rng(2)
    for n in (1, 4, 5, 9, 37, 300):
        for _ in range(40):
            a = rng.choice(10 * n, n, replace=False)
            b = np.union1d(a[int(rng.integers(0, n // 9 + 1)) :], rng.choice(np.arange(10 * n, 20 * n), int(rng.integers(0, n // 9 + 1)), replace=False))
            if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)):
                first = [set(np.sort(x)[: simhash.prefix_length(len(x), 0.8)]) for x in (a, b)]
                assert first[0] & first[1]


def near_corpus(rng, n=150):
    """Documents on a shared template below 0.8 with each other, and copies of some with a passage replaced, from 0.8 up."""
    own = lambda k: ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(k)]
    shared = own(240)
    texts = []
    for _ in range(n):
        w = list(shared)
        for _ in range(6):
            at = rng.randrange(len(w) + 1)
            w[at:at] = own(10)
        texts.append(w)
    for k, w in enumerate(texts[:60]):
        m, at = 4 + k, rng.randrange(len(w) - 70)
        texts.append([*w[:at], *own(m), *w[at + m :]] if k % 2 else w + own(4 + k))
    order = rng.sample(range(len(texts)), len(texts))
    return [(i, " ".join(texts[k])) for i, k in enumerate(order)]


@pytest.mark.parametrize("similarity", [0.8, 0.7])
def test_near_groups_are_exact(spark, similarity):
    rows = near_corpus(random.Random(3)) + [(1000 + k, t) for k, t in enumerate(["one two three", "one two three", "a b c d e f g", "a b c d e f h"])]
    s = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows for w in [t.split()]}
    like = {p: len(s[p[0]] & s[p[1]]) / len(s[p[0]] | s[p[1]]) for p in itertools.combinations(s, 2)}
    assert sum(similarity <= x < similarity + 0.1 for x in like.values()) >= 10
    got = {r.doc_id: r.component_id for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), similarity=similarity).collect()}
    assert got == plain_components(s, [p for p, x in like.items() if x >= similarity])


def test_member_pairs_in_blocks(spark):
    rows = [(k, i, 10, 0, i % 40, 90) for k in (1, 2) for i in range(90)]
    members = spark.createDataFrame(rows, "key long, node long, n int, at int, root long, m long")
    got = {(r.u, r.v) for r in simhash.member_pairs(members, 0.8, block_rows=20).collect()}
    assert got == {(i, j) for i in range(90) for j in range(i) if i % 40 != j % 40}


# ---------------------------------------------------------------- 3: quality rules


def test_op3(docs, rows):
    got = by_id(quality_rules.judge(docs))
    for i, text, *_ in rows:
        t = text or ""
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        count = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {j for k in range(len(w) - 4) if count[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover))
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w))
        assert not (r.base_failed and r.kept)


def plain_divergence(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    half = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
    return (half(p) + half(q)) / 2


def test_divergence():
    p, q = [[0.3, 0, 0.5, 0.2], [1, 0, 0, 0]], [0.1, 0.4, 0.5, 0.0]
    assert np.allclose(quality_rules.divergence(np.array(p), np.array(q)), [plain_divergence(x, q) for x in p])


def plain_judge(rows, class_limit=0.245, word_limit=0.27, min_words=50, most=100):
    """doc_id to (class distance, word distance, kept), everything counted in dictionaries."""
    strip, kinds = ".,;:!?'\"()-", ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\x0b\x0c\r", ".,;:!?'\"()-", "#*$%&|<>"]
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    words = lambda t: [w.strip(strip) for w in WORD.findall(low(t))]
    kind = lambda c: next((k for k, x in enumerate(kinds) if c in x), 6 if ord(c) < 128 else 7)
    held = collections.defaultdict(collections.Counter)
    for _, t, lang, *_ in rows:
        held[lang].update(set(words(t or "")) - {""})
    own = {lang: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:most]] for lang, c in held.items()}
    every = sorted({w for x in own.values() for w in x})

    def shares(items, bins):
        c = collections.Counter(items)
        return [c[b] / len(items) for b in bins]

    def by_word(t, bins):
        s = shares(words(t), bins)
        return [*s, 1 - sum(s)]

    def base_failed(t):
        w = WORD.findall(t)
        c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        return len(w) < 10 or 100 * len({j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}) > 20 * len(w)

    sound = [(t, lang) for _, t, lang, *_ in rows if t and not base_failed(t) and len(words(t)) >= min_words]
    refs = {}
    for lang in own:
        mine = [t for t, x in sound if x == lang]
        if mine:
            refs[lang] = (np.mean([shares(list(map(kind, t)), range(8)) for t in mine], 0), np.mean([by_word(t, own[lang]) for t in mine], 0))
    overall = np.mean([by_word(t, every) for t, _ in sound], 0) if sound else None
    out = {}
    for i, t, lang, *_ in rows:
        t = t or ""
        n = len(WORD.findall(t))
        best = None
        for name in [lang, *[x for x in refs if x != lang]] if n >= min_words else ():
            if name in refs and (best is None or best[0] > 1):
                c = plain_divergence(shares(list(map(kind, t)), range(8)), refs[name][0])
                w = plain_divergence(by_word(t, own[name]), refs[name][1])
                limit = word_limit**2 + 1.25 * sum(x >= 0.002 for x in refs[name][1]) / (5.5 * n)
                excess = max(c / class_limit**2, w / limit)
                if best is None or excess < best[0]:
                    best = (excess, c, w, limit)
        if best is None:
            out[i] = (None, None, not base_failed(t))
            continue
        _, c, w, limit = best
        if w > limit:
            w = min(w, plain_divergence(by_word(t, every), overall))
        out[i] = (max(c, 0) ** 0.5, max(w, 0) ** 0.5, not base_failed(t) and c <= class_limit**2 and w <= limit)
    return out


def test_op3_verdict(spark):
    """Mixed languages, symbols, capitals, short and empty texts; references and limits written out in plain Python."""
    rng = random.Random(11)
    common = {"en": [f"e{k}" for k in range(30)], "fr": [f"é{k}" for k in range(30)], None: [f"n{k}" for k in range(30)], "zu": ["u1", "u2"]}
    prose = lambda lang, n: " ".join(rng.choice(common[lang]) if rng.random() < 0.5 else "".join(rng.choices("abcdefé", k=6)) for _ in range(n))
    rows = []
    for i in range(120):
        lang = rng.choice(["en", "en", "fr", None])
        t = prose(lang, rng.choice([5, 30, 60, 200, 400]))
        t = {0: t.upper(), 1: t.replace(" ", " %$# "), 2: t + " " + prose("en", 150), 3: "1 2 3 " * 40 + t}.get(i % 12, t)
        rows.append((i, t, lang))
    rows += [(500, prose("zu", 90), "zu"), (501, None, "en"), (502, "", "fr"), (503, prose("fr", 300), "en")]
    want = plain_judge(rows)
    got = by_id(quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)))
    for i, (c, w, kept) in want.items():
        r = got[i]
        assert (r.class_distance is None) == (c is None) and r.kept == kept, i
        if c is not None:
            assert abs(r.class_distance - c) < 1e-6 and abs(r.word_distance - w) < 1e-6, i
    assert 5 < sum(k for *_, k in want.values()) < 110 and got[503].kept
    many = quality_rules.judge(spark.createDataFrame(rows * 7, "doc_id long, text string, lang string"))
    assert {(r.doc_id, r.kept) for r in many.collect()} == {(i, k) for i, (*_, k) in want.items()}  # the same at any size


COMMON = {
    "en": "the of and to a in is it that for was on are as with be by this he from or an at not which have were had but they",
    "de": "der die das und in den von zu mit sich des auf ist im dem nicht ein eine als auch es an er so dass wie bei aus nach",
    "fr": "le la les de des du et un une en est que qui dans pour sur par au il elle ne pas avec ce se plus son sa ou aux",
    "es": "de la que el en y a los del se las por un para con no una su al lo como pero sus le ya es fue este",
}


def test_symbols_are_rejected_and_prose_is_kept(spark):
    rng = random.Random(4)
    common = COMMON["en"].split()
    prose = lambda: " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choices("abcdefgh", k=6)) for _ in range(120))
    rows = [(i, prose()) for i in range(60)] + [(100 + i, " ".join(f"{w}%%%" for w in prose().split())) for i in range(5)] + [(200 + i, prose().upper()) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    kept = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    assert kept == set(range(60))


def test_rare_and_unlabelled_languages_are_kept(spark):
    rng = random.Random(6)

    def prose(lang):
        common = COMMON[lang].split() if lang in COMMON else ["il", "che", "di"]
        return " ".join(rng.choice(common) if rng.random() < 0.45 else "".join(rng.choices("abcdefgh", k=6)) for _ in range(250))

    rows = [(i, prose("en"), "en") for i in range(400)] + [(1000 + i, prose("de"), "de") for i in range(40)]
    rows += [(2000 + i, prose("fr"), "fr") for i in range(19)] + [(3000 + i, prose("de"), None) for i in range(10)] + [(4000, prose("xx"), "xx")]
    rows += [(5000 + i, " ".join(f"{w}%%%" for w in prose("en").split()), None if i % 2 else "fr") for i in range(4)]
    rows += [(10_000 + i, prose("es"), f"l{i // 30}") for i in range(30 * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    clean = {r[0] for r in rows if not 5000 <= r[0] < 6000}
    assert kept <= clean and sorted(clean - kept)[:50] == []


# ---------------------------------------------------------------- 6: id files


def test_op6(spark, docs, rows, library):
    order = sorted(rows)
    got, at = by_id(idfiles.id_digests(docs, PATH)), 0
    for r, ids in zip(order, library_ids(library, [x[1] for x in order], 2), strict=True):
        assert (got[r[0]].start, got[r[0]].n_tokens, got[r[0]].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_id_files_small_blocks_and_single_access(spark, docs, rows, library):
    out = new_path(spark, "test-ids")
    idfiles.write_ids(docs, out, PATH, 2, block_bytes=600, part_docs=9)
    reader = idfiles.Reader(spark, out)
    assert reader.blocks.count() > 10
    text = {r[0]: r[1] for r in rows}
    for i in (0, 3, 7, 1):
        assert reader.one(i) == [library_ids(library, [text[i]], 2)[0].tolist()]
    assert reader.one(999_999) == []
    name = next(iter(reader.dictionaries))
    reader.dictionaries[name] = (False, b"other")
    with pytest.raises(Exception, match="dictionary"):
        reader.one(0)


def test_ids_beyond_16_bits():
    """A vocabulary of 70,000 words: ids keep all their bits."""
    import json
    import tempfile

    vocabulary = {f"w{i}": i for i in range(70_000)}
    library = Tokenizer.from_str(json.dumps({"version": "1.0", "added_tokens": [], "model": {"type": "WordLevel", "vocab": vocabulary, "unk_token": "w0"}}))
    with tempfile.NamedTemporaryFile("w", suffix=".json") as f:
        f.write(library.to_str())
        f.flush()
        assert id_bytes(f.name, 2) == 4
    assert id_bytes(PATH, 2) == 2 and id_bytes(PATH, 70_000) == 4
    ids = np.array([69_999, 3], "<u4")
    assert np.frombuffer(packed(ids.tobytes(), 2, 4), "<u4").tolist() == [69_999, 3, 2]
    assert np.frombuffer(packed(np.array([50_000, 3], "<u4").tobytes(), 2, 2), "<u2").tolist() == [50_000, 3, 2]


def hot_ids(n=600):
    """A third of the rows without an id, a third with the same, and single ones."""
    return [(None if i % 3 == 0 else 77 if i % 3 == 1 else i * 5, f"text {i % 500} of this row") for i in range(n)]


def test_parts_split_hot_ids(spark):
    df = spark.createDataFrame(hot_ids(), "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    parts = range_parts(df, 20)
    got = [(r.part, r.doc_id is not None, r.doc_id or 0, r.h) for r in parts.add(df).collect()]
    assert [p for p, *_ in sorted(got, key=lambda r: r[1:])] == sorted(p for p, *_ in got)  # ascending with id and hash
    assert max(collections.Counter(p for p, *_ in got).values()) < 70
    assert {p for p, *_ in got} <= set(range(parts.count))


def test_id_files_with_hot_ids(spark, library):
    rows = hot_ids()
    out = new_path(spark, "test-hot")
    idfiles.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), out, PATH, 2, part_docs=20)
    reader = idfiles.Reader(spark, out)
    blocks = reader.blocks.orderBy("part", "block").collect()
    ids = [i for b in blocks for i in b.ids]
    assert ids == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert max(len(b.ids) for b in blocks) < 70
    want = sorted(x.tolist() for x in library_ids(library, [t for i, t in rows if i == 77], 2))
    assert sorted(reader.one(77)) == want


# ---------------------------------------------------------------- 7: chunks


def test_boundaries_resist_shifts():
    rng = random.Random(5)
    text = "".join(rng.choices("abcdefghij ", k=5000))
    a, b = chunks.chunk_set(text), chunks.chunk_set("inserted words " + text[:2000] + text[2010:])
    assert chunks.containment(a, b) > 0.9
    ends = [0, *chunks.boundaries(text.encode())]
    sizes = np.diff(ends)
    assert ends[-1] == 5000 and sizes[:-1].min() >= chunks.LEAST and sizes.max() <= chunks.MOST
    assert chunks.from_string(chunks.to_string(a)) == a
    assert chunks.containment({}, {}) == 1.0 and chunks.containment({}, a) == 0.0


def test_op7(docs, rows):
    order = sorted(rows)
    got = by_id(chunks.fingerprint_edits(docs))
    for k, (i, text, *_) in enumerate(order):
        t, after = text or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        a, b, c = chunks.chunk_set(t), chunks.chunk_set(e), chunks.chunk_set(after)
        assert (r.fingerprint, r.edited_fingerprint) == (chunks.to_string(a), chunks.to_string(b))
        assert (r.near_edited, r.near_next) == (chunks.containment(a, b), chunks.containment(a, c))


def test_next_over_many_ranges(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    order = sorted(r[0] for r in rows)
    ids = {r[1] or "": r[0] for r in rows}
    got = chunks.with_next(docs, lambda i, t, n: (i, n), "doc_id long, n string", part_docs=7).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    assert all(r.n == text[order[(order.index(r.doc_id) + 1) % len(order)]] for r in got)
    assert ids


def test_next_with_hot_ids(spark):
    rows = hot_ids()
    got = chunks.with_next(spark.createDataFrame(rows, "doc_id long, text string"), lambda i, t, n: (i, t, n), "doc_id long, t string, n string", part_docs=20).collect()
    assert sorted((r.doc_id or 0, r.t) for r in got) == sorted((i or 0, t) for i, t in rows)
    assert collections.Counter(r.n for r in got) == collections.Counter(t for _, t in rows)  # each follows one
    known = {i: t for i, t in rows if i not in (None, 77)}
    order = sorted(known)
    assert all(r.n == known[order[order.index(r.doc_id) + 1]] for r in got if r.doc_id in known and r.doc_id < order[-1] and r.doc_id > 77)


# ---------------------------------------------------------------- 8: substrings


def plain_removal(rows, window):
    first = {}
    for i, t in sorted((r[0], r[1] or "") for r in rows):
        w = WORD.findall(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out[i] = (len(w), len(gone), [x for k, x in enumerate(w) if k not in gone])
    return out


@pytest.mark.parametrize(("window", "gram"), [(50, 10), (12, 4)])
def test_op8(docs, rows, window, gram):
    want = plain_removal(rows, window)
    got = by_id(substrings.removal_digests(docs, window, gram))
    assert {k: (r.n_words, r.n_removed, r.kept_sha256) for k, r in got.items()} == {k: (n, m, hashlib.sha256(" ".join(kept).encode()).hexdigest()) for k, (n, m, kept) in want.items()}
    assert sum(m for _, m, _ in want.values()) > 500
    cut = {r.doc_id: r.text for r in substrings.dedup_substrings(docs, window, gram).collect()}
    for i, (n, m, kept) in want.items():
        if m:
            assert WORD.findall(cut.get(i, "")) == kept
        else:
            assert cut[i] == next(r[1] for r in rows if r[0] == i)


@pytest.mark.parametrize(("window", "gram"), [(50, 10), (12, 4)])
def test_factors(docs, rows, window, gram):
    """Factors are in the reference as said, long enough, don't go on in one another and cover what brute force removes."""
    words = {r[0]: WORD.findall(r[1] or "") for r in rows}
    want, n = plain_removal(rows, window), 0
    for r in substrings.factors(docs, window, gram).collect():
        gone = set()
        for start, length, ref, at in zip(r.starts, r.lengths, r.refs, r.ref_starts, strict=True):
            own, other = words[r.doc_id], words[ref]
            assert ref < r.doc_id and length >= window and own[start : start + length] == other[at : at + length]
            gone |= set(range(start, start + length))
            n += 1
        assert sorted(r.starts) == r.starts and len(gone) == want[r.doc_id][1]
        step = window - 1  # the windows of a factor begin at its first length - step words
        found = list(zip(r.starts, r.lengths, r.refs, r.ref_starts, strict=True))
        for (s, k, ref, at), (s2, _, ref2, at2) in itertools.pairwise(found):
            assert s + k - step <= s2 and (s + k - step, ref, at + k - step) != (s2, ref2, at2)
    assert n > 10


def test_parse_extends_greedily():
    first, count, ref, at = (np.array(x) for x in ([30, 0, 20, 50], [5, 20, 10, 3], [7, 7, 7, 7], [130, 100, 120, 135]))
    assert [x.tolist() for x in substrings.parse(first, count, ref, at, 50)] == [[0, 50], [84, 52], [7, 7], [100, 135]]
    ref[2] = 8
    assert [x.tolist() for x in substrings.parse(first, count, ref, at, 50)] == [[0, 20, 30, 50], [69, 59, 54, 52], [7, 8, 7, 7], [100, 120, 130, 135]]


def test_op8_repeated_rows(spark):
    """Rows equal in id and text cost no square."""
    rng = random.Random(3)
    passage = " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(120))
    rows = [(1, passage)] + [(2, "before " + passage + " after")] * 800
    got = substrings.removal_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 801 and {(r.doc_id, r.n_words, r.n_removed) for r in got} == {(1, 120, 0), (2, 122, 120)}


# ---------------------------------------------------------------- 9: packing


def check_packing(pieces, ids, window=1024):
    at = collections.Counter()
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        a = ids[r.doc_id]
        assert r.start == at[r.doc_id] and r.doc_tokens == len(a)
        assert r.ids_crc32 == zlib.crc32(a[r.start : r.start + r.length].tobytes())
        at[r.doc_id] += r.length
    assert dict(at) == {i: len(a) for i, a in ids.items()}
    sequences = collections.defaultdict(list)
    for r in pieces:
        sequences[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for s in sequences.values():
        end = 0
        for offset, n in sorted(s):
            assert offset == end
            end += n
        assert end <= window
        padding += window - end if end & (end - 1) else 0
    assert sorted(sequences) == list(range(len(sequences)))
    return padding


def test_op9(docs, rows, library):
    ids = dict(zip((r[0] for r in rows), library_ids(library, [r[1] for r in rows], 0), strict=True))
    assert check_packing(packing.pack_documents(docs, PATH).collect(), ids) == 0
    assert check_packing(packing.pack_documents(docs, PATH, window=64).collect(), ids, 64) == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 63), min_size=0, max_size=400))
def test_plan_places_every_remainder_once(lengths):
    window = 64
    plan = packing.make_plan(np.bincount(lengths, minlength=window), window)
    filled, rank = collections.defaultdict(list), collections.Counter()
    for n in lengths:
        pieces = packing.place(plan, window, n, rank[n])
        rank[n] += 1
        assert sum(k for *_, k in pieces) == n
        for s, offset, k in pieces:
            filled[s].append((offset, k))
    for s in filled.values():
        end = 0
        for offset, k in sorted(s):
            assert offset == end
            end += k
        assert end <= window and (end == window or end & (end - 1) == 0)


def test_patterns_carry_most_of_it():
    rng = np.random.default_rng(1)
    lengths = np.minimum(1023, rng.gamma(2, 150, 100_000).astype(int) + 1)
    h = np.bincount(lengths, minlength=1024)
    plan = packing.make_plan(h, 1024)
    assert plan.residual < 0.25 * (h * np.arange(1024)).sum()


# ---------------------------------------------------------------- 10: sharding


def test_hilbert_curve(spark):
    bits, n = 3, 3
    cells = spark.range(1 << bits * n).select(*[F.shiftright("id", bits * k).bitwiseAND(F.lit(7)).cast("int").alias(f"x{k}") for k in range(n)])
    at = {r.h: (r.x0, r.x1, r.x2) for r in cells.withColumn("h", hilbert.hilbert_index([F.col(f"x{k}") for k in range(n)], bits)).collect()}
    assert sorted(at) == list(range(1 << bits * n))
    assert all(sum(abs(a - b) for a, b in zip(at[h], at[h + 1], strict=True)) == 1 for h in range(len(at) - 1))


def test_op10(docs, rows):
    got = hilbert.assign_shards(docs, shards=7).collect()
    text = {r[0]: r[1] or "" for r in rows}
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id].encode()) + 16, zlib.crc32(text[r.doc_id].encode())) for r in got)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) == set(range(7)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    order = sorted((r.shard, r.slot, r.curve) for r in got)
    assert [c for *_, c in order] == sorted(c for *_, c in order)


def test_op10_cells_and_order(spark):
    """Cells, curve and order written out in plain Python; sources that share a long prefix, a hot source, a row in many copies."""
    rng = random.Random(7)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["en", "fr", None]), "https://site-a" if i % 3 == 0 else f"https://site-{rng.choice('bcdefgh')}") for i in range(300)]
    rows += [(900, "the same", "en", "https://site-a")] * 90
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    bits, shards = 4, 8

    def cells(values):
        count = collections.Counter(values)
        order, at, begins = sorted(count, key=lambda v: (v is not None, v if v is not None else 0)), 0, {}
        for v in order:
            cell = int((at + count[v] / 2) * (1 << bits) // len(values))
            at += count[v]
            if v is not None and cell > 0:
                begins.setdefault(cell, v)
        return [0 if v is None else sum(v >= b for b in begins.values()) for v in values]

    at = [cells([r[2] for r in rows]), cells([r[3] for r in rows]), cells([len((r[1] or "").encode()) + 16 for r in rows])]
    index = spark.createDataFrame([(k, *x) for k, x in enumerate(zip(*at, strict=True))], "k int, a int, b int, c int")
    curve = {r.k: r.h for r in index.select("k", hilbert.hilbert_index([F.col("a"), F.col("b"), F.col("c")], bits).alias("h")).collect()}
    got = hilbert.assign_shards(docs, shards, bits).collect()
    assert sorted((r.doc_id, r.curve) for r in got) == sorted((r[0], curve[k]) for k, r in enumerate(rows))
    assert len({x for x in at[1]}) >= 5
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in ordered] == sorted(curve.values())
    source = {r[0]: r[3] for r in rows}
    assert min(len({source[r.doc_id] for r in got if r.shard == k}) for k in range(shards)) <= 4  # shards differ in their sources


def test_ranks_do_not_depend_on_buckets(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 11).alias("cell"), "id", (F.col("id") % 2 + 1).alias("n"))
    few, many = ({r.id: (r["rank"], r.cell, r.n) for r in hilbert.ranked(df, "cell", ["id"], "n", bucket_rows=k).collect()} for k in (50, 5000))
    assert few == many
    at = 0
    for rank, _, n in sorted(few.values()):
        assert rank == at
        at += n
    assert [c for _, c, _ in sorted(few.values())] == sorted(c for _, c, _ in few.values())


def test_write_shards(spark, docs, rows, tmp_path):
    hilbert.write_shards(docs, str(tmp_path / "s"), shards=5)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(rows) and back.select("shard").distinct().count() == 5


# ---------------------------------------------------------------- 2: line templates


def plain_recurring(rows, depth=3, min_docs=5, min_constant=0.6, min_tokens=3, field_share=0.05, copied_share=0.8):
    """Text to the positions of its dropped lines."""
    lines = []
    for text in {r[1] for r in rows if r[1] is not None}:
        for k, raw in enumerate(text.split("\n")):
            line = re.sub("[ \t\x0b\f\r]+", " ", raw).strip(" ")
            if len(line.split(" ")) >= min_tokens:
                lines.append((text, k, line, tuple("<*>" if re.search("[0-9]", x) else x for x in line.split(" "))))
    leaf = lambda t: (len(t), t[:depth])
    where = collections.defaultdict(set)
    for text, _, line, _ in lines:
        where[line].add(text)
    shared = collections.Counter()
    for text, _, line, _ in lines:
        shared[text] += len(line.encode()) * (len(where[line]) > 1)
    copied = {t for t, n in shared.items() if n and n >= copied_share * len(t.encode())}
    pairs = {(t, text) for text, _, _, t in lines if text not in copied}
    support, total = collections.Counter(), collections.Counter()
    for t, _ in pairs:
        total[leaf(t)] += 1
        for k, x in enumerate(t):
            support[leaf(t), k, x] += 1

    def template(t):
        enough = max(min_docs, field_share * total[leaf(t)])
        shape = tuple(x if k < depth or support[leaf(t), k, x] >= enough else "<*>" for k, x in enumerate(t))
        return shape if sum(x != "<*>" for x in shape) >= min_constant * len(t) else t

    docs = collections.defaultdict(set)
    for t, text in pairs:
        docs[template(t)].add(text)
    gone = collections.defaultdict(set)
    for text, k, _, t in lines:
        if len(docs[template(t)]) >= min_docs:
            gone[text].add(k)
    return gone


def boilerplate(seed=8):
    rng = random.Random(seed)
    filler = lambda: " ".join("".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(rng.randint(4, 12)))
    names = ["Ann", "Bob", "Cid", "Dan"]
    rows = []
    for i in range(40):
        body = [filler() for _ in range(rng.randint(2, 5))]
        if i % 2:
            body.insert(rng.randrange(len(body) + 1), "All rights of this work are reserved by the owner")
        if i % 3 == 0:
            body.insert(rng.randrange(len(body) + 1), f"Posted by user {rng.choice(names)}{i} in the forum on day {rng.randrange(999)} as guest")
        if i % 4 == 0:
            body.insert(rng.randrange(len(body) + 1), f"Sent from the device of {filler().split()[0]} with many kind regards to you all")
        if i % 5 in (0, 1, 2):  # blocks of three to six lines, in the middle, first or last
            block = [f"Clause {'abcdef'[k]} of the licence that most of these files carry" for k in range(3 + i % 4)]
            at = (0, len(body), len(body) // 2)[i % 3]
            body[at:at] = block
        rows.append((i, "\n".join(body)))
    lines = [filler() for _ in range(30)]
    rows += [(100 + i, "\n".join(lines)) for i in range(12)]  # copies, and near copies with an edited line
    rows += [(120 + i, "\n".join([*lines[:i], filler(), *lines[i + 1 :]])) for i in range(20)]
    return rows + [(200, None), (201, ""), (202, "\n\n a b c \n\t\n"), (None, rows[0][1]), (None, "a line of no document with an id")]


def cut(text, gone):
    return "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone.get(text, ()))


def test_op2(spark):
    rows = boilerplate()
    want = plain_recurring(rows)
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    for i in range(40):  # every line of a block goes, and copied documents stay whole
        left = cut(texts[i], want).split("\n")
        assert not any(x.startswith(("Clause", "All rights", "Posted by")) for x in left) and left != [""]
    assert not any(texts[i] in want for i in range(100, 140) if i in texts)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_templates.line_digests(docs).collect())
    plain = lambda i, t: (i or -1, 0 if t is None else t.count("\n") + 1, len(want.get(t, ())), hashlib.sha256(("" if t is None else cut(t, want)).encode()).hexdigest())
    assert got == sorted(plain(*r) for r in rows)


def test_op2_fields_do_not_depend_on_size(spark):
    """Values of a field that are met five times and more each are still one template's."""
    rng = random.Random(2)
    rows = [(i, f"Article posted by {rng.choice('abcdefghijklmnopqrstuvwxyz')}name{'x' * rng.randrange(12)} in the local section\n" + " ".join(rng.choices("abcdefgh", k=12))) for i in range(3000)]
    got = line_templates.line_digests(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("n_dropped = 1").count() == 3000


def test_op2_sql(spark, docs, rows):
    import duckdb
    import pandas as pd

    for own in (boilerplate(), [r[:2] for r in rows]):
        con = duckdb.connect()
        con.register("documents", pd.DataFrame(own, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
        want = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in con.sql(line_templates.DIGESTS_SQL).fetchall())
        got = line_templates.line_digests(spark.createDataFrame(own, "doc_id long, text string")).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == want


def test_op2_on_the_corpus(docs, rows):
    want = plain_recurring(rows)
    got = by_id(line_templates.line_digests(docs))
    assert {i: r.n_dropped for i, r in got.items() if r.n_dropped} == {r[0]: len(want[r[1]]) for r in rows if r[1] in want}


def test_line_dedup_is_native(docs):
    plan = line_templates.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan)


# ---------------------------------------------------------------- 1: site quality


def labelled(spark, n=400, seed=9):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        site = "bad.example" if i % 4 == 0 else f"s{i % 7}"
        good = rng.random() > (0.8 if site == "bad.example" else 0.1)
        text = " ".join(("".join(rng.choices("abcde", k=4)) if good else "".join(rng.choices("ABC%$", k=4))) for _ in range(rng.randint(5, 30)))
        rows.append((i, text, "en", site))
        if i % 2:
            labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_op1_held_out_accuracy(spark):
    docs, labels, rows = labelled(spark)
    *_, accuracy = site_quality.fit(docs, labels)
    assert accuracy > 0.95
    got = by_id(site_quality.rate(docs, labels))
    truth = {i: text.islower() for i, text, *_ in rows}
    unlabelled = [i for i in truth if i % 2 == 0]
    assert len(got) == len(rows)
    assert sum(got[i].kept == truth[i] for i in unlabelled) > 0.95 * len(unlabelled)


def test_op1_shrinks_small_sites(spark):
    docs, labels, _ = labelled(spark)
    extra = spark.createDataFrame([(9999, "ABC% $$AB CCAB", "en", "tiny")], docs.schema)
    got = by_id(site_quality.rate(docs.union(extra), labels))
    tiny, bad = got[9999], next(r for r in got.values() if r.host == "bad.example")
    prior = sum(1 / (1 + np.exp(-r.evidence)) for r in got.values()) / len(got)
    assert bad.host_posterior < tiny.host_posterior  # one document says less than a hundred
    assert abs(tiny.path_posterior - tiny.host_posterior) < 0.2 and bad.host_posterior < prior


def test_op1_posteriors(spark):
    """Sites' posteriors written out in plain Python from the evidence."""
    docs, labels, _ = labelled(spark)
    got = site_quality.rate(docs, labels).collect()
    p = [1 / (1 + np.exp(-r.evidence)) for r in got]
    prior = sum(p) / len(p)

    def strength(groups, means):
        n = sum(len(g) for g in groups)
        v = sum(len(g) * (np.mean(g) - m) ** 2 for g, m in zip(groups, means, strict=True))
        e = sum(m * (1 - m) for m in means)
        within = sum(len(g) * m * (1 - m) for g, m in zip(groups, means, strict=True)) / n
        return min(max(within / max((v - e) / n, 1e-6) - 1, 1.0), 1e5)

    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for r, x in zip(got, p, strict=True):
        hosts[r.host].append(x)
        paths[r.host, r.path].append(x)
    k = strength(list(hosts.values()), [prior] * len(hosts))
    host = {h: (sum(g) + k * prior) / (len(g) + k) for h, g in hosts.items()}
    kp = strength(list(paths.values()), [host[h] for h, _ in paths])
    logit = lambda x: np.log(x / (1 - x))
    for r, x in zip(got, p, strict=True):
        g = paths[r.host, r.path]
        path = (sum(g) - x + kp * host[r.host]) / (len(g) - 1 + kp)
        quality = 1 / (1 + np.exp(-(r.evidence + 0.5 * (logit(path) - logit(prior)))))
        assert abs(r.host_posterior - host[r.host]) < 1e-9 and abs(r.path_posterior - path) < 1e-9
        assert abs(r.quality - quality) < 1e-9 and r.kept == (quality >= 0.5)


def test_op1_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept and r.evidence == 0 for r in site_quality.rate(docs, none).collect())


# ---------------------------------------------------------------- odd tables


OPERATORS = {
    "op1": lambda spark, d: site_quality.rate(d, spark.createDataFrame([(0, 1, 0), (3, 0, 0), (6, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")),
    "op2": lambda spark, d: line_templates.line_digests(d),
    "op3": lambda spark, d: quality_rules.judge(d),
    "op4": lambda spark, d: bpe.digests(d, PATH),
    "op5": lambda spark, d: simhash.simhash_groups(d),
    "op6": lambda spark, d: idfiles.id_digests(d, PATH),
    "op7": lambda spark, d: chunks.fingerprint_edits(d),
    "op8": lambda spark, d: substrings.removal_digests(d),
    "op10": lambda spark, d: hilbert.assign_shards(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row_of_odd_tables(spark, odd, name):
    out = OPERATORS[name](spark, odd).collect()
    assert len(out) == odd.count()
    same = [r for r in out if r.doc_id == 1000]
    assert len(same) == 3


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, empty, name):
    assert OPERATORS[name](spark, empty).count() == 0


def test_packing_of_odd_and_empty_tables(spark, odd, empty, library):
    pieces = packing.pack_documents(odd, PATH).collect()
    want = library_ids(library, [r.text for r in odd.collect()], 0)
    assert sum(r.length for r in pieces) == sum(map(len, want))
    assert packing.pack_documents(empty, PATH).count() == 0


def test_filters_keep_columns_of_odd_tables(spark, odd, empty):
    for f in (quality_rules.keep_sound, line_templates.dedup_lines, simhash.near_dedup, substrings.dedup_substrings):
        out = f(odd)
        assert out.columns == odd.columns and 0 < out.count() <= odd.count()
        assert f(empty).count() == 0


@pytest.mark.parametrize("names", [["_id", "_row", "_gone", "gone", "starts"], ["d", "k_doc_id", "k_mix", "v_starts", "lengths"]])
def test_filters_keep_clashing_columns(spark, rows, names, tmp_path):
    """Columns with the names that operators use inside come out as they went in."""
    df = spark.createDataFrame(rows[:25] + ODD, SCHEMA)
    for c in names:
        df = df.withColumn(c, F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    for f in (quality_rules.keep_sound, line_templates.dedup_lines, simhash.near_dedup, substrings.dedup_substrings):
        out = f(df)
        assert out.columns == df.columns
        assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for r in out.collect() for c in names)
    hilbert.write_shards(df.withColumn("shard", F.lit("own")), str(tmp_path / "s"), shards=3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert set(back.columns) == {*df.columns, "shard", "shard_"} and back.count() == df.count() and {r["shard"] for r in back.collect()} == {"own"}


def test_pipeline_of_an_empty_table(spark, empty, tmp_path):
    import corpus_pipeline

    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline(spark, docs, tmp_path, library):
    """Each stage against brute force on its own input."""
    import corpus_pipeline

    d = str(tmp_path / "sf")
    docs.write.parquet(f"{d}/documents.parquet")
    held, stages = spark.read.parquet(f"{d}/documents.parquet"), dict(corpus_pipeline.STAGES)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = held.collect()
        held = stage(spark, held, d)
        assert held.columns == list(corpus_pipeline.COLUMNS)
        held.write.parquet(f"{d}/stage{k}")
        held = spark.read.parquet(f"{d}/stage{k}")
        after = {r.doc_id: r.text for r in held.collect()}
        was = {r.doc_id: r.text for r in before}
        rows = [(r.doc_id, r.text) for r in before]
        if name == "quality rules":
            verdict = plain_judge([(r.doc_id, r.text, r.lang) for r in before])
            assert after == {i: t for i, t in was.items() if verdict[i][2]}
        elif name == "line dedup":
            gone = plain_recurring(rows)
            left = {i: cut(t, gone) for i, t in was.items()}
            assert after == {i: t for i, t in left.items() if t == was[i] or t.strip(" ")}
        elif name == "near dedup":
            root = plain_near_groups({r.doc_id: r.text for r in before})
            assert after == {i: t for i, t in was.items() if root.get(i, i) == i}
            assert len(set(after.values())) == len(after)
        else:
            want = plain_removal(rows, 50)
            assert {i: WORD.findall(t) for i, t in after.items()} == {i: kept for i, (n, m, kept) in want.items() if kept or not m}
        assert held.where("text is not null and n_chars <> length(text)").count() == 0
    assert list(stages) == ["quality rules", "line dedup", "near dedup", "substring dedup", "packing"]
    last = held.collect()
    ids = dict(zip((r.doc_id for r in last), library_ids(library, [r.text for r in last], 0), strict=True))
    out = corpus_pipeline.run(spark, d).collect()
    assert check_packing(out, ids) == 0
