"""BPE by speculation: propose the longest matching tokens, verify each adjacent pair, merge exactly only where that fails.

A token sequence is what exact merging gives if and only if each adjacent pair is: merging the bytes of two neighbours
must give the two back. For a proposal this is tested for all pairs of all words at once: a pair is unwound by undoing
merges from its seam, the younger of the two tokens first, and it fails if at any step the two could have been merged by
an older rule than the one undone. Ids must be numbered in merge order, which the loader checks.

Null text: no ids. Empty text: no ids, decoded to the empty text. Special tokens in a text become their ids, as in the
tokenizers library with its defaults. A very long word costs n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.llm.common import Bounded, arrow_schema, map_arrow, record_batch
from spanloom.llm.tokens import PieceEncoder, byte_letters

_SPACE = r"\t-\r \x85\xa0  -     　"
#: The byte-level pre-tokenizer's pattern; fixed values.
PRE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


class Bpe:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        letters = byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        vocab, merges = j["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in j["model"]["merges"]]
        plain = lambda t: bytes(map(to_byte.__getitem__, t))
        self.ids = {plain(t): i for t, i in vocab.items()}
        self.special = {a["content"]: a["id"] for a in j["added_tokens"]}
        self.bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in self.ids.items():
            self.bytes[i] = t
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        n = len(self.bytes)
        self.left, self.right = np.arange(n), np.arange(n)
        keys = []
        for k, (a, b) in enumerate(merges):
            i, a, b = vocab[a + b], vocab[a], vocab[b]
            if i != 256 + k or max(a, b) >= i:
                raise ValueError("ids are not numbered in merge order")
            self.left[i], self.right[i] = a, b
            keys.append((a << 32) | b)
        self.pair_key = np.array(keys, np.int64)
        order = np.argsort(self.pair_key)
        self.pair_key, self.pair_id = self.pair_key[order], 256 + order
        self.merged = dict(zip(self.pair_key.tolist(), self.pair_id.tolist(), strict=True))
        self.longest = max(map(len, self.ids))
        self.pre = regex.compile(PRE)
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.fast = PieceEncoder(self.encode_many)

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, ids = [], 0, self.ids
        while at < len(word):
            end = min(len(word), at + self.longest)
            while (i := ids.get(word[at:end])) is None:
                end -= 1
            out.append(i)
            at = end
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether exact merging of the two tokens' bytes gives the two tokens, for all pairs at once."""
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            key = (a << 32) | b
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            bad = (self.pair_key[at] == key) & (self.pair_id[at] < limit)
            ok[live[bad]] = False
            # Undo the younger merge at the seam; where that side is a single byte, the other one.
            left_turn = np.where(a > b, self.right[a] != a, self.left[b] == b)
            done = np.where(left_turn, self.right[a] == a, self.left[b] == b)
            new_limit = np.where(left_turn, a, b + 1)
            na, nb = np.where(left_turn, self.right[a], a), np.where(left_turn, b, self.left[b])
            go = ~(bad | done)
            live, a, b, limit = live[go], na[go], nb[go], new_limit[go]
        return ok

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the oldest rule first, the leftmost place first."""
        ids = [self.ids[word[i : i + 1]] for i in range(len(word))]
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        get = self.merged.get
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get((ids[i] << 32) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = m, False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := get((m << 32) | ids[k])) is not None:
                    heapq.heappush(heap, (x, i, m, ids[k]))
            if (h := before[i]) >= 0 and (x := get((ids[h] << 32) | m)) is not None:
                heapq.heappush(heap, (x, h, ids[h], m))
        return [x for x, yes in zip(ids, alive, strict=True) if yes]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        said = [self.propose(w) for w in words]
        flat = np.fromiter((i for s in said for i in s), np.int64)
        if len(flat) < 2:
            return said
        word = np.repeat(np.arange(len(said)), [len(s) for s in said])
        within = word[1:] == word[:-1]
        pairs, back = np.unique((flat[:-1] << 32) | flat[1:], return_inverse=True)
        bad = within & ~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
        for w in np.unique(word[1:][bad]).tolist():
            said[w] = self.merge(words[w])
        return said

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        seen: dict[bytes, int] = {}
        plans: list[list[int]] = []  # word numbers; specials as their negative id less one
        for t in texts:
            plan, at = [], 0
            for m in [*self.cut.finditer(t), None]:
                for w in self.pre.findall(t[at : m.start() if m else len(t)]):
                    plan.append(seen.setdefault(w.encode(), len(seen)))
                if m:
                    plan.append(-1 - self.special[m[0]])
                    at = m.end()
            plans.append(plan)
        words = self.encode_words(list(seen))
        return [[i for w in plan for i in ((-1 - w,) if w < 0 else words[w])] for plan in plans]

    def decode(self, ids: bytes) -> str:
        """Text of little-endian 32-bit ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_made = Bounded(Bpe, 4)


def bpe(path: str) -> Bpe:
    return _made[path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian 32-bit), decoded (string): a row for each row; other columns are left out."""
    schema = arrow_schema("doc_id long, ids binary, decoded string")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        coder = bpe(path)
        ids = coder.fast.encode(b.column(1).to_pylist())
        return record_batch(schema, b.column(0), ids, [coder.decode(x) for x in ids])

    return map_arrow(docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text"), run, "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what ``encode_decode`` gives, without passing the texts on."""
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema = arrow_schema(ddl)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        coder = bpe(path)
        ids = coder.fast.encode(b.column(1).to_pylist())
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return record_batch(schema, b.column(0), [len(x) // 4 for x in ids], [sha(x) for x in ids], [sha(coder.decode(x).encode()) for x in ids])

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run, ddl)
