"""Token ids of whole texts with the tokenizers library, through a cache of space-separated pieces.

The byte-level pre-tokenizer always starts a new pre-token at a single space between two characters that are not white
space, at a single newline between two such characters, and where a run of letters meets ASCII punctuation. So a text can
be cut there, and each distinct piece need be encoded only once; the ids of a text are those of its pieces, joined. A text
with any other white space (runs, tabs, leading or trailing) is encoded as a whole. The vocabulary file is a parameter.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from itertools import chain
from operator import attrgetter

import numpy as np

from spanloom.llm.common import Bounded

_EDGE = re.compile(r"[!-~\w]")
_SPACE = re.compile(r"\s")
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # all ASCII punctuation but the apostrophe, which could begin a contraction
_BEYOND_LATIN = "\u0250"  # letters below are letters in any version of Unicode
_NEWLINE = "  "  # the key of a newline between two lines; no piece has two spaces


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (chr(256 + i) for i in range(256 - len(own)))
    return [chr(b) if b in own else next(rest) for b in range(256)]


_LETTERS = dict(enumerate(byte_letters()))


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Pieces(dict):
    """Ids by piece. A piece that is missing is met by ``meet``, which gives None for those that have to be learnt."""

    def __init__(self, meet: Callable[[str], bytes | bool | None]):
        super().__init__()
        self.meet = meet

    def __missing__(self, piece: str) -> bytes | bool | None:
        ids = self.meet(piece)
        if ids is not None:
            self[piece] = ids
        return ids


class PieceEncoder:
    """``encode(texts)``: ids as little-endian unsigned 32-bit integers. ``encode_many(list of str)`` gives lists of ids.

    A key of the cache is a piece that follows a space, or a space and a piece that follows none. False: it holds white
    space that may join with its neighbours'. When the cache is full, what was not used since the last time goes.
    ``encode_word(word, spaced)``, if given, encodes a run of Latin letters, with a space before it or none: always a single pre-token.
    With it, most pieces are encoded where they are first looked up; the others, and all without it, are learnt together.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[list[int]]], cached: int = 200_000, encode_word: Callable[[str, bool], bytes] | None = None):
        self.encode_many, self.cached, self.encode_word = encode_many, cached, encode_word
        self.newline = self._bytes(["\n"])[0]
        self.young, self.old = _Pieces(self._meet), {}
        self.unknown: set[str] = set()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.young) > self.cached:
            self.old, self.young = self.young, _Pieces(self._meet)
        split = []
        for t in texts:
            words = t.split(" ") if t else []
            if words:
                words[0] = " " + words[0]
            split.append(words)
        if not self.encode_word:
            self._learn(set(chain.from_iterable(split)).difference(self.young))
        out = self._joined(split)
        if self.unknown:
            late = [k for k, ids in enumerate(out) if ids is None]
            self._learn(self.unknown)
            self.unknown = set()
            for k, ids in zip(late, self._joined([split[k] for k in late]), strict=True):
                out[k] = ids
        whole = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(whole, self._bytes([texts[k] for k in whole]), strict=True):
            out[k] = ids
        return out

    def _joined(self, split: list[list[str]]) -> list[bytes | None]:
        """The ids of each text; None where a piece is False or unknown."""
        get = self.young.__getitem__
        out: list[bytes | None] = []
        for words in split:
            try:
                out.append(b"".join(map(get, words)))
            except TypeError:
                out.append(None)
        return out

    def _meet(self, piece: str) -> bytes | bool | None:
        """A new piece: from the old cache, or spelt; else it is noted as unknown."""
        ids = self.old.get(piece) if self.old else None  # not by [], which would meet it again
        if ids is None and (word := self.encode_word):
            spaced = piece[:1] != " "
            core = piece if spaced else piece[1:]
            ids = word(core, spaced) if core.isalpha() and core.isascii() else self._spell(core, spaced)
        if ids is None:
            self.unknown.add(piece)
        return ids

    def _learn(self, new: set[str]) -> None:
        """Adds the keys in ``new``: from the old cache, or encoded, or joined from the parts they are cut into."""
        young, old = self.young, self.old
        known = new & old.keys()
        young.update(zip(known, map(old.__getitem__, known), strict=True))
        atoms, cuts = [], []
        for p in new - known:
            if (p[1:] if p[:1] == " " else p).isalpha():
                atoms.append(p)
            elif (cut := self._cut(p)) is None:
                young[p] = False
            elif len(cut) == 1:
                atoms.append(p)
            else:
                cuts.append((p, cut))
        young[_NEWLINE] = self.newline
        parts = set(chain.from_iterable(cut for _, cut in cuts)).difference(young).difference(atoms)
        known = parts & old.keys()
        young.update(zip(known, map(old.__getitem__, known), strict=True))
        atoms += parts - known
        young.update(zip(atoms, self._bytes([p[1:] if p[0] == " " else " " + p for p in atoms]), strict=True))
        for p, cut in cuts:
            young[p] = b"".join(map(young.__getitem__, cut))

    def _spell(self, core: str, spaced: bool) -> bytes | None:
        """The ids of lines that are each a Latin word and ASCII punctuation after it or none, without keeping their parts; None for all else."""
        young, ids = self.young, b""
        for line in core.split("\n"):
            bare = line.rstrip(_TAIL)
            if not bare.isalpha() or not (bare.isascii() or max(bare) < _BEYOND_LATIN):
                return None
            ids += (spaced and young.get(bare)) or self.encode_word(bare, spaced)
            if bare != line:
                tail = " " + line[len(bare) :]
                if tail not in young:
                    young[tail] = self._bytes([tail[1:]])[0]
                ids += young[tail]
            ids += self.newline
            spaced = False
        return ids[: -len(self.newline)]

    @staticmethod
    def _cut(piece: str) -> list[str] | None:
        """Keys of parts that are encoded on their own; None if white space may join with the neighbours'."""
        out = []
        first, lead = (1, " ") if piece[:1] == " " else (0, "")
        if not piece[first:]:
            return None
        for line in piece[first:].split("\n"):
            if out:
                out.append(_NEWLINE)
                lead = " "
            if not (line and _EDGE.match(line[0]) and _EDGE.match(line[-1])) or _SPACE.search(line):
                return None
            core = line.rstrip(_TAIL)
            out += [lead + core, " " + line[len(core) :]] if core.isalpha() and core != line else [lead + line]
        return out

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in self.encode_many(texts)] if texts else []


def _library(path: str) -> PieceEncoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    tokenize, space, number = t.model.tokenize, _LETTERS[32], attrgetter("id")

    def encode_word(word: str, spaced: bool) -> bytes:
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
        return array("I", list(map(number, tokenize(space + letters if spaced else letters)))).tobytes()

    return PieceEncoder(lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)], encode_word=encode_word)


def id_bytes(path: str, end_id: int) -> int:
    """Bytes that an id of this vocabulary, or the end id, needs: 2 or 4."""
    from tokenizers import Tokenizer

    return 2 if max(end_id, *Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) < 1 << 16 else 4


def packed(ids: bytes, end_id: int, size: int) -> bytes:
    """32-bit ids and an end id in ``size`` bytes each."""
    if size == 4:
        return ids + end_id.to_bytes(4, "little")
    return np.frombuffer(ids, "<u2")[::2].tobytes() + end_id.to_bytes(2, "little")


_encoders = Bounded(_library, 4)


def encoder(path: str) -> PieceEncoder:
    """The encoder of this worker for a vocabulary file."""
    return _encoders[path]
