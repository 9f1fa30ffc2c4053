"""Token counts by heap-and-linked-list byte-pair merging.

A word's symbols form a doubly linked list; a heap holds the adjacent pairs that have a merge rank.  The
lowest-ranked pair is popped and merged until none is left, so the word's tokens are its first symbols minus
the merges made, and no token identifiers are ever produced.  Each worker keeps the counts of words, and of
pieces between spaces, that it has seen in tables of bounded size, since words repeat far more often than they differ.

Defined results: a null or empty text has 0 bytes and 0 tokens; texts of any length are read whole; repeated
rows give repeated rows; input columns named like an output column are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .rows import append

#: Words, and pieces, whose counts a worker remembers before it starts anew.
CACHE_WORDS = 400_000

_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+", regex.V1)


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte: printable Latin-1 stands for
    itself, the other bytes for the characters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Merges:
    """Merge ranks over numbered symbols: a pair of symbols is one number, its value the rank of its merge."""

    def __init__(self, merges: list[str]) -> None:
        number: dict[str, int] = {}
        pairs = [m.split(" ") for m in merges]
        for a, b in pairs:
            for x in (a, b, a + b):
                number.setdefault(x, len(number))
        self.number = number
        self.rank = {number[a] << 24 | number[b]: r for r, (a, b) in enumerate(pairs)}
        self.made = [number[a + b] for a, b in pairs]

    def count(self, symbols: list[str]) -> int:
        """Tokens left of ``symbols`` after all merges, lowest rank first, leftmost among equals."""
        n = len(symbols)
        if n < 2:
            return n
        rank, made = self.rank.get, self.made
        part = [self.number.get(s, -1) for s in symbols]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        best = [-1 if a < 0 or b < 0 else rank(a << 24 | b, -1) for a, b in zip(part, part[1:], strict=False)] + [-1]
        heap = [r << 32 | i for i, r in enumerate(best) if r >= 0]
        heapify(heap)
        while heap:
            top = heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            if best[i] != r:  # an earlier merge took one of the two
                continue
            j = right[i]
            part[i], best[j] = made[r], -1
            right[i] = k = right[j]
            n -= 1
            best[i] = -1
            if k < len(part):
                left[k] = i
                if part[k] >= 0 and (x := rank(part[i] << 24 | part[k])) is not None:
                    best[i] = x
                    heappush(heap, x << 32 | i)
            if (h := left[i]) >= 0:
                x = rank(part[h] << 24 | part[i]) if part[h] >= 0 else None
                best[h] = -1 if x is None else x
                if x is not None:
                    heappush(heap, x << 32 | h)
        return n


class Remembered(dict):
    """What ``of`` gives for a key, worked out on first use.

    When the table is full it becomes the old one, from which keys still in use are taken over; so its size is
    bounded and frequent keys stay.
    """

    def __init__(self, of: Callable[[str], int]) -> None:
        super().__init__()
        self.of, self.old = of, {}

    def __missing__(self, key: str) -> int:
        total = self.old.get(key)
        if total is None:
            total = self.of(key)
        if len(key) < 200:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[key] = total
        return total


class WordCounts(Remembered):
    """Tokens of a piece of text without spaces or line feeds. Pieces that differ in case or in the marks around a
    word share what is remembered of the word."""

    def __init__(self, merges: list[str], specials: list[str]) -> None:
        super().__init__(self.count)
        self.merges, self.words = Merges(merges), Remembered(self.count_word)
        self.symbols = byte_symbols()
        self.specials = regex.compile("|".join(map(regex.escape, specials))) if specials else None

    def count_word(self, word: str) -> int:
        symbols = list(word) if word.isascii() and word.isalpha() else [self.symbols[b] for b in word.encode()]
        symbols[-1] += "</w>"
        return self.merges.count(symbols)

    def count(self, piece: str) -> int:
        if piece.isascii() and piece.isalpha():  # one word of plain letters
            return self.words[piece.lower()]
        total, parts = 0, [piece]
        if self.specials is not None and self.specials.search(piece):
            total, parts = len(self.specials.findall(piece)), self.specials.split(piece)
        for part in parts:
            # lower-casing is by character: a final sigma stays a plain one
            low = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            total += sum(map(self.words.__getitem__, _SPLIT.findall(low)))
        return total


#: Tables of this worker process, by vocabulary; they outlive its tasks.
_TABLES: dict[int, WordCounts] = {}


def read_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Merges in rank order and the special strings of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    merges = [m if isinstance(m, str) else " ".join(m) for m in whole["model"]["merges"]]
    return merges, [t["content"] for t in whole["added_tokens"]]


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text", limit: int = 2048, keep: list[str] | None = None) -> DataFrame:
    """``df`` with n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of ``text``.

    ``vocabulary`` is the path of a tokenizer file of the lower-casing kind with word-end marks; the driver
    reads it once and broadcasts its merges (a vocabulary's size is fixed: about 1 MB).
    """
    known = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    name = str(known.value).__hash__()
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]

    def count(texts: pa.Array) -> list:
        if name not in _TABLES:
            _TABLES[name] = WordCounts(*known.value)
        look, n_bytes, n_tokens = _TABLES[name].__getitem__, [], []
        for x in texts.to_pylist():
            x = x or ""
            n_bytes.append(len(x.encode()))
            n_tokens.append(sum(map(look, x.replace("\n", " ").split(" "))))
        return [n_bytes, n_tokens, [n > limit for n in n_tokens]]

    return append(df, text, fields, count, keep)
