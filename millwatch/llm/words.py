"""Vectorised word splitting and hashing of Arrow string columns.

Words are runs of bytes that a 256-entry table marks as word bytes.  Both word classes in use treat every
byte of a non-ASCII UTF-8 character alike, so splitting bytes gives the same words as splitting characters.
Texts are handled in pieces of a few MB, cut between words, so memory is bounded by the number of words of a
batch and the longest single word, not by the length of a text times a large factor.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
PIECE_BYTES = 2 << 20
#: Odd multiplier of the polynomial word hash.
BASE = 0x9E3779B97F4A7C15 | 1

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
LOWER = _lower
#: `[^\x20\x09-\x0D]+`
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


class Words(NamedTuple):
    """Words of a batch in text order: hash, and the row each belongs to; ``first[r]`` is row r's first word.
    ``start`` and ``size``: their bytes in the batch."""

    hash: np.ndarray
    row: np.ndarray
    first: np.ndarray
    start: np.ndarray
    size: np.ndarray


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string array; nulls are empty texts."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], at - at[0] if len(at) else np.zeros(1, np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> np.ndarray:
    p = np.full(n, BASE, dtype=U64)
    p[0] = 1
    return np.multiply.accumulate(p)


_POW = _powers(256)


def _piece(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, hashes and sizes of the words of one piece."""
    global _POW
    edge = np.flatnonzero(np.diff(np.concatenate(([False], is_word, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, np.zeros(0, U64), start
    longest = int((end - start).max())
    if longest > len(_POW):
        _POW = _powers(2 * longest)
    at = np.flatnonzero(is_word)
    size = end - start
    ahead = np.concatenate(([0], np.cumsum(size)[:-1]))
    value = data[at].astype(U64) + U64(1)
    value *= _POW[np.arange(len(at)) - np.repeat(ahead, size)]
    return start, mix(np.add.reduceat(value, ahead) ^ size.astype(U64) << U64(48)), size


def split(column: pa.Array, table: np.ndarray, lower: bool) -> Words:
    """All words of every row; ``table`` marks word bytes (after lower-casing A-Z if asked)."""
    data, at = utf8(column)
    n = len(at) - 1
    starts, hashes, sizes, low = [], [], [], 0
    ends = at[1:]
    while low < len(data):
        high = min(len(data), low + PIECE_BYTES)
        piece = LOWER[data[low:high]] if lower else data[low:high]
        is_word = table[piece]
        if high < len(data) and is_word[-1]:  # a word may go on: end the piece where a row or a word ends
            row_end = at[np.searchsorted(at, high, "right") - 1]
            gaps = np.flatnonzero(~is_word)
            cut = max(int(row_end) - low, int(gaps[-1]) + 1 if len(gaps) else 0)
            if cut > 0:
                high, piece, is_word = low + cut, piece[:cut], is_word[:cut]
            else:  # one word longer than a piece: take it whole
                stop = high
                limit = int(ends[np.searchsorted(ends, low, "right")])
                while stop < limit:
                    more = data[stop : min(limit, stop + PIECE_BYTES)]
                    more_is = table[LOWER[more] if lower else more]
                    if not more_is.all():
                        stop += int(np.argmin(more_is))
                        break
                    stop += len(more)
                high = stop
                piece = LOWER[data[low:high]] if lower else data[low:high]
                is_word = table[piece]
        # words never join across rows: split at row borders inside the piece
        inner = at[(at > low) & (at < high)] - low
        joined = inner[is_word[inner] & is_word[inner - 1]]
        if len(joined):
            cuts = np.unique(joined)
            wide_piece = np.insert(piece, cuts, 0)
            wide_is = np.insert(is_word, cuts, False)
            s, h, z = _piece(wide_piece, wide_is)
            s = s - np.searchsorted(cuts + np.arange(1, len(cuts) + 1), s, "right")
        else:
            s, h, z = _piece(piece, is_word)
        starts.append(s + low)
        hashes.append(h)
        sizes.append(z.astype(np.int32))
        low = high
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    value = np.concatenate(hashes) if hashes else np.zeros(0, U64)
    first = np.searchsorted(start, at)
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int32)
    return Words(value, np.repeat(np.arange(n, dtype=np.int32), np.diff(first)), first, start, size)


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k consecutive words of a row, and the index of its first word; rows with 1 to k - 1 words
    have none."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(words.row[:n] == words.row[k - 1 :])
    total = np.zeros(len(at), U64)
    for j in range(k):
        total = (total + words.hash[at + j]) * U64(BASE)
    return mix(total ^ U64(k)), at


def small_batches(batch: pa.RecordBatch, text: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; a longer text is a slice of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    total, low = np.cumsum(size), 0
    while low < len(size):
        before = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(low, high - low)
        low = high
