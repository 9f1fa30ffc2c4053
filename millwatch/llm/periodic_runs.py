"""Runs of words that repeat with a period, found by block convolution.

A run is a stretch of consecutive words with smallest period q, of at least max(24, 3 q) words, that no neighbouring
word extends keeping period q.  At each dyadic scale [D, 2 D) of periods a text is cut into aligned blocks of
max(8, D) words.  Every run with a period of that scale holds a whole block and its copy one period on (its length less
q is at least twice the block less one).  So the sum of squared differences between a block and its place in the
window that follows, for all distances of the scale at once an exact number-theoretic transform modulo a prime, is zero
at the distance q.  Such distances are seeds: the words themselves, compared outwards from the block, give the run,
so that a sum that is zero modulo the prime only adds a comparison.  A block with a word that does not come again
within the scale matches nowhere and is not transformed; a seed within a run already known has a multiple of its period.
Blocks of over 2^15 words are told by their first 2^15, so memory is bounded whatever the scale.

Each text is searched in its row, in O(n log^2 n); there is no shuffle.

Defined results: a null or empty text has no words, no run, and the collapsed text ''; texts of any length are read
whole; repeated rows give repeated rows; input columns named like an output column are replaced; an empty table
gives no rows; a row without id is not rewritten by ``rewritten``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import append

#: Words of the smallest block, and words by which a block is told at most.
LEAST_BLOCK, MOST_BLOCK = 8, 1 << 15
LEAST_LENGTH, LEAST_EXPONENT = 24, 3
#: Numbers transformed at once.
CHUNK = 1 << 18

#: A prime with roots of unity of order 2^27, and a generator of its units.
PRIME, GENERATOR = 15 * 2**27 + 1, 31
_P = np.uint64(PRIME)
_ROOTS: dict[tuple[int, bool], np.ndarray] = {}

Run = tuple[int, int, int]


def _roots(n: int, inverse: bool) -> np.ndarray:
    """The first n / 2 powers of a primitive n-th root of unity, or of its inverse."""
    if (n, inverse) not in _ROOTS:
        root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
        root = pow(root, -1, PRIME) if inverse else root
        powers, step = np.ones(1, np.uint64), root
        while len(powers) < n // 2:  # doubled: the next half is this one times root^len
            powers = np.concatenate((powers, powers * np.uint64(pow(step, len(powers), PRIME)) % _P))
        _ROOTS[n, inverse] = powers
    return _ROOTS[n, inverse]


def _forward(x: np.ndarray) -> np.ndarray:
    """Transform of each row in place, in bit-reversed order."""
    half = x.shape[1] // 2
    while half:
        v = x.reshape(len(x), -1, 2, half)
        a, b = v[:, :, 0].copy(), v[:, :, 1].copy()
        v[:, :, 0] = (a + b) % _P
        v[:, :, 1] = (a + _P - b) % _P * _roots(2 * half, False) % _P
        half //= 2
    return x


def _backward(x: np.ndarray) -> np.ndarray:
    """The inverse of ``_forward``."""
    half = 1
    while half < x.shape[1]:
        v = x.reshape(len(x), -1, 2, half)
        a, b = v[:, :, 0].copy(), v[:, :, 1] * _roots(2 * half, True) % _P
        v[:, :, 0] = (a + b) % _P
        v[:, :, 1] = (a + _P - b) % _P
        half *= 2
    return x * np.uint64(pow(x.shape[1], -1, PRIME)) % _P


def squared_differences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For each row the sums of (block - window at offset o)^2 modulo PRIME, for every offset at which the block fits."""
    size, offsets = blocks.shape[1], windows.shape[1] - blocks.shape[1] + 1
    n = 1 << (windows.shape[1] - 1).bit_length()
    a, b = np.zeros((len(blocks), n), np.uint64), np.zeros((len(blocks), n), np.uint64)
    a[:, :size], b[:, : windows.shape[1]] = blocks[:, ::-1] % _P, windows % _P
    own = (a * a % _P).sum(axis=1, keepdims=True) % _P
    total = np.cumsum(np.pad(b * b % _P, ((0, 0), (1, 0))), axis=1)  # under 2^31 each: sums stay far below 2^64
    theirs = (total[:, size : size + offsets] - total[:, :offsets]) % _P
    # what wraps around falls on the first size - 1 numbers only
    product = _backward(_forward(a) * _forward(b) % _P)[:, size - 1 : size - 1 + offsets]
    return (own + theirs + 2 * (_P - product)) % _P


def _seeds(ids: np.ndarray, starts: np.ndarray, size: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block start, distance) with low <= distance < high at which a block of ``size`` words comes again."""
    n, unused = len(ids), ids.max() + 1
    for begin in range(low, high, size):
        count = min(size, high - begin)
        rows = max(1, CHUNK // (2 * size))
        for k in range(0, len(starts), rows):
            s = starts[k : k + rows]
            at = s[:, None] + begin + np.arange(size + count - 1)
            window = np.where(at < n, ids[np.minimum(at, n - 1)], unused)
            row, offset = np.nonzero(squared_differences(ids[s[:, None] + np.arange(size)].astype(np.uint64), window.astype(np.uint64)) == 0)
            yield s[row], offset + begin


def _stretch(ids: np.ndarray, low: int, high: int, d: int) -> tuple[int, int]:
    """The largest [l, r) around [low, high) in which every word equals that d words on; empty if that one isn't so."""
    if (ids[low:high] != ids[low + d : high + d]).any():
        return low, low
    step = 64
    while high + d < len(ids):
        m = min(step, len(ids) - d - high)
        other = ids[high : high + m] != ids[high + d : high + d + m]
        if other.any():
            high += int(other.argmax())
            break
        high, step = high + m, 2 * step
    step = 64
    while low > 0:
        m = min(step, low)
        other = (ids[low - m : low] != ids[low - m + d : low + d])[::-1]
        if other.any():
            low -= int(other.argmax())
            break
        low, step = low - m, 2 * step
    return low, high


def runs_of(ids: np.ndarray) -> list[Run]:
    """(start, length, period) of every run of a sequence of numbers from 0, by start, then period."""
    n, found = len(ids), set()
    if n < LEAST_LENGTH:
        return []
    order = np.argsort(ids, kind="stable")
    again = np.full(n, n, np.int64)  # words until this one comes again
    same = ids[order[1:]] == ids[order[:-1]]
    again[order[:-1][same]] = np.diff(order)[same]
    reach = np.zeros(n, np.int64)  # where known runs that hold a word end at most
    low = 1
    while LEAST_EXPONENT * low <= n:
        high, step = 2 * low, max(LEAST_BLOCK, low)
        size = min(step, MOST_BLOCK)
        near = np.concatenate(([0], np.cumsum(again < high)))
        starts = np.arange(0, n - size - low + 1, step)
        starts = starts[near[starts + size] - near[starts] == size]
        new: list[Run] = []
        if len(starts):
            pairs = [(s[kept], d[kept]) for s, d in _seeds(ids, starts, size, low, high) if (kept := (s + d + size <= n) & (reach[s] < s + d + size)).any()]
            s, d = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (starts[:0], starts[:0])
            last, end = -1, -1
            for k in np.lexsort((s, d)).tolist():
                begin, q = int(s[k]), int(d[k])
                if q == last and begin + size <= end:  # within the stretch just found
                    continue
                l, end = _stretch(ids, begin, begin + size, q)
                last = q
                if end > l and end - l + q >= max(LEAST_LENGTH, LEAST_EXPONENT * q):
                    new.append((l, end - l + q, q))
        for begin, length, _ in new:
            reach[begin] = max(reach[begin], begin + length)
        if new:
            np.maximum.accumulate(reach, out=reach)
            found.update(new)
        low = high
    return sorted(found, key=lambda r: (r[0], r[2]))


def _text(text: str | None) -> tuple[list[Run], str]:
    # bytes.split parts at the six characters of [\x20\x09-\x0D]
    words = (text or "").encode().split()
    numbers: dict[bytes, int] = {}
    runs = runs_of(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
    if runs:
        edge = np.zeros(len(words) + 1, np.int32)
        for start, length, period in runs:
            edge[start + period] += 1
            edge[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
    return runs, b" ".join(words).decode()


RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False)


def find(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``runs``, by start, then period, and ``collapsed``: the words, joined by a
    space, without those that a run has after its first period."""

    def run(texts: pa.Array) -> list:
        done = [_text(t.as_py()) for t in texts]
        as_rows = [[{"start": a, "length": b, "period": c} for a, b, c in runs] for runs, _ in done]
        return [as_rows, [collapsed for _, collapsed in done]]

    return append(df, text, [T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())], run, keep)


def rewritten(doc_id: Column, text: Column) -> Column:
    """The text, of some documents with words repeating from a place on, as a hash of their id tells.

    With h = crc32 of the decimal id, g = h div 10: where h is divisible by 10 and there are n > 0 words, word i from
    a = g mod n on is word a + (i - a) mod p, with p = 1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def planted(x: Column) -> Column:
        n, g = F.size(x.words).cast("long"), x.g
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        tail = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.get(x.words, (a + i % p).cast("int")))
        return F.array_join(F.concat(F.slice(x.words, F.lit(1), a.cast("int")), tail), " ")

    # a one-element array, so that the words are made once
    changed = F.element_at(F.transform(F.array(F.struct(words.alias("words"), g.alias("g"))), lambda x: F.when(F.size(x.words) > 0, planted(x)).otherwise(F.lit(""))), 1)
    return F.when((h % 10 == 0) & text.isNotNull(), changed).otherwise(text)


def digest(found: DataFrame, keep: list[str]) -> DataFrame:
    """Of each row of ``find``: the number of runs, the one of the greatest length / period (ties: least start, then
    period), and hashes of all runs and of the collapsed text."""
    order = lambda a, b: (
        F.when(a.length * b.period != b.length * a.period, F.when(a.length * b.period > b.length * a.period, -1).otherwise(1))
        .when(a.start != b.start, F.when(a.start < b.start, -1).otherwise(1))
        .when(a.period != b.period, F.when(a.period < b.period, -1).otherwise(1)).otherwise(0)
    )
    best = F.get(F.array_sort("runs", order), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    told = found.select(*keep, F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return told.select(
        *keep, "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )
