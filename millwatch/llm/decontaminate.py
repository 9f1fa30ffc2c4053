"""Benchmark passages in training texts, found by an FM-index of each shard of texts.

A shard is the words of ``BATCH_BYTES`` of texts in a row of a partition, at most ``SHARD_WORDS`` of them; longer
texts go on in the next shard, which repeats one window less a word, so none is missed. Shards are indexed over
the benchmark's vocabulary: a run of words that the benchmark never uses is one mark, which no phrase holds.
All windows of the benchmark are searched backward at once, by wavelet-tree ranks; what is found is located by
sampled suffix positions, and the words it covers are merged to spans. Nothing is shuffled. The benchmark comes
to the workers in blocks of ``BLOCK_WORDS`` at most, one pass over the rows for each, whatever its size; passes
follow each other through written tables.

Words are compared by 64-bit hashes.

Defined results: a null or empty text has no words; a null or empty item has no windows; an item of fewer
words than a window is one window; items with equal windows are all found; repeated rows give repeated rows;
input columns named like an output column of ``find`` are replaced, those of ``remove`` stay; an empty table, or
an empty benchmark, finds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import words as w
from .fm_index import FMIndex
from .rows import freed
from .storage import saved

WINDOW, SHARD_WORDS, BLOCK_WORDS = 10, 500_000, 1_000_000
#: Text indexed at once: a word takes some 200 bytes of memory while its shard is sorted.
BATCH_BYTES = 4 << 20
OTHER = 1
FOUND = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("item_ids", T.ArrayType(T.StringType()))]


class Block(NamedTuple):
    """Phrases of some benchmark items: sorted word hashes (symbol k + 2 is the k-th), phrases as symbols, their
    lengths, and for each phrase its items."""

    vocabulary: np.ndarray
    phrases: np.ndarray
    length: np.ndarray
    items: list[list[str]]


def block_of(items: list[tuple[object, str]], window: int = WINDOW) -> Block:
    words = w.split(pa.array([t for _, t in items], pa.string()), w.ALNUM, lower=True)
    vocabulary, symbol = np.unique(words.hash, return_inverse=True)
    phrases: dict[tuple[int, ...], set[str]] = {}
    for k, (name, _) in enumerate(items):
        own = (symbol[words.first[k] : words.first[k + 1]] + 2).tolist()
        for i in range(max(1, len(own) - window + 1) if own else 0):
            phrases.setdefault(tuple(own[i : i + window]), set()).add(str(name))
    table = np.zeros((len(phrases), window), np.int64)
    for i, p in enumerate(phrases):
        table[i, : len(p)] = p
    return Block(vocabulary, table, np.asarray([len(p) for p in phrases], np.int64), [sorted(x) for x in phrases.values()])


def blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW, most: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark's phrases, some items at a time; never all rows are on the driver at once."""
    waiting, size = [], 0
    for name, value in benchmark.select(key, text).where(F.col(text).isNotNull()).toLocalIterator():
        waiting.append((name, value))
        size += len(value) // 4 + 1
        if size >= most:
            yield block_of(waiting, window)
            waiting, size = [], 0
    if waiting:
        yield block_of(waiting, window)


def matches(texts: pa.Array, block: Block, shard_words: int = SHARD_WORDS) -> tuple[w.Words, np.ndarray, list[set[str]]]:
    """Words of the texts, which of them are in an occurrence of a phrase, and each text's items."""
    words = w.split(texts, w.ALNUM, lower=True)
    covered, found = np.zeros(len(words.hash), bool), [set() for _ in range(len(texts))]
    if not len(words.hash) or not len(block.length):
        return words, covered, found
    at = np.minimum(np.searchsorted(block.vocabulary, words.hash), len(block.vocabulary) - 1)
    symbol = np.where(block.vocabulary[at] == words.hash, at + 2, OTHER)
    # runs of other words are one mark, and so is the border between texts: a word that begins a text has one before it
    keep = (symbol != OTHER) | np.concatenate(([True], symbol[:-1] != OTHER))
    starts = np.zeros(len(symbol), bool)
    starts[words.first[:-1][np.diff(words.first) > 0]] = True
    place = np.flatnonzero(keep)
    borders = np.searchsorted(place, np.flatnonzero(starts & (symbol != OTHER)))
    reduced, place = np.insert(symbol[place], borders, OTHER), np.insert(place, borders, -1)
    step = max(1, shard_words)
    for low in range(0, len(reduced), step):
        shard = reduced[low : low + step + int(block.length.max()) - 1]
        index = FMIndex(shard, len(block.vocabulary) + 1)
        first, last = index.search(block.phrases, block.length)
        count = last - first
        phrase = np.repeat(np.arange(len(count)), count)
        rows = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        word = place[low + index.locate(rows)]
        if len(word):
            mark = np.bincount(word, minlength=len(symbol) + 1) - np.bincount(word + block.length[phrase], minlength=len(symbol) + 1)
            covered |= np.cumsum(mark[:-1]) > 0
        for row, p in set(zip(words.row[word].tolist(), phrase.tolist(), strict=True)):
            found[row].update(block.items[p])
    return words, covered, found


def _spans(covered: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).view(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _passes(df: DataFrame, benchmark: DataFrame, text: str, window: int, shard_words: int, block_words: int, batch_bytes: int, removing: bool) -> DataFrame:
    """``df`` with the columns FOUND after its own, or, if ``removing``, without the passages in ``text``.

    A block of the benchmark is one pass. Passes follow each other through written tables, so a task never holds
    the texts of two of them.
    """
    at, known = df.columns.index(text), len(df.columns)
    context, fields = df.sparkSession.sparkContext, [T.StructField(f"__{f.name}", f.dataType) for f in FOUND]
    whole = T.StructType(df.schema.fields + fields)

    def passed(rows: DataFrame, block: Block, again: bool, cutting: bool) -> DataFrame:
        shared = context.broadcast(block)  # at most BLOCK_WORDS words and as many windows
        schema = df.schema if cutting else whole
        arrow = to_arrow_schema(schema)

        def spans_of(batch: pa.RecordBatch) -> tuple[w.Words, list, list]:
            found, covered, items = matches(batch.column(at), shared.value, shard_words)
            hit, spans = np.concatenate(([0], np.cumsum(covered))), []
            old = batch.columns[known + 1].to_pylist() if again else None
            if again:
                items = [a.union(b) for a, b in zip(items, batch.columns[known + 2].to_pylist(), strict=True)]
            for r in range(batch.num_rows):
                low, high = found.first[r], found.first[r + 1]
                if again and old[r]:
                    for s in old[r]:
                        covered[low + s["start"] : low + s["end"]] = True
                elif hit[low] == hit[high]:
                    spans.append([])
                    continue
                spans.append(_spans(covered[low:high]))
            return found, spans, items

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for big in batches:
                for batch in w.small_batches(big, at, batch_bytes):
                    found, spans, items = spans_of(batch)
                    columns = list(batch.columns[:known])
                    if cutting:
                        for r in [r for r, x in enumerate(spans) if x]:
                            spans[r] = without(columns[at][r].as_py(), spans[r])
                        if any(spans):
                            columns[at] = pa.array([x or columns[at][r].as_py() for r, x in enumerate(spans)], arrow.field(at).type)
                    else:
                        added = [np.diff(found.first), [[{"start": a, "end": b} for a, b in x] for x in spans], [sorted(x) for x in items]]
                        columns += [pa.array(x, arrow.field(known + i).type) for i, x in enumerate(added)]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        return rows.mapInArrow(freed(run), schema)

    none = Block(np.zeros(0, w.U64), np.zeros((0, window), np.int64), np.zeros(0, np.int64), [])
    out, again, waiting = df, False, None
    for block in blocks(benchmark, window=window, most=block_words):
        if waiting is not None:
            out, again = saved(passed(out, waiting, again, False), "decontamination"), True
        waiting = block
    return passed(out, none if waiting is None else waiting, again, removing)


def find(df: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, keep: list[str] | None = None, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``df`` with n_words, hit_spans (merged spans of words inside benchmark windows) and item_ids (sorted)."""
    new = {f.name for f in FOUND}
    names = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    rows = df.select(*[df[f"`{c}`"] for c in dict.fromkeys([*names, text])])
    found = _passes(rows, benchmark, text, window, shard_words, block_words, batch_bytes, False)
    return found.select(*[F.col(f"`{c}`") for c in names], *[F.col(f"__{f.name}").alias(f.name) for f in FOUND])


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])


def digest(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated of what ``find`` found."""
    hit = n_hit(F.col("hit_spans"))
    return df.select(key, "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


#: Stands for a removed span; being a word of its own, it keeps the words around from forming a window.
GAP = "…"
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def without(text: str, spans: list[tuple[int, int]], gap: str = GAP) -> str:
    """``text`` without the words of the spans, each span replaced by ``gap``."""
    data = text.encode()
    place = [m.span() for m in _WORD.finditer(data)]
    parts, low = [], 0
    for a, b in spans:
        parts += [data[low : place[a][0]], gap.encode()]
        low = place[b - 1][1]
    return b"".join([*parts, data[low:]]).decode()


def remove(df: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``df`` with the spans that ``find`` finds taken out of ``text``, in the pass that finds the last of them; rows
    and columns stay as they are, whatever their names."""
    return _passes(df, benchmark, text, window, shard_words, block_words, batch_bytes, True)
