"""Groups of texts whose sets of word 5-grams have a Jaccard similarity of 0.8 or more, by a prefix-tree join.

1. Every text's distinct shingles are hashed to 64 bits; texts with equal sets are one class.
2. Shingles get one global order: by how much more frequent than chance a count sketch over all texts says they
   are, rare ones first, then by hash.  Two sets can only be similar if they share a shingle of their prefixes, the first
   n - ceil(0.8 n) + 1 in that order.
3. Texts that share a prefix shingle, and could agree in length, form a list; its smallest text leads it.
   Frequent shingles' lists are joined to their leader by Spark, whose skew handling splits them; no other list is
   longer than the sketch says, and tasks find their leaders as they read entries that Spark has sorted.
4. All texts of a leader's lists meet in the leader's group, in blocks of ``BLOCK_TEXTS``, first by bitmaps of
   about a bit for each shingle: a shingle flips its bit, so two sets differ in no fewer shingles than their
   bitmaps in bits, and texts whose bitmaps are too far from all others of a block go no further.  The sets of
   the rest, in global order, are stored in a trie for each block.  The leader's set runs through it, sharing the overlap of common
   beginnings and leaving out subtrees that can't reach the overlap needed by what remains; then so does each
   text that the leader didn't match.  Texts of a group of many blocks that their leader didn't match also run
   through the tries of the other blocks, so no link is lost however large a group is.
5. Connected components of the links (and only of those: nothing is linked for being in a group).

No pair is ever listed: a block returns a spanning set of its links.

Defined results: a null text, or one without words, has an empty set and is a component by itself; a text of
fewer than five words has one shingle, its whole sequence; rows that share a doc_id are one document where links
are followed; a null doc_id takes the component of its equal texts (in ``firsts`` such rows take part like any
others); ``classes`` doesn't return extra columns, ``firsts`` returns them as they are; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as w
from .rows import freed
from .storage import saved

WORDS, PERCENT, BLOCK_TEXTS = 5, 80, 512
SKETCH_BITS, SLICE = 20, 1 << 14
#: Text worked on at once.
BATCH_BYTES = 2 << 20
U64 = np.uint64


def needed(a: int, b: int, percent: int = PERCENT) -> int:
    """Least overlap of sets of sizes a and b with 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


def shingle_sets(texts: pa.Array, k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = w.split(texts, w.NOT_SPACE, lower=True)
    value, first = w.windows(words, k)
    at = np.searchsorted(first, words.first)
    out = []
    for r in range(len(texts)):
        own = value[at[r] : at[r + 1]]
        n = words.first[r + 1] - words.first[r]
        if 0 < n < k:
            total = U64(n)
            with np.errstate(over="ignore"):
                for h in words.hash[words.first[r] : words.first[r + 1]]:
                    total = (total + h) * U64(w.BASE)
            own = w.mix(np.asarray([total], U64))
        own = np.sort(own)
        out.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) > 1 else own)
    return out


def fingerprint(own: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set; equal sets have equal ones."""
    both = (w.mix(own ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64), w.mix(own + U64(0x1234567)).sum(dtype=U64))
    return tuple(int(x) - (1 << 64) * (int(x) >> 63) for x in both)


class Order(NamedTuple):
    """The global order. A shingle's token is its level over the upper 58 bits of its hash; levels are powers of two
    of how far its counter exceeds what most counters have by chance (level 0: no further than chance explains).

    ``usual`` is the counters' median, ``noise`` what chance adds to it, and lists of shingles whose counter is under
    ``border`` are left to sorted streams; no list is longer than its counter."""

    counts: np.ndarray
    usual: float
    noise: float
    border: int

    @classmethod
    def of(cls, counts: np.ndarray) -> Order:
        usual = float(np.median(counts)) if len(counts) else 0.0
        return cls(counts, usual, 4 * usual**0.5 + 4, int(4 * counts.sum() // max(1, len(counts))) + 64)

    def prefix(self, own: np.ndarray, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The first ``size`` tokens of a set (all without it), and which of them are frequent."""
        seen = self.counts[(own & U64(len(self.counts) - 1)).astype(np.int64)]
        level = np.log2(np.maximum((seen - self.usual) / self.noise, 0.5)).astype(np.int64) + 1
        token = np.minimum(np.where(seen < self.usual + self.noise, 0, level), 30) << 58 | (own >> U64(6)).astype(np.int64)
        first = np.argsort(token)[:size]
        return token[first], seen[first] >= self.border


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    for big in batches:
        for batch in w.small_batches(big, 1, BATCH_BYTES):
            yield batch.column(0).to_pylist(), shingle_sets(batch.column(1))


def bitmap(own: np.ndarray) -> bytes:
    """A power of two of bits, as many as shingles or more: each shingle flips one, picked by its middle bits."""
    bits = max(64, 1 << int(max(1, len(own)) - 1).bit_length())
    flips = np.bincount(((own >> U64(20)) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def hopeful(sizes: list[int], bitmaps: list[bytes], percent: int = PERCENT) -> np.ndarray:
    """Which sets of a block may be similar to another: those that bitmaps and sizes don't part from all."""
    n = np.asarray(sizes, np.int64)
    ok, by_bits = np.zeros(len(n), bool), {}
    for k, b in enumerate(bitmaps):
        by_bits.setdefault(len(b), []).append(k)
    for width, rows in by_bits.items():
        rows = np.asarray(rows)
        own = np.stack([np.frombuffer(bitmaps[k], np.uint8) for k in rows])
        # similar sets differ in size by less than half, so the next width is the only other to look at
        sides = [(rows, own, own)]
        if 2 * width in by_bits:
            wider = np.asarray(by_bits[2 * width])
            halves = np.stack([np.frombuffer(bitmaps[k], np.uint8) for k in wider])
            sides.append((wider, halves[:, :width] ^ halves[:, width:], own))
        for others, other, mine in sides:
            for i, k in enumerate(rows):
                least = np.bitwise_count(other ^ mine[i]).sum(axis=1, dtype=np.int64)
                both = n[others] + n[k]
                # overlap is (both - difference) / 2; similar: (100 + percent) * overlap >= percent * both
                near = ((100 + percent) * (both - least) >= 2 * percent * both) & (others != k)
                if near.any():
                    ok[k] = True
                    ok[others[near]] = True
    return ok


def described(docs: DataFrame) -> DataFrame:
    """A row for each text (doc_id, n, f1, f2, bits), and rows with slices of the count sketch (slice, counts)."""
    schema = "doc_id long, n long, f1 long, f2 long, bits binary, slice int, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int32)
        types = [pa.int64()] * 4 + [pa.binary(), pa.int32(), pa.binary()]
        names = ["doc_id", "n", "f1", "f2", "bits", "slice", "counts"]
        for ids, sets in _batches(batches):
            every = np.concatenate(sets) if sets else np.zeros(0, U64)
            counts += np.bincount((every & U64(len(counts) - 1)).astype(np.int64), minlength=len(counts)).astype(np.int32)
            marks = [fingerprint(x) for x in sets]
            none = [None] * len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids, [len(x) for x in sets], [m[0] for m in marks], [m[1] for m in marks], [bitmap(x) for x in sets], none, none), types, strict=True)], names=names)
        for k in range(0, len(counts), SLICE):
            if counts[k : k + SLICE].any():
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, None, None, None, None, k // SLICE, counts[k : k + SLICE].tobytes()), types, strict=True)], names=names)

    return saved(docs.select("doc_id", "text").mapInArrow(freed(run), schema), "ngram-described")


def learned_order(about: DataFrame) -> Order:
    """Sums the slices where they meet, one at a time; the driver gets the summed sketch, of a fixed size."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(part.as_buffer(), np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "counts"])

    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in about.where("slice IS NOT NULL").select("slice", "counts").repartition("slice").mapInArrow(freed(added), "slice int, counts binary").collect():
        counts[row.slice * SLICE : (row.slice + 1) * SLICE] = np.frombuffer(row.counts, np.int64)
    return Order.of(counts)


def prefixes(docs: DataFrame, order: Order, frequent: bool, percent: int = PERCENT) -> DataFrame:
    """token, doc_id, n for the prefix shingles of each text that are frequent, or aren't. Texts of one batch with
    equal sets are entered once."""
    known = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _batches(batches):
            once: dict[tuple, tuple[int, np.ndarray]] = {}
            for name, own in zip(ids, sets, strict=True):
                if name is not None and len(own):
                    mark = (*fingerprint(own), len(own))
                    if mark not in once or once[mark][0] > name:
                        once[mark] = (name, own)
            parts = []
            for name, own in once.values():
                token, often = known.value.prefix(own, prefix_size(len(own), percent))
                parts.append((token[often == frequent], name, len(own)))
            if parts:
                size = [len(p[0]) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[0] for p in parts])), pa.array(np.repeat([p[1] for p in parts], size)), pa.array(np.repeat([p[2] for p in parts], size), pa.int32())], names=["token", "doc_id", "n"])

    return docs.select("doc_id", "text").mapInArrow(freed(run), "token long, doc_id long, n int")


def short_lists(entries: DataFrame, percent: int = PERCENT) -> DataFrame:
    """leader, doc_id of the lists of infrequent shingles. Spark sorts the entries, and a list's leader is its first
    text, so a task holds one batch and the leader of the list that goes on into it. A pair is given for each
    shingle that its texts share; Spark keeps one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # token, leader and n of the entry before this batch
        for batch in batches:
            token, name, n = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            if last is not None:
                token, name, n = (np.concatenate(([x], y)) for x, y in zip(last, (token, name, n), strict=True))
            if not len(token):
                continue
            # a list ends where its next text is too long to match any before it
            new = np.concatenate(([True], (token[1:] != token[:-1]) | (percent * n[1:] > 100 * n[:-1])))
            leader = name[np.maximum.accumulate(np.where(new, np.arange(len(token)), 0))]
            apart = leader != name
            last = (token[-1], leader[-1], n[-1])
            yield pa.RecordBatch.from_arrays([pa.array(leader[apart]), pa.array(name[apart])], names=["leader", "doc_id"])

    return entries.repartition("token").sortWithinPartitions("token", "n", "doc_id").mapInArrow(freed(run), "leader long, doc_id long")


def long_lists(entries: DataFrame) -> DataFrame:
    """leader, doc_id of the lists of frequent shingles."""
    entries = saved(entries, "ngram-frequent")
    leaders = entries.groupBy("token").agg(F.count("*").alias("size"), F.min(F.struct("n", "doc_id")).alias("least")).where("size > 1").select("token", F.col("least.doc_id").alias("leader"))
    return entries.join(saved(leaders, "ngram-leaders"), "token").where("doc_id <> leader").select("leader", "doc_id")


class Node:
    __slots__ = ("label", "children", "texts", "least", "most", "depth")

    def __init__(self, label: np.ndarray, depth: int) -> None:
        self.label, self.depth = label, depth  # depth: tokens from the root to this label's end
        self.children: dict[int, Node] = {}
        self.texts: list[int] = []
        self.least, self.most = 1 << 60, 0  # sizes of the sets below


class Trie:
    """Sets as paths of ascending tokens; chains of single children are one label."""

    def __init__(self, percent: int = PERCENT) -> None:
        self.root, self.percent = Node(np.zeros(0, np.int64), 0), percent

    def add(self, tokens: np.ndarray, text: int) -> None:
        node, at, n = self.root, 0, len(tokens)
        while True:
            node.least, node.most = min(node.least, n), max(node.most, n)
            if at == n:
                node.texts.append(text)
                return
            child = node.children.get(int(tokens[at]))
            if child is None:
                child = node.children[int(tokens[at])] = Node(tokens[at:], n)
            else:
                m = min(len(child.label), n - at)
                differ = np.flatnonzero(child.label[:m] != tokens[at : at + m])
                common = int(differ[0]) if len(differ) else m
                if common < len(child.label):
                    upper = Node(child.label[:common], at + common)
                    upper.least, upper.most = child.least, child.most
                    child.label = child.label[common:]
                    upper.children[int(child.label[0])] = child
                    node.children[int(tokens[at])] = child = upper
            node, at = child, child.depth

    def similar(self, tokens: np.ndarray) -> list[int]:
        """Texts whose sets are similar to this one."""
        n, p, out = len(tokens), self.percent, []
        shortest, longest = -(-p * n // 100), 100 * n // p
        stack = [(self.root, 0, 0)]  # node, overlap so far, tokens of the set already passed
        while stack:
            node, overlap, passed = stack.pop()
            if overlap >= needed(n, node.depth, p):
                out += node.texts
            for child in node.children.values():
                if child.most < shortest or child.least > longest:
                    continue
                least = needed(n, max(child.least, shortest), p)
                if overlap + min(n - passed, child.most - node.depth) < least:
                    continue
                place = np.searchsorted(tokens[passed:], child.label) + passed
                there = tokens[np.minimum(place, n - 1)] == child.label
                more = overlap + int(np.count_nonzero(there))
                after = int(place[-1]) + int(there[-1])
                if more + min(n - after, child.most - child.depth) >= least:
                    stack.append((child, more, after))
        return out


def block_links(names: list[int], sets: list[np.ndarray], leader: int | None, asked: list[tuple[int, np.ndarray]], percent: int = PERCENT) -> tuple[list[tuple[int, int]], list[int]]:
    """Links that span all similar texts of a block, and the texts that the leader doesn't match.

    With a leader, it and then the texts it doesn't match are looked up; else the texts of ``asked`` are.
    """
    trie, above = Trie(percent), {}

    def top(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    links, rest = [], []

    def join(a: int, b: int) -> None:
        x, y = top(a), top(b)
        if x != y:
            above[max(x, y)] = min(x, y)
            links.append((a, b))

    for k, own in enumerate(sets):
        trie.add(own, k)
    if leader is not None:
        for own in [s for name, s in zip(names, sets, strict=True) if name == leader]:
            for k in trie.similar(own):
                join(leader, names[k])
        rest = [k for k, name in enumerate(names) if top(name) != top(leader)]
        asked = [(names[k], sets[k]) for k in rest]
    for name, own in asked:
        for k in trie.similar(own):
            join(name, names[k])
    return links, sorted({names[k] for k in rest})


def joined(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """leader, a, b: links found in blocks; where a group has several blocks, also rows with a null b for the
    texts that the leader doesn't match. ``rows``: leader, block, n_blocks, asks, doc_id, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, sets, asked, out = None, [], [], [], []

        def finish() -> None:
            if now is None:
                return
            leader, _, n_blocks, again = now
            links, rest = block_links(names, sets, None if again else leader, asked, percent)
            out.extend((leader, a, b) for a, b in links)
            if n_blocks > 1 and not again:
                out.extend((leader, a, None) for a in rest)

        def full() -> pa.RecordBatch:
            done = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in done], names=["leader", "a", "b"])

        for batch in batches:
            leaders, blocks, counts, asks, ids, tokens = batch.columns
            at = zip(leaders.to_pylist(), blocks.to_pylist(), counts.to_pylist(), asks.to_pylist(), ids.to_pylist(), strict=True)
            for i, (leader, block, n_blocks, ask, name) in enumerate(at):
                if now is None or now[:2] != (leader, block):
                    finish()
                    now, names, sets, asked = (leader, block, n_blocks, ask is not None), [], [], []
                own = np.frombuffer(tokens[i].as_buffer(), np.int64)
                if ask:
                    asked.append((name, own.copy()))
                else:
                    names.append(name)
                    sets.append(own.copy())
            if len(out) > 50_000:
                yield full()
        finish()
        if out:
            yield full()

    order = ["leader", "block", "n_blocks", "asks", "doc_id", "tokens"]
    return rows.select(*order).repartition("leader", "block").sortWithinPartitions("leader", "block", "asks", "doc_id").mapInArrow(freed(run), "leader long, a long, b long")


def token_sets(docs: DataFrame, order: Order) -> DataFrame:
    known = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _batches(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([known.value.prefix(x)[0].tobytes() for x in sets], pa.binary())], names=["doc_id", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(freed(run), "doc_id long, tokens binary")


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node), for the nodes of links (a, b): large and small stars in turn until
    every node hangs on its least one."""
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "ngram-edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "ngram-least")
        large = saved(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "ngram-large")
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")), "ngram-least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v")
        new = saved(small.distinct(), "ngram-edges")
        print_ = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        old = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        edges = new
        if print_ == old:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _grouped(pairs: DataFrame, leads: DataFrame, block_texts: int) -> tuple[DataFrame, DataFrame]:
    """(leader, n_blocks), and leader, doc_id, n_blocks, block of all members; leaders of ``leads`` are in every
    block of their group."""
    groups = pairs.groupBy("leader").agg(F.count("*").alias("size")).select("leader", F.ceil(F.col("size") / block_texts).alias("n_blocks"))
    groups = saved(groups, "ngram-groups")
    members = pairs.join(groups, "leader").withColumn("block", F.pmod(F.xxhash64("doc_id"), "n_blocks"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block")
    lead = groups.join(leads, "leader", "left_semi").select("leader", F.col("leader").alias("doc_id"), "n_blocks", every)
    return groups, members.select("leader", "doc_id", "n_blocks", "block").unionByName(lead)


def near_by_bitmap(members: DataFrame, bits: DataFrame, percent: int = PERCENT) -> DataFrame:
    """leader, doc_id of the members whose bitmap is near another's in their block; all of groups of many blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, sizes, maps, out = None, [], [], [], []

        def finish() -> None:
            if now is not None:
                ok = hopeful(sizes, maps, percent) if now[2] == 1 else np.ones(len(names), bool)
                out.extend((now[0], names[k]) for k in np.flatnonzero(ok))

        for batch in batches:
            for leader, block, n_blocks, name, n, own in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or now[:2] != (leader, block):
                    finish()
                    now, names, sizes, maps = (leader, block, n_blocks), [], [], []
                names.append(name)
                sizes.append(n)
                maps.append(own)
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["leader", "doc_id"])
                out.clear()
        finish()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["leader", "doc_id"])

    rows = members.join(bits, "doc_id").select("leader", "block", "n_blocks", "doc_id", "n", "bits")
    return rows.repartition("leader", "block").sortWithinPartitions("leader", "block").mapInArrow(freed(run), "leader long, doc_id long")


def similar_links(docs: DataFrame, order: Order, named: DataFrame, bits: DataFrame, percent: int = PERCENT, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """a, b: doc_ids of similar texts, enough of them to span all links between classes.

    ``named``: doc_id and rep, the doc_id that stands for its class; ``bits``: doc_id (of a rep), n, bits.
    """
    pairs = short_lists(prefixes(docs, order, False, percent), percent).unionByName(long_lists(prefixes(docs, order, True, percent)))
    pairs = saved(pairs.distinct(), "ngram-pairs")
    for side in ("leader", "doc_id"):
        pairs = pairs.join(named.select(F.col("doc_id").alias(side), F.col("rep").alias("__rep")), side).drop(side).withColumnRenamed("__rep", side)
    pairs = saved(pairs.where("leader <> doc_id").distinct(), "ngram-pairs")
    _, members = _grouped(pairs, pairs.select("leader"), block_texts)
    near = saved(near_by_bitmap(members, bits, percent).distinct(), "ngram-near")
    groups, rows = _grouped(near.where("leader <> doc_id"), near.where("leader = doc_id").select("leader"), block_texts)
    sets = saved(token_sets(docs.select("doc_id", "text").join(near.select("doc_id").distinct(), "doc_id", "left_semi"), order), "ngram-sets")
    found = saved(joined(rows.join(sets, "doc_id").withColumn("asks", F.lit(None).cast("boolean")), percent), "ngram-links")
    links = found.where("b IS NOT NULL").select("a", "b")
    rest = found.where("b IS NULL").select("leader", F.col("a").alias("doc_id")).distinct()
    if rest.isEmpty():
        return links
    # texts that the leader of many blocks doesn't match meet the other blocks
    rest = saved(rest.join(groups, "leader"), "ngram-rest")
    ask = rest.withColumn("own", F.pmod(F.xxhash64("doc_id"), "n_blocks")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1))).where("block <> own")
    ask = ask.select("leader", "doc_id", "n_blocks", "block", F.lit(True).alias("asks"))
    told = rows.where("doc_id <> leader").join(rest.select("leader").distinct(), "leader", "left_semi").select("leader", "doc_id", "n_blocks", "block", F.lit(False).alias("asks"))
    return links.unionByName(joined(ask.unionByName(told).join(sets, "doc_id"), percent).select("a", "b"))


def classes(docs: DataFrame, percent: int = PERCENT, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links lead to) of each row."""
    about = described(docs)
    order = learned_order(about)
    rows = about.where("slice IS NULL").select("doc_id", "n", "f1", "f2")
    same = about.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("bits").alias("bits"))
    same = saved(same, "ngram-classes")
    named = rows.join(same.drop("bits"), ["n", "f1", "f2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep"))
    named = saved(named, "ngram-named")
    known = named.where("doc_id IS NOT NULL AND n_shingles > 0").select("doc_id", "rep").distinct()
    bits = same.where("rep IS NOT NULL").select(F.col("rep").alias("doc_id"), "n", "bits")
    links = saved(similar_links(docs, order, known, bits, percent, block_texts), "ngram-spanning")
    # a doc_id with several texts has several classes: a link of one is a link of all
    for side in ("a", "b"):
        links = links.join(known.select(F.col("doc_id").alias(side), F.col("rep").alias(f"{side}_rep")), side)
    found = components(links.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")))
    return named.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def firsts(docs: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs`` that stay when one of each group does: the document with the least doc_id, whole.

    Of several rows with one doc_id and text, the one that comes first by its other columns stays; rows with one
    doc_id and different texts are one document and all stay. Rows without a doc_id are numbered by their texts, after
    all others, so they take part like any. Rows meet only the doc_ids that go or are repeated.
    """
    number = F.coalesce(F.col("doc_id"), F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 62))
    keyed = docs.withColumn("__id", number)
    groups = classes(keyed.select(F.col("__id").alias("doc_id"), "text"), **options)
    odd = groups.groupBy(F.col("doc_id").alias("__odd")).agg((F.min("component_id") < F.col("doc_id")).alias("__goes"), (F.count("*") > 1).alias("__many"))
    odd = saved(odd.where("__goes OR __many"), "ngram-odd")
    both = keyed.join(odd, F.col("__id") == F.col("__odd"), "left")
    once = both.where("__odd IS NULL").drop("__id", "__odd", "__goes", "__many")
    if odd.where("__many AND NOT __goes").isEmpty():
        return once
    many = both.where("__many AND NOT __goes").drop("__odd", "__goes", "__many")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    stays = many.groupBy("__id", F.sha2("text", 256).alias("__text")).agg(F.min_by(row, F.to_json(row)).alias("__row"))
    return once.unionByName(stays.select("__row.*"))
