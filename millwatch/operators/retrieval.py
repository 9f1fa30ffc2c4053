"""Retrieval of chunks by BM25 over an inverted index.

The inverted index is written in one pass over the chunks, as lists: a row for each block of chunks that lie together and
each term in it, with the chunks' places, how often they have the term and how long they are. A search takes
the lists of its terms, and from them the most that a block can add to a score. It scores the few most promising blocks of
each query first; the score of the k-th best chunk there is a floor, and of all other blocks only those whose bounds
reach it are scored. So the result is that of scoring every chunk. Names of chunks are looked up at the end, for those that reach the floor.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scalars import TOPIC_KEYWORDS, TOPICS
from ..sources.shared import saved

K1, B = 1.2, 0.75
#: Digits to which scores are compared, and the slack of bounds that follows from it.
DIGITS, SLACK = 9, 1e-6


def terms(text: Column) -> Column:
    """Words of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


#: As ``terms`` tells words, of text in lower case.
_WORD = re.compile(r"[^\W_]+")


def _listed(block_chunks: int, fields: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """part, at, text, chunk_id and, if asked for, size to the rows of ``InvertedIndex.lists``. As many chunks as
    ``block_chunks`` in a row, if a batch has them, are a block, named by the first one's ``at``."""

    def lists(starts: np.ndarray, values: pa.Array | np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values))

    def rows(**columns: pa.Array) -> pa.RecordBatch:
        n = len(columns["part"])
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in fields], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for low in range(0, big.num_rows, block_chunks):
                batch = big.slice(low, block_chunks)
                n = batch.num_rows
                words = [_WORD.findall(t or "") for t in batch.column(2).to_pylist()]
                sizes = np.array([len(w) for w in words], np.int32)
                parts = batch.column(0).dictionary_encode(null_encoding="encode")
                part = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                at = batch.column(1).to_numpy()
                place = (at - at[0]).astype(np.int32)

                # the chunks themselves: a row for each part, without a term
                order = np.argsort(part, kind="stable")
                starts = np.flatnonzero(np.diff(part[order], prepend=-1))
                every = pa.array(order)
                own = {"chunk_ids": lists(starts, batch.column(3).take(every))}
                if "sizes" in fields.names:
                    own["sizes"] = lists(starts, batch.column(4).take(every))
                yield rows(part=parts.dictionary.take(pa.array(part[order][starts])), block=pa.array(np.full(len(starts), at[0])), places=lists(starts, place[order]), n_terms=lists(starts, sizes[order]), **own)

                # their terms: a row for each part and term
                coded = pa.array([t for w in words for t in w], pa.string()).dictionary_encode()
                row = np.repeat(np.arange(n), sizes)
                n_words = max(1, len(coded.dictionary))
                key, tf = np.unique((part[row] * n_words + coded.indices.to_numpy(zero_copy_only=False)) * n + row, return_counts=True)
                group, row = np.divmod(key, n)
                starts = np.flatnonzero(np.diff(group, prepend=-1))
                which, term = np.divmod(group[starts], n_words)
                yield rows(part=parts.dictionary.take(pa.array(which)), block=pa.array(np.full(len(starts), at[0])), term=coded.dictionary.take(pa.array(term)), places=lists(starts, place[row]), n_terms=lists(starts, sizes[row]), tfs=lists(starts, tf.astype(np.int32)))

    return run


class InvertedIndex(NamedTuple):
    """lists: part, block, term, places (of chunks, counted from the block's first), n_terms and tfs, in step; rows
    without a term list all chunks of a block, with chunk_ids and, if asked for, sizes. stats: part, n, mean (chunks
    and their mean length). A ``part`` is searched on its own."""

    lists: DataFrame
    stats: DataFrame

    @property
    def postings(self) -> DataFrame:
        """part, block, term, places, n_terms, tfs."""
        return self.lists.where("term IS NOT NULL").select("part", "block", "term", "places", "n_terms", "tfs")

    def chunks(self, blocks: DataFrame | None = None) -> DataFrame:
        """part, block, place, chunk_id and, if asked for, size: of all chunks, or of those of ``blocks`` (part, block)."""
        columns = {"place": "places", "chunk_id": "chunk_ids"} | ({"size": "sizes"} if "sizes" in self.lists.columns else {})
        rows = self.lists.where("term IS NULL")
        if blocks is not None:
            rows = rows.join(blocks.select("part", "block").distinct(), ["part", "block"], "left_semi")
        rows = rows.select("part", "block", F.explode(F.arrays_zip(*columns.values())).alias("chunk"))
        return rows.select("part", "block", *[F.col("chunk")[v].alias(k) for k, v in columns.items()])

    @property
    def dictionary(self) -> DataFrame:
        """part, term, df."""
        return self.postings.groupBy("part", "term").agg(F.sum(F.size("places")).alias("df"))

    @property
    def bounds(self) -> DataFrame:
        """part, term, block, most: what a posting of the block adds at most."""
        largest = F.array_max(F.transform(F.arrays_zip("tfs", "n_terms"), lambda x: weight(x["tfs"], x["n_terms"])))
        told = self.postings.join(F.broadcast(self.stats), "part").join(self.dictionary, ["part", "term"])
        return told.select("part", "term", "block", (idf() * largest).alias("most"))

    def of(self, asked: DataFrame) -> InvertedIndex:
        """The same without the lists of other terms than those of ``asked``, which are written once more."""
        few = self.postings.join(asked.select("term").distinct(), "term", "left_semi")
        return self._replace(lists=saved(few, "asked-lists"))


def idf() -> Column:
    return F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def weight(tf: Column, n_terms: Column, k1: float = K1, b: float = B) -> Column:
    """What a posting counts of its term's idf, by how often the chunk has the term and how long it is."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * n_terms / F.col("mean")))


def inverted(chunks: DataFrame, part: str = "doc_type", block_chunks: int = 4096, size: str | None = None) -> InvertedIndex:
    """The index of ``chunks`` (chunk_id, text, ``part``), written to the shared folder: ``chunks`` is computed once, and
    nothing moves. A block has up to ``block_chunks`` chunks that lie together. The index keeps the numbers
    of column ``size``, if one is named, beside the names of chunks."""
    rows = chunks.select(F.col(part).alias("part"), F.monotonically_increasing_id().alias("at"), F.lower("text").alias("text"), F.col("chunk_id"), *([F.col(size).cast("long").alias("size")] if size else []))
    whole = T.ArrayType(T.IntegerType())
    fields = T.StructType([rows.schema["part"]]).add("block", T.LongType()).add("term", T.StringType()).add("places", whole).add("n_terms", whole).add("tfs", whole).add("chunk_ids", T.ArrayType(rows.schema["chunk_id"].dataType))
    if size:
        fields = fields.add("sizes", T.ArrayType(T.LongType()))
    lists = saved(rows.mapInArrow(_listed(block_chunks, to_arrow_schema(fields)), fields), "lists")
    lengths = lists.where("term IS NULL").select("part", F.size("places").alias("n"), F.aggregate("n_terms", F.lit(0).cast("long"), lambda a, x: a + x).alias("all"))
    return InvertedIndex(lists, saved(lengths.groupBy("part").agg(F.sum("n").alias("n"), (F.sum("all") / F.sum("n")).alias("mean")), "stats"))


def bm25(index: InvertedIndex, queries: DataFrame, k: int, seeds: int = 4) -> DataFrame:
    """query, part, nth, chunk_id, score: the ``k`` best chunks of each part for each query (``queries``: query, term;
    a repeated term counts once), by score to DIGITS digits, then chunk_id. Chunks with none of the terms have no score; of rows with one chunk_id the
    best counts."""
    asked = saved(queries.select("query", "term").distinct(), "queries")
    few = index.of(asked)
    bounds = saved(few.bounds.join(asked, "term").groupBy("query", "part", "block").agg(F.sum("most").alias("bound")), "bounds")
    promising = Window.partitionBy("query", "part").orderBy(F.desc("bound"), "block")
    first = saved(bounds.withColumn("nth", F.row_number().over(promising)).where(F.col("nth") <= seeds).select("query", "part", "block"), "first-blocks")
    before = saved(named(index, saved(scores(few, asked, first), "first-scores")), "first-chunks")
    best = Window.partitionBy("query", "part").orderBy(F.desc("score"))
    floors = saved(before.withColumn("nth", F.row_number().over(best)).where(F.col("nth") == k).select("query", "part", F.col("score").alias("floor")), "floors")
    able = bounds.join(floors, ["query", "part"], "left").where("floor IS NULL OR bound >= floor - " + str(SLACK)).select("query", "part", "block")
    rest = scores(few, asked, able.join(first, ["query", "part", "block"], "left_anti"))
    # equal scores go by chunk_id: every chunk that reaches the floor gets its own
    rest = rest.join(floors, ["query", "part"], "left").where("floor IS NULL OR score >= floor").drop("floor")
    every = before.unionByName(named(index, saved(rest, "rest-scores")))
    return best_of(every.groupBy("query", "part", "chunk_id").agg(F.max("score").alias("score")), k)


def named(index: InvertedIndex, scored: DataFrame) -> DataFrame:
    """query, part, chunk_id, score of what ``scores`` gives."""
    with_id = scored.join(index.chunks(scored), ["part", "block", "place"])
    return with_id.groupBy("query", "part", "chunk_id").agg(F.max("score").alias("score"))


def scores(index: InvertedIndex, asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """query, part, block, place, score of the chunks of these blocks (query, part, block) that have a term."""
    read = index.postings.join(asked, "term").join(blocks, ["query", "part", "block"])
    weighed = read.join(index.dictionary, ["part", "term"]).join(F.broadcast(index.stats), "part")
    each = weighed.select("query", "part", "block", "mean", idf().alias("idf"), F.explode(F.arrays_zip("places", "tfs", "n_terms")).alias("x"))
    return each.groupBy("query", "part", "block", F.col("x.places").alias("place")).agg(F.round(F.sum(F.col("idf") * weight(F.col("x.tfs"), F.col("x.n_terms"))), DIGITS).alias("score"))


def best_of(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query", "part").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def retrieved_by_words(families: DataFrame, chunks: DataFrame, family_topics: Mapping[str, Sequence[str]] = TOPICS, keywords: Mapping[str, Sequence[str]] = TOPIC_KEYWORDS, k: int = 3, least: int = 1) -> DataFrame:
    """failure_family, doc_type, chunk_ids: the ``k`` best chunks of each type for the words of a family's topics; where
    none has such a word, the ``least`` longest, as ``matching.retrieved`` does."""
    spark = chunks.sparkSession
    words = spark.createDataFrame([(f, w) for f, topics in family_topics.items() for t in topics for w in keywords[t]], "query string, word string")
    wanted = families.select(F.col("failure_family").alias("query")).distinct()
    asked = words.join(wanted, "query", "left_semi").select("query", F.explode(terms(F.col("word"))).alias("term"))
    index = inverted(chunks, size="n_tokens")  # which keeps sizes too, so that texts are cut once
    found = saved(bm25(index, asked, k), "found").select("query", "part", "nth", "chunk_id")
    longest = Window.partitionBy("part").orderBy(F.desc("size"), "chunk_id")
    usual = index.chunks().withColumn("nth", F.row_number().over(longest)).where(F.col("nth") <= least)
    lacking = wanted.crossJoin(index.stats.select("part")).join(found, ["query", "part"], "left_anti")  # families times types, both closed lists
    every = found.unionByName(lacking.join(usual, "part").select("query", "part", "nth", "chunk_id"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("nth", "chunk_id"))), lambda x: x["chunk_id"])
    return every.groupBy(F.col("query").alias("failure_family"), F.col("part").alias("doc_type")).agg(ids.alias("chunk_ids"))
