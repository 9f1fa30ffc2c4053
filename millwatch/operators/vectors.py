"""Nearest vectors by cosine, over an index of inverted lists.

Centroids are fitted on a bounded sample of rows (those with the least hash of their id); every row is put into the list
of its nearest centroid.  A search compares each query with the rows of its nearest lists, as many as the sample needed for
the wanted recall.  With ``exact``, further lists follow: all that, by their largest angle to their centroid, could hold
something nearer than the k-th found, so nothing is lost.  Lists of many rows, and lists that many queries ask for, are
parted, so a task compares ``LIST_ROWS`` rows with ``QUERY_ROWS`` queries at most, about.

Rows whose vector is null, has null or non-finite entries, another length than ``dims``, or no direction (all zero), are
not compared; equal vectors are equally near and follow by id; a row is no neighbour of its own id.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import saved

FIT_ROWS, MOST_LISTS, ROUNDS = 20_000, 4096, 12
LIST_ROWS, QUERY_ROWS = 8192, 4096
DIGITS = 6


class VectorIndex(NamedTuple):
    """vectors: id, unit, list; lists: list, n, reach (the largest angle of a row to its centroid), at most MOST_LISTS
    rows; probes: lists that a search compares first."""

    vectors: DataFrame
    lists: DataFrame
    centroids: np.ndarray
    probes: int


def usable(vector: str, dims: int) -> Column:
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (F.size(vector) == dims) & sound & F.exists(vector, lambda c: c != 0)


def _units(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _fitted(sample: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Centroids of unit length: means of the sample's rows nearest to each, again and again."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(ROUNDS):
        near = (sample @ centroids.T).argmax(axis=1)
        total = np.zeros_like(centroids)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centroids = np.where(size > 0, total / np.maximum(size, 1e-300), centroids)
    return centroids


def _probes(sample: np.ndarray, centroids: np.ndarray, k: int, recall: float) -> int:
    """How many lists hold that share of the true neighbours of some of the sample among all of it. The sample is sparser
    than all rows, so that neighbours there lie farther: the number errs on the safe side."""
    asked = sample[:256]
    near = (sample @ centroids.T).argmax(axis=1)
    close = asked @ sample.T
    close[np.arange(len(asked)), np.arange(len(asked))] = -2
    true = np.argsort(-close, axis=1)[:, :k]
    rank = np.argsort(np.argsort(-(asked @ centroids.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(rank, near[true], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1 if len(needed) else len(centroids)


def indexed(rows: DataFrame, key: str, vector: str, dims: int, k: int = 10, recall: float = 0.95, lists: int | None = None, seed: int = 0) -> VectorIndex:
    """The index of all usable ``rows``, written to the shared folder."""
    whole = rows.where(usable(vector, dims)).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    n = whole.count()
    sample = _units(pa.array([r.v for r in whole.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).collect()], pa.list_(pa.float64()))) if n else np.zeros((0, dims))
    count = min(lists or int(np.ceil(np.sqrt(n))), MOST_LISTS, max(1, len(sample)))
    centroids = _fitted(sample, count, seed) if n else np.zeros((1, dims))
    fields = T.StructType([whole.schema["id"], T.StructField("unit", T.ArrayType(T.DoubleType())), T.StructField("list", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _units(batch.column(1))
                close = x @ centroids.T
                near = close.argmax(axis=1)
                angle = np.arccos(np.clip(close[np.arange(len(x)), near], -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64())), pa.array(near, pa.int32()), pa.array(angle)], names=fields.names)

    vectors = saved(whole.mapInArrow(run, fields), "vectors")
    return VectorIndex(vectors, saved(vectors.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("reach")), "lists"), centroids, min(_probes(sample, centroids, k, recall), count))


def nearest(index: VectorIndex, queries: DataFrame, key: str, vector: str, k: int = 10, exact: bool = False) -> DataFrame:
    """id, nth, neighbour, similarity (to DIGITS digits): the ``k`` nearest rows of each query, nearest first."""
    centroids, probes = index.centroids, index.probes
    fields = T.StructType([T.StructField("id", queries.schema[key].dataType), T.StructField("unit", T.ArrayType(T.DoubleType())), T.StructField("angles", T.ArrayType(T.DoubleType())), T.StructField("first", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _units(batch.column(1))
                angles = np.arccos(np.clip(x @ centroids.T, -1, 1))
                first = np.argsort(angles, axis=1, kind="stable")[:, :probes].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64())), pa.array(list(angles), pa.list_(pa.float64())), pa.array(list(first), pa.list_(pa.int32()))], names=fields.names)

    whole = queries.where(usable(vector, centroids.shape[1])).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    asked = saved(whole.mapInArrow(run, fields), "vector-queries")
    found = _best(_compared(index, asked.select("id", "unit", F.explode("first").alias("list")), k), k)
    if not exact:
        return found
    found = saved(found, "vector-first")
    floor = found.where(F.col("nth") == k).select("id", F.acos(F.greatest(F.lit(-1.0), F.col("similarity") - 10**-DIGITS)).alias("angle"))
    reach = F.element_at("angles", F.col("list") + 1) - F.col("reach") - 1e-7
    # every query meets every list's bounds, of which there are MOST_LISTS at most
    rest = asked.join(floor, "id", "left").join(F.broadcast(index.lists.select("list", "reach")), F.col("angle").isNull() | (reach <= F.col("angle"))).where(~F.array_contains("first", F.col("list")))
    more = _compared(index, rest.select("id", "unit", "list"), k)
    return _best(found.select("id", "neighbour", "similarity").unionByName(more), k)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return pairs.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).select("id", "nth", "neighbour", "similarity")


def _compared(index: VectorIndex, asked: DataFrame, k: int) -> DataFrame:
    """id, neighbour, similarity: the ``k`` nearest of each part of each list that a query (id, unit, list) asks for."""
    asked = saved(asked, "vector-asked")
    parts = lambda n, most: F.greatest(F.lit(1), F.ceil(F.col(n) / most)).cast("int")
    sizes = index.lists.select("list", parts("n", LIST_ROWS).alias("parts")).join(asked.groupBy("list").agg(F.count("*").alias("m")), "list").withColumn("sides", parts("m", QUERY_ROWS))
    sizes = F.broadcast(saved(sizes.select("list", "parts", "sides"), "vector-sizes"))
    spread = lambda id, n: F.pmod(F.xxhash64(id), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, "list").withColumn("side", spread("id", "sides")).withColumn("part", every("parts")).select("list", "part", "side", "id", "unit")
    right = index.vectors.join(sizes, "list").withColumn("part", spread("id", "parts")).withColumn("side", every("sides")).select("list", "part", "side", "id", "unit")
    schema = T.StructType([T.StructField("id", asked.schema["id"].dataType), T.StructField("neighbour", index.vectors.schema["id"].dataType), T.StructField("similarity", T.DoubleType())])

    def compare(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"id": [], "neighbour": [], "similarity": []})
        rows = rows.sort_values("id")
        ids, x = rows["id"].to_numpy(), np.stack(rows["unit"].to_numpy())
        out = []
        for low in range(0, len(queries), 256):
            some = queries.iloc[low : low + 256]
            close = np.round(np.stack(some["unit"].to_numpy()) @ x.T, DIGITS)
            close[some["id"].to_numpy()[:, None] == ids] = -2
            best = np.argsort(-close, axis=1, kind="stable")[:, :k]  # among equals the smaller id
            near = np.take_along_axis(close, best, axis=1)
            q = np.repeat(some["id"].to_numpy(), best.shape[1])
            there = near.ravel() > -2
            out.append(pd.DataFrame({"id": q[there], "neighbour": ids[best.ravel()][there], "similarity": near.ravel()[there]}))
        return pd.concat(out)

    by = ["list", "part", "side"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(compare, schema)
