"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries become whole numbers floor(64 c) + 1000000; sums are exact, and every covariance is centred before it is
multiplied.  The covariance V of d dimensions is never made: Spark only multiplies it with a block of k vectors
(a pass over all rows: the sum of Xc' (Xc Q), pre-added by each task), and the driver holds d x k numbers, whatever the
number of rows.  A Chebyshev polynomial of V, by its three-term recurrence of passes, damps the unwanted spectrum
[0, smallest Ritz value]; then QR, and Rayleigh-Ritz in the block.  That repeats until every wanted pair is certified:
the residual |V q - e q| is at rounding level, which for a symmetric matrix bounds the distance to a true eigenvalue.
Pairs certified are locked; a block that gains too little grows, so that clustered eigenvalues end the iteration too.

Passes read blocks of rows in the smallest integer type that holds them, written once to the shared folder.

Defined results: rows whose vector is null, or holds null, NaN or infinite entries, are dropped, and so are those whose
length isn't the commonest (ties: the longest); entries beyond +-2^32 count as +-2^32; repeated rows count each;
components of no variance (e <= 1e-12 of the trace) are left out, so one row, or rows all equal, give no
components; a deviation beyond 64 bits is null; equal eigenvalues have any basis of their space; an empty table
gives no rows. Input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .rows import freed
from .storage import new_path

SCALE, OFFSET, LARGEST = 64, 1_000_000, 2**32
BLOCK_BYTES = 4 << 20
NO_VARIANCE = 1e-12
#: Growth of the largest unlocked eigenvalue over the unwanted ones in one filter, and the degree, at most.
GROWTH, DEGREE = 1e10, 24
#: A filter that lowers the largest residual less than so many times is taken for too slow.
SLOW = 4


class Whitening(NamedTuple):
    """n fitted rows and their exact sums by dimension (of x - OFFSET); eigenvalues, falling, and components as columns;
    the trace of V; the largest residual, as a share of the largest eigenvalue; the largest entry of the
    covariance of whitened rows less the identity; passes over the rows; the largest |x - OFFSET|."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float
    residual: float
    identity_error: float
    passes: int
    largest: int


def whole(df: DataFrame, vector: str) -> DataFrame:
    """The rows to fit, with ``x``: the entries as whole numbers, less OFFSET."""
    valid = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = df.where(F.col(vector).isNotNull() & valid)
    usual = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    bound = lambda c: F.greatest(F.least(c.cast("double"), F.lit(float(LARGEST))), F.lit(-float(LARGEST)))
    return rows.where(F.size(vector) == (usual.d if usual else 0)).withColumn("x", F.transform(vector, lambda c: F.floor(bound(c) * SCALE)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows as blocks of a few MB, in the smallest integer type, written to the shared folder."""
    fields = T.StructType([T.StructField("kind", T.StringType()), T.StructField("rows", T.IntegerType()), T.StructField("x", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0))
            step = max(1, BLOCK_BYTES // max(8, 8 * x.shape[1]))
            for k in range(0, len(x), step):
                part = x[k : k + step]
                kind = next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= part.min(initial=0) and part.max(initial=0) <= np.iinfo(t).max)
                yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([len(part)], pa.int32()), pa.array([part.astype(kind).tobytes()], pa.binary())], names=fields.names)

    path = new_path(rows.sparkSession, "vectors")
    rows.select("x").mapInArrow(freed(run), fields).write.parquet(path)
    return rows.sparkSession.read.schema(fields).parquet(path)


def _total(blocks: DataFrame, of: Callable[[np.ndarray], np.ndarray], kind: str) -> list:
    """The sum over all blocks of the numbers that ``of`` gives for one: each task adds its own up, Spark adds tasks.
    Whole numbers are exact: a task's are of 64 bits (it would take 2^24 rows at LARGEST to leave them), sums of 128."""
    exact = kind == "long"
    fields = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("value", T.LongType() if exact else T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for t, rows, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                one = of(np.frombuffer(x, t).astype(np.int64).reshape(rows, -1))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel(), pa.int64() if exact else pa.float64())], names=fields.names)

    value = F.col("value").cast("decimal(38,0)") if exact else F.col("value")
    found = blocks.mapInArrow(freed(run), fields).groupBy("at").agg(F.sum(value).alias("value")).collect()
    return [r.value for r in sorted(found, key=lambda r: r.at)]


def _centre(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact: as 64-bit numbers where they hold it, else as Python's."""
    return (x.astype(sums.dtype) * n if sums.dtype == object else x * n) - sums


def _as_sums(n: int, sums: tuple[int, ...], largest: int) -> np.ndarray:
    fits = 2 * n * max(1, largest) < 2**62
    return np.array(sums, dtype=np.int64 if fits else object)


def fit(rows: DataFrame, count: int = 32, seed: int = 0, guard: int = 16) -> Whitening | None:
    """The leading ``count`` components of ``rows`` (of ``whole``); None where there is no row."""
    blocks = _blocks(rows)
    sized = blocks.agg(F.sum("rows").alias("n")).first()
    n = int(sized.n or 0)
    if not n:
        return None
    sums = tuple(int(v) for v in _total(blocks, lambda x: x.sum(axis=0), "long"))
    d = len(sums)
    top = blocks.mapInArrow(_largest, "value long").agg(F.max("value")).first()[0] or 0
    exact = _as_sums(n, sums, int(top))
    passes = 2

    def centred(x: np.ndarray) -> np.ndarray:
        return _centre(x, n, exact).astype(np.float64) / n

    def times(q: np.ndarray) -> np.ndarray:
        """V q, by a pass over all rows."""
        nonlocal passes
        passes += 1

        def of(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            return c.T @ (c @ q)

        return np.array(_total(blocks, of, "double")).reshape(d, -1) / n

    trace = _total(blocks, lambda x: np.array([np.square(centred(x)).sum()]), "double")[0] / n if d else 0.0
    if not trace:
        return Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0, 0.0, 0.0, passes, int(top))
    rng = np.random.default_rng(seed)
    wanted = min(count, d)
    q, _ = np.linalg.qr(rng.standard_normal((d, min(d, count + guard))))
    certain = 4 * np.finfo(float).eps * np.sqrt(d)
    locked, before = 0, np.inf
    while True:
        y = times(q)
        values, turn = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, y = q @ turn, y @ turn
        residuals = np.linalg.norm(y - q * values, axis=0)[:wanted] / values[0]
        worst = float(residuals.max())
        # at rounding level, or so near that another round no longer gains
        if worst <= certain or (worst <= 100 * certain and worst > before / 2):
            break
        locked = int(np.argmax(residuals > certain)) if worst > certain else wanted
        if worst > before / SLOW and q.shape[1] < d:  # too slow: a wider block has fewer unwanted directions near it
            q = np.linalg.qr(np.hstack((q, rng.standard_normal((d, min(d - q.shape[1], q.shape[1]))))))[0]
            before = np.inf
            continue
        before = worst
        q = _filtered(times, q, values, locked)
    values, q = values[:wanted], q[:, :wanted]
    real = values > NO_VARIANCE * trace
    values, q = values[real], q[:, real]
    scaled = q / np.sqrt(values)
    k = len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ scaled
        return np.concatenate((w.sum(axis=0)[None], w.T @ w))

    found = np.array(_total(blocks, moments, "double")).reshape(k + 1, k) / n
    # the rows are centred already: what is left of a mean is rounding
    error = float(np.abs(found[1:] - np.outer(found[0], found[0]) - np.eye(k)).max())
    return Whitening(n, sums, values, q, float(trace), worst, error, passes + 2, int(top))


def _largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [int(np.abs(np.frombuffer(x, t).astype(np.int64)).max(initial=0)) for t, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["value"])


def _filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, values: np.ndarray, locked: int) -> np.ndarray:
    """The block after a Chebyshev filter of its unlocked vectors, orthonormal again."""
    low, high, fixed, x = max(float(values[-1]), 0.0), float(values[locked]), q[:, :locked], q[:, locked:]

    def apart(x: np.ndarray) -> np.ndarray:
        """V x without the locked directions, which the polynomial would raise from rounding error."""
        y = times(x)
        return y - fixed @ (fixed.T @ y)

    if low <= 0 or high <= low:
        filtered = apart(x)
    else:
        middle = half = low / 2  # of [0, low], the unwanted spectrum
        degree = int(np.clip(np.log(GROWTH) / np.arccosh((high - middle) / half), 2, DEGREE))
        first = half / (high - middle)
        sigma, old, filtered = first, x, (apart(x) - middle * x) * (first / half)
        for _ in range(degree - 1):
            new = 1 / (2 / first - sigma)
            old, filtered = filtered, (apart(filtered) - middle * filtered) * (2 * new / half) - old * (sigma * new)
            sigma = new
    filtered = filtered / np.linalg.norm(filtered, axis=0)
    return np.linalg.qr(np.hstack((fixed, filtered)))[0]


def project(rows: DataFrame, model: Whitening, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``rows`` (of ``whole``) with ``deviation`` (of n x - S, exact) and ``whitened``, an entry for
    each component."""
    source = rows.select(*keep, "x")
    out = T.StructType([source.schema[c] for c in keep] + [T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType(), False))])
    arrow = to_arrow_schema(out)
    n, k, scaled = model.n, len(model.values), model.components / np.sqrt(model.values)
    sums = _as_sums(n, model.sums, model.largest)
    narrow = sums.dtype != object and len(sums) * (2 * n * max(1, model.largest)) ** 2 < 2**62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = _centre(_matrix(batch.column(len(keep))), n, sums)
            if narrow:
                deviation = pa.array(np.square(c).sum(axis=1))
            else:
                deviation = pa.array([t if t < 2**63 else None for t in (int(v) for v in np.square(c.astype(object)).sum(axis=1))], pa.int64())
            w = (c.astype(np.float64) / n) @ scaled
            lists = pa.ListArray.from_arrays(np.arange(0, (len(w) + 1) * k, k, dtype=np.int32) if k else np.zeros(len(w) + 1, np.int32), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), deviation, lists.cast(arrow.field("whitened").type)], names=out.names)

    return source.mapInArrow(freed(run), out)


def whiten(df: DataFrame, vector: str = "embedding", keep: list[str] | None = None, count: int = 32) -> DataFrame:
    """A row for each remaining row of ``df`` and component: columns ``keep`` (default: all), component from 1, n,
    deviation, whitened, explained, identity_error."""
    new = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    names = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    kept = [f"kept_{i}" for i in range(len(names))]  # names of their own, whatever the input's are
    rows = whole(df.select(*[df[f"`{c}`"].alias(k) for c, k in zip(names, kept, strict=True)], df[f"`{vector}`"].alias("vector")), "vector")
    model = fit(rows, count)
    if model is None:
        model, rows = Whitening(0, (), np.zeros(0), np.zeros((0, 0)), 0.0, 0.0, 0.0, 0, 0), rows.limit(0)
    shares = (model.values / model.trace).tolist() if len(model.values) else [0.0]
    each = project(rows, model, kept).select(*kept, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        *[F.col(k).alias(c) for c, k in zip(names, kept, strict=True)], (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(F.array(*map(F.lit, shares)), F.col("at") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
