"""Whitening: vectors on the leading unit eigenvectors of their covariance, over the root of the eigenvalue.

Spark sums whole numbers by dimension, then the products of the centred vectors; each task gives
one matrix, and matrices are summed in a tree of FAN at a time, so no task holds more than that.

The eigenvalues of the covariance come from *spectrum slicing*: the LDLt factors of V - s I have
as many negative pivots as V has eigenvalues below s, so bisection on s isolates the k-th largest
one in an interval that holds no other.  *Rayleigh quotient iteration* from there converges
cubically; its value must lie in the interval, else bisection goes on.  At the end a count on
either side of every value certifies its number.  Eigenvalues closer than CLOSE of the trace count
as one of several: their vectors are iterated at right angles to those found before.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import Scratch

#: Matrices summed at a step of the tree.
FAN = 32
#: Gap between eigenvalues, as a share of the trace, below which they count as equal.
CLOSE = 1e-13
#: Eigenvalues below this share of the trace have no direction of their own: rounding alone makes them.
NONE = 1e-13
#: Rows multiplied at a time.
ROWS = 4096


def inertia(matrix: np.ndarray) -> tuple[int, int, int]:
    """(negative, zero, positive) eigenvalues of a symmetric matrix, from its LDLt factors with pivots of one or two rows."""
    a = np.array(matrix, np.float64)
    below = zero = above = 0
    bound = (1 + np.sqrt(17)) / 8
    while len(a):
        top = int(np.argmax(np.abs(np.diag(a))))
        off = np.abs(a - np.diag(np.diag(a)))
        i, j = np.unravel_index(int(np.argmax(off)), off.shape)
        if a[top, top] == 0 and off[i, j] == 0:
            zero += len(a)
            break
        if abs(a[top, top]) >= bound * off[i, j]:
            pick = [top]
            if a[top, top] < 0:
                below += 1
            else:
                above += 1
        else:  # the block of the largest entry beside the diagonal has one eigenvalue of each sign
            pick = [int(i), int(j)]
            below, above = below + 1, above + 1
        rest = np.setdiff1d(np.arange(len(a)), pick)
        block, side = a[np.ix_(pick, pick)], a[np.ix_(rest, pick)]
        left = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        a = (left + left.T) / 2
    return below, zero, above


def leading_eigenpairs(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues that aren't zero, falling, and their unit vectors as columns."""
    d = len(v)
    scale = float(np.trace(v))
    values: list[float] = []
    vectors = np.zeros((d, 0))
    if not d or scale <= 0:
        return np.zeros(0), vectors
    tiny = CLOSE * scale
    eye = np.eye(d)

    seen: dict[float, int] = {}

    def above(s: float) -> int:
        if s not in seen:
            seen[s] = inertia(v - s * eye)[2]
        return seen[s]

    ceiling = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-12)
    floor = NONE * scale
    known = above(floor)
    for number in range(1, min(k, d) + 1):
        if known < number:
            break
        above(ceiling)
        low = max(s for s, count in seen.items() if count >= number)
        high = min(s for s, count in seen.items() if count < number)
        while True:
            alone = above(low) == number and above(high) == number - 1
            if alone or high - low <= tiny:
                found = _rayleigh(v, (low + high) / 2, vectors if high - low <= tiny else vectors[:, :0], number)
                if found is not None and low - tiny <= found[0] <= high + tiny and np.abs(found[1] @ vectors).max(initial=0) < 1e-6:
                    break
                if high - low <= tiny:
                    raise ArithmeticError(f"no eigenvector for eigenvalue {number}")
            middle = (low + high) / 2
            if above(middle) >= number:
                low = middle
            else:
                high = middle
        values.append(found[0])
        vectors = np.column_stack([vectors, found[1]])
    for number, value in enumerate(values, 1):
        slack = 4 * tiny
        if above(value + slack) >= number or above(value - slack) < number:
            raise ArithmeticError(f"eigenvalue {number} isn't the {number}. largest")
    return np.array(values), vectors


def _rayleigh(v: np.ndarray, start: float, beside: np.ndarray, seed: int) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration from a shift, at right angles to the columns of ``beside``."""
    d = len(v)
    x = np.random.default_rng([seed, d]).standard_normal(d)
    shift, best, kept = start, np.inf, None
    norm = float(np.abs(v).sum(axis=1).max())
    for step in range(60):
        try:
            y = np.linalg.solve(v - shift * np.eye(d), x)
        except np.linalg.LinAlgError:
            y = np.linalg.solve(v - (shift + 4e-16 * norm) * np.eye(d), x)
        y /= np.abs(y).max()
        for _ in range(2):
            y -= beside @ (beside.T @ y)
        x = y / np.linalg.norm(y)
        if step < 2:  # two steps at the slice's own shift turn the vector towards the isolated value
            continue
        value = float(x @ v @ x)
        residual = float(np.linalg.norm(v @ x - value * x))
        if residual >= best / 2 and best <= 1e-12 * norm:
            return kept
        if residual < best:
            best, kept = residual, (value, x)
        shift = value
    return kept if best <= 1e-10 * norm else None


def _whole(column: pa.Array, factor: int, offset: int) -> np.ndarray:
    """floor(factor * c) + offset of equal-length lists, as longs."""
    data = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    x = np.floor(factor * data)
    if len(x) and np.abs(x).max() > 2.0**52:
        raise ArithmeticError("a component is too large for exact whole numbers")
    return x.astype(np.int64) + offset


def _sums(batches: Iterator[pa.RecordBatch], factor: int, offset: int) -> Iterator[pa.RecordBatch]:
    """A task's rows and its sums by dimension."""
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            x = _whole(batch.column("embedding"), factor, offset)
            n += len(x)
            total = x.sum(axis=0) if total is None else total + x.sum(axis=0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["n", "sums"])


def _centred(batch: pa.RecordBatch, factor: int, offset: int, n: int, middle: np.ndarray, rest: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x - m, x - S / n), where m is the whole number nearest S / n and n m - S = rest."""
    x = _whole(batch.column("embedding"), factor, offset) - middle
    if len(x) and float(np.abs(x).max()) * x.shape[1] * max(float(np.abs(x).max()), n) >= 2.0**62:
        raise ArithmeticError("the sums of a row's deviation pass 64 bits")
    for at in range(0, len(x), ROWS):
        yield x[at : at + ROWS], x[at : at + ROWS] + rest / n


def _products(batches: Iterator[pa.RecordBatch], turn: np.ndarray | None, **about) -> Iterator[pa.RecordBatch]:
    """A task's sum of x x' over centred vectors, turned by ``turn`` if given."""
    total = None
    for batch in batches:
        for _, x in _centred(batch, **about) if batch.num_rows else ():
            y = x if turn is None else x @ turn
            total = y.T @ y if total is None else total + y.T @ y
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])


def _add(table: pa.Table) -> pa.Table:
    parts = sorted(v.as_py() for v in table.column("total"))
    total = np.sum([np.frombuffer(p) for p in parts], axis=0)
    return pa.table({"part": table.column("part")[:1], "total": pa.array([total.tobytes()], pa.binary())})


def _covariance(scratch: Scratch, vectors: DataFrame, n: int, d: int, name: str, turn: np.ndarray | None = None, **about) -> np.ndarray:
    """The sum of products over all rows, by a tree of sums, over n."""
    tasks = vectors.mapInArrow(partial(_products, turn=turn, n=n, **about), "total binary")
    level = scratch.save(tasks.withColumn("part", F.spark_partition_id().cast("long")), f"{name}-0")
    parts, step = (level.agg(F.max("part")).first()[0] or 0) + 1, 0
    while parts > 1:
        parts, step = -(-parts // FAN), step + 1
        level = scratch.save(
            level.withColumn("part", F.expr(f"part div {FAN}")).groupBy("part").applyInArrow(_add, "part long, total binary"),
            f"{name}-{step}",
        )
    return np.frombuffer(bytes(level.first().total)).reshape(d, -1) / n


def _project(
    batches: Iterator[pa.RecordBatch], turn: np.ndarray, factor: int, offset: int, n: int, middle: np.ndarray, rest: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """Each row's coordinates, and the two whole sums that its deviation is made of."""
    for batch in batches:
        for at, (whole, x) in enumerate(_centred(batch, factor, offset, n, middle, rest) if batch.num_rows else ()):
            told = x @ turn
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").slice(at * ROWS, len(x)), pa.array((whole * whole).sum(axis=1)), pa.array(whole @ rest),
                 pa.array(list(told), pa.list_(pa.float64()))],
                names=["vec_id", "squares", "products", "whitened"],
            )


def whiten(spark: SparkSession, vectors: DataFrame, k: int = 8, factor: int = 1024, offset: int = 100_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector of ``vectors`` (vec_id, embedding, ...) and component.

    Each component c of a vector becomes the whole number x = floor(factor * c) + offset; the fit
    is over all rows.  ``deviation`` is decimal(38,0), exact.  Rows whose vector is null, empty or
    holds null or non-finite entries take no part.  Eigenvalues of zero (fewer distinct vectors
    than components, constant dimensions) have no direction and give no rows, so one row, or only
    equal rows, give none.  Repeated rows and null vec_ids count and come back like all others;
    other columns are not read.  Vectors of several lengths raise ValueError.
    """
    scratch = Scratch(spark, "whiten")
    c = F.col("embedding")
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), c.cast("array<double>").alias("embedding")).filter(
        F.coalesce((F.size(c) > 0) & ~bad, F.lit(False))
    )
    sizes = kept.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if sizes[0] is None:
        return spark.createDataFrame([], schema)
    if sizes[0] != sizes[1]:
        raise ValueError(f"vectors of {sizes[0]} and of {sizes[1]} components")
    d = sizes[0]
    only = kept.select("embedding")
    tasks = only.mapInArrow(partial(_sums, factor=factor, offset=offset), "n long, sums array<long>")
    totals = tasks.select("n", F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    found = {r["at"]: r for r in totals.collect()}  # one row per dimension
    n, sums = found[0].n, [found[j].x for j in range(d)]
    middle = [(2 * s + n) // (2 * n) for s in sums]
    about = {
        "factor": factor, "offset": offset, "middle": np.array(middle), "rest": np.array([n * m - s for m, s in zip(middle, sums)]),
    }
    v = _covariance(scratch, only, n, d, "products", **about)
    v = (v + v.T) / 2
    values, axes = leading_eigenpairs(v, k)
    if not len(values):
        return spark.createDataFrame([], schema)
    turn = axes / np.sqrt(values)
    error = float(np.abs(_covariance(scratch, only, n, len(values), "identity", turn=turn, **about) - np.eye(len(values))).max())
    squares = sum(int(t) ** 2 for t in about["rest"])
    explained = F.array(*[F.lit(float(e / np.trace(v))) for e in values])

    def wide(x):
        return F.lit(x).cast("decimal(38,0)") if isinstance(x, int) else F.col(x).cast("decimal(20,0)")

    deviation = (wide("squares") * wide(n * n)).cast("decimal(38,0)") + (wide("products") * wide(2 * n)).cast("decimal(38,0)") + wide(squares)
    return (
        kept.mapInArrow(partial(_project, turn=turn, n=n, **about), "vec_id long, squares long, products long, whitened array<double>")
        .select("vec_id", deviation.cast("decimal(38,0)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
        .select(
            "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
            F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
        )
    )
