"""Approximate nearest neighbours by collision counting over single-projection sorted arrays.

Each of M random projections sorts a block's vectors by their value.  A query opens a window
around its own value in every array; windows grow by the factor GROWTH (virtual rehashing: no
array is built again).  A vector met in at least NEEDED windows has collided often enough and is
verified by its exact distance.  A block is done when the K-th distance found is within the
radius whose neighbours the windows then hold with high probability, or when every vector has
been verified.

The table is cut into blocks of about BLOCK vectors by hash, and the queries into groups, so that
a task holds one block and one group whatever the size of either table.  Each block gives its
own K nearest; the last step ranks them for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.llm.common import Scratch
from ledgerline.llm.vectors import matrix, taking_part

#: Projections, the share of their windows in which a vector must lie, and the windows' growth.
PROJECTIONS, NEEDED, GROWTH = 64, 0.60, 1.25
#: Half width of a window for radius r: a vector at distance r lies in it with probability 0.73.
WIDTH = 1.10
#: Vectors in a block, queries in a group.
BLOCK, QUERIES = 8192, 2048
#: Queries whose windows grow in step, and vectors of a block that set a query's first radius.
TOGETHER, SAMPLE = 64, 256


def search_block(
    data: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, seed: int, own: tuple[np.ndarray, np.ndarray] | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, block rows, distances) of the k nearest that the collision counts find in a block.

    ``own`` names the vectors and the queries; one of a query's name isn't its candidate (by default: of its id).
    """
    names, skipped = own or (ids, query_ids)
    n, d = data.shape
    axes = np.random.default_rng(seed).standard_normal((d, PROJECTIONS))
    values = np.ascontiguousarray((data @ axes).T)
    order = np.argsort(values, axis=1, kind="stable")
    arrays = np.take_along_axis(values, order, axis=1)
    centres = np.ascontiguousarray((queries @ axes).T)
    needed = int(np.ceil(NEEDED * PROJECTIONS))
    start = first_radii(data, queries, k, seed)
    for first in range(0, len(queries), TOGETHER):
        rows = np.arange(first, min(first + TOGETHER, len(queries)))
        radius = start[rows]
        low = np.stack([np.searchsorted(a, c) for a, c in zip(arrays, centres[:, rows])])
        high = low.copy()
        counts = np.zeros((len(rows), n), np.int32)
        tested = names[None, :] == skipped[rows][:, None]
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64))] * len(rows)
        active = np.arange(len(rows))
        while len(active):
            reach, at = WIDTH * radius[active], centres[:, rows[active]]
            lower = np.stack([np.searchsorted(a, c - reach, side="left") for a, c in zip(arrays, at)])
            upper = np.stack([np.searchsorted(a, c + reach, side="right") for a, c in zip(arrays, at)])
            lower, upper = np.minimum(lower, low[:, active]), np.maximum(upper, high[:, active])
            going = []
            for column, q in enumerate(active):
                old_low, old_high = low[:, q].tolist(), high[:, q].tolist()
                new_low, new_high = lower[:, column].tolist(), upper[:, column].tolist()
                met = [o[x:y] for o, x, y in zip(order, new_low, old_low)] + [o[x:y] for o, x, y in zip(order, old_high, new_high)]
                counts[q] += np.bincount(np.concatenate(met), minlength=n).astype(np.int32)
                new = np.flatnonzero((counts[q] >= needed) & ~tested[q])
                if len(new):
                    tested[q, new] = True
                    gap = data[new] - queries[rows[q]]  # squares are added up from the first component on
                    dist = np.concatenate([best[q][0], np.sqrt(np.cumsum(gap * gap, axis=1)[:, -1])])
                    found = np.concatenate([best[q][1], new])
                    keep = np.lexsort((names[found], ids[found], dist))[:k]
                    best[q] = dist[keep], found[keep]
                full = len(best[q][0]) >= k and best[q][0][-1] <= radius[q]
                # With every array open, every vector has met the query in all of them.
                if not full and not tested[q].all():
                    going.append(q)
            low[:, active], high[:, active] = lower, upper
            active = np.array(going, np.int64)
            radius[active] *= GROWTH
        for q, (dist, found) in enumerate(best):
            yield int(rows[q]), found, dist


def first_radii(data: np.ndarray, queries: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Each query's first radius: half its smallest positive distance to SAMPLE of the block's vectors.

    Only where the windows start depends on it: they grow until the stopping rule holds.
    """
    n = len(data)
    picked = data[np.random.default_rng([seed, 1]).choice(n, min(n, SAMPLE), replace=False)]
    squares = (queries**2).sum(axis=1)[:, None] + (picked**2).sum(axis=1) - 2 * queries @ picked.T
    least = np.finfo(np.float64).eps * 64 * np.maximum((queries**2).sum(axis=1)[:, None], (picked**2).sum(axis=1))
    return 0.5 * np.sqrt(np.where(squares > least, squares, least + np.finfo(np.float64).tiny).min(axis=1))


_FOUND = pa.schema([("asker", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.float64())])


def _search(left: pa.Table, right: pa.Table, k: int, seed: int, by_row: bool) -> pa.Table:
    """One block and one group of queries."""
    if not len(left) or not len(right):
        return _FOUND.empty_table()
    data, queries = matrix(left.column("embedding")), matrix(right.column("embedding"))
    ids, query_ids, rows, askers = (t.column(c).to_numpy() for t, c in ((left, "vec_id"), (right, "vec_id"), (left, "row"), (right, "row")))
    out: list[list[np.ndarray]] = [[np.empty(0, f.type.to_pandas_dtype())] for f in _FOUND]
    for q, found, dist in search_block(data, ids, queries, query_ids, k, seed, (rows, askers) if by_row else None):
        told = (np.full(len(found), askers[q]), np.full(len(found), query_ids[q]), ids[found], rows[found], dist)
        for column, values in zip(out, told):
            column.append(values)
    return pa.table([pa.array(np.concatenate(c), f.type) for c, f in zip(out, _FOUND)], schema=_FOUND)


def nearest(spark: SparkSession, vectors: DataFrame, queries: DataFrame | str, *, k: int = 10, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found by Euclidean distance.

    ``vectors`` has (vec_id, embedding).  ``queries`` is a condition on its rows, and a query's own
    row is no candidate (another row of its id is); or a table of its own (vec_id, embedding), and
    the vectors of a query's id are left out.  Vectors that are null, empty, zero or hold null or
    non-finite components take no part; vectors of another length than a query's aren't its
    candidates.  Ties go to the smaller vec_id.  A query with fewer candidates than k gets all
    of them; without candidates it has no row.  Rows of one id are queries and candidates of their
    own; a null vec_id takes no part.  Other columns are read by the condition only.
    """
    scratch = Scratch(spark, "collision-ann")
    by_row = isinstance(queries, str)

    def numbered(df: DataFrame, name: str) -> DataFrame:
        kept = df.filter("vec_id is not null").withColumn("dim", F.size("embedding"))
        return scratch.save(kept.withColumn("row", F.monotonically_increasing_id()), name)

    if by_row:
        asks = F.coalesce(F.expr(queries), F.lit(False))
        data = numbered(taking_part(vectors.withColumn("_asks", asks), "_asks"), "vectors")
        asked = scratch.save(data.filter("_asks").drop("_asks"), "queries")
        data = data.drop("_asks")
    else:
        data, asked = numbered(taking_part(vectors), "vectors"), numbered(taking_part(queries), "queries")
    blocks = max(1, -(-data.count() // BLOCK))
    groups = max(1, -(-asked.count() // QUERIES))
    left = data.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    )
    right = asked.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(groups)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    )
    keys = ["dim", "block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        lambda key, left, right: _search(left, right, k, seed, by_row), "asker long, query_id long, vec_id long, row long, score double"
    )
    of_query = W.partitionBy("asker").orderBy("score", "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(of_query)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
