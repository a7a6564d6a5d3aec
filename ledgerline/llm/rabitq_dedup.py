"""Embedding near-dedup with randomised-rotation binary codes.

Unit vectors are turned by a random rotation and coded by the signs of their components; with
each code its correction factor <code, vector> is stored.  For another vector y the quotient
<code, y> / factor is an unbiased estimate of the inner product, and its error stays within
CONFIDENCE * sqrt((1 - factor^2) / factor^2 / (dim - 1)) with high probability: pairs whose bound
lies below the threshold are dropped, the others are computed exactly in double precision.

Pairs are looked for among vectors that share a table's key, BITS signs of a rotation of that
table.  The number of tables follows from the wanted probability that a pair at the threshold
shares some key; a pair counts in the first table where it shares one.  Equal vectors are one
vector with a multiplicity.  A key's vectors are dealt into tiles, and tasks compare two tiles
at a time, so a key that holds a third of all rows is many tasks, none of which is larger.
Tiles give sums of links and a forest of the linked vectors, never their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import Scratch, components
from ledgerline.llm.vectors import matrix, taking_part, usable

#: Standard errors of the estimate that a bound allows for.
CONFIDENCE = 4.0
#: Wanted probability that a pair at the threshold shares a key.
RECALL = 0.9995
#: Vectors in a tile.
TILE = 1024


def plan_tables(n: int, threshold: float) -> tuple[int, int]:
    """(bits of a key, tables) for n vectors: keys of about 128 unrelated vectors each."""
    bits = max(4, min(32, ceil(log2(max(n, 2) / 128))))
    alike = 1 - acos(threshold) / pi
    return bits, max(1, ceil(log(1 - RECALL) / log(1 - alike**bits)))


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _keys(batches: Iterator[pa.RecordBatch], bits: int, tables: int, seed: int) -> Iterator[pa.RecordBatch]:
    """The vector's own numbers and its key in each table."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        keys = np.zeros((batch.num_rows, tables), np.int64)
        raw: list[bytes] = [b""] * batch.num_rows
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            data = matrix(batch.column("embedding").take(pa.array(rows)))
            unit = _unit(data)
            planes = np.random.default_rng([seed, int(dim), 1]).standard_normal((int(dim), bits * tables))
            signs = (unit @ planes > 0).reshape(len(rows), tables, bits)
            keys[rows] = signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))
            short = data.astype("<f4")
            for row, single, double in zip(rows, short, data):  # half the bytes where they lose nothing
                raw[row] = single.tobytes() if np.array_equal(single, double) else double.astype("<f8").tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), batch.column("copies"), batch.column("dim"), pa.array(raw, pa.binary()), pa.array(list(keys.astype(np.uint32)), pa.list_(pa.uint32())).cast(pa.list_(pa.int64()))],
            names=["node", "copies", "dim", "raw", "keys"],
        )


def _unit(data: np.ndarray) -> np.ndarray:
    unit = data / np.abs(data).max(axis=1, keepdims=True)
    return unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))


def linked_pairs(x: np.ndarray, y: np.ndarray, threshold: float, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows (i, j) of unit vectors with an inner product of the threshold or more, and the pairs computed exactly."""
    dim = x.shape[1]
    if dim < 2:
        i, j = np.nonzero(x @ y.T >= threshold)
        return i, j, x.shape[0] * y.shape[0]
    turned, other = x @ turn, y @ turn
    code = np.where(turned >= 0, 1.0, -1.0) / np.sqrt(dim)
    factor = (code * turned).sum(axis=1)
    bound = CONFIDENCE * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / (dim - 1))
    estimate = (code.astype(np.float32) @ other.T.astype(np.float32)) / factor[:, None].astype(np.float32)
    i, j = np.nonzero(estimate + bound[:, None].astype(np.float32) + np.float32(1e-5) >= threshold)
    exact = np.concatenate([np.einsum("ij,ij->i", x[i[a : a + 65536]], y[j[a : a + 65536]]) for a in range(0, len(i), 65536)] or [np.empty(0)])
    hit = exact >= threshold
    return i[hit], j[hit], len(i)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member (by row) of each row's component under the links."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


_LINKS = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


def _compare(key: tuple, table: pa.Table, threshold: float, seed: int) -> pa.Table:
    """Two tiles of one key: a link sum for each vector and an edge to its component's first."""
    number, a, b = (k.as_py() for k in key[:3])
    side = table.column("side").to_numpy()
    keys = matrix(table.column("keys")).astype(np.int64)
    nodes, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
    dim = table.column("dim")[0].as_py()
    raw = table.column("raw").to_pylist()
    x = _unit(np.stack([np.frombuffer(r, "<f4" if len(r) == 4 * dim else "<f8").astype(np.float64) for r in raw]))
    left, right = np.flatnonzero(side == a), np.flatnonzero(side == b)
    if not len(left) or not len(right):
        return _LINKS.empty_table()
    i, j, _ = linked_pairs(x[left], x[right], threshold, rotation(x.shape[1], seed))
    i, j = left[i], right[j]
    if a == b:
        once = nodes[i] < nodes[j]
        i, j = i[once], j[once]
    first = ~(keys[i, :number] == keys[j, :number]).any(axis=1)
    i, j = i[first], j[first]
    links = np.bincount(i, copies[j], len(nodes)) + np.bincount(j, copies[i], len(nodes))
    label = _forest(len(nodes), i, j)
    some = np.flatnonzero((links > 0) | (label != np.arange(len(nodes))))
    return pa.table([pa.array(nodes[some]), pa.array(links[some].astype(np.int64)), pa.array(nodes[label[some]])], schema=_LINKS)


def link_vectors(spark: SparkSession, vectors: DataFrame, *, threshold: float = 0.95, seed: int = 8) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Two rows link when their cosine, in double precision, is ``threshold`` or more.  Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing, and so do
    vectors of different lengths.  Equal vectors link (repeated rows too).  ``component_id`` is
    the smallest vec_id reachable, ``kept`` says whether it is the row's own.  Other columns are
    ignored; an empty table gives no rows.
    """
    scratch = Scratch(spark, "rabitq")
    # Equal vectors are told by 128 bits of two hashes; their node is a number of its own.
    alike = {"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(seed), "embedding"), "dim": F.size("embedding")}
    good = taking_part(vectors).withColumns(alike)
    rows = scratch.save(good.select("vec_id", *alike), "rows")
    nodes = scratch.save(
        good.groupBy(*alike).agg(
            F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"),
        ).withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    n = nodes.count()
    bits, tables = plan_tables(n, threshold)
    keyed = scratch.save(
        nodes.select("node", "copies", "dim", "embedding").repartition(max(8, n // 4096)).mapInArrow(
            partial(_keys, bits=bits, tables=tables, seed=seed), "node long, copies long, dim int, raw binary, keys array<long>"
        ),
        "keyed",
    )
    # Only numbers are posted; a vector's own data joins the tiles that it is in.
    posted = keyed.select("node", "dim", F.posexplode("keys").alias("number", "key"))
    # A key with up to TILE vectors is one tile; a larger one has tiles that meet two by two.
    held = posted.groupBy("dim", "number", "key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    tiled = posted.join(held, ["dim", "number", "key"]).withColumn("tiles", F.ceil(F.col("held") / TILE).cast("int"))
    tiled = tiled.withColumn("side", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    meets = tiled.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumns(
        {"a": F.least("side", "with"), "b": F.greatest("side", "with")}
    )
    found = scratch.save(
        meets.select("number", "a", "b", "key", "dim", "node", "side").join(keyed.drop("dim"), "node")
        .groupBy("number", "a", "b", "key", "dim")
        .applyInArrow(lambda key, table: _compare(key, table, threshold, seed), "node long, links long, other long"),
        "found",
    )
    roots = components(spark, found.select(F.col("node").alias("u"), F.col("other").alias("v")), scratch)
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = scratch.save(
        nodes.select("node", *alike, "copies", "first_id").join(sums, "node", "left").join(roots, "node", "left")
        .select(*alike, "copies", "first_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")),
        "rooted",
    )
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    lookup = scratch.save(
        rooted.join(named, "root").select(*alike, (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id"), "lookup"
    )
    linked = rows.join(lookup, [*alike]).select("vec_id", "n_links", "component_id")
    bad = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    alone = bad.filter(~usable("embedding")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    whole = linked.unionByName(alone)
    return whole.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
