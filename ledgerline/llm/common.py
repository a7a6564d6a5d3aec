"""Helpers shared by the corpus operators: scratch tables, key filters, components."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import work_dir

#: Bits of a key filter: 2^24 bits are 2 MB whatever the number of keys.
FILTER_BITS = 1 << 24


class Scratch:
    """Parquet tables under the shared work folder; they cut lineage between steps."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Let Spark's cleaner remove shuffle files of steps that nothing refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()


#: What Python workers keep from task to task; functions that don't need it let it go.
CACHES: list[dict] = []


def tidied(batches: Callable) -> Callable:
    """A batch function that lets other functions' caches go, and gives freed memory back when a task of it ends.

    Python workers live on after a task, and hold what it held.
    """

    @functools.wraps(batches)
    def run(*args, **kwargs):
        for cache in CACHES:
            cache.clear()
        try:
            yield from batches(*args, **kwargs)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap of the keys' hashes: at most 512 rows of 4 KB, whatever the number of keys."""
    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(FILTER_BITS)) + 1
    return (
        keys.select(slot.alias("_slot"))
        .groupBy(F.bitmap_bucket_number("_slot").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits"))
    )


def with_maybe(df: DataFrame, key: str | Column, bits: DataFrame, name: str) -> DataFrame:
    """Add ``name``: false only for rows whose key is surely not among the filter's keys.

    The filter has at most FILTER_BITS bits (2 MB), so its broadcast is bounded; with very
    many keys it lets more rows through, which an exact join after it drops again.
    """
    column = F.col(key) if isinstance(key, str) else key
    slot = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)) + 1
    position = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.expr("substring(_bits, int(_pos div 8) + 1, 1)")), 16, 10).cast("int")
    return (
        df.withColumns({"_key": F.bitmap_bucket_number(slot), "_pos": position})
        .join(F.broadcast(bits), F.col("_key") == F.col("_bucket"), "left")
        .withColumn(
            name,
            F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, int(_pos % 8))")) != 0, F.lit(False)),
        )
        .drop("_key", "_pos", "_bucket", "_bits")
    )


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the smallest node reachable by the edges (u long, v long).

    Rounds of contraction.  Each node takes its smallest neighbour as parent, parents are
    followed to their root by pointer jumping, and the edges between roots go to the next
    round, until none is left.  Only counts reach the driver.  Tables are written between the
    steps, so a hub's rows meet in joins of two plain shuffles, which AQE can split.
    Nodes without edges (or with self-loops only) have no row.
    """
    tag = uuid.uuid4().hex[:6]
    current = scratch.save(
        edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(),
        f"edges-{tag}-0",
    )
    labels: DataFrame | None = None
    step = 0
    while current.limit(1).count():
        step += 1
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = scratch.save(
            both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("parent")),
            f"parent-{tag}-{step}-0",
        )
        hop = 0
        while True:
            hop += 1
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
            jumped = scratch.save(
                parent.join(up, "parent").select(
                    "node", F.col("_up").alias("parent"), (F.col("_up") != F.col("parent")).alias("moved")
                ),
                f"parent-{tag}-{step}-{hop}",
            )
            parent = jumped.select("node", "parent")
            if not jumped.filter("moved").limit(1).count():
                break
        if labels is None:
            labels = parent.select("node", F.col("parent").alias("root"))
        else:
            nxt = parent.select(F.col("node").alias("root"), F.col("parent").alias("_next"))
            labels = scratch.save(
                labels.join(nxt, "root", "left").select("node", F.coalesce("_next", "root").alias("root")),
                f"labels-{tag}-{step}",
            )
        pu = parent.select(F.col("node").alias("u"), F.col("parent").alias("_u"))
        pv = parent.select(F.col("node").alias("v"), F.col("parent").alias("_v"))
        current = scratch.save(
            current.join(pu, "u").join(pv, "v").filter("_u <> _v")
            .select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v")).distinct(),
            f"edges-{tag}-{step}",
        )
    if labels is None:
        return spark.createDataFrame([], "node long, root long")
    return labels


def pack(docs: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` as (names..., _rest): all other columns in one struct, so their names can't clash."""
    others = [docs[c] for c in docs.columns if c not in names]
    rest = F.struct(*others) if others else F.lit(None).cast("struct<none:int>")
    return docs.select(*[docs[c] for c in names], rest.alias("_rest"))


def unpack(df: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """The columns of the table that ``pack`` took, in their order."""
    return df.select(*[F.col(c) if c in names else F.col("_rest")[c].alias(c) for c in columns])


def past_heads(heads: DataFrame, rows: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """Both tables dealt and sorted by ``keys``, each key's head before its rows; ``mark`` is a column that only heads have."""
    return (
        heads.unionByName(rows, allowMissingColumns=True).repartition(*keys)
        .sortWithinPartitions(*keys, F.col(mark).isNull())
    )


def heads_first(batches: Iterator[pa.RecordBatch], mark: str) -> Iterator[tuple[dict, pa.RecordBatch | None]]:
    """From the batches of ``past_heads``: (head, None) where a key begins, then (head, rows) for each run of its rows."""
    head: dict = {}
    for batch in batches:
        first = np.flatnonzero(np.asarray(batch.column(mark).is_valid()))
        edges = np.unique(np.concatenate([[0, batch.num_rows], first, first + 1]))
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if batch.column(mark)[low].is_valid:
                head = {name: batch.column(name)[low].as_py() for name in batch.schema.names}
                yield head, None
            else:
                yield head, batch.slice(low, high - low)
