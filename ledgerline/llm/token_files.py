"""Token-id files: Huffman-coded id blocks in ascending doc_id order, written and read back.

Layout under the target folder, all Parquet:

* ``codebook``: one row (lengths), the code length of each id as a byte string.  The code is
  canonical, so the lengths define it; they come from the ids' counts over all documents.
* ``blocks``: one row for each block of at most BLOCK ids of one shard: (shard, block, first,
  n_ids, ordinals, doc_ids, lengths, checkpoints, payload).  A block decodes alone:
  ``checkpoints`` holds the bit offset of every STRIDE-th id.  ``first`` counts the shard's ids
  before the block; ordinals, doc_ids and lengths tell which documents its ids belong to (a
  long document goes on in the next block under the same ordinal).
* ``shards``: one row for each shard: (shard, start), the ids of all shards before it.

Shards are ranges of doc_id, in order.  Steps: tokenize, move the ids to their shard and join
them to blocks there (one shuffle), count ids over the blocks, code each block.  A task holds
one block and one piece of a document at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.llm.common import Scratch
from ledgerline.llm.huffman import Codebook, code_lengths
from ledgerline.llm.tokens import PieceTokenizer

#: Ids in a block.
BLOCK = 1 << 16
#: Blocks whose lanes are decoded in step.
TOGETHER = 16
#: Documents' text bytes aimed at for a shard.
SHARD_BYTES = 24 << 20


def _encode(batches: Iterator[pa.RecordBatch], path: str, end: int, bounds: list[int]) -> Iterator[pa.RecordBatch]:
    tok, tail, edges = PieceTokenizer.get(path), np.array([end], "<u2").tobytes(), np.array(bounds, np.int64)
    for batch in batches:
        ids, rows, texts = batch.column("doc_id"), batch.column("row"), batch.column("text")
        out: list[list] = [[] for _ in range(6)]
        held = 0
        for k in range(batch.num_rows):
            doc_id = ids[k].as_py()
            made = tok.encode(texts[k].as_py()) + tail
            crc = zlib.crc32(made)
            shard = 0 if doc_id is None else int(np.searchsorted(edges, doc_id, side="right"))
            for piece, at in enumerate(range(0, len(made), 2 * BLOCK)):
                for column, value in zip(out, (shard, doc_id, crc, rows[k].as_py(), piece, made[at : at + 2 * BLOCK])):
                    column.append(value)
            held += len(made)
            if held > 1 << 23:
                yield _piece_batch(out)
                out, held = [[] for _ in range(6)], 0
        if held:
            yield _piece_batch(out)


_PIECES = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("crc", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("ids", pa.binary())])
_RAW = pa.schema([
    ("shard", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()), ("ordinals", pa.list_(pa.int64())),
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary()),
])
_RAW_DDL = "shard int, block long, first long, n_ids long, ordinals array<long>, doc_ids array<long>, lengths array<long>, ids binary"
_BLOCK_DDL = _RAW_DDL.replace("ids binary", "checkpoints array<long>, payload binary")


def _piece_batch(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES)], schema=_PIECES)


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces of one shard after another to raw blocks of at most BLOCK ids."""
    shard, block, first, ordinal = None, 0, 0, -1
    held, entries, parts = 0, [], []

    def cut() -> pa.RecordBatch:
        row = (shard, block, first, held, *([e[i] for e in entries] for i in range(3)), b"".join(parts))
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _RAW)], schema=_RAW)

    for batch in batches:
        columns = [batch.column(c) for c in ("shard", "doc_id", "piece", "ids")]
        for k in range(batch.num_rows):
            now, doc_id, piece, ids = (c[k].as_py() for c in columns)
            if now != shard:
                if held:
                    yield cut()
                shard, block, first, ordinal, held, entries, parts = now, 0, 0, -1, 0, [], []
            ordinal += piece == 0
            at = 0
            while at < len(ids):
                room = 2 * (BLOCK - held)
                part = ids[at : at + room]
                entries.append((ordinal, doc_id, len(part) // 2))
                parts.append(part)
                held += len(part) // 2
                at += len(part)
                if held == BLOCK:
                    yield cut()
                    first, block, held, entries, parts = first + held, block + 1, 0, [], []
    if held:
        yield cut()


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for x in batch.column("ids"):
            total += np.bincount(np.frombuffer(x.as_buffer(), "<u2"), minlength=1 << 16)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "n"])


def _code(batches: Iterator[pa.RecordBatch], lengths: bytes) -> Iterator[pa.RecordBatch]:
    book = Codebook(np.frombuffer(lengths, np.uint8))
    for batch in batches:
        marks, payloads = [], []
        for x in batch.column("ids"):
            payload, _, points = book.encode(np.frombuffer(x.as_buffer(), "<u2").astype(np.int64))
            marks.append(points)
            payloads.append(payload)
        names = [n for n in batch.schema.names if n != "ids"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array(marks, pa.list_(pa.int64())), pa.array(payloads, pa.binary())],
            names=[*names, "checkpoints", "payload"],
        )


def write_token_files(spark: SparkSession, docs: DataFrame, target: str, *, path: str, end: int) -> None:
    """Write the ids of ``docs`` (doc_id, text) under ``target``; null text is empty.

    Every document ends with the id ``end``.  Documents are in ascending doc_id order, null
    first; rows that share a doc_id are documents of their own, in order of their ids' crc32.
    An empty table gives empty files.  Other columns are ignored.
    """
    scratch = Scratch(spark, "token-files")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bytes_ = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = max(1, -(-int(bytes_) // SHARD_BYTES))
    bounds: list[int] = []
    if n_shards > 1:
        cuts = [k / n_shards for k in range(1, n_shards)]
        bounds = base.agg(F.percentile_approx("doc_id", cuts, 10_000)).first()[0] or []
    pieces = base.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        partial(_encode, path=path, end=end, bounds=sorted(set(bounds))),
        "shard int, doc_id long, crc long, row long, piece int, ids binary",
    )
    placed = pieces.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", "crc", "row", "piece")
    raw = scratch.save(placed.select("shard", "doc_id", "piece", "ids").mapInArrow(_join, _RAW_DDL), "raw")
    scratch.release()
    counts = raw.select("ids").mapInArrow(_histogram, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    total = np.zeros(1 << 16, np.int64)
    for r in counts.collect():  # at most one row for each id of the vocabulary
        total[r.id] = r.n
    lengths = code_lengths(total).tobytes()
    spark.createDataFrame([(lengths,)], "lengths binary").coalesce(1).write.parquet(f"{target}/codebook")
    raw.mapInArrow(partial(_code, lengths=lengths), _BLOCK_DDL).write.option("compression", "none").parquet(f"{target}/blocks")
    sizes = raw.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one narrow row for each shard
    sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).write.parquet(f"{target}/shards")
    scratch.drop("raw")


def _decode(batches: Iterator[pa.RecordBatch], lengths: bytes, with_ids: bool) -> Iterator[pa.RecordBatch]:
    book = Codebook(np.frombuffer(lengths, np.uint8))
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k] for c in batch.schema.names}
            if k % TOGETHER == 0:
                some = [{c: batch.column(c)[j] for c in ("payload", "n_ids", "checkpoints")} for j in range(k, min(k + TOGETHER, batch.num_rows))]
                decoded = book.decode_blocks([(r["payload"].as_buffer(), r["n_ids"].as_py(), r["checkpoints"].values.to_numpy()) for r in some])
            ids = decoded[k % TOGETHER]
            shard, first, at = row["shard"].as_py(), row["first"].as_py(), 0
            out: list[list] = [[] for _ in _PARTS]
            for ordinal, doc_id, n in zip(*(row[c].as_py() for c in ("ordinals", "doc_ids", "lengths"))):
                part = ids[at : at + n].astype("<u4").tobytes()
                values = (shard, ordinal, doc_id, first + at, n, zlib.crc32(part), part if with_ids else None)
                for column, value in zip(out, values):
                    column.append(value)
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PARTS)], schema=_PARTS)


_PARTS = pa.schema([
    ("shard", pa.int32()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()),
    ("ids", pa.binary()),
])


def read_token_files(spark: SparkSession, target: str, *, with_ids: bool = True) -> DataFrame:
    """(shard, ordinal, doc_id, at, n, crc, ids): each document's ids (32-bit little-endian) in parts.

    A document has a part in each block that holds some of its ids; ``at`` is the part's place
    among the ids of all documents, ``n`` their number and ``crc`` their crc32.  Without
    ``with_ids`` the ids are decoded all the same, but null takes their place in the result.
    """
    lengths = bytes(spark.read.schema("lengths binary").parquet(f"{target}/codebook").first()[0])
    parts = spark.read.schema(_BLOCK_DDL).parquet(f"{target}/blocks").mapInArrow(
        partial(_decode, lengths=lengths, with_ids=with_ids), "shard int, ordinal long, doc_id long, at long, n long, crc long, ids binary"
    )
    starts = spark.read.schema("shard int, start long").parquet(f"{target}/shards")
    return parts.join(starts, "shard").select("shard", "ordinal", "doc_id", (F.col("at") + F.col("start")).alias("at"), "n", "crc", "ids")


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo the CRC-32 polynomial, bits reversed."""
    product = 0
    while b:
        if b & 0x80000000:
            product ^= a
        b = (b << 1) & 0xFFFFFFFF
        a = (a >> 1) ^ (0xEDB88320 if a & 1 else 0)
    return product


def crc_join(left: int, right: int, right_bytes: int) -> int:
    """crc32(x + y) from crc32(x), crc32(y) and len(y)."""
    shift, square = 0x80000000, 0x00800000  # 1 and x^8, bits reversed
    while right_bytes:
        if right_bytes & 1:
            shift = _times(shift, square)
        square = _times(square, square)
        right_bytes >>= 1
    return _times(left, shift) ^ right


def _join_crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc in batch.column("parts"):
            doc = sorted(doc.as_py(), key=lambda p: p["at"])
            crc = doc[0]["crc"]
            for p in doc[1:]:
                crc = crc_join(crc, p["crc"], 4 * p["n"])
            out.append(crc)
        names = ["doc_id", "start", "n_tokens"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.int64())], names=[*names, "ids_crc32"])


def token_digests(parts: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of ``read_token_files``."""
    docs = parts.groupBy("shard", "ordinal").agg(
        F.min("doc_id").alias("doc_id"), F.min("at").alias("start"), F.sum("n").alias("n_tokens"),
        F.count(F.lit(1)).alias("n_parts"), F.collect_list(F.struct("at", "n", "crc")).alias("parts"),
    )
    single = docs.filter("n_parts = 1").select("doc_id", "start", "n_tokens", F.col("parts")[0]["crc"].alias("ids_crc32"))
    several = docs.filter("n_parts > 1").select("doc_id", "start", "n_tokens", "parts").mapInArrow(
        _join_crc, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
    return single.unionByName(several)
