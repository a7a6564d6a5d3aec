"""Packing by cutting-stock column generation.

A document's ids are cut every ``size`` ids; each full piece is a sequence of its own, and the
rest (1 to size - 1 ids) is an item.  Items are packed by their lengths' histogram alone, which
has fewer than ``size`` entries, so the driver solves a problem of bounded size:

* a linear program chooses how often each *pattern* (a multiset of lengths that fits a sequence)
  is used; it starts from greedy patterns that use up one length after another,
* a knapsack dynamic program over the lengths' dual prices finds the column that improves it
  most, for a sequence of ``size`` and for each smaller power of two (a sequence that ends at a
  power of two needs no padding, so it costs that many tokens only),
* uses are rounded down; the items left over, at most a few for each pattern, are laid end to
  end and cut at the sequence boundaries, the last of them at powers of two.

Items of a length are ranked (partition by partition, in the order of the table), and a rank
says which pattern, sequence and place an item gets.  Only items move in a shuffle; full pieces
stay where they were tokenized.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.llm.common import Scratch
from ledgerline.llm.tokens import PieceTokenizer

#: Columns generated at most, and the gap to the linear program's bound that ends it sooner.  The plan
#: of any round places every item; ``Plan.gap`` tells how far above the bound it may be.
ROUNDS, GAP = 300, 0.0005


def _greedy(lengths: np.ndarray, demand: np.ndarray, size: int) -> np.ndarray:
    """A feasible square basis: each pattern uses up a length that no later one holds."""
    m, left, columns = len(lengths), demand.astype(float), []
    down = np.argsort(-lengths)
    alive = np.ones(m, bool)
    while alive.any():
        column, room = np.zeros(m), size
        for i in down:
            if alive[i] and lengths[i] <= room:
                column[i] = room // lengths[i]
                room -= int(column[i]) * int(lengths[i])
        held = column > 0
        times = (left[held] / column[held]).min()
        left[held] -= times * column[held]
        gone = np.flatnonzero(held & (left <= 1e-9 * demand))
        columns.append(column)
        for i in gone[1:]:  # used up together: a pattern of that length alone keeps the basis square
            single = np.zeros(m)
            single[i] = size // lengths[i]
            columns.append(single)
        alive[gone] = False
    return np.array(columns).T


def _price(lengths: np.ndarray, value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Best total value of items that fill exactly c, for c up to size, and the last item."""
    best, last = np.full(size + 1, -np.inf), np.full(size + 1, -1)
    best[0] = 0.0
    for c in range(int(lengths[0]), size + 1):
        fit = int(np.searchsorted(lengths, c, side="right"))
        total = value[:fit] + best[c - lengths[:fit]]
        i = int(total.argmax())
        if total[i] > -np.inf:
            best[c], last[c] = total[i], i
    return best, last


@dataclass
class Plan:
    """Where each rank of each length goes."""

    size: int
    #: length -> arrays (first rank, copies in a pattern, first sequence, offset) in order of rank.
    runs: dict[int, tuple[np.ndarray, ...]] = field(default_factory=dict)
    #: length -> (first rank left over, its place among the ids left over).
    spare: dict[int, tuple[int, int]] = field(default_factory=dict)
    #: Ends of the sequences of left-over ids: whole ones, then powers of two.
    spare_ids: int = 0
    spare_first: int = 0
    sequences: int = 0
    padding: int = 0
    columns: int = 0
    #: The linear program's objective over its lower bound, less 1, where column generation ended.
    gap: float = 0.0

    def tail_ends(self) -> list[int]:
        at = self.spare_ids // self.size * self.size
        ends, rest = [], self.spare_ids - at
        for k in range(rest.bit_length() - 1, -1, -1):
            if rest >> k & 1:
                at += 1 << k
                ends.append(at)
        return ends

    def place(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(sequence, offset, ids) of the pieces of one item."""
        first_spare, base = self.spare[length]
        if rank < first_spare:
            ranks, copies, sequence, offset = self.runs[length]
            k = int(np.searchsorted(ranks, rank, side="right")) - 1
            number, slot = divmod(rank - int(ranks[k]), int(copies[k]))
            return [(int(sequence[k]) + number, int(offset[k]) + slot * length, length)]
        at, left, out = base + (rank - first_spare) * length, length, []
        whole = self.spare_ids // self.size
        ends = self.tail_ends()
        while left:
            if at < whole * self.size:
                number, low, high = at // self.size, at // self.size * self.size, (at // self.size + 1) * self.size
            else:
                k = next(i for i, e in enumerate(ends) if at < e)
                number, low, high = whole + k, ends[k - 1] if k else whole * self.size, ends[k]
            n = min(left, high - at)
            out.append((self.spare_first + number, at - low, n))
            at, left = at + n, left - n
        return out


def solve(histogram: dict[int, int], size: int) -> Plan:
    """Cutting-stock plan for items of lengths below ``size``: column generation, then rounding."""
    plan = Plan(size)
    if not histogram:
        return plan
    lengths = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(n)] for n in lengths], float)
    basis = _greedy(lengths, demand, size)
    fills = basis.T @ lengths

    def cost_of(fill: float) -> float:
        fill = int(fill)
        return fill / size if fill & (fill - 1) == 0 else 1.0

    cost = np.array([cost_of(f) for f in fills])
    inverse = np.linalg.inv(basis)
    uses = inverse @ demand
    powers = [1 << k for k in range(size.bit_length()) if 1 << k < size]
    bound = 0.0
    for _ in range(ROUNDS):
        value = cost @ inverse
        best, last = _price(lengths, value, size)
        whole = int(best.argmax())
        offers = [(best[whole], 1.0, whole)] + [(best[p], p / size, p) for p in powers if best[p] > -np.inf]
        gain, price, fill = max(offers, key=lambda o: o[0] - o[1])
        plan.columns += 1
        ratio = max(o[0] / o[1] for o in offers)
        bound = max(bound, float(cost @ uses) / max(ratio, 1.0))
        if gain - price <= 1e-7 or ratio <= 1 + GAP:  # the bound is the objective / ratio
            break
        column = np.zeros(len(lengths))
        c = fill
        while c:
            column[last[c]] += 1
            c -= int(lengths[last[c]])
        step = inverse @ column
        able = step > 1e-9
        if not able.any():
            break
        limits = np.full(len(step), np.inf)
        limits[able] = np.maximum(uses[able], 0) / step[able]
        out = int(limits.argmin())
        amount = limits[out]
        uses -= amount * step
        uses[out] = amount
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        basis[:, out], cost[out] = column, price
    plan.gap = float(cost @ uses) / bound - 1
    times = np.floor(np.maximum(uses, 0) + 1e-7).astype(np.int64)
    used = (basis * times).sum(axis=1).round().astype(np.int64)
    while (used > demand).any():  # rounding noise only
        over = int(np.flatnonzero(used > demand)[0])
        worst = int(np.flatnonzero((basis[over] > 0) & (times > 0))[0])
        times[worst] -= 1
        used = (basis * times).sum(axis=1).round().astype(np.int64)
    runs: dict[int, list[tuple[int, int, int, int]]] = {int(n): [] for n in lengths}
    rank = np.zeros(len(lengths), np.int64)
    for p in np.flatnonzero(times):
        offset = 0
        for i in np.flatnonzero(basis[:, p] > 0)[::-1]:
            copies = int(round(basis[i, p]))
            runs[int(lengths[i])].append((int(rank[i]), copies, plan.sequences, offset))
            rank[i] += copies * times[p]
            offset += copies * int(lengths[i])
        plan.padding += int(times[p]) * (0 if offset & (offset - 1) == 0 else size - offset)
        plan.sequences += int(times[p])
    for i, n in enumerate(lengths):
        table = np.array(runs[int(n)], np.int64).reshape(-1, 4)
        plan.runs[int(n)] = tuple(table[:, k] for k in range(4))
        plan.spare[int(n)] = (int(rank[i]), plan.spare_ids)
        plan.spare_ids += (int(demand[i]) - int(rank[i])) * int(n)
    plan.spare_first = plan.sequences
    plan.sequences += plan.spare_ids // size + len(plan.tail_ends())
    return plan


_CUT = pa.schema([
    ("part", pa.int32()), ("length", pa.int32()), ("rank", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()),
    ("doc_tokens", pa.int64()), ("ids", pa.binary()),
])
_CUT_DDL = "part int, length int, rank long, doc_id long, start long, doc_tokens long, ids binary"
_OUT = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()),
])
_OUT_DDL = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long, ids binary"


def _batch(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _cut(batches: Iterator[pa.RecordBatch], path: str, end: int, size: int) -> Iterator[pa.RecordBatch]:
    """Pieces with their partition, and their rank among the partition's pieces of that length."""
    tok, tail = PieceTokenizer.get(path), np.array([end], "<u2").tobytes()
    part = TaskContext.get().partitionId()
    ranks = np.zeros(size + 1, np.int64)
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        out: list[list] = [[] for _ in _CUT]
        held = 0
        for k in range(batch.num_rows):
            made = tok.encode(texts[k].as_py()) + tail
            for at in range(0, len(made), 2 * size):
                piece = made[at : at + 2 * size]
                n = len(piece) // 2
                row = (part, n, int(ranks[n]), ids[k].as_py(), at // 2, len(made) // 2, piece)
                ranks[n] += 1
                for column, value in zip(out, row):
                    column.append(value)
            held += len(made)
            if held > 1 << 23:
                yield _batch(out, _CUT)
                out, held = [[] for _ in _CUT], 0
        if held:
            yield _batch(out, _CUT)


def _place(batches: Iterator[pa.RecordBatch], plan: Plan, with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in _OUT]
        columns = [batch.column(c) for c in ("length", "rank", "before", "doc_id", "start", "doc_tokens", "ids")]
        for k in range(batch.num_rows):
            length, rank, before, doc_id, start, doc_tokens, ids = (c[k].as_py() for c in columns)
            if length == plan.size:
                places = [(plan.sequences + before + rank, 0, length)]
            else:
                places = plan.place(length, before + rank)
            at = 0
            for sequence, offset, n in places:
                part = ids[2 * at : 2 * (at + n)]
                crc = zlib.crc32(np.frombuffer(part, "<u2").astype("<u4").tobytes())
                row = (doc_id, start + at, n, doc_tokens, sequence, offset, crc, part if with_ids else None)
                for column, value in zip(out, row):
                    column.append(value)
                at += n
        yield _batch(out, _OUT)


def pack_documents(spark: SparkSession, docs: DataFrame, *, path: str, end: int, size: int = 1024, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids_crc32, ids.

    ``ids`` are 16-bit little-endian (null without ``with_ids``), ``ids_crc32`` is that of the ids
    as 32-bit little-endian integers; ``end`` closes each document (null text: that id alone).
    Sequences are numbered from 0 without gaps, pieces of a sequence lie one after another from
    offset 0, and a sequence is padded to ``size`` unless its ids end at a power of two.  Rows
    that share a doc_id are packed as documents of their own.  Other columns are ignored; an
    empty table gives no rows.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    scratch = Scratch(spark, "packing")
    cut = scratch.save(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            partial(_cut, path=path, end=end, size=size), _CUT_DDL
        ),
        "pieces",
    )
    counts = scratch.save(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    histogram.pop(size, None)
    plan = solve(histogram, size)
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    items = cut.filter(F.col("length") < size).join(before.filter(F.col("length") < size), ["length", "part"])
    # One row for each input partition: the broadcast is bounded by their number.
    wholes = F.broadcast(before.filter(F.col("length") == size).select("part", "before"))
    full = cut.filter(F.col("length") == size).join(wholes, "part")
    names = ["length", "rank", "before", "doc_id", "start", "doc_tokens", "ids"]
    return items.select(*names).unionByName(full.select(*names)).mapInArrow(partial(_place, plan=plan, with_ids=with_ids), _OUT_DDL)
