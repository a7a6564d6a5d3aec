"""Substring dedup with longest-previous-factor arrays: later copies of long strings go.

A byte goes when a string of DEPTH bytes that covers it also starts earlier (smaller doc_id, or
the same document further left).  Steps:

1. *Equal texts.* The one of the smallest doc_id stays in play; another is removed whole if it
   has DEPTH bytes, since every string in it starts earlier.
2. *Anchors.* Each window (string of DEPTH bytes) has an anchor, its leftmost gram of least hash.
   Consecutive windows of the same anchor are a *run*.  Equal windows have equal anchors, so
   only runs of equal anchors need to be compared.  Of runs equal in all their bytes, the first
   stays and the others are removed whole (in the map task where possible, so that a passage
   that is everywhere sends one row per task).
3. *Suffix order.* What is left are runs that share an anchor with another, different run: the
   borders of passages and edits.  Their bytes are fetched, and anchor by anchor, in order of
   position, their suffixes are sorted to DEPTH bytes by prefix doubling.  The previous and the
   next smaller position in suffix order give a suffix's longest earlier match; a window whose
   match has DEPTH bytes is removed.
4. Anchors with more than GROUP different runs aren't gathered: their windows are compared one
   by one, by hash, in a combining aggregate.

Equality of runs, windows and texts in steps 1, 2 and 4 is that of hashes of 96 bits and more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.llm.common import Scratch, key_filter, pack, tidied, unpack, with_maybe
from ledgerline.llm.words import _BYTE, CHUNK, _power_table, mix, text_chunks

_U = np.uint64
#: Bytes of a string that counts as a copy, and of the grams that are anchors.
DEPTH, GRAM = 100, 24
#: Different runs of an anchor that one task sorts; bytes of runs sorted together.
GROUP, SORT_BYTES = 20_000, 1 << 20

_RUNS = pa.schema([("a", pa.int64()), ("c", pa.int64()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("lo", pa.int64()), ("span", pa.int32()), ("later", pa.bool_())])
_RUNS_DDL = "a long, c long, doc_id long, tie long, lo long, span int, later boolean"


def find_runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, anchor hash, hash of the run's bytes) of the runs of all rows."""
    n, grams = len(raw), DEPTH - GRAM + 1
    empty = np.empty(0, np.int64)
    if n < DEPTH:
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    up, down = _power_table(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:n], out=total[1:])
    low = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1]) & ~_U(127)
    # The least gram of each window with its distance in the low bits: leftmost among equals.
    have = 1
    while have < grams:
        step = min(have, grams - have)
        low = np.minimum(low[: len(low) - step], low[step:] + _U(step))
        have += step
    start = np.arange(len(low), dtype=np.int64)
    anchor = start + (low & _U(127)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(low)]
    valid = start + DEPTH <= offsets[row + 1]
    start, anchor, row, low = start[valid], anchor[valid], row[valid], low[valid]
    if not len(start):
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))))
    last = np.append(first[1:], len(start)) - 1
    lo, hi = start[first], start[last]
    whole = mix((total[hi + DEPTH] - total[lo]) * down[lo] + ((anchor[first] - lo) * 131 + (hi - lo)).astype(np.uint64))
    return row[first], lo - offsets[row[first]], hi - lo + 1, mix(low[first] >> _U(7)), whole


def _segments(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their places in the text, bytes, offsets): a long text comes in overlapping parts."""
    for first, raw, offsets in text_chunks(texts):
        if len(offsets) == 2 and len(raw) > 2 * CHUNK:
            for at in range(0, len(raw) - DEPTH + 1, CHUNK):
                part = raw[at : at + CHUNK + DEPTH - 1]
                yield np.array([first]), np.array([at]), part, np.array([0, len(part)])
        else:
            yield np.arange(first, first + len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64), raw, offsets


def _combine(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Runs of a task; of equal ones all but the first are marked ``later`` and get a key of their own."""
    a, c, doc_id, tie, lo, span = (np.concatenate(x) for x in zip(*parts))
    key = mix(a ^ mix(c))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    later = np.zeros(len(a), bool)
    if same.any():
        touched = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        fine = touched[np.lexsort((lo[touched], tie[touched], doc_id[touched], c[touched], a[touched]))]
        again = (a[fine][1:] == a[fine][:-1]) & (c[fine][1:] == c[fine][:-1])
        later[fine[1:][again]] = True
        a = a.copy()
        a[later] = mix(a[later] + np.flatnonzero(later).astype(np.uint64))
    return pa.RecordBatch.from_arrays(
        [pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(doc_id), pa.array(tie), pa.array(lo), pa.array(span.astype(np.int32)), pa.array(later)],
        schema=_RUNS,
    )


@tidied
def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, held = [], 0
    for batch in batches:
        ids, ties = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("tie").to_numpy(zero_copy_only=False)
        for rows, places, raw, offsets in _segments(batch.column("text")):
            row, lo, span, a, c = find_runs(raw, offsets)
            if len(row):
                parts.append((a, c, ids[rows[row]], ties[rows[row]], lo + places[row], span))
                held += len(row)
            if held > 250_000:
                yield _combine(parts)
                parts, held = [], 0
    if held:
        yield _combine(parts)


@tidied
def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of listed runs of each text."""
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        held = 0
        ids, ties, texts, lists = (batch.column(c) for c in ("doc_id", "tie", "text", "runs"))
        for k in range(batch.num_rows):
            raw = texts[k].as_py().encode()
            runs = lists[k].values
            doc_id, tie = ids[k].as_py(), ties[k].as_py()
            for a, hot, lo, span in zip(*(runs.field(f).to_pylist() for f in ("a", "hot", "lo", "span"))):
                part = raw[lo : lo + span + DEPTH - 1]
                for column, value in zip(out, (a, hot, doc_id, tie, lo, part)):
                    column.append(value)
                held += len(part)
            if held > 1 << 22:
                yield _context_batch(out)
                out, held = [[] for _ in range(6)], 0
        if held:
            yield _context_batch(out)


_CONTEXT = pa.schema([("a", pa.int64()), ("hot", pa.bool_()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("lo", pa.int64()), ("bytes", pa.binary())])
_CONTEXT_DDL = "a long, hot boolean, doc_id long, tie long, lo long, bytes binary"


def _context_batch(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CONTEXT)], schema=_CONTEXT)


def _ranks(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    ranks = np.empty(len(keys), np.uint64)
    ranks[order] = np.cumsum(np.concatenate(([True], keys[order][1:] != keys[order][:-1]))).astype(np.uint64)
    return ranks


def suffix_ranks(data: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each position's suffix cut to ``depth`` bytes, groups apart; equal strings rank alike.

    Prefix doubling: ranks of 2h bytes from pairs of ranks of h bytes.  Only ranks of positions
    with ``depth`` bytes left in their own string have a meaning.
    """
    have = 1
    ranks = _ranks((group.astype(np.uint64) << _U(8)) | data.astype(np.uint64))
    while have < depth:
        step = min(have, depth - have)
        shifted = np.zeros(len(ranks), np.uint64)
        shifted[: len(ranks) - step] = ranks[step:]
        ranks = _ranks((ranks << _U(32)) | shifted)
        have += step
    return ranks


def smaller_neighbours(position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of an order: the nearest place before and after whose position is smaller (-1: none)."""
    n = len(position)
    out = []
    for way in (1, -1):
        p = position[::way]
        near = np.arange(n) - 1
        open_ = np.flatnonzero(near >= 0)
        open_ = open_[p[near[open_]] > p[open_]]
        while len(open_):  # follow the neighbours' own neighbours until a smaller one is found
            near[open_] = near[near[open_]]
            open_ = open_[near[open_] >= 0]
            open_ = open_[p[near[open_]] > p[open_]]
        out.append(near if way == 1 else np.where(near >= 0, n - 1 - near, -1)[::-1])
    return out[0], out[1]


def earlier_matches(ranks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Which ``windows`` (positions, ascending) have an earlier window of the same rank.

    This is the longest-previous-factor array, asked only whether it reaches the depth: the
    longest earlier match of a suffix is at its previous or next smaller position in suffix
    order, and it has that many bytes when the ranks are equal.
    """
    order = np.argsort(ranks[windows], kind="stable")
    rank = ranks[windows][order]
    before, after = smaller_neighbours(windows[order])
    reach = np.zeros(len(order), bool)
    for near in (before, after):
        has = near >= 0
        reach[has] |= rank[near[has]] == rank[has]
    found = np.zeros(len(order), bool)
    found[order] = reach
    return found


@tidied
def _sorted_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order of (anchor, doc_id, tie, lo) to removed spans; anchors are sorted together until SORT_BYTES."""
    held: list[tuple] = []
    size, anchor = 0, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("a", "doc_id", "tie", "lo", "bytes")]
        for row in zip(*columns):
            if row[0] != anchor and size > SORT_BYTES:
                yield _span_batch(held)
                held, size = [], 0
            anchor = row[0]
            held.append(row)
            size += len(row[4])
    if held:
        yield _span_batch(held)


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    sizes = np.array([len(r[4]) for r in rows])
    data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
    anchors = np.array([r[0] for r in rows])
    group = np.repeat(np.cumsum(np.concatenate(([0], anchors[1:] != anchors[:-1]))), sizes)
    ends = np.cumsum(sizes)
    place = np.arange(len(data))
    windows = place[place + DEPTH <= np.repeat(ends, sizes)]
    hit = windows[earlier_matches(suffix_ranks(data, group, DEPTH), windows)]
    row = np.searchsorted(ends, hit, side="right")
    cut = np.flatnonzero(np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (row[1:] != row[:-1])))) if len(hit) else np.empty(0, np.int64)
    last = np.append(cut[1:], len(hit)) - 1 if len(hit) else cut
    at = row[cut]
    lo = np.array([r[3] for r in rows], np.int64)[at] - (ends - sizes)[at]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.array([r[1] for r in rows], np.int64)[at]), pa.array(np.array([r[2] for r in rows], np.int64)[at]),
         pa.array(lo + hit[cut]), pa.array(lo + hit[last] + DEPTH)],
        names=["doc_id", "tie", "start", "stop"],
    )


@tidied
def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the runs of hot anchors with two hashes."""
    for batch in batches:
        for a, doc_id, tie, lo, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "doc_id", "tie", "lo", "bytes"))):
            made = [hashlib.blake2b(raw[k : k + DEPTH], digest_size=16).digest() for k in range(len(raw) - DEPTH + 1)]
            n = len(made)
            yield pa.RecordBatch.from_arrays(
                [pa.array(made, pa.binary()), pa.array([doc_id] * n, pa.int64()), pa.array([tie] * n, pa.int64()), pa.array(np.arange(lo, lo + n))],
                names=["w", "doc_id", "tie", "start"],
            )


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


@tidied
def _trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and their spans to the bytes that stay, a few megabytes at a time."""
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        texts, lists = batch.column("text"), batch.column("spans")
        rest = [c for c in batch.schema.names if c not in ("text", "spans")]
        out: list[list] = [[] for _ in range(5)]
        done, held = 0, 0
        for k in range(batch.num_rows):
            raw = (texts[k].as_py() or "").encode()
            spans = lists[k]
            merged: list[tuple[int, int]] = []
            if spans.is_valid and len(spans.values):
                merged = _merge(list(zip(spans.values.field("start").to_pylist(), spans.values.field("stop").to_pylist())))
            at, parts = 0, []
            for lo, hi in merged:
                parts.append(raw[at:lo])
                at = hi
            parts.append(raw[at:])
            kept = b"".join(parts)
            row = (len(raw), len(raw) - len(kept), [{"start": a, "stop": b} for a, b in merged], kept, hashlib.sha256(kept).hexdigest())
            for column, value in zip(out, row):
                column.append(value)
            held += len(raw)
            if held > 1 << 22 or k == batch.num_rows - 1:
                types = (pa.int64(), pa.int64(), span_type, pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(done, k + 1 - done) for c in rest), *(pa.array(c, t) for c, t in zip(out, types))],
                    names=[*rest, "n_bytes", "n_removed", "removed", "kept", "kept_sha256"],
                )
                out, done, held = [[] for _ in range(5)], k + 1, 0


def remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, _rest, n_bytes, n_removed, removed, kept, kept_sha256.

    ``removed`` lists the maximal removed runs (start, stop in bytes), ``kept`` holds the bytes
    that stay, ``_rest`` the table's other columns.  Null text is empty.  A null doc_id counts as
    smaller than any other.  Among rows of the same doc_id the order is that of a hash of the
    text; of rows equal in both, one is the first.
    """
    scratch = Scratch(spark, "suffix-dedup")
    columns = ["doc_id", "text"]
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    h1, h2 = F.xxhash64(F.coalesce("text", F.lit(""))), F.hash(F.coalesce("text", F.lit("")))
    packed = pack(docs, columns).withColumns({"_id": doc_id, "_h1": h1, "_h2": h2})
    names = scratch.save(packed.select("_id", "_h1", "_h2", F.octet_length("text").alias("size")), "names")

    # Step 1: rows that aren't the first of their text.
    firsts = scratch.save(
        names.groupBy("_h1", "_h2").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("rows")), "firsts"
    )
    several = firsts.filter("rows > 1").select(F.col("_h1").alias("h1"), F.col("_h2").alias("h2"), "first")
    text_key = F.xxhash64("_h1", "_h2")
    bits = key_filter(several.select(F.xxhash64("h1", "h2").alias("k")), "k")
    marked = with_maybe(packed, text_key, bits, "_maybe")
    alone = marked.filter("not _maybe").drop("_maybe")
    shared = marked.filter("_maybe").drop("_maybe").join(
        several, (F.col("_h1") == F.col("h1")) & (F.col("_h2") == F.col("h2")), "left"
    ).drop("h1", "h2")
    # Equal rows (same text and doc_id as the first): one stands for them, by number within (text, doc_id).
    copies = scratch.save(
        names.join(several, (F.col("_h1") == F.col("h1")) & (F.col("_h2") == F.col("h2")) & (F.col("_id") == F.col("first")))
        .groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"),
        "copies",
    )
    later = shared.filter("first is not null and _id > first").drop("first")
    first = shared.filter("first is null or _id <= first").drop("first")
    if copies.limit(1).count():
        c = copies.select(F.col("_h1").alias("c1"), F.col("_h2").alias("c2"), "n")
        with_n = first.join(c, (F.col("_h1") == F.col("c1")) & (F.col("_h2") == F.col("c2")), "left").drop("c1", "c2")
        number = F.row_number().over(W.partitionBy("_h1", "_h2", "_id").orderBy(F.lit(1)))
        # Only rows that repeat doc_id and text are numbered here.
        numbered = scratch.save(with_n.filter("n is not null").withColumn("_number", number).drop("n"), "numbered")
        first = with_n.filter("n is null").drop("n").unionByName(numbered.filter("_number = 1").drop("_number"))
        later = later.unionByName(numbered.filter("_number > 1").drop("_number"))
    # A task of step 2 marks what it has met before.  Rows that come from a shuffle are put in order, so that
    # a task run again after a lost executor meets them alike and marks the same runs.
    play = alone.unionByName(first.sortWithinPartitions("_h1", "_h2", "_id"))

    # Rows of one doc_id with different texts get a number (their order by hash); else it is 0.
    ids = firsts.groupBy(F.col("first").alias("_id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if ids.limit(1).count():
        order = W.partitionBy("first").orderBy("_h1", "_h2")
        ties = firsts.withColumn("tie", F.row_number().over(order).cast("long") - 1).filter("tie > 0")
        ties = scratch.save(ties.select(F.col("_h1").alias("t1"), F.col("_h2").alias("t2"), "tie"), "ties")
        play = play.join(ties, (F.col("_h1") == F.col("t1")) & (F.col("_h2") == F.col("t2")), "left").drop("t1", "t2")
        play = play.withColumn("tie", F.coalesce("tie", F.lit(0).cast("long"))).sortWithinPartitions("_h1", "_h2", "_id")
    else:
        play = play.withColumn("tie", F.lit(0).cast("long"))

    # Step 2: runs by anchor.
    texts = play.select(F.col("_id").alias("doc_id"), "tie", "text")
    long_texts = texts.filter(F.octet_length("text") >= DEPTH)
    runs = long_texts.mapInArrow(_runs, _RUNS_DDL)
    of_anchor = W.partitionBy("a")
    of_run = W.partitionBy("a", "c").orderBy("doc_id", "tie", "lo")
    met = runs.withColumns({"n": F.row_number().over(of_run), "least": F.min("c").over(of_anchor), "most": F.max("c").over(of_anchor)})
    met = scratch.save(
        met.withColumn("later", F.col("later") | (F.col("n") > 1)).filter("later or least <> most")
        .select("a", "doc_id", "tie", "lo", "span", "later"),
        "met",
    )
    scratch.release()
    whole = met.filter("later").select("doc_id", "tie", F.col("lo").alias("start"), (F.col("lo") + F.col("span") + DEPTH - 1).alias("stop"))

    # Step 3: bytes of the runs left, suffix order anchor by anchor.
    left = met.filter("not later")
    hot = left.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP).select("a", F.lit(True).alias("hot"))
    left = left.join(hot, "a", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    lists = scratch.save(
        left.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("a", "hot", "lo", "span")).alias("runs")), "lists"
    )
    lists_key = F.xxhash64("doc_id", "tie")
    near = with_maybe(texts, lists_key, key_filter(lists.select(lists_key.alias("k")), "k"), "_maybe").filter("_maybe")
    contexts = scratch.save(
        near.select("doc_id", "tie", "text").join(lists, ["doc_id", "tie"]).select("doc_id", "tie", "text", "runs").mapInArrow(_fetch, _CONTEXT_DDL),
        "contexts",
    )
    scratch.release()
    cold = contexts.filter("not hot").repartition("a").sortWithinPartitions("a", "doc_id", "tie", "lo")
    spans = cold.select("a", "doc_id", "tie", "lo", "bytes").mapInArrow(_sorted_spans, "doc_id long, tie long, start long, stop long")
    spans = spans.unionByName(whole)
    if contexts.filter("hot").limit(1).count():
        w = scratch.save(contexts.filter("hot").mapInArrow(_windows, "w binary, doc_id long, tie long, start long"), "windows")
        seen = w.groupBy("w").agg(F.min(F.struct("doc_id", "tie", "start")).alias("f"), F.count(F.lit(1)).alias("n"))
        seen = scratch.save(seen.filter("n > 1").select("w", "f"), "seen")
        again = w.join(seen, "w").filter("struct(doc_id, tie, start) > f")
        spans = spans.unionByName(again.select("doc_id", "tie", "start", (F.col("start") + DEPTH).alias("stop")))
    spans = scratch.save(
        spans.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
        .select(F.col("doc_id").alias("s_id"), F.col("tie").alias("s_tie"), "spans"),
        "spans",
    )
    for name in ("met", "lists", "contexts"):
        scratch.drop(name)
    scratch.release()

    span_key = F.xxhash64("s_id", "s_tie")
    marked = with_maybe(play, F.xxhash64("_id", "tie"), key_filter(spans.select(span_key.alias("k")), "k"), "_maybe")
    none = F.lit(None).cast("array<struct<start:bigint,stop:bigint>>")
    out = ["doc_id", "_rest", "text", "spans"]
    plain = marked.filter("not _maybe").withColumn("spans", none).select(*out)
    cut = marked.filter("_maybe").join(spans, (F.col("_id") == F.col("s_id")) & (F.col("tie") == F.col("s_tie")), "left").select(*out)
    size = F.octet_length("text").cast("long")
    all_of = F.when(size >= DEPTH, F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("stop"))))
    gone = later.withColumn("spans", all_of).select(*out)
    rest = packed.schema["_rest"].dataType.simpleString()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {id_type}, _rest {rest}, n_bytes long, n_removed long, removed array<struct<start:bigint,stop:bigint>>, kept binary, kept_sha256 string"
    return plain.unionByName(cut).unionByName(gone).mapInArrow(_trim, ddl)


def without_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``; rows left without a byte of their text go.

    A character that loses one of its bytes goes whole.  Rows that had no text before stay.
    """
    trimmed = remove_repeats(spark, docs).filter("n_removed = 0 or n_removed < n_bytes")
    types = {f.name: f.dataType.simpleString() for f in trimmed.schema}
    ddl = f"doc_id {types['doc_id']}, _rest {types['_rest']}, text string"
    return unpack(trimmed.mapInArrow(_decode, ddl), docs.columns, ["doc_id", "text"])


@tidied
def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [k.as_py().decode("utf-8", "ignore") for k in batch.column("kept")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("_rest"), pa.array(text, pa.string())], names=["doc_id", "_rest", "text"]
        )


def repeat_digests(trimmed: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of ``remove_repeats``."""
    return trimmed.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")
