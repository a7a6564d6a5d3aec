"""N-gram Jaccard join: a size-aware heavy-light self join of shingle sets, exact.

Two sets link when 100 * |A n B| >= percent * |A u B|.

*Light* sets (fewer than ``x`` shingles) enumerate fixed-size subsets: a linked pair shares the
subset A n B, which leaves out at most ``n * (100 - percent) / 100`` elements of either set, so
all subsets of the sizes ``n``, ``n - 1``, ... down to that number are keys of a join.

*Large* sets (``x`` and more) scan inverted lists.  A list belongs to a block, the shingles of a
set whose hashes fall in one of ``m`` cells, not to one shingle: a shingle of a passage that many
documents share has a list as long as the passage is common, a whole block has not.  A linked
pair whose larger set lies in a size class differs in at most ``d`` shingles there, so with
``m > d`` cells some block is the same in both (pigeonhole).  Empty blocks are keys only for a
set with at most ``d`` blocks that are not empty; every other set is found by one that is not.
A set posts to the classes of all partners' sizes that could link with it.

The boundary ``x`` is chosen by cost: from the counts of sets by size, keys plus shingles scanned
for each possible boundary (multiples of 100 / (100 - percent), where the subsets' sizes change).

Work is done on classes of equal sets, so copies never multiply.  Every list names its smallest
member and its hub, the member that meets most others in all its lists; candidates are first
checked against these, the classes found linked are joined to components, and only pairs of a
list that lie in different components are checked after that.  The pairs of a list grow with the
square of its members, so a set leaves the lists of MANY members and more when it has more elements
of its own, that no other set of such lists has, than a linked partner may lack (first counted over
a share of the hash range, which only counts fewer).  Of the pairs left, one leaves the join
only if the odd sketches of its sets (parities of their elements in SKETCH cells) differ in no
more cells than a linked pair has different elements: each of them flips one cell, so no linked
pair is lost.  Cells that are few for a set's size are even odds and tell nothing, so sets of LONG
shingles and more are joined apart, with sketches whose cells grow with the set (a sketch of more
cells folds to one of fewer); the pairs left are held against sketches of WIDE cells or more, by the
same bound, before any whole set is sent for a pair.
Components are whole: a pair left out joins two sets that are linked already.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.llm.common import Scratch, components, key_filter, pack, tidied, unpack, with_maybe
from ledgerline.llm.words import mix, shingles, text_chunks, word_hashes

_U = np.uint64
#: Boundaries that are compared, in units of 100 / (100 - percent) shingles.
BOUNDARIES = (1, 2, 3)
#: Cells of a set's odd sketch, in 64-bit words.
SKETCH = 2048
#: Sets from which on a list's entries carry sketches of as many cells as half their shingles, or more.
LONG = 2 * SKETCH
#: Members from which on a list's sets are first asked for elements of their own.
MANY = 32
#: Least cells of the sketch that pairs are held against before their sets are fetched (1 KB a set).
WIDE = 8192
WORDS = [f"s{k}" for k in range(SKETCH // 64)]


def _rows(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes)."""
    for first, raw, offsets in text_chunks(batch.column("text")):
        hashes, firsts = word_hashes(raw, offsets)
        made, starts = shingles(hashes, firsts, width)
        for k in range(len(offsets) - 1):
            part = made[starts[k] : starts[k + 1]]
            if len(part):
                part = np.sort(part)
                part = part[np.concatenate(([True], part[1:] != part[:-1]))]
            yield first + k, part


def _class_of(values: np.ndarray) -> int:
    """A set's id: 63 bits of a hash of all members and the size."""
    total = int(mix(values ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) if len(values) else 0
    return int(mix(np.array([(total + len(values)) & (2**64 - 1)], dtype=np.uint64))[0] >> _U(1))


def _sketch(values: np.ndarray, wide: int = SKETCH) -> np.ndarray:
    """Parities of a set's elements in so many cells, as 64-bit words."""
    cell = (mix(values ^ _U(0xD6E8FEB86659FD93)) % _U(wide)).astype(np.int64)
    odd = np.bincount(cell, minlength=wide).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def sketch_cells(n: int, least: int) -> int:
    """Cells for a set of n: a power of two that is half of n or more, so that sketches of two sizes fold."""
    return max(least, 1 << max(0, (n + 1) // 2 - 1).bit_length())


def differing(a: str, b: str) -> str:
    """SQL: cells in which two sketches differ, the longer folded to the shorter one's cells."""
    bits = "aggregate(zip_with({}, {}, (p, q) -> bit_count(p ^ q)), 0, (s, k) -> s + k)"
    fold = (
        "aggregate(sequence(0, size({0}) div size({1}) - 1), array_repeat(0L, size({1})), "
        "(f, i) -> zip_with(f, slice({0}, i * size({1}) + 1, size({1})), (p, q) -> p ^ q))"
    )
    return (
        f"case when size({a}) = size({b}) then {bits.format(a, b)} when size({a}) > size({b}) "
        f"then {bits.format(fold.format(a, b), b)} else {bits.format(a, fold.format(b, a))} end"
    )


@tidied
def _sizes(batches: Iterator[pa.RecordBatch], width: int, enough: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        more: list[np.ndarray | None] = [None] * batch.num_rows
        n, cls = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        words = np.zeros((batch.num_rows, len(WORDS)), np.int64)
        for row, values in _rows(batch, width):
            n[row], cls[row], words[row] = len(values), _class_of(values), _sketch(values)
            if len(values) >= enough:
                more[row] = _sketch(values, sketch_cells(len(values), SKETCH))
        rest = [batch.column(c) for c in batch.schema.names if c != "text"]
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [*rest, pa.array(n), pa.array(cls), pa.array(more, pa.list_(pa.int64())), *map(pa.array, words.T)],
            names=[*names, "n_shingles", "cls", "more", *WORDS],
        )


def allowed(n: int, percent: int) -> int:
    """Elements of a set of n that a linked partner may lack."""
    return n * (100 - percent) // 100


def size_classes(boundary: int, percent: int, upto: int) -> list[tuple[int, int, int]]:
    """(first size, next class's first size, most differing elements) for partners of upto."""
    out, low = [], boundary
    while not out or low <= upto:
        high = max(low + 1, low * 100 // percent)
        out.append((low, high, 2 * (high - 1) * (100 - percent) // (100 + percent)))
        low = high
    return out


def cells(d: int) -> int:
    return d + 1 + max(1, d // 20)


def _light_keys(values: np.ndarray, percent: int) -> list[np.ndarray]:
    marks = mix(values ^ _U(0x2545F4914F6CDD1D))
    total = marks.sum(dtype=np.uint64)
    keys = []
    for gone in range(allowed(len(values), percent) + 1):
        out = np.array(list(combinations(range(len(values)), gone)), np.int64)
        left = np.full(len(out), total) - marks[out].sum(axis=1, dtype=np.uint64)
        keys.append(mix(left + _U((len(values) - gone) << 8 | 1)))
    return keys


def _heavy_keys(values: np.ndarray, percent: int, boundary: int) -> list[np.ndarray]:
    n, keys = len(values), []
    if n < boundary * percent // 100:
        return keys
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(values ^ _U(0x9FB21C651E98DF25)), out=total[1:])
    for low, high, d in size_classes(boundary, percent, n * 100 // percent):
        if high <= n or 100 * n < percent * low:
            continue
        m = cells(d)
        step = (1 << 64) // m + 1
        bounds = np.arange(m, dtype=np.uint64) * _U(step)
        at = np.append(np.searchsorted(values, bounds), n)
        block = total[at[1:]] - total[at[:-1]]
        count = np.diff(at)
        made = mix(mix(block + count.astype(np.uint64)) + np.arange(m, dtype=np.uint64) * _U(0xA24BAED4963EE407) + _U(low << 8 | 2))
        full = count > 0
        keys.append(made if full.sum() <= d else made[full])
    return keys


@tidied
def _keys(batches: Iterator[pa.RecordBatch], width: int, percent: int, boundary: int) -> Iterator[pa.RecordBatch]:
    """Join keys of each set; of equal sets in a task, only the first posts."""
    seen: set[int] = set()
    for batch in batches:
        sig, cls, held = [], [], 0
        for _, values in _rows(batch, width):
            if not len(values):
                continue
            own = _class_of(values)
            if own in seen:
                continue
            seen.add(own)
            keys = _light_keys(values, percent) if len(values) < boundary else []
            keys += _heavy_keys(values, percent, boundary)
            for k in keys:
                sig.append(k.view(np.int64))
                cls.append(np.full(len(k), own, np.int64))
                held += len(k)
            if held > 200_000:
                yield _key_batch(sig, cls)
                sig, cls, held = [], [], 0
        if held:
            yield _key_batch(sig, cls)
        if len(seen) > 2_000_000:
            seen.clear()


def _key_batch(sig: list, cls: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (sig, cls)], names=["sig", "cls"])


@tidied
def _elements(batches: Iterator[pa.RecordBatch], width: int, below: int) -> Iterator[pa.RecordBatch]:
    """The members under ``below`` of each set; of equal sets in a task, only the first sends them."""
    seen: set[int] = set()
    for batch in batches:
        member, cls, held = [], [], 0
        for _, values in _rows(batch, width):
            own = _class_of(values)
            if not len(values) or own in seen:
                continue
            seen.add(own)
            part = values[: np.searchsorted(values, _U(below))]
            member.append(part.view(np.int64))
            cls.append(np.full(len(part), own, np.int64))
            held += len(part)
            if held > 200_000:
                yield _element_batch(member, cls)
                member, cls, held = [], [], 0
        if held:
            yield _element_batch(member, cls)
        if len(seen) > 2_000_000:
            seen.clear()


def _element_batch(member: list, cls: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (member, cls)], names=["member", "cls"])


@tidied
def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cls, sets, wide, held = [], [], [], 0
        for _, values in _rows(batch, width):
            if len(values):
                cls.append(_class_of(values))
                sets.append(values.view(np.int64))
                wide.append(_sketch(values, sketch_cells(len(values), WIDE)))
                held += len(values) + len(wide[-1])
            if held > 1 << 18:
                yield _set_batch(cls, sets, wide)
                cls, sets, wide, held = [], [], [], 0
        if cls:
            yield _set_batch(cls, sets, wide)


def _set_batch(cls: list, sets: list, wide: list) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    size = [len(x) for x in sets]
    return pa.RecordBatch.from_arrays(
        [pa.array(cls, pa.int64()), pa.array(size, pa.int64()), pa.array(sets, longs), pa.array(wide, longs)],
        names=["cls", "n", "members", "wide"],
    )


def choose_boundary(sizes: DataFrame, percent: int) -> int:
    """The boundary of least cost from counts of sets by size (a few dozen rows reach the driver)."""
    unit = -(-100 // (100 - percent))
    top = unit * (max(BOUNDARIES) + 1)
    rows = (
        sizes.filter("n_shingles > 0").groupBy(F.least("n_shingles", F.lit(top)).alias("n"))
        .agg(F.count(F.lit(1)).alias("sets"), F.sum("n_shingles").alias("all")).collect()
    )
    costs = {}
    for k in BOUNDARIES:
        x, cost = unit * k, 0
        for r in rows:
            if r.n < x:
                cost += r.sets * sum(comb(r.n, gone) for gone in range(allowed(r.n, percent) + 1))
            if 100 * r.n >= percent * x:
                posted = 4 * r["all"] * (100 - percent) // (100 + percent) + 2 * r.sets
                cost += posted + r["all"]
        costs[x] = cost
    return min(costs, key=lambda x: (costs[x], x))


def contested(placed: DataFrame) -> DataFrame:
    """Rows (sig, cls, root) of the lists with classes of several roots, with ``main``, the root of most of them, and ``listed``, their number."""
    parts = placed.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("held"))
    main = parts.groupBy("sig").agg(
        F.max(F.struct("held", "root")).alias("main"), F.count(F.lit(1)).alias("roots"), F.sum("held").alias("listed")
    ).filter("roots > 1").select("sig", F.col("main.root").alias("main"), "listed")
    return placed.join(main, "sig").select("sig", "cls", "root", "main", "listed")


def apart_from_all(texts: DataFrame, sizes: DataFrame, width: int, percent: int, share: int) -> DataFrame:
    """Classes (cls) that link with no other set of ``texts``, by their own elements; ``sizes`` has (cls, n).

    A set links with none if it has more elements that no other set has than a linked set may lack.
    Only those in ``share`` 200ths of the hash range are counted: fewer than all, so no link is lost.
    Nor is one by rows that repeat or by sets that nothing asks for: with them fewer elements count.
    """
    below = (1 << 64) * share // 200 - 1
    members = texts.mapInArrow(partial(_elements, width=width, below=below), "member long, cls long")
    owners = members.groupBy("member").agg(F.min("cls").alias("cls"), F.max("cls").alias("other")).filter("cls = other")
    alone = owners.groupBy("cls").agg(F.count(F.lit(1)).alias("alone"))
    return alone.join(sizes, "cls").filter(f"100 * alone > {100 - percent} * n").select("cls")


def link_documents(
    spark: SparkSession, docs: DataFrame, *, width: int = 5, percent: int = 80, scratch: Scratch | None = None
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text_key, cls, n_shingles, component_id, root.

    ``component_id`` is the smallest doc_id reachable by links, its own included.  Null text is
    empty; a text without words has n_shingles 0 and links with nothing.  Repeated rows are
    documents like any other and link with each other.  A null doc_id never names a component
    unless all of its doc_ids are null.  Other columns are ignored.  ``text_key`` (xxhash64 of
    the text) tells rows that share a doc_id apart.  ``root`` (the smallest class of the component)
    tells components apart that share a component_id: those without an id, and unlinked texts
    under one doc_id.
    """
    scratch = scratch or Scratch(spark, "ngram-join")
    base = docs.select("doc_id", "text")
    keyed = base.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    words = ", ".join(f"{w} long" for w in WORDS)
    enough = -(-percent * LONG // 100)  # partners of the sets of LONG shingles
    sizes = scratch.save(
        keyed.mapInArrow(
            partial(_sizes, width=width, enough=enough),
            f"doc_id long, text_key long, n_shingles long, cls long, more array<long>, {words}",
        ),
        "sizes",
    )
    boundary = choose_boundary(sizes, percent)
    posted = base.select("text").mapInArrow(
        partial(_keys, width=width, percent=percent, boundary=boundary), "sig long, cls long"
    )
    of_list = W.partitionBy("sig")
    lists = scratch.save(
        posted.withColumns({"rep": F.min("cls").over(of_list), "top": F.max("cls").over(of_list), "held": F.count("cls").over(of_list)})
        .filter("rep <> top").drop("top"),
        "lists",
    )
    scratch.release()

    listed = scratch.save(lists.select("cls").distinct(), "listed")
    chosen = scratch.save(
        sizes.join(listed, "cls", "left_semi").groupBy("cls")
        .agg(F.min(F.struct("doc_id", "text_key")).alias("of"), F.max("n_shingles").alias("n"), F.max("more").alias("more"), *[F.max(w).alias(w) for w in WORDS]),
        "chosen",
    )
    scratch.release()
    own = F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text"))

    # A linked pair has at most (n + nx) * (100 - percent) / (100 + percent) different elements.
    apart = " + ".join(f"bit_count({w} ^ x_{w})" for w in WORDS)
    bound = f"* {100 + percent} <= (n + nx) * {100 - percent}"
    near_enough = f"({apart}) {bound}"
    still_near = f"({differing('wide', 'x_wide')}) {bound}"
    marks = chosen.select("cls", "n", *WORDS)
    x_marks = marks.select(F.col("cls").alias("x"), F.col("n").alias("nx"), *[F.col(w).alias(f"x_{w}") for w in WORDS])

    def texts_of(needed: DataFrame, name: str) -> DataFrame:
        """A text of each class of ``needed`` (cls), and some that pass by chance, or repeat."""
        documents = chosen.join(needed, "cls", "left_semi").select(F.xxhash64("of.doc_id", "of.text_key").alias("key"))
        return with_maybe(base, own, key_filter(scratch.save(documents, f"needed-{name}"), "key"), "_maybe").filter("_maybe").select("text")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """``pairs`` (a, b), saved, with whether they link; their classes' sets come from one document each."""
        needed = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
        near = texts_of(needed, name)
        # Rows that pass by chance, or repeat, add sets that no pair needs or has already: pairs are made distinct again.
        known = scratch.save(near.mapInArrow(partial(_sets, width=width), "cls long, n long, members array<long>, wide array<long>"), f"sets-{name}")
        wide_a = known.select(F.col("cls").alias("a"), "n", "wide")
        wide_b = known.select(F.col("cls").alias("b"), F.col("n").alias("nx"), F.col("wide").alias("x_wide"))
        pairs = scratch.save(pairs.join(wide_a, "a").join(wide_b, "b").filter(still_near).select("a", "b").distinct(), f"near-{name}")
        scratch.release()
        a = known.select(F.col("cls").alias("a"), F.col("members").alias("set_a"))
        b = known.select(F.col("cls").alias("b"), F.col("members").alias("set_b"))
        both = F.size(F.array_intersect("set_a", "set_b"))
        union = F.size("set_a") + F.size("set_b") - F.col("both")
        full = pairs.join(a, "a").join(b, "b").withColumn("both", both)
        checked = scratch.save(full.select("a", "b", (100 * F.col("both") >= percent * union).alias("linked")).distinct(), name)
        for old in (f"sets-{name}", f"near-{name}", f"needed-{name}"):
            scratch.drop(old)
        scratch.release()
        return checked

    first = lists.filter("cls <> rep").groupBy(F.col("cls").alias("b")).agg(F.min("rep").alias("a"))
    weights = scratch.save(lists.groupBy("cls").agg(F.sum("held").alias("weight")), "weights")
    heaviest = F.max(F.struct("weight", "cls"))["cls"].alias("hub")
    hubs = scratch.save(lists.join(weights, "cls").groupBy("sig").agg(heaviest), "hubs")
    shared = lists.join(hubs, "sig").filter("cls <> hub").groupBy("cls", "hub").agg(F.count(F.lit(1)).alias("lists"))
    best = shared.groupBy("cls").agg(F.max(F.struct("lists", "hub"))["hub"].alias("hub"))
    to_hub = best.select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b"))
    asked = scratch.save(first.select("a", "b").unionByName(to_hub).distinct(), "asked")
    close = asked.join(marks.withColumnRenamed("cls", "a"), "a").join(x_marks.withColumnRenamed("x", "b"), "b").filter(near_enough)
    close = scratch.save(close.select("a", "b"), "close")
    scratch.drop("weights")
    scratch.drop("hubs")
    scratch.release()
    done = verified(close, "checked-0")
    scratch.release()
    edges = done.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = components(spark, edges, scratch)

    # The rest: pairs of a list in different components, the smaller side against the whole list.
    placed = lists.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    met = scratch.save(contested(placed), "met")
    scratch.drop("lists")
    scratch.release()
    # Sets that link with none of the long lists' sets go from these lists, before their pairs are met: most by a
    # share of their elements, then by all of those that the sets left have.
    few = [met.filter(F.col("listed") < MANY)]
    crowd = met.filter(F.col("listed") >= MANY)
    for step, share in enumerate((min(200, 3 * (100 - percent)), 200)):
        texts = texts_of(crowd.select("cls").distinct(), f"crowd-{step}")
        alone = scratch.save(apart_from_all(texts, chosen.select("cls", "n"), width, percent, share), f"alone-{step}")
        crowd = scratch.save(contested(crowd.select("sig", "cls", "root").join(alone, "cls", "left_anti")), f"crowd-left-{step}")
        few.append(crowd.filter(F.col("listed") < MANY))
        crowd = crowd.filter(F.col("listed") >= MANY)
        scratch.release()
    open_lists = scratch.save(few[0].unionByName(few[1]).unionByName(few[2]).unionByName(crowd).drop("listed"), "open")
    for old in ("met", "needed-crowd-0", "needed-crowd-1", "alone-0", "alone-1", "crowd-left-0", "crowd-left-1"):
        scratch.drop(old)
    scratch.release()
    # Short sets carry their sketch in columns, long ones in an array; each kind has its own join.
    long_marks = chosen.filter(f"n >= {enough}").select("cls", "n", "more")
    kinds = {
        "short": (marks.filter(f"n < {LONG}"), near_enough, WORDS),
        "long": (long_marks, f"greatest(n, nx) >= {LONG} and ({differing('more', 'x_more')}) {bound}", ["more"]),
    }
    found = []
    for kind, (of_kind, alike, sketch) in kinds.items():
        mixed = scratch.save(open_lists.join(of_kind, "cls"), f"mixed-{kind}")
        minor = mixed.filter("root <> main").select(
            "sig", F.col("cls").alias("x"), F.col("n").alias("nx"), F.col("root").alias("rx"), *[F.col(w).alias(f"x_{w}") for w in sketch]
        )
        pairs = (
            minor.join(mixed, "sig").filter(f"root <> rx and 100 * least(n, nx) >= {percent} * greatest(n, nx) and {alike}")
            .select(F.least("x", "cls").alias("a"), F.greatest("x", "cls").alias("b")).distinct()
            .join(close, ["a", "b"], "left_anti")
        )
        found.append(scratch.save(pairs, f"pairs-{kind}"))
        scratch.drop(f"mixed-{kind}")
        scratch.release()
    scratch.drop("open")
    pairs = found[0].unionByName(found[1])
    more = verified(pairs, "checked-1")
    scratch.release()
    again = edges.unionByName(more.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v")))
    roots = components(spark, again, scratch)

    by_class = scratch.save(sizes.groupBy("cls").agg(F.min("doc_id").alias("first_id")), "classes")
    rooted = by_class.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    rooted = scratch.save(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    lookup = scratch.save(rooted.join(named, "root").select("cls", "root", "component_id"), "lookup")
    for name in ("listed", "chosen", "asked", "close", "pairs-short", "pairs-long"):
        scratch.drop(name)
    joined = sizes.join(lookup, "cls", "left")
    return joined.select(
        "doc_id", "text_key", "cls", "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "root",
    )


def keep_first(spark: SparkSession, docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without near duplicates: of each component the row of the smallest doc_id stays.

    Nulls come last, and of texts that share the smallest doc_id the one of the smallest text_key
    stays.  Of equal rows one stays.  Rows without words all stay.
    """
    scratch = Scratch(spark, "ngram-keep")
    linked = link_documents(spark, docs, width=width, percent=percent, scratch=scratch)
    doubled = linked.filter("n_shingles > 0").groupBy("doc_id", "text_key").agg(
        F.min("root").alias("root"), F.count(F.lit(1)).alias("rows")
    )
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("hold")
    hold = doubled.groupBy("root").agg(least)
    gone = scratch.save(
        doubled.join(hold, "root")
        .withColumn("keeps", F.col("doc_id").eqNullSafe(F.col("hold.doc_id")) & (F.col("text_key") == F.col("hold.text_key")))
        .filter("not keeps or rows > 1").select("doc_id", "text_key", "keeps"),
        "gone",
    )
    scratch.release()
    key = F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text"))
    bits = key_filter(gone.select(F.xxhash64("doc_id", "text_key").alias("key")), "key")
    marked = with_maybe(pack(docs, ["doc_id", "text"]), key, bits, "_maybe")
    clean = marked.filter("not _maybe").drop("_maybe")
    touched = (
        marked.filter("_maybe").drop("_maybe")
        .withColumns({"_id": F.col("doc_id").cast("long"), "_text": F.xxhash64("text")})
    )
    g = gone.select(F.col("doc_id").alias("_gid"), F.col("text_key").alias("_gtext"), F.col("keeps").alias("_keeps"))
    joined = touched.join(g, F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_text") == F.col("_gtext")), "left")
    plain = joined.filter("_keeps is null")
    repeated = joined.filter("_keeps").dropDuplicates(["_id", "_text"])
    kept = plain.unionByName(repeated)
    whole = clean.unionByName(kept.select(*clean.columns))
    return unpack(whole, docs.columns, ["doc_id", "text"])
