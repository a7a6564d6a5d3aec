"""Exact top-k by inner product: an M-tree of pages in a Spark table, searched best first.

Components are whole numbers, so products are exact.  With one more coordinate, the root of
M - |x|^2 (M the largest |x|^2, and 0 for a query), all vectors lie on a sphere, and the largest
product is the smallest Euclidean distance: |q - x|^2 = |q|^2 + M - 2 q.x.  The tree is one of
that metric.

Building: a group of more than ``shelf`` rows is split by up to FANOUT of its own rows, each row
going to the nearest; equally near ones share the rows by hash, so copies split too.  Rounds go on
until all groups fit.  A group is a *shelf*: one task cuts it into pages of at most PAGE entries
the same way.  Every node has its routing row, its covering radius and its distance to the parent's
routing row, every entry of a leaf its distance to the leaf's.

Searching: a query first goes to its own row's shelf, then in rounds to the next 1, 4, 16 ... of
the shelves in the order of their lower bounds, as long as one may still hold a product as large
as its k-th; the bounds of all shelves come from a directory of their routing rows, which is dealt
in chunks.  On a shelf, rounds take each query's best open nodes.  Distances to a node's or a
leaf's entries are computed only where |d(q, parent) - d(entry, parent)| less the radius allows
a hit.  Queries travel to shelves in salted shares and stream past the pages.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import Scratch, heads_first, past_heads
from ledgerline.llm.words import mix

#: Rows that split a group, and entries of a page.
FANOUT, PAGE = 64, 64
#: Rows of a shelf: a 64th of all, between these.
SHELF = (4096, 1 << 18)
#: Shelves in a chunk of the directory, and rows or queries that stream past one copy of a head.
CHUNK, SHARE = 4096, 1 << 16
#: Queries searched at a time.
BLOCK = 2048
_KINDS = ("i1", "i2", "i4", "i8")
_NONE = np.iinfo(np.int64).min


def _matrix(column: pa.Array, kind: str, d: int) -> np.ndarray:
    """Binary rows of whole numbers as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), f"<{kind}").reshape(len(column), d)


class Metric:
    """Products and distances of rows with the added coordinate; ``top`` is M."""

    def __init__(self, d: int, top: int, kind: str):
        self.d, self.top, self.kind = d, top, kind
        # Below 2^53 all partial sums of a product are exact doubles (Cauchy-Schwarz).
        self.type = np.float64 if top < 1 << 53 else np.int64
        #: Rounding of a distance that is the root of a difference, generously.
        self.slack = 1e-6 * np.sqrt(2.0 * top) + 1e-9

    def rows(self, data: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(data, dtype=self.type)

    def lengths(self, rows: np.ndarray) -> np.ndarray:
        return (rows * rows).sum(axis=1).astype(np.float64)

    def added(self, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.top - self.lengths(rows), 0.0))

    def between(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of all rows of x to all of y."""
        products = (x @ y.T).astype(np.float64) + np.outer(self.added(x), self.added(y))
        return np.sqrt(np.maximum(2.0 * self.top - 2.0 * products, 0.0))

    def to_queries(self, lengths: np.ndarray, products: np.ndarray) -> np.ndarray:
        """Distances of queries of these squared lengths to rows of these products with them."""
        return np.sqrt(np.maximum(lengths + self.top - 2.0 * products.astype(np.float64), 0.0))


def _nearest(metric: Metric, rows: np.ndarray, seeds: np.ndarray, lots: np.ndarray) -> np.ndarray:
    """Each row's nearest seed; those as near share the rows by lot."""
    out = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), 8192):
        part = rows[at : at + 8192]
        far = -(part @ seeds.T).astype(np.float64) - np.outer(metric.added(part), metric.added(seeds))
        close = far <= far.min(axis=1, keepdims=True) + 1e-9 * metric.top
        place = np.cumsum(close, axis=1)
        pick = (lots[at : at + 8192] % place[:, -1].astype(np.uint64)).astype(np.int64) + 1
        out[at : at + 8192] = np.argmax(place == pick[:, None], axis=1)
    return out


def _split(batches: Iterator[pa.RecordBatch], metric: Metric) -> Iterator[pa.RecordBatch]:
    """Rows of split groups with the group of their nearest seed."""
    seeds = None
    for head, rows in heads_first(batches, "seeds"):
        if rows is None:
            seeds = metric.rows(np.frombuffer(b"".join(head["seeds"]), f"<{metric.kind}").reshape(-1, metric.d))
            continue
        data = metric.rows(_matrix(rows.column("x"), metric.kind, metric.d))
        lots = mix(rows.column("node").to_numpy().astype(np.uint64))
        to = rows.column("shelf").to_numpy() * FANOUT + 1 + _nearest(metric, data, seeds, lots)
        yield pa.RecordBatch.from_arrays(
            [pa.array(to), *[rows.column(c) for c in ("node", "vec_id", "asks", "x")]], names=["shelf", "node", "vec_id", "asks", "x"]
        )


def build_pages(metric: Metric, rows: np.ndarray, lots: np.ndarray) -> dict[str, np.ndarray]:
    """The tree over rows: for each node parent, begin, end, router, radius, off (distance to the parent's routing
    row), leaf; for each row its place (``order``) and ``far``, its distance to its leaf's routing row.

    A node covers the rows ``begin`` to ``end`` of the order; ``router`` is a row of it too.  Node 0 is the root.
    """
    nodes: list[list] = []
    order = np.arange(len(rows))
    far = np.zeros(len(rows))
    todo = [(-1, 0, len(rows), int(np.argmin(lots)) if len(rows) else 0)]
    turn = 0
    while todo:
        parent, begin, end, router = todo.pop()
        mine = order[begin:end]
        away = metric.between(rows[mine], rows[router : router + 1])[:, 0]
        off = 0.0 if parent < 0 else float(metric.between(rows[router : router + 1], rows[nodes[parent][3]][None])[0, 0])
        node, leaf = len(nodes), end - begin <= PAGE
        nodes.append([parent, begin, end, router, float(away.max(initial=0.0)), off, leaf])
        if leaf:
            far[begin:end] = away
            continue
        turn += 1
        lot = mix(lots[mine] + np.uint64(turn))
        seeds = mine[np.argsort(lot)[: min(PAGE, max(2, -(-2 * len(mine) // PAGE)))]]
        to = _nearest(metric, rows[mine], rows[seeds], lot)
        order[begin:end] = mine[np.argsort(to, kind="stable")]
        edges = begin + np.append(0, np.cumsum(np.bincount(to, minlength=len(seeds))))
        todo += [(node, int(lo), int(hi), int(s)) for lo, hi, s in zip(edges, edges[1:], seeds) if hi > lo]
    parent, begin, end, router, radius, off, leaf = (np.array(c) for c in zip(*nodes))
    return {
        "parent": parent.astype("<i4"), "begin": begin.astype("<i4"), "end": end.astype("<i4"), "router": router.astype("<i4"),
        "radius": radius.astype("<f8"), "off": off.astype("<f8"), "leaf": leaf.astype("<i1"), "order": order, "far": far.astype("<f8"),
    }


_PARTS = {"parent": "<i4", "begin": "<i4", "end": "<i4", "router": "<i4", "radius": "<f8", "off": "<f8", "leaf": "<i1", "far": "<f8"}


def _shelve(table: pa.Table, metric: Metric) -> pa.Table:
    """A shelf's pages, its rows in their order, and the shelf's own routing row and radius."""
    table = table.combine_chunks().sort_by("node")
    node = table.column("node").to_numpy()
    data = _matrix(table.column("x").combine_chunks(), metric.kind, metric.d)
    pages = build_pages(metric, metric.rows(data), mix(node.astype(np.uint64)))
    order = pages.pop("order")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    top = data[pages["router"][0]]
    pages["router"] = place[pages["router"]].astype("<i4")
    known = np.asarray(table.column("vec_id").is_valid())[order]
    ids = np.asarray(table.column("vec_id").fill_null(0))[order]
    return pa.table({
        "shelf": table.column("shelf")[:1], "routing": [top.tobytes()], "reach": [float(pages["radius"][0])],
        **{c: [pages[c].tobytes()] for c in _PARTS}, "nodes": [node[order].astype("<i8").tobytes()], "ids": [ids.astype("<i8").tobytes()],
        "known": [known.astype("<i1").tobytes()], "rows": [data[order].tobytes()],
    })


class Shelf:
    """A shelf's pages and rows, ready to be searched."""

    def __init__(self, metric: Metric, row: dict):
        self.metric = metric
        for name, kind in _PARTS.items():
            setattr(self, name, np.frombuffer(row[name], kind))
        self.nodes = np.frombuffer(row["nodes"], "<i8")
        self.known = np.frombuffer(row["known"], "<i1").astype(bool)
        self.ids = np.where(self.known, np.frombuffer(row["ids"], "<i8"), np.iinfo(np.int64).max)
        self.rows = metric.rows(np.frombuffer(row["rows"], f"<{metric.kind}").reshape(-1, metric.d))
        kids = np.argsort(self.parent, kind="stable")
        first = np.searchsorted(self.parent[kids], np.arange(len(self.parent) + 1))
        self.children = [kids[a:b] for a, b in zip(first, first[1:])]
        #: Products computed, for the tests.
        self.computed = 0

    def search(self, asks: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, product) of each query's k best rows here, its own left out; ``least`` is its k-th product so far."""
        metric = self.metric
        lengths = metric.lengths(queries)
        least = least.copy()
        best = tuple(np.zeros(0, np.int64) for _ in range(3))
        root = int(self.router[0])
        self.computed += len(queries)
        away = metric.to_queries(lengths, queries @ self.rows[root])
        # Open nodes: query, node, its distance, its lower bound.
        who, node, dist = np.arange(len(queries)), np.zeros(len(queries), np.int64), away
        bound = np.maximum(away - self.radius[0], 0.0)
        width = 1
        while len(who):
            limit = np.where(least == _NONE, np.inf, metric.to_queries(lengths, np.maximum(least, -(2.0**62)))) + metric.slack
            keep = bound <= limit[who]
            who, node, dist, bound = who[keep], node[keep], dist[keep], bound[keep]
            order = np.lexsort((node, bound, who))
            who, node, dist, bound = who[order], node[order], dist[order], bound[order]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            now = rank < width
            width *= 2
            opened = [(who[~now], node[~now], dist[~now], bound[~now])]
            mine, at, d = who[now], node[now], dist[now]
            order = np.argsort(at, kind="stable")
            mine, at, d = mine[order], at[order], d[order]
            found: list[tuple] = [best]
            edges = np.append(np.flatnonzero(np.diff(at, prepend=-1)), len(at)).tolist()
            for low, high in zip(edges, edges[1:]):
                page, q, dq = int(at[low]), mine[low:high], d[low:high]
                if self.leaf[page]:
                    entries = np.arange(self.begin[page], self.end[page])
                    near = np.abs(dq[:, None] - self.far[entries]) <= limit[q][:, None]
                else:
                    entries = self.children[page]
                    near = np.abs(dq[:, None] - self.off[entries]) - self.radius[entries] <= limit[q][:, None]
                need = near.any(axis=0)
                entries, near = entries[need], near[:, need]
                self.computed += len(q) * len(entries)
                if self.leaf[page]:
                    products = queries[q] @ self.rows[entries].T
                    hit = near & (products >= least[q][:, None]) & (self.nodes[entries] != asks[q][:, None])
                    i, j = np.nonzero(hit)
                    found.append((q[i], entries[j], products[i, j].astype(np.int64)))
                else:
                    far = metric.to_queries(lengths[q][:, None], queries[q] @ self.rows[self.router[entries]].T)
                    low_bound = np.maximum(far - self.radius[entries], 0.0)
                    i, j = np.nonzero(near & (low_bound <= limit[q][:, None]))
                    opened.append((q[i], entries[j], far[i, j], low_bound[i, j]))
            best = _best(*(np.concatenate(c) for c in zip(*found)), self.ids, self.nodes, k)
            count = np.bincount(best[0], minlength=len(queries))
            last = np.searchsorted(best[0], np.arange(len(queries)), side="right") - 1
            least = np.where(count >= k, np.maximum(least, best[2][last] if len(last) and len(best[2]) else least), least)
            who, node, dist, bound = (np.concatenate(c) for c in zip(*opened))
        return best


def _best(who: np.ndarray, row: np.ndarray, product: np.ndarray, ids: np.ndarray, nodes: np.ndarray, k: int) -> tuple:
    """The k largest products of each query, ties to the smaller id; null ids last."""
    order = np.lexsort((nodes[row], ids[row], -product, who))
    who, row, product = who[order], row[order], product[order]
    keep = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[keep], row[keep], product[keep]


def _ask(batches: Iterator[pa.RecordBatch], metric: Metric, k: int) -> Iterator[pa.RecordBatch]:
    """Queries streamed past the shelves they were sent to."""
    shelf = None
    for head, rows in heads_first(batches, "rows"):
        if rows is None:
            shelf = Shelf(metric, head)
            continue
        for at in range(0, rows.num_rows, BLOCK):
            part = rows.slice(at, BLOCK)
            asks = part.column("asker").to_numpy()
            queries = metric.rows(_matrix(part.column("x"), metric.kind, metric.d))
            who, row, product = shelf.search(asks, queries, part.column("least").to_numpy(), k)
            ids = pa.array(np.where(shelf.known[row], shelf.ids[row], 0), mask=~shelf.known[row])
            yield pa.RecordBatch.from_arrays(
                [pa.array(asks[who]), ids, pa.array(shelf.nodes[row]), pa.array(product)], names=["asker", "vec_id", "node", "score"]
            )


def _directory(table: pa.Table) -> pa.Table:
    """A chunk of the directory: shelves, routing rows and radii."""
    table = table.combine_chunks().sort_by("shelf")
    return pa.table({
        "chunk": table.column("chunk")[:1], "shelves": [table.column("shelf").to_numpy().astype("<i8").tobytes()],
        "routing": [b"".join(table.column("routing").to_pylist())], "reach": [table.column("reach").to_numpy().astype("<f8").tobytes()],
    })


def _bounds(batches: Iterator[pa.RecordBatch], metric: Metric, last: int) -> Iterator[pa.RecordBatch]:
    """(asker, shelf, bound) of at most ``last`` shelves of each chunk that may hold a hit, but for the query's own."""
    for head, rows in heads_first(batches, "routing"):
        if rows is None:
            shelves = np.frombuffer(head["shelves"], "<i8")
            routing = metric.rows(np.frombuffer(head["routing"], f"<{metric.kind}").reshape(-1, metric.d))
            reach = np.frombuffer(head["reach"], "<f8")
            continue
        for at in range(0, rows.num_rows, BLOCK):
            part = rows.slice(at, BLOCK)
            queries = metric.rows(_matrix(part.column("x"), metric.kind, metric.d))
            lengths, least = metric.lengths(queries), part.column("least").to_numpy()
            limit = np.where(least == _NONE, np.inf, metric.to_queries(lengths, np.maximum(least, -(2.0**62)))) + metric.slack
            bound = np.maximum(metric.to_queries(lengths[:, None], queries @ routing.T) - reach, 0.0)
            maybe = (bound <= limit[:, None]) & (shelves != part.column("own").to_numpy()[:, None])
            order = np.argsort(np.where(maybe, bound, np.inf), axis=1, kind="stable")[:, :last]
            keep = np.take_along_axis(maybe, order, axis=1)
            i, j = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays(
                [part.column("asker").take(pa.array(i)), pa.array(shelves[order[i, j]]), pa.array(bound[i, order[i, j]])],
                names=["asker", "shelf", "bound"],
            )


def _every(shares: int):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long")))


def _encode(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1).astype(f"<{kind}") if batch.num_rows else []
        names = ["node", "vec_id", "asks"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in names], pa.array([r.tobytes() for r in data], pa.binary())], names=[*names, "x"]
        )


def build_tree(spark: SparkSession, scratch: Scratch, points: DataFrame, metric: Metric, limit: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their shelf, shelves with their pages) of points (node, vec_id, asks, x)."""
    names = ["shelf", "node", "vec_id", "asks", "x"]
    waiting = scratch.save(points.withColumn("shelf", F.lit(0).cast("long")).select(*names), "split-0")
    done: DataFrame | None = None
    step = 0
    while True:
        sizes = scratch.save(waiting.groupBy("shelf").count(), f"sizes-{step}")
        large = sizes.filter(F.col("count") > limit)
        fits = waiting.join(large.select("shelf"), "shelf", "left_anti").select(*names)
        done = fits if done is None else done.unionByName(fits)
        if not large.limit(1).count():
            break
        some = F.least(F.lit(FANOUT), F.greatest(F.lit(2), F.ceil(2 * F.col("count") / limit)))
        drawn = Window.partitionBy("shelf").orderBy(F.xxhash64("node", F.lit(step)), "node")
        seeds = (
            waiting.select("shelf", "x", F.row_number().over(drawn).alias("place")).filter(F.col("place") <= FANOUT)
            .join(large, "shelf").filter(F.col("place") <= some)
            .groupBy("shelf", "count").agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("drawn"))
            .select("shelf", F.ceil(F.col("count") / SHARE).cast("long").alias("shares"), F.col("drawn.x").alias("seeds"))
        )
        seeds = scratch.save(seeds, f"seeds-{step}")
        heads = seeds.select("shelf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), "seeds")
        rows = waiting.join(seeds.select("shelf", "shares"), "shelf").withColumn("share", F.pmod(F.xxhash64("node"), F.col("shares"))).drop("shares")
        step += 1
        waiting = scratch.save(
            past_heads(heads, rows, ["shelf", "share"], "seeds")
            .mapInArrow(partial(_split, metric=metric), "shelf long, node long, vec_id long, asks boolean, x binary"),
            f"split-{step}",
        )
    dealt = scratch.save(done, "dealt")
    shape = ", ".join(f"{c} binary" for c in (*_PARTS, "nodes", "ids", "known", "rows"))
    shelves = dealt.groupBy("shelf").applyInArrow(lambda table: _shelve(table, metric), f"shelf long, routing binary, reach double, {shape}")
    return dealt, scratch.save(shelves, "shelves")


def top_products(spark: SparkSession, vectors: DataFrame, where: str, k: int = 20, factor: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: for every row of ``vectors`` (vec_id, embedding, ...) that fulfils ``where`` (an
    expression of its columns) the k other rows of largest product of floor(factor * component).

    Exact; all others, if there are fewer than k.  Ties go to the smaller vec_id, null ones last, then to either
    row.  Rows are searched and found by themselves: of repeated vec_ids, each has its own list, and each can be
    in the other's.  Vectors that are null, empty or hold null or non-finite components take no part; zero vectors
    do.  Other columns are only read by ``where``.  No rows give no rows.  Vectors of several lengths raise
    ValueError, products of more than 62 bits ArithmeticError.
    """
    scratch = Scratch(spark, "tree")
    c = F.col("embedding").cast("array<double>")
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(c, lambda x: F.floor(F.lit(float(factor)) * x).cast("long"))
    numbered = scratch.save(
        vectors.filter(F.coalesce((F.size("embedding") > 0) & ~bad, F.lit(False)))
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(F.expr(where), F.lit(False)).alias("asks"), whole.alias("x"))
        .withColumn("node", F.monotonically_increasing_id()),
        "numbered",
    )
    squares = F.aggregate("x", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    widest = F.greatest(F.array_max("x"), -F.array_min("x") - 1)
    about = numbered.agg(
        F.count("*").alias("n"), F.min(F.size("x")).alias("d"), F.max(F.size("x")).alias("d1"), F.max(squares).alias("top"),
        F.max(widest).alias("widest"),
    ).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not about.n:
        return spark.createDataFrame([], schema)
    if about.d != about.d1:
        raise ValueError(f"vectors of {about.d} and of {about.d1} components")
    if about.top >= 2.0**62:
        raise ArithmeticError("products pass 64 bits")
    kind = next(t for t in _KINDS if about.widest <= np.iinfo(t).max)
    metric = Metric(about.d, max(int(about.top), 1), kind)
    points = numbered.mapInArrow(partial(_encode, kind=kind), "node long, vec_id long, asks boolean, x binary")
    limit = min(max(about.n // 64, SHELF[0]), SHELF[1])
    dealt, shelves = build_tree(spark, scratch, points, metric, limit)
    n_shelves = shelves.count()
    queries = scratch.save(
        dealt.filter("asks").select(F.col("node").alias("asker"), F.col("vec_id").alias("query_id"), F.col("shelf").alias("own"), "x"), "queries"
    )
    n_queries = queries.count()
    shares = max(1, -(-n_queries // SHARE))
    share = F.pmod(F.xxhash64("asker"), F.lit(shares)).alias("share")
    pages = shelves.drop("routing", "reach").withColumn("share", _every(shares))
    chunks = -(-n_shelves // CHUNK)
    directory = scratch.save(
        shelves.select(F.pmod(F.xxhash64("shelf"), F.lit(chunks)).alias("chunk"), "shelf", "routing", "reach").groupBy("chunk")
        .applyInArrow(_directory, "chunk long, shelves binary, routing binary, reach binary"),
        "directory",
    )
    ranked = Window.partitionBy("asker").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "node")

    def asked(asks: DataFrame) -> DataFrame:
        return past_heads(pages, asks.withColumn("share", share), ["shelf", "share"], "rows").mapInArrow(
            partial(_ask, metric=metric, k=k), "asker long, vec_id long, node long, score long"
        )

    def merged(found: DataFrame, name: str) -> DataFrame:
        best = found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
        return scratch.save(best, name)

    none = F.lit(_NONE).cast("long")
    top = merged(asked(queries.select("asker", "x", F.col("own").alias("shelf"), none.alias("least"))), "top-0")
    seen, step, more = 0, 0, 1
    while seen < n_shelves - 1:
        step += 1
        least = top.filter(F.col("rank") == k).select("asker", F.col("score").alias("least"))
        now = queries.join(least, "asker", "left").withColumn("least", F.coalesce("least", none))
        # A chunk names at most as many shelves as the round can take, so their number is bounded by rounds.
        named = past_heads(
            directory.withColumn("share", _every(shares)),
            now.select("asker", "x", "own", "least", share).withColumn("chunk", _every(chunks)), ["chunk", "share"], "routing",
        ).mapInArrow(partial(_bounds, metric=metric, last=seen + more), "asker long, shelf long, bound double")
        order = Window.partitionBy("asker").orderBy("bound", "shelf")
        turn = named.withColumn("turn", F.row_number().over(order)).filter((F.col("turn") > seen) & (F.col("turn") <= seen + more))
        asks = scratch.save(turn.select("asker", "shelf"), f"asks-{step}")
        seen, more = seen + more, 4 * more
        if not asks.limit(1).count():
            break
        top = merged(
            asked(asks.join(now.select("asker", "x", "least"), "asker")).unionByName(top.drop("rank")), f"top-{step}"
        )
    return top.join(queries.select("asker", "query_id"), "asker").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
