"""The metric tree against all products, whitening against numpy's eigenvectors, with ties, copies and odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from ledgerline.llm import metric_tree, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    base = rng.standard_normal((700, 12)) * rng.uniform(0.2, 2, 12) / 4
    return np.concatenate([base, base[:80] + 0.01 * rng.standard_normal((80, 12)), np.repeat(base[3:4], 150, 0), np.zeros((4, 12))]).astype(np.float32)


@pytest.fixture(scope="module")
def table(spark, vectors):
    rows = [(k if k % 97 else None, [float(x) for x in v], 0) for k, v in enumerate(vectors)] + [(40, [0.5] * 12, 1), (41, [-0.5] * 12, 1)]
    odd = [(9000, None, 0), (9020, [], 0), (9040, [None] + [1.0] * 11, 0), (9060, [float("nan")] * 12, 0), (9080, [float("-inf")] * 12, 0)]
    names = ["node", "x", "shelf", "score", "asks", "n", "component", "whitened", "part"]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(4)
    for name in names:
        df = df.withColumn(name, df["label"])
    return df


def products(rows, k, factor=64):
    """Every list of the brute search, sorted: (query_id, [(score, vec_id) ...])."""
    x = np.array([np.floor(factor * np.array(r[1], np.float64)) for r in rows]).astype(np.int64)
    scores = x @ x.T
    out = []
    for q, (name, _) in enumerate(rows):
        if name is None or name % 20:
            continue
        others = sorted((-int(scores[q, j]), r[0] is None, r[0] or 0) for j, r in enumerate(rows) if j != q)[:k]
        out.append((name, [(-s, None if null else v) for s, null, v in others]))
    return sorted(out, key=str)


def lists(df, k):
    got, seen = {}, {}
    for r in df.collect():
        got.setdefault((r.query_id, r["rank"]), []).append((r.score, r.vec_id))
    return got


@pytest.mark.parametrize("shelf", [(64, 128), (4096, 1 << 18)])
def test_products_are_exact(spark, table, monkeypatch, shelf):
    monkeypatch.setattr(metric_tree, "SHELF", shelf)
    monkeypatch.setattr(metric_tree, "SHARE", 100)
    monkeypatch.setattr(metric_tree, "CHUNK", 5)
    rows = [(r.vec_id, r.embedding) for r in table.filter("vec_id < 9000 or vec_id is null").collect()]
    got = metric_tree.top_products(spark, table, "vec_id % 20 = 0")
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    found = lists(got, 20)
    want: dict = {}
    for name, best in products(rows, 20):
        for rank, pair in enumerate(best, 1):
            want.setdefault((name, rank), []).append(pair)
    assert {k: sorted(v, key=str) for k, v in found.items()} == {k: sorted(v, key=str) for k, v in want.items()}


def test_few_rows_and_none(spark, table):
    few = table.filter("vec_id in (20, 21, 22)")
    assert sorted(r["rank"] for r in metric_tree.top_products(spark, few, "vec_id % 20 = 0").collect()) == [1, 2]
    assert metric_tree.top_products(spark, table.filter("vec_id = 9000"), "vec_id % 20 = 0").count() == 0
    assert metric_tree.top_products(spark, table.filter("vec_id = 21"), "vec_id % 20 = 0").count() == 0
    with pytest.raises(ValueError):
        metric_tree.top_products(spark, spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>"), "true")
    with pytest.raises(ArithmeticError):
        metric_tree.top_products(spark, spark.createDataFrame([(0, [1e30])], "vec_id long, embedding array<float>"), "true")


def test_large_numbers_stay_exact(spark):
    rows = [(k, [float(3 * 10**5 + k), float(-(10**4) * k), 5.0]) for k in range(1, 300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = lists(metric_tree.top_products(spark, df, "vec_id % 20 = 0", factor=64), 20)
    want = {(name, rank): [pair] for name, best in products(rows, 20) for rank, pair in enumerate(best, 1)}
    assert found == want


def test_bounds_avoid_products():
    rng = np.random.default_rng(3)
    centres = rng.integers(-60, 60, (40, 8))
    x = (np.repeat(centres, 100, 0) + rng.integers(-2, 3, (4000, 8))).astype(np.int64)
    metric = metric_tree.Metric(8, int((x * x).sum(axis=1).max()), "i8")
    pages = metric_tree.build_pages(metric, metric.rows(x), metric_tree.mix(np.arange(4000, dtype=np.uint64)))
    order = pages.pop("order")
    rows = metric.rows(x)
    for k in range(len(pages["parent"])):  # covering radii and stored distances hold
        under = order[pages["begin"][k] : pages["end"][k]]
        away = metric.between(rows[under], rows[pages["router"][k]][None])[:, 0]
        assert away.max() <= pages["radius"][k] + metric.slack
        if pages["leaf"][k]:
            assert np.allclose(away, pages["far"][pages["begin"][k] : pages["end"][k]], atol=metric.slack) and len(under) <= metric_tree.PAGE
    place = np.empty(4000, np.int64)
    place[order] = np.arange(4000)
    pages["router"] = place[pages["router"]].astype("<i4")
    row = {c: pages[c].tobytes() for c in pages} | {
        "nodes": order.astype("<i8").tobytes(), "ids": order.astype("<i8").tobytes(), "known": np.ones(4000, "<i1").tobytes(), "rows": x[order].tobytes(),
    }
    shelf = metric_tree.Shelf(metric, row)
    asks = np.arange(0, 4000, 50)
    who, at, product = shelf.search(asks, rows[asks], np.full(len(asks), metric_tree._NONE), 20)
    scores = x[asks] @ x.T
    scores[np.arange(len(asks)), asks] = -(2**62)
    for q in range(len(asks)):
        want = np.lexsort((np.arange(4000), -scores[q]))[:20]
        assert shelf.ids[at[who == q]].tolist() == want.tolist()
    assert shelf.computed < 0.35 * len(asks) * 4000


def test_inertia_counts_signs():
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 17, 40):
        m = rng.standard_normal((d, d))
        m = m + m.T
        e = np.linalg.eigvalsh(m)
        assert whitening.inertia(m) == ((e < 0).sum(), 0, (e > 0).sum())
    assert whitening.inertia(np.zeros((3, 3))) == (0, 3, 0)
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]])) == (1, 0, 1)


@pytest.mark.parametrize("values", [
    [9, 7, 5, 3, 2, 1.5, 1.2, 1.1, 1, 0.5], [5, 5, 5, 1, 1, 1, 1, 1, 1, 1], [4, 4 - 1e-9, 2, 0, 0, 0], [3, 3 - 1e-12, 1], [1] * 12,
    list(2.0 ** -np.arange(30)),
])
def test_slices_find_eigenpairs(values):
    values = np.array(values, float)
    q = np.linalg.qr(np.random.default_rng(6).standard_normal((len(values), len(values))))[0]
    v = (q * values) @ q.T
    e, axes = whitening.leading_eigenpairs((v + v.T) / 2, 8)
    want = values[values > 1e-12][:8]
    assert len(e) == len(want) and np.allclose(e, want, atol=1e-12 * values.sum())
    assert np.allclose(axes.T @ axes, np.eye(len(e)), atol=1e-5) and np.abs(v @ axes - axes * e).max() < 1e-12 * values.sum()


def whitened(rows):
    x = np.floor(1024 * np.array([r[1] for r in rows], np.float64)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    dev = n * x - total
    v = (dev / n).T @ (dev / n) / n
    e, axes = np.linalg.eigh(v)
    return x, n, (dev.astype(object) ** 2).sum(axis=1), dev / n, e[::-1], axes[:, ::-1]


def test_whitening_matches_numpy(spark, table):
    rows = [(r.vec_id, r.embedding) for r in table.filter("(vec_id < 9000 or vec_id is null)").collect()]
    _, n, deviation, centred, e, axes = whitened(rows)
    got = whitening.whiten(spark, table)
    out = got.collect()
    assert len(out) == 8 * len(rows) and {r.n for r in out} == {n} and len({r.identity_error for r in out}) == 1
    assert out[0].identity_error < 1e-9
    for k in range(8):
        mine = sorted(((r.vec_id is None, r.vec_id or 0, int(r.deviation), r.whitened) for r in out if r.component == k + 1))
        w = centred @ axes[:, k] / np.sqrt(e[k])
        want = sorted((r[0] is None, r[0] or 0, int(d), float(x)) for r, d, x in zip(rows, deviation, w))
        assert [m[:3] for m in mine] == [m[:3] for m in want]
        a, b = np.array([m[3] for m in mine]), np.array([m[3] for m in want])
        # Rows equal in all but the vector's sign are sorted by the projection, so compare up to sign as sorted sets.
        assert np.allclose(np.sort(a), np.sort(b), atol=1e-7) or np.allclose(np.sort(a), np.sort(-b), atol=1e-7)
        share, = {r.explained for r in out if r.component == k + 1}
        assert share == pytest.approx(e[k] / e.sum(), rel=1e-9)


def test_whitening_in_many_tasks_and_of_few_rows(spark, table, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    wide = table.repartition(11)
    assert whitening.whiten(spark, wide).first().identity_error < 1e-9
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark, table.filter("vec_id >= 9000")).count() == 0
    assert whitening.whiten(spark, spark.createDataFrame([(1, [1.0, 2.0])], schema)).count() == 0
    assert whitening.whiten(spark, spark.createDataFrame([(1, [1.0, 2.0])] * 5, schema)).count() == 0
    two = whitening.whiten(spark, spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], schema)).collect()
    assert [r.component for r in two] == [1, 1] and sorted(abs(r.whitened) for r in two) == [pytest.approx(1.0)] * 2
    with pytest.raises(ValueError):
        whitening.whiten(spark, spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], schema))
