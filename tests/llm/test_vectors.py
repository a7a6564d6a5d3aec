"""The vector operators against brute force, with planted copies and odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from ledgerline.llm import collision_ann, rabitq_dedup

from . import brute

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 24))
    near = base[:60] + 0.08 * rng.standard_normal((60, 24))
    hot = base[0] + 0.05 * rng.standard_normal((40, 24))
    return np.concatenate([base, near, hot, np.repeat(base[5:6], 30, 0)]).astype(np.float32)


@pytest.fixture(scope="module")
def table(spark, vectors):
    rows = [(k, [float(x) for x in v], 0) for k, v in enumerate(vectors)]
    odd = [(9000, None, 0), (9001, [], 0), (9002, [0.0] * 24, 0), (9003, [None] + [1.0] * 23, 0),
           (9004, [float("nan")] * 24, 0), (9005, [float("inf")] * 24, 0), (9006, [1.0, 2.0], 0)]
    return spark.createDataFrame(rows + odd, SCHEMA).withColumnsRenamed({"label": "links"}).repartition(4)


def test_links_match_all_pairs(spark, table, vectors, monkeypatch):
    unit = vectors.astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    root = brute.roots(len(vectors), list(zip(*np.nonzero(linked))))
    first = {r: min(k for k in range(len(root)) if root[k] == r) for r in set(root)}
    for tile in (1024, 16):
        monkeypatch.setattr(rabitq_dedup, "TILE", tile)
        got = {r.vec_id: r for r in rabitq_dedup.link_vectors(spark, table).collect()}
        assert len(got) == len(vectors) + 7
        for k in range(len(vectors)):
            assert (got[k].n_links, got[k].component_id, got[k].kept) == (linked[k].sum(), first[root[k]], first[root[k]] == k)
        assert all(got[9000 + k].n_links == 0 and got[9000 + k].kept for k in range(7))
    assert rabitq_dedup.link_vectors(spark, table.filter("vec_id < 0")).count() == 0


def test_neighbours_reach_the_recall(spark, table, vectors):
    exact = vectors.astype(float)
    got = collision_ann.nearest(spark, table, table.filter("vec_id % 10 = 0"), k=10).collect()
    hit = total = 0
    for q in range(0, len(vectors), 10):
        dist = np.sqrt(((exact - exact[q]) ** 2).sum(axis=1))
        dist[q] = np.inf
        want = np.lexsort((np.arange(len(dist)), dist))[:10]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        assert all(r.score == pytest.approx(dist[r.vec_id], abs=1e-12) for r in mine)
        hit += len({r.vec_id for r in mine} & set(want.tolist()))
        total += 10
    assert hit / total >= 0.9
    assert not [r for r in got if r.query_id >= 9000]
    few = collision_ann.nearest(spark, table.filter("vec_id < 4"), table.filter("vec_id = 0"), k=10).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3]
    assert collision_ann.nearest(spark, table.filter("vec_id < 0"), table, k=3).count() == 0


def test_repeated_query_ids_are_searched_by_row(spark):
    rng = np.random.default_rng(9)
    data = rng.standard_normal((60, 6))
    rows = [(k % 50, [float(x) for x in v]) for k, v in enumerate(data)]  # ids 0-9 stand twice
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collision_ann.nearest(spark, table, "vec_id % 5 = 0", k=4).collect()
    want = []
    for q, (name, _) in enumerate(rows):
        if name % 5 == 0:
            near = sorted((np.sqrt(((data[q] - data[j]) ** 2).sum()), rows[j][0]) for j in range(60) if j != q)[:4]
            want += [(name, rank, v, round(float(d), 9)) for rank, (d, v) in enumerate(near, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == sorted(want)


def test_links_near_the_threshold_and_mixed_precision(spark):
    rng = np.random.default_rng(12)
    base = rng.standard_normal((120, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.standard_normal((120, 64))
    other -= (other * base).sum(axis=1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = np.linspace(0.93, 0.97, 120)[:, None]
    data = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * other, base[:10], base[:10] * 3])
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(data)]
    got = {r.vec_id: r for r in rabitq_dedup.link_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    sure = np.abs(unit @ unit.T - 0.95).min(axis=1) > 1e-12
    assert all(got[k].n_links == linked[k].sum() for k in range(len(rows)) if sure[k]) and 60 < linked.sum() / 2 < 150
