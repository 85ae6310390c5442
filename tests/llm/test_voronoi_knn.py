"""What the bounds of the Voronoi join leave out, and that nothing is lost by it."""

from __future__ import annotations

import numpy as np

from spendwarden.llm import voronoi_knn


def table_of(spark, x, ids=None):
    rows = [(int(i), [float(c) for c in v], 1, 2.0, 3.0, "x") for i, v in zip(range(len(x)) if ids is None else ids, x, strict=True)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, cell int, along double, off double, v string")


def brute(x, ids, every, k=5):
    v = np.floor(256 * np.asarray(x)).astype(np.int64)
    out = []
    for q in sorted({i for i in ids if i % every == 0}):
        mine = min(tuple(v[n]) for n in range(len(v)) if ids[n] == q)
        best = sorted((-int(np.dot(mine, v[n])), ids[n]) for n in range(len(v)) if ids[n] != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def found(df, **how):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in voronoi_knn.top_k(df, **how).collect())


def clustered(seed, clusters=24, each=60, dim=32, noise=0.02):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(clusters, dim))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    return np.repeat(centre, each, 0) + noise * rng.normal(size=(clusters * each, dim))


def test_far_clusters_are_not_sent(spark):
    x = clustered(1)
    df = table_of(spark, x)
    assert voronoi_knn.replication(df, every=7) < 4  # of 24 and more cells
    assert found(df, every=7) == brute(x, list(range(len(x))), 7)


def test_without_clusters_rows_are_sent_once_per_block(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 48))
    df = table_of(spark, x)
    join = voronoi_knn._Join(df, 3, 5, 64)
    assert join.replication() <= 1.01 and len(join.groups) == 1
    assert found(df, every=3) == brute(x, list(range(900)), 3)


def test_repeated_ids_and_rows(spark):
    x = np.concatenate([clustered(3, 6, 30, 8), np.repeat(clustered(4, 1, 1, 8), 20, 0), np.zeros((4, 8))])
    ids = [*range(180), *[10] * 12, *[400] * 8, 401, 402, 403, 404]
    for every in (2, 5, 10):
        assert found(table_of(spark, x, ids), every=every, pivots=7) == brute(x, ids, every)


def test_bounds_hold_for_every_query_and_band():
    rng = np.random.default_rng(5)
    pivots, x, q = rng.normal(size=(9, 6)) * 40, rng.normal(size=(400, 6)) * 40, rng.normal(size=(50, 6)) * 40
    cell = (x @ pivots.T - (pivots * pivots).sum(1) / 2).argmax(1)
    along, off = (m[np.arange(400), cell] for m in voronoi_knn._off(x, pivots))
    band = np.minimum((off / off.max() * voronoi_knn.BANDS).astype(int), voronoi_knn.BANDS - 1)
    bands = [(c, b, m.sum(), along[m].max(), along[m].min(), off[m].max()) for c in range(9) for b in range(voronoi_knn.BANDS) if (m := (cell == c) & (band == b)).any()]
    near = [(c, n, along[n], off[n]) for c in range(9) for n in sorted(np.flatnonzero(cell == c), key=lambda n: off[n] - along[n])[:6]]
    summary = voronoi_knn.Summary(pivots, bands, near)
    need = summary.needed(np.full(50, -1), q, 5)
    place = {(b[0], b[1]): i for i, b in enumerate(bands)}
    for i in range(50):
        for n in np.argsort(-(x @ q[i]))[:5]:
            assert need[i, place[cell[n], band[n]]]
    assert voronoi_knn.merged_groups({}, {}, np.zeros(0)) == []


def test_groups_merge_only_where_it_saves():
    need = {0: np.array([1, 1, 0, 0], bool), 1: np.array([1, 1, 0, 0], bool), 2: np.array([0, 0, 1, 1], bool)}
    rows = np.array([500, 500, 500, 500])
    groups = voronoi_knn.merged_groups(need, {0: 10, 1: 10, 2: 10}, rows)
    assert sorted(sorted(c) for c, _ in groups) == [[0, 1], [2]]
    assert len(voronoi_knn.merged_groups(need, {0: 600, 1: 600, 2: 1}, rows)) == 3  # too many queries for one block
