"""Warping: tiles against the whole matrix, the multi-resolution form against its definition."""
import numpy as np
import pytest

from framelark.operators import align, warping


def plain(a, b, dist="cosine", window=None):
    """(cost, path) by definition, over a set of open cells."""
    n, m, inf = len(a), len(b), float("inf")
    cost = warping.costs(a, b, dist)
    table = {(-1, -1): (0.0, None)}
    for i in range(n):
        for j in range(m):
            if window is None or (i, j) in window:
                ways = [(table.get(p, (inf,))[0], k) for k, p in enumerate(((i - 1, j), (i, j - 1), (i - 1, j - 1)))]
                best = min(ways, key=lambda w: w[0])
                table[i, j] = (best[0] + float(cost(np.array([i]), np.array([j]))[0]), best[1])
    path, i, j = [], n - 1, m - 1
    while i >= 0 and j >= 0:
        path.append((i, j))
        k = table[i, j][1]
        i, j = i - (k != 1), j - (k != 0)
    return table[n - 1, m - 1][0], path[::-1]


def multi_resolution(a, b, radius, dist):
    """Salvador and Chan's recursion with cells in sets."""
    if min(len(a), len(b)) < radius + 2:
        return plain(a, b, dist)
    half = lambda x: np.array([(x[2 * k] + x[2 * k + 1]) / 2 for k in range(len(x) // 2)])
    _, path = multi_resolution(half(a), half(b), radius, dist)
    reach = range(-radius, radius + 1)
    near = {(i + u, j + v) for i, j in path for u in reach for v in reach}
    return plain(a, b, dist, {(2 * i + u, 2 * j + v) for i, j in near for u in (0, 1) for v in (0, 1)})


def pair(rng, longest=40, dim=3):
    a, b = (np.cumsum(rng.normal(size=(rng.integers(1, longest), dim)), 0) for _ in range(2))
    return (a, b) if rng.random() < 0.8 else (np.round(a) + 0.5, np.round(b) + 0.5)  # whole steps: many ties


@pytest.mark.parametrize("dist", ["cosine", "euclidean"])
def test_whole_matrix(dist):
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = pair(rng)
        cost, path = warping.warp(a, b, dist)
        assert (pytest.approx(cost), path) == plain(a, b, dist)
        low, high = np.zeros(len(a), int), np.full(len(a), len(b))
        assert warping.band_warp(a, b, low, high, dist) == (cost, path)
        assert warping.band_warp(a, b, *warping.near_diagonal(len(a), len(b), 100), dist) == (cost, path)
    x = rng.normal(size=(12, 3))
    assert warping.warp(x, x)[1] == [(k, k) for k in range(12)]


def test_multi_resolution_by_definition():
    rng = np.random.default_rng(2)
    for k in range(200):
        a, b = pair(rng, 60)
        radius, dist = 1 + k % 3, ("cosine", "euclidean")[k % 2]
        assert warping.fast_warp(a, b, radius, dist) == multi_resolution(a, b, radius, dist)


def test_multi_resolution_of_long_series():
    """100,000 frames: a matrix would take 10 GB."""
    import tracemalloc

    t = np.linspace(0, 60, 100_000)
    a, b = (np.stack([np.cos(x), np.sin(x), np.cos(x / 7)], 1) for x in (t, t + 0.3 * np.sin(t / 5)))
    tracemalloc.start()
    _, path = warping.fast_warp(a, b)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    steps = np.diff(np.array(path), axis=0)
    assert path[0] == (0, 0) and path[-1] == (99_999, 99_999)
    assert steps.min() >= 0 and steps.max() == 1 and steps.sum(1).min() >= 1


def frames(spark, series, place):
    return spark.createDataFrame([(k, t, v.tolist()) for k, x in series.items() for t, v in enumerate(x)], f"dataset string, {place} long, vec array<double>")


def paths(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.dataset, r.cost), []).append((r.i, r.j))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("size", [8, 1000])
def test_tiles(spark, size):
    rng = np.random.default_rng(3)
    both = {f"d{k}": pair(rng, 24) for k in range(4)} | {"one": (rng.normal(size=(1, 3)), rng.normal(size=(9, 3))), "even": (np.round(rng.normal(size=(14, 3))) + 0.5,) * 2}
    a, b = ({k: v[side] for k, v in both.items()} for side in (0, 1))
    a["alone"] = np.ones((5, 3))  # the other side lacks it
    got = paths(warping.tiled_path(frames(spark, a, "i"), frames(spark, b, "j"), ["dataset"], size=size))
    want = {(k, (w := warping.warp(*v))[0]): w[1] for k, v in both.items()}
    assert got == want


def test_no_recordings(spark):
    none = {"x": np.zeros((0, 3))}
    assert align.align_series(frames(spark, none, "i"), frames(spark, none, "j"), ["dataset"]).count() == 0


def test_forms_over_recordings(spark):
    rng = np.random.default_rng(4)
    both = {f"d{k}": pair(rng, 30) for k in range(5)}
    a, b = (frames(spark, {k: v[side] for k, v in both.items()}, place) for side, place in ((0, "i"), (1, "j")))
    assert paths(warping.fast_path(a, b, ["dataset"], 2)) == {(k, (w := warping.fast_warp(*v, 2))[0]): w[1] for k, v in both.items()}
    near = {k: warping.band_warp(*v, *warping.near_diagonal(len(v[0]), len(v[1]), 3)) for k, v in both.items()}
    assert paths(align.align_series(a, b, ["dataset"], radius=3)) == {(k, w[0]): w[1] for k, w in near.items()}
