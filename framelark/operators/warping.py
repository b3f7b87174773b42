"""Dynamic time warping: one tile of a cost matrix, whole matrices as tiles in many tasks, and the multi-resolution form.

`warp` and `tiled_path` are exact and agree at every size of a tile. `fast_warp` follows Salvador and Chan (2007): the
series are halved until they are short, and a path is refined level by level within a band around the coarser one, so
that time and memory grow with the sum of the lengths. Of equally cheap ways into a cell a step in the first series goes
before one in the second, and that before one in both.

Defined cases: series are at least one frame long (a recording that one side lacks gives no path); zero vectors have no
cosine distance, and a path through one costs NaN.
"""
from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import new_folder

#: Frames of either series in a tile; cells of a band whose costs are made at once.
TILE, CELLS = 1024, 1 << 16


def costs(a: np.ndarray, b: np.ndarray, dist: str = "cosine") -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """cost(i, j) of frames by their places; a pair's cost does not depend on what else is asked for."""
    if dist == "euclidean":
        return lambda i, j: np.sqrt(((a[i] - b[j]) ** 2).sum(1))
    if dist != "cosine":
        raise ValueError(f"no distance {dist!r}")
    size_a, size_b = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    return lambda i, j: 1.0 - (a[i] * b[j]).sum(1) / (size_a[i] * size_b[j])


def tile(a: np.ndarray, b: np.ndarray, above: np.ndarray, left: np.ndarray, corner: float, dist: str = "cosine") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(last row, last column, steps) of accumulated costs, from those in the row above, in the column to the left and
    in the corner between. A step is 0 from above, 1 from the left, 2 from the corner. Anti-diagonals are made at once."""
    n, m, cost = len(a), len(b), costs(a, b, dist)
    step, bottom, right = np.empty((n, m), np.int8), np.empty(m), np.empty(n)
    before, last = np.full(n + 2, np.inf), np.full(n + 2, np.inf)  # by i + 1, of the two diagonals in front, borders included
    before[0], last[0], last[1] = corner, above[0], left[0]
    for d in range(n + m - 1):
        i = np.arange(max(0, d - m + 1), min(n, d + 1))
        ways = np.stack([last[i], last[i + 1], before[i]])
        best = ways.argmin(0)
        now = np.full(n + 2, np.inf)
        now[i + 1] = ways[best, np.arange(len(i))] + cost(i, d - i)
        step[i, d - i] = best
        if d + 1 < m:
            now[0] = above[d + 1]
        if d + 1 < n:
            now[d + 2] = left[d + 1]
        if d >= n - 1:
            bottom[d - n + 1] = now[n]
        if d >= m - 1:
            right[d - m + 1] = now[d - m + 2]
        before, last = last, now
    return bottom, right, step


def way_back(step: np.ndarray, i: int, j: int) -> tuple[list[int], list[int], int, int]:
    """The path's cells of a tile from (i, j) back, and the first cell outside (-1 in the tile above or to the left)."""
    rows, columns = [], []
    while i >= 0 and j >= 0:
        rows.append(i)
        columns.append(j)
        k = step[i, j]
        i, j = i - (k != 1), j - (k != 0)
    return rows, columns, i, j


def warp(a: np.ndarray, b: np.ndarray, dist: str = "cosine") -> tuple[float, list[tuple[int, int]]]:
    """(cost, path) of the cheapest monotone path through the whole matrix."""
    bottom, _, step = tile(a, b, np.full(len(b), np.inf), np.full(len(a), np.inf), 0.0, dist)
    i, j, *_ = way_back(step, len(a) - 1, len(b) - 1)
    return float(bottom[-1]), list(zip(i, j, strict=True))[::-1]


def band_warp(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, dist: str = "cosine") -> tuple[float, list[tuple[int, int]]]:
    """The cheapest path within a ragged band: row i has the columns low[i] .. high[i] - 1. Nothing is kept for cells
    outside; a step takes a byte."""
    cost, width = costs(a, b, dist), high - low
    ends = np.concatenate([[0], np.cumsum(width)])
    steps = bytearray(int(ends[-1]))
    above: list[float] = []
    first, at = 0, 0  # of the row above: its first column
    inf = float("inf")
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + CELLS, side="right")) - 1)  # rows whose costs are made at once
        rows = np.repeat(np.arange(at, to), width[at:to])
        columns = np.arange(len(rows)) - np.repeat(ends[at:to] - ends[at], width[at:to]) + low[rows]
        made, place = cost(rows, columns).tolist(), int(ends[at])
        for i in range(at, to):
            start, now, left = int(low[i]), [], inf
            for c, j in zip(itertools.islice(made, place - int(ends[at]), place - int(ends[at]) + int(width[i])), range(start, int(high[i])), strict=True):
                k = j - first
                up = above[k] if 0 <= k < len(above) else inf
                both = above[k - 1] if 0 < k <= len(above) else (0.0 if i == 0 and j == 0 else inf)
                best, s = (up, 0) if up <= left else (left, 1)
                if both < best:
                    best, s = both, 2
                left = best + c
                now.append(left)
                steps[place] = s
                place += 1
            above, first = now, start
        at = to
    i, j, path = len(a) - 1, len(b) - 1, []
    while i >= 0 and j >= 0:
        path.append((i, j))
        s = steps[int(ends[i]) + j - int(low[i])]
        i, j = i - (s != 1), j - (s != 0)
    return above[-1], path[::-1]


def halved(x: np.ndarray) -> np.ndarray:
    """Means of neighbouring frames; a last odd one is left out."""
    return (x[0 : len(x) - 1 : 2] + x[1 : len(x) : 2]) / 2


def finer_band(path: list[tuple[int, int]], n: int, m: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns of each of n rows that lie within `radius` coarse cells of a path of half the resolution."""
    i, j = np.array(path).T
    size = int(i[-1]) + 1
    least, most = np.full(size, m), np.zeros(size, np.int64)
    np.minimum.at(least, i, j)
    np.maximum.at(most, i, j)
    row = np.arange((n + 1) // 2)  # both grow along the path, so the outermost rows in reach hold the ends
    low = np.maximum(0, 2 * (least[np.clip(row - radius, 0, size - 1)] - radius))
    high = np.minimum(m, 2 * (most[np.clip(row + radius, 0, size - 1)] + radius + 1))
    return np.repeat(low, 2)[:n], np.repeat(high, 2)[:n]


def fast_warp(a: np.ndarray, b: np.ndarray, radius: int = 1, dist: str = "cosine") -> tuple[float, list[tuple[int, int]]]:
    """(cost, path), nearly the cheapest: exact for series shorter than radius + 2, refined from halves beyond."""
    if radius < 1:
        raise ValueError("the radius is at least 1")
    levels = [(np.asarray(a, float), np.asarray(b, float))]
    while min(map(len, levels[-1])) >= radius + 2:
        levels.append((halved(levels[-1][0]), halved(levels[-1][1])))
    x, y = levels.pop()
    cost, path = band_warp(x, y, np.zeros(len(x), np.int64), np.full(len(x), len(y)), dist)
    for x, y in reversed(levels):
        cost, path = band_warp(x, y, *finer_band(path, len(x), len(y), radius), dist)
    return cost, path


def chunks(frames: DataFrame, keys: list[str], place: str, at: str, size: int) -> DataFrame:
    """(keys, <at>, <at>_n, <at>_data): runs of `size` frames, as doubles of all vectors in a row."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.select(*keys).schema)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(place)
        data = np.stack(rows["vec"]).astype("<f8")
        return pd.DataFrame({**{k: rows[k].iloc[:1].to_numpy() for k in keys}, at: rows[at].iloc[:1].to_numpy(), f"{at}_n": [len(rows)], f"{at}_data": [data.tobytes()]})

    return frames.withColumn(at, F.floor(F.col(place) / size).cast("int")).groupBy(*keys, at).applyInPandas(one, f"{kinds}, {at} int, {at}_n int, {at}_data binary")


def tiled_path(a: DataFrame, b: DataFrame, keys: list[str], dist: str = "cosine", size: int = TILE) -> DataFrame:
    """(keys, i, j, cost): the cheapest path of each recording's frames (keys, i, vec) and (keys, j, vec), both numbered
    densely from 0.

    The matrix is cut into tiles. Those of an anti-diagonal are made side by side, for all recordings; a tile needs the
    frames of its sides and the borders of its neighbours, and only borders are kept. Then the path is read back: the tile
    of its end is made once more, gives its part of the path and the cell where the next tile goes on. So no task holds
    more than a tile, and jobs grow with the number of tiles along both sides. Every step is stored in the shared folder.
    """
    spark, folder = a.sparkSession, new_folder(a.sparkSession, "tiles")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in a.select(*keys).schema)
    for frames, place, name in ((a, "i", "ti"), (b, "j", "tj")):
        chunks(frames, keys, place, name, size).write.parquet(f"{folder}/{name}")
    rows, columns = spark.read.parquet(f"{folder}/ti"), spark.read.parquet(f"{folder}/tj")
    count = lambda df, at, to: df.groupBy(*keys).agg((F.max(at) + 1).alias(to))
    count(rows, "ti", "n_ti").join(count(columns, "tj", "n_tj"), keys).write.parquet(f"{folder}/sizes")
    sizes = spark.read.parquet(f"{folder}/sizes")
    last = sizes.agg(F.max(F.col("n_ti") + F.col("n_tj") - 2)).first()[0]
    if last is None:
        return spark.createDataFrame([], f"{kinds}, i long, j long, cost double")
    border = "above binary, left binary, corner double"

    def series(r, side: str) -> np.ndarray:
        return np.frombuffer(getattr(r, f"{side}_data"), "<f8").reshape(getattr(r, f"{side}_n"), -1)

    def sides(r) -> tuple:
        """Both series of a tile and its borders; outside the matrix they are infinite, but for the very corner."""
        x, y = series(r, "ti"), series(r, "tj")
        given = lambda v, n: np.full(n, np.inf) if v is None else np.frombuffer(v, "<f8")
        corner = r.corner if r.corner is not None and r.corner == r.corner else (0.0 if r.ti == 0 and r.tj == 0 else np.inf)
        return x, y, given(r.above, len(y)), given(r.left, len(x)), corner

    def forward(tiles: pd.DataFrame) -> pd.DataFrame:
        r = next(tiles.itertuples(index=False))
        x, y, above, left, corner = sides(r)
        bottom, right, _ = tile(x, y, above, left, corner, dist)
        out = tiles.iloc[:1][[*keys, "ti", "tj", "above", "left"]]
        return out.assign(corner=corner, bottom=bottom.astype("<f8").tobytes(), right=right.astype("<f8").tobytes(), below_left=float(left[-1]), cost=float(bottom[-1]))

    def back(tiles: pd.DataFrame) -> pd.DataFrame:
        r = next(tiles.itertuples(index=False))
        *given, corner = sides(r)
        step = tile(*given, corner, dist)[2]
        i, j, down, across = way_back(step, len(step) - 1 if r.from_i < 0 else r.from_i, step.shape[1] - 1 if r.from_j < 0 else r.from_j)
        out = tiles.iloc[:1][[*keys, "cost"]]
        # where the path left: -1 stands for the last place of the tile above or to the left
        return out.assign(ti=r.ti - (down < 0), tj=r.tj - (across < 0), from_i=down, from_j=across, rows=(np.array(i) + r.ti * size).astype("<i8").tobytes(), columns=(np.array(j) + r.tj * size).astype("<i8").tobytes())

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            for k in range(len(some)):
                r = some.iloc[k]
                i, j = np.frombuffer(r["rows"], "<i8"), np.frombuffer(r["columns"], "<i8")
                yield some.iloc[[k] * len(i)][[*keys, "cost"]].assign(i=i, j=j)

    none = lambda kind: F.lit(None).cast(kind)
    tiles = sizes.select(*keys, F.lit(0).alias("ti"), F.lit(0).alias("tj"), none("binary").alias("above"), none("binary").alias("left"), none("double").alias("corner"))
    one_tile = lambda df: df.join(rows, [*keys, "ti"]).join(columns, [*keys, "tj"]).groupBy(*keys, "ti", "tj")
    for d in range(last + 1):
        done = f"{folder}/forward/diagonal={d}"
        one_tile(tiles).applyInPandas(forward, f"{kinds}, ti int, tj int, {border}, bottom binary, right binary, below_left double, cost double").write.parquet(done)
        made = spark.read.parquet(done)
        down = made.select(*keys, (F.col("ti") + 1).alias("ti"), "tj", F.col("bottom").alias("above"), none("binary").alias("left"), F.col("below_left").alias("corner"))
        across = made.select(*keys, "ti", (F.col("tj") + 1).alias("tj"), none("binary").alias("above"), F.col("right").alias("left"), none("double").alias("corner"))
        met = down.unionByName(across).groupBy(*keys, "ti", "tj").agg(*[F.max(c).alias(c) for c in ("above", "left", "corner")])
        tiles = met.join(sizes, keys).where("ti < n_ti AND tj < n_tj").drop("n_ti", "n_tj")
    every = spark.read.schema(f"{kinds}, ti int, tj int, {border}, cost double, diagonal int").parquet(f"{folder}/forward")
    at = every.join(sizes, keys).where("ti = n_ti - 1 AND tj = n_tj - 1").select(*keys, "ti", "tj", F.lit(-1).alias("from_i"), F.lit(-1).alias("from_j"), "cost")
    for k in range(last + 1):  # at most as many tiles as there are diagonals lie on a path
        done = f"{folder}/back/step={k}"
        one_tile(at.join(every.select(*keys, "ti", "tj", "above", "left", "corner"), [*keys, "ti", "tj"])).applyInPandas(back, f"{kinds}, cost double, ti int, tj int, from_i int, from_j int, rows binary, columns binary").write.parquet(done)
        at = spark.read.parquet(done).where("ti >= 0 AND tj >= 0").drop("rows", "columns")
        if at.isEmpty():
            break
    parts = spark.read.schema(f"{kinds}, cost double, rows binary, columns binary, step int").parquet(f"{folder}/back")
    return parts.mapInPandas(unpacked, f"{kinds}, i long, j long, cost double")


def by_recording(a: DataFrame, b: DataFrame, keys: list[str], path: Callable[[np.ndarray, np.ndarray], tuple[float, list[tuple[int, int]]]]) -> DataFrame:
    """(keys, i, j, cost): path(first series, second series) of each recording, which is a task."""

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=[*keys, "i", "j", "cost"])
        left, right = left.sort_values("i"), right.sort_values("j")
        total, found = path(np.stack(left["vec"]).astype(float), np.stack(right["vec"]).astype(float))
        i, j = np.array(found).T
        return pd.DataFrame({**{k: left[k].iloc[0] for k in keys}, "i": left["i"].to_numpy()[i], "j": right["j"].to_numpy()[j], "cost": total})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in a.select(*keys).schema)
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(one, f"{schema}, i long, j long, cost double")


def fast_path(a: DataFrame, b: DataFrame, keys: list[str], radius: int = 1, dist: str = "cosine") -> DataFrame:
    """(keys, i, j, cost): the multi-resolution path of each recording. A recording is one task, whose memory grows with
    its frames, not with their pairs."""
    return by_recording(a, b, keys, lambda x, y: fast_warp(x, y, radius, dist))


def near_diagonal(n: int, m: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The band of the columns within `radius` of the diagonal, or so many that the rows meet."""
    centre, reach = np.arange(n) * max(m - 1, 1) / max(n - 1, 1), max(radius, m / n)
    return np.maximum(0, np.ceil(centre - reach)).astype(np.int64), np.minimum(m, np.floor(centre + reach) + 1).astype(np.int64)


def banded_path(a: DataFrame, b: DataFrame, keys: list[str], radius: int, dist: str = "cosine") -> DataFrame:
    """(keys, i, j, cost): the cheapest path within `radius` frames of the diagonal, memory as in fast_path."""
    return by_recording(a, b, keys, lambda x, y: band_warp(x, y, *near_diagonal(len(x), len(y), radius), dist))
