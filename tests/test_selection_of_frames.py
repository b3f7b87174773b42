"""Farthest points and coverage against their definitions."""
import math
import random

import pytest

from framelark.errors import InsufficientDataError
from framelark.operators import quality


def by_definition(rows, n):
    """Names in the order picked, of (name, columns) scaled to their ranges."""
    ends = [(min(c), max(c)) for c in zip(*[at for _, at in rows], strict=True)]
    scaled = sorted((name, tuple((x - a) / (z - a if z > a else 1.0) for x, (a, z) in zip(at, ends, strict=True))) for name, at in rows)
    chosen = [scaled[0]]
    while len(chosen) < n:
        rest = [r for r in scaled if r not in chosen]
        chosen.append(min(rest, key=lambda r: (-min(quality.apart(r[1], c[1]) for c in chosen), r[0])))
    return [name for name, _ in chosen]


def clouds():
    rng = random.Random(3)
    spread = [(f"s{k:04d}", (rng.random(), rng.random())) for k in range(300)]
    lumps = [(f"l{k:04d}", (round(rng.gauss(k % 3, 0.01), 3), round(rng.gauss(0, 0.02), 3))) for k in range(400)]
    lattice = [(f"g{k:04d}", (float(k % 12), float(k // 12))) for k in range(144)]  # ties everywhere
    return {"spread": spread, "lumps": lumps, "lattice": lattice, "same": [(f"x{k}", (1.0, 1.0)) for k in range(9)] + [("a", (2.0, 1.0))]}


@pytest.mark.parametrize(("kind", "cells", "reported"), [("spread", 8, 64), ("lumps", 8, 64), ("lattice", 8, 64), ("same", 8, 64), ("lumps", 3, 2), ("lattice", 1, 4)])
def test_picks(spark, monkeypatch, kind, cells, reported):
    monkeypatch.setattr(quality, "REPORTED", reported)
    rows = clouds()[kind]
    df = spark.createDataFrame([(name, *at) for name, at in rows], "name string, a double, b double").repartition(3)
    n = min(15, len(rows))
    got = [r.name for r in quality.farthest_point(df, n, "name", ("a", "b"), cells).orderBy("pick").collect()]
    assert got == by_definition(rows, n)


def test_picks_by_recording(spark, monkeypatch):
    monkeypatch.setattr(quality, "WRITTEN", 2)
    every = clouds()
    rows = [(kind, name, *at) for kind, own in every.items() for name, at in own]
    df = spark.createDataFrame(rows, "dataset string, name string, a double, b double").repartition(3)
    got = {}
    for r in quality.farthest_points(df, ["dataset"], 5, "name", ("a", "b")).orderBy("pick").collect():
        got.setdefault(r.dataset, []).append(r.name)
    assert got == {kind: by_definition(own, 5) for kind, own in every.items()}
    with pytest.raises(InsufficientDataError, match="same"):
        quality.farthest_points(df, ["dataset"], 11, "name", ("a", "b"))


def test_few_scans(spark, monkeypatch):
    scans = []
    whole = quality.farthest_of_cells
    monkeypatch.setattr(quality, "farthest_of_cells", lambda rows, cells, *rest: scans.append(len(cells)) or whole(rows, cells, *rest))
    rng = random.Random(4)
    df = spark.createDataFrame([(k, rng.random(), rng.random(), rng.random()) for k in range(20_000)], "name long, a double, b double, c double")
    quality.farthest_point(df, 45, "name", ("a", "b", "c"))
    assert len(scans) < 15
    assert sum(scans) < 2 * 512  # cells scanned for all picks, of 512


def test_too_few_frames(spark):
    df = spark.createDataFrame([(f"{k:03d}", float(k), None if k else 1.0) for k in range(60)], "name string, a double, b double")
    with pytest.raises(InsufficientDataError):
        quality.farthest_point(df, 61, "name", ("a",))
    with pytest.raises(InsufficientDataError):
        quality.farthest_point(df, 5, "name", ("a", "b"))


@pytest.mark.parametrize("radius", [0, 1, 8])
def test_coverage(spark, radius):
    rng = random.Random(7)
    width, height = 90, 60
    corners = [("ab"[k % 2], rng.uniform(-5, width + 5), rng.uniform(-5, height + 5)) for k in range(60)] + [("c", 0.0, 0.0), ("c", 89.9, 59.9), ("d", -1.0, 5.0), ("a", 3.2, 3.9)] * 2
    want = {}
    for camera, x, y in corners:
        i, j = math.trunc(x), math.trunc(y)
        if 0 <= i < width and 0 <= j < height:
            disc = {(i + u, j + v) for u in range(-radius, radius + 1) for v in range(-radius, radius + 1) if u * u + v * v <= radius * radius}
            want.setdefault(camera, set()).update(p for p in disc if 0 <= p[0] < width and 0 <= p[1] < height)
    got = quality.coverage(spark.createDataFrame(corners, "camera string, x double, y double"), ["camera"], width, height, radius)
    assert {r.camera: r.n_pixels for r in got.collect()} == {k: len(v) for k, v in want.items()}
