"""Rigid and pinhole geometry as column arithmetic. Matrices are 3x3 sequences of numbers or of columns."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Numbers = Sequence[float | Column]


def matrix(c: Column) -> list[list[Column]]:
    """A 3x3 array column as nine columns."""
    return [[c[i][j] for j in range(3)] for i in range(3)]


def rigid(point: Numbers, rotation: Sequence[Numbers], shift: Numbers) -> list[Column]:
    """R p + T."""
    return [point[0] * rotation[i][0] + point[1] * rotation[i][1] + point[2] * rotation[i][2] + shift[i] for i in range(3)]


def chained(point: Numbers, first: tuple, second: tuple) -> list[Column]:
    """Board to one camera, then on to the other."""
    return rigid(rigid(point, *first), *second)


def project(point: Numbers, k: Sequence[Numbers], d: Numbers) -> tuple[Column, Column]:
    """Pixels under a pinhole camera with radial (k1, k2, k3) and tangential (p1, p2) distortion, d = k1 k2 p1 p2 k3."""
    x, y = point[0] / point[2], point[1] / point[2]
    r2 = x * x + y * y
    radial = 1.0 + r2 * d[0] + r2 * r2 * d[1] + r2 * r2 * r2 * d[4]
    u = x * radial + x * y * 2.0 * d[2] + (r2 + x * x * 2.0) * d[3]
    v = y * radial + (r2 + y * y * 2.0) * d[2] + x * y * 2.0 * d[3]
    return u * k[0][0] + k[0][2], v * k[1][1] + k[1][2]


def distance(*pairs: tuple[Column, Column]) -> Column:
    return F.sqrt(sum(((a - b) * (a - b) for a, b in pairs[1:]), (pairs[0][0] - pairs[0][1]) * (pairs[0][0] - pairs[0][1])))


def rotation_of(vector: Numbers) -> list[list[Column]]:
    """The rotation matrix of a Rodrigues vector (axis times angle)."""
    x, y, z = (F.lit(v) if not isinstance(v, Column) else v for v in vector)
    angle = F.sqrt(x * x + y * y + z * z)
    n = F.when(angle > 0, angle).otherwise(1.0)
    a, b, c = x / n, y / n, z / n
    cos, sin = F.cos(angle), F.sin(angle)
    rest = 1.0 - cos
    return [
        [cos + a * a * rest, a * b * rest - c * sin, a * c * rest + b * sin],
        [b * a * rest + c * sin, cos + b * b * rest, b * c * rest - a * sin],
        [c * a * rest - b * sin, c * b * rest + a * sin, cos + c * c * rest],
    ]


def vector_of(r: Sequence[Numbers]) -> list[Column]:
    """The Rodrigues vector of a rotation by less than a half turn."""
    cos = F.least(F.greatest((r[0][0] + r[1][1] + r[2][2] - 1.0) / 2.0, F.lit(-1.0)), F.lit(1.0))
    angle = F.acos(cos)
    scale = F.when(F.sin(angle) > 1e-12, angle / (F.sin(angle) * 2.0)).otherwise(0.5)
    return [(r[2][1] - r[1][2]) * scale, (r[0][2] - r[2][0]) * scale, (r[1][0] - r[0][1]) * scale]
