"""Column expressions: numbers, names, vectors."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(c: Column) -> Column:
    """The nearest whole number, halves to the even one."""
    return F.rint(c).cast("long")


def lost(c: Column) -> Column:
    """NaN and null both say that a joint was not seen."""
    return c.isNull() | F.isnan(c)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def frame_name(c: Column) -> Column:
    """At least five digits; longer numbers keep all of theirs."""
    return F.format_string("%05d.png", c)


def raw_frame_name(camera: Column, idx: Column) -> Column:
    return F.format_string("%s_rgb_%05d.png", camera, idx)


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def stem(c: Column) -> Column:
    return F.split_part(basename(c), F.lit("."), F.lit(1))


def is_image(c: Column) -> Column:
    return F.lower(c).rlike(r"\.(png|jpg|jpeg)$")


def title(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def signed(c: Column, digits: int = 3) -> Column:
    return F.format_string(f"%+.{digits}f", c)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, 1.0 - dot(a, b) / n)


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def smoothing_factor(elapsed: Column, cutoff: Column) -> Column:
    """Weight of the new value in a first-order low-pass filter."""
    r = F.lit(2 * math.pi) * cutoff * elapsed
    return r / (r + 1.0)


def clean_depth(depth: Column) -> Column:
    """Depths as whole millimetres in 0..65535: lost ones 0, fractions cut, the rest clamped."""
    return F.transform(depth, lambda v: F.when(lost(v), F.lit(0)).otherwise(F.least(F.greatest(v, F.lit(0.0)), F.lit(65535.0)).cast("int")))


def bgra_to_rgb(pixel: Column) -> Column:
    return F.reverse(F.slice(pixel, 1, 3))


def output_curve(x: Column, dead: float, full: float, kind: str = "sigmoid", steep: float = 6.0) -> Column:
    """0 up to the dead zone, 1 from `full` on; between them linear, sigmoid (scaled to reach both ends) or piecewise
    (the first half of the way gives a quarter)."""
    u = F.least(F.greatest((x - dead) / (full - dead), F.lit(0.0)), F.lit(1.0))
    if kind == "linear":
        return u
    if kind == "piecewise":
        return F.when(u < 0.5, u * 0.5).otherwise(0.25 + (u - 0.5) * 1.5)
    low, high = 1 / (1 + math.exp(steep / 2)), 1 / (1 + math.exp(-steep / 2))
    return (1.0 / (1.0 + F.exp(-F.lit(steep) * (u - 0.5))) - low) / (high - low)
