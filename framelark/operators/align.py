"""Alignment of two feature series by dynamic time warping, and what follows from a frame mapping."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InsufficientDataError
from ..functions.columns import cosine_distance, euclidean_distance, frame_name
from ..sources.tables import positions
from .warping import banded_path, tiled_path


def cost_rows(a: DataFrame, b: DataFrame, keys: list[str], dist: str = "cosine", radius: int | None = None) -> DataFrame:
    """(keys, i, j, cost) of frames (keys, i, vec) and (keys, j, vec); with a radius only pairs near the diagonal.

    The wanted j of each i are listed and joined by equality, so no rows are made beyond the band.
    """
    sizes = a.groupBy(*keys).agg(F.max("i").alias("_m")).join(b.groupBy(*keys).agg(F.max("j").alias("_n")), keys)
    centre = F.round(F.col("i") * F.col("_n") / F.greatest(F.col("_m"), F.lit(1))).cast("long")
    low = F.lit(0).cast("long") if radius is None else F.greatest(centre - radius, F.lit(0))
    high = F.col("_n") if radius is None else F.least(centre + radius, F.col("_n"))
    wanted = a.withColumnRenamed("vec", "_a").join(sizes, keys).select(*keys, "i", "_a", F.explode(F.sequence(low, high)).alias("j"))
    measure = {"cosine": cosine_distance, "euclidean": euclidean_distance}[dist]
    return wanted.join(b.withColumnRenamed("vec", "_b"), [*keys, "j"]).select(*keys, "i", "j", measure(F.col("_a"), F.col("_b")).alias("cost"))


def align_series(a: DataFrame, b: DataFrame, keys: list[str], dist: str = "cosine", radius: int | None = None) -> DataFrame:
    """(keys, i, j, cost): the cheapest path of each recording's two series (keys, i, vec) and (keys, j, vec), tile by
    tile; with a radius, the cheapest of those near the diagonal."""
    return tiled_path(a, b, keys, dist) if radius is None else banded_path(a, b, keys, radius, dist)


def frame_mapping(path: DataFrame, keys: list[str]) -> DataFrame:
    """1-based (keys, sony_idx, zed_idx): of the frames paired with one, the last, which is the largest."""
    return path.groupBy(*keys, (F.col("i") + 1).alias("sony_idx")).agg((F.max("j") + 1).alias("zed_idx"))


def last_write(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """What a key holds after writes in order."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def compare_mappings(raw: DataFrame, smooth: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, sony_idx, zed_idx, zed_smooth, changed, line). A frame that `smooth` lacks makes the run fail."""
    return compared(raw.join(smooth.select(*keys, "sony_idx", "zed_smooth"), [*keys, "sony_idx"], "left"))


def compared(rows: DataFrame) -> DataFrame:
    """Rows (sony_idx, zed_idx, zed_smooth) with `changed` and `line`, where both mappings stand side by side."""
    there = F.when(F.col("zed_smooth").isNull(), F.raise_error(F.format_string("frame %d is not in the smoothed mapping", "sony_idx")).cast("long")).otherwise(F.col("zed_smooth"))
    plain = F.format_string("Sony Frame %05d -> ZED Frame %05d", "sony_idx", "zed_idx")
    changed = F.col("zed_idx") != F.col("zed_smooth")
    return rows.withColumn("zed_smooth", there).withColumn("changed", changed).withColumn("line", F.when(changed, F.concat(plain, F.format_string("-> Smoothed %05d", "zed_smooth"))).otherwise(plain))


def mismatches(compared: DataFrame) -> DataFrame:
    return compared.agg(F.count_if("changed").alias("n_changed"), F.count("*").alias("n_frames"))


def sync_manifest(mapping: DataFrame, sony: DataFrame, zed_rgb: DataFrame, zed_depth: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, sony_path, zed_rgb_path, zed_depth_path): listings (keys, path) by their sorted places; mapped places
    past a listing's end are left out."""
    place = lambda df, to, at: positions(df, keys, "path", at).select(*keys, at, F.col("path").alias(to))
    rows = mapping.join(place(sony, "sony_path", "sony_idx"), [*keys, "sony_idx"]).join(place(zed_rgb, "zed_rgb_path", "zed_idx"), [*keys, "zed_idx"]).join(place(zed_depth, "zed_depth_path", "zed_idx"), [*keys, "zed_idx"])
    return rows.select(*keys, frame_name(F.col("sony_idx")).alias("name"), "sony_path", "zed_rgb_path", "zed_depth_path")


def zip_pairs(a: DataFrame, b: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """Names paired by place, as far as the shorter listing goes."""
    left = positions(a, keys, name).select(*keys, "position", F.col(name).alias("first"))
    return left.join(positions(b, keys, name).select(*keys, "position", F.col(name).alias("second")), [*keys, "position"])


def need_features(features: DataFrame) -> DataFrame:
    if features.isEmpty():
        raise InsufficientDataError("no features")
    return features
