"""Calibration documents and what they are applied to: points, lens offsets, reprojection errors."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.columns import signed
from . import solvers

EXTRINSICS = "extrinsics"


def transform_points(points: DataFrame, calibration: DataFrame, keys: list[str], names: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """points (keys, x, y, z) moved from the depth camera to the colour camera, metres. One calibration row a recording."""
    e = calibration.select(*keys, F.col(f"{EXTRINSICS}.rotation_matrix_3x3").alias("_r"), F.col(f"{EXTRINSICS}.translation_metres").alias("_t"))
    there = points.join(e, keys) if keys else points.join(F.broadcast(e))  # without keys, one row
    moved = geometry.rigid([F.col(n) for n in names], geometry.matrix(F.col("_r")), [F.col("_t")[k] for k in range(3)])
    return there.select(*[c for c in points.columns if c not in names], *[m.alias(n) for m, n in zip(moved, names, strict=True)])


def unit_views(metres: Column) -> Column:
    """Centimetres, as an offset with named parts."""
    return F.struct(*[(metres[k] * 100.0).alias(f"{n}_cm") for k, n in enumerate("XYZ")])


def lens_offset(calibration: DataFrame) -> DataFrame:
    """The lines to type in, of each calibration: location in centimetres, rotation in degrees."""
    at = [F.concat(F.lit(f"Location {n} : "), signed(F.col(f"ue5_offset.{n}_cm")), F.lit(" cm")) for n in "XYZ"]
    turn = [F.concat(F.lit(f"{n} : "), signed(F.col(f"{EXTRINSICS}.rotation_degrees")[k]), F.lit("°")) for k, n in enumerate(("Roll  (X)", "Pitch (Y)", "Yaw   (Z)"))]
    return calibration.select("meta.dataset", F.posexplode(F.array(*at, *turn)).alias("line_no", "line"))


def calibration_document(solved: DataFrame, cameras: dict[str, DataFrame], pairs: DataFrame, dataset: str = "dataset", frame: str = "frame") -> DataFrame:
    """The nested document of each recording from stereo_calibrate's and, by name, calibrate's rows."""
    used = pairs.groupBy(dataset).agg(F.countDistinct(frame).cast("int").alias("_n"))
    out = solved.join(used, dataset)
    for name, df in cameras.items():
        out = out.join(df.select(dataset, F.struct("camera_matrix", "distortion_coeffs").alias(name)), dataset)
    extrinsics = F.struct(*[c for c in solved.columns if c != dataset])
    meta = F.struct(F.col(dataset).alias("dataset"), F.col("_n").alias("valid_pairs_used"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))
    return out.select(meta.alias("meta"), *cameras, extrinsics.alias(EXTRINSICS), unit_views(F.col("translation_metres")).alias("ue5_offset"))


def reprojection_errors(pairs: DataFrame, keys: list[str], first: tuple | str, second: tuple | str, r: np.ndarray | str, t: np.ndarray | str, frame: str = "frame", least: int = 4) -> DataFrame:
    """(keys, frame, corner_id, error): the board's pose from the first camera's corners, its corners moved to the second
    camera, projected, and held against what that saw. pairs: (keys, frame, corner_id, xa, ya, xb, yb, bx, by, bz). Cameras,
    rotation and shift are given for all recordings, or as names: of solvers.with_camera, and of columns."""

    def one(df: pd.DataFrame) -> pd.DataFrame:
        if len(df) < least:
            return pd.DataFrame(columns=[*keys, frame, "corner_id", "error"])
        turn, shift = (np.stack(df[x].iloc[0]).astype(float) if isinstance(x, str) else np.asarray(x, float) for x in (r, t))
        p = df[["bx", "by", "bz"]].to_numpy(float)
        v, at, _ = solvers.board_pose(p, df[["xa", "ya"]].to_numpy(float), *solvers.camera_in(df, first))
        there = p @ solvers.rotation(v).T + at
        off = solvers.projected(there, turn, shift, *solvers.camera_in(df, second)) - df[["xb", "yb"]].to_numpy(float)
        return df[[*keys, frame, "corner_id"]].assign(error=np.sqrt((off * off).sum(1)))

    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in (*keys, frame, "corner_id"))
    return pairs.groupBy(*keys, frame).applyInPandas(one, f"{kinds}, error double")


def camera_of(row, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(K, d) of a calibration document's row."""
    c = row[name]
    return np.array(c["camera_matrix"], float), np.array(c["distortion_coeffs"], float).ravel()


def summary(detections: DataFrame, dataset: str = "dataset") -> DataFrame:
    """{"sony": [...], "zed": [...]} of (dataset, camera, file, status, n_markers, n_corners), files in order."""
    item = F.struct("file", "status", "n_markers", "n_corners")
    lists = [F.array_sort(F.collect_list(F.when(F.col("camera") == c, item))).alias(c) for c in ("sony", "zed")]
    return detections.groupBy(dataset).agg(*lists)
