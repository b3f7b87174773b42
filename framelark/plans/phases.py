"""The three phases from end to end, each one plan of composed operators over tables."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InsufficientDataError
from ..operators import align, calibration, movement, quality, report, series, solvers
from ..scratch import durable
from ..shipping import ship
from ..sources.tables import board, need


@dataclass
class Synced:
    raw: DataFrame
    smooth: DataFrame
    log: DataFrame
    manifest: DataFrame


def temporal(sony: DataFrame, zed: DataFrame, listings: tuple[DataFrame, DataFrame, DataFrame], window: int = 1501, dist: str = "cosine", radius: int | None = None) -> Synced:
    """Phase 1: features (dataset, frame_idx, vec) of both cameras and three listings (dataset, path) to a mapping of
    frames, repaired, with its log and the synced triples."""
    ship(sony.sparkSession)
    a, b = (align.need_features(f) for f in (sony, zed))
    path = align.align_series(a.select("dataset", F.col("frame_idx").alias("i"), "vec"), b.select("dataset", F.col("frame_idx").alias("j"), "vec"), ["dataset"], dist, radius)
    raw = align.frame_mapping(path, ["dataset"])
    smooth = series.smooth_mapping(raw, window, ("dataset",))
    log = align.compare_mappings(raw, smooth.select("dataset", "sony_idx", "zed_smooth"), ("dataset",))
    mapped = smooth.select("dataset", "sony_idx", F.col("zed_smooth").alias("zed_idx"))
    return Synced(raw, smooth, log, align.sync_manifest(mapped, *listings, ["dataset"]))


@dataclass
class Calibrated:
    picked: DataFrame
    document: DataFrame
    errors: DataFrame
    report: DataFrame


def spatial(sony: DataFrame, zed: DataFrame, count: int = 45, least: int = 45, min_pairs: int = 5, lag: int = 3, px: float = 1.5) -> Calibrated:
    """Phase 2 for any number of recordings: corners (dataset, frame long, corner_id, x, y, width, height) of both cameras to
    each recording's picked frames, calibration document and validation report. Raises if a recording has too few frames."""
    spark = ship(sony.sparkSession)
    keys = ["dataset", "frame"]
    ok = quality.enough_shared(quality.matched_corners(zed, sony, keys), keys, least).select(*keys)
    still = quality.motion_gate(ok, sony.select(*keys, "corner_id", "x", "y"), ["dataset"], lag=lag, px=px).where("still").select(*keys)
    features = quality.frame_features(sony.join(still, keys, "left_semi"), keys)
    picked = durable(quality.farthest_points(features, ["dataset"], count, "frame"))
    pairs = durable(quality.collect_pairs(zed, sony, keys, least).join(picked.select(*keys), keys, "left_semi").join(F.broadcast(board(spark)), "corner_id"))
    few = sony.select("dataset").distinct().join(pairs.groupBy("dataset").agg(F.countDistinct("frame").alias("n")), "dataset", "left").where(F.coalesce("n", F.lit(0)) < min_pairs).limit(1).collect()
    if few:
        raise InsufficientDataError(f"frame pairs: {few[0]['n'] or 0} of at least {min_pairs} in {few[0]['dataset']}")
    cameras = {n: durable(solvers.calibrate(pairs.withColumnsRenamed({x: "x", y: "y"}), ["dataset"])) for n, x, y in (("zed_camera", "xa", "ya"), ("sony_camera", "xb", "yb"))}
    seen = pairs
    for name, df in cameras.items():
        seen = solvers.with_camera(seen, ["dataset"], df, name)
    solved = durable(solvers.stereo_calibrate(seen, ["dataset"], "zed_camera", "sony_camera"))
    document = calibration.calibration_document(solved, cameras, pairs)
    placed = seen.join(solved.select("dataset", "rotation_matrix_3x3", "translation_metres"), "dataset")
    errors = calibration.reprojection_errors(placed, ["dataset"], "zed_camera", "sony_camera", "rotation_matrix_3x3", "translation_metres")
    return Calibrated(picked, document, errors, report.validation_report(errors))


def errors_of(sony: DataFrame, zed: DataFrame, documents: DataFrame, least: int = 45) -> DataFrame:
    """(dataset, frame, corner_id, error) of corners as in spatial(), under each recording's calibration document. Raises
    where no pair of frames shares enough corners."""
    spark = ship(sony.sparkSession)
    pairs = quality.collect_pairs(zed, sony, ["dataset", "frame"], least).join(F.broadcast(board(spark)), "corner_id")
    lens = [F.col(f"{name}.{field}").alias(f"{name}_{short}") for name in ("zed_camera", "sony_camera") for field, short in (("camera_matrix", "k"), ("distortion_coeffs", "d"))]
    known = documents.select(F.col("meta.dataset").alias("dataset"), *lens, "extrinsics.rotation_matrix_3x3", "extrinsics.translation_metres")
    placed = need(pairs, 1, "corners of frame pairs").join(known, "dataset")
    return calibration.reprojection_errors(placed, ["dataset"], "zed_camera", "sony_camera", "rotation_matrix_3x3", "translation_metres")


def filtering(skeleton: DataFrame, joint: str = "right_wrist", axis: str = "x", fps: float = 30.0) -> DataFrame:
    """Phase 3: (dataset, frame_idx, t, raw, filtered, expansiveness) of skeleton rows (dataset, frame_idx, 114 columns)."""
    ship(skeleton.sparkSession)
    column = movement.joint_column(joint, axis)
    seen = quality.root_filter(skeleton)
    wide = movement.expansiveness(movement.point("spine_2"), movement.point("left_wrist"), movement.point("right_wrist"))
    rows = seen.select("dataset", "frame_idx", movement.frame_time(F.col("frame_idx"), fps).alias("t"), F.col(column).alias("raw"), wide.alias("expansiveness"))
    return series.one_euro(rows, ["dataset"], ["frame_idx"], F.col("t"), F.col("raw"))
