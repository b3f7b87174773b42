"""Declared schemas of the data model, as DDL: no inference anywhere."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: The joints of a skeleton frame, in file order.
JOINTS = (
    "pelvis", "spine_1", "spine_2", "spine_3", "neck", "nose", "left_eye", "right_eye", "left_ear", "right_ear",
    "left_clavicle", "right_clavicle", "left_shoulder", "right_shoulder", "left_elbow", "right_elbow", "left_wrist", "right_wrist",
    "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle", "left_big_toe", "right_big_toe",
    "left_small_toe", "right_small_toe", "left_heel", "right_heel", "left_hand_thumb_4", "right_hand_thumb_4",
    "left_hand_index_1", "right_hand_index_1", "left_hand_middle_4", "right_hand_middle_4", "left_hand_pinky_1", "right_hand_pinky_1",
)
AXES = ("x", "y", "z")


FRAMES = "dataset STRING, camera STRING, frame_idx BIGINT, path STRING, width INT, height INT, content BINARY"
DEPTH = "dataset STRING, frame_idx BIGINT, width INT, height INT, depth ARRAY<INT>"
FEATURES = "dataset STRING, camera STRING, frame_idx BIGINT, vec ARRAY<FLOAT>"
MAPPING = "dataset STRING, sony_idx BIGINT, zed_idx BIGINT"
SYNCED = "dataset STRING, name STRING, sony_path STRING, zed_rgb_path STRING, zed_depth_path STRING"
BOARD = "corner_id INT, bx DOUBLE, by DOUBLE, bz DOUBLE"
CORNERS = "dataset STRING, camera STRING, frame STRING, corner_id INT, x DOUBLE, y DOUBLE"
_DETECTION = "ARRAY<STRUCT<file: STRING, status: STRING, n_markers: INT, n_corners: INT>>"
DETECTION_SUMMARY = f"sony {_DETECTION}, zed {_DETECTION}"
_MATRIX = "ARRAY<ARRAY<DOUBLE>>"
_CAMERA = f"STRUCT<camera_matrix: {_MATRIX}, distortion_coeffs: {_MATRIX}>"
CALIBRATION = (
    "meta STRUCT<dataset: STRING, valid_pairs_used: INT, timestamp: STRING>, "
    f"sony_camera {_CAMERA}, zed_camera {_CAMERA}, "
    f"extrinsics STRUCT<rotation_matrix_3x3: {_MATRIX}, rotation_rodrigues: ARRAY<DOUBLE>, rotation_degrees: ARRAY<DOUBLE>, translation_metres: ARRAY<DOUBLE>, "
    f"translation_cm: ARRAY<DOUBLE>, essential_matrix: {_MATRIX}, fundamental_matrix: {_MATRIX}, stereo_rms_px: DOUBLE>, "
    "ue5_offset STRUCT<X_cm: DOUBLE, Y_cm: DOUBLE, Z_cm: DOUBLE>"
)
VALIDATION_REPORT = (
    "dataset STRING, n_frames_validated BIGINT, overall_mean_px DOUBLE, overall_std_px DOUBLE, percentile_95_px DOUBLE, "
    "frames_good BIGINT, frames_warn BIGINT, frames_bad BIGINT, bad_frame_names ARRAY<STRING>, assessment STRING, "
    "per_frame ARRAY<STRUCT<frame_pair: ARRAY<STRING>, n_corners: BIGINT, mean_error_px: DOUBLE, max_error_px: DOUBLE, std_error_px: DOUBLE, errors_px: ARRAY<DOUBLE>>>"
)
SKELETON = "frame_idx BIGINT, " + ", ".join(f"{j}_{a} DOUBLE" for j in JOINTS for a in AXES)
JOINT_ROWS = "dataset STRING, frame_idx BIGINT, joint STRING, axis STRING, value DOUBLE"
GRID = "dict_name STRING, board STRUCT<cols: INT, rows: INT>, params STRING, frame STRING, n_markers INT, n_corners INT"


def matches(df: DataFrame, ddl: str) -> list[str]:
    """The columns of a schema; raises where a table from outside (detector, body tracker, feature network) breaks it."""
    have, schema = {f.name: f.dataType for f in df.schema}, StructType.fromDDL(ddl)
    wrong = [f"{f.name} {f.dataType.simpleString()}" for f in schema if have.get(f.name) != f.dataType]
    if wrong:
        raise TypeError(f"columns missing or of another type: {', '.join(wrong)}")
    return schema.names
