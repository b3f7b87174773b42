"""Phase 2: detections, motion, selection, geometry, errors, solvers; queries over the test tables with their SQL."""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import geometry, headers
from ..functions.columns import signed
from ..operators import calibration, quality, report, solvers
from ..scratch import new_folder
from ..sources import sinks, tables
from ..sources.tables import board
from ._common import table

#: The documented sample calibration (matrix, distortion, rotation in degrees, shift in centimetres).
K = ((1500.0, 0.0, 960.0), (0.0, 1500.0, 540.0), (0.0, 0.0, 1.0))
D = (-0.12, 0.08, 0.001, -0.002, 0.01)
DEGREES, CENTIMETRES = (0.5, -1.2, 0.3), (-3.2, -6.5, 1.1)
VECTOR = tuple(math.radians(v) for v in DEGREES)
R = tuple(tuple(float(x) for x in row) for row in solvers.rotation(np.array(VECTOR)))
T = tuple(v / 100 for v in CENTIMETRES)
#: Frames of a recording, at least, in the solvers' queries.
VIEWS = 10


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker and corner counts of a frame from an order's lines; orders of odd customers are the unreadable ones."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n_markers"), F.sum("l_quantity").cast("int").alias("n_corners"))
    unread = F.col("l_orderkey") % 17 == 0
    return l.select("l_orderkey", F.when(~unread, F.col("n_markers")).alias("n_markers"), F.when(~unread, F.col("n_corners")).alias("n_corners"))


def detection_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unread frames have no marker count, here -1."""
    return quality.classify_detections(detections(spark, sf_dir), 100, 3).fillna(-1, ["n_markers"])


def detection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("status")
    return detection_status(spark, sf_dir).agg(*[F.count_if(s == x).alias(x) for x in ("ok", "unreadable", "rejected_no_markers", "rejected_few_corners")])


def annotation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of widths from 640 to 2239; the size of those without a picture is -1 here."""
    d = detection_status(spark, sf_dir).withColumns({"width": F.col("l_orderkey") % 1600 + 640, "height": F.col("l_orderkey") % 900 + 360})
    return quality.annotations(d).select("l_orderkey", "label", F.array_join(F.col("colour").cast("array<string>"), " ").alias("colour"), *[F.coalesce(f"shown.{c}", F.lit(-1)).alias(c) for c in ("width", "height")])


def trial_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as configurations that were tried."""
    p = table(spark, sf_dir, "part").withColumns({"board": F.concat_ws("x", F.col("p_size"), F.col("p_size") % 7), "n": F.col("p_partkey") % 13})
    text = quality.trial_label(F.col("p_name"), F.col("board"), F.col("p_size"), F.col("n"))
    return p.select("p_partkey", text.alias("label"), F.array_join(quality.colour(F.col("n") >= 6, quality.TRIED).cast("array<string>"), " ").alias("colour"))


def _cameras(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = detection_status(spark, sf_dir)
    half = F.floor(F.col("l_orderkey") / 2).alias("frame")
    pick = lambda k: s.where(F.col("l_orderkey") % 2 == k).select(half, "status", "n_corners")
    return pick(0), pick(1)


def paired_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.both_ok(*_cameras(spark, sf_dir), ["frame"])


def frames_in_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.in_both(*_cameras(spark, sf_dir), ["frame"]).select("frame", "status")


def best_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("try_order"), (F.col("l_quantity") - 25).cast("int").alias("n_corners"))
    return quality.best_variant(tried, ["l_orderkey"])


def corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 corners of each vector, those near its axis unseen; pixels of a 1920 by 1080 picture."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct(F.get("embedding", 2 * k).cast("double").alias("x"), F.get("embedding", 2 * k + 1).cast("double").alias("y")))).alias("corner_id", "c"))
    return e.select("vec_id", "corner_id", (F.col("c.x") * 2000 + 960).alias("x"), (F.col("c.y") * 2000 + 540).alias("y")).where(F.abs(F.col("x") - 960) > 40)


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = corners(spark, sf_dir)
    pick = lambda k: c.where(F.col("vec_id") % 2 == k).select(F.floor(F.col("vec_id") / 2).alias("frame"), "corner_id", "x", "y")
    return pick(0), pick(1)


def matched_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.matched_corners(*_two(spark, sf_dir), ["frame"])


def pair_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.enough_shared(quality.matched_corners(*_two(spark, sf_dir), ["frame"]), ["frame"], 24)


def collected_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.collect_pairs(*_two(spark, sf_dir), ["frame"], 26)


def motion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "embeddings").select(F.lit("d").alias("dataset"), F.col("vec_id").alias("frame"))
    c = corners(spark, sf_dir).select(F.lit("d").alias("dataset"), F.col("vec_id").alias("frame"), "corner_id", "x", "y")
    return quality.motion_gate(frames, c, ["dataset"], px=900.0, least=20).select("frame", F.coalesce("n_shared", F.lit(0)).alias("n_shared"), F.coalesce(F.round("max_shift", 6), F.lit(-1.0)).alias("max_shift"), "still")


def board_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board(spark).select("corner_id", *[F.round(c, 6).alias(c) for c in ("bx", "by", "bz")])


def corners_on_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.broadcast(board(spark))
    return corners(spark, sf_dir).join(b, "corner_id").select("vec_id", "corner_id", F.round("bx", 6).alias("bx"), F.round("by", 6).alias("by"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corners(spark, sf_dir).withColumns({"width": F.lit(1920.0), "height": F.lit(1080.0)})
    return quality.frame_features(c, ["vec_id"])


def frame_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("vec_id", *[F.round(c, 4).alias(c) for c in quality.FEATURES])


def normalised_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.normalised(_components(spark, sf_dir), ("e0", "e1", "e2", "e3")).select("vec_id", *[F.round(f"e{k}", 6).alias(f"e{k}") for k in range(4)])


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(4)])


def farthest_point_45(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.farthest_point(_components(spark, sf_dir), 45, "vec_id", ("e0", "e1", "e2", "e3"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 0.01).alias("X"), (F.col("p_retailprice") * 0.0005).alias("Y"), (F.col("p_partkey") % 100 * 0.01 + 1.0).alias("Z"))



def _xyz() -> list:
    return [F.col(c) for c in "XYZ"]


def rigid_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = geometry.rigid(_xyz(), R, T)
    return points(spark, sf_dir).select("p_partkey", *[F.round(v, 6).alias(n) for n, v in zip("xyz", p, strict=True)])


def chained_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = geometry.chained(_xyz(), (R, T), (R, T))
    return points(spark, sf_dir).select("p_partkey", *[F.round(v, 6).alias(n) for n, v in zip("xyz", p, strict=True)])


def project_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v = geometry.project(geometry.rigid(_xyz(), R, T), K, D)
    return points(spark, sf_dir).select("p_partkey", F.round(u, 4).alias("u"), F.round(v, 4).alias("v"))


def reprojection_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the projection without distortion."""
    u, v = geometry.project(geometry.rigid(_xyz(), R, T), K, D)
    a, b = geometry.project(geometry.rigid(_xyz(), R, T), K, (0.0,) * 5)
    return points(spark, sf_dir).select("p_partkey", F.round(geometry.distance((u, a), (v, b)), 4).alias("error"))


def rodrigues_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = [(F.col("p_size") + 1) * 0.01, F.col("p_partkey") % 50 * 0.02, F.lit(0.3)]
    back = geometry.vector_of(geometry.rotation_of(v))
    return table(spark, sf_dir, "part").select("p_partkey", *[F.round(F.degrees(x), 4).alias(n) for n, x in zip("xyz", back, strict=True)])


def lens_offset_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cm = [c * 100.0 for c in geometry.rigid(_xyz(), R, T)]
    return points(spark, sf_dir).select("p_partkey", F.concat_ws(" ", *[F.concat(F.lit(f"Location {n} : "), signed(c, 2), F.lit(" cm")) for n, c in zip("XYZ", cm, strict=True)]).alias("line"))


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), (F.col("l_quantity") * 0.1).alias("error"))


def reprojection_by_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_frame(errors(spark, sf_dir), ["frame"]).select("frame", "n_corners", *[F.round(c, 6).alias(c) for c in ("mean_error_px", "max_error_px", "std_error_px")])


def reprojection_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = report.overall(errors(spark, sf_dir))
    return o.select(*[F.round(c, 6).alias(c) for c in o.columns], report.assessment(F.col("overall_mean_px")).alias("assessment"))


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's mean, on a grid, so that both engines grade the same number."""
    return report.by_frame(errors(spark, sf_dir), ["frame"]).withColumn("mean_error_px", F.round("mean_error_px", 6))


def validation_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.grades(_means(spark, sf_dir))


def frame_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("mean_error_px")
    return _means(spark, sf_dir).select("frame", report.grade(m).alias("grade"), report.bar_class(m).alias("bar"), report.assessment(m).alias("assessment"))


def error_histogram_40(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("error"))
    return report.histogram(e).select("bin", "n", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


def validation_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each 500 orders as a recording; its frames read back from JSON."""
    e = errors(spark, sf_dir).withColumn("dataset", F.floor(F.col("frame") / 500).cast("string"))
    r = report.validation_report(e)
    kind = r.schema["per_frame"].dataType.simpleString()
    back = F.from_json(F.get_json_object(F.to_json(F.struct(*r.columns)), "$.per_frame"), kind)
    flat = r.select("dataset", "n_frames_validated", F.explode(back).alias("f"))
    return flat.groupBy("dataset", "n_frames_validated").agg(F.sum("f.n_corners").alias("n_corners"), F.round(F.sum(F.size("f.errors_px")), 0).cast("long").alias("n_errors"))


def validation_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report of each 500 orders as a recording. Errors are sixteenths, whose sums are exact."""
    e = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 500).cast("string").alias("dataset"), F.format_string("%07d", "l_orderkey").alias("frame"), (F.col("l_quantity") / 16).alias("error"))
    path = new_folder(spark, "reports")
    sinks.write_report(report.validation_report(e), path)
    r = spark.read.schema(schemas.VALIDATION_REPORT).json(path)
    worst = F.array_max(F.transform("per_frame", lambda f: F.struct(f["max_error_px"].alias("max"), f["frame_pair"][0].alias("name"))))
    return r.select(
        "dataset", "n_frames_validated", *[F.round(c, 6).alias(c) for c in ("overall_mean_px", "overall_std_px", "percentile_95_px")], "frames_good", "frames_warn", "frames_bad",
        F.array_join("bad_frame_names", ",").alias("bad"), "assessment", worst["name"].alias("worst"), F.aggregate("per_frame", F.lit(0).cast("long"), lambda n, f: n + F.size(f["errors_px"])).alias("n_errors"),
    )


def flat_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = errors(spark, sf_dir).groupBy("frame").agg(F.collect_list("error").alias("errors_px"))
    return per.select("frame", F.explode("errors_px").alias("error")).select("frame", F.round("error", 6).alias("error"))


def shared_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that both cameras saw, as arrays; and whether corner 0 is one."""
    a, b = _two(spark, sf_dir)
    ids = lambda df, n: df.groupBy("frame").agg(F.array_sort(F.collect_set("corner_id")).alias(n))
    both = F.array_sort(F.array_intersect("a", "b"))
    return ids(a, "a").join(ids(b, "b"), "frame").select("frame", F.array_join(both.cast("array<string>"), ",").alias("ids"), F.array_contains(both, 0).alias("has_first"))


def bounds_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corners(spark, sf_dir).where(quality.in_bounds(F.col("x"), F.col("y"), 1100, 700)).select("vec_id", "corner_id")


def coverage_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corners(spark, sf_dir).withColumn("camera", F.col("vec_id") % 2)
    return quality.coverage(c, ["camera"], 1920, 1080).select("camera", "n_pixels", F.round("share", 6).alias("share"))


def calibrated_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calibration document for each nation, written as a JSON file and read back; every part as a point of a recording."""
    path, k = new_folder(spark, "calibrations"), F.col("n_nationkey")
    turned, straight = (F.array(*[F.array(*map(F.lit, row)) for row in m]) for m in ([[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]], [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]))
    shift = F.array(k * 0.5, k * -0.25, F.lit(2.0))
    extrinsics = F.struct(F.when(k % 2 == 1, turned).otherwise(straight).alias("rotation_matrix_3x3"), shift.alias("translation_metres"))
    documents = table(spark, sf_dir, "nation").select(F.struct(F.col("n_name").alias("dataset")).alias("meta"), extrinsics.alias("extrinsics"))
    documents.withColumn("recording", F.col("meta.dataset")).write.partitionBy("recording").json(path)  # a file each
    read = tables.calibration_json(spark, path).withColumn("dataset", F.col("meta.dataset"))
    named = table(spark, sf_dir, "nation").select(k.alias("nation"), F.col("n_name").alias("dataset"))
    p = points(spark, sf_dir).withColumn("nation", F.col("p_partkey") % 25).join(named, "nation").select("p_partkey", "dataset", "X", "Y", "Z")
    moved = calibration.transform_points(p, read, ["dataset"], ("X", "Y", "Z"))
    return moved.select("p_partkey", "dataset", *[F.round(c, 6).alias(c.lower()) for c in "XYZ"])


def picture_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as the beginning of a PNG or JPEG file, every seventh cut off; the first readable one of each 20 parts."""
    bytes_of = lambda c, n: F.unhex(F.lpad(F.hex(c), 2 * n, "0"))
    fixed = lambda text: F.unhex(F.lit(text))
    key, wide, high = F.col("p_partkey"), F.col("p_partkey") % 4000 + 1, F.col("p_size") * 30
    png = F.concat(fixed(headers.PNG), bytes_of(wide, 4), bytes_of(high, 4), fixed("0802000000"))
    jpeg = F.concat(fixed("FFD8FFE0"), bytes_of(F.col("p_size") + 2, 2), F.unhex(F.repeat(F.lit("FF"), F.col("p_size"))), fixed("FFD0FFFFC2001108"), bytes_of(high, 2), bytes_of(wide, 2), fixed("03"))
    whole = F.when(key % 2 == 0, png).otherwise(jpeg)
    files = table(spark, sf_dir, "part").select(F.floor(key / 20).alias("folder"), F.col("p_name").alias("path"), "p_partkey", F.when(key % 7 == 0, F.substring(whole, 1, 19)).otherwise(whole).alias("content"))
    return tables.image_size(tables.with_size(files), ["folder"], "p_partkey")


def config_grid_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as dictionaries, two parameter sets, and each region's first three nations as frames."""
    n = table(spark, sf_dir, "nation").withColumn("place", F.row_number().over(_by_region())).where("place <= 3")
    axes = quality.grid(spark, dict_id=list(range(5)), params=["default", "relaxed"])
    found = n.join(F.broadcast(axes), F.col("n_regionkey") == F.col("dict_id")).select((F.col("ordinal") * 100 + F.col("n_nationkey")).alias("ordinal"), "dict_id", "params", F.col("n_name").alias("frame"), (F.col("n_nationkey") * 7 % 23).cast("int").alias("n_corners"))
    return quality.grid_search(found, ["dict_id", "params"])


def _by_region():
    from pyspark.sql import Window

    return Window.partitionBy("n_regionkey").orderBy("n_name")


def synthetic_views(spark: SparkSession, n: int = 8, noise: float = 0.0) -> DataFrame:
    """Corners of a board at known poses in two cameras (dataset, frame, corner_id, bx, by, bz, xa, ya, xb, yb)."""
    rng, rows = np.random.default_rng(5), []
    p = np.array([((i % 10 + 1) * 0.028, (i // 10 + 1) * 0.028, 0.0) for i in range(70)])
    for f in range(n):
        r, t = solvers.rotation(rng.uniform(-0.5, 0.5, 3)), np.array([*rng.uniform(-0.2, 0.0, 2), rng.uniform(0.6, 1.0)])
        a = solvers.projected(p, r, t, np.array(K), np.array(D))
        b = solvers.projected(p, np.array(R) @ r, np.array(R) @ t + np.array(T), np.array(K), np.array(D))
        rows += [("d", f, i, *p[i].tolist(), *(a[i] + noise * rng.normal(size=2)).tolist(), *(b[i] + noise * rng.normal(size=2)).tolist()) for i in range(70)]
    return spark.createDataFrame(rows, "dataset string, frame int, corner_id int, bx double, by double, bz double, xa double, ya double, xb double, yb double")


def table_views(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """Views like synthetic_views of every vector of the table: a vector is a frame whose pose comes from its id and
    numbers, and its id deals it to one of the recordings of ten frames or more. Dealt to tasks by `keys`."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), "embedding")
    n = e.agg(F.greatest(F.lit(1), F.floor(F.count("*") / VIEWS)).alias("n"))
    part = lambda k, low, high: F.pmod(F.xxhash64("frame", "embedding", F.lit(k)), F.lit(1_000_000)) / 1e6 * (high - low) + low
    pose = [part(k, -0.5, 0.5) for k in range(3)] + [part(k, -0.2, 0.0) for k in (3, 4)] + [part(5, 0.6, 1.0)]
    e = e.crossJoin(F.broadcast(n)).select(F.pmod("frame", "n").cast("string").alias("dataset"), "frame", *[c.alias(f"p{k}") for k, c in enumerate(pose)])
    e = e.select("dataset", "frame", F.array(*[F.array(*row) for row in geometry.rotation_of([F.col(f"p{k}") for k in range(3)])]).alias("r"), *[f"p{k}" for k in (3, 4, 5)])
    e = e.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)  # a solve costs more than its few bytes tell
    i = F.col("corner_id")
    v = e.select("*", F.explode(F.sequence(F.lit(0), F.lit(69))).alias("corner_id")).select("*", ((i % 10 + 1) * 0.028).alias("bx"), ((F.floor(i / 10) + 1) * 0.028).alias("by"), F.lit(0.0).alias("bz"))
    first = geometry.rigid([F.col(c) for c in ("bx", "by", "bz")], geometry.matrix(F.col("r")), [F.col(f"p{k}") for k in (3, 4, 5)])
    v = v.select("dataset", "frame", "corner_id", "bx", "by", "bz", *[c.alias(f"a{k}") for k, c in enumerate(first)])
    a = [F.col(f"a{k}") for k in range(3)]
    v = v.select("*", *[c.alias(f"b{k}") for k, c in enumerate(geometry.rigid(a, R, T))])
    (xa, ya), (xb, yb) = geometry.project(a, K, D), geometry.project([F.col(f"b{k}") for k in range(3)], K, D)
    return v.select("dataset", "frame", "corner_id", "bx", "by", "bz", xa.alias("xa"), ya.alias("ya"), xb.alias("xb"), yb.alias("yb"))


def pose_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table_views(spark, sf_dir, "dataset", "frame").withColumnsRenamed({"xa": "x", "ya": "y"})
    return solvers.solve_poses(v, ["dataset", "frame"], np.array(K), np.array(D)).select("dataset", "frame", F.round("rms", 4).alias("rms"))


def calibrate_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table_views(spark, sf_dir, "dataset").withColumnsRenamed({"xa": "x", "ya": "y"})
    return solvers.calibrate(v, ["dataset"]).select("dataset", F.round(F.col("camera_matrix")[0][0], 2).alias("fx"), F.round(F.col("camera_matrix")[0][2], 2).alias("cx"), F.round("rms", 4).alias("rms"), "n_views")


def stereo_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    camera = (np.array(K), np.array(D))
    s = solvers.stereo_calibrate(table_views(spark, sf_dir, "dataset"), ["dataset"], camera, camera)
    return s.select("dataset", *[F.round(F.col("rotation_degrees")[k], 3).alias(f"r{k}") for k in range(3)], *[F.round(F.col("translation_cm")[k], 3).alias(f"t{k}") for k in range(3)])


_DET = """d AS (SELECT l_orderkey, CASE WHEN l_orderkey % 17 <> 0 THEN count(*)::INT END AS m, CASE WHEN l_orderkey % 17 <> 0 THEN trunc(sum(l_quantity))::INT END AS c FROM lineitem GROUP BY l_orderkey),
st AS (SELECT l_orderkey, CASE WHEN c IS NULL THEN 'unreadable' WHEN m < 3 THEN 'rejected_no_markers' WHEN c >= 100 THEN 'ok' ELSE 'rejected_few_corners' END AS status, CASE WHEN m < 3 THEN 0 ELSE coalesce(m, -1) END AS n_markers, CASE WHEN c IS NULL OR m < 3 THEN 0 ELSE c END AS n_corners FROM d)"""
_COR = "c AS (SELECT vec_id, k AS corner_id, embedding[2 * k + 1]::DOUBLE * 2000 + 960 AS x, embedding[2 * k + 2]::DOUBLE * 2000 + 540 AS y FROM embeddings, (SELECT unnest(range(0, 32))::INT AS k) WHERE abs(embedding[2 * k + 1]::DOUBLE * 2000 + 960 - 960) > 40)"
_PAIR = _COR + ", p AS (SELECT a.vec_id // 2 AS frame, a.corner_id, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb FROM c a JOIN c b ON b.vec_id = a.vec_id + 1 AND a.corner_id = b.corner_id WHERE a.vec_id % 2 = 0)"
_PT = "p AS (SELECT p_partkey, p_size * 0.01::DOUBLE AS X, p_retailprice * 0.0005::DOUBLE AS Y, p_partkey % 100 * 0.01::DOUBLE + 1 AS Z FROM part)"


def _rigid_sql(a: str, source: str) -> str:
    return f"{a} AS (SELECT p_partkey, " + ", ".join(f"X * {R[i][0]!r}::DOUBLE + Y * {R[i][1]!r}::DOUBLE + Z * {R[i][2]!r}::DOUBLE + {T[i]!r}::DOUBLE AS {n}" for i, n in enumerate("XYZ")) + f" FROM {source})"


_UV = f"""n AS (SELECT p_partkey, X / Z AS x, Y / Z AS y, (X / Z) * (X / Z) + (Y / Z) * (Y / Z) AS q FROM t),
g AS (SELECT *, 1 + q * {D[0]}::DOUBLE + q * q * {D[1]}::DOUBLE + q * q * q * {D[4]}::DOUBLE AS r FROM n),
uv AS (SELECT p_partkey, (x * r + x * y * 2 * {D[2]}::DOUBLE + (q + x * x * 2) * {D[3]}::DOUBLE) * 1500 + 960 AS u, (y * r + (q + y * y * 2) * {D[2]}::DOUBLE + x * y * 2 * {D[3]}::DOUBLE) * 1500 + 540 AS v, x * 1500 + 960 AS a, y * 1500 + 540 AS b FROM g)"""
_GEO = f"WITH {_PT}, {_rigid_sql('t', 'p')}"
_ERR = "e AS (SELECT l_orderkey AS frame, l_quantity * 0.1::DOUBLE AS error FROM lineitem)"
_MEAN = _ERR + ", m AS (SELECT frame, round(avg(error), 6) AS a FROM e GROUP BY frame)"
_GRADE = "CASE WHEN a < 1.5 THEN 'good' WHEN a < 2.5 THEN 'warn' WHEN a >= 2.8 THEN 'bad' END"
_NORM = "SELECT vec_id, " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS e{k}" for k in range(4)) + " FROM embeddings"
_SCALED = f"b AS ({_NORM}), r AS (SELECT " + ", ".join(f"min(e{k}) AS a{k}, max(e{k}) AS z{k}" for k in range(4)) + " FROM b), s AS (SELECT vec_id, " + ", ".join(f"(e{k} - a{k}) / CASE WHEN z{k} > a{k} THEN z{k} - a{k} ELSE 1 END AS e{k}" for k in range(4)) + " FROM b, r)"

QUERIES = {f.__name__: f for f in (detection_status, detection_counts, annotation_labels, trial_labels, paired_ok, frames_in_both, best_variant, matched_corners, pair_gate, collected_pairs, motion_gate, board_corners, corners_on_board, frame_features, normalised_features, farthest_point_45, rigid_transform, chained_transform, project_points, reprojection_error, rodrigues_roundtrip, lens_offset_text, reprojection_by_frame, reprojection_overall, validation_grade, frame_classes, error_histogram_40, validation_report_json, validation_reports, flat_errors, shared_ids, bounds_filter, coverage_mask, calibrated_points, picture_sizes, config_grid_best, pose_solve, calibrate_camera, stereo_calibrate)}
ORACLE = {
    "detection_status": f"WITH {_DET} SELECT * FROM st",
    "detection_counts": f"WITH {_DET} SELECT " + ", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in ("ok", "unreadable", "rejected_no_markers", "rejected_few_corners")) + " FROM st",
    "annotation_labels": f"""WITH {_DET}, w AS (SELECT *, l_orderkey % 1600 + 640 AS w, l_orderkey % 900 + 360 AS h FROM st), z AS (SELECT *, CASE WHEN status <> 'rejected_no_markers' AND w > 1280 THEN 1280::DOUBLE / w ELSE 1 END AS z FROM w WHERE status <> 'unreadable')
SELECT l_orderkey, CASE WHEN status = 'rejected_no_markers' THEN 'REJECTED - no ArUco markers' ELSE 'Corners: ' || n_corners || '  Status: ' || status END AS label, CASE WHEN status = 'ok' THEN '0 180 0' ELSE '0 0 220' END AS colour, trunc(w * z)::INT AS width, trunc(h * z)::INT AS height FROM z
UNION ALL SELECT l_orderkey, NULL, NULL, -1, -1 FROM st WHERE status = 'unreadable'""",
    "trial_labels": "SELECT p_partkey, 'Dict: ' || p_name || '  Board: ' || p_size || 'x' || p_size % 7 || '  Markers: ' || p_size || '  ChArUco corners: ' || p_partkey % 13 AS label, CASE WHEN p_partkey % 13 >= 6 THEN '0 200 0' ELSE '0 0 220' END AS colour FROM part",
    "paired_ok": f"WITH {_DET} SELECT a.l_orderkey // 2 AS frame, a.n_corners AS sony_corners, b.n_corners AS zed_corners FROM st a JOIN st b ON b.l_orderkey = a.l_orderkey + 1 WHERE a.l_orderkey % 2 = 0 AND a.status = 'ok' AND b.status = 'ok'",
    "frames_in_both": f"WITH {_DET} SELECT l_orderkey // 2 AS frame, status FROM st WHERE l_orderkey % 2 = 0 AND l_orderkey + 1 IN (SELECT l_orderkey FROM st)",
    "best_variant": "SELECT l_orderkey, l_linenumber AS try_order, trunc(l_quantity - 25)::INT AS n_corners FROM lineitem WHERE trunc(l_quantity - 25) >= 1 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY trunc(l_quantity - 25) DESC, l_linenumber) = 1",
    "matched_corners": f"WITH {_PAIR} SELECT * FROM p",
    "pair_gate": f"WITH {_PAIR} SELECT frame, count(*) AS n_shared FROM p GROUP BY frame HAVING count(*) >= 24",
    "collected_pairs": f"WITH {_PAIR} SELECT *, count(*) OVER (PARTITION BY frame) AS n_shared FROM p QUALIFY n_shared >= 26",
    "motion_gate": f"""WITH {_COR}, m AS (SELECT a.vec_id AS frame, count(*) AS n, max(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS s FROM c a JOIN c b ON b.vec_id = a.vec_id - 3 AND a.corner_id = b.corner_id GROUP BY 1)
SELECT vec_id AS frame, coalesce(n, 0) AS n_shared, coalesce(round(s, 6), -1) AS max_shift, coalesce(n >= 20 AND s <= 900, false) AS still FROM embeddings LEFT JOIN m ON frame = vec_id""",
    "board_corners": "SELECT k::INT AS corner_id, round((k % 10 + 1) * 0.028::DOUBLE, 6) AS bx, round((k // 10 + 1) * 0.028::DOUBLE, 6) AS by, 0::DOUBLE AS bz FROM (SELECT unnest(range(0, 70)) AS k)",
    "corners_on_board": f"WITH {_COR} SELECT vec_id, corner_id, round((corner_id % 10 + 1) * 0.028::DOUBLE, 6) AS bx, round((corner_id // 10 + 1) * 0.028::DOUBLE, 6) AS by FROM c",
    "frame_features": f"WITH {_COR} SELECT vec_id, round((avg(x) / 1920)::FLOAT::DOUBLE, 4) AS mean_x, round((avg(y) / 1080)::FLOAT::DOUBLE, 4) AS mean_y, round(((max(x) - min(x)) / greatest(max(y) - min(y), 1e-6::DOUBLE))::FLOAT::DOUBLE, 4) AS aspect, round((((max(x) - min(x)) / 1920) * ((max(y) - min(y)) / 1080))::FLOAT::DOUBLE, 4) AS area FROM c GROUP BY vec_id",
    "normalised_features": f"WITH {_SCALED} SELECT vec_id, " + ", ".join(f"round(e{k}, 6) AS e{k}" for k in range(4)) + " FROM s",
    "farthest_point_45": "WITH RECURSIVE " + _SCALED + """, d AS (SELECT a.vec_id AS i, list(struct_pack(d := sqrt(""" + " + ".join(f"(a.e{k} - b.e{k}) * (a.e{k} - b.e{k})" for k in range(4)) + """), v := b.vec_id) ORDER BY b.vec_id) AS l FROM s a, s b GROUP BY a.vec_id),
f AS (SELECT 1 AS pick, (SELECT min(vec_id) FROM s) AS v, (SELECT [1e300::DOUBLE FOR x IN l] FROM d ORDER BY i LIMIT 1) AS far
UNION ALL SELECT pick + 1, l[list_position(n, list_max(n))].v, n FROM (SELECT pick, d.l AS l, [CASE WHEN d.l[k].d = 0 THEN -1 ELSE least(far[k], d.l[k].d) END FOR k IN range(1, len(far) + 1)] AS n FROM f JOIN d ON d.i = f.v WHERE pick < 45))
SELECT v AS vec_id, pick FROM f""",
    "rigid_transform": f"{_GEO} SELECT p_partkey, round(X, 6) AS x, round(Y, 6) AS y, round(Z, 6) AS z FROM t",
    "chained_transform": f"{_GEO}, {_rigid_sql('w', 't')} SELECT p_partkey, round(X, 6) AS x, round(Y, 6) AS y, round(Z, 6) AS z FROM w",
    "project_points": f"{_GEO}, {_UV} SELECT p_partkey, round(u, 4) AS u, round(v, 4) AS v FROM uv",
    "reprojection_error": f"{_GEO}, {_UV} SELECT p_partkey, round(sqrt((u - a) * (u - a) + (v - b) * (v - b)), 4) AS error FROM uv",
    "rodrigues_roundtrip": "SELECT p_partkey, round(degrees((p_size + 1) * 0.01::DOUBLE), 4) AS x, round(degrees(p_partkey % 50 * 0.02::DOUBLE), 4) AS y, round(degrees(0.3::DOUBLE), 4) AS z FROM part",
    "lens_offset_text": f"{_GEO} SELECT p_partkey, printf('Location X : %+.2f cm Location Y : %+.2f cm Location Z : %+.2f cm', X * 100, Y * 100, Z * 100) AS line FROM t",
    "reprojection_by_frame": f"WITH {_ERR} SELECT frame, count(*) AS n_corners, round(avg(error), 6) AS mean_error_px, round(max(error), 6) AS max_error_px, round(stddev_pop(error), 6) AS std_error_px FROM e GROUP BY frame",
    "reprojection_overall": f"WITH {_ERR}, o AS (SELECT avg(error) AS a, stddev_pop(error) AS s, quantile_cont(error, 0.95) AS q FROM e) SELECT round(a, 6) AS overall_mean_px, round(s, 6) AS overall_std_px, round(q, 6) AS percentile_95_px, CASE WHEN a < 0.5 THEN 'Excellent' WHEN a < 1.8 THEN 'Good' WHEN a < 2.5 THEN 'Acceptable' ELSE 'Poor' END AS assessment FROM o",
    "validation_grade": f"WITH {_MEAN} SELECT count(*) FILTER (a < 1.5) AS frames_good, count(*) FILTER (a >= 1.5 AND a < 2.5) AS frames_warn, count(*) FILTER (a >= 2.8) AS frames_bad, count(*) AS n_frames_validated FROM m",
    "frame_classes": f"WITH {_MEAN} SELECT frame, {_GRADE} AS grade, CASE WHEN a < 1 THEN 'low' WHEN a < 2 THEN 'middle' ELSE 'high' END AS bar, CASE WHEN a < 0.5 THEN 'Excellent' WHEN a < 1.8 THEN 'Good' WHEN a < 2.5 THEN 'Acceptable' ELSE 'Poor' END AS assessment FROM m",
    "error_histogram_40": "WITH r AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS z FROM lineitem) SELECT least(floor((l_extendedprice - a) / (z - a) * 40), 39)::INT AS bin, count(*) AS n, round(any_value(a + (z - a) / 40 * least(floor((l_extendedprice - a) / (z - a) * 40), 39)), 4) AS low, round(any_value(a + (z - a) / 40 * (least(floor((l_extendedprice - a) / (z - a) * 40), 39) + 1)), 4) AS high FROM lineitem, r GROUP BY 1",
    "validation_report_json": "SELECT (l_orderkey // 500)::VARCHAR AS dataset, count(DISTINCT l_orderkey) AS n_frames_validated, count(*) AS n_corners, count(*) AS n_errors FROM lineitem GROUP BY 1",
    "validation_reports": f"""WITH e AS (SELECT (l_orderkey // 500)::VARCHAR AS dataset, printf('%07d', l_orderkey) AS frame, l_quantity / 16 AS error FROM lineitem),
m AS (SELECT dataset, frame, avg(error) AS a, max(error) AS top FROM e GROUP BY ALL),
f AS (SELECT dataset, count(*) AS n_frames_validated, count(*) FILTER (a < 1.5) AS frames_good, count(*) FILTER (a >= 1.5 AND a < 2.5) AS frames_warn, count(*) FILTER (a >= 2.8) AS frames_bad, coalesce(string_agg(frame, ',' ORDER BY frame) FILTER (a >= 2.8), '') AS bad, max(struct_pack(top := top, frame := frame)).frame AS worst FROM m GROUP BY dataset),
o AS (SELECT dataset, avg(error) AS a, stddev_pop(error) AS s, quantile_cont(error, 0.95) AS q, count(*) AS n_errors FROM e GROUP BY dataset)
SELECT dataset, n_frames_validated, round(a, 6) AS overall_mean_px, round(s, 6) AS overall_std_px, round(q, 6) AS percentile_95_px, frames_good, frames_warn, frames_bad, bad, CASE WHEN a < 0.5 THEN 'Excellent' WHEN a < 1.8 THEN 'Good' WHEN a < 2.5 THEN 'Acceptable' ELSE 'Poor' END AS assessment, worst, n_errors FROM f JOIN o USING (dataset)""",
    "flat_errors": f"WITH {_ERR} SELECT frame, round(error, 6) AS error FROM e",
    "shared_ids": f"WITH {_PAIR}, f AS (SELECT DISTINCT a.vec_id // 2 AS frame FROM c a JOIN c b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0) SELECT frame, coalesce(string_agg(corner_id::VARCHAR, ',' ORDER BY corner_id), '') AS ids, coalesce(bool_or(corner_id = 0), false) AS has_first FROM f LEFT JOIN p USING (frame) GROUP BY frame",
    "bounds_filter": f"WITH {_COR} SELECT vec_id, corner_id FROM c WHERE trunc(x) >= 0 AND trunc(x) < 1100 AND trunc(y) >= 0 AND trunc(y) < 700",
    "coverage_mask": f"WITH {_COR}, o AS (SELECT dx, dy FROM (SELECT unnest(range(-8, 9)) AS dx), (SELECT unnest(range(-8, 9)) AS dy) WHERE dx * dx + dy * dy <= 64), q AS (SELECT DISTINCT vec_id % 2 AS camera, trunc(x)::INT + dx AS i, trunc(y)::INT + dy AS j FROM c, o WHERE trunc(x) >= 0 AND trunc(x) < 1920 AND trunc(y) >= 0 AND trunc(y) < 1080) SELECT camera, count(*) AS n_pixels, round(count(*) / (1920 * 1080)::DOUBLE, 6) AS share FROM q WHERE i >= 0 AND i < 1920 AND j >= 0 AND j < 1080 GROUP BY camera",
    "calibrated_points": f"WITH {_PT}, n AS (SELECT n_nationkey AS k, n_name AS dataset FROM nation) SELECT p_partkey, dataset, round(CASE WHEN k % 2 = 1 THEN -Y ELSE X END + k * 0.5::DOUBLE, 6) AS x, round(CASE WHEN k % 2 = 1 THEN X ELSE Y END + k * -0.25::DOUBLE, 6) AS y, round(Z + 2, 6) AS z FROM p JOIN n ON k = p_partkey % 25",
    "picture_sizes": "SELECT p_partkey // 20 AS folder, p_partkey % 4000 + 1 AS width, (p_size * 30)::BIGINT AS height FROM part WHERE p_partkey % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) = 1",
    "config_grid_best": "WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS k FROM nation) SELECT n_regionkey::BIGINT AS dict_id, p AS params, n_name AS frame, (n_nationkey * 7 % 23)::INT AS n_corners FROM n, (SELECT unnest(['default', 'relaxed']) AS p, unnest([0, 1]) AS o) WHERE k <= 3 AND n_nationkey * 7 % 23 >= 6 ORDER BY n_corners DESC, (n_regionkey * 2 + o) * 100 + n_nationkey LIMIT 1",
}
