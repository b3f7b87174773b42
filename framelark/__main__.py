"""python -m framelark PROGRAM: the programs over files, each a few operators."""
from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="framelark")
    sub = p.add_subparsers(dest="program", required=True)

    def program(name: str, *files: str, **options: tuple) -> None:
        q = sub.add_parser(name)
        for f in files:
            q.add_argument(f)
        for o, (kind, default) in options.items():
            q.add_argument(f"--{o}", type=kind, default=default, required=default is None)

    program("sample-frames", "frames", "out", skip=(int, 1))
    program("smooth-mapping", "mapping_json", "out", dataset=(str, None), window=(int, 1501))
    program("compare-mappings", "raw_json", "smooth_json", "out")
    program("filter-skeleton", "csv", "out", dataset=(str, None), joint=(str, "right_wrist"), axis=(str, "x"))
    program("lens-offset", "calibration_json")
    program("sync-frames", "sony_features", "zed_features", "out", dist=(str, "cosine"), fast=(int, 0))
    program("compile-dataset", "mapping_json", "sony_folder", "zed_rgb_folder", "zed_depth_folder", "out", target=(str, "synced"))
    program("inspect-detections", "detections", "out", corners=(int, 45), markers=(int, 4))
    program("pick-frames", "corners", "out", count=(int, 45))
    program("calibrate-stereo", "sony_corners", "zed_corners", "out", count=(int, 45), least=(int, 45))
    program("validate-calibration", "sony_corners", "zed_corners", "calibration_json", "out", least=(int, 45))
    program("diagnose-detection", "grid", "out", least=(int, 6))
    q = sub.add_parser("transform-point")
    q.add_argument("calibration_json")
    q.add_argument("--point", nargs=3, type=float, required=True)
    a = p.parse_args(argv)

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators import align, calibration, quality, report, series, warping
    from .plans import phases
    from .shipping import ship
    from .sources import sinks, tables

    spark = ship(SparkSession.builder.getOrCreate())
    if a.program == "sample-frames":
        series.sample_frames(spark.read.parquet(a.frames).withColumnRenamed("frame_idx", "source_idx"), "source_idx", a.skip, keys=("dataset", "camera")).write.mode("overwrite").parquet(a.out)
    elif a.program == "smooth-mapping":
        m = series.smooth_mapping(tables.mapping_json(spark, a.mapping_json), a.window)
        sinks.write_mapping(m.select(F.lit(a.dataset).alias("dataset"), "sony_idx", F.col("zed_smooth").alias("zed_idx")), a.out)
    elif a.program == "compare-mappings":
        smooth = tables.mapping_json(spark, a.smooth_json).withColumnRenamed("zed_idx", "zed_smooth")
        lines = align.compare_mappings(tables.mapping_json(spark, a.raw_json), smooth)
        sinks.write_lines(lines.orderBy("sony_idx").select(F.explode(F.array("line", F.lit(""))).alias("line")), a.out)
        print("{n_changed} of {n_frames} frames changed".format(**align.mismatches(lines).first().asDict()))
    elif a.program == "filter-skeleton":
        phases.filtering(tables.skeleton_csv(spark, a.csv).withColumn("dataset", F.lit(a.dataset)), a.joint, a.axis).write.mode("overwrite").parquet(a.out)
    elif a.program == "lens-offset":
        for r in calibration.lens_offset(tables.calibration_json(spark, a.calibration_json)).orderBy("line_no").collect():  # six lines
            print(r.line)
    elif a.program == "sync-frames":  # features (dataset, frame_idx from 0, vec)
        one, two = (align.need_features(spark.read.parquet(f).select("dataset", F.col("frame_idx").alias(c), "vec")) for f, c in ((a.sony_features, "i"), (a.zed_features, "j")))
        path = warping.fast_path(one, two, ["dataset"], a.fast, a.dist) if a.fast else align.align_series(one, two, ["dataset"], a.dist)
        sinks.write_mapping(align.frame_mapping(path, ["dataset"]), a.out)
    elif a.program == "compile-dataset":  # writes what is to be copied where; nothing is copied here
        listed = [tables.listing(spark, f, "*.png").select(F.lit("").alias("dataset"), "path") for f in (a.sony_folder, a.zed_rgb_folder, a.zed_depth_folder)]
        synced = align.sync_manifest(tables.mapping_json(spark, a.mapping_json).withColumn("dataset", F.lit("")), *listed, ["dataset"])
        kinds = {"sony_path": "sony_rgb", "zed_rgb_path": "zed_rgb", "zed_depth_path": "zed_depth"}
        copies = synced.select("name", F.explode(F.array(*[F.struct(F.col(c).alias("src"), F.concat(F.lit(f"{a.target}/{k}/"), F.col("name")).alias("dst")) for c, k in kinds.items()])).alias("c"))
        sinks.copy_manifest(copies, F.col("c.src"), F.col("c.dst")).write.mode("overwrite").option("header", True).csv(a.out)
    elif a.program == "inspect-detections":  # detections (dataset, camera, file, n_markers, n_corners)
        known = quality.classify_detections(spark.read.parquet(a.detections), a.corners, a.markers).select("dataset", "camera", "file", "status", "n_markers", "n_corners")
        calibration.summary(known).write.mode("overwrite").json(a.out)
        for r in known.groupBy("dataset", "camera", "status").count().orderBy("dataset", "camera", "status").toLocalIterator():
            print(r.dataset, r.camera, r.status, r["count"])
    elif a.program == "pick-frames":  # corners (dataset, frame, corner_id, x, y, width, height)
        features = quality.frame_features(spark.read.parquet(a.corners), ["dataset", "frame"])
        quality.farthest_points(features, ["dataset"], a.count, "frame").write.mode("overwrite").partitionBy("dataset").json(a.out)
    elif a.program == "calibrate-stereo":
        done = phases.spatial(spark.read.parquet(a.sony_corners), spark.read.parquet(a.zed_corners), a.count, a.least)
        done.document.write.mode("overwrite").json(f"{a.out}/calibration")
        sinks.write_report(done.report, f"{a.out}/report")
    elif a.program == "validate-calibration":
        errors = phases.errors_of(spark.read.parquet(a.sony_corners), spark.read.parquet(a.zed_corners), tables.calibration_json(spark, a.calibration_json), a.least)
        sinks.write_report(report.validation_report(errors), a.out)
    elif a.program == "diagnose-detection":  # grid (ordinal, dict_name, board, params, frame, n_markers, n_corners)
        found = quality.grid_search(spark.read.parquet(a.grid), ["dict_name", "board", "params"], a.least)
        found.write.mode("overwrite").json(a.out)
        print(*(f"{k}: {v}" for r in found.collect() for k, v in r.asDict().items()), sep="\n")  # one row
    else:
        c = tables.calibration_json(spark, a.calibration_json)
        point = spark.createDataFrame([tuple(a.point)], "x double, y double, z double")
        print(*("{:+.6f}".format(v) for v in calibration.transform_points(point, c, []).first()))


if __name__ == "__main__":
    main()
