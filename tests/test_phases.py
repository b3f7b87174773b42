"""The phases from end to end on made-up recordings, and the command line."""
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelark import __main__ as cli
from framelark import schemas
from framelark.errors import InsufficientDataError
from framelark.operators import calibration
from framelark.plans import phases, spatial


def test_temporal_phase_finds_a_shift(spark):
    rng = np.random.default_rng(0)
    x = np.cumsum(rng.normal(size=(80, 6)), 0)
    features = lambda v: spark.createDataFrame([("d", k, r.tolist()) for k, r in enumerate(v)], "dataset string, frame_idx long, vec array<float>")
    files = lambda n, p: spark.createDataFrame([("d", f"{p}{k:05d}") for k in range(n)], "dataset string, path string")
    s = phases.temporal(features(x[5:65]), features(x), (files(60, "s"), files(80, "r"), files(80, "z")), window=11)
    raw = {r.sony_idx: r.zed_idx for r in s.raw.collect()}
    assert all(raw[k] == k + 5 for k in range(2, 50)) and len(raw) == 60
    z = [r.zed_smooth for r in s.smooth.orderBy("sony_idx").collect()]
    assert z == sorted(z) and s.log.count() == 60
    m = s.manifest.where("name = '00030.png'").first()
    assert (m.sony_path, m.zed_rgb_path, m.zed_depth_path) == ("s00029", "r00034", "z00034")


def test_spatial_phase_recovers_the_cameras(spark):
    v = spatial.synthetic_views(spark, 8).withColumns({"width": F.lit(1920), "height": F.lit(1080)})
    twice = v.withColumn("frame", (F.col("frame") * 10 + 3).cast("long")).unionByName(v.withColumn("frame", (F.col("frame") * 10).cast("long")))  # each view also three frames before
    side = lambda a, b: twice.select("dataset", "frame", "corner_id", F.col(a).alias("x"), F.col(b).alias("y"), "width", "height")
    got = phases.spatial(side("xb", "yb"), side("xa", "ya"), count=6)
    assert got.picked.count() == 6 and {r.frame % 10 for r in got.picked.collect()} == {3}
    doc, rep = got.document.first(), got.report.first()
    assert np.allclose(doc.extrinsics.translation_cm, spatial.CENTIMETRES, atol=0.05) and doc.meta.valid_pairs_used == 6
    assert doc.ue5_offset.X_cm == pytest.approx(doc.extrinsics.translation_cm[0])
    assert doc.sony_camera.camera_matrix[0][0] == pytest.approx(1500, abs=3)
    assert rep.overall_mean_px < 0.05 and rep.assessment == "Excellent" and rep.frames_good == 6 and rep.bad_frame_names == []
    e = np.array(doc.extrinsics.essential_matrix)
    assert np.allclose(np.linalg.svd(e)[1][0], np.linalg.svd(e)[1][1], rtol=1e-3)


def test_spatial_phase_of_several_recordings(spark):
    """A second recording of cameras whose pictures are half as large gets cameras of its own, and the same extrinsics."""
    v = spatial.synthetic_views(spark, 8).withColumns({"width": F.lit(1920), "height": F.lit(1080)})
    half = v.withColumns({c: F.col(c) / 2 for c in ("xa", "ya", "xb", "yb")}).withColumn("dataset", F.lit("half"))
    both = v.withColumn("dataset", F.lit("full")).unionByName(half)
    twice = both.withColumn("frame", (F.col("frame") * 10 + 3).cast("long")).unionByName(both.withColumn("frame", (F.col("frame") * 10).cast("long")))
    side = lambda a, b: twice.select("dataset", "frame", "corner_id", F.col(a).alias("x"), F.col(b).alias("y"), "width", "height")
    got = phases.spatial(side("xb", "yb"), side("xa", "ya"), count=6)
    docs, reports = {r.meta.dataset: r for r in got.document.collect()}, {r.dataset: r for r in got.report.collect()}
    assert {r.dataset: r["count"] for r in got.picked.groupBy("dataset").count().collect()} == {"full": 6, "half": 6}
    for name, focal in (("full", 1500), ("half", 750)):
        assert docs[name].sony_camera.camera_matrix[0][0] == pytest.approx(focal, abs=3)
        assert np.allclose(docs[name].extrinsics.translation_cm, spatial.CENTIMETRES, atol=0.1)
        assert reports[name].overall_mean_px < 0.05
    with pytest.raises(InsufficientDataError):
        phases.spatial(side("xb", "yb"), side("xa", "ya"), count=9)


def test_filtering_phase(spark):
    rows = [("d", k, *[None if (i == 0 and k == 4) else float(k + i) for i in range(114)]) for k in range(10)]
    df = spark.createDataFrame(rows, "dataset string, " + schemas.SKELETON)
    got = phases.filtering(df).orderBy("frame_idx").collect()
    assert [r.frame_idx for r in got] == [0, 1, 2, 3, 5, 6, 7, 8, 9] and got[0].filtered == got[0].raw and got[1].filtered < got[1].raw
    assert got[0].expansiveness > 0


def test_summary_document(spark):
    rows = [("d", "sony", "b", "ok", 4, 50), ("d", "sony", "a", "unreadable", None, 0), ("d", "zed", "a", "ok", 5, 60)]
    r = calibration.summary(spark.createDataFrame(rows, "dataset string, camera string, file string, status string, n_markers int, n_corners int")).first()
    assert [x.file for x in r.sony] == ["a", "b"] and len(r.zed) == 1


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.json").write_text(json.dumps({str(k): k + k % 3 for k in range(1, 60)}))
    cli.main(["smooth-mapping", str(tmp_path / "a.json"), str(tmp_path / "s"), "--dataset", "d", "--window", "11"])
    part = next((tmp_path / "s" / "dataset=d").glob("part*"))
    cli.main(["compare-mappings", str(tmp_path / "a.json"), str(part), str(tmp_path / "log")])
    assert "of 59 frames changed" in capsys.readouterr().out
    doc = {"meta": {"dataset": "d"}, "extrinsics": {"rotation_matrix_3x3": [[1, 0, 0], [0, 1, 0], [0, 0, 1]], "translation_metres": [1, 2, 3], "rotation_degrees": [0.5, 1, 2]}, "ue5_offset": {"X_cm": 100, "Y_cm": 200, "Z_cm": 300}}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    cli.main(["lens-offset", str(tmp_path / "c.json")])
    cli.main(["transform-point", str(tmp_path / "c.json"), "--point", "0", "0", "1"])
    out = capsys.readouterr().out
    assert "Location X : +100.000 cm" in out and "Roll  (X) : +0.500°" in out and out.strip().endswith("+1.000000 +2.000000 +4.000000")


def test_programs_over_tables(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    read = lambda name: [json.loads(x) for f in sorted((tmp_path / name).rglob("part*.json")) for x in f.read_text().splitlines()]
    x = np.cumsum(np.random.default_rng(0).normal(size=(40, 6)), 0)
    for name, v in (("a", x[3:33]), ("b", x)):
        spark.createDataFrame([("d", k, r.tolist()) for k, r in enumerate(v)], "dataset string, frame_idx long, vec array<float>").write.parquet(at(name))
    for out, more in (("exact", []), ("fast", ["--fast", "1"])):
        cli.main(["sync-frames", at("a"), at("b"), at(out), *more])
        m = json.loads(next((tmp_path / out / "dataset=d").glob("part*")).read_text())
        assert len(m) == 30 and m["10"] == 13
    for folder, n in (("sony", 30), ("rgb", 40), ("depth", 40)):
        (tmp_path / folder).mkdir()
        for k in range(n):
            (tmp_path / folder / f"{folder}{k:03d}.png").write_bytes(b"x")
    cli.main(["compile-dataset", str(next((tmp_path / "exact" / "dataset=d").glob("part*"))), at("sony"), at("rgb"), at("depth"), at("copies")])
    copies = {r.dst: r.src.split("/")[-1] for r in spark.read.option("header", True).csv(at("copies")).collect()}
    assert len(copies) == 90 and copies["synced/zed_depth/00010.png"] == "depth012.png" and copies["synced/sony_rgb/00010.png"] == "sony009.png"

    rows = [("d", "sony", "1.png", 20, 60), ("d", "zed", "1.png", 2, 60), ("d", "zed", "2.png", None, None)]
    spark.createDataFrame(rows, "dataset string, camera string, file string, n_markers int, n_corners int").write.parquet(at("detections"))
    cli.main(["inspect-detections", at("detections"), at("summary")])
    assert [r["status"] for r in read("summary")[0]["zed"]] == ["rejected_no_markers", "unreadable"]
    spark.createDataFrame([(k, f"dict{k}", "p", "f", 9, n) for k, n in enumerate((3, 8, 8))], "ordinal int, dict_name string, params string, frame string, n_markers int, n_corners int").write.parquet(at("grid"))
    cli.main(["diagnose-detection", at("grid"), at("best")])
    assert read("best")[0]["dict_name"] == "dict1"
    assert "d zed unreadable 1" in capsys.readouterr().out

    v = spatial.synthetic_views(spark, 8).withColumns({"width": F.lit(1920), "height": F.lit(1080)})
    twice = v.withColumn("frame", (F.col("frame") * 10 + 3).cast("long")).unionByName(v.withColumn("frame", (F.col("frame") * 10).cast("long")))
    for name, c in (("sony_c", "b"), ("zed_c", "a")):
        twice.select("dataset", "frame", "corner_id", F.col(f"x{c}").alias("x"), F.col(f"y{c}").alias("y"), "width", "height").write.parquet(at(name))
    cli.main(["pick-frames", at("sony_c"), at("picks"), "--count", "5"])
    assert sorted(r["pick"] for r in read("picks")) == [1, 2, 3, 4, 5]
    cli.main(["calibrate-stereo", at("sony_c"), at("zed_c"), at("solved"), "--count", "6"])
    cli.main(["validate-calibration", at("sony_c"), at("zed_c"), at("solved/calibration"), at("report")])
    assert read("report")[0]["n_frames_validated"] == 16 and read("report")[0]["assessment"] == "Excellent"
