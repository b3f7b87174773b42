"""Hand-made cases and properties of the operators."""
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelark import schemas
from framelark.errors import InsufficientDataError, MissingInputError
from framelark.functions import columns, geometry
from framelark.operators import align, movement, quality, report, series, solvers
from framelark.plans import spatial
from framelark.sources import sinks, tables

NAN = float("nan")


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expr.alias("v")).first()["v"]


def euro(values, times=None):
    f, out = None, []
    for t, x in zip(times or [k / 30 for k in range(len(values))], values, strict=True):
        f, y = series.filter_row(f, t, x)
        out.append(y)
    return out


def test_one_euro_cases():
    assert euro([5.0]) == [5.0]
    assert euro([3.0] * 9) == pytest.approx([3.0] * 9)
    gap = euro([1.0, NAN, 2.0])
    assert gap[0] == 1.0 and math.isnan(gap[1]) and gap[2] == euro([1.0, 2.0], [0, 2 / 30])[1]
    start = euro([NAN, 5.0, 6.0])
    assert math.isnan(start[0]) and start[1] == 5.0 and 5 < start[2] < 6
    same = euro([1.0, 9.0, 2.0], [0.0, 0.0, 1.0])
    assert same[1] == 9.0 and same[2] == euro([1.0, 2.0], [0.0, 1.0])[1]


def test_one_euro_forms_agree(spark):
    rng = np.random.default_rng(0)
    data = [(int(k % 3), k, k / 30, None if k % 7 == 0 else float(rng.normal())) for k in range(200)]
    df = spark.createDataFrame(data, "key int, id long, t double, x double")
    a = series.one_euro(df, ["key"], ["t", "id"], F.col("t"), F.col("x")).orderBy("id").toPandas()["filtered"]
    b = series.one_euro_fold(df, ["key"], ["t", "id"], F.col("t"), F.col("x"), ["id"]).orderBy("id").toPandas()["filtered"]
    assert a.isna().tolist() == b.isna().tolist()
    assert np.array_equal(a.dropna(), b.dropna())


def test_savgol_reproduces_a_parabola_and_needs_a_window(spark):
    df = spark.range(400).select((F.col("id") + 1).alias("sony_idx"), (F.col("id") * F.col("id") - 7 * F.col("id") + 3).alias("zed_idx"))
    s = series.savgol(df, "sony_idx", "zed_idx", 51).toPandas()
    assert np.abs(s["smooth"] - s["zed_idx"]).max() < 1e-5
    with pytest.raises(InsufficientDataError):
        series.savgol(df.limit(20), "sony_idx", "zed_idx", 51)


def test_chunked_orders_match_plain_ones(spark):
    df = spark.range(1000).select((F.col("id") * 3).alias("k"), F.pmod(F.hash("id"), F.lit(500)).cast("long").alias("v"))
    got = series.running_max(series.numbered(df, "k", "n", 1), "k", "v", "top", 1).orderBy("k").toPandas()
    assert got["n"].tolist() == list(range(1, 1001))
    assert got["top"].tolist() == np.maximum(1, got["v"].cummax()).tolist()


def test_repaired_mapping_never_falls(spark):
    df = spark.range(300).select((F.col("id") + 1).alias("sony_idx"), (F.col("id") + F.pmod(F.hash("id"), F.lit(40)) - 30).alias("zed_idx"))
    z = series.smooth_mapping(df, 51).orderBy("sony_idx").toPandas()["zed_smooth"]
    assert z.is_monotonic_increasing and z.min() >= 1


def test_rounding_and_names(spark):
    df = spark.createDataFrame([(0.5,), (2.5,), (1.4,), (1.5,)], ["x"])
    assert [r[0] for r in df.select(columns.half_even(F.col("x"))).collect()] == [0, 2, 1, 2]
    assert one(spark, columns.frame_name(F.lit(7))) == "00007.png"
    assert one(spark, columns.frame_name(F.lit(123456))) == "123456.png"
    assert one(spark, columns.stem(F.lit("a/b/00012.x.png"))) == "00012"
    assert one(spark, columns.title(F.lit("right_wrist"))) == "Right Wrist"
    assert one(spark, columns.is_image(F.lit("A.JPG"))) is True


def test_path_to_mapping_takes_the_last(spark):
    path = spark.createDataFrame([("d", 0, 0), ("d", 0, 1), ("d", 1, 2)], "dataset string, i long, j long")
    assert sorted((r.sony_idx, r.zed_idx) for r in align.frame_mapping(path, ["dataset"]).collect()) == [(1, 2), (2, 3)]


def test_manifest_drops_places_past_the_listing(spark):
    m = spark.createDataFrame([("d", 1, 1), ("d", 2, 9)], "dataset string, sony_idx long, zed_idx long")
    files = lambda *names: spark.createDataFrame([("d", n) for n in names], "dataset string, path string")
    got = align.sync_manifest(m, files("b", "a"), files("z"), files("q"), ["dataset"]).collect()
    assert [(r.name, r.sony_path, r.zed_rgb_path) for r in got] == [("00001.png", "a", "z")]


def test_missing_smoothed_frame_fails(spark):
    raw = spark.createDataFrame([(1, 1), (2, 2)], "sony_idx long, zed_idx long")
    smooth = spark.createDataFrame([(1, 1)], "sony_idx long, zed_smooth long")
    with pytest.raises(Exception, match="not in the smoothed mapping"):
        align.compare_mappings(raw, smooth).collect()


def test_detection_statuses(spark):
    df = spark.createDataFrame([(None, None), (3, 60), (4, 44), (4, 45), (None, 50)], "n_markers int, n_corners int")
    got = [(r.status, r.n_markers, r.n_corners) for r in quality.classify_detections(df).collect()]
    assert got == [("unreadable", None, 0), ("rejected_no_markers", 0, 0), ("rejected_few_corners", 4, 44), ("ok", 4, 45), ("rejected_no_markers", 0, 0)]


def test_best_variant_prefers_the_first_and_never_zero(spark):
    df = spark.createDataFrame([("a", 0, 50), ("a", 1, 50), ("b", 0, 0), ("b", 1, 0)], "f string, try_order int, n_corners int")
    assert [(r.f, r.try_order) for r in quality.best_variant(df, ["f"]).collect()] == [("a", 0)]


def test_motion_gate_cases(spark):
    base = [(k, float(10 * k), 0.0) for k in range(6)]
    move = lambda dx, n=6: [(k, x + dx, y) for k, x, y in base[:n]]
    shots = {1: base, 4: move(1.5), 2: base, 5: move(1.5001), 3: base, 6: move(0.0, 5)}
    c = spark.createDataFrame([("d", f, *p) for f, ps in shots.items() for p in ps], "dataset string, frame long, corner_id int, x double, y double")
    frames = spark.createDataFrame([("d", f) for f in [*shots, 7]], "dataset string, frame long")
    still = {r.frame for r in quality.motion_gate(frames, c, ["dataset"]).where("still").collect()}
    assert still == {4}


def test_features_of_flat_clouds_and_constant_columns(spark):
    c = spark.createDataFrame([("a", 0.0, 5.0, 100, 50), ("a", 10.0, 5.0, 100, 50)], "name string, x double, y double, width int, height int")
    assert quality.frame_features(c, ["name"]).first()["aspect"] == pytest.approx(1e7)
    n = quality.normalised(spark.createDataFrame([(1, 3.0, 1.0), (2, 3.0, 2.0)], "id int, a double, b double"), ("a", "b")).orderBy("id").collect()
    assert [(r.a, r.b) for r in n] == [(0.0, 0.0), (0.0, 1.0)]


def test_grades(spark):
    df = spark.createDataFrame([(1.49,), (1.5,), (2.5,), (2.79,), (2.8,)], ["m"])
    assert [r[0] for r in df.select(report.grade(F.col("m"))).collect()] == ["good", "warn", None, None, "bad"]
    df = spark.createDataFrame([(0.49,), (0.5,), (1.8,), (2.5,)], ["m"])
    assert [r[0] for r in df.select(report.assessment(F.col("m"))).collect()] == ["Excellent", "Good", "Acceptable", "Poor"]


def test_histogram_against_numpy(spark):
    x = np.random.default_rng(2).exponential(size=500)
    got = {r.bin: r.n for r in report.histogram(spark.createDataFrame([(float(v),) for v in x], ["error"])).collect()}
    want = np.histogram(x, 40)[0]
    assert [got.get(k, 0) for k in range(40)] == want.tolist()
    same = report.histogram(spark.createDataFrame([(2.0,)] * 3, ["error"])).collect()
    assert [(r.bin, r.n) for r in same] == [(20, 3)]


def test_wrist_rule(spark):
    df = spark.createDataFrame([(NAN, 1.0), (2.0, NAN), (1.0, 3.0), (3.0, 1.0)], "l double, r double")
    got = [r[0] for r in df.select(movement.larger(F.col("l"), F.col("r"))).collect()]
    assert math.isnan(got[0]) and got[1:] == [2.0, 3.0, 3.0]


def test_rotation_vectors(spark):
    v = np.array([0.3, -0.8, 0.5])
    r = solvers.rotation(v)
    assert np.allclose(r @ r.T, np.eye(3)) and np.allclose(solvers.rodrigues(r), v)
    col = [[one(spark, c) for c in row] for row in geometry.rotation_of(v.tolist())]
    assert np.allclose(col, r)
    assert np.allclose([one(spark, c) for c in geometry.vector_of([[F.lit(float(x)) for x in row] for row in r])], v)


def test_projection_matches_numpy(spark):
    p = np.array([[0.1, -0.2, 1.5]])
    want = solvers.projected(p, np.eye(3), np.zeros(3), np.array(spatial.K), np.array(spatial.D))[0]
    u, v = geometry.project([F.lit(float(x)) for x in p[0]], spatial.K, spatial.D)
    assert np.allclose([one(spark, u), one(spark, v)], want)


def test_solvers_recover_what_made_the_views(spark):
    row = spatial.stereo_calibrate(spark, "/root/testdata/sf0.001").first()
    assert np.allclose([row.r0, row.r1, row.r2], spatial.DEGREES, atol=1e-2) and np.allclose([row.t0, row.t1, row.t2], spatial.CENTIMETRES, atol=1e-2)
    row = spatial.calibrate_camera(spark, "/root/testdata/sf0.001").first()
    assert row.fx == pytest.approx(1500, abs=1) and row.cx == pytest.approx(960, abs=1) and row.rms < 0.01
    assert max(r.rms for r in spatial.pose_solve(spark, "/root/testdata/sf0.001").collect()) < 0.01


def test_solvers_get_every_row_in_many_recordings(spark):
    folder, n = "/root/testdata/sf0.01", spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").count()
    poses = spatial.pose_solve(spark, folder).toPandas()
    assert len(poses) == poses["frame"].nunique() == n and poses["rms"].max() < 0.01
    cameras = spatial.calibrate_camera(spark, folder).toPandas()
    assert cameras["n_views"].sum() == n and len(cameras) == n // spatial.VIEWS and cameras["n_views"].min() >= spatial.VIEWS
    assert (cameras["fx"] - 1500).abs().max() < 1 and (cameras["cx"] - 960).abs().max() < 1 and cameras["rms"].max() < 0.01
    pairs = spatial.stereo_calibrate(spark, folder).toPandas()
    assert len(pairs) == len(cameras)
    assert np.allclose(pairs[["r0", "r1", "r2"]], spatial.DEGREES, atol=1e-2) and np.allclose(pairs[["t0", "t1", "t2"]], spatial.CENTIMETRES, atol=1e-2)


def test_solvers_find_the_least_error_by_exact_slopes():
    """Noisy views: no step lowers the error, and slopes agree with differences; many views cost in proportion."""
    rng = np.random.default_rng(9)
    board = np.array([((i % 10 + 1) * 0.028, (i // 10 + 1) * 0.028, 0.0) for i in range(70)])
    k, d = np.array(spatial.K), np.array(spatial.D)

    def views(n):
        poses = [(solvers.rotation(rng.uniform(-0.5, 0.5, 3)), np.array([*rng.uniform(-0.2, 0.0, 2), rng.uniform(0.6, 1.0)])) for _ in range(n)]
        return [(board, solvers.projected(board, r, t, k, d) + rng.normal(scale=0.3, size=(70, 2))) for r, t in poses]

    for v in (np.zeros(3), np.array([1e-8, 0, 0]), np.array([0.3, -0.8, 0.5])):
        (r,), (slopes,) = solvers.turns(v[None])
        assert np.allclose(r, solvers.rotation(v), atol=1e-12)
        for c in range(3):
            step = np.eye(3)[c] * 1e-5
            assert np.allclose(slopes[c], (solvers.rotation(v + step) - solvers.rotation(v - step)) / 2e-5, atol=1e-6)
    some = views(10)
    found, bent, rms, poses = solvers.camera(some)

    def error(x):
        kk = np.array([[x[0], 0, x[2]], [0, x[1], x[3]], [0, 0, 1]])
        e = np.concatenate([(solvers.projected(b, solvers.rotation(p[:3]), p[3:], kk, x[4:9]) - s).ravel() for (b, s), p in zip(some, x[9:].reshape(-1, 6), strict=True)])
        return float(np.sqrt(2 * (e * e).mean()))

    x = np.concatenate([[found[0, 0], found[1, 1], found[0, 2], found[1, 2]], bent, *poses])
    assert error(x) == pytest.approx(rms, abs=1e-12) and 0.35 < rms < 0.45
    for c in range(len(x)):
        assert min(error(x + np.eye(len(x))[c] * s * max(1, abs(x[c]))) for s in (-1e-5, 1e-5)) > rms - 1e-9
    many = views(100)  # by differences of all parameters: 609 projections of all views a round
    began = time.process_time()
    assert solvers.camera(many)[0][0, 0] == pytest.approx(1500, abs=5)
    assert time.process_time() - began < 15


def test_stereo_of_many_views_costs_in_proportion():
    """Poses of all views together are those of each alone; by differences 90 views took minutes."""
    rng = np.random.default_rng(10)
    board = np.array([((i % 10 + 1) * 0.028, (i // 10 + 1) * 0.028, 0.0) for i in range(70)])
    lens = np.array(spatial.K), np.array(spatial.D)
    views = []
    for _ in range(90):
        r, t = solvers.rotation(rng.uniform(-0.5, 0.5, 3)), np.array([*rng.uniform(-0.2, 0.0, 2), rng.uniform(0.6, 1.0)])
        a, b = solvers.projected(board, r, t, *lens), solvers.projected(board, np.array(spatial.R) @ r, np.array(spatial.R) @ t + np.array(spatial.T), *lens)
        views.append((board, a + rng.normal(scale=0.2, size=a.shape), b + rng.normal(scale=0.2, size=b.shape)))
    poses = solvers.board_poses([(b, s) for b, s, _ in views], *lens)[0]
    for k in (0, 44, 89):
        assert np.allclose(poses[k], np.concatenate(solvers.board_pose(*views[k][:2], *lens)[:2]), atol=1e-5)
    began = time.process_time()
    s = solvers.stereo(views, lens, lens)
    assert np.allclose(s["R"], spatial.R, atol=1e-3) and np.allclose(s["T"], spatial.T, atol=1e-3) and 0.2 < s["rms"] < 0.35
    assert time.process_time() - began < 15


def test_table_views_match_the_numpy_projection(spark):
    v = spatial.table_views(spark, "/root/testdata/sf0.001", "dataset", "frame").where("frame = 7").orderBy("corner_id").toPandas()
    p = v[["bx", "by", "bz"]].to_numpy()
    r, t, rms = solvers.board_pose(p, v[["xa", "ya"]].to_numpy(), np.array(spatial.K), np.array(spatial.D))
    r = np.array(spatial.R) @ solvers.rotation(r)
    b = solvers.projected(p, r, np.array(spatial.R) @ t + np.array(spatial.T), np.array(spatial.K), np.array(spatial.D))
    assert len(v) == 70 and rms < 1e-4 and np.allclose(b, v[["xb", "yb"]].to_numpy(), atol=1e-3)


def test_json_and_csv_round_trips(spark, tmp_path):
    m = spark.createDataFrame([("d", k, k + 1) for k in (2, 10, 1)], "dataset string, sony_idx long, zed_idx long")
    text = m.groupBy("dataset").agg(sinks.mapping_object("sony_idx", "zed_idx").alias("j")).first()["j"]
    assert text == '{"1":2,"2":3,"10":11}'
    (tmp_path / "m.json").write_text(text)
    assert sorted(tuple(r) for r in tables.mapping_json(spark, str(tmp_path / "m.json")).collect()) == [(1, 2), (2, 3), (10, 11)]
    wide = spark.createDataFrame([tuple([k, *[None if k == 1 else float(k + i) for i in range(114)]]) for k in range(3)], schemas.SKELETON)
    sinks.write_skeleton(wide, str(tmp_path / "s"))
    back = tables.skeleton_csv(spark, str(tmp_path / "s"))
    assert back.orderBy("frame_idx").collect() == wide.orderBy("frame_idx").collect()
    assert quality.root_filter(back).count() == 2
    doc = {"meta": {"dataset": "d", "valid_pairs_used": 36, "timestamp": "t"}, "ue5_offset": {"X_cm": 1.0, "Y_cm": 2.0, "Z_cm": 3.0}}
    (tmp_path / "c.json").write_text(__import__("json").dumps(doc, indent=1))
    assert tables.calibration_json(spark, str(tmp_path / "c.json")).select("meta.valid_pairs_used", "ue5_offset.Z_cm").first() == (36, 3.0)


def test_listing_and_guards(spark, tmp_path):
    for n in ("b.png", "a.PNG", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert sorted(r.name for r in tables.listing(spark, str(tmp_path)).collect()) == ["a.PNG", "b.png"]
    assert tables.first_file(spark, str(tmp_path), "*.txt").endswith("c.txt")
    with pytest.raises(MissingInputError):
        tables.first_file(spark, str(tmp_path), "*.mp4")
    with pytest.raises(TypeError):
        tables.decoded(spark.range(1), "features")
    with pytest.raises(ValueError):
        movement.joint_column("tail", "x")


def test_dataset_overwrite_keeps_others(spark, tmp_path):
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    path = str(tmp_path / "t")
    sinks.write_dataset(spark.createDataFrame([("a", 1), ("b", 2)], "dataset string, v int"), path)
    sinks.write_dataset(spark.createDataFrame([("b", 3)], "dataset string, v int"), path)
    assert sorted((r.dataset, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]


def test_stream_equals_batch(spark, tmp_path):
    from framelark.streaming.one_euro import one_euro_stream

    rng = np.random.default_rng(4)
    data = [(int(k % 2), k, k / 30, float(rng.normal())) for k in range(60)]
    df = spark.createDataFrame(data, "key int, id long, t double, x double")
    for k in range(3):
        df.where((F.col("id") >= 20 * k) & (F.col("id") < 20 * k + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = one_euro_stream(src, "key").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.id: r.filtered for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.id: r.filtered for r in series.one_euro(df, ["key"], ["t", "id"], F.col("t"), F.col("x")).collect()}
    assert got == want


def test_plans_have_no_product_and_prune_columns(spark):
    from framelark.plans import temporal

    plan = temporal.monotone_mapping(spark, "/root/testdata/sf0.01")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "o_totalprice" not in plan.split("Physical Plan")[-1]
