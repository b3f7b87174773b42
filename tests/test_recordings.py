"""The data source of detector and tracker files."""
import pytest
from pyspark.sql import functions as F

from framelark import schemas
from framelark.sources import recordings, tables


@pytest.fixture(scope="module")
def read(spark):
    recordings.register(spark)
    return lambda kind, path, **names: spark.read.format("recordings").options(kind=kind, **names).load(str(path))


@pytest.fixture
def detections(tmp_path):
    for d in range(3):
        for camera in ("sony", "zed"):
            (tmp_path / f"d{d}").mkdir(exist_ok=True)
            rows = "".join(f"{k:05d}.png,{k % 7},{k + d}.5,{'nan' if k == 3 else k}\n" for k in range(20))
            (tmp_path / f"d{d}" / f"{camera}.csv").write_text("frame,corner_id,x,y,\n".replace(",\n", "\n") + rows)
    (tmp_path / "d0" / "notes.txt").write_text("no")
    (tmp_path / "stray.csv").write_text("a,b\n1,2\n")
    return tmp_path


def test_corners(read, detections):
    df = read("corners", detections)
    assert tables.decoded(df, "corners").columns == df.columns
    assert df.count() == 120 and df.rdd.getNumPartitions() == 6
    r = df.where("dataset = 'd1' AND camera = 'zed' AND corner_id = 2").orderBy("frame").first()
    assert tuple(r) == ("d1", "zed", "00002.png", 2, 3.5, 2.0)
    assert df.where("y IS NULL").count() == 6
    assert read("corners", f"file://{detections}").count() == 120


def test_names_leave_out_files(read, detections):
    (detections / "d2" / "zed.csv").write_text("broken")  # fails if it is opened
    some = read("corners", detections, dataset="d1,d0", camera="zed")
    assert some.rdd.getNumPartitions() == 2 and some.count() == 40
    assert read("corners", detections, dataset="d9").count() == 0
    with pytest.raises(Exception, match="Empty CSV"):
        read("corners", detections).count()


def test_a_filter_stays_with_its_query(read, detections):
    df = read("corners", detections)
    assert df.where((F.col("dataset") == "d1") & F.col("camera").isin("zed", "sony")).count() == 40
    assert df.where("dataset = 'd9'").count() == 0
    assert df.where("dataset = 'd0' AND x > 10").count() == 20
    assert df.count() == 120


def test_skeletons(spark, read, tmp_path):
    columns = schemas.SKELETON.replace(" BIGINT", "").replace(" DOUBLE", "").split(", ")
    (tmp_path / "walk.csv").write_text(",".join([*columns, "extra"]) + "\n" + ",".join(["7", "nan", *["0.5"] * 113, "x"]) + "\n")
    df = read("skeleton", tmp_path)
    r = df.first()
    assert (r.dataset, r.frame_idx, r.pelvis_x, r.pelvis_y) == ("walk", 7, None, 0.5)


def test_what_is_not_there(read, tmp_path):
    assert read("corners", tmp_path).count() == 0
    with pytest.raises(Exception, match="none of corners"):
        read("video", tmp_path)
    with pytest.raises(Exception, match="no folder"):
        read("corners", tmp_path / "none").count()
