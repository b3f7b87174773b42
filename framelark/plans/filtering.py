"""Phase 3 and 4: skeleton smoothing and movement descriptors; queries over the test tables with their SQL."""
from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.columns import output_curve
from ..operators import movement, quality, series
from ..scratch import new_folder
from ..sources import sinks, tables
from ._common import table

JOINTS = ("pelvis", "spine_2", "left_wrist", "right_wrist")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return table(spark, sf_dir, "events").select("user_id", "event_id", seconds.alias("t"), "value")


def one_euro_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every user's signal, in time order."""
    return series.one_euro(signals(spark, sf_dir), ["user_id"], ["t", "event_id"], F.col("t"), F.col("value")).select("user_id", "event_id", F.round("filtered", 6).alias("filtered"))


def one_euro_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.one_euro_fold(signals(spark, sf_dir), ["user_id"], ["t", "event_id"], F.col("t"), F.col("value"), ["event_id"]).select("user_id", "event_id", F.round("filtered", 6).alias("filtered"))


def one_euro_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 11th value is lost."""
    s = signals(spark, sf_dir).withColumn("value", F.when(F.col("event_id") % 11 != 0, F.col("value")))
    return series.one_euro(s, ["user_id"], ["t", "event_id"], F.col("t"), F.col("value")).select("user_id", "event_id", F.round("filtered", 6).alias("filtered"))


def event_time_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", movement.frame_time(F.col("event_id")).alias("t"))


def skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four joints in millimetres from a vector's first components; small pelvis_x and wrist values are lost."""
    at = lambda k: F.col("embedding")[k].cast("double") * 1000.0
    names = [f"{j}_{a}" for j in JOINTS for a in "xyz"]
    gone = {"pelvis_x": 10.0, "left_wrist_x": 5.0, "right_wrist_x": 5.0}
    value = lambda k, n: F.when(F.abs(at(k)) >= gone[n], at(k)) if n in gone else at(k)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_idx"), F.col("label"), *[value(k, n).alias(n) for k, n in enumerate(names)])


def root_joint_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.root_filter(skeleton(spark, sf_dir)).select("frame_idx", "pelvis_x")


def first_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.first_body(skeleton(spark, sf_dir).select("label", "frame_idx", "spine_2_x"), ["label"], "frame_idx")


def joint_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton(spark, sf_dir).select("frame_idx", F.col(movement.joint_column("right_wrist", "y")).alias("value"))


def expansiveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = movement.expansiveness(movement.point("spine_2"), movement.point("left_wrist"), movement.point("right_wrist"))
    return skeleton(spark, sf_dir).select("frame_idx", F.round(e, 6).alias("expansiveness"))


def joints_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return movement.to_long(skeleton(spark, sf_dir), ["frame_idx"], JOINTS)


def joints_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return movement.to_wide(movement.to_long(skeleton(spark, sf_dir), ["frame_idx"], JOINTS), ["frame_idx"], JOINTS)


def _moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["left_wrist_y", "left_wrist_z", "right_wrist_y", "right_wrist_z"]
    return movement.differences(skeleton(spark, sf_dir), ["label"], "frame_idx", names)


def movement_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lambda side: [F.col(f"v_{side}_wrist_{a}") for a in "yz"]
    m = _moving(spark, sf_dir)
    a = [F.col(f"a_left_wrist_{x}") for x in "yz"]
    return m.select("frame_idx", F.round(movement.effort([(v("left"), 2.0), (v("right"), 1.0)]), 5).alias("effort"), F.round(movement.weight(a), 4).alias("weight"))


def movement_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = movement.flow(_moving(spark, sf_dir), ["label"], "frame_idx", "v_left_wrist_y", 5)
    return f.select("frame_idx", F.round("flow", 5).alias("flow"))


def movement_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = movement.direction(movement.point("spine_2"), movement.point("left_wrist"), movement.point("right_wrist"))
    s = skeleton(spark, sf_dir).where("left_wrist_x IS NOT NULL AND right_wrist_x IS NOT NULL")
    return s.select("frame_idx", d.alias("d")).select("frame_idx", *[F.round(f"d.{a}", 6).alias(a) for a in "xyz"])


def action_drives(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    d = movement.drive_distances(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10)
    return l.select("l_orderkey", "l_linenumber", d.alias("d")).select("l_orderkey", "l_linenumber", *[F.round(f"d.{n}", 6).alias(n) for n in ("punch", "wring", "float")])


def effort_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight drives, with flow; every 13th order has lost its flow."""
    l = table(spark, sf_dir, "lineitem")
    flow = F.when(F.col("l_orderkey") % 13 != 0, F.col("l_linenumber") / 7)
    d = movement.effort_distances(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10, flow)
    return l.select("l_orderkey", "l_linenumber", d.alias("d")).select("l_orderkey", "l_linenumber", *[F.round(f"d.{n}", 6).alias(n) for n in movement.EFFORTS])


def skeleton_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a frame of all 38 joints, some lost, written as wide CSV files and read back."""
    path = new_folder(spark, "skeletons")
    value = lambda k: F.when((F.col("vec_id") + k) % 11 != 0, F.element_at("embedding", k % 64 + 1).cast("double"))
    columns = [c.split(" ")[0] for c in schemas.SKELETON.split(", ")]
    sinks.write_skeleton(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_idx"), *[value(k).alias(c) for k, c in enumerate(columns[1:])]), path)
    read = tables.skeleton_csv(spark, path)
    seen = [F.when(F.col(c).isNull(), 0).otherwise(1) for c in columns[1:]]
    return read.select("frame_idx", reduce(add, seen).cast("long").alias("n_seen"), F.round(reduce(add, [F.coalesce(c, F.lit(0.0)) for c in columns[1:]]), 6).alias("total"), F.round("pelvis_x", 6).alias("pelvis_x"))


def response_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_quantity") / 50
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(output_curve(x, 0.1, 0.9, k), 6).alias(k) for k in ("linear", "sigmoid", "piecewise")])


def performer_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = skeleton(spark, sf_dir)
    b = s.select((F.col("frame_idx") - 1).alias("frame_idx"), *[F.col(f"spine_2_{a}").alias(f"b_{a}") for a in "xyz"])
    p = movement.proximity(movement.point("spine_2"), [F.col(f"b_{a}") for a in "xyz"], 600.0)
    return s.join(b, "frame_idx").select("frame_idx", F.round(p, 6).alias("proximity"))


def mode_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "compositing").when(F.col("role") == "assistant", "interactive").alias("mode"))
    return movement.in_mode(c, "interactive").select("conv_id", "turn")


_EURO = """s AS (SELECT user_id, event_id, epoch_us(ts) / 1e6::DOUBLE AS t, {value} AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, event_id, k, t AS tp, x AS xp, 0::DOUBLE AS dp, x AS y FROM s WHERE k = 1
UNION ALL SELECT user_id, event_id, k, CASE WHEN x IS NULL OR (xp IS NOT NULL AND e <= 0) THEN tp ELSE t END, CASE WHEN x IS NULL OR (xp IS NOT NULL AND e <= 0) THEN xp WHEN xp IS NULL THEN x ELSE z END, CASE WHEN x IS NULL OR xp IS NULL OR e <= 0 THEN dp ELSE d END, CASE WHEN x IS NULL THEN NULL WHEN xp IS NULL OR e <= 0 THEN x ELSE z END
FROM (SELECT *, a * x + (1 - a) * xp AS z FROM (SELECT *, r / (r + 1) AS a FROM (SELECT *, 2 * pi() * (1 + 0.05::DOUBLE * abs(d)) * e AS r FROM
(SELECT *, ad * ((x - xp) / e) + (1 - ad) * dp AS d FROM (SELECT s.user_id, s.event_id, s.k, s.t, s.x, f.tp, f.xp, f.dp, nullif(s.t - f.tp, 0) AS e, (2 * pi() * (s.t - f.tp)) / (2 * pi() * (s.t - f.tp) + 1) AS ad FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.k + 1))))))"""
_EURO_SQL = "WITH RECURSIVE " + _EURO + " SELECT user_id, event_id, round(y, 6) AS filtered FROM f"
_NAMES = [f"{j}_{a}" for j in JOINTS for a in "xyz"]
_LOST = {"pelvis_x": 10, "left_wrist_x": 5, "right_wrist_x": 5}
_SK = "s AS (SELECT vec_id AS frame_idx, label, " + ", ".join(
    (f"CASE WHEN abs(embedding[{k}]::DOUBLE * 1000) >= {_LOST[n]} THEN embedding[{k}]::DOUBLE * 1000 END" if n in _LOST else f"embedding[{k}]::DOUBLE * 1000") + f" AS {n}" for k, n in enumerate(_NAMES, 1)
) + " FROM embeddings)"
_LEN = lambda a, b: "sqrt(" + " + ".join(f"({a}_{x} - {b}_{x}) * ({a}_{x} - {b}_{x})" for x in "xyz") + ")"
_L, _R = _LEN("spine_2", "left_wrist"), _LEN("spine_2", "right_wrist")
_MOVE = _SK + ", q AS (SELECT *, (frame_idx - lag(frame_idx) OVER w) * (1.0::DOUBLE / 30) AS dt, " + ", ".join(f"{n} - lag({n}) OVER w AS d_{n}" for n in ("left_wrist_y", "left_wrist_z", "right_wrist_y", "right_wrist_z")) + " FROM s WINDOW w AS (PARTITION BY label ORDER BY frame_idx)), v AS (SELECT *, " + ", ".join(f"d_{n} / dt AS v_{n}" for n in ("left_wrist_y", "left_wrist_z", "right_wrist_y", "right_wrist_z")) + " FROM q), m AS (SELECT *, (v_left_wrist_y - lag(v_left_wrist_y) OVER w) / dt AS a_y, (v_left_wrist_z - lag(v_left_wrist_z) OVER w) / dt AS a_z, v_left_wrist_y - lag(v_left_wrist_y) OVER w AS dv FROM v WINDOW w AS (PARTITION BY label ORDER BY frame_idx))"
_DIR = ", ".join(f"round((CASE WHEN r > l THEN right_wrist_{a} ELSE left_wrist_{a} END - spine_2_{a}) / nullif(greatest(l, r), 0), 6) AS {a}" for a in "xyz")
_DRIVE = lambda t, w, s: f"round(sqrt((l_quantity / 50 - {t}) * (l_quantity / 50 - {t}) + (l_discount * 10 - {w}) * (l_discount * 10 - {w}) + (l_tax * 10 - {s}) * (l_tax * 10 - {s})), 6)"

QUERIES = {f.__name__: f for f in (one_euro_by_user, one_euro_fold, one_euro_with_gaps, event_time_projection, root_joint_filter, first_body, joint_axis, expansiveness, joints_unpivot, joints_pivot, movement_effort, movement_flow, movement_direction, action_drives, effort_space, skeleton_files, response_curves, performer_proximity, mode_rows)}
ORACLE = {
    "one_euro_by_user": _EURO_SQL.replace("{value}", "value"),
    "one_euro_fold": _EURO_SQL.replace("{value}", "value"),
    "one_euro_with_gaps": _EURO_SQL.replace("{value}", "CASE WHEN event_id % 11 <> 0 THEN value END"),
    "event_time_projection": "SELECT event_id, event_id::DOUBLE * (1.0::DOUBLE / 30.0::DOUBLE) AS t FROM events",
    "root_joint_filter": f"WITH {_SK} SELECT frame_idx, pelvis_x FROM s WHERE pelvis_x IS NOT NULL",
    "first_body": f"WITH {_SK} SELECT label, min(frame_idx) AS frame_idx, min_by(spine_2_x, frame_idx) AS spine_2_x FROM s GROUP BY label",
    "joint_axis": f"WITH {_SK} SELECT frame_idx, right_wrist_y AS value FROM s",
    "expansiveness": f"WITH {_SK} SELECT frame_idx, round(CASE WHEN {_L} IS NULL THEN NULL WHEN {_R} > {_L} THEN {_R} ELSE {_L} END, 6) AS expansiveness FROM s",
    "joints_unpivot": f"WITH {_SK} " + " UNION ALL ".join(f"SELECT frame_idx, '{n[:-2]}' AS joint, '{n[-1]}' AS axis, {n} AS value FROM s" for n in _NAMES),
    "joints_pivot": f"WITH {_SK} SELECT frame_idx, {', '.join(_NAMES)} FROM s",
    "movement_effort": f"WITH {_MOVE} SELECT frame_idx, round(sqrt((coalesce((v_left_wrist_y * v_left_wrist_y + v_left_wrist_z * v_left_wrist_z) * 2, 0) + coalesce(v_right_wrist_y * v_right_wrist_y + v_right_wrist_z * v_right_wrist_z, 0)) / CASE WHEN dt IS NULL THEN NULL ELSE 3 END), 5) AS effort, round(sqrt(a_y * a_y + a_z * a_z), 4) AS weight FROM m",
    "movement_flow": f"WITH {_MOVE} SELECT frame_idx, round(stddev_pop(dv) OVER (PARTITION BY label ORDER BY frame_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 5) AS flow FROM m",
    "movement_direction": f"WITH {_SK}, d AS (SELECT *, {_L} AS l, {_R} AS r FROM s WHERE left_wrist_x IS NOT NULL AND right_wrist_x IS NOT NULL) SELECT frame_idx, {_DIR} FROM d",
    "action_drives": f"SELECT l_orderkey, l_linenumber, {_DRIVE(1, 1, 1)} AS punch, {_DRIVE(0, 1, 0)} AS wring, {_DRIVE(0, 0, 0)} AS float FROM lineitem",
    "effort_space": "WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS t, l_discount * 10 AS w, l_tax * 10 AS s, CASE WHEN l_orderkey % 13 <> 0 THEN l_linenumber / 7 END AS f FROM lineitem) SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(sqrt((t - {d[0]}) * (t - {d[0]}) + (w - {d[1]}) * (w - {d[1]}) + (s - {d[2]}) * (s - {d[2]}) + (f - {d[3]}) * (f - {d[3]})), 6) AS {n}" for n, d in movement.EFFORTS.items()) + " FROM l",
    "skeleton_files": "SELECT vec_id AS frame_idx, len([k FOR k IN range(114) IF (vec_id + k) % 11 <> 0])::BIGINT AS n_seen, round(list_sum([CASE WHEN (vec_id + k) % 11 <> 0 THEN embedding[k % 64 + 1]::DOUBLE ELSE 0 END FOR k IN range(114)]), 6) AS total, CASE WHEN vec_id % 11 <> 0 THEN round(embedding[1]::DOUBLE, 6) END AS pelvis_x FROM embeddings",
    "response_curves": """WITH u AS (SELECT l_orderkey, l_linenumber, least(greatest((l_quantity / 50 - 0.1::DOUBLE) / 0.8::DOUBLE, 0), 1) AS u FROM lineitem)
SELECT l_orderkey, l_linenumber, round(u, 6) AS linear, round((1 / (1 + exp(-6 * (u - 0.5::DOUBLE))) - 1 / (1 + exp(3::DOUBLE))) / (1 / (1 + exp(-3::DOUBLE)) - 1 / (1 + exp(3::DOUBLE))), 6) AS sigmoid, round(CASE WHEN u < 0.5 THEN u * 0.5::DOUBLE ELSE 0.25::DOUBLE + (u - 0.5::DOUBLE) * 1.5::DOUBLE END, 6) AS piecewise FROM u""",
    "performer_proximity": f"WITH {_SK} SELECT a.frame_idx, round(greatest(0, 1 - sqrt(" + " + ".join(f"(a.spine_2_{x} - b.spine_2_{x}) * (a.spine_2_{x} - b.spine_2_{x})" for x in "xyz") + ") / 600), 6) AS proximity FROM s a JOIN s b ON b.frame_idx = a.frame_idx + 1",
    "mode_rows": "SELECT conv_id, turn FROM conversations WHERE role <> 'user' OR role IS NULL",
}
