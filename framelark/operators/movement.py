"""Skeleton tables and movement descriptors."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import lost
from ..functions.geometry import distance
from ..schemas import AXES, JOINTS


def joint_column(joint: str, axis: str) -> str:
    if joint not in JOINTS or axis not in AXES:
        raise ValueError(f"no joint {joint!r} or axis {axis!r}")
    return f"{joint}_{axis}"


def frame_time(frame: Column, fps: float = 30.0) -> Column:
    """Seconds: the number times the frame's duration."""
    return frame.cast("double") * F.lit(1.0 / fps)


def to_long(wide: DataFrame, ids: list[str], joints: tuple[str, ...] = JOINTS) -> DataFrame:
    """(ids, joint, axis, value) of columns joint_axis."""
    columns = [f"{j}_{a}" for j in joints for a in AXES]
    name = F.col("_name")
    return wide.unpivot(ids, columns, "_name", "value").select(*ids, F.regexp_replace(name, "_[xyz]$", "").alias("joint"), F.right(name, F.lit(1)).alias("axis"), "value")


def to_wide(rows: DataFrame, ids: list[str], joints: tuple[str, ...] = JOINTS) -> DataFrame:
    names = [f"{j}_{a}" for j in joints for a in AXES]
    return rows.groupBy(*ids).pivot("_name", names).agg(F.first("value")) if "_name" in rows.columns else to_wide(rows.withColumn("_name", F.concat_ws("_", "joint", "axis")), ids, joints)


def point(joint: str) -> list[Column]:
    return [F.col(joint_column(joint, a)) for a in AXES]


def between(a: list[Column], b: list[Column]) -> Column:
    return distance(*zip(a, b, strict=True))


def larger(left: Column, right: Column) -> Column:
    """The larger of two lengths; a lost left one stays, beside a lost right one the left counts."""
    return F.when(lost(left) | lost(right), left).otherwise(F.greatest(left, right))


def expansiveness(centre: list[Column], left: list[Column], right: list[Column]) -> Column:
    """How far the farther wrist is from the upper body."""
    return larger(between(centre, left), between(centre, right))


def direction(centre: list[Column], left: list[Column], right: list[Column]) -> Column:
    """The unit vector from the upper body to the farther wrist; null at no distance."""
    l, r = between(centre, left), between(centre, right)
    far = F.when(r > l, r).otherwise(l)
    return F.struct(*[(F.when(r > l, b - c).otherwise(a - c) / F.when(far > 0, far)).alias(n) for n, a, b, c in zip(AXES, left, right, centre, strict=True)])


def differences(df: DataFrame, keys: list[str], order: str, columns: list[str], fps: float = 30.0) -> DataFrame:
    """Velocities (v_) and accelerations (a_) of columns, a second, from the row in front in the series."""
    w = W.partitionBy(*keys).orderBy(order)
    time = (F.col(order) - F.lag(order).over(w)) * F.lit(1.0 / fps)
    v = df.withColumns({f"v_{c}": (F.col(c) - F.lag(c).over(w)) / time for c in columns})
    return v.withColumns({f"a_{c}": (F.col(f"v_{c}") - F.lag(f"v_{c}").over(w)) / time for c in columns})


def effort(velocities: list[tuple[list[Column], float]]) -> Column:
    """Weighted root mean square speed of limbs; lost ones count neither up nor down."""
    parts = [(sum((c * c for c in v[1:]), v[0] * v[0]), w) for v, w in velocities]
    up = [F.when(~lost(s), s * w).otherwise(0.0) for s, w in parts]
    down = [F.when(~lost(s), F.lit(float(w))).otherwise(0.0) for s, w in parts]
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    return F.sqrt(add(up) / F.nullif(add(down), F.lit(0.0)))


def weight(acceleration: list[Column]) -> Column:
    return F.sqrt(sum((c * c for c in acceleration[1:]), acceleration[0] * acceleration[0]))


def flow(df: DataFrame, keys: list[str], order: str, speed: str, rows: int = 15, to: str = "flow") -> DataFrame:
    """Rolling standard deviation of the change of speed."""
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumn("_d", F.col(speed) - F.lag(speed).over(w)).withColumn(to, F.stddev_pop("_d").over(w.rowsBetween(-(rows - 1), 0))).drop("_d")


#: The eight action drives as corners of (time, weight, space) in 0..1: sudden, strong and direct are 1.
DRIVES = {"punch": (1, 1, 1), "slash": (1, 1, 0), "dab": (1, 0, 1), "flick": (1, 0, 0), "press": (0, 1, 1), "wring": (0, 1, 0), "glide": (0, 0, 1), "float": (0, 0, 0)}


def drive_distances(time: Column, weight_: Column, space: Column) -> Column:
    """How far a moment is from each drive: a description, not a classification."""
    away = lambda d: F.sqrt((time - d[0]) * (time - d[0]) + (weight_ - d[1]) * (weight_ - d[1]) + (space - d[2]) * (space - d[2]))
    return F.struct(*[away(d).alias(n) for n, d in DRIVES.items()])


#: The eight action drives as corners of the four-dimensional effort space (time: sudden is 1; weight: strong
#: is 1; space: expanded is 1; flow: free is 1).
EFFORTS = {
    "punch": (1, 1, 0, 0), "slash": (1, 1, 1, 1), "wring": (0, 1, 1, 0), "press": (0, 1, 0, 0),
    "flick": (1, 0, 1, 1), "dab": (1, 0, 0, 0), "float": (0, 0, 1, 1), "glide": (0, 0, 0, 0),
}


def effort_distances(time: Column, weight_: Column, space: Column, flow_: Column) -> Column:
    """How far a moment is from each drive in the space of all four descriptors, each in 0..1; null where one is lost."""
    at = (time, weight_, space, flow_)
    away = lambda d: F.sqrt(reduce(lambda a, b: a + b, [(x - k) * (x - k) for x, k in zip(at, d, strict=True)]))
    return F.struct(*[away(d).alias(n) for n, d in EFFORTS.items()])


def proximity(a: list[Column], b: list[Column], reach: float) -> Column:
    """1 at no distance of two performers' roots, 0 from `reach` on."""
    return F.greatest(F.lit(0.0), 1.0 - between(a, b) / reach)


def in_mode(df: DataFrame, mode: str) -> DataFrame:
    """Rows that the compositing or the interactive mode shows; rows of no mode are for both."""
    if mode not in ("compositing", "interactive"):
        raise ValueError(mode)
    return df.where(F.col("mode").isNull() | (F.col("mode") == mode))
