"""Detection and motion quality: statuses, best variants, shared corners, the motion gate, frame features, selection."""
from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..errors import InsufficientDataError
from ..scratch import durable


def detection_status(markers: Column, corners: Column, min_markers: int = 4, min_corners: int = 45) -> Column:
    """status, n_markers, n_corners. Unread frames have null markers; frames without enough markers count as without any."""
    few = F.coalesce(markers, F.lit(0)) < min_markers
    read = corners.isNotNull()
    status = F.when(~read, "unreadable").when(few, "rejected_no_markers").when(corners >= min_corners, "ok").otherwise("rejected_few_corners")
    return F.struct(status.alias("status"), F.when(read, F.when(few, 0).otherwise(markers)).cast("int").alias("n_markers"), F.when(~read | few, 0).otherwise(corners).cast("int").alias("n_corners"))


def classify_detections(df: DataFrame, min_corners: int = 45, min_markers: int = 4) -> DataFrame:
    return df.withColumn("_d", detection_status(F.col("n_markers"), F.col("n_corners"), min_markers, min_corners)).withColumns({c: F.col(f"_d.{c}") for c in ("status", "n_markers", "n_corners")}).drop("_d")


#: Colours (blue, green, red) of a picture's label; the widest picture that is kept as it is.
FINE, REJECTED, TRIED, WIDEST = (0, 180, 0), (0, 0, 220), (0, 200, 0), 1280


def label_of(status: Column, corners: Column) -> Column:
    """What is written on an inspected frame; nothing on one that cannot be read."""
    text = F.format_string("Corners: %d  Status: %s", corners, status)
    return F.when(status == "rejected_no_markers", "REJECTED - no ArUco markers").when(status != "unreadable", text)


def trial_label(dictionary: Column, board: Column, markers: Column, corners: Column) -> Column:
    """What is written on a frame of a configuration that was tried."""
    return F.format_string("Dict: %s  Board: %s  Markers: %d  ChArUco corners: %d", dictionary, board, markers, corners)


def colour(fine: Column, good: tuple[int, int, int] = FINE) -> Column:
    return F.when(fine, F.array(*map(F.lit, good))).otherwise(F.array(*map(F.lit, REJECTED)))


def shown_size(width: Column, height: Column, widest: int = WIDEST) -> Column:
    """(width, height) in which a frame is written: wider ones are scaled down, fractions of pixels cut."""
    scale = F.when(width > widest, F.lit(float(widest)) / width).otherwise(1.0)
    return F.struct((width * scale).cast("int").alias("width"), (height * scale).cast("int").alias("height"))


def annotations(classified: DataFrame) -> DataFrame:
    """classified (status, n_corners, width, height) with the label, its colour and the size of the picture to draw; frames
    without markers keep their size, unreadable ones give no picture."""
    kept = F.col("status") == "rejected_no_markers"
    size = F.when(F.col("status") != "unreadable", F.when(kept, F.struct(F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))).otherwise(shown_size(F.col("width"), F.col("height"))))
    return classified.withColumns({"label": label_of(F.col("status"), F.col("n_corners")), "colour": F.when(F.col("status") != "unreadable", colour(F.col("status") == "ok")), "shown": size})


def best_variant(tried: DataFrame, keys: list[str], n: str = "n_corners", order: str = "try_order", least: int = 1) -> DataFrame:
    """The row of the most corners of each key; the first tried on a tie; none below `least`."""
    rest = [c for c in tried.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(n), -F.col(order))).alias("_best")
    return tried.where(F.col(n) >= least).groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


def both_ok(sony: DataFrame, zed: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of frames by name that are fine in both cameras."""
    return sony.where("status = 'ok'").select(*keys, F.col("n_corners").alias("sony_corners")).join(zed.where("status = 'ok'").select(*keys, F.col("n_corners").alias("zed_corners")), keys)


def in_both(sony: DataFrame, zed: DataFrame, keys: list[str]) -> DataFrame:
    """Frames that the other folder has as well."""
    return sony.join(zed.select(*keys), keys, "left_semi")


def matched_corners(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Corners seen in both, with both places (xa, ya, xb, yb)."""
    left = a.select(*keys, "corner_id", F.col("x").alias("xa"), F.col("y").alias("ya"))
    return left.join(b.select(*keys, "corner_id", F.col("x").alias("xb"), F.col("y").alias("yb")), [*keys, "corner_id"])


def enough_shared(matched: DataFrame, keys: list[str], least: int) -> DataFrame:
    return matched.groupBy(*keys).agg(F.count("*").alias("n_shared")).where(F.col("n_shared") >= least)


def collect_pairs(a: DataFrame, b: DataFrame, keys: list[str], least: int = 45) -> DataFrame:
    """Matched corners of the frame pairs that share enough."""
    m = matched_corners(a, b, keys)
    return m.join(enough_shared(m, keys, least), keys)


def motion_gate(frames: DataFrame, corners: DataFrame, keys: list[str], frame: str = "frame", lag: int = 3, px: float = 1.5, least: int = 6) -> DataFrame:
    """(keys, frame, still): a frame is still if the corners that it shares with the frame `lag` numbers before are at
    least `least` and none moved by more than `px`. No such frame, or no corners: not still."""
    before = corners.withColumn(frame, F.col(frame) + lag)
    moved = F.max(F.sqrt((F.col("xa") - F.col("xb")) * (F.col("xa") - F.col("xb")) + (F.col("ya") - F.col("yb")) * (F.col("ya") - F.col("yb"))))
    shared = matched_corners(corners, before, [*keys, frame]).groupBy(*keys, frame).agg(F.count("*").alias("n_shared"), moved.alias("max_shift"))
    there = frames.select(*keys, frame).join(shared, [*keys, frame], "left")
    return there.withColumn("still", F.coalesce((F.col("n_shared") >= least) & (F.col("max_shift") <= px), F.lit(False)))


FEATURES = ("mean_x", "mean_y", "aspect", "area")


def frame_features(corners: DataFrame, keys: list[str], width: str = "width", height: str = "height") -> DataFrame:
    """Where a board is in its frame, its shape and size, as 32-bit numbers read back as doubles."""
    w, h = F.first(width), F.first(height)
    dx, dy = F.max("x") - F.min("x"), F.max("y") - F.min("y")
    values = (F.avg("x") / w, F.avg("y") / h, dx / F.greatest(dy, F.lit(1e-6)), (dx / w) * (dy / h))
    return corners.groupBy(*keys).agg(*[v.cast("float").cast("double").alias(n) for n, v in zip(FEATURES, values, strict=True)])


def normalised(df: DataFrame, columns: tuple[str, ...] = FEATURES, keys: tuple[str, ...] = ()) -> DataFrame:
    """Columns scaled to their range over the table, or over each key's rows; a constant one becomes 0."""
    ends = df.groupBy(*keys).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))])
    span = lambda c: F.when(F.col(f"_high_{c}") > F.col(f"_low_{c}"), F.col(f"_high_{c}") - F.col(f"_low_{c}")).otherwise(1.0)
    there = df.join(ends, list(keys)) if keys else df.join(F.broadcast(ends))
    return there.select(*[c for c in df.columns if c not in columns], *[((F.col(c) - F.col(f"_low_{c}")) / span(c)).alias(c) for c in columns])


#: Cells along a column; rows that a scanned cell reports; slack of bounds for rounding; share of the distance asked for
#: from which a cell is scanned along with others.
CELLS, REPORTED, SLACK, AHEAD = 8, 64, 1e-9, 0.75


class Cells:
    """What is known of the rows of each cell of a grid: the box around them, how far from all picks some row is for sure,
    the rows that the last scan of the cell reported with their distance, and how far the rest can be."""

    def __init__(self, boxes: list, columns: tuple[str, ...]) -> None:
        self.names = [r["_cell"] for r in boxes]
        self.low, self.high = (np.array([[r[f"{end}_{c}"] for c in columns] for r in boxes]) for end in ("low", "high"))
        self.sure = np.full(len(boxes), np.inf)
        self.rest = np.full(len(boxes), np.inf)  # bound on rows that were not reported
        self.exact = np.zeros(len(boxes), bool)  # scanned since the last pick: the first reported row is the cell's next
        self.seen = np.zeros(len(boxes), bool)  # scanned ever: what is sure may have been picked from the others only
        self.rows: list[dict] = [{} for _ in boxes]

    def picked(self, name: object, at: tuple[float, ...]) -> None:
        """A pick brings bounds, sure distances (some row of the cell has at least that) and reported rows down."""
        p = np.array(at)
        self.exact[:] = False
        gap = np.maximum(np.maximum(self.low - p, p - self.high), 0.0)
        reach = np.maximum(np.abs(p - self.low), np.abs(p - self.high))
        far = np.sqrt((reach * reach).sum(1)) * (1 + SLACK)
        self.rest = np.minimum(self.rest, far)
        self.sure = np.minimum(self.sure, np.sqrt((gap * gap).sum(1)) * (1 - SLACK))
        for own in self.rows:
            own.pop(name, None)
            for other, (where, d) in own.items():
                own[other] = (where, min(d, apart(where, at)))

    def best(self) -> tuple | None:
        """The farthest reported row (distance, name, place), the first by name of equal ones."""
        found = [(-d, name, where) for own in self.rows for name, (where, d) in own.items()]
        return min(found, key=lambda f: f[:2]) if found else None

    def open(self) -> list[int]:
        """Cells to scan: those with rows not reported that may be as far as the farthest one known, or as any is sure to be;
        where there are such, also those that come close, which the next picks would ask for."""
        best = self.best()
        known = max(-best[0] if best else -np.inf, self.sure[~self.seen].max(initial=-np.inf))
        left = ~self.exact & (self.rest > -np.inf)
        return np.flatnonzero(left & (self.rest >= AHEAD * known)).tolist() if (left & (self.rest >= known)).any() else []

    def scanned(self, cell: int, rows: list[tuple]) -> None:
        """rows (distance, name, place), the farthest REPORTED of the cell."""
        self.rows[cell] = {name: (where, d) for d, name, where in rows}
        self.rest[cell] = rows[-1][0] * (1 + SLACK) if len(rows) == REPORTED else -np.inf
        self.exact[cell] = self.seen[cell] = True


def apart(a: tuple[float, ...], b: tuple[float, ...]) -> float:
    """Euclidean distance, summed in the order in which Spark sums it."""
    total = (a[0] - b[0]) * (a[0] - b[0])
    for x, y in zip(a[1:], b[1:], strict=True):
        total += (x - y) * (x - y)
    return math.sqrt(total)


def farthest_point(df: DataFrame, n: int = 45, name: str = "name", columns: tuple[str, ...] = FEATURES, cells: int = CELLS) -> DataFrame:
    """(name, pick) of n diverse rows: the first by name, then always the row farthest from all picked ones, of equally
    far ones the first by name.

    Rows lie in the cells of a grid. The driver keeps bounds of each cell, at most cells ** len(columns) of them, and the
    REPORTED farthest rows of cells that were scanned. Only cells whose other rows could be the next pick are scanned
    again, by tasks that send those rows only, so a pick mostly needs no job, and no task sees all rows. Names are
    distinct; rows without one, or with a null or NaN column, are no picks.
    """
    fine = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in columns]) & F.col(name).isNotNull()
    cell = F.concat_ws(",", *[F.least(F.floor(F.col(c) * cells), F.lit(cells - 1)).cast("string") for c in columns])
    rows = durable(normalised(df, columns).select(name, *columns).where(fine).withColumn("_cell", cell))
    ends = [f(c).alias(f"{end}_{c}") for c in columns for end, f in (("low", F.min), ("high", F.max))]
    boxes = rows.groupBy("_cell").agg(F.count("*").alias("n"), F.min(F.struct(name, *columns)).alias("first"), *ends).collect()  # a row a cell
    if sum(r["n"] for r in boxes) < n:
        raise InsufficientDataError(f"frames to pick from: {sum(r['n'] for r in boxes)} of at least {n}")
    known = Cells(sorted(boxes, key=lambda r: r["_cell"]), columns)
    place = lambda r: tuple(r[c] for c in columns)
    first = min((r["first"] for r in boxes), key=lambda r: r[name])
    picks = [(first[name], place(first))]
    known.picked(*picks[0])
    while len(picks) < n:
        while wanted := known.open():
            found: dict[str, list] = {known.names[k]: [] for k in wanted}
            for r in farthest_of_cells(rows, list(found), picks, name, columns):
                found[r["_cell"]].append((r["_far"], r[name], place(r)))
            for k in wanted:
                known.scanned(k, sorted(found[known.names[k]], key=lambda x: (-x[0], x[1])))
        _, *pick = known.best()
        picks.append(tuple(pick))
        known.picked(*pick)
    return df.sparkSession.createDataFrame([(p[0], k) for k, p in enumerate(picks, 1)], f"{name} {df.schema[name].dataType.simpleString()}, pick int")


#: Picks after which the rows' distances are written.
WRITTEN = 8


def farthest_points(df: DataFrame, keys: list[str], n: int = 45, name: str = "name", columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """(keys, name, pick): the n picks of farthest_point of every key, all keys side by side. Raises if a key has fewer rows.

    A pick is one aggregate over all rows, made by task first; rows keep how far they are from their key's picks so far,
    which is written every few picks. Null keys take no part.
    """
    fine = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in columns])
    pool = normalised(df.select(*keys, name, *columns), columns, tuple(keys)).where(fine)
    short = pool.groupBy(*keys).count().where(F.col("count") < n).limit(1).collect()
    if short:
        raise InsufficientDataError(f"frames to pick from: {short[0]['count']} of at least {n} in {[short[0][k] for k in keys]}")
    rows = durable(pool.withColumn("_far", F.lit(float("inf"))))
    best = F.min_by(F.struct(name, *columns), F.struct(-F.col("_far"), F.col(name))).alias("_p")
    square = lambda c: (F.col(c) - F.col(f"_p.{c}")) * (F.col(c) - F.col(f"_p.{c}"))
    away = F.sqrt(reduce(lambda a, b: a + b, map(square, columns)))
    picks = []
    for k in range(1, n + 1):
        picks.append(durable(rows.groupBy(*keys).agg(best).withColumn("pick", F.lit(k))))
        rows = rows.join(picks[-1].drop("pick"), keys).where(F.col(name) != F.col(f"_p.{name}")).withColumn("_far", F.least("_far", away)).drop("_p")
        rows = durable(rows) if k % WRITTEN == 0 and k < n else rows
    return reduce(DataFrame.unionByName, picks).select(*keys, F.col(f"_p.{name}").alias(name), "pick")


def farthest_of_cells(rows: DataFrame, cells: list[str], picks: list[tuple], name: str, columns: tuple[str, ...]) -> list:
    """(_cell, name, columns, _far): of each cell the rows that are farthest from all picks, without those."""
    chosen = F.array(*[F.struct(F.lit(p).alias("name"), *[F.lit(x).alias(c) for c, x in zip(columns, at, strict=True)]) for p, at in picks])

    def distance(p: Column) -> Column:
        return F.sqrt(reduce(lambda a, b: a + b, [(F.col(c) - p[c]) * (F.col(c) - p[c]) for c in columns]))

    near = rows.where(F.col("_cell").isin(cells) & ~F.col(name).isin([p for p, _ in picks])).withColumn("_far", F.array_min(F.transform(chosen, distance)))
    order = F.row_number().over(W.partitionBy("_cell").orderBy(F.desc("_far"), name))
    return near.withColumn("_k", order).where(F.col("_k") <= REPORTED).collect()  # Spark cuts to the first ones by task


def grid_search(found: DataFrame, params: list[str], least: int = 6) -> DataFrame:
    """The configuration and frame of the most corners; the first in the grid on a tie; none below `least`."""
    rest = [c for c in found.columns if c != "ordinal"]
    best = F.max_by(F.struct(*rest), F.struct(F.col("n_corners"), -F.col("ordinal"))).alias("_b")
    return found.where(F.col("n_corners") >= least).agg(best).where("_b IS NOT NULL").select("_b.*")


def grid(spark, **axes: list) -> DataFrame:
    """All combinations of a few literal values, in order, with their ordinal."""
    import itertools

    rows = [(k, *values) for k, values in enumerate(itertools.product(*axes.values()))]
    return spark.createDataFrame(rows, ["ordinal", *axes])


def first_body(bodies: DataFrame, keys: list[str], order: str) -> DataFrame:
    return bodies.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_k = 1").drop("_k")


def root_filter(skeleton: DataFrame, root: str = "pelvis_x") -> DataFrame:
    """Frames whose root joint was seen; frame numbers stay, with gaps."""
    return skeleton.where(F.col(root).isNotNull() & ~F.isnan(root))


def in_bounds(x: Column, y: Column, width: Column | int, height: Column | int) -> Column:
    """Whether a point, cut to whole pixels, is within the picture."""
    i, j = x.cast("int"), y.cast("int")
    return (i >= 0) & (i < width) & (j >= 0) & (j < height)


def coverage(corners: DataFrame, keys: list[str], width: int, height: int, radius: int = 8) -> DataFrame:
    """(keys, n_pixels, share) covered by discs around corners within the picture; a pixel counts once.

    A disc is a span of pixels in each of its 2 * radius + 1 rows. Of spans that begin at the same pixel the longest is
    kept, by task first, so a row of the picture has at most as many as pixels; a sweep over a row adds what each reaches
    beyond those before it.
    """
    reach = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(math.isqrt(radius * radius - dy * dy)).alias("r")) for dy in range(-radius, radius + 1)])
    centres = corners.where(in_bounds(F.col("x"), F.col("y"), width, height)).select(*keys, F.col("x").cast("int").alias("_i"), F.col("y").cast("int").alias("_j"))
    spans = centres.select("*", F.explode(reach).alias("s")).select(*keys, (F.col("_j") + F.col("s.dy")).alias("row"), F.greatest(F.col("_i") - F.col("s.r"), F.lit(0)).alias("low"), F.least(F.col("_i") + F.col("s.r"), F.lit(width - 1)).alias("high"))
    rows = spans.where((F.col("row") >= 0) & (F.col("row") < height))
    longest = rows.groupBy(*keys, "row", "low").agg(F.max("high").alias("high"))
    before = F.coalesce(F.max("high").over(W.partitionBy(*keys, "row").orderBy("low").rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))
    new = F.greatest(F.col("high") - F.greatest(before, F.col("low") - 1), F.lit(0))
    swept = longest.withColumn("new", new).groupBy(*keys).agg(F.sum("new").alias("n_pixels"))
    return swept.withColumn("share", F.col("n_pixels") / F.lit(float(width * height)))
