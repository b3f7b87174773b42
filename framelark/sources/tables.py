"""Reading: listings, skeleton CSV, mapping and calibration JSON, the board; and contracts for decoded recordings."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..errors import InsufficientDataError, MissingInputError
from ..functions import headers
from ..functions.columns import basename, is_image, nan_to_null
from ..operators.series import numbered


def listing(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """(path, name, length) of a folder's files, by glob or any image; contents are not read. Order by name yourself."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false")
    files = (files.option("pathGlobFilter", glob) if glob else files).load(folder).select("path", "length").withColumn("name", basename(F.col("path")))
    return files if glob else files.where(is_image(F.col("name")))


def first_file(spark: SparkSession, folder: str, glob: str) -> str:
    """The first path by name; raises where there is none."""
    found = listing(spark, folder, glob).agg(F.min("path")).first()[0]
    if found is None:
        raise MissingInputError(f"no {glob} in {folder}")
    return found


def positions(names: DataFrame, keys: list[str], name: str = "name", to: str = "position") -> DataFrame:
    """1-based places of names in their sorted listing; a listing of any length, in as many tasks as it needs."""
    return numbered(names, name, to, 1, tuple(keys))


def need(df: DataFrame, least: int, what: str) -> DataFrame:
    """df, if it has `least` rows; reads no more than that many."""
    n = df.limit(least).count()
    if n < least:
        raise InsufficientDataError(f"{what}: {n} of at least {least}")
    return df


def skeleton_csv(spark: SparkSession, path: str) -> DataFrame:
    """One row a frame, 38 joints times three axes; nan becomes null."""
    df = spark.read.schema(schemas.SKELETON).option("header", True).option("nanValue", "nan").csv(path)
    return df.select("frame_idx", *[nan_to_null(F.col(c)).alias(c) for c in df.columns[1:]])


def mapping_entries(json: Column) -> Column:
    """Rows (key, value) of a JSON object from text keys to whole numbers."""
    return F.explode(F.from_json(json, "MAP<STRING,BIGINT>"))


def mapping_json(spark: SparkSession, path: str) -> DataFrame:
    """(sony_idx, zed_idx) of a frame mapping file."""
    rows = spark.read.option("wholetext", True).text(path).select(mapping_entries(F.col("value")).alias("key", "zed_idx"))
    return rows.select(F.col("key").cast("long").alias("sony_idx"), "zed_idx")


def calibration_json(spark: SparkSession, path: str) -> DataFrame:
    """One row a calibration document."""
    return spark.read.schema(schemas.CALIBRATION).option("multiLine", True).json(path)


def board(spark: SparkSession, cols: int = 10, rows: int = 7, square: float = 0.028) -> DataFrame:
    """Inner corners of a board, metres, row by row."""
    i = F.col("id")
    return spark.range(cols * rows).select(i.cast("int").alias("corner_id"), ((i % cols + 1) * square).alias("bx"), ((F.floor(i / cols) + 1) * square).alias("by"), F.lit(0.0).alias("bz"))


def image_size(frames: DataFrame, keys: list[str], order: str = "path") -> DataFrame:
    """(keys, width, height) of each key's first readable frame."""
    size = F.min_by(F.struct("width", "height"), order).alias("size")
    return frames.where("width IS NOT NULL AND height IS NOT NULL").groupBy(*keys).agg(size).select(*keys, "size.width", "size.height")


def with_size(files: DataFrame, content: str = "content") -> DataFrame:
    """files with width and height from their headers, null for those that cannot be read."""
    return files.withColumn("_size", headers.size(F.col(content))).withColumns({c: F.col(f"_size.{c}") for c in ("width", "height")}).drop("_size")


def folder_size(spark: SparkSession, folder: str) -> DataFrame:
    """(folder, width, height) of the first readable picture of each folder below."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(is_image(F.col("path")))
    sized = with_size(files).select("path", "width", "height").withColumn("folder", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    return image_size(sized, ["folder"])


def decoded(df: DataFrame, kind: str) -> DataFrame:
    """A table from an outside decoder or model, held against its schema: pictures and videos are not decoded here."""
    schema = {"frames": schemas.FRAMES, "depth": schemas.DEPTH, "features": schemas.FEATURES, "corners": schemas.CORNERS, "skeleton": schemas.SKELETON, "grid": schemas.GRID}[kind]
    return df.select(*schemas.matches(df, schema))


def enough_corners(corners: DataFrame, least: int = 6, keys: tuple[str, ...] = ("dataset", "camera", "frame")) -> DataFrame:
    """Corners of frames that have `least` of them; frames below give none."""
    return corners.join(corners.groupBy(*keys).count().where(F.col("count") >= least).select(*keys), list(keys), "left_semi")
