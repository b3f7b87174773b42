"""Reprojection errors: statistics by frame and over all corners, grades, histogram, report."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import percentile


def grade(mean: Column) -> Column:
    """A frame's grade; between 2.5 and 2.8 it has none."""
    return F.when(mean < 1.5, "good").when(mean < 2.5, "warn").when(mean >= 2.8, "bad")


def assessment(mean: Column) -> Column:
    return F.when(mean < 0.5, "Excellent").when(mean < 1.8, "Good").when(mean < 2.5, "Acceptable").otherwise("Poor")


def bar_class(mean: Column) -> Column:
    """The colour class of a frame's bar; its limits are not those of the grade."""
    return F.when(mean < 1.0, "low").when(mean < 2.0, "middle").otherwise("high")


def by_frame(errors: DataFrame, keys: list[str], error: str = "error") -> DataFrame:
    return errors.groupBy(*keys).agg(F.count(error).alias("n_corners"), F.avg(error).alias("mean_error_px"), F.max(error).alias("max_error_px"), F.stddev_pop(error).alias("std_error_px"))


def overall(errors: DataFrame, error: str = "error", keys: tuple[str, ...] = ()) -> DataFrame:
    """Over all corners, not over frames; the percentile is exact, between neighbours in proportion."""
    key = (F.struct(*keys) if keys else F.lit(0)).alias("_key")
    means = errors.groupBy(*keys).agg(F.avg(error).alias("overall_mean_px"), F.stddev_pop(error).alias("overall_std_px")).select("*", key)
    return means.join(percentile(errors, error, 0.95, keys, "percentile_95_px"), "_key", "left").drop("_key")


def grades(frames: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    g = grade(F.col("mean_error_px"))
    return frames.groupBy(*keys).agg(*[F.count_if(g == x).alias(f"frames_{x}") for x in ("good", "warn", "bad")], F.count("*").alias("n_frames_validated"))


def histogram(errors: DataFrame, error: str = "error", bins: int = 40) -> DataFrame:
    """(bin, n, low, high): bins of equal width from the least to the largest error, the last one closed; where all are
    equal, the range reaches half a unit to either side."""
    ends = errors.agg(F.min(error).cast("double").alias("a"), F.max(error).cast("double").alias("b")).select(F.when(F.col("a") < F.col("b"), F.col("a")).otherwise(F.col("a") - 0.5).alias("_low"), F.when(F.col("a") < F.col("b"), F.col("b")).otherwise(F.col("b") + 0.5).alias("_high"))
    at = F.least(F.floor((F.col(error) - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins), F.lit(bins - 1)).cast("int")
    step = (F.col("_high") - F.col("_low")) / bins
    return errors.where(F.col(error).isNotNull()).join(F.broadcast(ends)).groupBy(at.alias("bin"), "_low", "_high").agg(F.count("*").alias("n")).select("bin", "n", (F.col("_low") + step * F.col("bin")).alias("low"), (F.col("_low") + step * (F.col("bin") + 1)).alias("high"))


def validation_report(errors: DataFrame, dataset: str = "dataset", frame: str = "frame", error: str = "error") -> DataFrame:
    """One nested row a dataset. A report lists each frame's errors: it is as long as its recording's corners."""
    per = errors.groupBy(dataset, frame).agg(F.count(error).alias("n_corners"), F.avg(error).alias("mean_error_px"), F.max(error).alias("max_error_px"), F.stddev_pop(error).alias("std_error_px"), F.array_sort(F.collect_list(error)).alias("errors_px"))
    g = grade(F.col("mean_error_px"))
    name = F.col(frame).cast("string")
    lists = per.groupBy(dataset).agg(
        F.count("*").alias("n_frames_validated"), *[F.count_if(g == x).alias(f"frames_{x}") for x in ("good", "warn", "bad")],
        F.array_sort(F.collect_list(F.when(g == "bad", name))).alias("bad_frame_names"),
        F.array_sort(F.collect_list(F.struct(F.array(name, name).alias("frame_pair"), "n_corners", "mean_error_px", "max_error_px", "std_error_px", "errors_px"))).alias("per_frame"),
    )
    return overall(errors, error, (dataset,)).join(lists, dataset).withColumn("assessment", assessment(F.col("overall_mean_px")))
