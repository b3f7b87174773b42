"""Writing: JSON maps and reports, wide CSV, text logs, copy manifests."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mapping_object(key: str, value: str) -> Column:
    """An aggregate: a JSON object with keys in the order of their numbers. One object holds one recording's frames."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))))
    return F.to_json(F.map_from_entries(F.transform(ordered, lambda e: F.struct(e["k"].cast("string"), e["v"]))))


def write_mapping(mapping: DataFrame, path: str, key: str = "sony_idx", value: str = "zed_idx") -> None:
    mapping.groupBy("dataset").agg(mapping_object(key, value).alias("value")).write.mode("overwrite").partitionBy("dataset").text(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def write_skeleton(wide: DataFrame, path: str) -> None:
    wide.write.mode("overwrite").option("header", True).option("nullValue", "nan").csv(path)


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def copy_manifest(pairs: DataFrame, source: Column, target: Column) -> DataFrame:
    """(src, dst) rows for whatever copies files; nothing is copied here."""
    return pairs.select(source.alias("src"), target.alias("dst"))


def write_dataset(df: DataFrame, path: str) -> None:
    """Replaces only the datasets that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset").parquet(path)
