"""Reading of the test tables, and the package's way to executors."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
