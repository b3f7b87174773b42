import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def duck(folder: str):
    import duckdb

    c = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        name, path = f.split(".")[0], os.path.join(folder, f)
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return c


def rows(df) -> list[tuple]:
    """Rows by sorted column names, sorted, as text."""
    import pandas as pd

    text = lambda v: "null" if v is None or (not isinstance(v, (list, tuple)) and not hasattr(v, "__len__") and pd.isna(v)) else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def compare():
    return rows


@pytest.fixture(scope="session")
def duckdb_at():
    return duck
