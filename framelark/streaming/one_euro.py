"""The 1 Euro filter and rolling descriptors on streams."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.series import Cutoffs, filter_row


class OneEuroProcessor(StatefulProcessor):
    """One filter state for each series. Rows of a micro-batch are taken in the order of time and id; rows that come late
    (time does not go on) pass as they are, and the state stays."""

    def __init__(self, key: str, min_cutoff: float = 1.0, beta: float = 0.05, d_cutoff: float = 1.0) -> None:
        self.key, self.cutoffs = key, Cutoffs(min_cutoff, beta, d_cutoff)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("filter", "t double, x double, dx double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        df = pd.concat(rows).sort_values(["t", "id"], kind="stable")
        stored = self.state.get() if self.state.exists() else None
        held = None if stored is None else (stored[0], float("nan") if stored[1] is None else stored[1], stored[2])
        out = []
        for t, x in zip(df["t"].tolist(), df["x"].tolist(), strict=True):
            held, y = filter_row(held, t, x, self.cutoffs)
            out.append(y)
        self.state.update((held[0], None if held[1] != held[1] else held[1], held[2]))
        yield pd.DataFrame({self.key: key[0], "id": df["id"].to_numpy(), "filtered": out})

    def close(self) -> None:
        pass


def one_euro_stream(rows: DataFrame, key: str, **params: float) -> DataFrame:
    """(key, id, filtered) of a stream (key, id long, t double, x double). The session needs the RocksDB state store."""
    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).transformWithStateInPandas(OneEuroProcessor(key, **params), f"{key} {kind}, id long, filtered double", "Append", "None")


def rolling(rows: DataFrame, key: str, time: str, value: str, width: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Mean, spread and count of a signal by key and window of event time; rows later than `late` are dropped."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return rows.withWatermark(time, late).groupBy(key, w.alias("w")).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("spread"), F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "mean", "spread", "n")
