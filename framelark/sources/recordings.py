"""What detectors, body trackers and feature networks wrote, as a Spark data source.

A folder holds a file for each recording, `<dataset>/<camera>.csv` with a header line (`<dataset>.csv` for what has no
camera), in any store that pyarrow opens (local or mounted folders, hdfs://, s3://, gs://). Each file is a partition and
is read in batches. The options `dataset` and `camera`, lists of names with commas, leave out files before any is opened.
(Filters that Spark 4.1 pushes to a Python source stay with the relation: a later query over the same DataFrame, without
them, lost rows in our tests. So the source takes none, and Spark applies all.)

    spark.dataSource.register(Recordings)
    spark.read.format("recordings").option("kind", "corners").option("dataset", "d1,d2").load("hdfs://.../detections")

Defined cases: columns beyond the schema are left out, one that lacks makes the read fail, as does a value of another
type; empty values and `nan` are null; names may not hold a separator; a folder without files is an empty table.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import csv, fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import schemas
from ..errors import MissingInputError
from ..shipping import ship

#: Schemas of the files; dataset and camera come from their names. Frames of corners are text, as their files are named.
KINDS = {"corners": schemas.CORNERS, "skeleton": f"dataset STRING, {schemas.SKELETON}", "mapping": schemas.MAPPING}
NAMES = ("dataset", "camera")


@dataclass
class Recording(InputPartition):
    path: str
    dataset: str
    camera: str | None


class Recordings(DataSource):
    """Options: path, kind (corners, skeleton or mapping), dataset and camera (names that are read; without, all)."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        kind = self.options.get("kind", "")
        if kind not in KINDS:
            raise ValueError(f"kind {kind!r} is none of {', '.join(KINDS)}")
        return KINDS[kind]

    def reader(self, schema: StructType) -> DataSourceReader:
        return RecordingsReader(self.options["path"], schema, {k: set(self.options[k].split(",")) for k in NAMES if k in self.options})


class RecordingsReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, wanted: dict[str, set[str]]) -> None:
        self.path, self.columns, self.wanted = path.rstrip("/"), schema, wanted

    def partitions(self) -> list[Recording]:
        store, folder = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        if store.get_file_info(folder).type != fs.FileType.Directory:
            raise MissingInputError(f"no folder {self.path}")
        deep, found = "camera" in self.columns.names, []
        for f in store.get_file_info(fs.FileSelector(folder, recursive=deep)):
            parts = f.path.removeprefix(folder).strip("/").split("/")
            if f.type == fs.FileType.File and parts[-1].endswith(".csv") and len(parts) == 1 + deep:
                names = dict(zip(NAMES, [*parts[:-1], parts[-1].removesuffix(".csv")], strict=False))
                if all(names.get(k) in some for k, some in self.wanted.items()):
                    found.append(Recording(f"{self.path}/{'/'.join(parts)}", names["dataset"], names.get("camera")))
        return sorted(found, key=lambda r: r.path) or [Recording("", "", None)]

    def read(self, partition: Recording) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        target = to_arrow_schema(self.columns)
        own = [c for c in target.names if c not in NAMES]
        types = csv.ConvertOptions(column_types={c: target.field(c).type for c in own}, include_columns=own, null_values=["", "nan", "NaN"], strings_can_be_null=True)
        store, path = fs.FileSystem.from_uri(partition.path) if "://" in partition.path or partition.path.startswith("file:") else (fs.LocalFileSystem(), partition.path)
        with store.open_input_stream(path) as f:
            for b in csv.open_csv(f, convert_options=types):
                fixed = {k: pa.repeat(pa.scalar(getattr(partition, k), pa.string()), b.num_rows) for k in NAMES}
                yield pa.RecordBatch.from_arrays([fixed[c] if c in fixed else b.column(c) for c in target.names], schema=target)


def register(spark: SparkSession) -> None:
    """Makes format("recordings") known to the session, and the package to its executors."""
    ship(spark).dataSource.register(Recordings)
