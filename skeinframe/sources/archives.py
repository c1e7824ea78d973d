"""Tables in members of zip archives (survey S-07): a partition a member, of any number of archives."""

from __future__ import annotations

import csv
import fnmatch
import io
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH_ROWS = 8192
ARCHIVE = "archive"

#: The tables of a timetable feed with the columns that are used.
FEED = {
    "agency": ("agency_id", "agency_name"), "routes": ("route_id", "agency_id", "route_short_name", "route_long_name"), "trips": ("route_id", "service_id", "trip_id"),
    "stop_times": ("trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time"), "stops": ("stop_id", "stop_name", "stop_lat", "stop_lon"),
    "calendar": ("service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date"),
}


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Member(InputPartition):
    def __init__(self, path: str, name: str):
        self.path, self.name = path, name


class ZipReader(DataSourceReader):
    """Rows of one member of each archive. The driver reads the archives' directories only; a task seeks to its member and hands on batches as it unpacks."""

    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.options = schema, options

    def partitions(self) -> Sequence[Member]:
        files, at = _opened(self.options["path"])
        folder, _, pattern = at.rpartition("/")
        if files.get_file_info(at).type == fs.FileType.Directory:
            folder, pattern = at, "*.zip"
        found = [i for i in files.get_file_info(fs.FileSelector(folder)) if i.is_file and fnmatch.fnmatch(i.base_name, pattern)]
        prefix = self.options["path"][: len(self.options["path"]) - len(at)]
        out = []
        for info in sorted(found, key=lambda i: i.path):
            with files.open_input_file(info.path) as f, zipfile.ZipFile(f) as z:
                out += [Member(prefix + info.path, n) for n in z.namelist() if n == self.options["member"]]
        return out

    def read(self, partition: Member | None) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in self.schema.fields]
        if partition is None:
            return
        files, at = _opened(partition.path)
        archive = at.rpartition("/")[2]
        kind = pa.schema([(n, pa.string()) for n in names])
        with files.open_input_file(at) as f, zipfile.ZipFile(f) as z, z.open(partition.name) as member:
            rows = csv.reader(io.TextIOWrapper(member, encoding="utf-8-sig", errors="replace", newline=""))
            header = [c.strip().lower() for c in next(rows, [])]
            places = [header.index(n) if n in header else None for n in names]
            held: list[list[str | None]] = []

            def batch() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], pa.string()) for i in range(len(names))], schema=kind)

            for row in rows:
                if not row:
                    continue
                held.append([archive if n == ARCHIVE else row[p] if p is not None and p < len(row) else None for n, p in zip(names, places)])
                if len(held) == BATCH_ROWS:
                    yield batch()
                    held = []
            if held:
                yield batch()


class ZippedCsv(DataSource):
    """``spark.read.format("zipped_csv").schema(...).load(path)``: path is an archive, a folder of them or a pattern in a folder, in any file system that Arrow opens; the option ``member`` names the file within. Columns are found by their header, whatever their order; those that a member lacks are null, and a column ``archive`` has the archive's name. All is text."""

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def schema(self) -> T.StructType:
        raise ValueError("zipped_csv needs a schema")

    def reader(self, schema: T.StructType) -> ZipReader:
        return ZipReader(schema, {k: self.options.get(k) for k in ("path", "member")})


def zipped_csv(spark: SparkSession, path: str, member: str, columns: Sequence[str]) -> DataFrame:
    """The rows of ``member`` in all archives of ``path``, with the archive's name. Archives without it have none."""
    from ..operators.tables import prepare_workers

    prepare_workers(spark)
    spark.dataSource.register(ZippedCsv)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (ARCHIVE, *columns)])
    return spark.read.format("zipped_csv").schema(schema).option("member", member).load(path)


def feed_archive(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The six tables of the timetable feeds in ``path``, each with the archive of its rows, as ids are unique in one feed only."""
    return {t: zipped_csv(spark, path, f"{t}.txt", columns) for t, columns in FEED.items()}
