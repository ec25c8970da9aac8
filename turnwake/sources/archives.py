"""Monthly archives as a data source of Spark: ``spark.read.format("on_time_archives")``.

Each archive is a partition, unzipped as it is read by the task that has it. Its month is in its name, so
filters on FlightDate or archive_month are pushed to the scan and archives that cannot hold a row are not
opened; dates inside an archive that is read are still compared by Spark. Of the columns only those of the
schema asked for are parsed out of the text.
"""

from __future__ import annotations

import datetime as dt
import fnmatch
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .flights import RAW, csv_batches

MONTH = "archive_month"
#: Fixed value: how a monthly file is named.
NAME = re.compile(r"_(\d{4})_(\d{1,2})\.zip$")
#: Text columns but for the date; ``scan`` gives the others their types, by the casts that ``read_csv`` uses.
TEXT = T.StructType([T.StructField(f.name, f.dataType if f.name == "FlightDate" else T.StringType()) for f in RAW] + [T.StructField(MONTH, T.StringType())])


@dataclass
class Archive(InputPartition):
    path: str
    month: str | None  # yyyy-mm; None: the name does not say


def _first_days(month: str) -> tuple[dt.date, dt.date]:
    """The month's first day and the next month's."""
    year, m = map(int, month.split("-"))
    return dt.date(year, m, 1), dt.date(year + m // 12, m % 12 + 1, 1)


def may_hold(month: str | None, f: Filter) -> bool:
    """Whether an archive of that month can have a row that passes the filter."""
    if month is None or f.attribute not in (("FlightDate",), (MONTH,)):
        return True
    if f.attribute == (MONTH,):
        tests = {EqualTo: lambda v: month == v, In: lambda v: month in v, GreaterThan: lambda v: month > v, GreaterThanOrEqual: lambda v: month >= v, LessThan: lambda v: month < v, LessThanOrEqual: lambda v: month <= v}
    else:
        lo, hi = _first_days(month)
        within = lambda v: v is not None and lo <= v < hi
        tests = {EqualTo: within, In: lambda v: any(map(within, v)), GreaterThan: lambda v: hi - dt.timedelta(days=1) > v, GreaterThanOrEqual: lambda v: hi > v, LessThan: lambda v: lo < v, LessThanOrEqual: lambda v: lo <= v}
    test = tests.get(type(f))
    return test is None or test(f.value)


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType) -> None:
        self.path, self.schema, self.filters = path, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what chooses archives; all is compared again by Spark, row by row, but for the month of an archive."""
        for f in filters:
            known = type(f) in (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
            if known and f.attribute in (("FlightDate",), (MONTH,)):
                self.filters.append(f)
            yield f

    def partitions(self) -> list[Archive]:
        store, place = _store(self.path)
        found = [Archive(p, f"{m[1]}-{int(m[2]):02d}" if (m := NAME.search(p)) else None) for p in sorted(_listed(store, place))]
        return [a for a in found if all(may_hold(a.month, f) for f in self.filters)] or [Archive("", None)]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = _store(self.path)
        names = self.schema.names
        with store.open_input_file(partition.path) as f:
            for b in csv_batches(f, [n for n in names if n != MONTH] or ["FlightDate"]):
                yield pa.RecordBatch.from_arrays([self._column(b, n, partition.month) for n in names], names)

    def _column(self, b: pa.RecordBatch, name: str, month: str | None) -> pa.Array:
        if name == MONTH:
            return pa.array([month] * b.num_rows, pa.string())
        if name == "FlightDate":
            return pc.strptime(b.column(name), "%Y-%m-%d", "s", error_is_null=True).cast(pa.date32())
        return b.column(name)


class OnTimeArchives(DataSource):
    """Option ``path``: a folder, a pattern of file names in a folder, or a file, on any store that Arrow opens."""

    @classmethod
    def name(cls) -> str:
        return "on_time_archives"

    def schema(self) -> T.StructType:
        return TEXT

    def reader(self, schema: T.StructType) -> Reader:
        if unknown := set(schema.names) - set(TEXT.names):
            raise ValueError(f"archives have no columns {sorted(unknown)}")
        return Reader(self.options["path"], schema)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _listed(store: fs.FileSystem, place: str) -> list[str]:
    folder, _, last = place.rpartition("/")
    if last.endswith(".zip"):
        pattern = last
    else:
        folder, pattern = place, "*.zip"
    inside = store.get_file_info(fs.FileSelector(folder or "/"))
    return [i.path for i in inside if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, pattern)]


def scan(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Typed flights of a folder's archives with their archive_month; ``columns``: those that are parsed (None: all kept ones)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(OnTimeArchives)
    wanted = [f for f in TEXT if f.name == MONTH or columns is None or f.name in columns]
    if unknown := set(columns or ()) - set(RAW.names) - {MONTH}:
        raise ValueError(f"archives have no columns {sorted(unknown)}")
    rows = spark.read.format("on_time_archives").schema(T.StructType(wanted)).load(path)
    typed = [rows[f.name].try_cast(f.dataType).alias(f.name) if f.name != "FlightDate" else rows[f.name] for f in RAW if f.name in rows.columns]
    return rows.select(*typed, MONTH)
