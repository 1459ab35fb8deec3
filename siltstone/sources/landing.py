"""A data source for what log and ticket services answer: folders of JSON lines, or any backend.

A backend lists its pages and fetches one page's records; each page is a partition of its own,
read on the executors. Comparisons of columns with constants are pushed down: the backend may
skip pages by them, and records are filtered before they become rows. As a stream, pages that
are new since the last batch are read, in order of their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from typing import Any

import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType, TimestampType

NAME = "siltstone_landing"
#: What can be told of a record's value without Spark.
TESTS = {
    EqualTo: lambda v, f: v is not None and v == f.value,
    EqualNullSafe: lambda v, f: v == f.value,
    GreaterThan: lambda v, f: v is not None and v > f.value,
    GreaterThanOrEqual: lambda v, f: v is not None and v >= f.value,
    LessThan: lambda v, f: v is not None and v < f.value,
    LessThanOrEqual: lambda v, f: v is not None and v <= f.value,
    In: lambda v, f: v is not None and v in f.value,
    IsNull: lambda v, f: v is None,
    IsNotNull: lambda v, f: v is not None,
    StringContains: lambda v, f: v is not None and f.value in v,
    StringStartsWith: lambda v, f: v is not None and v.startswith(f.value),
    StringEndsWith: lambda v, f: v is not None and v.endswith(f.value),
}


class FolderBackend:
    """Pages are the files of a folder that pyarrow can open (local, HDFS, S3, GCS), named so that later ones sort later.

    A file name may begin with ``column=value`` parts, separated by commas; a page whose parts
    contradict an equality is not read.
    """

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def _fs(self) -> tuple[Any, str]:
        return pyarrow.fs.FileSystem.from_uri(self.path) if "://" in self.path else (pyarrow.fs.LocalFileSystem(), self.path)

    def pages(self) -> list[str]:
        fs, path = self._fs()
        return sorted(f.base_name for f in fs.get_file_info(pyarrow.fs.FileSelector(path)) if f.is_file and f.base_name.endswith(".json"))

    def may_hold(self, page: str, filters: list[Filter]) -> bool:
        said = dict(part.split("=", 1) for part in page.removesuffix(".json").split(",") if "=" in part)
        return not any(isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in said and said[f.attribute[0]] != str(f.value) for f in filters)

    def fetch(self, page: str) -> Iterator[dict]:
        fs, path = self._fs()
        with fs.open_input_stream(f"{path}/{page}") as f:
            for line in f.read().decode("utf-8").split("\n"):
                if line.strip():
                    yield json.loads(line)


class Page(InputPartition):
    def __init__(self, page: str):
        self.page = page


def value_of(record: dict, name: str, kind: Any) -> Any:
    """A record's field as its column has it; times are ISO 8601, those without a zone UTC."""
    v = record.get(name)
    if v is None or not isinstance(kind, TimestampType):
        return v
    at = datetime.fromisoformat(v)
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


class LandingReader(DataSourceReader):
    def __init__(self, backend: Any, schema: StructType):
        self.backend, self.schema, self.filters = backend, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of a top column are taken over; the others are left to Spark."""
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Page]:
        return [Page(p) for p in self.backend.pages() if self.backend.may_hold(p, self.filters)]

    def read(self, partition: Page | None) -> Iterator[tuple]:
        if partition is None:  # Spark's stand-in where no page is left
            return
        for record in self.backend.fetch(partition.page):
            row = {f.name: value_of(record, f.name, f.dataType) for f in self.schema.fields}
            if all(TESTS[type(f)](row[f.attribute[0]], f) for f in self.filters):
                yield tuple(row.values())


class LandingStreamReader(DataSourceStreamReader):
    """Offsets are how many pages have been read; names sort by arrival."""

    def __init__(self, backend: Any, schema: StructType):
        self.reader = LandingReader(backend, schema)

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": len(self.reader.backend.pages())}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(p) for p in self.reader.backend.pages()[start["pages"] : end["pages"]]]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.reader.read(partition)


class Landing(DataSource):
    """``spark.read.format("siltstone_landing").schema(...).load(folder)``; ``BACKEND`` of a subclass reads from elsewhere."""

    BACKEND: Any = FolderBackend

    @classmethod
    def name(cls) -> str:
        return NAME

    def reader(self, schema: StructType) -> LandingReader:
        return LandingReader(self.BACKEND(self.options), schema)

    def streamReader(self, schema: StructType) -> LandingStreamReader:
        return LandingStreamReader(self.BACKEND(self.options), schema)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Landing)
