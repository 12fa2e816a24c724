"""Page layouts as a data source: files read by a decoder, a task for each range of pages.

    spark.dataSource.register(LayoutSource)
    spark.read.format("layout").schema("document string, page int, spans ...").load(folder)

A decoder opens a file, tells how many pages it has, and yields pages. Which columns a reader's schema names is handed to
the decoder, so that a costly one, as the drawings are, is decoded only where it is asked for. Files above splitBytes
are cut into tasks of pagesPerTask pages; smaller ones are put together up to that size, so that tasks follow the bytes.
Pages are narrowed by the options firstPage and lastPage, or, with the option pushdown, by a filter on page (needs
spark.sql.python.filterPushdown.enabled). A file that can't be decoded gives one row with its path and error and no
page; with mode failfast the job fails.

Folders are reached through pyarrow's file systems, so they may be local, shared, or in a store that these know.
"""

from __future__ import annotations

import importlib
import io
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import BinaryIO, Protocol

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from foliant.session import ship

BOX = "x0: double, y0: double, x1: double, y1: double"
SCHEMA = f"""path string, document string, page int, width double, height double, rotation int,
  spans array<struct<text: string, size: double, font: string, color: int, {BOX}>>,
  drawings array<struct<kind: string, {BOX}, color: int, width: double>>, error string"""
#: Rows of a batch, and of a file that is written; a page holds many spans.
BATCH, FILE_PAGES = 256, 512


class Decoder(Protocol):
    """How a kind of file is read. Both are given the file anew."""

    def count(self, file: BinaryIO) -> int:
        """The number of pages."""

    def pages(self, file: BinaryIO, first: int, last: int, columns: frozenset[str]) -> Iterator[dict]:
        """Pages first to last, from 1, with at least these columns."""


class JsonPages:
    """A page a line, as JSON under the names of SCHEMA."""

    def count(self, file: BinaryIO) -> int:
        return sum(1 for line in file if line.strip())

    def pages(self, file: BinaryIO, first: int, last: int, columns: frozenset[str]) -> Iterator[dict]:
        lines = (line for line in file if line.strip())
        for n, line in enumerate(lines, 1):
            if n > last:
                return
            if n >= first:
                yield {"page": n} | json.loads(line)


@dataclass
class Part(InputPartition):
    """(path, first, last) of the page ranges of a task; last 0: to the end."""

    ranges: list[tuple[str, int, int]]


class LayoutSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "layout"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return (PushingReader if self.options.get("pushdown", "false") == "true" else LayoutReader)(schema, dict(self.options))


class LayoutReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.fields, self.schema = frozenset(schema.names), schema
        self.path, self.failfast = options["path"], options.get("mode", "permissive") == "failfast"
        self.module, self.decoder = options.get("decoder", "foliant.sources.layout:JsonPages").split(":")
        self.suffix = options.get("suffix", "")
        self.first, self.last = int(options.get("firstpage", options.get("firstPage", "1"))), int(options.get("lastpage", options.get("lastPage", str(2**31 - 1))))
        self.split, self.step = int(options.get("splitbytes", options.get("splitBytes", str(32 << 20)))), int(options.get("pagespertask", options.get("pagesPerTask", "64")))

    def _store(self, path: str) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)

    def _decoder(self) -> Decoder:
        return getattr(importlib.import_module(self.module), self.decoder)()

    def partitions(self) -> Sequence[InputPartition]:
        store, path = self._store(self.path)
        info = store.get_file_info(path)
        found = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(path, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.endswith(self.suffix) and not f.base_name.startswith(("_", ".")))
        parts, held, size = [], [], 0
        for name, n in files:
            if n > self.split and self.first <= self.last:
                parts += [Part([r]) for r in self._ranges(store, name)]
                continue
            if held and size + n > self.split:
                parts.append(Part(held))
                held, size = [], 0
            held.append((name, self.first, self.last))
            size += n
        return [*parts, *([Part(held)] if held else [])] or [Part([])]

    def _ranges(self, store: pafs.FileSystem, name: str) -> list[tuple[str, int, int]]:
        """The page ranges of a large file; one that can't be counted is left to a task, which tells why."""
        try:
            with io.BufferedReader(store.open_input_file(name)) as file:
                last = min(self.last, self._decoder().count(file))
        except Exception:  # noqa: BLE001  (any decoder may fail in its own way)
            return [(name, self.first, self.last)]
        return [(name, at, min(at + self.step - 1, last)) for at in range(self.first, last + 1, self.step)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        store, decoder, schema = self._store(self.path)[0], self._decoder(), to_arrow_schema(self.schema)
        rows: list[dict] = []
        for name, first, last in partition.ranges:
            try:
                with io.BufferedReader(store.open_input_file(name)) as file:
                    for page in decoder.pages(file, first, last, self.fields):
                        rows.append({"path": name} | page)
                        if len(rows) == BATCH:
                            yield self._batch(rows, schema)
                            rows = []
            except Exception as why:  # noqa: BLE001
                if self.failfast:
                    raise
                rows.append({"path": name, "error": f"{type(why).__name__}: {why}"})
        if rows:
            yield self._batch(rows, schema)

    @staticmethod
    def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema=schema)


class PushingReader(LayoutReader):
    """Narrows the pages by filters on page. Spark applies them again, since failed files have no page."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("page",):
                low = {EqualTo: 0, GreaterThan: 1, GreaterThanOrEqual: 0}
                high = {EqualTo: 0, LessThan: -1, LessThanOrEqual: 0}
                if isinstance(f, In):
                    known = [v for v in f.value if v is not None]
                    self.first, self.last = max(self.first, min(known, default=1)), min(self.last, max(known, default=0))
                if type(f) in low:
                    self.first = max(self.first, f.value + low[type(f)])
                if type(f) in high:
                    self.last = min(self.last, f.value + high[type(f)])
            yield f


def read_layouts(spark: SparkSession, path: str, schema: str = SCHEMA, **options: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(LayoutSource)
    return spark.read.format("layout").schema(schema).options(**options).load(path)


def write_layouts(pages: DataFrame, path: str) -> None:
    """Pages (columns of SCHEMA) as files of JSON lines, FILE_PAGES at most in each: a large file is counted by the driver, and read from its start for each of its ranges."""
    lines = pages.select(F.to_json(F.struct(*pages.columns)).alias("value"))
    lines.write.option("maxRecordsPerFile", FILE_PAGES).text(path)


def thin(x0: Column, y0: Column, x1: Column, y1: Column, thickest: float = 2.0) -> Column:
    """Whether a drawing is a thin rule across."""
    return (x1 > x0) & (y1 - y0 <= thickest)


def thin_count(drawings: Column, thickest: float = 2.0) -> Column:
    """How many of a page's drawings are thin rules across: counted beside what else is read of the page, in one reading."""
    return F.coalesce(F.size(F.filter(drawings, lambda d: thin(d["x0"], d["y0"], d["x1"], d["y1"], thickest))), F.lit(0))


def thin_lines(pages: DataFrame, thickest: float = 2.0) -> DataFrame:
    """(path, page, x0, y0, x1, y1, color, width) of the drawings that are thin rules across."""
    each = pages.select("path", "page", F.inline("drawings"))
    return each.where(thin(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], thickest)).select("path", "page", "x0", "y0", "x1", "y1", "color", "width")
