"""Cells of workbooks as a Python data source: a partition for each sheet, filters pushed down, rows given on as they are read."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from quireframe.sources import office

NAME = "quire_sheets"
SCHEMA = "file_id string, sheet_id string, sheet_name string, row_index int, column_index int, type string, raw_value string, style_id int, formula string"
KINDS = pa.schema([("file_id", pa.string()), ("sheet_id", pa.string()), ("sheet_name", pa.string()), ("row_index", pa.int32()), ("column_index", pa.int32()), ("type", pa.string()), ("raw_value", pa.string()), ("style_id", pa.int32()), ("formula", pa.string())])
BATCH = 5000


@dataclass
class SheetPart(InputPartition):
    """A sheet of a file: what a task reads."""

    path: str
    sheet_id: str
    name: str
    part: str


@dataclass
class Window:
    """What filters leave of the cells: ids and names of sheets (None: all), rows and columns from first to last."""

    sheet_ids: set[str] | None = None
    names: set[str] | None = None
    first_row: int = 1
    last_row: int | None = None
    first_column: int = 1
    last_column: int | None = None

    def narrow(self, f: Filter) -> bool:
        """Take a filter on; False if it is of another kind."""
        column = f.attribute[0] if len(f.attribute) == 1 else ""
        if column in ("sheet_id", "sheet_name"):
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is None:
                return False
            field = "sheet_ids" if column == "sheet_id" else "names"
            before = getattr(self, field)
            setattr(self, field, wanted if before is None else before & wanted)
            return True
        if column not in ("row_index", "column_index"):
            return False
        first, last = ("first_row", "last_row") if column == "row_index" else ("first_column", "last_column")
        low = high = None
        if isinstance(f, EqualTo):
            low = high = f.value
        elif isinstance(f, GreaterThanOrEqual | GreaterThan):
            low = f.value + isinstance(f, GreaterThan)
        elif isinstance(f, LessThanOrEqual | LessThan):
            high = f.value - isinstance(f, LessThan)
        elif isinstance(f, In) and f.value:
            low, high = min(f.value), max(f.value)
        else:
            return False
        if low is not None:
            setattr(self, first, max(getattr(self, first), low))
        if high is not None:
            setattr(self, last, high if getattr(self, last) is None else min(getattr(self, last), high))
        return True


def opened(path: str) -> zipfile.ZipFile:
    """A package by its path in a store; only what is asked for is read."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    return zipfile.ZipFile(system.open_input_file(at))


def files_below(path: str) -> list[str]:
    """Workbooks below a folder (or the one file), in order, as paths that opened() takes."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    found = sorted(i.path for i in system.get_file_info(fs.FileSelector(at, recursive=True)) if i.type == fs.FileType.File and i.path.endswith(".xlsx"))
    return [path.rstrip("/") + f[len(at.rstrip("/")) :] for f in found]


def rows_of(package: zipfile.ZipFile, part: str, window: Window) -> Iterator[tuple]:
    """(row, column, type, raw value, style, formula) of a sheet's cells inside a window; reading ends behind its last row.

    Rows are parsed one at a time and dropped then, so a sheet is never held as a whole. A row without a number is the
    one after the last, a cell without a reference at the right of the one before.
    """
    number = 0
    with package.open(part) as source:
        data = None
        for event, node in ElementTree.iterparse(source, ("start", "end")):
            name = office._local(node.tag)
            if event == "start":
                if name == "sheetData":
                    data = node
                continue
            if name == "sheetData":
                return
            if name != "row" or data is None:
                continue
            number = int(node.get("r")) if node.get("r") else number + 1
            if number >= window.first_row and (window.last_row is None or number <= window.last_row):
                column = 0
                for c in node:
                    m = re.fullmatch(r"([A-Z]+)([0-9]+)", c.get("r") or "")
                    column = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(m[1]))) if m else column + 1
                    if column < window.first_column or window.last_column is not None and column > window.last_column:
                        continue
                    at = {office._local(x.tag): x for x in c}
                    value = "".join(t.text or "" for t in office._below(at["is"], "t")) if "is" in at else at["v"].text if "v" in at else None
                    yield number, column, c.get("t") or "n", value, int(c.get("s") or 0), at["f"].text if "f" in at else None
            if window.last_row is not None and number >= window.last_row:
                return
            data.clear()  # rows that are done


class SheetReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.window = path, Window()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on sheets, rows and columns narrow what is read; Spark checks them once more."""
        for f in filters:
            self.window.narrow(f)
            yield f

    def partitions(self) -> list[SheetPart]:
        """A partition for each sheet that the filters leave; of a file only the workbook's part is read here."""
        found = []
        for path in files_below(self.path):
            with opened(path) as package:
                for sheet_id, name, part, *_ in office._sheet_parts(package):
                    if (self.window.sheet_ids is None or sheet_id in self.window.sheet_ids) and (self.window.names is None or name in self.window.names) and part in package.namelist():
                        found.append(SheetPart(path, sheet_id, name, part))
        return found

    def read(self, partition: SheetPart) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        with opened(partition.path) as package:
            for row in rows_of(package, partition.part, self.window):
                rows.append((partition.path, partition.sheet_id, partition.name, *row))
                if len(rows) == BATCH:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), KINDS, strict=True)], schema=KINDS)


class SheetSource(DataSource):
    """spark.read.format("quire_sheets").load(path): the cells of the workbooks below a path."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SheetReader:
        return SheetReader(self.options["path"])


def raw_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of the workbooks below a path; filters on sheet_id, sheet_name, row_index and column_index reach the source.

    Planning opens each file's workbook part, so a folder of very many files is better read by sources.office, in which
    tasks do that; large sheets are what this is for. A sheet that cannot be read fails its task.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SheetSource)
    return spark.read.format(NAME).load(path)


def shown(cells: DataFrame, strings: DataFrame) -> DataFrame:
    """raw_cells() with value: the shared string of an index, TRUE or FALSE, else the raw value."""
    index = F.when(F.col("type") == "s", F.col("raw_value").try_cast("int"))
    joined = cells.withColumn("_index", index).join(strings.select("file_id", F.col("index").alias("_index"), F.col("value").alias("_string")), ["file_id", "_index"], "left")
    value = F.when(F.col("type") == "s", F.coalesce("_string", F.lit(""))).when(F.col("type") == "b", F.when(F.col("raw_value") == "1", "TRUE").otherwise("FALSE")).otherwise(F.coalesce("raw_value", F.lit("")))
    return joined.withColumn("value", value).drop("_index", "_string")
