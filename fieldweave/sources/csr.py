"""Compressed sparse rows as a Spark source: a folder with indptr.npy, indices.npy, data.npy and, if known, shape.npy.

Tasks read ranges of rows, and of the value arrays only the bytes of those rows. A lower and an upper bound
of the row, given as options or pushed down from filters, drop whole ranges before anything is read. Paths
are local ones or any that Arrow's file systems open. Arrays that contradict one another are an error: in
length when the scan is planned, in order and column range when a task reads them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "row long, col long, value double"


class _Array:
    """A one-dimensional .npy file of which slices are read."""

    def __init__(self, path: str):
        store, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        self.file = store.open_input_file(place)
        version = np.lib.format.read_magic(self.file)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, _, self.dtype = read(self.file)
        if len(shape) != 1 or self.dtype.hasobject:
            raise ValueError(f"{path} is not a plain one-dimensional array")
        self.length, self.start = shape[0], self.file.tell()

    def __getitem__(self, span: tuple[int, int]) -> np.ndarray:
        first, end = span
        self.file.seek(self.start + first * self.dtype.itemsize)
        return np.frombuffer(self.file.read((end - first) * self.dtype.itemsize), self.dtype)


@dataclass
class Rows(InputPartition):
    first: int
    end: int


class CsrReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.step = int(options.get("rows_per_task", 1 << 16))
        self.low, self.high = int(options.get("first_row", 0)), int(options["end_row"]) if "end_row" in options else None

    def array(self, name: str) -> _Array:
        return _Array(f"{self.path}/{name}.npy")

    def shape(self) -> tuple[int, int] | None:
        try:
            n = self.array("shape")[0, 2]
        except FileNotFoundError:
            return None
        return int(n[0]), int(n[1])

    def pushFilters(self, filters) -> Iterator:
        """Bounds of the row narrow the ranges; Spark still applies every filter."""
        for f in filters:
            if getattr(f, "attribute", None) == ("row",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value)
                if isinstance(f, GreaterThan):
                    self.low = max(self.low, f.value + 1)
                if isinstance(f, (EqualTo, LessThanOrEqual)):
                    self.high = min(f.value + 1, f.value + 1 if self.high is None else self.high)
                if isinstance(f, LessThan):
                    self.high = min(f.value, f.value if self.high is None else self.high)
            yield f

    def partitions(self) -> list[Rows]:
        pointers, indices, data = self.array("indptr"), self.array("indices"), self.array("data")
        rows = pointers.length - 1
        ends = pointers[0, 1].tolist() + pointers[rows, rows + 1].tolist() if rows >= 0 else []
        shape = self.shape()
        if rows < 0 or ends != [0, indices.length] or indices.length != data.length or shape and shape[0] != rows:
            raise ValueError(f"the arrays in {self.path} contradict one another: {rows} rows, pointers {ends}, {indices.length} columns, {data.length} values, shape {shape}")
        high = rows if self.high is None else min(self.high, rows)
        return [Rows(s, min(s + self.step, high)) for s in range(max(0, self.low), high, self.step)] or [Rows(0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if part.end <= part.first:
            return
        pointers = self.array("indptr")[part.first, part.end + 1].astype(np.int64)
        counts = np.diff(pointers)
        if (counts < 0).any():
            raise ValueError(f"row pointers fall between rows {part.first} and {part.end}")
        span = int(pointers[0]), int(pointers[-1])
        columns, shape = self.array("indices")[span].astype(np.int64), self.shape()
        if len(columns) and (columns.min() < 0 or shape and columns.max() >= shape[1]):
            raise ValueError(f"column numbers lie outside the shape between rows {part.first} and {part.end}")
        row = np.repeat(np.arange(part.first, part.end), counts)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(columns), pa.array(self.array("data")[span].astype(np.float64))], ["row", "col", "value"])


class CsrSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fieldweave_csr"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CsrReader:
        return CsrReader(dict(self.options))


def read_csr(spark: SparkSession, path: str, first_row: int | None = None, end_row: int | None = None, rows_per_task: int = 1 << 16) -> DataFrame:
    """(row, col, value) of rows first_row (inclusive) to end_row (exclusive)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # else Spark refuses sources that take filters
    spark.dataSource.register(CsrSource)
    reader = spark.read.format("fieldweave_csr").option("rows_per_task", rows_per_task)
    bounds = {"first_row": first_row, "end_row": end_row}
    for name, value in bounds.items():
        if value is not None:
            reader = reader.option(name, value)
    return reader.load(path)


def select_rows(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """rows(row, new_row): the entries of the wanted rows under their new numbers; a row may be wanted more than once."""
    return entries.join(rows, "row").select(rows["new_row"].alias("row"), "col", "value")
