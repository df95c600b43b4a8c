"""A stream that replays files in an order of its own, epoch by epoch, without end or so many times.

Spark's file streams take files by the time of their last change and each only once. Here files go by their
names and rows by their place, and the offset says how far the stream has come: (epoch, file, row). It is all a
restart needs to go on where the last batch stopped. Each batch has up to `rows` rows; a part of a file is a
task. Rows come with `epoch` and `place`, which orders those of an epoch: the file's number and the row's in it.

Files are Parquet files (a footer tells the number of rows) or record files, which are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from inkmill.sources import tfrecord

FORMAT = "inkmill_replay"
#: Places of one file: the file's number stands before them.
FILE_ROWS = 1 << 40


@dataclass
class _Part(InputPartition):
    epoch: int
    number: int
    path: str
    first: int
    end: int | None


def advanced(at: tuple[int, int, int], sizes: list[int | None], rows: int, epochs: int | None) -> tuple[int, int, int]:
    """The offset up to `rows` rows further, within one epoch; files without a size count as that many rows."""
    epoch, file, row = at
    if epochs is not None and epoch >= epochs or not any(n is None or n for n in sizes):
        return at
    while rows > 0 and file < len(sizes):
        n = sizes[file]
        if n is None or row + rows >= n:
            rows -= rows if n is None else n - row
            file, row = file + 1, 0
        else:
            row, rows = row + rows, 0
    return (epoch + 1, 0, 0) if file == len(sizes) else (epoch, file, row)


def between(start: tuple[int, int, int], end: tuple[int, int, int], sizes: list[int | None]) -> Iterator[tuple[int, int, int, int | None]]:
    """(epoch, file, first row, row behind the last) from one offset to another."""
    epoch, file, row = start
    while (epoch, file, row) < end:
        last = end[2] if (epoch, file) == end[:2] else sizes[file]
        if last is None or last > row:
            yield epoch, file, row, last
        if (epoch, file) == end[:2]:
            return
        file, row = file + 1, 0
        if file == len(sizes):
            epoch, file = epoch + 1, 0


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: str, schema: StructType, rows: int, epochs: int | None):
        self.folder, self.names, self.rows, self.epochs = folder, [n for n in schema.names if n not in ("epoch", "place")], rows, epochs
        self.order = schema.names
        store, root = fs.FileSystem.from_uri(folder)
        found = sorted(f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
        # all that is listed as the stream begins; what comes later is another stream
        self.paths = [p for p in found if p.endswith(".parquet") or ".tfrecord" in p]
        self.sizes = [pq.ParquetFile(store.open_input_file(p)).metadata.num_rows if p.endswith(".parquet") else None for p in self.paths]
        self.told: tuple[int, int, int] | None = None

    def initialOffset(self) -> dict:
        return {"epoch": 0, "file": 0, "row": 0}

    @staticmethod
    def _offset(at: dict) -> tuple[int, int, int]:
        return at["epoch"], at["file"], at["row"]

    def latestOffset(self) -> dict:
        # a restart tells the last offset by asking for its parts before it asks for more
        self.told = advanced(self.told or (0, 0, 0), self.sizes, self.rows, self.epochs)
        return dict(zip(("epoch", "file", "row"), self.told))

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        self.told = max(self.told or (0, 0, 0), self._offset(end))
        return [_Part(epoch, file, self.paths[file], first, last) for epoch, file, first, last in between(self._offset(start), self._offset(end), self.sizes)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.folder)
        batches = pq.ParquetFile(store.open_input_file(part.path)).iter_batches(batch_size=tfrecord.RECORDS, columns=self.names) if part.path.endswith(".parquet") else tfrecord.records(store, part.path, self.names)
        at = 0
        for batch in batches:
            n, first = batch.num_rows, max(0, part.first - at)
            end = n if part.end is None else min(n, part.end - at)
            if first < end:
                some = batch.slice(first, end - first)
                columns = {c: some.column(c) for c in self.names}
                columns["epoch"] = pa.array([part.epoch] * len(some), pa.int32())
                columns["place"] = pa.array(range(part.number * FILE_ROWS + at + first, part.number * FILE_ROWS + at + end), pa.int64())
                yield pa.RecordBatch.from_arrays([columns[c] for c in self.order], names=self.order)
            at += n
            if part.end is not None and at >= part.end:
                return

    def commit(self, end: dict) -> None:
        pass


class ReplaySource(DataSource):
    """Options: path, `rows` of a batch (1000), `epochs` (without end unless given). The schema names the columns, epoch and place."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        raise ValueError("a replay needs a schema with epoch int and place long")

    def streamReader(self, schema: StructType) -> _Stream:
        epochs = self.options.get("epochs")
        return _Stream(tfrecord.as_uri(self.options["path"]), schema, int(self.options.get("rows", 1000)), int(epochs) if epochs else None)


def replay(spark: SparkSession, path: str, columns: str, rows: int = 1000, epochs: int | None = None):
    """The stream of the files' columns (as in a schema), epoch and place."""
    spark.dataSource.register(ReplaySource)
    read = spark.readStream.format(FORMAT).schema(f"{columns}, epoch int, place long").option("path", path).option("rows", rows)
    return (read.option("epochs", epochs) if epochs else read).load()
