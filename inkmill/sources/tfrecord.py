"""GZIP record files of tf.train.Example messages with int64 lists, written and read without that library.

A record file is a run of: length (8 bytes), masked CRC-32C of it, message, masked CRC-32C of the message.
An Example holds features {name: int64 list}. Both formats are public; protobuf's wire format is written
here for these messages alone, for a batch of rows at a time: whole numbers become bytes, and sums are worked
out, in arrays over all records of a batch.

`RecordSource` is the format for `spark.read` and `DataFrame.write` (`register`). Reading makes a task of each file and
parses the features that the schema names. Write tasks leave their files in a passing folder and tell them in their
commit messages; when all tasks are done the files get their numbers in the order of tasks, and counts go to
`meta.json`. The folder goes with a write that fails.
"""

from __future__ import annotations

import gzip
import json
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from inkmill.functions import arrays
from inkmill.functions.text import IGNORE_ID, ITEMS_PER_FILE

FEATURES = ("data", "pinyin", "attention_mask", "label")
END, FORMAT = ".tfrecord.gz", "inkmill_records"
#: Records that are parsed or written at a time, and bytes that are unpacked at a time.
RECORDS, CHUNK = 2000, 1 << 20


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


CRC_TABLE = np.array(_crc_table(), np.uint32)


def masked_crcs(messages: list[bytes]) -> np.ndarray:
    """Masked CRC-32C of each message, byte by byte over all messages at once."""
    size = np.array([len(m) for m in messages], np.int64)
    order = np.argsort(-size, kind="stable")
    out = np.full(len(messages), 0xFFFFFFFF, np.uint32)
    at = 0
    while at < len(order):
        # messages of like length side by side, some megabytes at a time
        most = int(size[order[at]])
        some = order[at : at + max(1, (4 << 20) // max(1, most))]
        cells = np.zeros((len(some), most), np.uint8)
        for row, i in enumerate(some):
            cells[row, : size[i]] = np.frombuffer(messages[i], np.uint8)
        cells = np.ascontiguousarray(cells.T)
        crc = out[some]
        alive = np.searchsorted(-size[some], -np.arange(most), "left")
        for j in range(most):
            n = alive[j]
            crc[:n] = CRC_TABLE[(crc[:n] ^ cells[j, :n]) & 255] ^ (crc[:n] >> np.uint32(8))
        out[some] = crc
        at += len(some)
    out ^= np.uint32(0xFFFFFFFF)
    return (out >> np.uint32(15) | out << np.uint32(17)) + np.uint32(0xA282EAD8)


def masked_crc(data: bytes) -> int:
    return int(masked_crcs([data])[0])


def varints(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(the values as protobuf's whole numbers one behind the other, where each ends)."""
    left = values.astype(np.int64).view(np.uint64)
    size = np.ones(len(left), np.int64)
    for k in range(1, 10):
        size += left >= np.uint64(1) << np.uint64(7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(10):
        longer = np.flatnonzero(size > k)
        if not len(longer):
            break
        byte = (left[longer] >> np.uint64(7 * k)).astype(np.uint8) & 127
        out[ends[longer] - size[longer] + k] = byte | np.where(size[longer] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes(), ends


def whole_numbers(body: bytes) -> np.ndarray:
    """varints() undone."""
    raw = np.frombuffer(body, np.uint8)
    last = np.flatnonzero(raw < 128)
    if not len(last):
        return np.zeros(0, np.int64)
    first = np.r_[0, last[:-1] + 1]
    place = np.arange(last[-1] + 1) - np.repeat(first, last - first + 1)
    return np.bitwise_or.reduceat((raw[: last[-1] + 1] & 127).astype(np.uint64) << (7 * place).astype(np.uint64), first).view(np.int64)


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _entry(name: str, numbers: bytes) -> bytes:
    return _field(1, _field(1, name.encode()) + _field(2, _field(3, _field(1, numbers))))


def serialize(features: dict[str, list[int] | None]) -> bytes:
    """An Example of the features that are not None, in the order of their names."""
    return _field(1, b"".join(_entry(n, varints(np.array(features[n], np.int64))[0]) for n in sorted(features) if features[n] is not None))


def serialized(columns: dict[str, pa.Array]) -> list[bytes]:
    """An Example for each row of list columns; null lists are left out."""
    rows = len(next(iter(columns.values())))
    entries: list[list[bytes]] = [[] for _ in range(rows)]
    for name in sorted(columns):
        column = columns[name]
        body, ends = varints(column.flatten().to_numpy(zero_copy_only=False))
        ends = np.r_[0, ends]
        size = pa.compute.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
        at = 0
        for i, n in enumerate(size.tolist()):
            if n >= 0:
                entries[i].append(_entry(name, body[ends[at] : ends[at + n]]))
                at += n
    return [_field(1, b"".join(e)) for e in entries]


def _take_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    at = 0
    while at < len(data):
        tag, at = _take_varint(data, at)
        if tag & 7 == 2:
            n, at = _take_varint(data, at)
            yield tag >> 3, data[at : at + n]
            at += n
        elif tag & 7 == 0:
            n, at = _take_varint(data, at)
            yield tag >> 3, n
        else:
            raise ValueError("a field that an Example of whole numbers does not have")


def parse(message: bytes, wanted: Iterable[str] | None = None) -> dict[str, np.ndarray]:
    """The features of an Example, or those of them that are wanted."""
    out: dict[str, np.ndarray] = {}
    for _, features in _fields(message):
        for _, entry in _fields(features):
            parts = dict(_fields(entry))
            name = parts[1].decode()
            if wanted is not None and name not in wanted:
                continue
            found = []
            for kind, numbers in _fields(parts.get(2, b"")):
                for _, body in _fields(numbers) if kind == 3 else ():
                    found.append(np.array([body], np.uint64).view(np.int64) if isinstance(body, int) else whole_numbers(body))
            out[name] = np.concatenate(found) if found else np.zeros(0, np.int64)
    return out


def framed(messages: list[bytes]) -> bytes:
    """Records of messages one behind the other."""
    sizes = [struct.pack("<Q", len(m)) for m in messages]
    sums = masked_crcs(messages + sizes).astype("<u4")
    return b"".join(x for i, m in enumerate(messages) for x in (sizes[i], sums[len(messages) + i].tobytes(), m, sums[i].tobytes()))


def unframed(stream) -> Iterator[list[bytes]]:
    """The messages of a binary stream, some thousands at a time; a broken record is an error."""
    messages, sums = [], []

    def checked() -> list[bytes]:
        if (masked_crcs(messages) != np.array(sums, np.uint32)).any():
            raise ValueError("a broken record")
        return messages

    while head := stream.read(12):
        if len(head) < 12 or masked_crc(head[:8]) != struct.unpack_from("<I", head, 8)[0]:
            raise ValueError("a broken record")
        n = struct.unpack_from("<Q", head)[0]
        body = stream.read(n + 4)
        if len(body) < n + 4:
            raise ValueError("a broken record")
        messages.append(body[:n])
        sums.append(struct.unpack_from("<I", body, n)[0])
        if len(messages) >= RECORDS:
            yield checked()
            messages, sums = [], []
    if messages:
        yield checked()


def records(store: fs.FileSystem, path: str, wanted: list[str]) -> Iterator[pa.RecordBatch]:
    """file, pos and the wanted features of a record file, never the whole of it at a time."""
    name, at = path.rpartition("/")[2], 0
    with store.open_input_stream(path, compression=None, buffer_size=CHUNK) as raw, gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw as stream:
        for messages in unframed(stream):
            found = [parse(m, wanted) for m in messages]
            n = len(found)
            columns = [pa.array([f.get(c) for f in found], pa.list_(pa.int64())) for c in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(at, at + n)), *columns], names=["file", "pos", *wanted])
            at += n


class _Shard:
    """A record file under a passing name until it is moved."""

    def __init__(self, store: fs.FileSystem, root: str):
        self.store, self.path, self.n, self.most, self.labels = store, f"{root}/.passing-{uuid.uuid4().hex}", 0, 0, False
        self.stream = store.open_output_stream(self.path, compression=None)
        self.out = gzip.GzipFile(fileobj=self.stream, mode="wb", mtime=0)

    def add(self, batch: pa.RecordBatch) -> None:
        columns = {c: batch.column(c) for c in batch.schema.names}
        self.out.write(framed(serialized(columns)))
        self.n += batch.num_rows
        self.most = max(self.most, pa.compute.max(pa.compute.list_value_length(columns["data"])).as_py() or 0)
        self.labels = self.labels or ("label" in columns and columns["label"].null_count < batch.num_rows)

    def close(self) -> None:
        self.out.close()
        self.stream.close()


def write(rows: DataFrame, folder: str, file: str, order: str) -> DataFrame:
    """Writes rows to the files named in their column `file`; gives file and n_items. Reruns leave whole files."""
    present = [c for c in FEATURES if c in rows.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, None
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)

        def close() -> pa.RecordBatch:
            shard.close()
            store.move(shard.path, f"{root}/{now}")
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([shard.n])], names=["file", "n_items"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if names[a] != now:
                    if shard:
                        yield close()
                    now, shard = names[a], _Shard(store, root)
                shard.add(batch.slice(a, b - a).select(present))
        if shard:
            yield close()

    chosen = rows.select(file, order, *[F.col(c).cast("array<bigint>").alias(c) for c in present]).repartition(file).sortWithinPartitions(file, order)
    return chosen.select(file, *present).mapInArrow(run, "file string, n_items long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, pos and the features of all records below a path."""
    register(spark)
    return spark.read.format(FORMAT).load(path)


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    task: int
    shards: list  # (passing path, records, most ids, whether there are labels)


class _Reader(DataSourceReader):
    def __init__(self, folder: str, schema: StructType):
        self.folder, self.names = folder, schema.names

    def partitions(self) -> list[_File]:
        store, root = fs.FileSystem.from_uri(self.folder)
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and ".tfrecord" in f.base_name and not f.base_name.startswith((".", "_"))]

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, _ = fs.FileSystem.from_uri(self.folder)
        for batch in records(store, partition.path, [n for n in self.names if n not in ("file", "pos")]):
            yield batch.select(self.names)


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, schema: StructType, overwrite: bool, items: int):
        self.folder, self.overwrite, self.items = folder, overwrite, items
        self.names = [c for c in FEATURES if c in schema.names]
        if "data" not in self.names:
            raise ValueError("records need a column data")
        store, root = fs.FileSystem.from_uri(folder)
        if not overwrite and any(f.base_name.endswith(END) for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True))):
            raise ValueError("the folder has record files already")
        # made here alone: what a lost task leaves goes with it, and a late one finds it gone
        self.passing = f"{root}/.passing-{uuid.uuid4().hex}"
        store.create_dir(self.passing, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, _ = fs.FileSystem.from_uri(self.folder)
        shards: list[_Shard] = []
        for batch in iterator:
            batch = pa.RecordBatch.from_arrays([batch.column(c).cast(pa.list_(pa.int64())) for c in self.names], names=self.names)
            at = 0
            while at < batch.num_rows:
                if not shards or shards[-1].n >= self.items:
                    if shards:
                        shards[-1].close()
                    shards.append(_Shard(store, self.passing))
                n = min(RECORDS, batch.num_rows - at, self.items - shards[-1].n)
                shards[-1].add(batch.slice(at, n))
                at += n
        if shards:
            shards[-1].close()
        return _Written(TaskContext.get().partitionId(), [(s.path, s.n, s.most, s.labels) for s in shards])

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.folder)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(root)):
                if f.base_name.endswith(END):
                    store.delete_file(f.path)
        shards = [s for m in sorted((m for m in messages if m), key=lambda m: m.task) for s in m.shards]
        names = [f"{i:08d}{END}" for i in range(len(shards))]
        for name, (path, *_) in zip(names, shards):
            store.move(path, f"{root}/{name}")
        store.delete_dir(self.passing)
        told = {"padding_shape": max((s[2] for s in shards), default=0), "count": sum(s[1] for s in shards), "files": names, "compression_type": "GZIP", "has_attention_mask": "attention_mask" in self.names, "has_label": any(s[3] for s in shards)}
        with store.open_output_stream(f"{root}/meta.json") as out:
            out.write(json.dumps(told).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        fs.FileSystem.from_uri(self.folder)[0].delete_dir(self.passing)


def as_uri(path: str) -> str:
    """A path with its store, as pyarrow wants it."""
    return f"file://{path}" if path.startswith("/") else path.replace("file:///", "file:/").replace("file:/", "file:///")


class RecordSource(DataSource):
    """Options: path, and `items`, the records of a file at most."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, pos long, " + ", ".join(f"{c} array<bigint>" for c in FEATURES)

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self._folder(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self._folder(), schema, overwrite, int(self.options.get("items", ITEMS_PER_FILE)))

    def _folder(self) -> str:
        return as_uri(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordSource)


def defaults(rows: DataFrame, shape: int) -> DataFrame:
    """Records as a model reads them: masks of ones and labels like the data where there are none, all padded."""
    mask = F.coalesce("attention_mask", F.transform("data", lambda _: F.lit(1).cast("long")))
    out = rows.withColumn("label", arrays.pad_right(F.coalesce("label", "data"), shape, IGNORE_ID)).withColumn("attention_mask", arrays.pad_right(mask, shape))
    return out.withColumn("data", arrays.pad_right("data", shape))
