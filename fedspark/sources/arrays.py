"""The data source `arrays`: .npy files, read by ranges of rows and written in parts that a list commits."""

from __future__ import annotations

import ast
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .storage import files_below, opened, put

#: The list of an array's parts, in their order.
PARTS = "_parts.json"
#: Bytes of rows that one task reads, about, and in one Arrow batch.
TASK_BYTES, BATCH_BYTES = 64 << 20, 4 << 20


def header(data: bytes) -> tuple[np.dtype, tuple[int, ...], int]:
    """(dtype, shape, where rows begin) by the beginning of a .npy file. Objects and Fortran order aren't read."""
    if data[:6] != b"\x93NUMPY":
        raise ValueError("not a .npy file")
    long = data[6] > 1
    at = 12 if long else 10
    size = struct.unpack("<I" if long else "<H", data[8:at])[0]
    fields = ast.literal_eval(data[at : at + size].decode("utf-8" if data[6] > 2 else "latin1").strip())
    dtype = np.dtype(fields["descr"])
    if dtype.hasobject or fields["fortran_order"] and len(fields["shape"]) > 1:
        raise ValueError("only numbers in rows can be read")
    return dtype, tuple(fields["shape"]), at + size


def encoded_header(dtype: np.dtype, shape: tuple[int, ...]) -> bytes:
    """The beginning of a .npy file (version 1), filled up to whole 64 bytes."""
    text = repr({"descr": np.lib.format.dtype_to_descr(dtype), "fortran_order": False, "shape": shape})
    text += " " * (-(len(text) + 11) % 64) + "\n"
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(text)) + text.encode("latin1")


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    count: int
    before: int


class ArrayReader(DataSourceReader):
    """(row, values): the rows of a .npy file, or of a folder's in the order of their list or else of their names. A task
    reads the bytes of its range of rows alone; each row's values are flat, and null where they aren't in the schema."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.most, self.schema = options["path"], int(options.get("bytespertask", TASK_BYTES)), schema

    def partitions(self) -> list[Rows]:
        store, root = opened(self.path)
        if root.endswith(".npy"):
            names = [root]
        elif store.get_file_info(f"{root}/{PARTS}").is_file:
            with store.open_input_file(f"{root}/{PARTS}") as file:
                names = [f"{root}/{n}" for n in json.loads(file.read())]
        else:
            names = [p for p, _ in files_below(self.path, (".npy",))]
        out, before = [], 0
        for name in names:
            with store.open_input_file(name) as file:
                dtype, shape, at = header(file.read_at(min(file.size(), 1 << 16), 0))
                width = int(np.prod(shape[1:], dtype=np.int64)) * dtype.itemsize
                if file.size() < at + shape[0] * width:
                    raise ValueError(f"{name} ends before its rows do")
            step = max(1, self.most // max(width, 1))
            out += [Rows(name, first, min(step, shape[0] - first), before + first) for first in range(0, shape[0], step)]
            before += shape[0]
        return out or [Rows("", 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        arrow = to_arrow_schema(self.schema)
        store, _ = opened(self.path)
        with store.open_input_file(partition.path) as file:
            dtype, shape, at = header(file.read_at(min(file.size(), 1 << 16), 0))
            cells = int(np.prod(shape[1:], dtype=np.int64))
            step = max(1, BATCH_BYTES // max(cells * dtype.itemsize, 1))
            for first in range(partition.first, partition.first + partition.count, step):
                n = min(step, partition.first + partition.count - first)
                columns = []
                for field in arrow:
                    if field.name == "values":
                        data = file.read_at(n * cells * dtype.itemsize, at + first * cells * dtype.itemsize)
                        flat = np.frombuffer(data, dtype).astype(dtype.newbyteorder("="))
                        columns.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * cells), pa.array(flat)).cast(field.type))
                    else:
                        columns.append(pa.array(partition.before + first - partition.first + np.arange(n), field.type))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)


@dataclass
class Part(WriterCommitMessage):
    order: int
    name: str


class ArrayWriter(DataSourceArrowWriter):
    """Rows' `values` as .npy files of `dtype` and rows of `shape` (comma-separated; one number each without it): a part for
    each task, in the order of partitions. The list of parts is written last, so what a failed or doubled task leaves is never read."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.dtype = options["path"], np.dtype(options.get("dtype", "float32"))
        self.shape = tuple(int(x) for x in options.get("shape", "").split(",") if x)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, root = opened(self.path)
        order = TaskContext.get().partitionId()
        name = f"part-{order:05d}-{uuid.uuid4().hex}.npy"
        cells, rows, hidden = int(np.prod(self.shape, dtype=np.int64)), 0, f"{root}/_{name}"
        store.create_dir(root, recursive=True)
        with store.open_output_stream(hidden) as out:
            for batch in iterator:
                column = batch.column("values")
                flat = (column.flatten() if pa.types.is_list(column.type) else column).to_numpy(zero_copy_only=False)
                if len(flat) != len(batch) * cells or column.null_count:
                    raise ValueError(f"every row must have {cells} values")
                out.write(np.ascontiguousarray(flat, self.dtype).tobytes())
                rows += len(batch)
        with store.open_input_file(hidden) as body, store.open_output_stream(f"{root}/{name}") as out:  # the header has the number of rows
            out.write(encoded_header(self.dtype, (rows, *self.shape)))
            while block := body.read(BATCH_BYTES):
                out.write(block)
        store.delete_file(hidden)
        return Part(order, name)

    def commit(self, messages: list) -> None:
        store, root = opened(self.path)
        names = [m.name for m in sorted((m for m in messages if m is not None), key=lambda m: m.order)]
        put(store, f"{root}/{PARTS}", json.dumps(names).encode())

    def abort(self, messages: list) -> None:
        store, root = opened(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{root}/{m.name}")


class Arrays(DataSource):
    """`spark.read.format("arrays").load(path)` and `df.write.format("arrays").option("shape", "8,8").save(folder)`."""

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        return "row long, values array<double>"

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Arrays)
