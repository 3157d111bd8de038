"""The data source `volumes`: NIfTI-1 files read by slices and written one file a sample."""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import nifti
from .storage import files_below, opened, packed, put

#: Bytes of files that one task reads, about, and slices in one Arrow batch.
TASK_BYTES, SLICES_AT_ONCE = 64 << 20, 96


@dataclass
class Paths(InputPartition):
    paths: list[str]


class VolumeReader(DataSourceReader):
    """A row for each of three slices of each file, or one with its error (nifti.SCHEMA).

    A task takes files of about `bytesPerTask` bytes. What isn't in the schema that is asked for isn't made: without an
    image, files are only held against what their headers promise. Of a file that isn't compressed, slices along the last
    axis are read alone. Filters by label or path leave out files before they are opened.
    """

    def __init__(self, options: dict, schema: StructType):
        self.path, self.most = options["path"], int(options.get("bytespertask", TASK_BYTES))
        self.size = None if options.get("resize", "true") == "false" else nifti.SIZE
        self.schema = schema
        self.wanted = [f.name for f in schema]
        self.only: list[tuple[str, set]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("label",), ("path",)):
                self.only.append((f.attribute[0], {f.value}))
            elif isinstance(f, In) and f.attribute in (("label",), ("path",)):
                self.only.append((f.attribute[0], set(f.value)))
            else:
                yield f

    def partitions(self) -> list[Paths]:
        chosen = [(p, n) for p, n in files_below(self.path, (".nii", ".nii.gz")) if all({"path": p, "label": nifti.label_of(p)}[k] in v for k, v in self.only)]
        return [Paths(run) for run in packed(chosen, self.most)] or [Paths([])]

    def read(self, partition: Paths) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        arrow, rows = to_arrow_schema(self.schema), []
        image = "image" in self.wanted
        for path in partition.paths:
            try:
                rows += self._slices(store, path, image)
            except Exception as error:  # the file's fault: it becomes a row
                rows.append({"path": path, "label": nifti.label_of(path), "ok": False, "error": str(error)})
            if len(rows) >= SLICES_AT_ONCE:
                yield self._batch(rows, arrow)
                rows = []
        if rows:
            yield self._batch(rows, arrow)

    def _slices(self, store, path: str, image: bool) -> list[dict]:
        with store.open_input_file(path) as file:
            packed_ = path.endswith(".gz")
            data = gzip.decompress(file.read()) if packed_ else None
            head = nifti.Header(data[: nifti.HEADER] if packed_ else file.read_at(nifti.HEADER, 0))
            if (len(data) if packed_ else file.size()) < head.end:
                raise ValueError("the file ends before its voxels do")
            rows = []
            for nth, k in enumerate(nifti.slices_of(head.shape)):
                row = {"path": path, "label": nifti.label_of(path), "ok": True, "axis": head.axis, "nth": nth, "slice": k}
                if image:
                    if not packed_ and head.axis == len(head.shape) - 1:
                        level = nifti.normalise(head.flat_slice(file.read_at(head.slice_bytes, head.slice_at(k)), 0))
                    else:
                        data = file.read_at(head.end, 0) if data is None else data
                        level = nifti.normalise(head.scaled(np.take(head.volume(data), k, head.axis)))
                    level = level if self.size is None else nifti.resize_levels(level, self.size)
                    row |= {"h": level.shape[0], "w": level.shape[1], "image": (level / 255).astype(np.float32).ravel()}
                else:
                    h, w = [n for a, n in enumerate(head.shape) if a != head.axis] if self.size is None else self.size
                    row |= {"h": h, "w": w}
                rows.append(row)
            return rows

    def _batch(self, rows: list[dict], arrow: pa.Schema) -> pa.RecordBatch:
        columns = []
        for field in arrow:
            if field.name == "image":
                images = [r.get("image") for r in rows]
                ends = np.cumsum([0, *(0 if i is None else len(i) for i in images)], dtype=np.int32)
                flat = np.concatenate([i for i in images if i is not None]) if any(i is not None for i in images) else np.empty(0, np.float32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([i is None for i in images])).cast(field.type))
            else:
                columns.append(pa.array([r.get(field.name) for r in rows], field.type))
        return pa.RecordBatch.from_arrays(columns, schema=arrow)


class SampleWriter(DataSourceArrowWriter):
    """A file for each row (folder, file_name, content), below its folder. A file stands there whole or not at all, and its
    name follows from its row, so repeated and doubled tasks write the same; `_SUCCESS` says that all are there."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]
        if overwrite:
            store, root = opened(self.path)
            store.create_dir(root, recursive=True)
            store.delete_dir_contents(root)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = opened(self.path)
        there: set[str] = set()
        for batch in iterator:
            for folder, name, content in zip(*(batch.column(c) for c in ("folder", "file_name", "content"))):
                put(store, f"{root}/{folder.as_py()}/{name.as_py()}", content.as_py(), there)
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        store, root = opened(self.path)
        put(store, f"{root}/_SUCCESS", b"")


class Volumes(DataSource):
    """`spark.read.format("volumes").load(folder)` and `df.write.format("volumes").save(folder)`; options are of VolumeReader."""

    @classmethod
    def name(cls) -> str:
        return "volumes"

    def schema(self) -> str:
        return nifti.SCHEMA

    def reader(self, schema: StructType) -> VolumeReader:
        return VolumeReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> SampleWriter:
        return SampleWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets filters reach it, without which Spark refuses a reader that takes them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(Volumes)
