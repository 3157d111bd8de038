"""Volumes in NIfTI-1 files: found by suffix, decoded where they lie, three slices each."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.prep import lanczos_weights

#: NIfTI-1 datatype codes (fixed by the format).
DTYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}

SCHEMA = "path string, label string, ok boolean, error string, axis int, nth int, slice int, h int, w int, image array<float>"
#: Height and width that slices are resized to.
SIZE = (224, 224)
#: Bytes before the voxels that say how they stand.
HEADER = 352
#: The columns of SCHEMA for Arrow.
_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "array<float>": pa.list_(pa.float32())}


def find_volumes(spark: SparkSession, folder: str) -> DataFrame:
    """All .nii and .nii.gz files below a folder with their contents, and the name of the directory that holds each as its label.

    This way reads any store that Spark does. Contents aren't sorted: order paths where an order is wanted. Files on paths
    that Arrow opens are read by the data source `volumes`, in pieces.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.nii*").load(folder)
    return files.filter(F.col("path").rlike(r"\.nii(\.gz)?$")).withColumn("label", F.element_at(F.split("path", "/"), -2))


def first_paths(files: DataFrame, n: int) -> DataFrame:
    """The first n files of each label, by path. n is small, so each task keeps its own first n before they meet."""
    first = Window.partitionBy("label").orderBy("path")
    return files.withColumn("_nth", F.row_number().over(first)).filter(F.col("_nth") <= n).drop("_nth")


def encode(volume: np.ndarray) -> bytes:
    """A volume of 32-bit floats as a NIfTI-1 file."""
    header = bytearray(352)
    struct.pack_into("<i", header, 0, 348)
    struct.pack_into("<8h", header, 40, volume.ndim, *volume.shape, *[1] * (7 - volume.ndim))
    struct.pack_into("<2h", header, 70, 16, 32)
    struct.pack_into("<3f", header, 108, 352.0, 1.0, 0.0)
    header[344:348] = b"n+1\0"
    return bytes(header) + np.asarray(volume, "<f4").tobytes(order="F")


def label_of(path: str) -> str:
    """The name of the directory that holds a file."""
    return path.rpartition("/")[0].rpartition("/")[2]


class Header:
    """Where a volume's voxels and slices stand, by the first HEADER bytes of its file; of a series, the first volume's."""

    def __init__(self, data: bytes):
        order = "<" if len(data) >= 4 and struct.unpack("<i", data[:4])[0] == 348 else ">"
        if len(data) < HEADER or struct.unpack(order + "i", data[:4])[0] != 348:
            raise ValueError("not a NIfTI-1 file")
        dims = struct.unpack(order + "8h", data[40:56])
        self.dtype = np.dtype(order + DTYPES[struct.unpack(order + "h", data[70:72])[0]])
        offset, slope, self.inter = struct.unpack(order + "3f", data[108:120])
        self.offset, self.slope = int(offset), slope or 1.0
        self.shape = dims[1 : 1 + min(dims[0], 3)]
        if not self.shape or min(self.shape) < 1:
            raise ValueError("a volume without voxels")
        self.axis = int(np.argmax(self.shape))
        self.slice_bytes = int(np.prod(self.shape[:-1], dtype=np.int64)) * self.dtype.itemsize
        self.end = self.offset + self.slice_bytes * self.shape[-1]

    def slice_at(self, k: int) -> int:
        """Where the k-th slice along the last axis begins."""
        return self.offset + k * self.slice_bytes

    def flat_slice(self, data: bytes, at: int) -> np.ndarray:
        """A slice along the last axis out of data, in which it begins at `at`."""
        flat = np.frombuffer(data, self.dtype, self.slice_bytes // self.dtype.itemsize, at)
        return self.scaled(flat.reshape(self.shape[:-1], order="F"))

    def scaled(self, voxels: np.ndarray) -> np.ndarray:
        return voxels.astype(float) * self.slope + self.inter

    def volume(self, data: bytes) -> np.ndarray:
        """All voxels, as they stand: scaled only when a slice is taken."""
        return np.frombuffer(data, self.dtype, self.slice_bytes // self.dtype.itemsize * self.shape[-1], self.offset).reshape(self.shape, order="F")


def decode(data: bytes) -> np.ndarray:
    """The volume, scaled as its header says; of a series, the first volume."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    head = Header(data[:HEADER])
    return head.scaled(head.volume(data))


def slices_of(shape: tuple[int, ...]) -> list[int]:
    """Along the longest axis: a sixth before the middle, the middle, and a sixth behind."""
    n = max(shape)
    return [min(max(k, 0), n - 1) for k in (n // 2 - n // 6, n // 2, n // 2 + n // 6)]


def normalise(image: np.ndarray) -> np.ndarray:
    """z-score clipped at three deviations, then scaled to whole levels of 0 to 255; a flat image is 0."""
    spread = image.std()
    if not spread > 0:
        return np.zeros(image.shape)
    z = np.clip((image - image.mean()) / spread, -3, 3)
    return np.floor((z - z.min()) / (z.max() - z.min() + 1e-8) * 255)


@lru_cache(maxsize=256)
def _weights(source: int, target: int) -> np.ndarray:
    return np.array(lanczos_weights(source, target))


def resize_levels(image: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Levels of 0 to 255 by the Lanczos kernel: first across, then down, each rounded to whole levels."""
    level = lambda x: np.clip(np.floor(x + 0.5), 0, 255)
    across = level(image @ _weights(image.shape[1], size[1]).T)
    return level(_weights(image.shape[0], size[0]) @ across)


def read_slices(files: DataFrame, size: tuple[int, int] | None = SIZE) -> DataFrame:
    """A row for each of three slices of each volume of files (path, label, content): a sixth before the middle of the
    longest axis, the middle, and a sixth behind, normalised to [0, 1] and resized.

    A file that can't be decoded gives one row with ok false and the reason. Without a size, slices stay as large as they are.
    """

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    arrow = pa.schema([(x.split()[0], _ARROW[x.split()[1]]) for x in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):  # a volume at a time: its slices are one small batch
                path, label, content = (batch.column(c)[at].as_py() for c in ("path", "label", "content"))
                try:
                    made = [(path, label, True, None, axis, nth, k, *image.shape, image.ravel()) for nth, (axis, k, image) in enumerate(_read(content, size))]
                except Exception as error:  # the file's fault: it becomes a row
                    made = [(path, label, False, str(error), None, None, None, None, None, None)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], arrow.field(n).type) for i, n in enumerate(names)], schema=arrow)

    return files.select("path", "label", "content").mapInArrow(run, SCHEMA)


def _read(content: bytes, size: tuple[int, int] | None) -> list[tuple[int, int, np.ndarray]]:
    """(axis, slice, image in [0, 1]) of a file's three slices. Only they are made floats."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    head = Header(data[:HEADER])
    volume, out = head.volume(data), []
    for k in slices_of(head.shape):
        level = normalise(head.scaled(np.take(volume, k, head.axis)))
        out.append((head.axis, k, ((level if size is None else resize_levels(level, size)) / 255).astype(np.float32)))
    return out


def ingest_stats(slices: DataFrame) -> DataFrame:
    """For each label: files, those that could be read, those that couldn't, and slices."""
    by_file = F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("ok") & (F.col("nth") == 0)).alias("processed"), F.count_if("ok").alias("output_slices")
    return slices.groupBy("label").agg(*by_file).select("label", (F.col("processed") + F.col("failed")).alias("total"), "processed", "failed", "output_slices")
