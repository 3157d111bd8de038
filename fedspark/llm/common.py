"""Helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import warnings
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one step inside a task handles at once; a single longer text is handled alone.
SLICE_BYTES = 8 << 20

#: Tables that stand in the shared folder.
_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; where none is set, a temporary one if the session is local, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='fedspark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: written as Parquet to the shared folder and read again, so that its lineage ends here.

    The table goes with forget(), or when the driver's process ends.
    """
    path = temporary_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def temporary_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what stands there goes when the driver's process ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_all)
    _written[path] = spark
    return path


def forget(df: DataFrame) -> None:
    """Deletes the table of written() that df reads; nothing may read it afterwards."""
    for path in {file.rpartition("/")[0] for file in df.inputFiles()}:
        for known in [p for p in _written if p.partition(":")[2].lstrip("/") == path.partition(":")[2].lstrip("/")]:
            _remove(known)


def _remove(path: str) -> None:
    spark = _written.pop(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _remove_all() -> None:
    for path in list(_written):
        try:
            _remove(path)
        except Exception as error:  # the session may have ended before
            warnings.warn(f"{path} and what follows stay in the shared folder: {error}", stacklevel=1)
            return


def spread(spark: SparkSession, units: float, per_partition: float) -> int:
    """Partitions for so many units of work, at least as many as the session's shuffles have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(units // per_partition) + 1)


@contextmanager
def rows_at_once(spark: SparkSession, n: int) -> Iterator[None]:
    """While it lasts, Python tasks take n rows at a time, for tables whose rows are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, n)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most so many bytes of text; a null text becomes an empty one."""
    at = batch.schema.get_field_index(column)
    texts = pc.fill_null(batch.column(at).cast(pa.string()), "")
    batch = batch.set_column(at, column, texts)
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(texts):
        gone = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, gone + most, side="right")))
        part = batch.slice(first, last - first)
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.columns], schema=part.schema)
        first = last


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words, runs of other than space and \\t to \\r, and the number of words of each text."""
    parts = pc.ascii_split_whitespace(texts)
    words, starts = parts.flatten(), parts.offsets.to_numpy()
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    before = np.concatenate(([0], np.cumsum(full)))
    return words.filter(pa.array(full)), np.diff(before[starts - starts[0]])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all elements of the runs that begin at starts."""
    total = int(lengths.sum())
    skip = np.cumsum(lengths) - lengths
    return np.repeat(starts - skip, lengths) + np.arange(total)


class Memo:
    """Ids of strings, kept between batches: encode(strings) gives the ids of all, one after another, and each one's count.

    It is emptied before it would hold more than `most` strings, so its memory is bounded.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 400_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat = np.empty(0, np.int32)
        self.starts = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int64)

    def __call__(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) in self.flat of each string."""
        rows = np.fromiter(map(self.at.get, strings, repeat(-1)), np.int64, len(strings))
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            unknown = strings if len(missing) == len(strings) else [strings[k] for k in missing.tolist()]
            new = list(dict.fromkeys(unknown))
            if len(self.at) + len(new) > self.most:
                self.clear()
                missing, unknown, new = slice(None), strings, list(dict.fromkeys(strings))
            at, known = self.at, len(self.at)
            flat, lengths = self.encode(new)
            begin = len(self.flat)
            at.update(zip(new, range(known, known + len(new))))
            self.starts = np.concatenate((self.starts, begin + np.cumsum(lengths) - lengths))
            self.lengths = np.concatenate((self.lengths, lengths))
            self.flat = np.concatenate((self.flat, flat.astype(np.int32)))
            # without repeats, their numbers follow one another
            rows[missing] = np.arange(known, known + len(new)) if len(new) == len(unknown) else np.fromiter(map(at.__getitem__, unknown), np.int64, len(unknown))
        return self.starts.take(rows), self.lengths.take(rows)


def with_columns(docs: DataFrame, needed: dict[str, str]) -> DataFrame:
    """Only the named columns of docs, cast to the given types, so that others can't clash with an operator's own."""
    return docs.select(*(docs[name].cast(kind).alias(name) for name, kind in needed.items()))
