"""The data sources of volumes and of arrays: what is written is read, in pieces, and what isn't whole is told."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fedspark.sources import arrays, nifti, volumes


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    volumes.register(spark)
    arrays.register(spark)


def stored(tmp_path):
    rng = np.random.default_rng(3)
    kept = {}
    for label, name, shape in (("CN", "a.nii", (9, 6, 30, 2)), ("CN", "b.nii.gz", (12, 6, 5)), ("AD", "c.nii", (4, 9, 3)), ("AD", "bad.nii", None), ("AD", "cut.nii", (5, 5, 8)), ("AD", "note.txt", None), ("AD", ".hidden.nii", None)):
        path = tmp_path / label / name
        path.parent.mkdir(exist_ok=True)
        data = b"short" if shape is None else nifti.encode(kept.setdefault(str(path), rng.standard_normal(shape).astype(np.float32)))
        data = data[:-40] if name == "cut.nii" else data
        path.write_bytes(gzip.compress(data) if name.endswith("gz") else data)
    return kept


def test_volumes_are_read_by_slices(spark, tmp_path):
    kept = stored(tmp_path)
    read = lambda: spark.read.format("volumes").option("bytesPerTask", 2000)
    found = read().option("resize", "false").load(str(tmp_path))
    assert found.rdd.getNumPartitions() > 1
    rows = found.collect()
    good = [r for r in rows if r.ok]
    assert len(good) == 9 and sorted(r.path.rpartition("/")[2] for r in rows if not r.ok) == ["bad.nii", "cut.nii"]
    for r in good:
        volume = kept[r.path][..., 0] if kept[r.path].ndim == 4 else kept[r.path]
        want = nifti.normalise(np.take(volume.astype(float), r.slice, r.axis))
        assert (r.h, r.w) == want.shape and np.allclose(np.array(r.image) * 255, want.ravel(), atol=1e-3)
    large = read().load(str(tmp_path)).filter("ok").collect()
    assert all(len(r.image) == 224 * 224 for r in large)
    binary = {(r.path.removeprefix("file:"), r.nth): r.image for r in nifti.read_slices(nifti.find_volumes(spark, str(tmp_path))).filter("ok").collect()}
    assert all(np.allclose(binary[r.path, r.nth], r.image) for r in large)


def test_columns_and_labels_are_pruned(spark, tmp_path):
    stored(tmp_path)
    few = spark.read.format("volumes").schema("label string, ok boolean, nth int").load(str(tmp_path))
    assert {r.label: tuple(r)[1:] for r in nifti.ingest_stats(few).collect()} == {"CN": (2, 2, 0, 6), "AD": (3, 1, 2, 3)}
    one = spark.read.format("volumes").load(str(tmp_path)).filter("label = 'CN'")
    assert one.count() == 6
    reader = volumes.VolumeReader({"path": str(tmp_path)}, one.schema)
    from pyspark.sql.datasource import EqualTo, IsNotNull

    assert [type(f) for f in reader.pushFilters([EqualTo(("label",), "CN"), IsNotNull(("label",))])] == [IsNotNull]
    assert sum(len(p.paths) for p in reader.partitions()) == 2
    (tmp_path / "none").mkdir()
    assert spark.read.format("volumes").load(str(tmp_path / "none")).count() == 0


def test_samples_are_written_whole(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("client_"), F.col("id") % 3).alias("folder"), F.concat(F.lit("CN_"), F.lpad("id", 4, "0"), F.lit(".nii")).alias("file_name"), F.lit(nifti.encode(np.ones((3, 2, 2)))).alias("content"))
    for _ in range(2):  # again: the same files
        rows.repartition(5).write.format("volumes").mode("append").save(str(tmp_path))
    names = sorted(p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*.nii"))
    assert names == sorted(f"client_{i % 3}/CN_{i:04d}.nii" for i in range(40)) and (tmp_path / "_SUCCESS").exists()
    assert not [p for p in tmp_path.rglob(".*")]
    assert spark.read.format("volumes").load(str(tmp_path)).filter("ok").count() == 120


@pytest.mark.parametrize("dtype", ["float32", "int64", ">f8"])
def test_arrays_round_trip(spark, tmp_path, dtype):
    x = np.arange(7 * 6).reshape(7, 2, 3).astype(dtype)
    np.save(tmp_path / "x.npy", x)
    got = spark.read.format("arrays").option("bytesPerTask", 60).load(str(tmp_path / "x.npy"))
    assert got.rdd.getNumPartitions() > 1
    assert [(r.row, list(r["values"])) for r in got.orderBy("row").collect()] == [(i, x[i].ravel().tolist()) for i in range(7)]
    got.repartitionByRange(3, "row").sortWithinPartitions("row").select("values").write.format("arrays").option("shape", "2,3").option("dtype", np.dtype(dtype).newbyteorder("=").name).mode("append").save(str(tmp_path / "out"))
    parts = json.loads((tmp_path / "out" / arrays.PARTS).read_text())
    assert np.array_equal(np.concatenate([np.load(tmp_path / "out" / p) for p in parts]), x)
    (tmp_path / "out" / "part-99999-left.npy").write_bytes(b"what a lost task left")
    assert [(r.row, list(r["values"])) for r in spark.read.format("arrays").load(str(tmp_path / "out")).orderBy("row").collect()] == [(i, x[i].ravel().tolist()) for i in range(7)]
    assert spark.read.format("arrays").schema("row long").load(str(tmp_path / "out")).count() == 7


def test_broken_arrays_are_refused(spark, tmp_path):
    np.save(tmp_path / "ok.npy", np.ones((5, 4)))
    (tmp_path / "cut.npy").write_bytes((tmp_path / "ok.npy").read_bytes()[:-8])
    with pytest.raises(Exception, match="ends before"):
        spark.read.format("arrays").load(str(tmp_path / "cut.npy")).count()
    with pytest.raises(ValueError):
        arrays.header(b"no")
    with pytest.raises(Exception, match="4 values"):
        spark.createDataFrame([([1.0, 2.0],)], "values array<double>").write.format("arrays").option("shape", "4").mode("append").save(str(tmp_path / "bad"))
    np.save(tmp_path / "labels.npy", np.arange(4))
    assert [list(r["values"]) for r in spark.read.format("arrays").load(str(tmp_path / "labels.npy")).orderBy("row").collect()] == [[0], [1], [2], [3]]
