"""Core operators beyond what their queries' SQL says, against plain numpy."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from fedspark.functions.ranking import hash_rank, running, sketched
from fedspark.operators import experiment, explain, metrics, model, prep, privacy, report, split
from fedspark.sources import files, nifti


def made(spark, n=240, classes=3, width=4, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = rng.standard_normal((n, width)) + 2 * np.eye(classes, width)[y]
    rows = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(n)], "id long, features array<double>, label int")
    return rows, x, y


def probs(x, w):
    z = x @ w.T
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def test_lanczos_keeps_constants_and_equal_sizes():
    for source, target in ((8, 224), (300, 224), (7, 7)):
        w = np.array(prep.lanczos_weights(source, target))
        assert np.allclose(w.sum(1), 1)
    assert np.allclose(w, np.eye(7))
    image = np.arange(48.0).reshape(6, 8)
    assert (nifti.resize_levels(image, (6, 8)) == image).all() and nifti.resize_levels(image, (224, 224)).shape == (224, 224)


def test_resize_of_odd_images(spark):
    rows = spark.createDataFrame([(1, [0.0, 2.0, 4.0, 6.0]), (2, None), (3, [1.0])], "id int, image array<double>")
    got = {r.id: r.image for r in prep.resize(rows, "image", (2, 2), (4, 4)).collect()}
    assert got[2] is None and got[3] is None and len(got[1]) == 16 and got[1][0] == 0 and got[1][-1] == 6
    assert prep.resize(rows.limit(0), "image", (2, 2), (4, 4)).count() == 0


def test_summaries_of_resized_images(spark):
    """A summary sees what resize gives, and null and odd images have null summaries."""
    rows = spark.createDataFrame([(1, [0.0, 1.0, 2.0, 3.0]), (2, None), (3, [1.0]), (4, [4.0, 4.0, 4.0, 0.0])], "id int, image array<double>")
    images = {r.id: r.image for r in prep.resize(rows, "image", (2, 2), (4, 4)).collect()}
    got = prep.resize(rows, "image", (2, 2), (4, 4), "bilinear", lambda x: [x.sum(1), x[:, 5]], "total double, one double")
    assert got.columns == ["id", "total", "one"]
    assert {r.id: (r.total, r.one) for r in got.collect()} == {i: (None, None) if x is None else (sum(x), x[5]) for i, x in images.items()}
    assert prep.resize(rows.limit(0), "image", (2, 2), (4, 4), "bilinear", lambda x: [x.sum(1)], "total double").count() == 0


@pytest.mark.parametrize("name", ["lanczos_resize_224", "ingest_images"])
def test_large_images_are_summed_in_arrays(spark, name):
    """No expression goes over 50,176 pixels one by one."""
    from fedspark.plans import queries

    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(" not in plan


def test_volumes_are_found_read_and_counted(spark, tmp_path):
    rng = np.random.default_rng(3)
    for label, names in {"CN": ("a.nii", "b.nii.gz"), "AD": ("deep/c.nii", "bad.nii", "note.txt")}.items():
        for name in names:
            path = tmp_path / label / name if "/" not in name else tmp_path / "deep" / label / name.split("/")[1]
            path.parent.mkdir(parents=True, exist_ok=True)
            volume = rng.standard_normal((9, 6, 30, 2) if name == "a.nii" else (12, 6, 5))
            data = b"short" if name == "bad.nii" else nifti.encode(volume)
            path.write_bytes(gzip.compress(data) if name.endswith("gz") else data)
    found = nifti.find_volumes(spark, str(tmp_path))
    assert found.count() == 4
    rows = nifti.read_slices(found).collect()
    good = [r for r in rows if r.ok]
    assert len(good) == 9 and all((r.h, r.w, len(r.image)) == (224, 224, 224 * 224) and 0 <= min(r.image) and max(r.image) <= 1 for r in good)
    assert sorted((r.axis, r.slice) for r in good if r.path.endswith("a.nii")) == [(2, 10), (2, 15), (2, 20)]
    stats = {r.label: tuple(r)[1:] for r in nifti.ingest_stats(nifti.read_slices(found)).collect()}
    assert stats == {"CN": (2, 2, 0, 6), "AD": (2, 1, 1, 3)}


def test_one_clients_folder_is_read(spark, tmp_path):
    rows = spark.range(40).select("id", (F.col("id") % 4).cast("int").alias("client"), F.lit(1).alias("label"))
    files.write_clients(rows, str(tmp_path))
    one = files.read_client(spark, str(tmp_path), 2)
    assert sorted(r.id for r in one.collect()) == list(range(2, 40, 4))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(client" in plan and len(one.inputFiles()) <= len(files.read_client(spark, str(tmp_path), 2).inputFiles())


def test_ranks_keep_null_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, None), (None, "a"), (None, None)], "id long, k string")
    got = hash_rank(rows, 1, keys=("k",)).collect()
    assert len(got) == 5 and sorted(r.rn for r in got if r.k is None) == [1, 2, 3]


def test_labels_without_shares_go_to_the_first_client(spark):
    rows = spark.createDataFrame([(i, i % 5 if i % 7 else None) for i in range(100)], "id long, label int")
    got = split.dirichlet_partition(rows, 3, 4).collect()
    assert len(got) == 100 and all(r.client == 0 for r in got if r.label is None or r.label > 2)


def test_private_steps_equal_plain_ones(spark):
    rows, x, y = made(spark)
    got, ledger = privacy.private_train(rows, 3, 4, 3, 0.7, 0.5, seed=9)
    rng, w = np.random.default_rng(9), np.zeros((3, 4))
    for _ in range(3):
        e = probs(x, w) - np.eye(3)[y]
        each = np.einsum("nc,nj->ncj", e, x)
        norm = np.sqrt((each**2).sum((1, 2)))
        g = (each * np.minimum(1, 0.5 / norm)[:, None, None]).sum(0)
        w = w - 0.5 * (g + rng.standard_normal(g.shape) * 0.7 * 0.5) / len(y)
    assert np.allclose(got, w) and len(ledger) == 3
    assert len(privacy.private_train(rows, 3, 4, 50, 4.0, 0.5, target=1.0, seed=1)[1]) < 50


def test_macro_auroc_falls_back_to_zero(spark):
    points = lambda labels: metrics.one_vs_rest(spark.createDataFrame([(c, [0.2 + 0.1 * c, 0.5, 0.3 - 0.1 * c]) for c in labels], "label int, probs array<double>"))
    assert metrics.auroc_macro(points([0, 1, 2])).first()[0] > 0
    assert metrics.auroc_macro(points([0, 1, 1])).first()[0] == 0.0


def test_all_experiments_are_configured():
    names = [c[0] for c in report.ABLATIONS]
    assert len(names) == len(set(names)) == 14 and sum(n.startswith("A4") for n in names) == 2
    assert {c[1] for c in report.ABLATIONS} == {"federated", "private", "central"}
    assert [experiment.configured(*c).epochs for c in report.ABLATIONS if c[0].startswith("A7")] == [1, 3, 5]


def test_crowded_scores_fill_no_bucket(spark):
    rows = spark.range(20_000).select((0.33 + F.col("id") / 2_000_000).alias("score"))
    bucket = sketched(rows, "score", per_bucket=1000)
    sizes = [r["count"] for r in rows.groupBy(bucket.alias("b")).count().collect()]
    assert len(sizes) == 20 and max(sizes) <= 1500
    ranked = running(rows, bucket, ["score"], {"rn": F.lit(1)}).orderBy("score").select("rn").collect()
    assert [r.rn for r in ranked] == list(range(1, 20_001))
    same = spark.range(5000).select(F.lit(0.5).alias("score"))
    assert same.groupBy(sketched(same, "score", per_bucket=1000)).count().count() == 1
    points = rows.select(F.lit(0).alias("c"), "score", (F.col("score") * 1e6 % 2 < 1).cast("int").alias("pos")).withColumn("neg", 1 - F.col("pos"))
    pos = np.array([r.pos for r in points.orderBy("score").select("pos").collect()])
    above = np.cumsum(1 - pos)[pos == 1].sum() / (pos.sum() * (1 - pos).sum())
    assert metrics.auroc(points).first().auroc == pytest.approx(above)


def test_overlay_in_red(spark):
    (row,) = spark.sql("select array(0.2D, 0.9D) as i, array(0.4D, 1.0D) as h").select(explain.red_overlay(F.col("i"), F.col("h")).alias("x")).collect()
    assert row.x == pytest.approx([0.4, 1.0])


def test_frozen_features_stay(spark):
    rows, x, y = made(spark)
    w, history = model.train_two_phase(rows, 3, 4, 3, 3, [0, 1])
    assert not w[:, :2].any() and w[:, 2:].any() and [h["phase"] for h in history] == ["frozen"] * 3
    assert history[-1]["loss"] < history[0]["loss"]
