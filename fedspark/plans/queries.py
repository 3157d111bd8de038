"""One query for each operator, with SQL for DuckDB where it can say the same."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import mean, total
from ..operators import conv, experiment, explain, federated, metrics, model, prep, privacy, report, split, training
from ..sources import arrays, files, nifti
from ..sources import volumes as volume_source
from ..sources.tables import samples, spread, table
from . import sql
from .sql import CLASSES, CLIENTS, HISTORY, MODEL_CLASSES, PX, PX3, SCORED, WIDTH

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(text: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if text is not None:
            ORACLE_SQL[f.__name__] = text
        return f

    return add


def three(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d, MODEL_CLASSES)


def centroids(spark: SparkSession, d: str) -> DataFrame:
    return model.centroid_params(three(spark, d))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return model.score(three(spark, d), centroids(spark, d))


def dealt(spark: SparkSession, d: str, alpha: float = 0.5, clients: int = CLIENTS) -> DataFrame:
    return split.dirichlet_partition(samples(spark, d), CLASSES, clients, alpha)


def long(rows: DataFrame, column: str, *keep: str, name: str = "v", digits: int = 6) -> DataFrame:
    return rows.select(*keep, F.posexplode(column).alias("j", name)).withColumn(name, F.round(name, digits))


def history(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return events.groupBy((F.col("user_id") % 50).cast("int").alias("step")).agg(F.round(F.avg("value") / 100, 6).alias("f1"), F.count(F.lit(1)).alias("n"))


# scans, projections, filters


@query("select vec_id as id, vec_id // 3 as subject, label, len(embedding) as width from embeddings")
def scan_samples(spark, d):
    return samples(spark, d).select("id", "subject", "label", F.size("features").cast("long").alias("width"))


@query(f"with {sql.dealt()} select id, label from dealt where client = 1")
def client_scan(spark, d):
    """All clients are written to folders of their own, and one is read again."""
    folder = files.scratch_folder(spark)
    files.write_clients(dealt(spark, d).select("id", "client", "label"), folder)
    return files.read_client(spark, folder, 1).select("id", "label")


NAMES = {0: "CN", 1: "MCI", 2: "AD"}


@query(f"""with {sql.dealt()}
select id, client, coalesce(case label when 0 then 'CN' when 1 then 'MCI' when 2 then 'AD' end, cast(label as varchar)) || '_' ||
  lpad(cast(row_number() over (partition by client, label order by id) - 1 as varchar), 4, '0') as file_name from dealt""")
def client_file_names(spark, d):
    return files.client_file_names(dealt(spark, d), NAMES).select("id", "client", "file_name")


@query("select vec_id as id from embeddings where label = 1")
def filter_class(spark, d):
    return samples(spark, d).filter(F.col("label") == 1).select("id")


@query("select vec_id as id, label from embeddings where vec_id in (select doc_id from labels where quality = 1)")
def gather_semi_join(spark, d):
    wanted = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    return samples(spark, d).join(wanted, "id", "left_semi").select("id", "label")


@query("""with s as (select l_orderkey, l_linenumber, [l_partkey % 97, l_suppkey % 97, cast(l_quantity as bigint)] as shape from lineitem)
select l_orderkey, l_linenumber, case when shape[1] >= shape[2] and shape[1] >= shape[3] then 0 when shape[2] >= shape[3] then 1 else 2 end as axis from s""")
def axis_argmax(spark, d):
    shape = F.array(F.col("l_partkey") % 97, F.col("l_suppkey") % 97, F.col("l_quantity").cast("long"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", prep.longest_axis(shape).alias("axis"))


@query("""with s as (select distinct cast(p_size as bigint) as n from part)
select n, cast(greatest(0, least(n // 2, n - 1)) as int) as mid, cast(greatest(0, least(n // 2 - n // 6, n - 1)) as int) as before, cast(greatest(0, least(n // 2 + n // 6, n - 1)) as int) as after from s""")
def slice_select(spark, d):
    rows = table(spark, d, "part").select(F.col("p_size").cast("long").alias("n")).distinct().withColumn("k", prep.slice_indices(F.col("n")))
    return rows.select("n", F.col("k")[0].alias("mid"), F.col("k")[1].alias("before"), F.col("k")[2].alias("after"))


@query(f"""with {PX}, s as (select *, avg(v) over (partition by id) as m, stddev_pop(v) over (partition by id) as sd from px)
select id, cast(j as int) as j, round(case when sd > 0 then greatest(least((v - m) / sd, 3), -3) else 0 end, 6) as v from s""")
def zscore_clip(spark, d):
    return long(samples(spark, d).withColumn("z", prep.zscore_clip(F.col("features"))), "z", "id")


@query(f"""with {PX}, s as (select *, min(v) over (partition by id) as lo, max(v) over (partition by id) as hi from px)
select id, cast(j as int) as j, round((v - lo) / (hi - lo + 1e-8::double), 6) as v from s""")
def minmax_scale(spark, d):
    return long(samples(spark, d).withColumn("z", prep.minmax(F.col("features"))), "z", "id")


@query(f"""with {PX}, s as (select *, min(v) over (partition by id) as lo, max(v) over (partition by id) as hi from px)
select id, cast(j as int) as j, round(floor(round((v - lo) / (hi - lo + 1e-8::double), 6) * 255) / 255.0::double, 6) as v from s""")
def quantize_u8(spark, d):
    scaled = F.transform(prep.minmax(F.col("features")), lambda v: F.round(v, 6))
    return long(samples(spark, d).withColumn("z", prep.quantize(scaled)), "z", "id")


def _weights_sql(source: int, target: int) -> str:
    return ", ".join(f"({t}, {s}, {w!r}::double)" for t, row in enumerate(prep.bilinear_weights(source, target)) for s, w in enumerate(row) if w)


@query(f"""with {PX}, wt as (select * from (values {_weights_sql(8, 12)}) t(o, i, w))
select id, cast(a.o * 12 + b.o as int) as j, round(sum(a.w * b.w * v), 6) as v from px join wt a on a.i = j // 8 join wt b on b.i = j % 8 group by all""")
def bilinear_resize(spark, d):
    return long(prep.resize(samples(spark, d).select("id", "features"), "features", (8, 8), (12, 12)), "features", "id")


def _kernel_sql(name: str, source: int, target: int, method) -> str:
    rows = ", ".join(f"({t}, {i}, {w!r}::double)" for t, row in enumerate(method(source, target)) for i, w in enumerate(row) if w)
    return f"{name} as (select * from (values {rows}) t(o, i, w))"


@query(f"""with {PX}, {_kernel_sql("wt", 8, 12, prep.lanczos_weights)}
select id, cast(a.o * 12 + b.o as int) as j, round(sum(a.w * b.w * v), 6) as v from px join wt a on a.i = j // 8 join wt b on b.i = j % 8 group by all""")
def lanczos_resize(spark, d):
    return long(prep.resize(samples(spark, d).select("id", "features"), "features", (8, 8), (12, 12), "lanczos"), "features", "id")


@query(f"""with {PX}, {_kernel_sql("wt", 8, 224, prep.lanczos_weights)}, m as (select i, sum(w) as w, sum(w * o) as wo from wt group by i), spot as (select a.i as y, b.i as x, a.w * b.w as w from wt a join wt b on a.o = 100 and b.o = 57),
s as (select id, sum(a.w * b.w * v) / 50176 as mean, sum((224 * a.wo * b.w + a.w * b.wo + a.w * b.w) * v) as digest from px join m a on a.i = j // 8 join m b on b.i = j % 8 group by id),
t as (select id, sum(w * v) as pixel from px join spot on y = j // 8 and x = j % 8 group by id)
select id, 50176 as pixels, round(mean, 6) as mean, round(pixel, 6) as pixel, round(digest, 3) as digest from s join t using (id)""")
def lanczos_resize_224(spark, d):
    """Each image's mean, one pixel, and the sum of all pixels by their numbers from 1 on."""
    number = np.arange(1.0, 224 * 224 + 1)

    def summary(images):
        return [np.full(len(images), images.shape[1], np.int32), images.mean(1), images[:, 100 * 224 + 57], np.array([(x * number).sum() for x in images])]

    rows = spread(samples(spark, d).select("id", "features"))
    large = prep.resize(rows, "features", (8, 8), (224, 224), "lanczos", summary, "pixels int, mean double, pixel double, digest double")
    return large.select("id", "pixels", F.round("mean", 6).alias("mean"), F.round("pixel", 6).alias("pixel"), F.round("digest", 3).alias("digest"))


def volumes(spark: SparkSession, d: str) -> DataFrame:
    """Each sample as the file of a volume of 8 x 4 x 2 voxels; every seventh file is cut short."""

    def files_of(batches):
        for batch in batches:
            batch["content"] = [nifti.encode(np.round(np.array(x), 6).reshape(8, 4, 2))[: 200 if i % 7 == 0 else None] for i, x in zip(batch["id"], batch.pop("features"))]
            yield batch[["path", "label", "content"]].assign(label=batch["label"].astype(str))

    rows = samples(spark, d).select("id", F.concat(F.lit("/"), F.col("id")).alias("path"), "label", "features")
    return spread(rows).mapInPandas(files_of, "path string, label string, content binary")


@query("""with px as (select vec_id as id, label, cast(cast(round(cast(unnest(embedding) as double), 6) as float) as double) as v, unnest(range(64)) as j from embeddings where vec_id % 7 <> 0),
sl as materialized (select id, nth, k, j % 8 as p, v from px join (values (0, 3), (1, 4), (2, 5)) t(nth, k) on j // 8 = k),
z as (select *, greatest(-3, least(3, (v - avg(v) over w) / stddev_pop(v) over w)) as z from sl window w as (partition by id, nth)),
r as (select *, (z - min(z) over w) / (max(z) over w - min(z) over w + 1e-8::double) * 255 as level from z window w as (partition by id, nth))
select '/' || id as path, nth::int as nth, k::int as slice, 4 as h, 2 as w, round(sum(floor(level) / 255.0::double), 4) as total from r group by all""")
def ingest_slices(spark, d):
    slices = nifti.read_slices(volumes(spark, d), None).filter("ok")
    return slices.select("path", "nth", "slice", "h", "w", F.round(total(F.transform("image", lambda v: v.cast("double"))), 4).alias("total"))


def volume_files(spark: SparkSession, d: str) -> str:
    """A folder with a file for each sample's volume, in a folder for each label, written by the data source of volumes."""
    folder = files.scratch_folder(spark)
    rows = volumes(spark, d).select(F.col("label").alias("folder"), F.concat(F.substring("path", 2, 100), F.lit(".nii")).alias("file_name"), "content")
    volume_source.register(spark)
    rows.write.format("volumes").mode("append").save(folder)
    return folder


@query("select label::varchar as label, count(*) as total, count(*) filter (vec_id % 7 <> 0) as processed, count(*) filter (vec_id % 7 = 0) as failed, 3 * count(*) filter (vec_id % 7 <> 0) as output_slices from embeddings group by label")
def ingest_files(spark, d):
    """Volumes on disk are counted by what their headers promise and their sizes hold."""
    folder = volume_files(spark, d)
    return nifti.ingest_stats(spark.read.format("volumes").schema("label string, ok boolean, nth int").load(folder))


@query(f"""with px as (select vec_id as id, label, cast(cast(round(cast(unnest(embedding) as double), 6) as float) as double) as v, unnest(range(64)) as j from embeddings where vec_id % 7 <> 0 and label in (1, 2)),
sl as materialized (select id, label, nth, k, (j % 8) // 2 as y, j % 2 as x, v from px join (values (0, 3), (1, 4), (2, 5)) t(nth, k) on j // 8 = k),
z as (select *, greatest(-3, least(3, (v - avg(v) over w) / stddev_pop(v) over w)) as z from sl window w as (partition by id, nth)),
r as materialized (select *, floor((z - min(z) over w) / (max(z) over w - min(z) over w + 1e-8::double) * 255) as level from z window w as (partition by id, nth)),
{_kernel_sql("kx", 2, 224, prep.lanczos_weights)}, {_kernel_sql("ky", 4, 224, prep.lanczos_weights)},
across as materialized (select id, label, nth, k, y, o as x, greatest(0, least(255, floor(round(sum(w * level), 9) + 0.5::double))) as level from r join kx on i = x group by all),
down as materialized (select id, label, nth, k, o as y, x, greatest(0, least(255, floor(round(sum(w * level), 9) + 0.5::double))) as level from across join ky on i = y group by all)
select label::varchar as label, id, nth::int as nth, k::int as slice, 224 as h, 224 as w, round(sum(level * (1 + (y * 224 + x) % 997))::double / 1e6::double, 3) as digest from down group by all""")
def ingest_images(spark, d):
    """Slices of the volumes of two classes, read from disk at full size; every pixel's level counts in a row's digest."""
    found = spark.read.format("volumes").load(volume_files(spark, d)).filter("label in ('1', '2')").filter("ok")
    weight = 1.0 + np.arange(224 * 224) % 997

    def digests(batches):
        for batch in batches:
            images = batch.column("image")
            pixels, starts = images.values.to_numpy(), images.offsets.to_numpy()
            found = [float(np.rint(pixels[a:b] * 255.0) @ weight[: b - a]) / 1e6 for a, b in zip(starts[:-1], starts[1:])]
            yield batch.drop_columns(["image"]).append_column("digest", pa.array(found, pa.float64()))

    name = F.regexp_extract("path", r"([0-9]+)\.nii$", 1).cast("long")
    rows = found.select("label", name.alias("id"), "nth", "slice", "h", "w", "image")
    return rows.mapInArrow(digests, "label string, id long, nth int, slice int, h int, w int, digest double").withColumn("digest", F.round("digest", 3))


@query(f"""with {sql.dealt()}, px as (select vec_id as id, cast(cast(round(cast(unnest(embedding) as double), 6) as float) as double) as v from embeddings), t as (select id, sum(v) as v from px group by id)
select 'client_' || client as folder, coalesce(case label when 0 then 'CN' when 1 then 'MCI' when 2 then 'AD' end, cast(label as varchar)) || '_' || lpad(cast(row_number() over (partition by client, label order by id) - 1 as varchar), 4, '0') || '.nii' as file_name,
round(v, 4) as total from dealt join t using (id)""")
def client_sample_files(spark, d):
    """A file for each sample in its client's folder, named by its counter; all are found and read again."""
    folder = files.scratch_folder(spark)
    volume_source.register(spark)

    def contents(batches):
        for batch in batches:
            batch["content"] = [nifti.encode(np.round(np.array(x), 6).reshape(8, 4, 2)) for x in batch.pop("features")]
            yield batch

    named = files.client_file_names(dealt(spark, d), NAMES).select(F.concat(F.lit("client_"), F.col("client")).alias("folder"), F.concat("file_name", F.lit(".nii")).alias("file_name"), "features")
    named.mapInPandas(contents, "folder string, file_name string, content binary").write.format("volumes").mode("append").save(folder)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.nii").load(folder)

    def sums(batches):
        for batch in batches:
            batch["total"] = [float(nifti.decode(x).sum()) for x in batch.pop("content")]
            yield batch

    rows = found.select("path", "content").mapInPandas(sums, "path string, total double")
    part = F.split("path", "/")
    return rows.select(F.element_at(part, -2).alias("folder"), F.element_at(part, -1).alias("file_name"), F.round("total", 4).alias("total"))


@query("""with px as (select vec_id as id, label, cast(cast(round(cast(unnest(embedding) as double), 6) as float) as double) as v, unnest(range(64)) as j from embeddings where vec_id % 7 <> 0),
sl as materialized (select id, label, nth, j % 8 as p, v from px join (values (0, 3), (1, 4), (2, 5)) t(nth, k) on j // 8 = k),
z as (select *, greatest(-3, least(3, (v - avg(v) over w) / stddev_pop(v) over w)) as z from sl window w as (partition by id, nth)),
r as (select *, floor((z - min(z) over w) / (max(z) over w - min(z) over w + 1e-8::double) * 255) as level from z window w as (partition by id, nth))
select row_number() over (order by label, id, nth) - 1 as row, label::bigint as label, round(sum(level / 255.0::double * (p + 1)), 4) as digest from r group by label, id, nth""")
def slice_files(spark, d):
    """Slices of all volumes are written as one array, and their labels as another in the same order; both are read again
    and met by row."""
    folder = files.scratch_folder(spark)
    arrays.register(spark)
    found = spark.read.format("volumes").option("resize", "false").load(volume_files(spark, d)).filter("ok")
    keyed = found.select(F.col("label").cast("long").alias("label"), F.regexp_extract("path", r"([0-9]+)\.nii$", 1).cast("long").alias("id"), "nth", "image")
    ordered = files.written(keyed).repartitionByRange(4, "label", "id", "nth").sortWithinPartitions("label", "id", "nth")
    ordered.select(F.col("image").alias("values")).write.format("arrays").option("shape", "4,2").mode("append").save(f"{folder}/images")
    ordered.select(F.array("label").alias("values")).write.format("arrays").option("shape", "1").option("dtype", "int64").mode("append").save(f"{folder}/labels")
    images, labels = (spark.read.format("arrays").load(f"{folder}/{name}") for name in ("images", "labels"))
    met = images.join(labels.select("row", F.col("values")[0].cast("long").alias("label")), "row")
    return met.select("row", "label", F.round(total(F.transform("values", lambda v, p: v * (p + 1))), 4).alias("digest"))


@query("select row, round(sum((j + 1) * v), 4) as total from (select row_number() over (order by vec_id) - 1 as row, unnest(range(64)) as j, cast(unnest(embedding) as double) as v from embeddings) group by row")
def array_files(spark, d):
    """Images are written as parts of one array of 8 x 8 floats, in the order of their ids, and read again by ranges of rows."""
    folder = files.scratch_folder(spark)
    arrays.register(spark)
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("values"))
    ordered = rows.repartitionByRange(4, "vec_id").sortWithinPartitions("vec_id").select("values")
    ordered.write.format("arrays").option("shape", "8,8").mode("append").save(folder)
    found = spark.read.format("arrays").option("bytesPerTask", 64 * 1024).load(folder)
    return found.select("row", F.round(total(F.transform("values", lambda v, j: v * (j + 1))), 4).alias("total"))


@query("select label, path from (select label::varchar as label, '/' || vec_id as path, row_number() over (partition by label order by '/' || vec_id) as k from embeddings) where k <= 5")
def first_files(spark, d):
    rows = samples(spark, d).select(F.col("label").cast("string").alias("label"), F.concat(F.lit("/"), F.col("id")).alias("path"))
    return nifti.first_paths(rows, 5)


@query(f"""with {PX}, s as (select *, {sql.uniform('42flip')} < 0.5 as coin from px)
select a.id, cast(a.j as int) as j, round(b.v, 6) as v from s a join px b on b.id = a.id and b.j = case when a.coin then (a.j // 8) * 8 + 7 - a.j % 8 else a.j end""")
def augment_flip(spark, d):
    return long(prep.augment_flip(samples(spark, d), 8), "features", "id")


@query(f"""with {PX}
select id, cast(j as int) as j, round(case when {sql.uniform('42noise')} < 0.5 then greatest(0, least(1, v + 0.02::double * {sql.gauss('42', "id || '_' || j")})) else v end, 6) as v from px""")
def augment_noise(spark, d):
    return long(prep.augment_noise(samples(spark, d)), "features", "id")


@query("select vec_id as id, case label when 0 then 'CN' when 1 then 'MCI' when 2 then 'AD' end as name from embeddings where label < 3")
def label_decode(spark, d):
    return three(spark, d).select("id", prep.decode_label(F.col("label"), NAMES).alias("name"))


@query("select vec_id as id, c::int as c, case when c = label then 1 else 0 end as hot from embeddings, range(3) t(c) where label < 3")
def one_hot(spark, d):
    return three(spark, d).select("id", F.posexplode(prep.one_hot(F.col("label"), 3)).alias("c", "hot"))


@query(f"""with {PX}, s as (select *, min(v) over (partition by id) as lo, max(v) over (partition by id) as hi, max(abs(v)) over (partition by id) as mx from px)
select id, cast(j as int) as j, round(greatest(0, least(1, 0.6::double * (v - lo) / (hi - lo + 1e-8::double) + 0.4::double * abs(v) / mx)), 6) as v from s""")
def overlay_blend(spark, d):
    heat = F.transform("features", lambda v: F.abs(v) / F.array_max(F.transform("features", F.abs)))
    return long(samples(spark, d).withColumn("z", prep.overlay(prep.minmax(F.col("features")), heat)), "z", "id")


@query("select vec_id as id, label, text is not null as has_text, n_chars from embeddings join documents on doc_id = vec_id")
def zip_join(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").isNotNull().alias("has_text"), "n_chars")
    return samples(spark, d).select("id", "label").join(docs, "id")


# splits and partitions


@query(f"""with r as (select vec_id as id, row_number() over (order by {sql.hashed('42', 'vec_id')}) as rn, count(*) over () as n from embeddings)
select id, case when rn <= cast(floor(0.8::double * n) as bigint) then 'train' when rn <= cast(floor(0.9::double * n) as bigint) then 'val' else 'test' end as split from r""")
def split_80_10_10(spark, d):
    return split.split_by_cuts(samples(spark, d).select("id"), [("train", 0.8), ("val", 0.9)], "test")


@query(f"""with r as (select vec_id as id, row_number() over (order by {sql.hashed('rs', 'vec_id')}) as rn, count(*) over () as n from embeddings)
select id, case when rn <= cast(floor(0.8::double * n) as bigint) then 'train' when rn <= cast(floor(0.8::double * n) as bigint) + cast(floor(0.1::double * n) as bigint) then 'val' else 'test' end as split from r""")
def split_random(spark, d):
    return split.split_by_cuts(samples(spark, d).select("id"), [("train", 0.8), ("val", 0.1)], "test", "rs", sizes=True)


@query(f"""with r as (select vec_id as id, row_number() over (order by {sql.hashed('server', 'vec_id')}) as rn, count(*) over () as n from embeddings)
select id from r where rn > cast(floor(0.9::double * n) as bigint)""")
def server_holdout(spark, d):
    return split.split_by_cuts(samples(spark, d).select("id"), [("rest", 0.9)], "test", "server").filter("split = 'test'").select("id")


@query(f"""with s as (select distinct vec_id // 3 as subject from embeddings),
r as (select subject, row_number() over (order by {sql.hashed('42', 'subject')}) as rn, count(*) over () as n from s)
select vec_id as id, case when rn <= cast(floor(0.8::double * n) as bigint) then 'train' else 'test' end as split from embeddings join r on subject = vec_id // 3""")
def split_by_subject(spark, d):
    return split.split_by_subject(samples(spark, d).select("id", "subject")).select("id", "split")


@query(f"with {sql.dealt()} select id, label, client from dealt")
def dirichlet_partition(spark, d):
    return dealt(spark, d).select("id", "label", "client")


@query(f"""with ranked as (
  select l_orderkey * 10 + l_linenumber as id, case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as label,
         row_number() over (partition by l_returnflag order by {sql.hashed('42', '(l_orderkey * 10 + l_linenumber)')}, l_orderkey) as rn, count(*) over (partition by l_returnflag) as n
  from (select distinct l_orderkey, l_linenumber, min(l_returnflag) as l_returnflag from lineitem group by all))
select client, label, count(*) as n from (
  select ranked.label, cast(len(list_filter(s.cum, lambda x: ranked.rn > floor(x * ranked.n))) as int) as client from ranked join (values {sql.shares()}) s(label, cum) on s.label = ranked.label) group by all""")
def dirichlet_partition_lineitem(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"))
    label = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    rows = rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), label.alias("label"))
    return split.dirichlet_partition(rows, CLASSES).groupBy("client", "label").agg(F.count(F.lit(1)).alias("n"))


_STATS = ", ".join(f"count(*) filter (label = {c}) as class_{c}" for c in range(CLASSES))
_ALL = "round(count(*) * 100.0::double / (select count(*) from dealt), 1) as percentage"


@query(f"with {sql.dealt()} select client, {_STATS}, count(*) as total, {_ALL} from dealt group by client")
def partition_stats(spark, d):
    return split.partition_stats(dealt(spark, d), list(range(CLASSES)))


@query(f"with {sql.dealt()} select client, {_STATS}, count(*) as total, {_ALL} from dealt group by rollup (client)")
def partition_stats_rollup(spark, d):
    return split.partition_stats(dealt(spark, d), list(range(CLASSES)), total_row=True)


@query(f"""with {sql.dealt()}, c as (select client, label, count(*) as n from dealt group by all)
select client, label, round(n * 100.0::double / (sum(n) over (partition by client) + 1e-8::double), 6) as pct from c""")
def partition_pct(spark, d):
    return split.client_class_pct(dealt(spark, d)).withColumn("pct", F.round("pct", 6))


@query(f"""with {sql.dealt()}, r as (select id, client, row_number() over (partition by client order by {sql.hashed('local')}) as rn, count(*) over (partition by client) as n from dealt)
select id, client, case when rn <= greatest(1, floor(n * 0.1::double)) then 'val' else 'train' end as split from r""")
def client_local_split(spark, d):
    return split.client_local_split(dealt(spark, d)).select("id", "client", "split")


@query(f"select vec_id as id, cast(floor((row_number() over (order by {sql.hashed('batch', 'vec_id')}) - 1) / 32) as bigint) as batch from embeddings")
def batch_assign(spark, d):
    return split.batches(samples(spark, d).select("id"))


@query(f"select vec_id as id from embeddings order by {sql.hashed('bg', 'vec_id')}, vec_id limit 20")
def background_sample(spark, d):
    return split.draw(samples(spark, d).select("id"), 20, "bg")


@query(f"""with b as (select vec_id as id from embeddings order by {sql.hashed('bg', 'vec_id')}, vec_id limit 20)
select vec_id as id from embeddings where vec_id not in (select id from b) order by {sql.hashed('test', 'vec_id')}, vec_id limit 50""")
def anti_sample(spark, d):
    rows = samples(spark, d).select("id")
    return split.draw(rows, 50, "test", without=split.draw(rows, 20, "bg"))


# grouped statistics


@query("select label, count(*) as n from embeddings group by label")
def class_counts(spark, d):
    return samples(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("select label, count(*) as n, round(sum(count(*)) over () / (count(*) over () * count(*))::double, 9) as weight from embeddings group by label")
def class_weights(spark, d):
    return model.class_weights(samples(spark, d), CLASSES).withColumn("weight", F.round("weight", 9))


@query("""select source, count(*) as total, count(*) filter (n_chars >= 300) as processed, count(*) filter (n_chars < 300 or n_chars is null) as failed,
3 * count(*) filter (n_chars >= 300) as output_slices from documents group by source""")
def ingest_stats(spark, d):
    ok = F.coalesce(F.col("n_chars") >= 300, F.lit(False))
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("processed"), F.count_if(~ok).alias("failed"), (3 * F.count_if(ok)).alias("output_slices"))


# scoring and metrics


@query(f"with {SCORED} select id, c, round(z, 6) as z from logits")
def linear_logits(spark, d):
    return scored(spark, d).select("id", F.posexplode("logits").alias("c", "z")).withColumn("z", F.round("z", 6))


@query(f"with {SCORED} select id, c, round(p, 6) as p from probs")
def softmax_probs(spark, d):
    return scored(spark, d).select("id", F.posexplode("probs").alias("c", "p")).withColumn("p", F.round("p", 6))


@query(f"with {SCORED} select id, label, pred from pred")
def predict_argmax(spark, d):
    return scored(spark, d).select("id", "label", "pred")


@query(f"with {SCORED} select id, round(confidence, 6) as confidence from pred")
def confidence_scores(spark, d):
    return scored(spark, d).select("id", F.round("confidence", 6).alias("confidence"))


_GRID = "grid as (select a::int as label, b::int as pred from range(3) x(a), range(3) y(b)), cm as (select label, pred, (select count(*) from pred p where p.label = g.label and p.pred = g.pred) as n from grid g)"
_PRF = """prf as (select c, support, coalesce(tp / nullif(predicted, 0)::double, 0) as precision, coalesce(tp / nullif(support, 0)::double, 0) as recall,
  coalesce(2.0::double * tp / nullif(predicted + support, 0), 0) as f1 from (
  select c::int as c, sum(n) filter (label = c and pred = c)::bigint as tp, sum(n) filter (label = c)::bigint as support, sum(n) filter (pred = c)::bigint as predicted from cm, range(3) t(c) group by c))"""


@query(f"with {SCORED}, {_GRID} select label, pred, n from cm")
def confusion_matrix(spark, d):
    return metrics.confusion(scored(spark, d), MODEL_CLASSES)


@query(f"with {SCORED}, {_GRID}, {_PRF} select c, support, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from prf")
def per_class_prf(spark, d):
    out = metrics.precision_recall(metrics.confusion(scored(spark, d), MODEL_CLASSES))
    return out.select("c", "support", *(F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")))


@query(f"""with {SCORED}, {_GRID}, {_PRF} select round((select avg(case when label = pred then 1.0 else 0.0 end) from pred), 6)::double as accuracy,
round(avg(precision), 6) as precision_macro, round(avg(recall), 6) as recall_macro, round(avg(f1), 6) as f1_macro from prf""")
def macro_metrics(spark, d):
    return metrics.macro(scored(spark, d), MODEL_CLASSES).select(*(F.round(x, 6).alias(x) for x in ("accuracy", "precision_macro", "recall_macro", "f1_macro")))


@query(f"with {SCORED}, {_GRID}, {_PRF} select round(avg(f1), 6) as f1_macro from prf where c in (select label from pred union select pred from pred)")
def macro_f1_present(spark, d):
    return metrics.macro_f1_present(scored(spark, d)).select(F.round("f1_macro", 6).alias("f1_macro"))


_OVR = "ovr as materialized (select c, round(p, 9) as score, (label = c)::int as y from probs)"


@query(f"""with {SCORED}, {_OVR}, r as (select *, rank() over (partition by c order by score) + (count(*) over (partition by c, score) - 1) / 2.0::double as rk from ovr)
select c, round((sum(rk) filter (y = 1) - sum(y) * (sum(y) + 1) / 2.0::double) / (sum(y) * sum(1 - y)), 6) as auroc from r group by c""")
def auroc_ovr(spark, d):
    return metrics.auroc(metrics.one_vs_rest(scored(spark, d))).withColumn("auroc", F.round("auroc", 6))


@query(f"""with {SCORED}, {_OVR}, r as (select *, rank() over (partition by c order by score) + (count(*) over (partition by c, score) - 1) / 2.0::double as rk from ovr),
a as (select c, (sum(rk) filter (y = 1) - sum(y) * (sum(y) + 1) / 2.0::double) / nullif(sum(y) * sum(1 - y), 0) as auroc from r group by c)
select case when count(auroc) = count(*) then round(avg(auroc), 6) else 0 end as auroc_macro from a""")
def auroc_macro(spark, d):
    return metrics.auroc_macro(metrics.one_vs_rest(scored(spark, d))).withColumn("auroc_macro", F.round("auroc_macro", 6))


_ROC = """pts as (select c, score, sum(y) as pos, sum(1 - y) as neg from ovr group by all),
roc as (select c, score, sum(pos) over w / sum(pos) over (partition by c)::double as tpr, sum(neg) over w / sum(neg) over (partition by c)::double as fpr from pts window w as (partition by c order by score desc))"""


@query(f"with {SCORED}, {_OVR}, {_ROC} select c, score, round(tpr, 6) as tpr, round(fpr, 6) as fpr from roc")
def roc_curve(spark, d):
    return metrics.roc_points(metrics.one_vs_rest(scored(spark, d))).select("c", "score", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query(f"""with {SCORED}, {_OVR}, {_ROC}, s as (select *, coalesce(lag(tpr) over (partition by c order by score desc), 0) as t0, coalesce(lag(fpr) over (partition by c order by score desc), 0) as f0 from roc)
select c, round(sum((fpr - f0) * (tpr + t0) / 2), 6) as auc from s group by c""")
def roc_auc_trapezoid(spark, d):
    return metrics.trapezoid_auc(metrics.one_vs_rest(scored(spark, d))).withColumn("auc", F.round("auc", 6))


@query(f"""with {SCORED}, cw as (select label, (select count(*) from pred) / (3.0::double * count(*)) as weight from pred group by label),
b as (select id, cast(floor((row_number() over (order by {sql.hashed('batch')}) - 1) / 32) as bigint) as batch from pred),
per as (select batch, sum(-ln(p) * weight) / sum(weight) as loss, count(*) as n, sum((pred.label = pred)::int) as hits
  from pred join b using (id) join probs on probs.id = pred.id and probs.c = pred.label join cw on cw.label = pred.label group by batch)
select round(sum(loss * n) / sum(n), 6) as loss, round(sum(hits) * 100.0::double / sum(n), 6) as accuracy_pct from per""")
def weighted_ce_loss(spark, d):
    rows = three(spark, d)
    out = metrics.epoch_loss(model.score(split.batches(rows), centroids(spark, d)), model.class_weights(rows, MODEL_CLASSES))
    return out.select(F.round("loss", 6).alias("loss"), F.round("accuracy_pct", 6).alias("accuracy_pct"))


@query(f"""with {SCORED}, k as (select *, row_number() over (partition by label order by id) as rank from pred where pred = label),
m as (select min(n) as least from (select label, least(count(*), 5) as n from k group by label)) select id, label, pred, rank::int as rank from k, m where rank <= least""")
def correct_balanced_topk(spark, d):
    return explain.correct_first(scored(spark, d), 5)


@query(f"with {SCORED} select label, min(id) as id from pred where pred = label group by label")
def first_correct_per_class(spark, d):
    return explain.correct_first(scored(spark, d), 1, balanced=False).select("label", "id")


# histories


@query(f"with {HISTORY} select step, f1, n from history where f1 > 0 order by f1 desc, step limit 1")
def best_checkpoint(spark, d):
    return metrics.best_step(history(spark, d))


@query(f"""with {HISTORY}, b as (select step, f1, greatest(coalesce(max(f1) over (order by step rows between unbounded preceding and 1 preceding), 0), 0) as best_before from history)
select *, f1 > best_before as improved, f1 >= best_before as star from b""")
def best_so_far_flag(spark, d):
    return metrics.history_flags(history(spark, d)).select("step", "f1", "best_before", "improved", "star")


_EPS = f"""{HISTORY}, c as (select step, n, sum(n) over (order by step) as steps from history),
eps as (select step, steps::bigint as steps, 0.02::double * sqrt(2.0::double * steps * {float(np.log(1e5))!r}::double) / 1.1::double as epsilon from c)"""


def epsilons(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    steps = history(spark, d).withColumn("steps", F.sum("n").over(Window.orderBy("step")))  # a row for each step
    return steps.select("step", "steps", privacy.epsilon_simple(F.lit(1.1), F.col("steps"), F.lit(0.02)).alias("epsilon"))


@query(f"with {_EPS} select step, steps, round(epsilon, 6) as epsilon from eps")
def epsilon_history(spark, d):
    return epsilons(spark, d).withColumn("epsilon", F.round("epsilon", 6))


@query(f"""with {_EPS}, s as (select *, coalesce(max((epsilon > 3)::int) over (order by step rows between unbounded preceding and 1 preceding), 0) as over from eps)
select step, round(epsilon, 6) as epsilon from s where over = 0""")
def early_stop_history(spark, d):
    return metrics.early_stop(epsilons(spark, d), "epsilon", 3.0).select("step", F.round("epsilon", 6).alias("epsilon"))


# federated training


@query(f"""with {PX}, {sql.dealt()}, cp as (select client, c, j, avg(v) as w, count(distinct id) as n from (select px.id, px.label as c, j, v, client from px join dealt using (id)) group by all),
s as (select client, count(*) as n from dealt group by client)
select c, cast(j as int) as j, round(sum(w * s.n) / sum(s.n), 6) as w from cp join s using (client) group by c, j""")
def fedavg(spark, d):
    rows = dealt(spark, d)
    means = pixels_of(rows).groupBy("client", F.col("label").alias("c"), "j").agg(F.avg("v").alias("w"))
    sizes = rows.groupBy("client").agg(F.count(F.lit(1)).alias("n"))
    return federated.fedavg(means.join(F.broadcast(sizes), "client")).withColumn("w", F.round("w", 6))


def pixels_of(rows: DataFrame) -> DataFrame:
    return rows.select("id", "label", "client", F.posexplode("features").alias("j", "v"))


def dealt3(spark: SparkSession, d: str) -> DataFrame:
    return split.dirichlet_partition(three(spark, d), CLASSES)


def _rounds(spark: SparkSession, d: str, rounds: int) -> DataFrame:
    rows = files.written(dealt3(spark, d).select("features", "label", "client"))
    w = federated.federated_rounds(rows, MODEL_CLASSES, WIDTH, rounds)
    return model.from_matrix(spark, w).withColumn("w", F.round("w", 6))


@query(f"with {sql.rounds_sql(1, 1.0)} select c::int as c, j::int as j, round(w, 6) as w from w1")
def fl_round_1(spark, d):
    return _rounds(spark, d, 1)


@query(f"with {sql.rounds_sql(3, 1.0)} select c::int as c, j::int as j, round(w, 6) as w from w3")
def fl_rounds_3(spark, d):
    return _rounds(spark, d, 3)


@query(f"""with held as (select vec_id as hid, row_number() over (order by {sql.hashed('server', 'vec_id')}) > cast(floor(0.9::double * count(*) over ()) as bigint) as test from embeddings where label < 3),
{sql.rounds_sql(1, 1.0, "label < 3").replace("from embeddings where label < 3", "from embeddings join held on hid = vec_id where label < 3 and not test").replace("from px join dealt using (id) where", "from px join dealt using (id) where")},
t as (select px.id, px.label, c, sum(v * w) as z from px join held on hid = px.id and test join w1 using (j) group by all),
pr as (select id, label, c as pred from (select *, row_number() over (partition by id order by round(z, 9) desc, c) as k from t) where k = 1)
select label, pred::int as pred, count(*) as n from pr group by all""")
def fl_disjoint(spark, d):
    sides = split.split_by_cuts(three(spark, d), [("train", 0.9)], "test", "server")
    w = federated.federated_rounds(split.dirichlet_partition(sides.filter("split = 'train'"), CLASSES), MODEL_CLASSES, WIDTH, 1)
    return model.score(sides.filter("split = 'test'"), w).groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {sql.batches_sql(2, 12)} select c::int as c, j::int as j, round(w, 5) as w from f2")
def fl_adam(spark, d):
    """Two rounds of an epoch of Adam in mini-batches of 32. (The SQL takes clients of up to 384 rows.)"""
    rows = files.written(dealt3(spark, d).select("id", "features", "label", "client"))
    w, _ = federated.federated_adam(rows, MODEL_CLASSES, WIDTH, rounds=2, epochs=1)
    return model.from_matrix(spark, w).withColumn("w", F.round("w", 5))


def units3(spark: SparkSession, d: str) -> DataFrame:
    """Rows with their client as the only unit, written."""
    return files.written(dealt3(spark, d).select("features", "label", F.array("client").alias("units")))


_PRIVATE = training.Experiment("private", CLIENTS, rounds=1, epochs=2, sigma=1.1, clip=0.5, adam=False, rate=0.5, decay=0.0)


@query(f"""with {PX}, {sql.dealt(where='label < 3')}, {sql.steps_sql("select client as unit, px.id, px.label, j, v from px join dealt using (id)", "select distinct client as unit, client, 1.1::double as sigma from dealt", 2, 0.5, 0.5)}
select c::int as c, j::int as j, round(sum(w * n) / sum(n), 6) as w from s2 join un using (unit) group by c, j""")
def fl_private_round(spark, d):
    """A round in which each client takes two steps on clipped and noisy sums of its own rows."""
    trainer = training.Trainer([_PRIVATE], MODEL_CLASSES, WIDTH, seed=42)
    trainer.train(units3(spark, d))
    return model.from_matrix(spark, trainer.weights_of(0)).withColumn("w", F.round("w", 6))


@query(f"""with {sql.dealt(where='label < 3')}, c as (select distinct client from dealt)
select 'private' as experiment, r::int as round, client::int as client, (2 * r)::int as steps, round(sqrt(2.0::double * 2 * r * {float(np.log(1e5))!r}::double) / 1.1::double, 6) as epsilon from c, range(1, 4) t(r)""")
def fl_private_ledger(spark, d):
    """What each client has spent after each of three private rounds."""
    from dataclasses import replace

    trainer = training.Trainer([replace(_PRIVATE, rounds=3)], MODEL_CLASSES, WIDTH, seed=42)
    ledger = trainer.train(units3(spark, d)).ledger
    return training.ledger_table(spark, ledger).withColumn("epsilon", F.round("epsilon", 6))


@query(f"with {sql.rounds_sql(3, 1.0)} select c::int as c, j::int as j, round(w, 6) as w from w3")
def fl_resumed(spark, d):
    """Three rounds, cut off after the second and taken up from its checkpoint by another trainer."""
    plan = training.Experiment("resumed", CLIENTS, rounds=3, adam=False, rate=1.0, decay=0.0)
    rows, folder = units3(spark, d), files.scratch_folder(spark)
    first = training.Trainer([plan], MODEL_CLASSES, WIDTH)

    def after_round(trainer):
        training.save_round(spark, trainer.state, folder)
        return trainer.state.round[0] == 2

    first.train(rows, after_round=after_round)
    second = training.Trainer([plan], MODEL_CLASSES, WIDTH)
    training.load_round(second, spark, folder)
    second.train(rows)
    return model.from_matrix(spark, second.weights_of(0)).withColumn("w", F.round("w", 6))


@query(f"""with {PX}, {sql.dealt(where='label < 3')}, loc as (select id, label, client, row_number() over (partition by client order by {sql.hashed('local')}) as rn, count(*) over (partition by client) as n from dealt),
side as materialized (select id, label, client, rn <= greatest(1, floor(n * 0.1::double)) as val from loc),
cw as materialized (select client, label, sum(count(*)) over (partition by client) / (count(*) over (partition by client) * count(*))::double as cw from side group by client, label),
r as materialized (select px.id, px.label, client, val, cw, j, v from px join side using (id) join cw using (client) where cw.label = px.label),
n as (select client, count(*) filter (not val) / 64 as n, sum(cw) filter (not val) / 64 as t from r group by client),
u as (select r.client, c, j, -sum(cw * (1 / 3.0::double - (c = label)::int) * v) / any_value(t) as w from r join n using (client), range(3) k(c) where not val group by all),
w as materialized (select c, j, sum(w * n) / sum(n) as w from u join n using (client) group by c, j),
z as (select id, client, label, cw, c, sum(v * w) as z from r join w using (j) where val group by all),
e as (select *, exp(z - max(z) over (partition by id)) as e, row_number() over (partition by id order by round(z, 9) desc, c) as k from z),
p as (select *, e / sum(e) over (partition by id) as p, max(case when k = 1 then c end) over (partition by id) as pred from e)
select client::int as client, any_value(n)::bigint as n_train, count(*) as n_val, round(sum(cw * -ln(p)) / sum(cw), 6) as loss, round(avg((pred = label)::int) * 100, 6) as accuracy_pct from p join n using (client) where c = label group by client""")
def client_round(spark, d):
    """A round in which each client trains on nine tenths of its rows, weighted by its own labels, and the mean is
    evaluated on the rest of each."""
    rows = files.written(split.client_local_split(dealt3(spark, d)).withColumn("units", F.array("client")))
    weights = training.label_weights(rows, CLIENTS, MODEL_CLASSES)
    plan = training.Experiment("local", CLIENTS, adam=False, rate=1.0, decay=0.0)
    trainer = training.Trainer([plan], MODEL_CLASSES, WIDTH, weights=weights)
    trainer.train(rows.filter("split = 'train'"))
    of = F.array(*(F.array(*map(F.lit, map(float, w))) for w in weights))
    own = F.element_at(F.element_at(of, F.col("client") + 1), F.col("label") + 1)
    scored = model.score(rows.filter("split = 'val'"), trainer.weights_of(0)).withColumn("_w", own)
    loss = F.sum(-F.log(F.element_at("probs", F.col("label") + 1)) * F.col("_w")) / F.sum("_w")
    out = scored.groupBy("client").agg(F.count(F.lit(1)).alias("n_val"), F.round(loss, 6).alias("loss"), F.round(F.avg(F.when(F.col("pred") == F.col("label"), 1.0).otherwise(0.0)) * 100, 6).alias("accuracy_pct"))
    trained = rows.filter("split = 'train'").groupBy("client").agg(F.count(F.lit(1)).alias("n_train"))
    return out.join(trained, "client").select(F.col("client").cast("int").alias("client"), "n_train", "n_val", "loss", "accuracy_pct")


@query(f"""with {sql.dealt(where='label < 3')}, n as (select client, label, count(*) as n from dealt group by all), t as (select client, sum(n) as total, count(*) as present from n group by client)
select k.client::int as client, c::int as label, round(coalesce(total / (present * n)::double, 1), 9) as weight from range(4) k(client) cross join range(3) r(c) left join t on t.client = k.client left join n on n.client = k.client and n.label = c""")
def client_class_weights(spark, d):
    """Each client's class weights from its own labels."""
    w = training.label_weights(units3(spark, d), CLIENTS, MODEL_CLASSES)
    rows = [(k, c, float(w[k, c])) for k in range(CLIENTS) for c in range(MODEL_CLASSES)]
    return spark.createDataFrame(rows, "client int, label int, weight double").withColumn("weight", F.round("weight", 9))


@query(f"""with {SCORED}, {sql.dealt(where='label < 3')}
select client, count(*) as n, round(avg(-ln(p)), 6) as loss, round(avg((pred = pred.label)::int) * 100, 6) as accuracy_pct
from pred join dealt using (id) join probs on probs.id = pred.id and probs.c = pred.label group by client""")
def client_eval_metrics(spark, d):
    out = federated.client_metrics(model.score(dealt3(spark, d), centroids(spark, d)))
    return out.select("client", "n", F.round("loss", 6).alias("loss"), F.round("accuracy_pct", 6).alias("accuracy_pct"))


@query(f"""with {sql.rounds_sql(1, 1.0)}
select u0.client::bigint as client, c::int as c, u0.j::int as j, round(u0.w, 6) as w, u0.n::bigint as n, round({float(np.log(3))!r}::double, 6) as loss from u0""")
def client_fit_metrics(spark, d):
    out = federated.client_step(dealt3(spark, d), np.zeros((MODEL_CLASSES, WIDTH)), 1.0)
    return out.select("client", "c", "j", F.round("w", 6).alias("w"), "n", F.round("loss", 6).alias("loss"))


_GRAD = f"""{SCORED}, n as (select count(*) as n from pred),
grads as materialized (select c, j, sum((p - case when c = probs.label then 1 else 0 end) * v) / (select n from n) as g from probs join p3 using (id) group by all)"""


def grads(spark: SparkSession, d: str) -> DataFrame:
    w = model.to_matrix(centroids(spark, d), MODEL_CLASSES, WIDTH)
    return privacy.mean_gradient(three(spark, d), w)


@query(f"with {_GRAD} select c, j::int as j, round(g, 6) as g from grads")
def softmax_grad(spark, d):
    return grads(spark, d).withColumn("g", F.round("g", 6))


@query(f"""with {_GRAD}, s as (select c, j, w, g + 1e-4::double * w as g from grads join params using (c, j))
select c, j::int as j, round(w - 1e-4::double * ((0.1::double * g) / 0.1::double) / (sqrt(0.001::double * g * g / 0.001::double) + 1e-8::double), 6) as w from s""")
def adam_step_1(spark, d):
    return model.adam_step(centroids(spark, d), grads(spark, d)).select("c", "j", F.round("w", 6).alias("w"))


@query("with " + HISTORY + """ select step as epoch, case when step < 15 then 'frozen' else 'all' end as phase, case when step < 15 then 1e-4::double else 1e-4::double * 0.1::double end as rate, step = 15 as fresh_optimiser from history""")
def freeze_schedule(spark, d):
    """The phase of each epoch of a history."""
    return model.freeze_schedule(history(spark, d).select(F.col("step").alias("epoch")), 15)


_FIRST = "w - {rate} * (g + 1e-4::double * w) / (abs(g + 1e-4::double * w) + 1e-8::double)"


@query(f"""with {PX}, p3 as materialized (select * from px where label < 3), n as (select count(*) / 64 as n from p3),
g0 as (select c, j, sum((1 / 3.0::double - (c = label)::int) * v) / (select n from n) as g from p3, range(3) t(c) group by all),
w1 as materialized (select c, j, case when j < 32 then 0 else -1e-2::double * g / (abs(g) + 1e-8::double) end as w from g0),
z as materialized (select id, label, c, sum(v * w) as z from p3 join w1 using (j) group by all), p as (select id, c, exp(z) / sum(exp(z)) over (partition by id) - (c = label)::int as e from z),
g1 as (select c, j, sum(e * v) / (select n from n) as g from p join p3 using (id) group by all)
select c::int as c, j::int as j, round({_FIRST.format(rate="1e-3::double")}, 5) as w from w1 join g1 using (c, j)""")
def two_phase_params(spark, d):
    """An epoch with the first half of the features frozen, and one of all at a tenth of the rate by a fresh optimiser."""
    w, _ = model.train_two_phase(three(spark, d), MODEL_CLASSES, WIDTH, 2, 1, list(range(32)))
    return model.from_matrix(spark, w).withColumn("w", F.round("w", 5))


@query(f"with {PX3} select c, (j // 4)::bigint as cell, round(avg(w), 6) as w from params group by all")
def channel_mean_init(spark, d):
    return prep.channel_mean(centroids(spark, d).withColumn("cell", F.expr("cast(j div 4 as bigint)")), ["c", "cell"]).withColumn("w", F.round("w", 6))


@query(f"with {PX3} select count(*) as total, count(*) filter (j >= 32) as trainable from params")
def param_counts(spark, d):
    return model.count_params(centroids(spark, d), F.col("j") < 32)


# differential privacy


@query(f"with {_GRAD}, nm as (select sqrt(sum(g * g)) as norm from grads) select c, j::int as j, round(g * least(1, 0.05::double / (norm + 1e-6::double)), 6) as clipped from grads, nm")
def grad_clip_batch(spark, d):
    return model.clip_by_norm(grads(spark, d), 0.05).select("c", "j", F.round("clipped", 6).alias("clipped"))


@query(f"""with {_GRAD}, nm as (select sqrt(sum(g * g)) as norm from grads)
select c, j::int as j, round(g * least(1, 0.05::double / (norm + 1e-6::double)) + {sql.gauss('42', "(c || '_' || j)")} * {1.1 * 0.05 / 32!r}::double, 6) as noisy from grads, nm""")
def dp_noisy_grad(spark, d):
    return privacy.noisy_gradient(grads(spark, d), 1.1, 0.05, 32).select("c", "j", F.round("noisy", 6).alias("noisy"))


@query(f"""with {SCORED}, e as (select id, c, p - case when c = label then 1 else 0 end as e from probs), xn as (select id, sqrt(sum(v * v)) as xn from p3 group by id),
sc as (select id, least(1, 0.1::double / (sqrt(sum(e * e)) * any_value(xn))) as s from e join xn using (id) group by id)
select c, j::int as j, round(sum(e * s * v), 6) as g from e join sc using (id) join p3 using (id) group by c, j""")
def dp_per_row_clip(spark, d):
    w = model.to_matrix(centroids(spark, d), MODEL_CLASSES, WIDTH)
    return privacy.per_row_clipped(three(spark, d), w, 0.1).withColumn("g", F.round("g", 6))


@query(f"""with s as (select cast(unnest([0.0, 0.5, 0.7, 1.1]) as double) as sigma), n as (select count(*) as n from embeddings)
select sigma, round(case when sigma = 0 then 'infinity'::double else least(32.0::double / n, 1) * sqrt(2.0::double * 340 * {float(np.log(1e5))!r}::double) / sigma end, 6) as epsilon_simple from s, n""")
def epsilon_budget(spark, d):
    n = samples(spark, d).agg(F.count(F.lit(1)).alias("n"))
    rows = spark.createDataFrame([(0.0,), (0.5,), (0.7,), (1.1,)], "sigma double").crossJoin(F.broadcast(n))
    return rows.select("sigma", F.round(privacy.epsilon_simple(F.col("sigma"), F.lit(340), privacy.sample_rate(F.col("n"))), 6).alias("epsilon_simple"))


@query("""with t as (select p_partkey, (p_size % 21)::double / 2 as target from part)
select p_partkey, target, case target when 1.0 then 2.0 when 1.5 then 1.5 when 2.0 then 1.1 when 5.0 then 0.7 when 10.0 then 0.5 else 1.0 end::double as sigma, 2 * target as stop_above from t""")
def sigma_lookup(spark, d):
    """The noise for each part's target; targets are halves of sizes."""
    rows = table(spark, d, "part").select("p_partkey", ((F.col("p_size") % 21) / 2.0).alias("target"))
    return rows.select("p_partkey", "target", privacy.sigma_for(F.col("target")).alias("sigma"), (F.col("target") * 2).alias("stop_above"))


@query("""with k as (select distinct case when user_id % 40 = 0 then 'inf' else (user_id % 40) || '.0' end as key from events)
select key, row_number() over (order by case when key = 'inf' then 999 else try_cast(key as double) end)::int as place, case when key = 'inf' then 20 else try_cast(key as double) end::double as x from k""")
def privacy_curve_order(spark, d):
    """Stringified numbers that events have, in their numeric order; there are forty at most."""
    from pyspark.sql import Window

    user = F.col("user_id") % 40
    keys = table(spark, d, "events").select(F.when(user == 0, "inf").otherwise(F.concat(user.cast("string"), F.lit(".0"))).alias("key")).distinct()
    at = report.numeric_order(F.col("key"))
    return keys.select("key", F.row_number().over(Window.orderBy(at)).alias("place"), F.when(F.col("key") == "inf", 20.0).otherwise(at).alias("x"))


_SIGMAS = (1.1, 0.7, 0.5, 0.0)


@query(f"""with {PX}, side as materialized (select id, label, row_number() over (order by {sql.hashed('42')}) as rn, count(*) over () as n from (select vec_id as id, label from embeddings where label < 3)),
{sql.steps_sql("select unit, px.id, px.label, j, v from px join side using (id), range(4) u(unit) where rn <= cast(floor(0.8::double * n) as bigint)", f"select unit, 0 as client, {list(_SIGMAS)!r}[unit + 1]::double as sigma from range(4) u(unit)", 5, 0.5, 1.0)},
tz as (select unit, px.id, px.label, c, sum(v * w) as z from px join side using (id) join s5 using (j) where rn > cast(floor(0.9::double * n) as bigint) group by all),
pred as (select unit, id, label, c as pred from (select *, row_number() over (partition by unit, id order by round(z, 9) desc, c) as k from tz) where k = 1),
cls as (select unit, c, count(*) filter (label = c and pred = c) as tp, count(*) filter (label = c) as p, count(*) filter (pred = c) as q from pred, range(3) t(c) group by all)
select sigma, round(case when sigma = 0 then 'infinity'::double else sqrt(2.0::double * 5 * {float(np.log(1e5))!r}::double) / sigma end, 6) as epsilon_simple, round(sum(tp) / sum(p)::double, 6) as accuracy,
round(avg(coalesce(2.0::double * tp / nullif(p + q, 0), 0)), 6) as f1_macro from cls join unit using (unit) group by sigma""")
def privacy_utility_table(spark, d):
    """Five private steps for each noise, and as many without any, on training rows; figures on rows held out. The noise
    comes from hashes here, so that it can be drawn again."""
    plans = [training.Experiment(str(s), epochs=5, sigma=s, clip=1.0 if s else None, adam=False, rate=0.5, decay=0.0) for s in _SIGMAS]
    sides = files.written(split.split_by_cuts(three(spark, d).select("id", "features", "label"), [("train", 0.8), ("val", 0.9)], "test"))
    trainer = training.Trainer(plans, MODEL_CLASSES, WIDTH, seed=42)
    state = trainer.train(files.written(training.deal(sides.filter("split = 'train'"), plans, MODEL_CLASSES)))
    got = metrics.macro_by(training.score_all(sides.filter("split = 'test'"), trainer), MODEL_CLASSES, ("experiment",))
    spent = training.spent(training.ledger_table(spark, state.ledger)).select("experiment", "epsilon")
    rows = got.join(spent, "experiment", "left").select(F.col("experiment").cast("double").alias("sigma"), F.coalesce("epsilon", F.lit(float("inf"))).alias("epsilon_simple"), "accuracy", "f1_macro")
    return rows.select("sigma", *(F.round(x, 6).alias(x) for x in ("epsilon_simple", "accuracy", "f1_macro")))


_TARGETS = ((2.0, 1.1), (5.0, 0.7), (10.0, 0.5))


@query(f"""with {PX}, {sql.steps_sql("select unit, id, label, j, v from px, range(3) u(unit) where label < 3", f"select unit, 0 as client, {[s for _, s in _TARGETS]!r}[unit + 1]::double as sigma from range(3) u(unit)", 3, 0.5, 1.0)},
loss as (select 1 as epoch, unit, avg(-ln(e / t)) as loss from (select *, sum(e) over (partition by unit, id) as t from se0) where c = label group by unit
  union all select 2, unit, avg(-ln(e / t)) from (select *, sum(e) over (partition by unit, id) as t from se1) where c = label group by unit
  union all select 3, unit, avg(-ln(e / t)) from (select *, sum(e) over (partition by unit, id) as t from se2) where c = label group by unit),
h as (select {[t for t, _ in _TARGETS]!r}[unit + 1]::double as target, epoch, loss, sqrt(2.0::double * epoch * {float(np.log(1e5))!r}::double) / sigma as epsilon from loss join unit using (unit))
select target, epoch::int as epoch, round(loss, 6) as loss, round(epsilon, 6) as epsilon from h where coalesce((select max(b.epsilon) from h b where b.target = h.target and b.epoch < h.epoch), 0) <= 2 * target""")
def private_history(spark, d):
    """Loss and spent privacy after each epoch, for each target with its noise: training ends once it has spent twice the target."""
    plans = [training.Experiment(str(t), epochs=3, sigma=s, clip=1.0, most_epsilon=2 * t, adam=False, rate=0.5, decay=0.0) for t, s in _TARGETS]
    trainer = training.Trainer(plans, MODEL_CLASSES, WIDTH, seed=42)
    state = trainer.train(files.written(training.deal(three(spark, d), plans, MODEL_CLASSES).select("features", "label", "units")))
    found = training.epoch_table(spark, state.epochs)
    return found.select(F.col("experiment").cast("double").alias("target"), "epoch", F.round("loss", 6).alias("loss"), F.round("epsilon", 6).alias("epsilon"))


# membership inference

_MEMBERS = f"""{SCORED}, sp as (select id, row_number() over (order by {sql.hashed('42')}) as rn, count(*) over () as n from pred),
members as materialized (select id, round(confidence, 9) as confidence, case when rn <= cast(floor(0.8::double * n) as bigint) then 1 else 0 end as member
  from pred join sp using (id) where rn <= cast(floor(0.8::double * n) as bigint) or rn > cast(floor(0.9::double * n) as bigint))"""


def members(spark: SparkSession, d: str) -> DataFrame:
    """Confidences of training rows and of test rows; the middle tenth is left out. The model's parameters come from all
    rows, so their scores carry some signal of class sizes only."""
    sides = split.split_by_cuts(three(spark, d), [("member", 0.8), ("unused", 0.9)], "other")
    rows = model.score(sides, centroids(spark, d)).withColumn("confidence", F.round("confidence", 9))
    flag = lambda name, value: rows.filter(F.col("split") == name).select("id", "confidence", F.lit(value).alias("member"))
    return flag("member", 1).unionByName(flag("other", 0))


_SWEEP = f"{_MEMBERS}, {sql.thresholds()}, sweep as (select t, avg(case when (confidence >= t) = (member = 1) then 1.0::double else 0.0::double end) as accuracy from members, thresholds group by t)"


@query(f"with {_MEMBERS} select id, member, round(confidence, 6) as confidence from members")
def union_members(spark, d):
    return members(spark, d).select("id", "member", F.round("confidence", 6).alias("confidence"))


@query(f"with {_SWEEP} select t, round(accuracy, 6) as accuracy from sweep")
def mia_sweep(spark, d):
    return privacy.attack_sweep(members(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


def quality_members(spark: SparkSession, d: str) -> DataFrame:
    """Scores with signal: lengths of documents against their quality labels."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    length = F.least(F.col("n_chars") / 5000.0, F.lit(1.0))
    return table(spark, d, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("id"), F.round(F.coalesce(length, F.lit(0.0)), 6).alias("confidence"), F.when(F.col("quality") == 1, 1).otherwise(0).alias("member"))


_QM = "members as (select doc_id as id, round(coalesce(least(n_chars / 5000.0::double, 1), 0), 6) as confidence, case when quality = 1 then 1 else 0 end as member from labels join documents using (doc_id))"
_QS = f"{_QM}, {sql.thresholds()}, sweep as (select t, round(avg(case when (confidence >= t) = (member = 1) then 1.0::double else 0.0::double end), 9) as accuracy from members, thresholds group by t)"


@query(f"with {_QS} select round(accuracy * 100, 6) as accuracy_pct, round(accuracy * 100 - 50, 6) as advantage_pct, t as threshold from sweep order by accuracy desc, t limit 1")
def mia_best(spark, d):
    out = privacy.best_attack(privacy.attack_sweep(quality_members(spark, d)).withColumn("accuracy", F.round("accuracy", 9)))
    return out.select(F.round("accuracy_pct", 6).alias("accuracy_pct"), F.round("advantage_pct", 6).alias("advantage_pct"), "threshold")


@query(f"with {_SWEEP}, s as (select t, round(accuracy, 9) as accuracy from sweep) select round(accuracy * 100, 6) as accuracy_pct, round(accuracy * 100 - 50, 6) as advantage_pct, t as threshold from s order by accuracy desc, t limit 1")
def mia_end_to_end(spark, d):
    out = privacy.best_attack(privacy.attack_sweep(members(spark, d)).withColumn("accuracy", F.round("accuracy", 9)))
    return out.select(F.round("accuracy_pct", 6).alias("accuracy_pct"), F.round("advantage_pct", 6).alias("advantage_pct"), "threshold")


_CURVE = """pts as (select confidence, sum(member) as m, sum(1 - member) as o from members group by all),
curve as (select confidence, sum(m) over w / sum(m) over ()::double as tpr, sum(o) over w / sum(o) over ()::double as fpr from pts window w as (order by confidence desc))"""


@query(f"with {_QM}, {_CURVE} select confidence, round(tpr, 6) as tpr, round(fpr, 6) as fpr from curve")
def mia_cumulative(spark, d):
    return privacy.attack_curve(quality_members(spark, d)).select("confidence", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query(f"""with {_QM}, {_CURVE}, b as (select confidence, (tpr + 1 - fpr) / 2 as ba from curve order by round((tpr + 1 - fpr) / 2, 9) desc, confidence desc limit 1), s as (select avg(member) as share from members)
select round(ba, 6) as balanced_accuracy, confidence as threshold, round(greatest(share, 1 - share), 6) as majority_rate from b, s""")
def mia_balanced(spark, d):
    out = privacy.balanced_attack(quality_members(spark, d))
    return out.select(F.round("balanced_accuracy", 6).alias("balanced_accuracy"), "threshold", F.round("majority_rate", 6).alias("majority_rate"))


# attributions: an embedding as 4 channels of 4 x 4, and its neighbour's as gradients

_CAM = f"""{PX}, av as materialized (select a.id, a.j // 16 as ch, (a.j % 16) // 4 as y, a.j % 4 as x, a.v as act, b.v as grad from px a join px b on b.id = a.id and b.j = 63 - a.j),
cw as (select id, ch, avg(grad) as w from av group by all), cam as materialized (select id, y::int as y, x::int as x, greatest(0, sum(w * act)) as heat from av join cw using (id, ch) group by all)"""


def maps(spark: SparkSession, d: str) -> DataFrame:
    heat = explain.activation_map(F.col("features"), F.reverse("features"), 4, 16)
    return samples(spark, d).select("id", heat.alias("map"))


def cells(rows: DataFrame) -> DataFrame:
    found = rows.select("id", F.posexplode("map").alias("j", "heat"))
    return found.select("id", F.expr("cast(j div 4 as int)").alias("y"), (F.col("j") % 4).alias("x"), F.round("heat", 6).alias("heat"))


@query(f"with {_CAM} select id, y, x, round(heat, 6) as heat from cam")
def gradcam_map(spark, d):
    return cells(maps(spark, d))


@query(f"""with {_CAM}, {_kernel_sql("wt", 4, 8, prep.bilinear_weights)}
select id, cast(a.o * 8 + b.o as int) as j, round(sum(a.w * b.w * heat), 6) as heat from cam join wt a on a.i = y join wt b on b.i = x group by all""")
def gradcam_upsampled(spark, d):
    return long(prep.resize(maps(spark, d), "map", (4, 4), (8, 8)), "map", "id", name="heat")


@query(f"""with {_CAM}, s as (select *, min(heat) over (partition by id) as lo, max(heat) over (partition by id) as hi from cam)
select id, y, x, round(case when hi > 0 then (heat - lo) / nullif(hi - lo, 0) else heat end, 6) as heat from s""")
def gradcam_norm(spark, d):
    return cells(maps(spark, d).withColumn("map", explain.scale_map(F.col("map"))))


_NET = conv.drawn_net((1, 8, 8), (2, 3), (2, 1), MODEL_CLASSES)
_CONV = sql.conv_sql(_NET)


@query(f"with {_CONV} select id, c::int as c, round(e / sum(e) over (partition by id), 6) as p from prob")
def conv_scores(spark, d):
    """Probabilities by a convolutional network with drawn weights; an embedding is an image of 8 x 8."""
    return conv.score(samples(spark, d), _NET).select("id", F.posexplode("probs").alias("c", "p")).withColumn("p", F.round("p", 6))


@query(f"""with {_CONV}, {_kernel_sql("wt", 4, 8, prep.bilinear_weights)}, {sql.cam_sql()}, span as (select *, min(v) over (partition by id, layer) as lo, max(v) over (partition by id, layer) as hi from heat)
select id, layer, c::int as target, round(confidence, 6) as confidence, j::int as j, round(case when hi > 0 then (v - lo) / (hi - lo) else v end, 5) as heat from span join best using (id)""")
def gradcam_class(spark, d):
    """Class-activation maps of the predicted class at both layers, by the network's own gradients."""
    rows = samples(spark, d)
    maps = [conv.class_maps(rows, _NET, k).withColumn("layer", F.lit(k)) for k in (0, 1)]
    cells = maps[0].unionByName(maps[1]).select("id", "layer", "target", F.round("confidence", 6).alias("confidence"), F.posexplode("heat").alias("j", "heat"))
    return cells.withColumn("heat", F.round("heat", 5))


@query(f"with {_CONV}, {sql.conv_gradient_sql()} select part, i::int as i, round(g, 5) as g from grad")
def conv_gradients(spark, d):
    """The loss's gradient by every weight of the network, summed over all rows."""
    g, _, _ = conv.gradients(three(spark, d), _NET)
    out, at = [], 0
    for part, a in zip(("kernel_0", "kernel_1", "bias_0", "bias_1", "head", "bias"), (*_NET.kernels, *_NET.biases, _NET.head, _NET.bias)):
        out += [(part, i, float(v)) for i, v in enumerate(g[at : at + a.size])]
        at += a.size
    return spark.createDataFrame(out, "part string, i int, g double").withColumn("g", F.round("g", 5) + F.lit(0.0))


@query(f"""with {PX}, p3 as materialized (select * from px where label < 3), par as (select label as c, j, avg(v) * 8 as w, avg(v * v) * 8 as w2 from p3 group by all),
bg as (select vec_id as b from embeddings where label < 3 order by {sql.hashed('bg', 'vec_id')}, vec_id limit 20),
draw as materialized (select p.id, b, (k + {sql.uniform('42', "(p.id || '_' || b || '_' || k)")}) / 2 as t from (select distinct id from p3) p, bg, range(2) r(k)),
phi as (select x.id, c, x.j, avg((x.v - y.v) * (w + 2 * w2 * (y.v + t * (x.v - y.v)))) as phi from draw join p3 x using (id) join p3 y on y.id = b and y.j = x.j join par on par.j = x.j group by all)
select id, c, j::int as j, round(phi, 6) + 0.0::double as phi from phi""")
def expected_gradients(spark, d):
    """Attributions of a model over features and their squares, two points on each way from 20 background rows."""
    rows = three(spark, d)
    w = model.to_matrix(model.centroid_params(experiment.with_model(rows, "vgg19")), MODEL_CLASSES, 2 * WIDTH)
    phi = explain.expected_gradients(rows, split.draw(rows, 20, "bg"), explain.square_gradient(w), paths=2)
    return phi.select("id", "c", F.posexplode("phi").alias("j", "phi")).withColumn("phi", F.round("phi", 6) + F.lit(0.0))


_SHAP = f"""{PX3}, bg as (select vec_id as id from embeddings where label < 3 order by {sql.hashed('bg', 'vec_id')}, vec_id limit 20),
mean as (select j, avg(v) as mu from p3 where id in (select id from bg) group by j),
phi as materialized (select id, c, j::int as j, w * (v - mu) as phi from p3 join mean using (j) join params using (j))"""


def shap(spark: SparkSession, d: str) -> DataFrame:
    rows = three(spark, d)
    chosen = split.draw(rows, 20, "bg")
    return explain.shap_linear(rows, centroids(spark, d), chosen)


@query(f"with {_SHAP} select id, c, j, round(phi, 6) + 0.0::double as phi from phi")
def shap_linear(spark, d):
    return shap(spark, d).select("id", "c", F.posexplode("phi").alias("j", "phi")).withColumn("phi", F.round("phi", 6) + F.lit(0.0))  # no -0


@query(f"with {SCORED} select id, c, round(z, 6) as total from logits")
def shap_additivity(spark, d):
    """A row's attributions and the background's logit, summed."""
    base = explain.background_logits(centroids(spark, d), split.draw(three(spark, d), 20, "bg"))
    summed = shap(spark, d).withColumn("phi", total(F.col("phi")))
    return summed.join(F.broadcast(base), "c").select("id", "c", F.round(F.col("phi") + F.col("base"), 6).alias("total"))


@query(f"with {_SHAP} select c, j, round(avg(abs(phi)), 6) as importance from phi group by c, j")
def shap_importance(spark, d):
    return explain.importance(shap(spark, d)).withColumn("importance", F.round("importance", 6))


@query(f"""with {_SHAP} select id, c, j, round(greatest(phi, 0), 6) as positive, round(abs(least(phi, 0)), 6) as negative, round(coalesce(abs(phi) / nullif(max(abs(phi)) over (partition by id, c), 0), 0), 6) as strength from phi""")
def shap_pos_neg(spark, d):
    names = ("positive", "negative", "strength")
    each = explain.signed_parts(shap(spark, d)).select("id", "c", F.posexplode(F.arrays_zip(*names)).alias("j", "v"))
    return each.select("id", "c", "j", *(F.round(f"v.{x}", 6).alias(x) for x in names))


@query(f"with {_SHAP} select row_number() over (order by id, c) - 1 as row, round(sum(phi * (j + 1)), 4) as digest from phi group by id, c")
def attribution_files(spark, d):
    """Attributions are written as one array of 8 x 8 maps, by id and class, and read again by ranges of rows."""
    folder = files.scratch_folder(spark)
    arrays.register(spark)
    ordered = shap(spark, d).repartitionByRange(4, "id", "c").sortWithinPartitions("id", "c").select(F.col("phi").alias("values"))
    ordered.write.format("arrays").option("shape", "8,8").option("dtype", "float64").mode("append").save(folder)
    found = spark.read.format("arrays").option("bytesPerTask", 64 * 1024).load(folder)
    return found.select("row", F.round(total(F.transform("values", lambda v, j: v * (j + 1))), 4).alias("digest"))


# reports


@query("select event_id, coalesce(cast(json_extract(props, '$.k') as double), 0) as k, coalesce(cast(json_extract(props, '$.accuracy') as double), 0) as accuracy from events")
def compile_metrics(spark, d):
    return report.compile_metrics(table(spark, d, "events").select("event_id", "props"), "k double, accuracy double").drop("props")


@query(f"""with {SCORED}, {_GRID}, {_PRF}, m as (select round((select avg(case when label = pred then 1.0 else 0.0 end) from pred), 6)::double as accuracy,
round(avg(precision), 6) as precision_macro, round(avg(recall), 6) as recall_macro, round(avg(f1), 6) as f1_macro from prf)
select '{{"accuracy":' || accuracy || ',"precision_macro":' || precision_macro || ',"recall_macro":' || recall_macro || ',"f1_macro":' || f1_macro || '}}' as json from m""")
def metrics_to_json(spark, d):
    return files.metrics_to_json(macro_metrics(spark, d))


_CLIENT_METRICS = f"""{SCORED}, {sql.dealt(where='label < 3')},
m as (select 'client_' || client as experiment, avg(-ln(p)) as loss, avg((pred = pred.label)::int) * 100 as accuracy_pct from pred join dealt using (id) join probs on probs.id = pred.id and probs.c = pred.label group by client)"""


@query(f"with {_CLIENT_METRICS} select experiment, round(loss, 6) as loss, round(accuracy_pct, 6) as accuracy_pct, 0.0::double as auroc_macro from m")
def metric_files(spark, d):
    """Metrics are written as JSON files by experiment, found again by name, compiled, written as CSV and read again."""
    folder = files.scratch_folder(spark)
    rows = federated.client_metrics(model.score(dealt3(spark, d), centroids(spark, d)))
    rows = rows.select(F.concat(F.lit("client_"), F.col("client")).alias("experiment"), F.round("loss", 6).alias("loss"), F.round("accuracy_pct", 6).alias("accuracy_pct"))
    files.write_metrics(rows, f"{folder}/metrics")
    files.write_metrics(rows.limit(1).withColumn("experiment", F.lit("other")), f"{folder}/metrics")
    found = files.read_metrics(spark, f"{folder}/metrics", "loss double, accuracy_pct double, auroc_macro double", "client_*")
    files.write_csv(found.select("experiment", "loss", "accuracy_pct", "auroc_macro"), f"{folder}/table")
    return files.read_csv(spark, f"{folder}/table", "experiment string, loss double, accuracy_pct double, auroc_macro double")


@query("with " + HISTORY + " select (row_number() over (order by step) - 1)::int as step, f1, n::double as n from history")
def history_file(spark, d):
    """A history is written as one row of parallel arrays, and read as a row for each step."""
    folder = files.scratch_folder(spark)
    one = F.array_sort(F.collect_list(F.struct("step", "f1", F.col("n").cast("double").alias("n"))))
    arrays = history(spark, d).agg(one.alias("h")).select(F.col("h.f1").alias("f1"), F.col("h.n").alias("n"))
    arrays.write.json(folder)
    return files.read_history(spark, folder, ["f1", "n"])


@query(f"with {PX3} select layout, c, j::int as j, round(w, 6) as w from params, (values ('flat'), ('nested')) t(layout)")
def checkpoint_layouts(spark, d):
    """Parameters are saved as a table, and as structs below one name, and both are loaded alike."""
    folder, params = files.scratch_folder(spark), centroids(spark, d)
    files.save_params(params, f"{folder}/flat")
    files.save_params(params.select(F.struct("*").alias("params")), f"{folder}/nested")
    both = [files.load_params(spark, f"{folder}/{name}").select(F.lit(name).alias("layout"), "c", "j", F.round("w", 6).alias("w")) for name in ("flat", "nested")]
    return both[0].unionByName(both[1])


@query("select url, regexp_extract(url, '([^/.]*)[^/]*$', 1) as bare, 'head._module.w' || page_id % 3 as key, 'head.w' || page_id % 3 as name from pages")
def strip_names(spark, d):
    rows = table(spark, d, "pages").select("url", F.concat(F.lit("head._module.w"), F.col("page_id") % 3).alias("key"))
    return rows.select("url", report.strip_extension(F.col("url")).alias("bare"), "key", report.strip_wrapper(F.col("key")).alias("name"))


@query(f"""with {sql.experiment_sql(3)}, {sql.thresholds()},
cls as (select c, count(*) filter (label = c and pred = c) as tp, count(*) filter (label = c) as p, count(*) filter (pred = c) as q from esc where side = 'test' group by c),
auc as (select a.c, avg(case when round(a.p, 9) > round(b.p, 9) then 1.0::double when round(a.p, 9) = round(b.p, 9) then 0.5::double else 0.0::double end) as v from esc a join esc b on a.c = b.c and a.label = a.c and b.label <> b.c and a.side = 'test' and b.side = 'test' group by a.c),
conf as (select id, any_value(side) as side, max(p) as confidence from esc group by id),
mia as (select t, avg(case when (confidence >= t) = (side = 'train') then 1.0::double else 0.0::double end) as accuracy from conf, thresholds group by t),
best as (select accuracy * 100 as accuracy from mia order by accuracy desc, t limit 1),
m as (select sum(tp) / sum(p)::double as accuracy, avg(coalesce(tp / nullif(q, 0)::double, 0)) as precision_macro, avg(coalesce(tp / nullif(p, 0)::double, 0)) as recall_macro, avg(coalesce(2.0::double * tp / nullif(p + q, 0), 0)) as f1_macro from cls),
a as (select case when count(*) = 3 then avg(v) else 0 end as v from auc)
select metric, round(value, 5) as value from (select 'accuracy' as metric, accuracy as value from m union all select 'precision_macro', precision_macro from m union all select 'recall_macro', recall_macro from m
  union all select 'f1_macro', f1_macro from m union all select 'auroc_macro', v from a union all select 'mia_accuracy', accuracy from best union all select 'mia_advantage', accuracy - 50 from best)""")
def experiment_one(spark, d):
    """One configured experiment: split, three epochs, metrics of the test rows and the attack."""
    out = experiment.sweep(three(spark, d), [("one", "central", "resnet50", 0.5, 1, 1, 3)], MODEL_CLASSES, WIDTH)
    return out.select(F.explode("metrics").alias("metric", "value")).withColumn("value", F.round("value", 5))


@query(None)
def experiment_sweep(spark, d):
    """Every configured experiment with all its rounds and epochs, and one that can't run."""
    configs = (*report.ABLATIONS, ("no_such_setting", "none", "resnet50", 0.5, 1, 1, 1))
    return report.ablation_table(experiment.sweep(three(spark, d), configs, MODEL_CLASSES, WIDTH, seed=42))


@query("""with k as (select p_partkey, case p_size % 4 when 0 then 'A5_alpha' || (p_partkey % 300) || '.5' when 1 then 'A6_K' || p_size when 2 then 'A7_E' || p_size else 'A1_no_dp' end as key from part)
select p_partkey, key, split_part(key, '_', 1) as family, regexp_extract(key, '_(K|E|alpha)[0-9.]+$', 1) as variable,
case when key like '%alpha%' and coalesce(try_cast(regexp_extract(key, '(?:K|E|alpha)([0-9.]+)$', 1) as double), 0) >= 100 then 'IID' else regexp_extract(key, '(?:K|E|alpha)([0-9.]+)$', 1) end as value from k""")
def parse_experiment_key(spark, d):
    """Experiments' keys, made from parts, taken apart."""
    size = F.col("p_size")
    key = F.when(size % 4 == 0, F.concat(F.lit("A5_alpha"), (F.col("p_partkey") % 300).cast("string"), F.lit(".5"))).when(size % 4 == 1, F.concat(F.lit("A6_K"), size)).when(size % 4 == 2, F.concat(F.lit("A7_E"), size)).otherwise("A1_no_dp")
    return table(spark, d, "part").select("p_partkey", key.alias("key")).select("p_partkey", "key", *report.parse_key(F.col("key")))


@query(f"with {HISTORY} select step, printf('%.1f%%', round(f1 * 100, 1)) as shown from history")
def ablation_format(spark, d):
    return history(spark, d).select("step", report.percent(F.col("f1")).alias("shown"))


@query("with " + HISTORY + " select step, metric, value from (select step, 'f1' as metric, f1 as value from history union all select step, 'n', n::double from history)")
def unpivot_metrics(spark, d):
    return report.unpivot_metrics(history(spark, d).withColumn("n", F.col("n").cast("double")), "step", ["f1", "n"])


_SWEEPS = [(a, k) for a in (0.1, 0.5, 1.0, 100.0) for k in (2, 4, 6)]


@query(" union all ".join(f"select * from (with {sql.dealt(a, k)} select {a!r}::double as alpha, {k} as clients, client, count(*) as total, count(distinct label) as classes from dealt group by client)" for a, k in _SWEEPS))
def ablation_grid(spark, d):
    rows = split.deal_by_cuts(samples(spark, d).select("id", "label"), CLASSES, _SWEEPS)
    return rows.groupBy("alpha", "clients", "client").agg(F.count(F.lit(1)).alias("total"), F.countDistinct("label").alias("classes"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """One federated round on four non-IID clients, and the confusion matrix on rows that no client has."""
    sides = split.split_by_cuts(three(spark, d), [("train", 0.9)], "test", "server")
    w = federated.federated_rounds(split.dirichlet_partition(sides.filter("split = 'train'"), CLASSES), MODEL_CLASSES, WIDTH, 1)
    return metrics.confusion(model.score(sides.filter("split = 'test'"), w), MODEL_CLASSES)


