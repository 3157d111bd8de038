"""Vector compression by codes of parts: whole-number codebooks, each part's nearest entry found in a ball tree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Parts of a vector, entries of a part's codebook, rounds of training, and steps of a unit.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries in a leaf of a tree.
LEAF = 8
#: Components are held within this size, so that sums of many rows stay exact.
LARGEST = 1 << 40
#: Rows that one task sums before it sends its sums on.
SUMMED_ROWS = 1 << 22
#: Rows that go through a tree at once, and components that one step holds.
TREE_ROWS, STEP_CELLS = 1 << 13, 1 << 21
#: A float64's error in a distance is far smaller than this share of it.
SLACK = 1e-9


class BallTree:
    """A ball tree over a codebook's entries (rows of whole numbers), which finds each query's nearest entry exactly.

    Balls have float64 centres and radii rounded up; a query visits every ball that may hold an entry as near as its best
    so far, equal ones too, and distances to entries are summed in whole numbers. Ties go to the lower index.
    """

    def __init__(self, entries: np.ndarray, leaf: int = LEAF):
        self.entries, self.leaf = entries, leaf
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.children: list[tuple[int, int] | None] = []
        self.members: list[np.ndarray] = []
        self.largest = int(np.abs(entries).max(initial=0))
        #: Pairs of a query and an entry whose distance was summed.
        self.verified = 0
        if len(entries):
            self._build(np.arange(len(entries)))

    def _build(self, at: np.ndarray) -> int:
        points = self.entries[at].astype(float)
        centre = points.mean(0)
        far = np.sqrt(((points - centre) ** 2).sum(1))
        node = len(self.centres)
        self.centres.append(centre)
        self.radii.append(float(far.max()) * (1 + SLACK) + 1e-6)
        self.members.append(at)
        self.children.append(None)
        if len(at) > self.leaf and far.max() > 0:
            one = points[far.argmax()]
            other = points[((points - one) ** 2).sum(1).argmax()]
            order = np.argsort(points @ (other - one), kind="stable")
            half = len(at) // 2
            self.children[node] = self._build(np.sort(at[order[:half]])), self._build(np.sort(at[order[half:]]))
        return node

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each query's nearest entry."""
        most = 2 * max(self.largest, int(np.abs(queries).max(initial=0)))
        kind = np.int64 if most * most * max(queries.shape[1], 1) * PARTS < 1 << 62 else object
        index, best = np.full(len(queries), len(self.entries), np.int64), np.full(len(queries), 1 << 62 if kind is np.int64 else 1 << 200, kind)
        exact, entries = queries.astype(kind), self.entries.astype(kind)
        place = queries.astype(float)
        rows = np.arange(len(queries))
        self._descend(0, rows, place, exact, entries, index, best)
        self._visit(0, rows, place, exact, entries, index, best)
        return index, best

    def _away(self, node: int, rows: np.ndarray, place: np.ndarray) -> np.ndarray:
        gap = place[rows] - self.centres[node]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    def _descend(self, node: int, rows: np.ndarray, place: np.ndarray, *state) -> None:
        """Every query goes to one leaf, at each ball to the child whose centre is nearer: a first best."""
        if not len(rows):
            return
        if self.children[node] is None:
            self._verify(node, rows, *state)
            return
        left, right = self.children[node]
        near = self._away(left, rows, place) <= self._away(right, rows, place)
        self._descend(left, rows[near], place, *state)
        self._descend(right, rows[~near], place, *state)

    def _visit(self, node: int, rows: np.ndarray, place: np.ndarray, exact, entries, index, best) -> None:
        least = np.maximum(self._away(node, rows, place) * (1 - SLACK) - self.radii[node], 0.0)
        rows = rows[least * least * (1 - SLACK) <= best[rows].astype(float)]
        if not len(rows):
            return
        if self.children[node] is None:
            self._verify(node, rows, exact, entries, index, best)
            return
        for child in self.children[node]:
            self._visit(child, rows, place, exact, entries, index, best)

    def _verify(self, node: int, rows: np.ndarray, exact, entries, index, best) -> None:
        members = self.members[node]
        self.verified += len(rows) * len(members)
        step = max(1, STEP_CELLS // max(1, len(members) * exact.shape[1]))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            gap = exact[some][:, None, :] - entries[members][None]
            away = (gap * gap).sum(2) if exact.shape[1] else np.zeros(gap.shape[:2], exact.dtype)
            first = away.argmin(1)  # members stand by index, so the first of equals is the lowest
            found, which = away[np.arange(len(some)), first], members[first]
            better = (found < best[some]) | ((found == best[some]) & (which < index[some]))
            index[some[better]], best[some[better]] = which[better], found[better]


def whole(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector has components and none that is null or not finite, with them as whole numbers in `parts`."""
    values = F.col(column).cast("array<double>")
    fine = F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    held = lambda x: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), x * float(SCALE))))
    return vectors.filter(F.coalesce(fine, F.lit(False))).withColumn("parts", F.transform(values, held))


def _cut(column: pa.Array, width: int) -> np.ndarray:
    """(rows, PARTS, width) of a column of equally long arrays; what lacks at the end is 0."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)
    out = np.zeros((len(column), PARTS * width), np.int64)
    out[:, : flat.shape[1]] = flat
    return out.reshape(len(column), PARTS, width)


def _assigned(batch: pa.RecordBatch, trees: list[BallTree], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows with their parts, indexes (rows, PARTS) and squared distances."""
    for at in range(0, len(batch), TREE_ROWS):
        some = batch.slice(at, TREE_ROWS)
        parts = _cut(some.column("parts"), width)
        found = [tree.nearest(parts[:, p]) for p, tree in enumerate(trees)]
        yield some, parts, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def first_codebooks(rows: DataFrame, entries: int = ENTRIES) -> tuple[int, np.ndarray | None]:
    """The first vector's length and (PARTS, entries, width), the parts of the rows with the smallest vec_ids that are as
    long; at most `entries` rows come to the driver."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(entries).select("parts").collect()
    if not first:
        return 0, None
    n = len(first[0]["parts"])
    width = -(-n // PARTS)
    same = [r["parts"] for r in first if len(r["parts"]) == n]
    out = np.zeros((len(same), PARTS * width), np.int64)
    out[:, :n] = same
    return n, out.reshape(len(same), PARTS, width).transpose(1, 0, 2)


def train_round(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round: each used entry becomes its parts' mean, rounded down. Tasks send a row of sums for each
    entry that they use; the driver gets PARTS * entries sums, whatever the table's size."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, sums, counts, seen = [BallTree(b) for b in books], np.zeros_like(books), np.zeros(books.shape[:2], np.int64), 0

        def flush() -> pa.RecordBatch:
            part, entry = np.nonzero(counts)
            flat = pa.array(sums[part, entry].ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * width), flat)
            out = pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), lists], names=["part", "entry", "n", "sums"])
            sums[:], counts[:] = 0, 0
            return out

        for batch in batches:
            for some, parts, index, _ in _assigned(batch, trees, width):
                for p in range(PARTS):
                    np.add.at(sums[p], index[:, p], parts[:, p])
                    counts[p] += np.bincount(index[:, p], minlength=counts.shape[1])
                seen += len(some)
                if seen >= SUMMED_ROWS:
                    yield flush()
                    seen = 0
        if seen:
            yield flush()

    sent = rows.select("parts").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    total = sent.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)))
    out = books.copy()
    for r in total.collect():
        out[r["part"], r["entry"]] = [int(r[f"s{j}"]) // r["n"] for j in range(width)]
    return out


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error (squared distances, summed over parts; 2^63 - 1 at most)."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [BallTree(b) for b in books]
        for batch in batches:
            for some, _, index, away in _assigned(batch, trees, width):
                code = [row.tobytes().hex() for row in index.astype(np.uint8)]
                error = np.minimum(away.sum(1), (1 << 63) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("label"), pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "parts").mapInArrow(run, "vec_id long, label int, code string, error long")


def compress(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors (vec_id, embedding, label) and the final codebooks (PARTS, entries, width).

    Each round is one scan whose tasks send sums; vectors are never shuffled. Rows whose vector is null, empty, or holds
    null or non-finite components are dropped, and so are vectors of another length than that of the smallest vec_id;
    a length that PARTS doesn't divide is filled up with zeros. Components beyond 2^40 steps count as that. Rows
    with equal or null vec_ids are coded each; null ids are the largest. An empty table gives none and empty codebooks.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a part's code has two hex digits: 1 to 256 entries")
    rows = whole(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("int").alias("label"))).select("vec_id", "label", "parts")
    length, books = first_codebooks(rows, entries)
    if books is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, label int, code string, error long"), np.zeros((PARTS, 0, 0), np.int64)
    rows = rows.filter(F.size("parts") == length)
    if books.shape[1] < entries:  # of vectors of that length alone
        _, books = first_codebooks(rows, entries)
    for _ in range(rounds):
        books = train_round(rows, books)
    return encode(rows, books), books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code, its error, its label's error, and the codebooks' digest. Edge cases are those of compress();
    sums over a label stop at 2^63 - 1, and rows without a label form one."""
    vectors = table(spark, sf_dir, "embeddings")
    coded, books = compress(vectors)
    coded = written(coded, "codes")
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    labels = written(coded.groupBy(F.col("label").alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error")), "label-errors")
    return coded.join(labels, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _rounds_sql() -> str:
    """Rounds of assignment and floored means, in whole numbers, without a tree."""
    sql = f"""kept as materialized (select row_number() over (order by vec_id) as r, vec_id, label, list_transform(embedding, lambda x: cast(floor({SCALE} * x::double) as bigint)) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select vec_id, r, label, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] as v from kept, range({PARTS}) t(p)),
b0 as materialized (select p, r - 1 as k, v as e from parts where r <= {ENTRIES})"""
    for n in range(ROUNDS + 1):
        sql += f""",
d{n} as materialized (select vec_id, p, k, list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - e[i]) * (v[i] - e[i])))::bigint as d from parts join b{n} using (p)),
a{n} as materialized (select vec_id, p, min(d) as d, arg_min(k, d * 256 + k) as k from d{n} group by vec_id, p)"""
        if n < ROUNDS:
            sql += f""",
m{n} as materialized (select p, k, i, ((sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*))::bigint as x from a{n} join parts using (vec_id, p), range(1, len(v) + 1) t(i) group by p, k, i),
b{n + 1} as materialized (select b.p, b.k, coalesce(u.e, b.e) as e from b{n} b left join (select p, k, list(x order by i) as e from m{n} group by p, k) u on u.p = b.p and u.k = b.k)"""
    return sql


OP12_SQL = f"""with {_rounds_sql()},
coded as (select vec_id, string_agg(lower(printf('%02x', k)), '' order by p) as code, sum(d)::bigint as error from a{ROUNDS} group by vec_id),
book as (select sha256(string_agg(array_to_string(e, ','), ',' order by p, k)) as h from b{ROUNDS})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, h as codebooks_sha256 from coded join kept using (vec_id), book"""
