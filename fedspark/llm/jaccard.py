"""Exact join of documents by the Jaccard similarity of their word n-grams, by signature trees.

The tree's upper levels are spread over Spark: the OR of all documents' shingles lies in ranges of hashes, with the sizes of
the documents that have each, and a document is held against it. Its lower levels stand in tasks: nodes with OR-combined
bitmaps and ranges of sizes, traversed in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, mix64, ragged, split_words, spread, table, text_slices, with_columns, written
from .components import connected_components, spanning_stars

WORDS, PERCENT = 4, 85
#: Shingles that one task sorts at once, and those of the documents that one task's trees hold.
SORTED, HELD = 3_000_000, 500_000
#: Documents of a family beyond HELD that are compared with all others of it first.
PIVOTS = 16
BITS, LEAF, FANOUT = 2048, 16, 8

U64 = np.uint64
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], U64)


def shingle_sets(texts: pa.Array, width: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles of lower-cased words; of a shorter text, of all its words."""
    words, counts = split_words(pc.ascii_lower(texts))
    if not len(words):
        yield from (np.empty(0, U64) for _ in range(len(texts)))
        return
    coded = words.dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), U64, len(coded.dictionary))
    h = hashes[coded.indices.to_numpy(zero_copy_only=False)]
    m = len(h) - width + 1
    rolled = mix64(sum((h[j : m + j] * ODD[j % 8] for j in range(1, width)), h[:m] * ODD[0])) if m > 0 else np.empty(0, U64)
    at = 0
    for n in counts.tolist():
        if n >= width:
            yield np.unique(rolled[at : at + n - width + 1])
        elif n:
            yield mix64(np.array([(h[at : at + n] * ODD[np.arange(n) % 8]).sum() + U64(n)], U64))
        else:
            yield np.empty(0, U64)
        at += n


def node_of(shingles: np.ndarray) -> int:
    """A set's 64-bit name; documents with one set are one node of the trees."""
    total = int(shingles.sum()) * int(ODD[1]) + int(np.bitwise_xor.reduce(mix64(shingles + ODD[6]))) + len(shingles) * int(ODD[3])
    return int(mix64(np.array([total % (1 << 64)], U64))[0].astype(np.int64))


def _name_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                found = [(len(s), node_of(s) if len(s) else None) for s in shingle_sets(part.column("text"), width)]
                n, node = zip(*found)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, pa.int64())], names=["doc_id", "n", "node"])

    return run


def _slim(x: np.ndarray) -> bytes:
    """The numbers in as few bytes each as the largest needs."""
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def _unslim(group: pa.Table, name: str) -> np.ndarray:
    """The numbers of all rows, each row's as many as its nodes."""
    rows = zip(group.column(name).to_pylist(), group.column("nodes").to_pylist())
    return np.concatenate([np.frombuffer(x, f"u{8 * len(x) // len(nodes)}").astype(np.int64) for x, nodes in rows])


DEALT = "range long, nodes binary, sizes binary, runs binary, low binary, high binary"


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return (((h >> U64(32)) * U64(ranges)) >> U64(32)).astype(np.int64)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal neighbours."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    return starts, np.diff(np.append(starts, len(key)))


def _deal(width: int, ranges: int):
    """Shingles by ranges of their hashes, each with its set; of equal sets that a task holds at once, one is dealt."""

    def chunk(sets: list, nodes: list) -> pa.RecordBatch:
        lengths = np.array([len(s) for s in sets])
        flat, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths)
        to = _range_of(flat, ranges)
        order = np.argsort(to.astype(np.uint16) if ranges < 65536 else to, kind="stable")
        flat, own, to = flat[order], own[order], to[order]
        starts, runs = _runs(to * len(sets) + own)
        node, size = np.array(nodes, np.int64)[own[starts]], lengths[own[starts]]
        low, high = flat.astype(np.uint32), (flat >> U64(32)).astype(np.uint8)
        first, many = _runs(to[starts])
        rows = []
        for a, n in zip(first.tolist(), many.tolist()):
            x, y = starts[a], starts[a + n] if a + n < len(starts) else len(flat)
            rows.append((int(to[x]), node[a : a + n].tobytes(), _slim(size[a : a + n]), _slim(runs[a : a + n]), low[x:y].tobytes(), high[x:y].tobytes()))
        k, *blobs = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), *(pa.array(b, pa.binary()) for b in blobs)], names=[x.split()[0] for x in DEALT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, nodes, held = [], {}, 0
        for batch in batches:
            for part in text_slices(batch):
                for s in shingle_sets(part.column("text"), width):
                    if len(s) and (node := node_of(s)) not in nodes:
                        nodes[node] = None
                        sets.append(s)
                        held += len(s)
                    if held >= SORTED:
                        yield chunk(sets, list(nodes))
                        sets, nodes, held = [], {}, 0
        if held:
            yield chunk(sets, list(nodes))

    return run


def _blobs(group: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(group.column(name).to_pylist()), kind)


SHARED = "bin long, range long, nodes binary, sizes binary, runs binary, ids binary, common binary"


def _hold_against(percent: int, bins: int):
    """A range of the OR of all sets: the shingles that a set shares with others of sizes it may link to, each with a number
    and with how many sets have it, dealt by sets."""

    def run(group: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in SHARED.split(", ")]
        at = group.column("range")[0].as_py()
        low = _blobs(group, "low", np.uint32)
        both = (_blobs(group, "high", np.uint8).astype(U64) << U64(32)) | low
        runs = _unslim(group, "runs")
        node, size = np.repeat(_blobs(group, "nodes", np.int64), runs), np.repeat(_unslim(group, "sizes").astype(np.int32), runs)
        order = np.argsort(both)
        both = both[order]
        twice = both[1:] == both[:-1]
        some = np.flatnonzero(np.concatenate((twice, [False])) | np.concatenate(([False], twice))) if len(both) else order
        both, node, size = both[some], node[order[some]], size[order[some]].astype(np.int64)
        order = np.lexsort((node, size, both))
        both, node, size = both[order], node[order], size[order]
        new = np.concatenate(([True], (both[1:] != both[:-1]) | (node[1:] != node[:-1]))) if len(both) else np.empty(0, bool)
        both, node, size = both[new], node[new], size[new]
        starts, many = _runs(both)
        number, common = np.repeat(np.arange(len(starts)), many), np.repeat(np.minimum(many, 255), many).astype(np.uint8)
        near = (number[1:] == number[:-1]) & (100 * size[:-1] >= percent * size[1:])
        shared = np.flatnonzero(np.concatenate((near, [False])) | np.concatenate(([False], near))) if len(both) else np.empty(0, np.int64)
        number, node, size, common = number[shared], node[shared], size[shared], common[shared]
        to = (node.astype(U64) % U64(bins)).astype(np.int64)
        order = np.lexsort((number, node, to))
        number, node, size, common, to = number[order].astype(np.uint32), node[order], size[order], common[order], to[order]
        starts, runs = _runs(node)
        first, many = _runs(to[starts])
        rows = []
        for a, n in zip(first.tolist(), many.tolist()):
            x, y = starts[a], starts[a + n] if a + n < len(starts) else len(node)
            own = starts[a : a + n]
            rows.append((int(to[x]), at, node[own].tobytes(), _slim(size[own]), _slim(runs[a : a + n]), number[x:y].tobytes(), common[x:y].tobytes()))
        columns = list(zip(*rows)) if rows else [()] * len(names)
        return pa.table({name: pa.array(c, pa.int64() if name in ("bin", "range") else pa.binary()) for name, c in zip(names, columns)})

    return run


def packed(ids: np.ndarray) -> bytes:
    return (ids.astype(np.uint32) if not len(ids) or int(ids.max()) < 1 << 32 else ids.astype(U64)).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint32 if len(data) == 4 * n else U64).astype(U64)


def _survivors(percent: int, ranges: int):
    """Sets that share enough shingles with all others together to link to any; with the shared ones, the rarest first."""

    def run(group: pa.Table) -> pa.Table:
        per_row = [len(x) // 4 for x in group.column("ids").to_pylist()]
        runs = _unslim(group, "runs")
        node, size = np.repeat(_blobs(group, "nodes", np.int64), runs), np.repeat(_unslim(group, "sizes"), runs)
        ids = _blobs(group, "ids", np.uint32).astype(U64) * U64(ranges) + np.repeat(group.column("range").to_numpy().astype(U64), per_row)
        order = np.lexsort((ids, _blobs(group, "common", np.uint8), node))
        node, size, ids = node[order], size[order], ids[order]
        starts, many = _runs(node)
        alive = np.flatnonzero(100 * many >= percent * size[starts])
        out = [(int(node[a]), int(size[a]), int(n), packed(ids[a : a + n])) for a, n in zip(starts[alive].tolist(), many[alive].tolist())]
        node, size, n, ids = zip(*out) if out else ((), (), (), ())
        return pa.table({"node": pa.array(node, pa.int64()), "n": pa.array(size, pa.int64()), "shared": pa.array(n, pa.int64()), "ids": pa.array(ids, pa.binary())})

    return run


def _deal_rarest(percent: int, ranges: int):
    """Of each surviving set, so many of its rarest shared shingles that two linked sets have one of them in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for size, shared, ids in zip(batch.column("n").to_pylist(), batch.column("shared").to_pylist(), batch.column("ids").to_pylist()):
                kept.append(unpacked(ids, shared)[: shared - -(-percent * size // 100) + 1])
            if not kept:
                continue
            lengths = [len(x) for x in kept]
            ids, node, size = np.concatenate(kept), np.repeat(batch.column("node").to_numpy(), lengths), np.repeat(batch.column("n").to_numpy(), lengths)
            to = (mix64(ids) % U64(ranges)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            ids, node, size, to = ids[order], node[order], size[order], to[order]
            starts, many = _runs(to)
            blobs = [(int(to[a]), ids[a : a + m].tobytes(), node[a : a + m].tobytes(), size[a : a + m].tobytes()) for a, m in zip(starts.tolist(), many.tolist())]
            k, *rest = zip(*blobs)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), *(pa.array(b, pa.binary()) for b in rest)], names=["range", "ids", "nodes", "sizes"])

    return run


def _meet(percent: int):
    """Ties of sets that have a rare shingle in common, from one to the next by size; as stars of what hangs together here."""

    def run(group: pa.Table) -> pa.Table:
        ids, node, size = _blobs(group, "ids", U64), _blobs(group, "nodes", np.int64), _blobs(group, "sizes", np.int64)
        order = np.lexsort((node, size, ids))
        ids, node, size = ids[order], node[order], size[order]
        near = np.flatnonzero((ids[1:] == ids[:-1]) & (node[1:] != node[:-1]) & (100 * size[:-1] >= percent * size[1:]))
        a, b = spanning_stars(node[near], node[near + 1])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


class _Groups:
    """Union-find."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j

    def roots(self, items: np.ndarray) -> np.ndarray:
        found = self.up[items]
        while not np.array_equal(found, self.up[found]):
            found = self.up[found]
        return found


class SignatureTree:
    """Leaves of documents of like size. A node holds, for each bit of the hashed shingles, the most shingles that one of
    its documents has there (the OR of the documents' bitmaps, with counts), and the range of their sizes."""

    def __init__(self, members: np.ndarray, counts: np.ndarray, sizes: np.ndarray):
        level = [members[k : k + LEAF] for k in range(0, len(members), LEAF)]
        level = [(docs, (), counts[docs].max(0), sizes[docs].min(), sizes[docs].max()) for docs in level]
        while len(level) > 1:
            parts = [level[k : k + FANOUT] for k in range(0, len(level), FANOUT)]
            level = [(np.concatenate([x[0] for x in p]), tuple(p), np.max([x[2] for x in p], 0), min(x[3] for x in p), max(x[4] for x in p)) for p in parts]
        self.root = level[0]


def may_link(x: tuple, y: tuple, percent: int) -> bool:
    """Whether the largest overlap that two nodes' bitmaps and sizes allow reaches what their smallest documents need."""
    if x[4] * 100 < y[3] * percent or y[4] * 100 < x[3] * percent:
        return False
    overlap = min(int(np.minimum(x[2], y[2]).sum(dtype=np.int64)), int(x[4]), int(y[4]))
    return overlap * (100 + percent) >= percent * int(x[3] + y[3])


def tree_links(sets: list[np.ndarray], sizes: np.ndarray, sides: np.ndarray | None = None, percent: int = PERCENT, every: bool = False) -> list[tuple[int, int]]:
    """Links that connect what all links among sets connect; with sides, of links between side 0 and side 1.

    sizes: of the whole sets; what is given of them holds all that two of them can have in common. Dual traversal of the
    tree with itself, or of the two sides' trees. Pairs that are connected already are passed over, unless every link is
    asked for.
    """
    n = len(sets)
    if n < 2 or sides is not None and len(np.unique(sides)) < 2:
        return []
    sizes, given = np.asarray(sizes, np.int64), np.array([len(s) for s in sets])
    ends = np.cumsum(given)
    flat = np.concatenate(sets)
    values, ids = np.unique(flat, return_inverse=True)
    bits = 1 << min(int(BITS).bit_length() - 1, max(6, int(4 * given.mean()).bit_length()))
    counts = np.zeros((n, bits), np.uint8 if given.max() < 256 else np.uint16 if given.max() < 65536 else np.uint32)
    np.add.at(counts, (np.repeat(np.arange(n), given), (mix64(flat) % U64(bits)).astype(np.int64)), 1)
    groups, out, mark = _Groups(n), [], np.zeros(len(values), bool)

    def compare(i: int, others: np.ndarray) -> None:
        ok = (np.minimum(sizes[others], sizes[i]) * 100 >= np.maximum(sizes[others], sizes[i]) * percent) & (every | (groups.roots(others) != groups.root(i)))
        others = others[ok]
        if len(others):
            bound = np.minimum(counts[others], counts[i]).sum(1, dtype=np.int64)
            others = others[bound * (100 + percent) >= percent * (sizes[others] + sizes[i])]
        if not len(others):
            return
        own = ids[ends[i] - given[i] : ends[i]]
        mark[own] = True
        hits = mark[ids[ragged(ends[others] - given[others], given[others])]]
        both = np.add.reduceat(hits, np.cumsum(given[others]) - given[others], dtype=np.int64)
        mark[own] = False
        for j in others[100 * both >= percent * (sizes[others] + sizes[i] - both)].tolist():
            if groups.join(i, j) or every:
                out.append((i, j))

    # documents of widely shared shingles first: in a group of near copies these link most others, which then need no more
    common = np.bincount(ids)[ids]
    typical = np.add.reduceat(common, ends - given) / sizes
    everyone = np.lexsort((values[ids[ends - given]], (np.log(sizes) * 12).astype(np.int64)))
    for i in () if every else np.argsort(-typical, kind="stable")[:LEAF].tolist():
        compare(i, everyone if sides is None else everyone[sides[everyone] != sides[i]])
    if sides is None:
        a = b = SignatureTree(everyone, counts, sizes).root
    else:
        a, b = (SignatureTree(everyone[sides[everyone] == k], counts, sizes).root for k in (0, 1))
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        if not may_link(x, y, percent):
            continue
        if not every:
            roots = groups.roots(np.concatenate((x[0], y[0])))
            if (roots == roots[0]).all():
                continue
        if not x[1] and not y[1]:
            for i in x[0].tolist():
                compare(i, y[0][y[0] != i])
        elif x is y:
            stack += [(p, q) for k, p in enumerate(x[1]) for q in x[1][k:]]
        elif x[1] and (len(x[0]) >= len(y[0]) or not y[1]):
            stack += [(p, y) for p in x[1]]
        else:
            stack += [(x, q) for q in y[1]]
    return sorted({(min(p), max(p)) for p in out}) if every else out


LINKS = "a long, b long, open boolean"
#: Sides of a group of documents: all of one, or two that are compared with each other; a pivot is of its block as well.
ONE, OTHER, PIVOT = 0, 1, 2


def _trees(percent: int, every: bool = False):
    """Links (a, b) of each group (family, x, y); and, where it has pivots, the sets that nothing here connects with the
    first of them, as open (a: set, b: family)."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("family", "ascending"), ("x", "ascending"), ("y", "ascending"), ("node", "ascending"), ("side", "ascending")])
        family, x, y, side, node, n, shared = (group.column(c).to_numpy() for c in ("family", "x", "y", "side", "node", "n", "shared"))
        new = np.flatnonzero(np.concatenate(([True], (family[1:] != family[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
        links, left = [], []
        for lo, hi in zip(new, np.append(new[1:], len(family))):
            pivots = node[lo:hi][side[lo:hi] == PIVOT]
            at = np.unique(node[lo:hi], return_index=True)[1] if len(pivots) else np.arange(hi - lo)
            names = node[lo:hi][at]
            sets = [unpacked(data, int(s)) for data, s in zip(group.column("ids").slice(lo, hi - lo).take(pa.array(at)).to_pylist(), shared[lo:hi][at])]
            sides = side[lo:hi][at] if (side[lo:hi] == OTHER).any() else None
            found = tree_links(sets, n[lo:hi][at], sides, percent, every)
            links += [(names[i], names[j]) for i, j in found if names[i] != names[j]]
            if len(pivots):
                groups = _Groups(len(names))
                for i, j in found:
                    groups.join(i, j)
                main = groups.root(int(np.searchsorted(names, pivots.min())))
                left += [(names[k], family[lo]) for k in np.flatnonzero(groups.roots(np.arange(len(names))) != main)]
        both = np.array(links + left, np.int64).reshape(-1, 2)
        return pa.table({"a": both[:, 0], "b": both[:, 1], "open": pa.array(np.arange(len(both)) >= len(links))})

    return run


def _grow(rows: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """The trees of rows (family, x, y, side, node, n, shared, ids), whose groups are dealt to tasks of about HELD shingles."""
    work = rows.agg(F.coalesce(F.sum("shared"), F.lit(0))).first()[0]
    bins = F.lit(spread(rows.sparkSession, work, HELD))
    return rows.withColumn("bin", F.pmod(F.xxhash64("family", "x", "y"), bins)).groupBy("bin").applyInArrow(_trees(percent, every), LINKS)


def _links(survivors: DataFrame, percent: int, every: bool) -> DataFrame:
    """Links (a, b) among surviving sets (node, n, shared, ids).

    Sets that have a rare shingle in common hang together in families, each of which goes through a tree. A family beyond
    HELD shingles is cut into blocks: every block meets the family's pivots, and the sets that this leaves unconnected to
    the first pivot then meet all blocks. What is connected to it needs no more, so a family of near copies is read twice,
    however large it is.
    """
    ranges = spread(survivors.sparkSession, survivors.agg(F.coalesce(F.sum("shared"), F.lit(0))).first()[0], SORTED)
    dealt = survivors.select("node", "n", "shared", "ids").mapInArrow(_deal_rarest(percent, ranges), "range long, ids binary, nodes binary, sizes binary")
    ties = written(dealt.groupBy("range").applyInArrow(_meet(percent), "a long, b long").distinct(), "ties")
    families = connected_components(ties).withColumnRenamed("component", "family")
    forget(ties)
    sizes = families.join(survivors.select("node", "shared"), "node").groupBy("family").agg(F.sum("shared").alias("_s"))
    big = written(sizes.filter(F.col("_s") > HELD).select("family", (F.floor(F.col("_s") / HELD) + 1).cast("int").alias("blocks")), "big-families")
    one = F.lit(ONE).alias("side")
    zero = F.lit(0)
    members = families.join(survivors, "node").join(big, "family", "left").select("node", "family", "n", "shared", "ids", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    data = ("node", "n", "shared", "ids")
    if every:
        other = members.select("*", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("_to"))
        pairs = other.select("family", F.least("block", "_to").alias("x"), F.greatest("block", "_to").alias("y"), F.when(F.col("block") > F.col("_to"), OTHER).otherwise(ONE).alias("side"), *data)
        return written(_grow(pairs, percent, True), "links").select("a", "b")
    alone = members.select("family", F.col("block").alias("x"), zero.alias("y"), one, *data)
    if big.isEmpty():
        return written(_grow(alone, percent), "links").select("a", "b")
    cut = members.filter("blocks > 1")
    first = Window.partitionBy("family").orderBy(F.xxhash64(F.lit(1), "node"), "node")
    pivots = families.join(big, "family").withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= PIVOTS).join(survivors, "node")
    pivots = pivots.select("family", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("x"), zero.alias("y"), F.lit(PIVOT).alias("side"), *data)
    found = written(_grow(alone.unionByName(pivots), percent), "links")
    left = written(found.filter("open").select(F.col("a").alias("node"), F.col("b").alias("family")).distinct().join(survivors, "node").join(big, "family"), "open-sets")
    parts = written(left.groupBy("family").agg((F.floor(F.sum("shared") / HELD) + 1).cast("int").alias("parts")), "open-parts")
    left = left.join(parts, "family").withColumn("y", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int"))
    left = left.select("family", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("x"), "y", F.lit(OTHER).alias("side"), *data)
    all_ = cut.join(parts, "family").select("family", F.col("block").alias("x"), F.explode(F.sequence(zero, F.col("parts") - 1)).alias("y"), one, *data)
    more = written(_grow(all_.unionByName(left), percent), "links")
    return found.filter("not open").unionByName(more).select("a", "b")


def near_duplicates(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, every_link: bool = False) -> DataFrame:
    """Components of docs (doc_id, text) under links where 100 * intersection >= percent * union of their shingle sets.

    1. The upper levels: shingles meet by ranges of hashes, which hold the OR of all sets and the sizes of those that have
    each. A set's largest possible overlap with all others of a size that it may link to is the number of its shingles
    that one of those has; where it is too small, the set links to none and goes no further. 2. The surviving sets, with their shared
    shingles, the only ones that two sets can have in common, hang together in families by their rarest ones. 3. Each
    family goes through a signature tree, by dual traversal of nodes with bitmaps and size ranges, and links are exact.

    Returns doc_id, n_shingles (0 without words; fewer than `width` words are one shingle) and component_id, the smallest
    doc_id that links reach, for each row. Every row is a document of its own, also where doc_ids repeat or are null; a null one
    is never a component's id unless all are. Documents without words link to none. An empty table gives an empty one;
    other columns aren't read. Sets and shingles are told apart by 64-bit hashes, shingles from the range of hashes on by 40 bits of it.

    Pairs connected already are passed over. With every_link they aren't, and all links (a, b), a < b, between the smallest
    documents of different sets are returned instead.
    """
    spark = docs.sparkSession
    docs = with_columns(docs, {"doc_id": "long", "text": "string"})
    named = written(docs.mapInArrow(_name_sets(width), "doc_id long, n long, node long"), "named")
    total = named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = spread(spark, total, SORTED)
    dealt = docs.select("doc_id", "text").mapInArrow(_deal(width, ranges), DEALT)
    held = dealt.groupBy("range").applyInArrow(_hold_against(percent, ranges), SHARED)
    survivors = written(held.groupBy("bin").applyInArrow(_survivors(percent, ranges), "node long, n long, shared long, ids binary"), "survivors")
    links = _links(survivors, percent, every_link)
    least = named.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    if every_link:
        ends = [least.select(F.col("node").alias(x), F.col("least").alias(f"_{x}")) for x in "ab"]
        pairs = links.distinct().join(ends[0], "a").join(ends[1], "b")
        return pairs.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
    linked = connected_components(links)
    reached = written(linked.join(least, "node").groupBy("component").agg(F.min("least").alias("component_id")), "reached")
    whole = written(least.join(linked, "node", "left").join(reached, "component", "left").select("node", F.coalesce("component_id", "least").alias("component_id")), "components")
    forget(survivors)
    return named.join(whole, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op4_jaccard(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
