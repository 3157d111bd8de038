"""Language-model scores: a causal self-attention model over subword ids, trained in numpy, beside a word-count base."""

from __future__ import annotations

import base64
import ctypes
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, ragged, rows_at_once, spread, split_words, table, text_slices, with_columns, written

#: Queries of a window; its keys are they and as many before. So windows overlap by half, and each token is scored once.
STRIDE = 32
WIDTH = 32
#: Windows scored at once, and those of them whose attention is.
SCORED_WINDOWS, ATTENDED = 512, 64
#: Unless all are asked for, one of every TRAIN_EVERY windows of the training documents' texts trains the model, so that training
#: grows with the table, and more in a small table. In small tables windows train again, in up to MOST_PASSES passes, until
#: LEAST_WINDOWS have.
TRAIN_EVERY, LEAST_WINDOWS, MOST_PASSES = 8, 40_000, 12
#: The training windows are dealt to ROUNDS; a round's trainers start from the mean of the round before and see each of
#: their windows once, in batches of FIT_BATCH. A trainer holds about FIT_WINDOWS windows of all rounds. Windows stay in groups of
#: GROUPED that follow one another and share keys; about MIXED are gathered, and their groups are shuffled.
ROUNDS, FIT_WINDOWS, FIT_BATCH, FIT_RATE = 4, 100_000, 128, 1.6e-2
GROUPED, MIXED = 8, 8192
#: Numbers that one task averages at once.
AVERAGED = 16_000_000
#: Text bytes whose words are counted at once, and whose ids make one row.
WORD_SLICE, ID_SLICE = 2 << 20, 128 << 10
#: Text bytes whose different words are encoded once.
WORDS_SLICE = 16 << 20
#: Rows of ids that a task takes from Spark at once.
ROWS_AT_ONCE = 64
#: (block, word) counts that one task adds up at once.
COUNTED = 2_000_000


def _bytes(x: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


DEALT = "range long, block long, hashes binary, train binary, doc_ids binary, nulls binary, keys binary, tokens binary, held binary, postings binary, docs binary, repeats binary"


def _deal_words(ranges: int):
    """Each block of texts as one row (range -1) of its documents and of the documents that have each of its words, in the
    order of their hashes; and its words, cut into ranges of hashes, with their counts in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DEALT.split(", ")]
        task, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in text_slices(batch, most=WORD_SLICE):
                block, nth = (nth << 32) | task, nth + 1  # the same when the task is repeated
                held = np.array([held_out(d) for d in part.column("doc_id").to_pylist()])
                words, counts = split_words(pc.ascii_lower(part.column("text")))
                coded = words.dictionary_encode()
                hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
                order = np.argsort(hashes)
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                hashes = hashes[order]
                codes = place[coded.indices.to_numpy(zero_copy_only=False)]
                doc = np.repeat(np.arange(len(part)), counts)
                train = np.bincount(codes[~held[doc]], minlength=len(hashes)).astype(np.uint32)
                key, repeats = np.unique(codes * len(part) + doc, return_counts=True)
                cuts = np.searchsorted(((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32), np.arange(ranges + 1))
                ids = part.column("doc_id")
                rows = [(-1, block, b"", b"", _bytes(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), np.int64), _bytes(ids.is_null().to_numpy(zero_copy_only=False), np.uint8), part.column("key").to_numpy().tobytes(), _bytes(counts + 1, np.int64), _bytes(held, np.uint8), _bytes(np.bincount(key // len(part), minlength=len(hashes)), np.uint32), _bytes(key % len(part), np.uint32), _bytes(repeats, np.uint32))]
                rows += [(k, block, hashes[a:b].tobytes(), train[a:b].tobytes(), *[b""] * 8) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
                k, blocks, *blobs = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(blocks, pa.int64()), *(pa.array(x, pa.binary()) for x in blobs)], names=names)

    return run


COUNTS = "block long, range long, words long, totals binary"


def _count_words(group: pa.Table) -> pa.Table:
    """A range's words, counted over all training documents: what each block sent of it comes back as these counts. A row of
    block -1 has the number of words that were counted. A word is one number a block here, however many documents have it."""
    rows = group.to_pylist()
    words, at = np.unique(np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows]), return_inverse=True)
    total = np.zeros(len(words), np.int64)
    np.add.at(total, at, np.concatenate([np.frombuffer(r["train"], np.uint32) for r in rows]))
    ends = np.cumsum([len(r["hashes"]) // 8 for r in rows])
    totals = [x.tobytes() for x in np.split(total[at], ends[:-1])]
    number = pa.array([rows[0]["range"]] * (len(rows) + 1), pa.int64())
    return pa.table({"block": pa.array([-1, *(r["block"] for r in rows)], pa.int64()), "range": number, "words": pa.array([int((total > 0).sum()), *[0] * len(rows)], pa.int64()), "totals": pa.array([b"", *totals], pa.binary())})


BASES = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double"


def _add_words(own: pa.Table, counts: pa.Table) -> pa.Table:
    """A block's documents with their sums of log10(c + 0.5) and their known tokens, by its words' counts of all ranges."""
    (own,) = own.to_pylist()
    totals = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(r["totals"], np.int64) for r in sorted(counts.to_pylist(), key=lambda r: r["range"]))])
    postings, docs, repeats = (np.frombuffer(own[k], np.uint32) for k in ("postings", "docs", "repeats"))
    if len(totals) != len(postings):
        raise ValueError("a block's words have not all been counted")
    keys = np.frombuffer(own["keys"], np.int64)
    sums = np.bincount(docs, np.repeat(np.log10(totals + 0.5), postings) * repeats, len(keys))
    known = np.bincount(docs, np.repeat(totals > 0, postings) * repeats, len(keys))
    null = np.frombuffer(own["nulls"], np.uint8).astype(bool)
    return pa.table({
        "key": keys, "doc_id": pa.array(np.frombuffer(own["doc_ids"], np.int64), mask=null), "held_out": pa.array(np.frombuffer(own["held"], np.uint8).astype(bool)),
        "n_tokens": np.frombuffer(own["tokens"], np.int64), "n_known": known.astype(np.int64), "base": sums.astype(float),
    })


IDS = "block long, keys binary, held binary, ids binary, id_ends binary"


def _write_ids(ranks_file: str, pattern: str):
    """A row for each slice of texts, with the subword ids of the lower-cased (A to Z) documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        if len(ranks) != END:
            raise ValueError(f"the vocabulary has {len(ranks)} ids, and its end was to be {END}")
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        sizes = np.zeros(END, np.int64)
        sizes[list(ranks.values())] = list(map(len, ranks))
        apart = words_apart(pattern)
        for batch in batches:
            for part, ids, ends in _ids_of_slices(encoding, sizes, apart, batch):
                held = np.array([held_out(d) for d in part.column("doc_id").to_pylist()])
                blobs = (part.column("key").to_numpy().tobytes(), _bytes(held, np.uint8), _bytes(ids, np.uint16), _bytes(ends, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([zlib.crc32(blobs[2])], pa.int64()), *(pa.array([x], pa.binary()) for x in blobs)], names=[x.split()[0] for x in IDS.split(", ")])

    return run


#: Whitespace, in brackets of a regular expression.
WHITE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def words_apart(pattern: str) -> bool:
    """Whether a pattern is known never to go on over a space after another character than whitespace, so that it may start anew there."""
    return pattern == r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ids_of_texts(encoding, sizes: np.ndarray, apart: bool, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts, one after another, and each one's end in them. sizes: bytes of each id's token.

    If words may stand apart, texts are cut before each space, and each different word is encoded once. A text with
    whitespace before a space, or at its end, is encoded as a whole.
    """
    if not apart:
        found = [encoding.encode_to_numpy(text, disallowed_special=()) for text in texts.to_pylist()]
        return np.concatenate(found), np.cumsum([len(x) for x in found])
    cut = pc.invert(pc.match_substring_regex(texts, f"[{WHITE}]( |$)"))
    parts = pc.split_pattern(pc.if_else(cut, texts, ""), " ")
    starts, words = parts.offsets.to_numpy()[:-1], parts.flatten()
    begins = np.zeros(len(words), bool)
    begins[starts] = True  # without a space before
    coded = words.filter(pa.array(~begins)).dictionary_encode()
    known = len(coded.dictionary)
    joined = pc.binary_join(pa.ListArray.from_arrays([0, known], coded.dictionary), " ")[0].as_py()
    pool = [encoding.encode_to_numpy(f" {joined}", disallowed_special=())] if known else []
    lengths = np.diff(np.searchsorted(np.cumsum(sizes[pool[0]]), np.cumsum(pc.binary_length(coded.dictionary).to_numpy() + 1)) + 1, prepend=0) if known else np.empty(0, np.int64)
    pool += [encoding.encode_to_numpy(text, disallowed_special=()) for text in pc.if_else(cut, words.take(pa.array(starts)), texts).to_pylist()]
    lengths = np.concatenate((lengths, [len(x) for x in pool[bool(known) :]])).astype(np.int64)
    at = np.empty(len(words), np.int64)
    at[begins] = known + np.arange(len(texts))
    at[~begins] = coded.indices.to_numpy()
    own = lengths[at]
    return np.concatenate(pool)[ragged((np.cumsum(lengths) - lengths)[at], own)], np.cumsum(own)[np.append(starts[1:], len(words)) - 1]


def _ids_of_slices(encoding, sizes: np.ndarray, apart: bool, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of texts with their ids; larger slices share their words."""
    for large in text_slices(batch, most=WORDS_SLICE):
        ids, ends = ids_of_texts(encoding, sizes, apart, pc.ascii_lower(large.column("text")))
        first = begin = 0
        for part in text_slices(large, most=ID_SLICE):
            own = ends[first : first + len(part)]
            yield part, ids[begin : own[-1]], own - begin
            first, begin = first + len(part), int(own[-1])


def _ids_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row's ids, each document's end in them, and whether it is held out."""
    return np.frombuffer(row["ids"], np.uint16), np.frombuffer(row["id_ends"], np.int64), np.frombuffer(row["held"], np.uint8).astype(bool)


#: The id after the vocabulary's last one, which it leaves free, begins and ends a text.
BEGIN = END = 50_256


def runs_of(id_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The document of each run of STRIDE inputs, and the run's number in it. A document's inputs are BEGIN and its ids."""
    runs = -(-(np.diff(np.concatenate(([0], id_ends))) + 1) // STRIDE)
    return np.repeat(np.arange(len(runs)), runs), np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)


def lay_out(ids: np.ndarray, id_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inputs of all runs and their targets; -1 outside the document."""
    sizes = np.diff(np.concatenate(([0], id_ends))) + 1
    runs = -(-sizes // STRIDE)
    at = ragged((np.cumsum(runs) - runs) * STRIDE, sizes)
    inputs, targets = np.full((2, int(runs.sum()) * STRIDE), -1)
    targets[at] = stream = np.insert(ids.astype(np.int64), id_ends, END)
    inputs[at] = np.concatenate(([BEGIN], stream[:-1]))  # what ends a document begins the next
    return inputs.reshape(-1, STRIDE), targets.reshape(-1, STRIDE)


@dataclass
class AttentionModel:
    """One layer of causal self-attention; a softmax over classes, one over a class's members, and an id's share of its place."""

    embedding: np.ndarray
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    residual: np.ndarray
    place_query: np.ndarray
    place_key: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    place_of: np.ndarray
    class_of: np.ndarray
    member_of: np.ndarray
    log_share: np.ndarray

    WEIGHTS = ("embedding", "query", "key", "value", "residual", "place_query", "place_key", "hidden_bias", "out", "out_bias", "inner", "inner_bias")

    @staticmethod
    def begin(counts: np.ndarray, width: int = WIDTH, seed: int = 3) -> AttentionModel:
        """Biases begin at the shares of counts and a half. Ids of like frequency share a class.

        Each id that training documents have gets a place of its own; the others, which nothing there tells apart, share
        one. A token costs two short softmaxes, over classes and over its class's members; classes of frequent ids are small.
        """
        rng = np.random.default_rng(seed)
        seen = np.flatnonzero(counts)
        places = len(seen) + 1
        place_of = np.full(len(counts), places - 1)
        place_of[seen[np.argsort(-counts[seen], kind="stable")]] = np.arange(places - 1)
        mass = np.bincount(place_of, counts + 0.5, minlength=places)
        log_share = np.log(counts + 0.5) - np.log(mass[place_of])
        ranked = np.argsort(-mass, kind="stable")
        sizes = class_sizes(mass[ranked])
        classes, members = len(sizes), int(sizes.max())
        class_of, member_of = np.empty(places, np.int64), np.empty(places, np.int64)
        class_of[ranked], member_of[ranked] = np.repeat(np.arange(classes), sizes), ragged(np.zeros(classes, np.int64), sizes)
        inner_bias = np.full((classes, members), -30.0)
        inner_bias[class_of, member_of] = np.log(np.maximum(mass, 1e-9))
        out_bias = np.log(np.exp(inner_bias).sum(1))
        w = lambda *shape: (rng.standard_normal(shape) / math.sqrt(width)).astype(np.float32)
        zero = lambda *shape: np.zeros(shape, np.float32)
        return AttentionModel(
            w(places, width), w(width, width), w(width, width), w(width, width), w(width, width), zero(STRIDE, width), zero(2 * STRIDE, width), zero(width),
            w(width, classes), (out_bias - out_bias.max()).astype(np.float32), zero(classes, width, members), (inner_bias - out_bias[:, None]).astype(np.float32), place_of, class_of, member_of, log_share,
        )

    def copy(self) -> AttentionModel:
        return replace(self, **{name: getattr(self, name).copy() for name in self.WEIGHTS})

    def flat(self) -> np.ndarray:
        """All weights, one after another."""
        return np.concatenate([getattr(self, name).ravel() for name in self.WEIGHTS])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for name in self.WEIGHTS:
            old = getattr(self, name)
            setattr(self, name, flat[at : at + old.size].reshape(old.shape).copy())
            at += old.size

    def places(self, rows: np.ndarray) -> np.ndarray:
        """Ids as places; -1 stays."""
        return np.where(rows >= 0, self.place_of[np.maximum(rows, 0)], -1)

    @property
    def sizes(self) -> np.ndarray:
        """The members of each class; the arrays are as wide as the largest."""
        return np.bincount(self.class_of, minlength=len(self.inner))

    def joined(self) -> np.ndarray:
        """The projections of an embedding side by side: query (with attention's scale), residual, key and value."""
        width = self.embedding.shape[1]
        return np.concatenate((self.query * self.query.dtype.type(1 / math.sqrt(width)), self.residual, self.key, self.value), 1)

    def projected(self, used: slice | np.ndarray = slice(None)) -> list[np.ndarray]:
        """The places' projections, as arrays of their own: query, residual with its bias, key and value."""
        own, scale = self.embedding[used], self.query.dtype.type(1 / math.sqrt(self.embedding.shape[1]))
        tables = [own @ w for w in (self.query * scale, self.residual, self.key, self.value)]
        tables[1] += self.hidden_bias
        return tables

    def attend(self, tables: list[np.ndarray], runs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Hidden states of groups of windows. runs: group x (windows + 1) x STRIDE rows of tables, where each window's keys
        are its own run and the one before; first: group x windows, those that don't see the run before. Returns them before
        they are squashed, and what gradients need: queries, keys, values, weights and their sums, and means of values."""
        n, windows, width = len(runs), runs.shape[1] - 1, self.embedding.shape[1]
        own = runs[:, 1:].ravel()
        q, z = (x.take(own, 0).reshape(n, windows, STRIDE, width) for x in tables[:2])
        keys, values = (x.take(runs.ravel(), 0).reshape(*runs.shape, width) for x in tables[2:])
        q += self.place_query * q.dtype.type(1 / math.sqrt(width))
        k = np.empty((n, windows, 2, STRIDE, width), q.dtype)
        np.add(keys[:, :-1], self.place_key[:STRIDE], out=k[:, :, 0])
        np.add(keys[:, 1:], self.place_key[STRIDE:], out=k[:, :, 1])
        k = k.reshape(n, windows, 2 * STRIDE, width)
        v = np.ndarray(k.shape, q.dtype, values, 0, values.strides)  # two runs, of which the second is the next one's first
        a = q @ k.swapaxes(2, 3)
        if a.max() > 60 or a.min() < -60:
            np.copyto(a, -np.inf, where=SEEN == 0)
            a[first, :, :STRIDE] = -np.inf
            a -= a.max(3, keepdims=True)
        np.exp(a, out=a)
        a *= SEEN.astype(a.dtype)
        a[first, :, :STRIDE] = 0
        total = (a.reshape(-1, 2 * STRIDE) @ np.ones(2 * STRIDE, a.dtype)).reshape(n, windows, STRIDE, 1)
        mean = a @ v
        mean /= total
        z += mean
        return z, q, k, v, a, total, mean

    def attend_back(self, dz: np.ndarray, d: np.ndarray, q, k, v, a, total, mean) -> np.ndarray:
        """The gradients of the positions' keys; d (4 x group x run) gets those of all rows of tables that attend() took, from
        those of its states. The weights are used up."""
        width = dz.shape[3]
        part = dz / total
        dv = a.swapaxes(2, 3) @ part
        da = part @ v.swapaxes(2, 3)
        part *= mean
        da -= (part.reshape(-1, width) @ np.ones(width, part.dtype)).reshape(total.shape)
        da *= a
        d[:2, :, 0], d[1, :, 1:] = 0, dz
        np.matmul(da, k, out=d[0, :, 1:])
        dk = da.swapaxes(2, 3) @ q
        for at, x in ((2, dk), (3, dv)):
            d[at, :, 0], d[at, :, -1] = x[:, 0, :STRIDE], x[:, -1, STRIDE:]
            np.add(x[:, :-1, STRIDE:], x[:, 1:, :STRIDE], out=d[at, :, 1:-1])
        return dk.sum((0, 1))

    def loss_and_gradients(self, rows: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """rows: 2 * STRIDE inputs and STRIDE targets, as places."""
        runs, targets = np.maximum(rows[:, : 2 * STRIDE], 0).reshape(-1, 2, STRIDE), rows[:, 2 * STRIDE :].reshape(-1, 1, STRIDE)
        losses = []
        g, used = self.gradients(runs, targets, rows[:, :1] < 0, losses)
        embedding = np.zeros_like(self.embedding)
        embedding[used] = g["embedding"]
        return float(sum(losses)) / max(1, int((targets >= 0).sum())), g | {"embedding": embedding}

    def gradients(self, runs: np.ndarray, targets: np.ndarray, first: np.ndarray, losses: list | None = None) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """The gradients of the mean loss of groups of windows that follow one another; those of the embedding are of the
        places that are returned beside. Inputs and targets are places, -1 where there is no target. Losses are appended, if asked for."""
        width, places = self.embedding.shape[1], len(self.embedding)
        here = np.bincount(runs.ravel(), minlength=places)
        used = np.flatnonzero(here)
        of = np.empty(places, np.int64)
        of[used] = np.arange(len(used))
        runs = of[runs]
        tables, block = self.projected(used), max(1, ATTENDED // first.shape[1])
        blocks = [slice(at, at + block) for at in range(0, len(runs), block)]  # few enough for a processor's cache
        attended = [self.attend(tables, runs[x], first[x]) for x in blocks]
        h, slope = np.empty((2, *targets.shape, width), tables[0].dtype)
        for x, (z, *_) in zip(blocks, attended):
            slope[x] = 1 / (1 + np.abs(z))
            h[x] = z * slope[x]
        h = h.reshape(-1, width)
        known = np.flatnonzero(targets.ravel() >= 0)
        want = targets.ravel()[known]
        n = h.dtype.type(1 / max(len(known), 1))
        order = np.argsort(self.class_of[want].astype(np.uint16), kind="stable")  # by counting
        known, want = known[order], want[order]
        x, c = with_one(h, known), self.class_of[want]
        outer = np.concatenate((self.out, self.out_bias[None]))
        p = x @ outer
        softmax_gradients(p.ravel(), np.arange(len(p) + 1) * p.shape[1], c, n, losses)
        dx = p @ self.out.T
        out = x.T @ p
        inner, inner_grads = np.concatenate((self.inner, self.inner_bias[:, None]), 1), np.zeros((len(self.inner), width + 1, self.inner.shape[2]), h.dtype)
        flat, starts, parts = self.member_logits(x, c, inner)
        softmax_gradients(flat, starts, self.member_of[want], n, losses)
        for i, lo, hi, p in parts:
            inner_grads[i, :, : p.shape[1]] = x[lo:hi].T @ p
            dx[lo:hi] += p @ self.inner[i, :, : p.shape[1]].T
        g = {"out": out[:-1], "out_bias": out[-1], "inner": inner_grads[:, :-1], "inner_bias": inner_grads[:, -1]}
        dz = np.zeros_like(h)
        dz[known] = dx
        dz = dz.reshape(slope.shape)
        d = np.empty((4, *runs.shape, width), h.dtype)
        place_key = 0
        for x, (_, *kept) in zip(blocks, attended):
            slope[x] *= slope[x]
            dz[x] *= slope[x]
            place_key = place_key + self.attend_back(dz[x], d[:, x], *kept)
        order = np.argsort(runs.ravel().astype(np.uint16), kind="stable")  # by counting
        parts = (order[:, None] + np.arange(4) * len(order)).ravel()  # of all four projections
        sums = sum_runs(d.reshape(-1, width).take(parts, 0).reshape(-1, 4 * width), here[used])
        g["query"], g["residual"], g["key"], g["value"] = np.split(self.embedding[used].T @ sums, 4, 1)
        scale = h.dtype.type(1 / math.sqrt(width))
        g["query"] = g["query"] * scale
        g |= {"hidden_bias": sums[:, width : 2 * width].sum(0), "place_query": d[0, :, 1:].sum((0, 1)) * scale, "place_key": place_key, "embedding": sums @ self.joined().T}
        return g, used

    def member_logits(self, x: np.ndarray, c: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
        """The logits of the members of each row's class, for rows in the order of their classes c. inner: weights and, last,
        biases. Returns them one row after another, where rows start and the last one ends, and each class with its rows."""
        counts, sizes = np.bincount(c, minlength=len(inner)), self.sizes
        starts = np.concatenate(([0], np.cumsum(np.repeat(sizes, counts))))
        flat, parts, lo = np.empty(starts[-1], x.dtype), [], 0
        for i, (n, size) in enumerate(zip(counts.tolist(), sizes.tolist())):
            if n:
                own = flat[starts[lo] : starts[lo + n]].reshape(n, size)
                np.matmul(x[lo : lo + n], inner[i, :, :size], out=own)
                parts.append((i, lo, lo + n, own))
                lo += n
        return flat, starts, parts

    def train(self, runs: np.ndarray, targets: np.ndarray, first: np.ndarray, rate: float, adam: Moments) -> None:
        """Adam over batches of groups of windows, once each in the order given."""
        most = max(1, FIT_BATCH // first.shape[1])
        for at in range(0, len(first), most):
            adam.step(*self.gradients(runs[at : at + most], targets[at : at + most], first[at : at + most]), rate)

    def scores(self, ids: np.ndarray, id_ends: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
        """log10 probability of each document's ids and its end: batches of windows, each with the keys of its own inputs
        and of the window before. tables: the embedding's projections, if they are at hand."""
        tables = self.projected() if tables is None else tables
        owner, number = runs_of(id_ends)
        inputs, targets = lay_out(ids, id_ends)
        inputs = self.place_of[np.maximum(inputs, 0)]
        inputs, first = np.concatenate((inputs[:1], inputs)), number == 0
        width, out = self.embedding.shape[1], np.zeros(len(id_ends))
        outer, inner = np.concatenate((self.out, self.out_bias[None])), np.concatenate((self.inner, self.inner_bias[:, None]), 1)
        for at in range(0, len(owner), SCORED_WINDOWS):
            end = min(at + SCORED_WINDOWS, len(owner))
            h = np.empty((end - at, STRIDE, width), np.float32)
            for x in range(at, end, ATTENDED):  # few enough for a processor's cache
                y = min(x + ATTENDED, end)
                h[x - at : y - at] = squash(self.attend(tables, inputs[None, x : y + 1], first[None, x:y])[0][0])
            aim = targets[at:end].ravel()
            known = np.flatnonzero(aim >= 0)
            c = self.class_of[self.place_of[aim[known]]].astype(np.uint16)
            known = known[np.argsort(c, kind="stable")]
            want = self.place_of[aim[known]]
            x, c = with_one(h.reshape(-1, width), known), self.class_of[want]
            logits = x @ outer
            p = self.log_share[aim[known]] + log_softmax_at(logits.ravel(), np.arange(len(logits) + 1) * logits.shape[1], c)
            p += log_softmax_at(*self.member_logits(x, c, inner)[:2], self.member_of[want])
            out += np.bincount(owner[at + known // STRIDE], p, minlength=len(out))
        return out / math.log(10)


class Moments:
    """Adam's moments of a model's weights; its first 20 steps are shorter. They are kept ten times (the first) and a hundred
    times as large. All weights but the embedding become views of one array, which a step goes through in pieces that a processor's cache holds."""

    PIECE = 1 << 14

    def __init__(self, model: AttentionModel):
        self.model, self.steps = model, 0
        self.names = [name for name in model.WEIGHTS if name != "embedding"]
        old = [getattr(model, name) for name in self.names]
        self.flat = np.concatenate([w.ravel() for w in old])
        for name, w, flat in zip(self.names, old, np.split(self.flat, np.cumsum([w.size for w in old])[:-1])):
            setattr(model, name, flat.reshape(w.shape))
        self.of, self.of_embedding = np.zeros((2, len(self.flat)), self.flat.dtype), np.zeros((2, *model.embedding.shape), model.embedding.dtype)

    def step(self, g: dict[str, np.ndarray], used: np.ndarray, rate: float) -> None:
        """The gradients are used up. An embedding that no window of the batch has stays, and so do its moments."""
        self.steps += 1
        unbias = math.sqrt(1 - 0.99**self.steps) * 10
        now, least = np.float32(rate * min(1.0, self.steps / 20) / (1 - 0.9**self.steps) * 0.1 * unbias), np.float32(1e-8 * unbias)
        d = np.concatenate([g[name].ravel() for name in self.names])
        for at in range(0, len(d), self.PIECE):
            self._move(self.flat[at : at + self.PIECE], *self.of[:, at : at + self.PIECE], d[at : at + self.PIECE], now, least)
        every = (self.model.embedding, *self.of_embedding)
        parts = [x.take(used, 0) for x in every]
        self._move(*parts, g["embedding"], now, least)
        for whole, part in zip(every, parts):
            whole[used] = part

    @staticmethod
    def _move(w: np.ndarray, m: np.ndarray, v: np.ndarray, d: np.ndarray, now: np.float32, least: np.float32) -> None:
        m *= np.float32(0.9)
        m += d
        v *= np.float32(0.99)
        d *= d
        v += d
        np.sqrt(v, out=d)
        d += least
        np.divide(m, d, out=d)
        d *= now
        w -= d


#: The keys that each query of a window may see: those of the run before, and its own run's up to itself.
SEEN = np.concatenate((np.ones((STRIDE, STRIDE)), np.tril(np.ones((STRIDE, STRIDE)))), 1)


def squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|)."""
    return x / (1 + np.abs(x))


def class_sizes(mass: np.ndarray) -> np.ndarray:
    """Cuts ids, given by falling mass, into classes such that a token's two softmaxes, over all classes and over its class's
    members, are short in the mean. No class has over three times the square root of the ids."""
    ends = np.concatenate(([0], np.cumsum(mass / mass.sum())))
    most, best = 3 * (math.isqrt(len(mass)) + 1), (math.inf, None)
    for bound in np.geomspace(0.05, 8, 24):
        cuts = [0]
        while (a := cuts[-1]) < len(mass):
            near = slice(a + 1, a + most + 1)
            cuts.append(a + max(1, int(np.searchsorted((ends[near] - ends[a]) * np.arange(1, len(ends[near]) + 1), bound, side="right"))))
        cuts = np.array(cuts)
        best = min(best, (len(cuts) - 1 + float((np.diff(ends[cuts]) * np.diff(cuts)).sum()), cuts), key=lambda x: x[0])
    return np.diff(best[1])


def sum_runs(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of runs of rows. Long ones are summed each, short ones all at once: their first rows, their second rows and so on."""
    starts = np.cumsum(lengths) - lengths
    by_length = np.argsort(-lengths, kind="stable")
    long, short = np.split(by_length, [int(np.searchsorted(-lengths[by_length], -12))])
    out, ones = np.empty((len(lengths), rows.shape[1]), rows.dtype), np.ones(int(lengths.max(initial=0)), rows.dtype)
    for k, at, n in zip(long.tolist(), starts[long].tolist(), lengths[long].tolist()):
        np.matmul(ones[:n], rows[at : at + n], out=out[k])
    if len(short):
        at, falling = starts[short], -lengths[short]
        total = rows.take(at, 0)
        for k in range(1, -int(falling[0])):
            more = int(np.searchsorted(falling, -k))
            total[:more] += rows.take(at[:more] + k, 0)
        out[short] = total
    return out


def keep_memory() -> None:
    """Lets the C library keep freed arrays of up to 64 MB in all for the next ones; else it takes each large one's pages from the system anew,
    which costs more than what is done with them."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError, TypeError):  # not glibc
        return
    mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
    mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD


def with_one(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Some rows, with a 1 after each for biases."""
    out = np.empty((len(rows), x.shape[1] + 1), x.dtype)
    out[:, :-1], out[:, -1] = x.take(rows, 0), 1
    return out


def level(logits: np.ndarray, starts: np.ndarray) -> None:
    """Where a row's logits are too large or small for exponentials, takes the row's largest from all."""
    if len(logits) and (logits.max() > 60 or logits.min() < -60):
        logits -= np.repeat(np.maximum.reduceat(logits, starts[:-1]), np.diff(starts))


def equally_long(starts: np.ndarray) -> bool:
    return len(starts) > 1 and starts[1] * (len(starts) - 1) == starts[-1] and bool((np.diff(starts) == starts[1]).all())


def row_sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of rows that stand one after another."""
    if equally_long(starts):
        return x.reshape(-1, starts[1]) @ np.ones(starts[1], x.dtype)
    return np.add.reduceat(x, starts[:-1]) if len(x) else x


def scale_rows(x: np.ndarray, starts: np.ndarray, by: np.ndarray) -> None:
    """Multiplies rows that stand one after another, each by a number of its own."""
    if equally_long(starts):
        rows = x.reshape(-1, starts[1])
        rows *= by[:, None]
    else:
        x *= np.repeat(by, np.diff(starts))


def softmax_gradients(logits: np.ndarray, starts: np.ndarray, at: np.ndarray, share: np.floating, losses: list | None) -> None:
    """Rows of logits, one after another, become share times the gradients of the losses by them; the sum of losses is
    appended, if asked for."""
    level(logits, starts)
    np.exp(logits, out=logits)
    total, own = row_sums(logits, starts), starts[:-1] + at
    if losses is not None:
        losses.append((np.log(total) - np.log(logits[own] + logits.dtype.type(1e-30))).sum())
    scale_rows(logits, starts, share / total)
    logits[own] -= share


def log_softmax_at(logits: np.ndarray, starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of rows of logits, one after another, which are used up."""
    level(logits, starts)
    own = logits[starts[:-1] + at].astype(np.float64)
    return own - np.log(row_sums(np.exp(logits, out=logits), starts))


def grouped(model: AttentionModel, ids: np.ndarray, id_ends: np.ndarray, number: np.ndarray, some: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Some windows in groups of `size`, each after the other: runs, targets and whether a window is its document's first,
    as in gradients(). Over one in a group, they must hold all windows of their documents. The last group is filled up."""
    inputs, targets = lay_out(ids, id_ends)
    fill = np.arange(-(-len(some) // size) * size)
    own = some[np.minimum(fill, len(some) - 1)].reshape(-1, size)
    targets = model.places(targets[own])
    targets.reshape(-1, STRIDE)[len(some) :] = -1
    runs = np.concatenate((np.maximum(own[:, :1] - 1, 0), own), 1)
    return model.place_of[np.maximum(inputs[runs], 0)], targets, (number[own] == 0) | (fill >= len(some)).reshape(own.shape)


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time, as each holds a slice of texts."""
    for k in range(len(batch)):
        yield batch.slice(k, 1).to_pylist()[0]


def _id_counts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for row in _each(batch):
                ids, ends, held = _ids_of(row)
                counts += np.bincount(ids[np.repeat(~held, np.diff(np.concatenate(([0], ends))))], minlength=size)
                counts[END] += int((~held).sum())
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["id", "n"])

    return run


def training_windows(owner: np.ndarray, held: np.ndarray, first: int, every: int) -> np.ndarray:
    """Every so manyth window of the texts that aren't held out, from the first on that a hash gives."""
    return np.flatnonzero(~held[owner])[first % every :: every]


def schedule(windows: float, whole: bool = False) -> tuple[int, int]:
    """(every, passes) for so many windows of training documents, all of which train if whole."""
    every = 1 if whole else max(1, min(TRAIN_EVERY, int(windows // LEAST_WINDOWS)))
    return every, max(1, min(MOST_PASSES, math.ceil(LEAST_WINDOWS * every / max(windows, 1))))


def _fit(model, piece: int, rate: float, every: int, passes: int):
    """Trains the model over the task's training windows, once each; its weights, flat and in pieces, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        net, adam, windows = None, None, 0
        rows = (row for batch in batches for row in _each(batch))
        if passes > 1:  # there are under LEAST_WINDOWS windows then
            rows = list(rows) * passes
        held_back, rng = [], np.random.default_rng(0)
        size = GROUPED if every == 1 else 1

        def train():
            parts = [np.concatenate(x) for x in zip(*held_back)]
            held_back.clear()
            order = rng.permutation(len(parts[0]))
            net.train(*(x[order] for x in parts), rate, adam)

        for row in rows:
            ids, id_ends, held = _ids_of(row)
            owner, number = runs_of(id_ends)
            some = training_windows(owner, held, zlib.crc32(row["ids"]), every)
            if not len(some):
                continue
            if net is None:
                net = model.value.copy()
                adam = Moments(net)
            held_back.append(grouped(net, ids, id_ends, number, some, size))
            windows += len(some)
            if sum(len(x[0]) for x in held_back) * size >= MIXED:
                train()
        if held_back:
            train()
        if net is not None:
            flat = net.flat()
            for k, at in enumerate(range(0, len(flat), piece)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([windows], pa.int64()), pa.array([flat[at : at + piece].tobytes()], pa.binary())], names=["piece", "windows", "weights"])

    return run


def _average(group: pa.Table) -> pa.Table:
    """A piece's mean over trainers, by their windows."""
    total, windows = 0.0, 0
    for n, weights in zip(group.column("windows").to_pylist(), group.column("weights")):
        total = total + n * np.frombuffer(weights.as_py(), np.float32).astype(np.float64)
        windows += n
    return pa.table({"piece": group.column("piece").slice(0, 1), "windows": pa.array([windows], pa.int64()), "weights": pa.array([_bytes(total / windows, np.float32)], pa.binary())})


def fit_all(texts: DataFrame, model: AttentionModel, windows: float, whole: bool = False) -> int:
    """Trains the model over the training windows of texts, by rounds of trainers where the rows are.

    windows: about how many windows training documents have. Trainers grow with them; what a round sends is their weights.
    Returns how many trained it, counted in each pass.
    """
    spark = texts.sparkSession
    every, passes = schedule(windows, whole)
    trainers, seen = int(windows / every // FIT_WINDOWS) + 1, 0
    piece = max(1024, min(1 << 20, AVERAGED // trainers))
    size = len(model.flat())
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)  # its size is set by the tokenizer's
        rows = texts.filter(F.pmod(F.xxhash64("block"), F.lit(ROUNDS)) == turn).select("held", "ids", "id_ends")
        trained = rows.coalesce(trainers).mapInArrow(_fit(shared, piece, FIT_RATE * (1 - turn / ROUNDS), every, passes), "piece long, windows long, weights binary")
        mean = trained.groupBy("piece").applyInArrow(_average, "piece long, windows long, weights binary").toArrow().sort_by("piece")  # the model's size
        shared.unpersist()
        if len(mean):
            flat = np.frombuffer(b"".join(mean.column("weights").to_pylist()), np.float32)
            if len(flat) != size:
                raise ValueError("the trained weights are not the model's")
            model.load(flat)
            seen += mean.column("windows")[0].as_py()
    return seen


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        tables = model.value.projected()
        for batch in batches:
            for row in _each(batch):
                ids, id_ends, _ = _ids_of(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["keys"], np.int64)), pa.array(model.value.scores(ids, id_ends, tables))], names=["key", "score"])

    return run


def word_scores(docs: DataFrame) -> DataFrame:
    """docs (doc_id, key, text) scored by word counts: key, doc_id, held_out, n_tokens, n_known, train_tokens and base_score."""
    spark = docs.sparkSession
    bytes_ = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = spread(spark, bytes_ / 16, COUNTED)  # about as many (block, word) counts as a sixteenth of the bytes
    dealt = written(docs.mapInArrow(_deal_words(ranges), DEALT), "words")
    counted = written(dealt.filter("range >= 0").select("range", "block", "hashes", "train").groupBy("range").applyInArrow(_count_words, COUNTS), "word-counts")
    words = counted.filter("block < 0").agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    own = dealt.filter("range < 0").drop("range", "hashes", "train")
    bases = written(own.groupBy("block").cogroup(counted.filter("block >= 0").groupBy("block")).applyInArrow(_add_words, BASES), "word-sums")
    forget(dealt)
    forget(counted)
    of = bases.filter("not held_out").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, ends = of[0], of[1]
    level = math.log10(tokens + 0.5 * (words + (ends > 0) + 1))
    return bases.select(
        "key", "doc_id", "held_out", "n_tokens", (F.col("n_known") + int(ends > 0)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + math.log10(ends + 0.5) - F.col("n_tokens") * level).alias("base_score"),
    )


def fit_model(texts: DataFrame, size: int, whole: bool = False) -> AttentionModel:
    """The attention model of texts' ids: they are counted over all training documents, and all of their windows train, or,
    unless whole, every TRAIN_EVERY-th."""
    counted = texts.select("held", "ids", "id_ends").mapInArrow(_id_counts(size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # a row for each id at most
    counts = np.zeros(size, np.int64)
    counts[counted.column("id").to_numpy()] = counted.column("n").to_numpy()
    model = AttentionModel.begin(counts)
    fit_all(texts, model, counts.sum() / STRIDE, whole)
    return model


def score_texts(docs: DataFrame, ranks_file: str, pattern: str, whole: bool = False) -> DataFrame:
    """Scores the whole texts of docs (doc_id, text) by word counts and by a causal self-attention model.

    Documents with crc32(doc_id as text) mod 5 = 1 are held out. Words are lower-cased (A to Z). base_score is the sum of
    log10((c + 0.5) / (N + 0.5 (V + 1))) over a text's words and end, c counted in training documents by the words'
    64-bit hashes. Counts meet by ranges of word hashes, one number for a word and block of about 2 MB of text, and go back
    to the blocks, where documents are summed; so a frequent word's documents never meet. score is the model's log10 probability of the text's subword ids, by the ranks in a file and a pattern that cuts texts
    before them, and an end id, each given between
    STRIDE and 2 * STRIDE - 1 ids before, as far as there are any. Ids are counted over all
    training documents. With whole, all of their windows train the model; without, every TRAIN_EVERY-th, and more of them in
    a small table. They train where the rows are, so that what trains the model grows with the table. Returns doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score, score. A null text counts as empty: its end alone is scored. A null doc_id trains;
    rows with one doc_id are scored each; an empty table gives an empty one; other columns aren't read.
    """
    spark = docs.sparkSession
    docs = with_columns(docs, {"doc_id": "long", "text": "string"})
    docs = docs.select("doc_id", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.coalesce("text", F.lit(""))).alias("key"), "text")
    bases = word_scores(docs)
    texts = written(docs.mapInArrow(_write_ids(ranks_file, pattern), IDS), "ids")
    with rows_at_once(spark, ROWS_AT_ONCE):
        model = fit_model(texts, END + 1, whole)
        shared = spark.sparkContext.broadcast(model)  # its size is set by the tokenizer's
        # rows equal in doc_id and text have one key, and one score
        scores = written(texts.select("keys", "held", "ids", "id_ends").mapInArrow(_score(shared), "key long, score double").groupBy("key").agg(F.max("score").alias("score")), "scores")
    forget(texts)
    return bases.join(scores, "key").select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_lm(spark, sf_dir):
    """All windows of all training documents train the model."""
    import public_tokenizers

    return score_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, whole=True)
