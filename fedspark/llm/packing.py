"""Packing of tokenised documents into fixed windows by best-fit decreasing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, ragged, spread, split_words, table, text_slices, with_columns, written

WINDOW = 4096
END_ID = 2
#: Ranks within a length are taken in parts of about so many pieces of all lengths, so that many pieces of one length, as
#: full windows are, don't meet in one task.
RANKED = 20_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class CapacityTree:
    """Segment tree over the remaining capacities 0 to size: the smallest one, at least some length, that an open window has."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.held = [0] * (2 * self.leaves)
        self.windows: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, first: int, count: int) -> None:
        """count windows with ids from first are open with this capacity."""
        self.windows[capacity].append((first, count))
        if len(self.windows[capacity]) == 1:
            self._count(capacity, 1)

    def take(self, capacity: int) -> tuple[int, int]:
        found = self.windows[capacity].pop()
        if not self.windows[capacity]:
            self._count(capacity, -1)
        return found

    def _count(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.held[at] += by
            at >>= 1

    def tightest(self, least: int) -> int | None:
        at = least + self.leaves
        if self.held[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.held[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.held[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit_plan(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of documents by length, all of one length at once.

    Runs (length, first rank, documents, first window, documents for each window, offset in the window): a document's
    rank within its length finds its run. The number of runs follows from the number of lengths, not of documents.
    """
    tree, runs, windows = CapacityTree(window), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                each = window // length
                first, many, capacity = windows, max(1, left // each), window
                windows += many
            else:
                first, many = tree.take(capacity)
                each = capacity // length
            used = min(many, left // each)
            if used:
                runs.append((length, rank, used * each, first, each, window - capacity))
                rank, left = rank + used * each, left - used * each
                if capacity - each * length:
                    tree.add(capacity - each * length, first, used)
            first, many = first + used, many - used
            if many and left and left < each:
                runs.append((length, rank, left, first, left, window - capacity))
                if capacity - left * length:
                    tree.add(capacity - left * length, first, 1)
                first, many, left = first + 1, many - 1, 0
            if many:
                tree.add(capacity, first, many)
    return runs


def _word_encoder(path: str):
    """Ids of words without white space: the library's, for many at once.

    Every pretoken's last id is one of a token with a word end, so the ids of pretokens set apart by spaces can be told
    apart. Words beyond ASCII and Latin-1 letters, or with a special token's beginning, go to the library one by one.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    plain = r"^[\x21-\x7EÀ-ÖØ-öø-ÿ]+$"
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    pretokens = regex.compile(pattern)
    ends = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), bool)
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        ends[i] = token.endswith("</w>")

    def many(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, lengths = [], []
        for at in range(0, len(parts), 4096):
            some = parts[at : at + 4096]
            ids = np.array(tokenizer.encode(" ".join(some), add_special_tokens=False).ids, np.int32)
            last = np.flatnonzero(ends[ids])
            if len(last) == len(some):
                flat.append(ids)
                lengths.append(np.diff(np.concatenate(([-1], last))))
            else:  # a pretoken without a word end: one by one
                each = [np.array(tokenizer.encode(x, add_special_tokens=False).ids, np.int32) for x in some]
                flat += each
                lengths.append(np.array([len(x) for x in each]))
        return (np.concatenate(flat), np.concatenate(lengths)) if flat else (np.empty(0, np.int32), np.empty(0, np.int64))

    memo = Memo(many, 400_000)

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        given = pa.array(words, pa.string())
        ok = pc.and_(pc.match_substring_regex(given, plain), pc.invert(pc.match_substring(given, "<|")))
        lower = pc.utf8_lower(given.filter(ok))
        per_word = np.zeros(len(words), np.int64)
        per_word[ok.to_numpy(zero_copy_only=False)] = pc.count_substring_regex(lower, pattern).to_numpy(zero_copy_only=False)
        parts = pretokens.findall(" ".join(lower.to_numpy(zero_copy_only=False).tolist()))
        if len(parts) != per_word.sum():  # two regular-expression libraries cut words differently: all go one by one
            ok, parts, per_word = pa.array([False] * len(words)), [], np.zeros(len(words), np.int64)
        odd = {k: np.array(tokenizer.encode(words[k], add_special_tokens=False).ids, np.int32) for k in np.flatnonzero(~ok.to_numpy(zero_copy_only=False)).tolist()}
        starts, lengths = memo(parts)
        ends_at = np.concatenate(([0], np.cumsum(lengths)))
        word_ends = np.cumsum(per_word)
        sizes = ends_at[word_ends] - ends_at[word_ends - per_word]
        flat = memo.flat.take(ragged(starts, lengths))
        if odd:
            cuts = np.cumsum(sizes) - sizes
            for k, ids in odd.items():
                sizes[k] = len(ids)
            where = sorted(odd)
            flat = np.insert(flat, np.repeat([cuts[k] for k in where], [len(odd[k]) for k in where]), np.concatenate([odd[k] for k in where]) if where else [])
        return flat, sizes

    return encode


def _pieces(path: str, window: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(_word_encoder(path), 700_000)
        for batch in batches:
            for part in text_slices(batch):
                words, counts = split_words(part.column("text"))
                coded = words.dictionary_encode()
                starts, lengths = memo(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
                codes = coded.indices.to_numpy(zero_copy_only=False)
                sizes = lengths.take(codes)
                ids = memo.flat.take(ragged(starts.take(codes), sizes)).astype("<u4")
                word_at = np.concatenate(([0], np.cumsum(sizes)))
                doc_at = word_at[np.concatenate(([0], np.cumsum(counts)))]
                rows, all_ids = [], []
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), doc_at[:-1], doc_at[1:]):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(own), window):
                        piece = own[start : start + window]
                        rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(own)))
                        if with_ids:
                            all_ids.append(piece)
                arrays = [pa.array(x, pa.int64()) for x in zip(*rows)]
                if with_ids:
                    arrays.append(pa.array([x.astype(np.int64) for x in all_ids], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids)

    return run


def _place(runs: list[tuple[int, int, int, int, int, int]], window: int):
    length, rank, _, first, each, offset = np.array(runs or [(0,) * 6], np.int64).T
    order = np.lexsort((rank, length))
    length, rank, first, each, offset = (x[order] for x in (length, rank, first, each, offset))
    base = int(rank.max()) + 1
    if base * (window + 1) > 1 << 62:
        raise ValueError("a length's ranks and the window are too large for one key")
    key = length * base + rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, at = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            lo = np.searchsorted(key, own * base + np.minimum(at, base - 1), side="right") - 1
            inner = at - rank[lo]
            names = batch.schema.names
            batch = batch.set_column(names.index("_rank"), "sequence_id", pa.array(first[lo] + inner // each[lo]))
            yield batch.append_column("offset", pa.array(offset[lo] + inner % each[lo] * own))

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Packs the token ids of docs (doc_id, text), each document's followed by end_id, into sequences of `window` ids.

    A document is first cut into full windows, each a sequence of its own. The rests are packed by best-fit decreasing:
    a segment tree by remaining capacity finds the tightest open window. As rests of one length are alike, the tree
    works on the counts of the at most `window` lengths, and gives runs by which every task places its rows by their
    rank within their length. Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id
    and offset, and the ids if asked for. A null text is empty and has end_id only; rows with one doc_id are documents
    of their own; a null doc_id stays null; an empty table gives an empty one; other columns aren't read.
    """
    spark = docs.sparkSession
    schema = PIECES + (", ids array<long>" if with_ids else "")
    pieces = written(with_columns(docs, {"doc_id": "long", "text": "string"}).mapInArrow(_pieces(tokenizer, window, end_id, with_ids), schema), "pieces")
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `window` rows
    salts = spread(spark, sum(lengths.values()), RANKED)
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("long"))
    counts = pieces.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n"))
    runs = best_fit_plan(lengths, window)
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = pieces.join(counts, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.row_number().over(order) - 1)
    columns = [x.split()[0] for x in schema.split(", ")]
    placed = ranked.select(*columns, F.col("_rank").cast("long").alias("_rank"))
    return placed.mapInArrow(_place(runs, window), schema + ", sequence_id long, offset long")


def op6_packing(spark, sf_dir):
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
