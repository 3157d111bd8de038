"""SentencePiece encoding and decoding by a score-ordered agenda of adjacent symbol pairs."""

from __future__ import annotations

import hashlib
import heapq
import re
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import Memo, ragged, text_slices, with_columns

SPACE = "▁"
NONE = np.int32(1 << 30)
#: Chunks of more symbols keep their agenda in a heap; shorter ones are rows of a matrix, all merged in step.
MATRIX_WIDTH = 32

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class MergeVocabulary:
    """Pieces, scores and the table of adjacent pairs that merge, read from a merge-type model."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any(SPACE in pieces[i].lstrip(SPACE) for i in normal):
            raise ValueError("a piece spans two words, so words can't be encoded one by one")
        self.unknown, self.end = sp.unk_id(), sp.eos_id()
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.symbol = {pieces[i]: i for i in normal}
        #: Symbols that only parts of pieces need get numbers beyond the vocabulary.
        for i in normal:
            for char in pieces[i]:
                self.symbol.setdefault(char, size + len(self.symbol))
        made = [i for i in normal if len(pieces[i]) > 1]  # what a merge can make
        scores = sorted({sp.get_score(i) for i in made}, reverse=True)
        order = {s: k for k, s in enumerate(scores)}
        self.width = max(self.symbol.values()) + 2
        self.pairs: dict[int, tuple[int, int]] = {}
        for i in made:
            for cut in range(1, len(pieces[i])):
                a, b = self.symbol.get(pieces[i][:cut]), self.symbol.get(pieces[i][cut:])
                if a is not None and b is not None:
                    self.pairs[a * self.width + b] = (order[sp.get_score(i)], i)
        self.keys = np.array(sorted(self.pairs), np.int64)
        self.orders = np.array([self.pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.piece = np.full(len(scores), -1, np.int32)  # by order
        for i in made:
            if pieces[i].strip(SPACE):
                if self.piece[order[sp.get_score(i)]] >= 0:
                    raise ValueError("two pieces with letters have one score")
                self.piece[order[sp.get_score(i)]] = i
        self.size = size
        self.by_code = np.full(0x110000, self.width - 1, np.int32)  # the last: a character of no piece
        for char, i in self.symbol.items():
            if len(char) == 1:
                self.by_code[ord(char)] = i

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Order of adjacent symbols; NONE where they don't merge."""
        key = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.orders[at], NONE)

    def heap_merge(self, symbols: list[int]) -> list[tuple[int, int]]:
        """(id, first symbol) of what is left when the agenda is empty: best score first, then leftmost."""
        n = len(symbols)
        ids, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < n and (found := self.pairs.get(ids[left] * self.width + ids[right])):
                heapq.heappush(agenda, (found[0], left, right, ids[left], ids[right]))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, left, right, a, b = heapq.heappop(agenda)
            if ids[left] != a or ids[right] != b or after[left] != right:
                continue
            ids[left], ids[right] = self.pairs[a * self.width + b][1], -1
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        out, i = [], 0
        while i < n:
            out.append((ids[i], i))
            i = after[i]
        return out

    def _ids(self, merged: list[tuple[int, int]], text: str) -> list[int]:
        if all(i < self.size for i, _ in merged):
            return [i for i, _ in merged]
        out = []
        for i, at in merged:
            out += [i] if i < self.size else [int(self.byte[b]) for b in text[at].encode()]
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each with a space before it, one after another, and the number of each."""
        chunks = [SPACE + w for w in words]
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.by_code[codes]
        ends = np.cumsum(sizes)
        single = (symbols >= self.size) & (codes < 128)  # of no piece, and one byte: it stays alone
        symbols = np.where(single, self.width - 1, symbols)
        strange = np.add.reduceat((symbols >= self.size) & ~single, ends - sizes) > 0 if len(chunks) else np.empty(0, bool)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (word, place among its ids, id)
        spaced = np.fromiter((SPACE in w for w in words), bool, len(words))  # pieces of spaces share a score
        by_heap = np.flatnonzero(strange | spaced | (sizes > MATRIX_WIDTH))
        for k in by_heap.tolist():
            ids = np.array(self._ids(self.heap_merge(symbols[ends[k] - sizes[k] : ends[k]].tolist()), chunks[k]))
            found.append((np.full(len(ids), k), np.arange(len(ids)), ids))
        rest = np.ones(len(chunks), bool)
        rest[by_heap] = False
        for width in range(2, MATRIX_WIDTH + 2, 2):
            rows = np.flatnonzero(rest & (sizes <= width) & (sizes > width - 2))
            if len(rows):
                at = (ends - sizes)[rows][:, None] + np.arange(width)
                grid = np.where(np.arange(width) < sizes[rows][:, None], symbols[np.minimum(at, len(symbols) - 1)], -1).astype(np.int32)
                self._merge(grid)
                r, c = np.nonzero(grid >= 0)
                ids = grid[r, c]
                raw = np.flatnonzero(ids >= self.size)
                ids[raw] = self.byte[codes[at[r[raw], c[raw]]]]
                found.append((rows[r], c, ids))
        if not found:
            return np.empty(0, np.int32), sizes
        word, place, ids = (np.concatenate(x) for x in zip(*found))
        return ids[np.argsort(word * (1 << 20) + place)].astype(np.int32), np.bincount(word, minlength=len(chunks))

    def _merge(self, grid: np.ndarray) -> None:
        """All rows' agendas in step: each pops its best, leftmost pair, merges it and offers the two pairs beside it.

        A row's symbols are linked by after and before; a symbol merged into its left neighbour becomes -1.
        """
        n, width = grid.shape
        orders = np.full((n, width), NONE, np.int32)
        orders[:, :-1] = self.lookup(grid[:, :-1], grid[:, 1:])
        after = np.broadcast_to(np.arange(1, width + 1), grid.shape).copy()
        before = np.broadcast_to(np.arange(-1, width - 1), grid.shape).copy()
        live = np.arange(n)
        while len(live):
            left = orders[live].argmin(1)
            order = orders[live, left]
            on = order < NONE
            live, left, order = live[on], left[on], order[on]
            right = after[live, left]
            grid[live, left] = self.piece[order]
            grid[live, right] = -1
            orders[live, right] = NONE
            beyond, ahead = after[live, right], before[live, left]
            after[live, left] = beyond
            has = beyond < width
            before[live[has], beyond[has]] = left[has]
            orders[live, left] = np.where(has, self.lookup(grid[live, left], grid[live, np.minimum(beyond, width - 1)]), NONE)
            has = ahead >= 0
            orders[live[has], ahead[has]] = self.lookup(grid[live[has], ahead[has]], grid[live[has], left[has]])


_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def words_of(text: str) -> list[str]:
    """The text as the model sees it, a space before it and spaces made visible, cut before each run of spaces; less each piece's first space."""
    return [c[1:] for c in _CHUNK.findall(SPACE + text.replace(" ", SPACE))] if text else []


class CheckedEncoder:
    """Encodes new words by the agenda and compares them with the library's, many words in one text; the library's ids win."""

    def __init__(self, vocabulary: MergeVocabulary):
        self.vocabulary, self.mended = vocabulary, 0

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        v = self.vocabulary
        flat, sizes = v.encode_words(words)
        ends = np.cumsum(sizes)
        for at in range(0, len(words), 256):
            some, a, b = words[at : at + 256], ends[at] - sizes[at], ends[min(at + 256, len(words)) - 1]
            if "" in some or not np.array_equal(v.library.encode(" ".join(some), return_type="numpy"), flat[a:b]):
                for k in range(at, at + len(some)):
                    own, said = flat[ends[k] - sizes[k] : ends[k]].tolist(), v.library.encode(words[k])
                    if words[k] and own != said:
                        self.mended += 1
                        warnings.warn(f"the agenda's ids of {words[k]!r} are {own}, the library's {said}", stacklevel=2)
                        flat = np.concatenate((flat[: ends[k] - sizes[k]], said, flat[ends[k] :])).astype(np.int32)
                        sizes[k] = len(said)
                        ends = np.cumsum(sizes)
        return flat, sizes


def _rows(part: pa.RecordBatch, words: pa.Array, counts: np.ndarray, memo: Memo, vocabulary: MergeVocabulary, with_ids: bool) -> pa.RecordBatch:
    coded = words.dictionary_encode()
    starts, lengths = memo(coded.dictionary.to_pylist())
    codes = coded.indices.to_numpy(zero_copy_only=False)
    sizes = lengths[codes]
    ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))]
    ids = np.insert(memo.flat[ragged(starts[codes], sizes)], ends[1:], vocabulary.end).astype(np.int32)
    ends = ends + np.arange(len(ends))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids).cast(pa.string())), " ").cast(pa.binary())
    digest = [hashlib.sha256(x).hexdigest() for x in joined.to_pylist()]
    rows = [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]
    decoded = vocabulary.library.decode(rows, num_threads=1) if rows else []
    out = [part.column("doc_id"), pa.array(np.diff(ends)), pa.array(digest, pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string())]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    if with_ids:
        out, names = [*out, pa.array(rows, pa.list_(pa.int32())), pa.array(decoded, pa.string())], [*names, "ids", "decoded"]
    return pa.RecordBatch.from_arrays(out, names=names)


def _codec(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = MergeVocabulary(path)
        memo = Memo(CheckedEncoder(vocabulary), 700_000)
        for batch in batches:
            for part in text_slices(batch):
                texts = part.column("text")
                odd = pc.or_(pc.match_substring_regex(texts, "  |^ | $"), pc.equal(pc.binary_length(texts), 0))
                some = part.filter(pc.invert(odd))
                split = pc.split_pattern(some.column("text"), " ")
                yield _rows(some, split.flatten(), np.diff(split.offsets.to_numpy()), memo, vocabulary, with_ids)
                some = part.filter(odd)
                if len(some):
                    words = [words_of(t) for t in some.column("text").to_pylist()]
                    yield _rows(some, pa.array([w for row in words for w in row], pa.string()), np.fromiter(map(len, words), np.int64, len(words)), memo, vocabulary, with_ids)

    return run


def encode_decode(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """Encodes and decodes the whole texts of docs (doc_id, text) with a merge-type sentencepiece model, without a shuffle.

    No piece of such a model spans two words, so the agenda of symbol pairs runs for each distinct word, with the spaces
    before it, of a batch; every one is checked against the library, whose ids win should they differ. An end id
    follows, and the library decodes the ids. Returns doc_id, n_tokens, SHA-256 of the ids (decimal, joined by a space)
    and of the decoded text, and ids and decoded if asked for. A null text
    counts as empty and has the end id only; repeated rows get equal rows; a null doc_id stays null; an empty table
    gives an empty one; other columns aren't read.
    """
    schema = SCHEMA + (", ids array<int>, decoded string" if with_ids else "")
    return with_columns(docs, {"doc_id": "long", "text": "string"}).mapInArrow(_codec(model, with_ids), schema)


def op5_sentencepiece(spark, sf_dir):
    import public_tokenizers

    from .common import table

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
