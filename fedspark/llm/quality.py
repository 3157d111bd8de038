"""Quality rules: counts of words, symbols and repeats, and zstandard compression bands."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, split_words, table, text_slices, with_columns, written

#: (UTF-8 bytes from which the band holds, smallest and largest ratio of bytes to compressed bytes). These outer bands hold
#: everywhere; the table's own ratios narrow them.
BANDS = ((0, 0.0, 1e9), (200, 1.0, 4.0), (1000, 1.35, 4.5), (4000, 1.45, 5.0), (16000, 1.5, 6.0))
#: A length class holds texts of like length: two classes for each doubling. Its band reaches SPREADS robust deviations to
#: either side of its centre, NARROWEST of the centre at least. Centre and deviation are those of its own texts, weighed by
#: their number, and those that the classes around it foretell, weighed as the texts around, PRIOR_TEXTS at most; a class's say in that halves
#: with every class in between. What is foretold starts from one text of variance FIRST_VARIANCE, which grows by as much
#: with each class of distance, and of no rise, so that a few texts do not pass for a rule.
SPREADS, NARROWEST, PRIOR_TEXTS, FIRST_VARIANCE = 5.5, 0.06, 50, 0.0625
CLASSES = 64
#: Ratios are counted in hundredths, up to MOST_RATIO.
MOST_RATIO = 20
CHUNK_BYTES = 4096
#: A rest of a text shorter than this belongs to the chunk before it.
SHORT = 200
#: Share of a text's chunks that may lie outside the band.
BAD_CHUNKS = 0.3
LEVEL = 3

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "ratio double, n_chunks long, n_bad_chunks long, base_failed boolean, kept boolean"
)
MEASURES = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_bytes long, kind long, ratio double, chunk_bytes array<long>, chunk_ratio array<double>, base_failed boolean"
)


def length_class(n_bytes: int) -> int:
    return min(int(2 * math.log2(max(n_bytes, 1))), CLASSES - 1)


def bands_of(counts: dict[tuple[int, int], int]) -> dict[int, tuple[float, float]]:
    """The band of every length class, from counts of (length class, ratio in hundredths): medians and quartiles of what was
    counted, drawn towards a line through the medians of the classes around. There are none only where nothing was counted."""
    by_class: dict[int, list] = {}
    for (kind, at), n in sorted(counts.items()):
        by_class.setdefault(kind, []).append((at, n))
    if not by_class:
        return {}
    kinds, texts, centre, spread = np.array(list(by_class), float), [], [], []
    for rows in by_class.values():
        at, n = np.array(rows).T
        first, median, third = (at[np.searchsorted(np.cumsum(n), q * n.sum())] / 100 + 0.005 for q in (0.25, 0.5, 0.75))
        texts.append(n.sum())
        centre.append(median)
        spread.append((third - first) / 1.349)
    texts, centre, spread = (np.array(x, float) for x in (texts, centre, spread))
    out = {}
    for kind in range(CLASSES):
        own = kinds == kind
        say = texts * 2.0 ** -np.abs(kinds - kind) * ~own
        heard = say.sum()
        if heard:
            say /= heard
            at, level = say @ kinds, say @ centre
            rise = heard * say @ ((kinds - at) * (centre - level)) / (heard * say @ (kinds - at) ** 2 + 1)
            line = level + rise * (kinds - at)
            # doubt: the classes' own deviations, their distance from the line, and half of what the line rises from where they are
            foretold, doubt = level + rise * (kind - at), say @ (spread**2 + (centre - line) ** 2) + (rise * (kind - at) / 2) ** 2
            doubt = (heard * doubt + FIRST_VARIANCE * (1 + say @ np.abs(kinds - kind))) / (heard + 1)
        else:
            foretold, doubt = centre[0], FIRST_VARIANCE
        n, prior = texts[own].sum(), min(heard + 1, PRIOR_TEXTS)
        middle = (n * centre[own].sum() + prior * foretold) / (n + prior)
        reach = max(SPREADS * math.sqrt((n * spread[own].sum() ** 2 + prior * doubt) / (n + prior)), NARROWEST * middle)
        out[kind] = (middle - reach, middle + reach)
    return out


def inside(n_bytes: np.ndarray, ratio: np.ndarray, fitted: dict[int, tuple[float, float]]) -> np.ndarray:
    """Whether the ratio of a text or chunk of so many bytes lies in the fixed outer band and in that of its length class."""
    least, low, high = (np.array(x) for x in zip(*BANDS))
    at = np.searchsorted(least, n_bytes, side="right") - 1
    kept = (low[at] <= ratio) & (ratio <= high[at])
    if fitted:
        low, high = np.array([fitted[k] for k in range(CLASSES)]).T
        at = np.array([length_class(n) for n in n_bytes.tolist()], np.int64)
        kept &= (low[at] <= ratio) & (ratio <= high[at])
    return kept


def chunks_of(text: bytes, chunk_bytes: int = CHUNK_BYTES) -> list[bytes]:
    """A text's chunks, the partial one at its end included; a text shorter than a chunk has none."""
    cuts = [*range(0, len(text), chunk_bytes), len(text)] if len(text) >= chunk_bytes else []
    if len(cuts) > 2 and cuts[-1] - cuts[-2] < SHORT:
        del cuts[-2]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def repeated_window_words(codes: np.ndarray, counts: np.ndarray, width: int = 5) -> np.ndarray:
    """Words of each text inside windows of `width` words that occur twice or more in it; codes: the words' numbers, text after text."""
    n, texts = len(codes), len(counts)
    out = np.zeros(texts, np.int64)
    if n < width:
        return out
    doc = np.repeat(np.arange(texts), counts)
    m = n - width + 1
    inside = np.flatnonzero(doc[:m] == doc[width - 1 :])
    key = mix64(doc[inside].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for j in range(width):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + codes[inside + j].astype(np.uint64))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    a, b = inside[order][:-1][same], inside[order][1:][same]
    if not all(np.array_equal(codes[a + j], codes[b + j]) for j in range(width)) or not np.array_equal(doc[a], doc[b]):
        # two different windows have one hash: number the windows by themselves
        key = np.unique(np.stack((doc[inside], *(codes[inside + j] for j in range(width))), 1), axis=0, return_inverse=True)[1].ravel()
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        a, b = inside[order][:-1][same], inside[order][1:][same]
    hit = np.zeros(n, bool)
    for j in range(width):
        hit[a + j] = True
        hit[b + j] = True
    np.add.at(out, doc[hit], 1)
    return out


def duplicate_lines(texts: pa.Array) -> np.ndarray:
    """Lines of each text that hold a word and equal an earlier line of it."""
    out = np.zeros(len(texts), np.int64)
    parts = pc.split_pattern(texts, "\n")
    lines, starts = parts.flatten(), parts.offsets.to_numpy()
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))
    worded = pc.match_substring_regex(lines, "[^\\x20\\x09-\\x0D]").to_numpy(zero_copy_only=False)
    lines, doc = lines.filter(pa.array(worded)), doc[worded]
    if not len(lines):
        return out
    seen = lines.dictionary_encode()
    key = doc.astype(np.int64) * len(seen.dictionary) + seen.indices.to_numpy(zero_copy_only=False)
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[first] = False
    np.add.at(out, doc[again], 1)
    return out


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """All words, and each text's number of words, number of those in repeated windows, and whether the base rules fail it."""
    words, counts = split_words(texts)
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(words) else np.empty(0, np.int64)
    repeats = repeated_window_words(codes, counts)
    return words, counts, repeats, (counts < 10) | (100 * repeats > 20 * counts)


def _count_ratios(level: int):
    """Counts of (length class, ratio in hundredths) over texts that pass the base rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, counts = zstandard.ZstdCompressor(level=level), Counter()
        for batch in batches:
            for part in text_slices(batch):
                texts = part.column("text")
                for text, failed in zip(texts.cast(pa.binary()).to_pylist(), _words(texts)[3].tolist()):
                    if not failed:
                        counts[length_class(len(text)), int(min(len(text) / len(press.compress(text)) * 100, 100 * MOST_RATIO))] += 1
        if counts:
            kind, at = zip(*counts)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(at), pa.array(list(counts.values()))], names=["kind", "at", "n"])

    return run


def fit_bands(docs: DataFrame, level: int = LEVEL) -> dict[int, tuple[float, float]]:
    """The bands by length class from the ratios of all texts of docs (text) that pass the base rules."""
    counts = docs.select(docs["text"].cast("string").alias("text")).mapInArrow(_count_ratios(level), "kind long, at long, n long")
    return _bands(counts.groupBy("kind", "at").agg(F.sum("n").alias("n")))


def _bands(counts: DataFrame) -> dict[int, tuple[float, float]]:
    return bands_of({(r["kind"], r["at"]): r["n"] for r in counts.collect()})  # 64 classes of 2,001 ratios at most


def _measure(texts: pa.Array, press: zstandard.ZstdCompressor, chunk_bytes: int) -> dict[str, pa.Array]:
    """Counts of each text, its bytes and ratio, and those of its chunks."""
    words, counts, repeats, failed = _words(texts)
    ends = np.concatenate(([0], np.cumsum(counts)))
    chars = np.concatenate(([0], np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)))
    ratio_of = lambda data: len(data) / len(press.compress(data))
    n_bytes, ratio, n_chunks, sizes, ratios = [], [], [], [], []
    for text in texts.cast(pa.binary()).to_pylist():
        chunks = chunks_of(text, chunk_bytes)
        n_bytes.append(len(text))
        ratio.append(ratio_of(text) if text else 0.0)
        n_chunks.append(len(chunks))
        sizes += map(len, chunks)
        ratios += map(ratio_of, chunks)
    cuts = pa.array(np.concatenate(([0], np.cumsum(n_chunks))).astype(np.int32))
    each = {"n_words": counts.astype(np.int64), "word_chars": chars[ends[1:]] - chars[ends[:-1]], "n_repeat_words": repeats, "base_failed": failed}
    return {name: pa.array(x) for name, x in each.items()} | {
        "n_bytes": pa.array(n_bytes, pa.int64()),
        "ratio": pa.array(ratio, pa.float64()),
        "chunk_bytes": pa.ListArray.from_arrays(cuts, pa.array(sizes, pa.int64())),
        "chunk_ratio": pa.ListArray.from_arrays(cuts, pa.array(ratios, pa.float64())),
    }


def _decide(of: dict[str, pa.Array], fitted: dict, bad_chunks: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's number of chunks, number of those outside their bands, and whether it is kept."""
    plain = lambda x: x.to_numpy(zero_copy_only=False)
    n_chunks = plain(pc.list_value_length(of["chunk_bytes"])).astype(np.int64)
    out = ~inside(plain(of["chunk_bytes"].flatten()), plain(of["chunk_ratio"].flatten()), fitted)
    bad = np.bincount(np.repeat(np.arange(len(n_chunks)), n_chunks)[out], minlength=len(n_chunks))
    kept = ~plain(of["base_failed"]) & inside(plain(of["n_bytes"]), plain(of["ratio"]), fitted) & (bad <= bad_chunks * n_chunks)
    return n_chunks, bad, kept


def _measure_rows(chunk_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=level)
        names = [x.split()[0] for x in MEASURES.split(", ")]
        for batch in batches:
            for part in text_slices(batch):
                texts = part.column("text")
                found = _measure(texts, press, chunk_bytes)
                found |= {"doc_id": part.column("doc_id"), "n_symbols": pc.count_substring_regex(texts, "[#*$%&|<>]").cast(pa.int64()), "n_dup_lines": pa.array(duplicate_lines(texts))}
                found["kind"] = pa.array([length_class(n) for n in found["n_bytes"].to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([found[name] for name in names], names=names)

    return run


def _decide_rows(fitted: dict, bad_chunks: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            found = dict(zip(batch.schema.names, batch.columns))
            found |= {name: pa.array(x) for name, x in zip(("n_chunks", "n_bad_chunks", "kept"), _decide(found, fitted, bad_chunks))}
            yield pa.RecordBatch.from_arrays([found[name] for name in names], names=names)

    return run


def quality_rules(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, bad_chunks: float = BAD_CHUNKS, level: int = LEVEL) -> DataFrame:
    """One row of counts and verdicts for each row of docs (doc_id, text); only counts of ratios are shuffled.

    kept is false where base_failed is true (under 10 words, or over 20 % of words in repeated 5-word windows), where
    the zstandard ratio of the whole text leaves the band for its length, and where more than bad_chunks of its
    chunks, the last partial one included, leave the bands for theirs. The bands come from the ratios of all texts of
    the table that pass the base rules, by length class, within fixed outer bands; a class of few texts leans on the classes
    around it, so tables of every size have bands. Texts are read and compressed once, and their measures written. A null
    text counts as an empty one, which fails with its 0 words; repeated rows get equal rows; a null doc_id stays null; other
    columns of docs are not read; an empty table gives an empty one.
    """
    docs = with_columns(docs, {"doc_id": "long", "text": "string"})
    measured = written(docs.mapInArrow(_measure_rows(chunk_bytes, level), MEASURES), "measures")
    at = F.least(F.floor(F.col("ratio") * 100), F.lit(100 * MOST_RATIO))
    fitted = _bands(measured.filter("not base_failed").groupBy("kind", at.alias("at")).agg(F.count(F.lit(1)).alias("n")))
    return measured.mapInArrow(_decide_rows(fitted, bad_chunks), SCHEMA)


def keep_good(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, bad_chunks: float = BAD_CHUNKS, level: int = LEVEL) -> DataFrame:
    """The rows of docs (text and any other columns, as they are) that quality_rules would keep, each by its own text; they
    are read twice, so that they needn't be written in between."""
    fitted = fit_bands(docs, level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            for part in text_slices(batch):  # a null text has no words and goes
                kept = _decide(_measure(part.column("text"), press, chunk_bytes), fitted, bad_chunks)[2]
                if kept.any():
                    yield part.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def op8_quality(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))
