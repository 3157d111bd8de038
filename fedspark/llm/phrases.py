"""Phrase collocations: n-grams counted in suffix arrays of shards, merged by key, scored by their weakest cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, mix64, table, written

#: Words of a phrase at most, occurrences at least, and phrases returned for each language.
WORDS, LEAST, TOP = 4, 30, 2000
#: Bytes of text of one suffix array. Longer texts are cut between pieces, which no phrase crosses.
SHARD_BYTES = 8 << 20
#: Bits of the filter of frequent pairs for each of them, and in all at least and at most (32 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 1 << 20, 1 << 28
#: Bits of one row of the filter (fixed by Spark's bitmap functions).
ROW_BITS = 1 << 15
#: Parts of a language that are ranked apart first.
SALTS = 64

#: Of each byte: 0 in a word, 1 between words, 2 between pieces; and its lower case.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def sections(texts: pa.Array, most: int = SHARD_BYTES) -> Iterator[np.ndarray]:
    """The bytes of all texts, lower-cased, in sections of about `most` that end between pieces."""
    joined = pc.binary_join_element_wise(texts.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    data = _LOWER[np.frombuffer(joined.buffers()[2] or b"", np.uint8)[: int(pc.sum(pc.binary_length(joined)).as_py() or 0)]]
    at = 0
    while at < len(data):
        end = at + most
        while end < len(data):  # to the next break
            breaks = np.flatnonzero(_KIND[data[end : end + most]] == 2)
            if len(breaks):
                end += int(breaks[0]) + 1
                break
            end += most
        yield data[at:end]
        at = end


def word_ids(data: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The section's distinct words, the ids of all its words, and for each the words left in its piece, WORDS at most."""
    kind = _KIND[data]
    inside = kind == 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    flat = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    coded = flat.dictionary_encode()
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    room = np.ones(len(starts), np.int8)
    for k in range(1, WORDS):
        room[:-k] += piece[k:] == piece[:-k]
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), room


def suffix_array(ids: np.ndarray, room: np.ndarray, depth: int = WORDS) -> np.ndarray:
    """Positions of all words, ordered by the words from there on to the piece's end, `depth` at most.

    Prefix doubling: the order by h words gives that by 2 h.
    """
    rank, h = ids + 1, 1
    order = np.argsort(rank, kind="stable")
    while h < depth:
        after = np.zeros_like(rank)
        after[:-h] = np.where(room[:-h] > h, rank[h:], 0)
        key = rank * (int(rank.max(initial=0)) + 1) + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty_like(key)
        rank[order] = np.cumsum(np.concatenate(([1], ranked[1:] != ranked[:-1]))) if len(key) else key
        h *= 2
    return order


def common_words(ids: np.ndarray, room: np.ndarray, order: np.ndarray, depth: int = WORDS) -> np.ndarray:
    """Of each suffix in the order, the words at its beginning that it shares with the one before it."""
    out, same = np.zeros(len(order), np.int8), np.ones(max(0, len(order) - 1), bool)
    one, two = order[:-1], order[1:]
    for k in range(depth):
        same = same & (room[one] > k) & (room[two] > k)
        at = np.flatnonzero(same)
        same[at] = ids[one[at] + k] == ids[two[at] + k]
        out[1:] += same
    return out


def intervals(order: np.ndarray, shared: np.ndarray, room: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, count): the runs of suffixes that share k words, as places in the order; suffixes with fewer words are in none."""
    first = np.flatnonzero(shared < k)
    count = np.diff(np.append(first, len(order)))
    long = room[order[first]] >= k
    return first[long], count[long]


def _pair_keys(words: pa.Array, lang: str, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit keys of the pairs of words that begin at these positions."""
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))
    seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
    return mix64(mix64(hashes[ids[at]] ^ seed) + hashes[ids[at + 1]])


def _by_lang(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, np.ndarray]]:
    """Sections of the texts of each language; what is kept between batches has `most` bytes at about."""
    kept: dict[str, list[pa.Array]] = {}
    size = 0

    def flush() -> Iterator[tuple[str, np.ndarray]]:
        for lang, texts in kept.items():
            for data in sections(pa.concat_arrays(texts), most):
                yield lang, data
        kept.clear()

    for batch in batches:
        langs = pc.fill_null(batch.column("lang"), "und")
        texts = pc.fill_null(batch.column("text"), "").cast(pa.large_string())
        for at in range(0, len(batch), 256):
            some, names = texts.slice(at, 256), langs.slice(at, 256)
            for lang in pc.unique(names).to_pylist():
                kept.setdefault(lang, []).append(some.filter(pc.equal(names, lang)))
            size += int(pc.sum(pc.binary_length(some)).as_py())
            if size >= most:
                yield from flush()
                size = 0
    yield from flush()


def frequent_pairs(docs: DataFrame, least: int, most_bits: int = MOST_BITS, shard: int = SHARD_BYTES) -> np.ndarray:
    """A filter of the pairs of words that occur `least` times: bit (key mod bits) of each one's key is set.

    Some bits stand for pairs that are rarer; the phrases' own counts decide. Only the filter comes to the driver, of a
    size that follows the number of frequent pairs up to most_bits; a full one only prunes less.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in _by_lang(batches, shard):
            words, ids, room = word_ids(data)
            order = suffix_array(ids, room, 2)
            first, count = intervals(order, common_words(ids, room, order, 2), room, 2)
            yield pa.RecordBatch.from_arrays([pa.array(_pair_keys(words, lang, ids, order[first]).view(np.int64)), pa.array(count.astype(np.int64))], names=["key", "n"])

    counts = docs.select("lang", "text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    often = written(counts.filter(F.col("n") >= least).select("key"), "pairs")
    bits = LEAST_BITS
    wanted = BITS_EACH * often.count()
    while bits < min(wanted, most_bits):
        bits *= 2
    place = often.select(F.col("key").bitwiseAND(F.lit(bits - 1)).alias("at"))
    rows = place.groupBy(F.expr(f"at div {ROW_BITS}").alias("row")).agg(F.expr(f"bitmap_construct_agg(at % {ROW_BITS})").alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.collect():
        out[r["row"] * ROW_BITS // 8 :][: ROW_BITS // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    forget(often)
    return out


def count_phrases(docs: DataFrame, least: int = LEAST, shard: int = SHARD_BYTES, most_bits: int = MOST_BITS) -> DataFrame:
    """(lang, k, phrase, f): words (k 1) and phrases of 2 to WORDS words that occur `least` times, and each lang's words in
    all (k 0, an empty phrase).

    A phrase that is frequent has frequent pairs only, so shards send no other; each shard sends a phrase once, with its count.
    """
    filter_ = frequent_pairs(docs, least, most_bits, shard)
    mask = np.uint64(len(filter_) * 8 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in _by_lang(batches, shard):
            words, ids, room = word_ids(data)
            if not len(ids):
                continue
            order = suffix_array(ids, room)
            shared = common_words(ids, room, order)
            first, count = intervals(order, shared, room, 2)
            key = _pair_keys(words, lang, ids, order[first]) & mask
            often = (filter_[(key >> np.uint64(3)).astype(np.int64)] >> (key & np.uint64(7)).astype(np.uint8)) & 1 > 0
            pair = np.zeros(len(ids) + WORDS, bool)  # by position: a frequent pair begins there
            within = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
            pair[order[within]] = np.repeat(often, count)
            made = [(0, pa.array([""], pa.large_string()), np.array([len(ids)]))]
            for k in range(1, WORDS + 1):
                first, count = intervals(order, shared, room, k)
                at = order[first]
                keep = np.ones(len(at), bool)
                for step in range(k - 1):
                    keep &= pair[at + step]
                at = at[keep]
                parts = [words.take(pa.array(ids[at + step])) for step in range(k)]
                made.append((k, parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())), count[keep]))
            for k, phrase, n in made:
                for part in range(0, len(n), 1 << 16):  # small batches for the JVM
                    p, c = phrase.slice(part, 1 << 16), n[part : part + (1 << 16)].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(p), pa.string()), pa.array(np.full(len(p), k, np.int32)), p.cast(pa.string()), pa.array(c)], names=["lang", "k", "phrase", "n"])

    sent = docs.select("lang", "text").mapInArrow(run, "lang string, k int, phrase string, n long")
    return sent.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("f")).filter((F.col("f") >= least) | (F.col("k") == 0))


def wide(x: F.Column | str) -> F.Column:
    """A count as a decimal, whose products stay exact."""
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, shard: int = SHARD_BYTES, most_bits: int = MOST_BITS) -> DataFrame:
    """The `top` phrases of each language by the score of their weakest cut: lang, rank, phrase, a, l, r, n, score.

    Null texts are empty and null langs `und`; rows that repeat count each time, and ids play no part. Equal scores stand
    by count, then by phrase. A table without frequent phrases gives an empty result; a phrase never crosses a text.
    """
    grams = written(count_phrases(docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")), least, shard, most_bits), "phrases")
    counts = grams.filter("k > 0")
    words = F.split("phrase", " ")
    cuts = counts.filter("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    left, right = F.array_join(F.slice(words, F.lit(1), F.col("cut")), " "), F.array_join(F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")), " ")
    of = lambda name, value: counts.select(F.col("lang"), F.col("phrase").alias(name), F.col("f").alias(value))
    cuts = cuts.withColumns({"_left": left, "_right": right}).join(of("_left", "l"), ["lang", "_left"]).join(of("_right", "r"), ["lang", "_right"])
    cuts = cuts.withColumns({"_a": F.lit(2_000_000).cast("decimal(7,0)") * wide("a"), "_of": wide("l") + wide("r")})
    weakest = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(F.expr("_a div _of").alias("score"), "cut", "l", "r")).alias("_cut"))
    inner = F.explode(F.array(F.array_join(F.slice(words, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("k") - 1), " ")))
    longer = counts.filter("k > 2").select("lang", inner.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    # a phrase inside one that is longer by two words is also inside the one between, which is at least as frequent
    kept = weakest.join(longer, ["lang", "phrase"], "left").filter(F.col("_longer").isNull() | (5 * wide("_longer") < 4 * wide("a")))
    rows = kept.select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*best))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    totals = grams.filter("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first collocations; edge cases are those of collocations()."""
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = f"""with pieces as materialized (
  select coalesce(lang, 'und') as lang, row_number() over () as piece, list_filter(regexp_split_to_array(t, '[ \\t]+'), lambda w: w <> '') as w
  from (select lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as t from documents)),
grams as materialized (
  select lang, k, phrase, count(*) as f from (
    select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase from (select lang, w, unnest(range(1, len(w) + 1)) as i from pieces), range(1, {WORDS + 1}) t(k) where i + k - 1 <= len(w)) group by all),
totals as (select lang, sum(f) as n from grams where k = 1 group by lang),
often as materialized (select *, string_split(phrase, ' ') as w from grams where f >= {LEAST}),
cuts as (select c.lang, c.phrase, c.k, c.f as a, l.f as l, r.f as r, cut, (2000000::hugeint * c.f) // (l.f + r.f) as score
  from (select *, unnest(range(1, k)) as cut from often where k > 1) c
  join often l on l.lang = c.lang and l.phrase = array_to_string(c.w[1 : cut], ' ') join often r on r.lang = c.lang and r.phrase = array_to_string(c.w[cut + 1 : c.k], ' ')),
weakest as materialized (select * from (select *, row_number() over (partition by lang, phrase order by score, cut) as o from cuts) where o = 1),
inside as (select distinct s.lang, s.phrase from often s join (select lang, f, k, unnest(list_distinct(list_concat([array_to_string(w[i : i + 1], ' ') for i in range(1, k)], [array_to_string(w[i : i + 2], ' ') for i in range(1, k - 1)]))) as phrase from often where k > 2) b
  on b.lang = s.lang and b.phrase = s.phrase and b.k > s.k and 100 * b.f >= 80 * s.f),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from weakest anti join inside using (lang, phrase))
select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score from ranked join totals using (lang) where rank <= {TOP}"""
