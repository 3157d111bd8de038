"""Secret scans: fixed patterns, and a battery of randomness tests with a length-aware false-discovery rate."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_slices, with_columns, written

KINDS = ("assign", "access", "hex", "random")
#: (kind, quick test by RE2, exact pattern, group and its least length)
BASE = (
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 6),
    ("access", r"AKIA[A-Z0-9]{16}", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", r"[0-9a-f]{24}", re.compile(r"[0-9a-f]+"), 0, 24),
)
LEAST = 20
#: '=' stands only at a candidate's end, as padding, so a name and its '=' are no part of the value.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST)
#: Where a run that fits no alphabet, as it mixes both pairs of separators, is cut into candidates: by either pair, or both.
CUTS = tuple(re.compile(r"[%s]{%d,}={0,2}" % (chars, LEAST)) for chars in ("A-Za-z0-9+/", "A-Za-z0-9_-", "A-Za-z0-9"))
#: Alphabets in which a string's symbols are numbered, by the encoding inferred from its characters.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
NUMBERS = {name: {c: i for i, c in enumerate(chars)} for name, chars in ALPHABETS.items()}
#: Chance that two letters of running text are alike, from which text's distance from uniform follows.
TEXT_REPEATS = 0.065
LEVEL = 1e-3  # each test of the battery must not reject randomness at this level
FDR = 0.01
BINS_PER_DECADE, MOST_DECADES = 20, 60
#: Lengths are weighed by classes, so many for each doubling.
CLASSES_PER_DOUBLING = 4

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
GUESS = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("bin", pa.int32())])
SCHEMA = "doc_id long, base array<struct<kind:string,start:int,end:int>>, base_sha256 string, guesses array<struct<start:int,end:int,bin:int>>"


def infer_encoding(text: str) -> str | None:
    """The narrowest alphabet of a string that mixes classes of characters as codes do; None for words and plain numbers."""
    body = text.rstrip("=")
    has = [any(a <= c <= b for c in body) for a, b in (("0", "9"), ("a", "z"), ("A", "Z"))]
    if not has[0] or not (has[1] or has[2]):
        return None
    lower = body.lower()
    if (body == lower or body == body.upper()) and all(c in NUMBERS["hex"] for c in lower):
        return "hex"
    for name in ("base32", "base62", "base64", "base64url"):
        if all(c in NUMBERS[name] for c in body):
            return name
    return None


def battery(text: str, encoding: str) -> tuple[float, float, float, float]:
    """p of text-like repetition, and of uniformity, runs and serial correlation under randomness.

    The first is the chance that text of this length would spread over the alphabet as evenly as this string does.
    """
    body = text.rstrip("=")
    x = np.array([NUMBERS[encoding][c] for c in (body.lower() if encoding == "hex" else body)], float)
    n, k = len(x), len(ALPHABETS[encoding])
    seen = np.bincount(x.astype(int), minlength=k)
    chi2 = float(((seen - n / k) ** 2).sum() / (n / k))
    far = n * max(k * TEXT_REPEATS - 1, 0.5)
    below = _normal((chi2 - (k - 1 + far)) / math.sqrt(2 * (k - 1 + 2 * far)))
    uniform = 1 - _normal(((chi2 / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1))))
    above = x >= (k / 2)
    a, b = int(above.sum()), int((~above).sum())
    if a and b:
        runs, mean = 1 + int((above[1:] != above[:-1]).sum()), 2 * a * b / n + 1
        spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        p_runs = 2 * (1 - _normal(abs(runs - mean) / spread))
    else:
        p_runs = 0.0
    centred = x - x.mean()
    total = float((centred**2).sum())
    serial = float((centred[1:] * centred[:-1]).sum()) / total * math.sqrt(n) if total else math.inf
    return below, uniform, p_runs, 2 * (1 - _normal(abs(serial)))


def _normal(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def guess_bin(text: str) -> int | None:
    """The bin of a string's p, in twentieths of a decade from 1 downward; None where a test rejects."""
    encoding = infer_encoding(text)
    if encoding is None:
        return None
    below, *random = battery(text, encoding)
    if min(random) < LEVEL:
        return None
    return int(min(max(-math.log10(max(below, 1e-300)), 0), MOST_DECADES) * BINS_PER_DECADE)


def guessed(text: str, start: int = 0) -> list[tuple[int, int, int]]:
    """(start, end, bin) of a run's candidates that the battery passes: the run, or its parts by the cut with the likeliest code."""
    if not (("+" in text or "/" in text) and ("-" in text or "_" in text)):
        found = guess_bin(text)
        return [] if found is None else [(start, start + len(text), found)]
    ways = [[(start + m.start(), start + m.end(), b) for m in cut.finditer(text) if (b := guess_bin(m[0])) is not None] for cut in CUTS]
    return max(ways, key=lambda way: max((b for *_, b in way), default=-1))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch):
            texts = part.column("text")
            n = len(texts)
            base: list[list] = [[] for _ in range(n)]
            guesses: list[list] = [[] for _ in range(n)]
            for order, (kind, quick, exact, group, least) in enumerate(BASE):
                for k in np.flatnonzero(pc.match_substring_regex(texts, quick).to_numpy(zero_copy_only=False)).tolist():
                    for m in exact.finditer(texts[k].as_py()):
                        if len(m[group]) >= least:
                            base[k].append((m.start(), order, m.end()))
            for k in np.flatnonzero(pc.match_substring_regex(texts, r"[A-Za-z0-9+/_-]{%d}" % LEAST).to_numpy(zero_copy_only=False)).tolist():
                taken = sorted((a, b) for a, _, b in base[k])
                at = 0
                for m in CANDIDATE.finditer(texts[k].as_py()):
                    while at < len(taken) and taken[at][1] <= m.start():
                        at += 1
                    if not any(a < m.end() and m.start() < b for a, b in taken[at : at + len(BASE) + 1]):
                        guesses[k] += [{"start": a, "end": b, "bin": found} for a, b, found in guessed(m[0], m.start())]
            for spans in base:
                spans.sort()
            rows = [[{"kind": KINDS[o], "start": a, "end": b} for a, o, b in spans] for spans in base]
            digest = [hashlib.sha256(",".join(f"{KINDS[o]}:{a}:{b}" for a, o, b in spans).encode()).hexdigest() for spans in base]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(rows, pa.list_(SPAN)), pa.array(digest, pa.string()), pa.array(guesses, pa.list_(GUESS))], names=["doc_id", "base", "base_sha256", "guesses"]
            )


def length_weight(kind: int) -> float:
    """The weight of a length class: longer strings say more, so they get the larger share of the error rate."""
    return 2.0 ** (kind / CLASSES_PER_DOUBLING)


def discovery(counts: dict[tuple[int, int], int], rate: float = FDR) -> tuple[float, float]:
    """(mean weight, least score) by the procedure of Benjamini and Hochberg with weights of mean 1, over counts of (bin,
    length class). A string's score is -log10 of its p over its weight; infinity where none is accepted."""
    total = sum(counts.values())
    mean = sum(n * length_weight(kind) for (_, kind), n in counts.items()) / total if total else 1.0
    scores: dict[float, int] = {}
    for (b, kind), n in counts.items():
        score = b / BINS_PER_DECADE + math.log10(length_weight(kind) / mean)
        scores[score] = scores.get(score, 0) + n
    so_far, least = 0, math.inf
    for score in sorted(scores, reverse=True):
        so_far += scores[score]
        if 10**-score <= rate * so_far / total:
            least = score
    return mean, least


def scan_secrets(docs: DataFrame, rate: float = FDR) -> DataFrame:
    """Finds secrets in the whole texts of docs (doc_id, text), in one pass over the texts.

    Base spans (assign, access, hex) are leftmost and don't overlap within a kind; all stay. Strings of 20 characters
    or more ('=' only as padding at their end; runs that mix '+' or '/' with '-' or '_' by their parts) that mix digits and
    letters and touch no base span go through the battery in the alphabet of their encoding:
    chi-squared uniformity, runs and serial correlation must not reject randomness, and the chance that text of that
    length looks so even is held to the false-discovery rate `rate` over all such strings of the table, longer ones
    with more weight; they become spans of kind random. Returns doc_id, base and spans (kind, start, end in code points,
    end exclusive, by start and then kind) and base_sha256. A null text counts as empty; repeated rows get equal spans;
    a null doc_id stays null; an empty table gives an empty one; other columns aren't read.
    """
    found = written(with_columns(docs, {"doc_id": "long", "text": "string"}).mapInArrow(_scan, SCHEMA), "secrets")
    kind = lambda g: F.floor(F.log2(g["end"] - g["start"]) * CLASSES_PER_DOUBLING).cast("int")
    bins = found.select(F.explode("guesses").alias("g")).select("g.bin", kind(F.col("g")).alias("kind")).groupBy("bin", "kind").agg(F.count(F.lit(1)).alias("n"))
    mean, least = discovery({(r["bin"], r["kind"]): r["n"] for r in bins.collect()}, rate)  # at most 1201 bins of 120 length classes
    score = lambda g: g["bin"] / BINS_PER_DECADE + (kind(g) / CLASSES_PER_DOUBLING) * math.log10(2) - math.log10(mean)
    order = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    random = F.transform(F.filter("guesses", lambda g: score(g) >= least - 1e-9), lambda g: F.struct(F.lit("random").alias("kind"), g["start"].alias("start"), g["end"].alias("end")))
    keyed = F.array_sort(F.transform(F.concat("base", random), lambda s: F.struct(s["start"].alias("start"), order(s).alias("order"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return found.select("doc_id", "base", "base_sha256", F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def op9_secrets(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *(count(k) for k in KINDS[:3]), "base_sha256", joined.alias("spans"))
