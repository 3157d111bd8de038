"""Operators that work text by text, against plain versions of what they must return."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from fedspark.llm import packing, pii, quality, secrets, sharding, spm_codec

from .cases import by_id, documents, empty, texts

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_quality_counts(spark):
    got = by_id(quality.quality_rules(documents(spark)))
    for i, text in enumerate(texts()):
        text = text or ""
        words = WORD.findall(text)
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        hit = {j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text)), text[:50]
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(hit)), text[:50]
        assert r.base_failed == (len(words) < 10 or 100 * len(hit) > 20 * len(words))
        assert not (r.kept and r.base_failed)
    assert quality.quality_rules(empty(spark)).count() == 0


def test_quality_bands(spark):
    import random

    rng = random.Random(1)
    noise = " ".join("".join(chr(rng.randrange(33, 127)) for _ in range(9)) for _ in range(800))
    few = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]) for _ in range(40))
    got = by_id(quality.quality_rules(documents(spark, [noise, texts()[-6], few])))
    assert [got[i].kept for i in range(3)] == [False, True, True]


def test_quality_measures_every_chunk(spark):
    prose = texts()[-6]
    rest = base64.b64encode(b"".join(hashlib.sha512(bytes([k])).digest() for k in range(48))).decode()
    chunk = lambda text, n: text.encode()[:n].decode(errors="ignore")
    values = [chunk(prose, 4200) + rest[:3800], chunk(prose, 4200) + "one line again. " * 230, chunk(prose, 7000), chunk(prose, 4000)]
    got = by_id(quality.quality_rules(documents(spark, values)))
    assert [(got[i].n_chunks, got[i].n_bad_chunks) for i in range(4)] == [(2, 1), (2, 1), (2, 0), (0, 0)]
    assert [got[i].kept for i in range(4)] == [False, False, True, True]


def plain_kept(values: list) -> list:
    """kept by a plain reading of the rules, bands fitted to the table included."""
    import math

    import zstandard

    press = zstandard.ZstdCompressor(level=quality.LEVEL)
    ratio = lambda data: len(data) / len(press.compress(data))
    passed, by_class = [], {}
    for text in values:
        words = WORD.findall(text or "")
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        hit = {j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
        passed.append(len(words) >= 10 and 100 * len(hit) <= 20 * len(words))
        if passed[-1]:
            data = text.encode()
            by_class.setdefault(int(2 * math.log2(len(data))), []).append(min(int(100 * ratio(data)), 2000))
    texts, centre, spread = {}, {}, {}
    for kind, found in by_class.items():
        first, centre[kind], third = (sorted(found)[math.ceil(q * len(found)) - 1] / 100 + 0.005 for q in (0.25, 0.5, 0.75))
        texts[kind], spread[kind] = len(found), (third - first) / 1.349

    def fitted(kind):
        say = {k: n / 2 ** abs(k - kind) for k, n in texts.items() if k != kind}
        if say:
            mean = lambda of: sum(say[k] * of(k) for k in say) / sum(say.values())
            at, level = mean(lambda k: k), mean(centre.get)
            heard = sum(say.values())
            rise = heard * mean(lambda k: (k - at) * (centre[k] - level)) / (heard * mean(lambda k: (k - at) ** 2) + 1)
            line = lambda k: level + rise * (k - at)
            foretold, doubt = line(kind), mean(lambda k: spread[k] ** 2 + (centre[k] - line(k)) ** 2) + (rise * (kind - at) / 2) ** 2
            doubt = (heard * doubt + 0.0625 * (1 + mean(lambda k: abs(k - kind)))) / (heard + 1)
        else:
            foretold, doubt = centre[kind], 0.0625
        n, prior = texts.get(kind, 0), min(sum(say.values()) + 1, quality.PRIOR_TEXTS)
        middle = (n * centre.get(kind, 0) + prior * foretold) / (n + prior)
        reach = max(quality.SPREADS * math.sqrt((n * spread.get(kind, 0) ** 2 + prior * doubt) / (n + prior)), quality.NARROWEST * middle)
        return middle - reach, middle + reach

    def inside(data):
        low, high = next((low, high) for least, low, high in reversed(quality.BANDS) if len(data) >= least)
        own = fitted(int(2 * math.log2(len(data))))
        return max(low, own[0]) <= ratio(data) <= min(high, own[1])

    out = []
    for text, ok in zip(values, passed):
        data = (text or "").encode()
        chunks = [data[k : k + 4096] for k in range(0, len(data), 4096)] if len(data) >= 4096 else []
        if len(chunks) > 2 and len(chunks[-1]) < quality.SHORT:
            chunks[-2:] = [chunks[-2] + chunks[-1]]
        out.append(ok and inside(data) and sum(not inside(c) for c in chunks) <= 0.3 * len(chunks))
    return out


def test_quality_bands_follow_the_table(spark):
    import random

    rng = random.Random(4)
    syllables = ["th", "an", "er", "on", "in", "the", "ou", "ti", "ed", "re", "st", "ly"]
    prose = lambda n: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))
    marked = lambda n: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) + rng.choice(["###", "$$$"]) + " |" for _ in range(n))
    noise = lambda n: base64.b64encode(rng.randbytes(n)).decode()
    values = [prose(rng.randint(200, 220)) for _ in range(400)] + [marked(115), " ".join(noise(9) for _ in range(100)), prose(900) + " " + noise(3000), None, "", prose(5000)]
    got = by_id(quality.quality_rules(documents(spark, values)))
    kept = [got[i].kept for i in range(len(values))]
    assert kept == plain_kept(values)
    assert all(kept[:400]) and kept[400:] == [False, False, False, False, False, True]
    assert not any(got[i].base_failed for i in (400, 401, 402))  # the bands alone reject these
    whole = documents(spark, values)
    assert sorted(r.doc_id for r in quality.keep_good(whole).collect()) == [i for i, k in enumerate(kept) if k]
    assert quality.keep_good(whole).schema == whole.schema


@pytest.mark.parametrize("n", [25, 100, 800])
def test_quality_bands_do_not_hang_on_the_tables_size(spark, n):
    import random

    rng = random.Random(n)
    syllables = ["th", "an", "er", "on", "in", "the", "ou", "ti", "ed", "re", "st", "ly"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    prose = [" ".join(word() for _ in range(int(30 * 2 ** rng.uniform(0, 6)))) for _ in range(n)]
    dense = " ".join(base64.b64encode(rng.randbytes(9)).decode() for _ in range(200))
    ring = [word() for _ in range(9)]
    loop = " ".join(ring[rng.randrange(9)] for _ in range(800))  # few windows of five words come twice: some words in 59,049
    values = prose + [dense, loop]
    got = by_id(quality.quality_rules(documents(spark, values)))
    assert [got[i].kept for i in range(len(values))] == plain_kept(values)
    assert all(got[i].kept for i in range(n))
    assert not got[n].base_failed and not got[n + 1].base_failed and not got[n].kept and not got[n + 1].kept


def test_bands_of_lengths_without_texts():
    assert quality.bands_of({}) == {}
    one = quality.bands_of({(20, 190): 3})
    assert len(one) == quality.CLASSES and all(low < 1.905 < high for low, high in one.values())
    few, many = (quality.bands_of({(k, 100 + 5 * k + d): n for k in (18, 19, 20, 21) for d in (-1, 0, 1)}) for n in (1, 10_000))
    assert all(low < 1.005 + 0.05 * k < high for f in (few, many) for k, (low, high) in f.items())
    assert many[30][1] - many[30][0] > many[24][1] - many[24][0] > many[20][1] - many[20][0]


def test_repeated_windows_of_one_hash(monkeypatch):
    import numpy as np

    monkeypatch.setattr(quality, "mix64", lambda x: x & np.uint64(3))
    codes = np.array([1, 2, 3, 4, 5, 9, 1, 2, 3, 4, 5, 7, 7, 7, 7, 7, 7])
    assert quality.repeated_window_words(codes, np.array([11, 6])).tolist() == [10, 6]


BASE_PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def test_personal_data(spark):
    values = texts() + ["phone number 030 1234567 8, price $ 4930 1234567", "9" * 3000 + "@" + "a" * 3000, "1 " * 5000]
    got = by_id(pii.find_personal_data(documents(spark, values)))
    for i, text in enumerate(values):
        want = [(kind, m.start(), m.end()) for kind, (p, ok) in BASE_PII.items() for m in re.finditer(p, text or "") if ok(m[0])]
        assert [tuple(s) for s in got[i]["base"]] == want, text and text[:60]
        assert [tuple(s) for s in got[i]["spans"]][: len(want)] == want
        assert got[i]["n"] == 1  # other columns stay
    assert pii.find_personal_data(empty(spark)).count() == 0


def test_mask(spark):
    from pyspark.sql import functions as F

    found = pii.find_personal_data(documents(spark, ["é a@b.c 10.0.0.1 x", "none", None]).withColumn("kept_text", F.col("text")))
    got = by_id(found.withColumn("kept_text", pii.mask(F.col("kept_text"), F.col("spans"))))
    assert [got[i]["kept_text"] for i in range(3)] == ["é <EMAIL> <IP> x", "none", None]


BASE_SECRETS = [
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def test_secrets(spark):
    got = by_id(secrets.scan_secrets(documents(spark)))
    for i, text in enumerate(texts()):
        want = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE_SECRETS) for m in p.finditer(text or "") if ok(m))
        want = [(BASE_SECRETS[k][0], a, b) for a, k, b in want]
        assert [tuple(s) for s in got[i]["base"]] == want
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert set(want) <= {tuple(s) for s in got[i]["spans"]}
        more = [s for s in got[i]["spans"] if s["kind"] == "random"]
        assert bool(more) == ("q9XfT2Lm" in (text or "")), (text, more)
    assert secrets.scan_secrets(empty(spark)).count() == 0


def test_secrets_after_names_and_in_mixed_runs(spark):
    code = "q9XfT2LmZ8aVw3Kc7RjY5tHbN1sDpE6u0GoIvQxM"
    padded = base64.b64encode(hashlib.sha512(b"key1").digest()).decode().rstrip("=")
    assert "+" in padded and "/" in padded
    values = [f"auth={code}", f"AccountKey={padded}==", f"see https://a.b/?key={code}&x=1", f"backup-of_the-old/{code}", f"my-key_is-{padded} here", "a quiet line"]
    got = by_id(secrets.scan_secrets(documents(spark, values)))
    want = [code, padded + "==", code, code, padded]
    for i, found in enumerate(want):
        at = values[i].index(found)
        (span,) = got[i]["spans"]
        # a code without separators of its own may take in the path's last word, never lose a part
        assert span["kind"] == "random" and span["end"] == at + len(found) and at - (4 if i == 3 else 0) <= span["start"] <= at, values[i]
    assert got[5]["spans"] == []


def test_labelers_are_weighed_and_decide(spark):
    """Spans that the labelers should know, and look-alikes that they should not, among base spans that teach them."""
    import random

    rng = random.Random(2)
    digits = lambda n: "".join(rng.choices("123456789", k=n))
    teach = [f"call +1 ({digits(3)}) 555-{digits(4)} or mail ann{k}@mail.example.com at 10.{k % 250}.3.4 today" for k in range(150)]
    decoys = [f"lot {digits(15)}0 of part{digits(7)}x in row {digits(6)}" for _ in range(60)]
    decoys = [t for t in decoys if not any(ok(m[0]) for p, ok in BASE_PII.values() for m in re.finditer(p, t))]
    more = {"write to ann (at) mail (dot) com soon": "spelled", "pay to DE89 3704 0044 0532 0130 00 please": "iban", "so said Mrs. Anna Novak then": "name", "she lives at 12 Long Hill Road now": "address"}
    values = teach + decoys + list(more) + ["pay to DE00 3704 0044 0532 0130 00 please", "a plain line of words"]
    got = by_id(pii.find_personal_data(documents(spark, values)))
    added = [[s["kind"] for s in got[i]["spans"][len(got[i]["base"]) :]] for i in range(len(values))]
    at = len(teach) + len(decoys)
    assert added[at : at + 4] == [[kind] for kind in more.values()]
    assert not any(added[:at]) and not any(added[at + 4 :])


def test_reliabilities_by_em():
    import random

    rng = random.Random(1)
    truth = {True: (0.9, 0.7, 0.5, 0.8, 0.6), False: (0.05, 0.2, 0.3, 0.1, 0.5)}
    votes = Counter(tuple(1 if rng.random() < p else -1 for p in truth[rng.random() < 0.3]) for _ in range(20000))
    prior, given = pii.fit_reliabilities(dict(votes))
    assert abs(prior - 0.3) < 0.04
    for k, labeler in enumerate(pii.LABELERS):
        assert abs(given[labeler, 1][0] - truth[True][k]) < 0.05 and abs(given[labeler, 1][1] - truth[False][k]) < 0.05
    assert pii.fit_reliabilities({})[0] == 0.5


def test_columns_of_like_names_stay(spark):
    df = spark.createDataFrame([(1, "mail a@b.c", "own", 7, 8)], "doc_id long, text string, email string, number int, base int")
    (row,) = pii.find_personal_data(df).collect()
    assert (row["email"], row["number"], [s["kind"] for s in row["base"]]) == ("own", 7, ["email"])


def test_battery_tells_text_from_codes():
    assert secrets.guess_bin("aaaaaaaaaaaaaaaaaaaaaaaaaa1") is None
    assert secrets.guess_bin("thisisjustalongwordwithoutdigits") is None
    assert secrets.guess_bin("q9XfT2LmZ8aVw3Kc7RjY5tHbN1sDpE6u0GoIvQxM") > 40
    assert secrets.discovery({})[1] > 1000 and secrets.discovery({(100, 20): 5, (0, 20): 5})[1] == 5


def test_discoveries_equal_those_of_a_plain_procedure():
    import math
    import random

    rng = random.Random(5)
    drawn = [(rng.choice([0, 1, 3, 8, 20, 60, 90]), rng.randint(17, 30)) for _ in range(300)]
    mean, least = secrets.discovery(Counter(drawn), 0.05)
    weights = [2 ** (kind / 4) for _, kind in drawn]
    scaled = [w * len(drawn) / sum(weights) for w in weights]
    p = [10 ** (-b / 20) / w for (b, _), w in zip(drawn, scaled)]
    ranked = sorted(p)
    accepted = max((x for k, x in enumerate(ranked) if x <= 0.05 * (k + 1) / len(p)), default=-1)
    found = [b / 20 + math.log10(2 ** (kind / 4) / mean) >= least - 1e-9 for b, kind in drawn]
    assert found == [x <= accepted * (1 + 1e-9) for x in p] and 0 < sum(found) < len(p)


def test_battery_alone_finds_what_is_random(spark):
    import random

    rng = random.Random(9)
    words = lambda n: " ".join(rng.choice(["alpha", "beta7", "gamma", "delta", "release-notes-2024-final-version", "zzzzzzzzzz1zzzzzzzzzzzz", "path/to/the/file2/of/this/thing"]) for _ in range(n))
    code = lambda n: "".join(rng.choices(secrets.ALPHABETS["base62"], k=n))
    values = [words(30) for _ in range(60)] + [words(9) + " " + code(44) + " " + words(9) for _ in range(40)]
    got = by_id(secrets.scan_secrets(documents(spark, values)))
    hits = [bool([s for s in got[i]["spans"] if s["kind"] == "random" and s["end"] - s["start"] == 44]) for i in range(100)]
    assert not any(hits[:60]) and sum(hits[60:]) >= 38
    assert not any(got[i]["spans"] for i in range(60)) and not any(got[i]["base"] for i in range(100))


def test_agenda_needs_no_mending():
    import random

    rng = random.Random(7)
    vocabulary = spm_codec.MergeVocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    encoder = spm_codec.CheckedEncoder(vocabulary)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEéßüñ0123456789.,-_@#&"
    words = {w for t in texts() for w in spm_codec.words_of(t or "")} | {"".join(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(5000)}
    encoder(sorted(w for w in words if w))
    assert encoder.mended == 0


def test_sentencepiece(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(spm_codec.encode_decode(documents(spark), path, with_ids=True))
    for i, text in enumerate(texts()):
        ids = sp.encode(text or "", add_eos=True)
        assert got[i]["ids"] == ids, text and text[:60]
        assert got[i]["n_tokens"] == len(ids) and got[i]["decoded"] == sp.decode(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert spm_codec.encode_decode(empty(spark), path).count() == 0


def test_agenda_without_the_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    v, sp = spm_codec.MergeVocabulary(path), sentencepiece.SentencePieceProcessor(model_file=path)
    words = list(dict.fromkeys(w for t in texts() if t for w in t.split(" ") if w))
    flat, sizes = v.encode_words(words)
    ends = sizes.cumsum()
    assert [flat[b - n : b].tolist() for n, b in zip(sizes, ends)] == [sp.encode(w) for w in words]


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    values = texts()
    rows = packing.pack(documents(spark), path, window=256, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(values):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert sum((r.ids for r in pieces), []) == ids, text and text[:60]
        assert [r.start for r in pieces] == [sum(len(q.ids) for q in pieces[:k]) for k in range(len(pieces))]
        for r in pieces:
            assert r.doc_tokens == len(ids) and r.length == len(r.ids)
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r.ids))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    used = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
        used += at
    assert len(by_sequence) <= used // 256 + 2
    assert packing.pack(empty(spark), path).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_plan_packs_as_one_by_one(seed):
    import random

    rng = random.Random(seed)
    window = 64
    lengths = [rng.choice([1, 3, 9, 20, 21, 33, 40, 64]) if rng.random() < 0.7 else rng.randint(1, 64) for _ in range(rng.choice([5, 50, 700]))]
    runs = packing.best_fit_plan(Counter(lengths), window)
    free = []  # one document at a time
    for n in sorted(lengths, reverse=True):
        fit = min((c for c in free if c >= n), default=None)
        if fit is None:
            free.append(window - n)
        else:
            free[free.index(fit)] = fit - n
    held: dict = {}
    for length, _, many, first, each, offset in runs:
        for k in range(many):
            held.setdefault(first + k // each, []).append((offset + k % each * length, length))
    assert sorted(n for x in held.values() for _, n in x) == sorted(lengths)
    for x in held.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= window
    assert len(held) == len(free) and sorted(held) == list(range(len(held)))


def test_sharding(spark):
    values = texts(n=300)
    rows = sharding.interleave(documents(spark, values), 8).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(values)))
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 8
    for shard in sizes:
        assert sorted(r.slot for r in rows if r["shard"] == shard) == list(range(sizes[shard]))
    for source, n in Counter(r.source for r in rows).items():
        per = Counter(r["shard"] for r in rows if r.source == source)
        assert all(abs(per[k] - n / 8) <= 1.5 for k in range(8)), (source, per)
    for r in rows:
        data = (values[r.doc_id] or "").encode()
        assert r["size"] == len(data) + 1 and r.text_crc32 == zlib.crc32(data)
    again = sharding.interleave(documents(spark, values).repartition(7), 8).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert sharding.interleave(empty(spark)).count() == 0
    assert sorted((r["shard"], r.slot) for r in sharding.interleave(documents(spark, ["a", "a", None]), 8).collect()) == [(0, 0), (2, 0), (5, 0)]


def test_sharding_order_by_brute_force(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 5)
    monkeypatch.setattr(sharding, "RUN", 4)
    values = texts(n=150)
    docs = documents(spark, values)
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.lit(42), F.col("doc_id").cast("long")).alias("h")).collect()}
    rows = [(r.source, hashes[r.doc_id], r.doc_id) for r in docs.collect()]
    by_source = {}
    for source, h, doc in sorted(rows, key=lambda r: (str(r[0]), (r[1] % (1 << 64)) >> 33, r[1])):
        by_source.setdefault(source, []).append((h, doc))
    shares = [((k + 0.5) / len(own), "" if source is None else source, h, doc) for source, own in by_source.items() for k, (h, doc) in enumerate(own)]
    n, want = len(shares), []
    for place, (*_, doc) in enumerate(sorted(shares)):
        shard = place * 8 // n
        want.append((doc, shard, place - -(-shard * n // 8)))
    got = [(r.doc_id, r["shard"], r.slot) for r in sharding.interleave(docs, 8).collect()]
    assert sorted(got) == sorted(want)


def test_repeated_and_null_ids_and_long_texts(spark):
    """Every operator on texts keeps rows with one doc_id, or none, apart, and takes texts beyond any of its slices."""
    long = "long words of a text " * 8000 + "mail last@one.org token = abcdef1234"
    rows = [(1, "first text of one mail a@b.c"), (1, "second text of one, token = qwerty99"), (None, "no id here 10.1.2.3"), (None, None), (1, "first text of one mail a@b.c"), (2, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' as source").repartition(2)
    key = lambda r: (r is None, r or 0)
    ids = sorted((i for i, _ in rows), key=key)
    found = pii.find_personal_data(docs).collect()
    assert sorted((len(r.base) for r in found)) == [0, 0, 1, 1, 1, 1]
    assert sorted((r.doc_id for r in found), key=key) == ids
    found = secrets.scan_secrets(docs).collect()
    assert sorted(len(r.base) for r in found) == [0, 0, 0, 0, 1, 1] and sorted((r.doc_id for r in found), key=key) == ids
    found = quality.quality_rules(docs).collect()
    assert sorted(r.n_words for r in found) == sorted(len(WORD.findall(t or "")) for _, t in rows)
    path = public_tokenizers.path("piece_bpe_32k.model")
    found = spm_codec.encode_decode(docs, path, with_ids=True).collect()
    assert sorted(r.decoded for r in found) == sorted(t or "" for _, t in rows)
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted((r.doc_id for r in pieces if r.start == 0), key=key) == ids and sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)
    found = sharding.interleave(docs, 2).collect()
    assert sorted((r.doc_id for r in found), key=key) == ids and sorted((r["shard"], r.slot) for r in found) == [(a, b) for a in range(2) for b in range(3)]


def test_a_memo_looks_known_strings_up_once():
    from fedspark.llm.common import Memo

    class Counted(str):
        hashed = 0

        def __hash__(self):
            Counted.hashed += 1
            return str.__hash__(self)

    asked = []

    def lengths(strings):
        asked.append(strings)
        return np.concatenate([np.full(len(s), len(s), np.int32) for s in strings]), np.array([len(s) for s in strings])

    memo = Memo(lengths, 4)
    for given in (["a", "bb", "a"], ["bb", "ccc", "a", "ccc"], ["dddd", "ccc", "ee", "dddd"], ["ee", "dddd"]):
        starts, sizes = memo(given)
        assert [memo.flat[s : s + n].tolist() for s, n in zip(starts, sizes)] == [[len(x)] * len(x) for x in given]
    assert asked == [["a", "bb"], ["ccc"], ["dddd", "ccc", "ee"]]  # the third would have held more than four
    memo([Counted("ee"), Counted("dddd"), Counted("ccc")])
    assert Counted.hashed == 3 and len(asked) == 3
