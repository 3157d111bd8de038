"""Archives and their index, codes of vectors, and collocations, against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from fedspark.llm import codes, phrases, warc


def of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


# archives


def test_loser_tree():
    rng = random.Random(3)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randrange(20) for _ in range(rng.randrange(6))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_records_are_members():
    big = random.Random(1).randbytes(1 << 24)  # a record of 16 MB and more ends in another byte than 0
    made = [warc.record(n, url, 5, p, hashlib.sha1(p).hexdigest(), ref, ref is not None) for n, url, p, ref in ((1, "http://a.b/c?d=%20é", b"x" * 2000, None), (None, None, b"", None), (2, "http://a.b/\r\nX: y", b"x" * 2000, 1), (3, "u", big, None))]
    assert made[3][-1] != 0
    data = b"".join((m if m[-1] == 0 else m + warc.EMPTY)[:-1] + b"\0" for m in made)
    found = [warc.parse(c) for _, _, c in warc.members(data)]
    assert [(f["page_id"], f["url"], f["payload_bytes"], f["refers_to"], f["record_type"]) for f in found] == [
        (1, "http://a.b/c?d=%20é", 2000, None, "response"), (None, None, 0, None, "response"), (2, "http://a.b/%0D%0AX: y", 2000, 1, "revisit"), (3, "u", 1 << 24, None, "response"),
    ]
    for at, n, content in warc.members(data):  # each stands where the index says
        assert next(warc.members(data[at : at + n]))[2] == content
    with pytest.raises(ValueError):
        list(warc.members(data[:-9]))


def test_url_keys():
    assert warc.url_key("HTTP://u@www.Ab.example.com:80/x?y=1#z") == "com,example,ab)/x?y=1"
    assert warc.url_key("http://a.b?q") == "b,a)/?q" and warc.url_key("not a url#x") == "not a url" and warc.url_key(None) == ""


PAGES = [
    (1, "http://a.example/x", "p" * 1000), (2, "http://b.example/x", "p" * 1000), (3, None, "p" * 1000), (4, "http://a.example/x", "p" * 999), (5, "http://c", "p" * 999), (6, "http://c", None), (7, "http://c", ""),
    (None, "http://d", "q" * 1500), (None, "http://d", "q" * 1500), (8, "http://e", "é" * 600), (9, "http://e", "é" * 600), (9, "http://e", "é" * 600), (10, "http://f", "r" * 5000), (None, None, None), (None, "http://g", "p" * 1000),
] + [(100 + n, "http://hot.example/", f"<p>{n}</p>") for n in range(300)]


def test_warc(spark, tmp_path):
    """Nulls, repeated rows, ties of size, a hot url over several ranges, and a column of another name."""
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, place string").repartition(5)
    got = warc.archive(warc.page_captures(pages), f"file://{tmp_path}/w", file_bytes=20_000, per_range=40)
    first = defaultdict(list)
    for page, _, html in PAGES:
        first[html or ""].append(page)
    want = []
    for page, url, html in PAGES:
        body = (html or "").encode()
        most = max((p for p in first[html or ""] if p is not None), default=None)
        again = len(body) >= 1000 and most is not None and page != most
        want.append((page, url, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", most if again else None))
    assert of(got, "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=str)
    rows = sorted(got.collect(), key=lambda r: r["place"])
    assert [r["place"] for r in rows] == list(range(len(PAGES)))
    order = [(r["url_key"], r["captured"]) for r in rows]
    assert order == sorted(order)
    seen = Counter()
    for r in rows:
        assert r["capture"] == seen[r["url_key"]]
        seen[r["url_key"]] += 1
    empty = warc.archive(warc.page_captures(pages.limit(0)), f"file://{tmp_path}/none")
    assert empty.count() == 0


# codes of vectors


@pytest.mark.parametrize("scale", [1, 3, 1000, 1 << 30])
def test_ball_tree_is_exact(scale):
    rng = np.random.default_rng(scale)
    entries = rng.integers(-6, 7, (200, 3)) * scale
    entries[50:90] = entries[10]  # equal entries: the lowest index counts
    queries = rng.integers(-8, 9, (500, 3)) * scale
    index, away = codes.BallTree(entries).nearest(queries)
    exact = ((queries[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(2)
    assert (index == exact.argmin(1)).all() and (away == exact.min(1)).all()


def test_ball_tree_prunes():
    rng = np.random.default_rng(5)
    entries = (rng.normal(size=(32, 1, 4)) * 500 + rng.normal(size=(32, 8, 4)) * 10).reshape(-1, 4).astype(int)
    tree = codes.BallTree(entries)
    tree.nearest(entries[rng.integers(0, 256, 1000)] + rng.integers(-3, 4, (1000, 4)))
    assert tree.verified < 1000 * 256 / 8


def plain_codes(rows, entries, rounds):
    kept = [(i, [int(np.floor(1024 * x)) for x in v], label) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    n = len(kept[0][1])
    kept = [(i, v + [0] * (-n % 4), label) for i, v, label in kept if len(v) == n]
    width = len(kept[0][1]) // 4
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(4)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, p: min((away(part(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = [[list(e) for e in b] for b in books]
        for p in range(4):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[nearest(v, p)[1]].append(part(v, p))
            for k, g in groups.items():
                new[p][k] = [sum(x) // len(g) for x in zip(*g)]
        books = new
    out = [(i, label, [nearest(v, p) for p in range(4)]) for i, v, label in kept]
    return [(i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)) for i, label, found in out], [b for b in books]


def test_codes(spark):
    """Nulls, other lengths, ties, repeated ids, large components, and a length that four doesn't divide."""
    rng = np.random.default_rng(2)
    rows = [(n // 2 if n % 9 else None, (rng.integers(-3, 4, 6) / 4).tolist(), int(rng.integers(0, 3)) or None) for n in range(120)]
    rows += [(900, None, 1), (901, [], 1), (902, [1.0] * 5, 1), (903, [None] + [1.0] * 5, 1), (904, [float("nan")] + [1.0] * 5, 1), (905, [float("inf")] * 6, 1), (906, [3e5, -3e5, 0.0, 1.0, 2.0, 0.5], 2)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, code string").repartition(3)
    got, books = codes.compress(df, rounds=3, entries=7)
    want, want_books = plain_codes(rows, 7, 3)
    assert of(got, "vec_id", "label", "code", "error") == sorted(want, key=str)
    assert books.tolist() == want_books
    none, books = codes.compress(df.limit(0))
    assert none.count() == 0 and books.size == 0


# collocations


def test_suffix_arrays():
    rng = random.Random(4)
    text = "".join(rng.choice(["a ", "b ", "Ab\t", ". ", "b,", "a\n"]) for _ in range(400))
    words, ids, room = phrases.word_ids(next(phrases.sections(phrases.pa.array([text]))))
    names = words.to_pylist()
    suffixes = [[names[ids[i + k]] for k in range(room[i])] for i in range(len(ids))]
    order = phrases.suffix_array(ids, room)
    numbered = [[ids[i + k] for k in range(room[i])] for i in order]
    assert numbered == sorted(numbered)
    shared = phrases.common_words(ids, room, order)
    for k in range(1, 5):
        first, count = phrases.intervals(order, shared, room, k)
        assert Counter(tuple(s[:k]) for s in suffixes if len(s) >= k) == Counter({tuple(suffixes[order[f]][:k]): c for f, c in zip(first, count)})


def plain_collocations(docs, least, top):
    import re

    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    out = defaultdict(list)
    candidates = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    for (lang, *w), a in candidates.items():
        inside = any(b[0] == lang and len(b) - 1 > len(w) and 100 * c >= 80 * a and any(list(b[i : i + len(w)]) == w for i in range(1, len(b) - len(w) + 1)) for b, c in candidates.items())
        score, _, l, r = min((2_000_000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
        if not inside:
            out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return [(lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for k, (s, a, p, l, r) in enumerate(sorted(found)[:top])]


@pytest.mark.parametrize("shard, bits", [(200, 1 << 20), (1 << 20, 1 << 20), (3000, 1 << 15)])
def test_collocations(spark, monkeypatch, shard, bits):
    """Null langs and texts, equal rows, a text longer than a shard, ties, and a filter that is too small."""
    monkeypatch.setattr(phrases, "LEAST_BITS", 1 << 15)
    rng = random.Random(6)
    word = lambda: rng.choice(["New", "york", "City", "a", "the", "é", "of", "x\x85y"])
    docs = [(rng.choice(["en", "de", None, "und"]), " ".join(word() + rng.choice(["", "", "", ".", ",\n", "\t"]) for _ in range(rng.randrange(60)))) for _ in range(80)]
    docs += [("en", None), (None, ""), ("en", " . ,"), *[("en", "New York city hall of a")] * 40, ("fr", "le chat noir " * 900)]
    df = spark.createDataFrame([(*d, 5) for d in docs], "lang string, text string, phrase int").repartition(4)
    got = phrases.collocations(df, least=8, top=25, shard=shard, most_bits=bits)
    assert of(got, "lang", "rank", "phrase", "a", "l", "r", "n", "score") == sorted(plain_collocations(docs, 8, 25), key=str)


def test_no_collocations(spark):
    df = spark.createDataFrame([("en", "one two")], "lang string, text string")
    assert phrases.collocations(df).count() == 0 and phrases.collocations(df.limit(0)).count() == 0
