"""Chat formatting, language-model scores and the corpus pipeline, against plain versions."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fedspark.llm import chat, lm, quality

from .cases import EDGE, documents, empty, texts, write
from .test_pairs import brute_components, lower, near_copies
from .test_texts import BASE_PII, WORD


RANKS = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "ann", "é"), (1, 2, "ann", "é"), (1, None, None, "x"), (1, 300, "ann", "late"), (2, 0, "system", "alone"), (None, 1, "ann", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as block", "'y' as speaker")
    want = {}
    for conv in (1, 2, None):
        own = sorted({(-1 if t is None else t, r or "unknown", x or "", -1 if t is None else t // 256) for c, t, r, x in rows if c == conv})
        for who in {r for _, r, _, _ in own} - {"system"}:
            for block in {b for *_, b in own}:
                out, mask = "", []
                for _, role, text, b in own:
                    if b == block:
                        out += "<|im_start|>" + ("system" if role == "system" else "assistant" if role == who else f"user name={role}") + "\n"
                        if role == who:
                            mask.append(f"{len(out)}:{len(out) + len(text)}")
                        out += text + "<|im_end|>\n"
                want[conv, who, block] = (out, ",".join(mask))
    got = chat.rotate_perspectives(df).collect()
    assert {(r.conv_id, r.speaker, r["block"]): (r.rendered, r["mask"]) for r in got} == want and len(got) == len(want)
    assert chat.rotate_perspectives(df.limit(0)).count() == 0


def test_scores(spark):
    values = texts()
    got = {r.doc_id: r for r in lm.score_texts(documents(spark, values), *RANKS).collect()}
    assert sorted(got) == list(range(len(values)))
    tokens = [[*WORD.findall(lower(t or "")), None] for t in values]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(values))]
    c = Counter(w for own, h in zip(tokens, held) if not h for w in own)
    n, v = sum(c.values()), len(c)
    for i, own in enumerate(tokens):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(own), sum(c[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    # better than giving each of the vocabulary's ids the same chance
    some = [i for i in range(len(values)) if held[i] and len(tokens[i]) > 20]
    assert sum(got[i].score for i in some) > -math.log10(lm.END) * sum(len(values[i].encode()) for i in some) / 2
    assert lm.score_texts(empty(spark), *RANKS).count() == 0


def test_a_fixed_share_of_windows_trains(spark, monkeypatch):
    monkeypatch.setattr(lm, "ID_SLICE", 2000)
    monkeypatch.setattr(lm, "LEAST_WINDOWS", 5)
    seen = []
    fit = lm.fit_all
    monkeypatch.setattr(lm, "fit_all", lambda texts, *more: seen.append((texts.select("held", "ids", "id_ends").collect(), fit(texts, *more))))
    lm.score_texts(documents(spark, texts()), *RANKS).count()
    (rows, n), want = seen[0], 0
    for r in rows:
        owner, _ = lm.runs_of(np.frombuffer(r["id_ends"], np.int64))
        held = np.frombuffer(r["held"], np.uint8).astype(bool)
        some = lm.training_windows(owner, held, zlib.crc32(r["ids"]), lm.TRAIN_EVERY)
        assert not held[owner[some]].any() and abs(len(some) - (~held[owner]).sum() / lm.TRAIN_EVERY) < 1
        want += len(some)
    assert n == want > 10
    assert lm.schedule(10**9) == (lm.TRAIN_EVERY, 1) and lm.schedule(0)[0] == 1 < lm.schedule(0)[1] and lm.schedule(3 * lm.LEAST_WINDOWS) == (3, 1)


def test_every_window_trains_in_the_query(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(lm, "ID_SLICE", 2000)
    monkeypatch.setattr(lm, "LEAST_WINDOWS", 5)
    seen = []
    fit = lm.fit_all
    monkeypatch.setattr(lm, "fit_all", lambda texts, *more: seen.append((texts.select("held", "id_ends").collect(), fit(texts, *more))))
    values = texts()
    write(tmp_path, documents=pa.table({"doc_id": pa.array(range(len(values)), pa.int64()), "text": pa.array(values, pa.string())}))
    lm.op10_lm(spark, str(tmp_path)).count()
    rows, n = seen[0]
    windows = [int((~np.frombuffer(r["held"], np.uint8).astype(bool))[lm.runs_of(np.frombuffer(r["id_ends"], np.int64))[0]].sum()) for r in rows]
    assert n == sum(windows) > 8 * lm.LEAST_WINDOWS
    assert [lm.schedule(k * lm.LEAST_WINDOWS, True) for k in (0.5, 3, 10**9)] == [(1, 2), (1, 1), (1, 1)]


def test_every_seen_id_has_its_own_place():
    counts = np.random.default_rng(1).zipf(1.3, 32000).clip(0, 10**6) - 1
    model = lm.AttentionModel.begin(counts)
    seen = np.flatnonzero(counts)
    at = list(zip(model.class_of[model.place_of].tolist(), model.member_of[model.place_of].tolist()))
    assert len({at[i] for i in seen}) == len(seen) == len(model.embedding) - 1
    unseen = np.flatnonzero(counts == 0)
    assert len({at[i] for i in unseen}) == 1 and not model.log_share[seen].any()
    assert np.allclose(np.exp(model.log_share[unseen]).sum(), 1)


def plain_score(model, ids: list) -> float:
    """One token after another, each with the keys that its window gives it."""
    inputs, total = [lm.BEGIN, *ids], 0.0
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    for k, target in enumerate([*ids, lm.END]):
        first = k // lm.STRIDE * lm.STRIDE - lm.STRIDE
        keys = [(j, model.embedding[model.place_of[inputs[j]]]) for j in range(max(first, 0), k + 1)]
        own = keys[-1][1]
        query = own @ model.query + model.place_query[k % lm.STRIDE]
        a = soft(np.array([query @ (e @ model.key + model.place_key[j - first]) for j, e in keys]) / math.sqrt(len(own)))
        h = sum(w * (e @ model.value) for w, (_, e) in zip(a, keys)) + own @ model.residual + model.hidden_bias
        h = h / (1 + np.abs(h))
        place = model.place_of[target]
        c = model.class_of[place]
        total += math.log(soft(h @ model.out + model.out_bias)[c]) + math.log(soft(h @ model.inner[c] + model.inner_bias[c])[model.member_of[place]]) + model.log_share[target]
    return total / math.log(10)


def test_scores_equal_those_of_one_token_at_a_time(monkeypatch):
    monkeypatch.setattr(lm, "SCORED_WINDOWS", 3)
    rng = np.random.default_rng(2)
    model = lm.AttentionModel.begin(np.bincount(np.append(rng.integers(3, 80, 900), lm.END), minlength=lm.END + 1))
    for name in model.WEIGHTS:
        setattr(model, name, getattr(model, name) + 0.3 * rng.standard_normal(getattr(model, name).shape).astype(np.float32))
    docs = [rng.integers(3, 100, n).tolist() for n in (0, 1, lm.STRIDE - 1, lm.STRIDE, 5 * lm.STRIDE + 3, 7)]
    got = model.scores(np.concatenate(docs).astype(np.uint16), np.cumsum([len(d) for d in docs]))
    assert np.allclose(got, [plain_score(model, d) for d in docs], rtol=1e-4)


def test_model_learns_what_follows_what(spark):
    import random

    rng = random.Random(3)
    names = ["".join(rng.choices("abcdefghijkl", k=5)) for _ in range(30)]
    follow = {w: rng.sample(names, 2) for w in names}
    values = []
    for _ in range(500):
        words = [rng.choice(names)]
        while len(words) < 80:
            words.append(rng.choice(follow[words[-1]]))
        values.append(" ".join(words))
    got = lm.score_texts(documents(spark, values), *RANKS).filter("held_out").collect()
    # the counts of words know nothing of what stands before them
    assert sum(r.score for r in got) > 0.7 * sum(r.base_score for r in got)


def test_gradients():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 40, (6, 3 * lm.STRIDE))
    rows[0, : lm.STRIDE] = -1
    model = lm.AttentionModel.begin(np.bincount(rows[rows >= 0], minlength=40), width=8)
    for name in model.WEIGHTS:
        setattr(model, name, getattr(model, name).astype(np.float64))
    places = model.places(rows)
    _, g = model.loss_and_gradients(places)
    for name in model.WEIGHTS:
        w = getattr(model, name)
        at = np.unravel_index(np.abs(g[name]).argmax(), w.shape)
        old, step = w[at], 1e-4
        w[at] = old + step
        up, _ = model.loss_and_gradients(places)
        w[at] = old - step
        down, _ = model.loss_and_gradients(places)
        w[at] = old
        assert math.isclose((up - down) / (2 * step), g[name][at], rel_tol=2e-3, abs_tol=1e-5), name


def test_groups_of_windows_have_the_gradients_of_windows_alone():
    rng = np.random.default_rng(4)
    docs = [rng.integers(3, 60, n) for n in (700, 0, 31, 32, 300, 450, 9)]
    ids, ends = np.concatenate(docs).astype(np.uint16), np.cumsum([len(d) for d in docs])
    model = lm.AttentionModel.begin(np.bincount(np.append(ids, lm.END), minlength=lm.END + 1), width=8)
    for name in model.WEIGHTS:
        setattr(model, name, getattr(model, name) + 0.3 * rng.standard_normal(getattr(model, name).shape))
    owner, number = lm.runs_of(ends)
    held = np.array([False, False, False, True, False, False, False])
    some = lm.training_windows(owner, held, 0, 1)
    assert len(some) % lm.GROUPED and not held[owner[some]].any()
    (g, used), (one, same) = (model.gradients(*lm.grouped(model, ids, ends, number, some, size)) for size in (lm.GROUPED, 1))
    both = np.intersect1d(used, same)  # the run before a first window, which isn't seen, may differ
    g["embedding"], one["embedding"] = (x["embedding"][np.searchsorted(u, both)] for x, u in ((g, used), (one, same)))
    for name in model.WEIGHTS:
        assert np.abs(one[name]).max() > 0 and np.allclose(g[name], one[name], rtol=1e-8, atol=1e-12), name


def test_classes_are_short_in_the_mean():
    counts = np.append(np.sort(np.random.default_rng(1).zipf(1.3, 4000))[::-1], 0)
    model = lm.AttentionModel.begin(counts)
    sizes = np.bincount(model.class_of)
    mass = np.append(counts[counts > 0], 0) / counts.sum()
    mean = len(sizes) + (mass * sizes[model.class_of]).sum()
    assert mean < 1.5 * math.sqrt(len(model.embedding)) and sizes.max() <= model.inner.shape[2]


def test_steps_in_pieces_are_adams(monkeypatch):
    monkeypatch.setattr(lm.Moments, "PIECE", 37)
    rng = np.random.default_rng(6)
    model = lm.AttentionModel.begin(rng.integers(1, 9, 50), width=8)
    start = {name: getattr(model, name).astype(float) for name in model.WEIGHTS}
    want, m, v = ({name: x.copy() for name, x in start.items()} for _ in range(3))
    for x in (*m.values(), *v.values()):
        x[:] = 0
    adam = lm.Moments(model)
    for t in range(1, 31):
        g = {name: rng.standard_normal(w.shape).astype(np.float32) * 10.0 ** rng.integers(-6, 2) for name, w in start.items()}
        used = np.flatnonzero(rng.random(len(model.embedding)) < 0.4)
        for name, w in want.items():
            at = used if name == "embedding" else slice(None)
            m[name][at] = 0.9 * m[name][at] + 0.1 * g[name][at]
            v[name][at] = 0.99 * v[name][at] + 0.01 * g[name][at].astype(float) ** 2
            w[at] -= 1e-2 * min(1, t / 20) * m[name][at] / (1 - 0.9**t) / (np.sqrt(v[name][at] / (1 - 0.99**t)) + 1e-8)
        adam.step(g | {"embedding": g["embedding"][used]}, used, 1e-2)
    assert all(np.allclose(getattr(model, name), w, rtol=1e-4, atol=1e-5) for name, w in want.items())
    assert all(np.abs(w - start[name]).max() > 0.01 for name, w in want.items())
    assert np.shares_memory(model.inner, adam.flat) and np.allclose(model.copy().flat(), model.flat())


def test_sums_of_runs_of_rows():
    rng = np.random.default_rng(7)
    for lengths in (np.array([1, 40, 3, 12, 1, 11, 200, 2]), np.array([50]), np.array([1, 1]), np.empty(0, int)):
        rows = rng.standard_normal((int(lengths.sum()), 5))
        assert np.allclose(lm.sum_runs(rows, lengths), [x.sum(0) for x in np.split(rows, np.cumsum(lengths)[:-1])] if len(lengths) else np.empty((0, 5)))


def test_words_encoded_once_have_the_ids_of_whole_texts():
    import base64
    import random

    import tiktoken

    with open(RANKS[0], "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=RANKS[1], mergeable_ranks=ranks, special_tokens={})
    sizes = np.zeros(lm.END, np.int64)
    sizes[list(ranks.values())] = list(map(len, ranks))
    rng = random.Random(7)
    bits = [" ", " ", " ", "a", "b", "é", "'s", "'", "1", "22", ".", "!?", "\n", "\t", "\u00a0", "\u3000", "\x0b", "\x85", "\u200b", "語", "😀", "\x1c", "\r\n", "ll", " don't"]
    assert lm.words_apart(RANKS[1]) and not lm.words_apart(".+")
    for _ in range(60):
        values = pa.array(["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(40)] + ["", " ", "a b a b"])
        ids, ends = lm.ids_of_texts(encoding, sizes, True, values)
        want = [encoding.encode(t, disallowed_special=()) for t in values.to_pylist()]
        assert ids.tolist() == sum(want, []) and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    prose = [t for t in texts(seed=9, n=60)[len(EDGE) :] if len(WORD.findall(t or "")) > 50]
    marked = [f"{t} {x} end" for t, x in zip(prose, ["mail some.one@host.example.com", "at 10.20.30.40 and +1 (743) 555-3824", "card 4111 1111 1111 1111 x@y.zz", "+49 30 123 456 78 90 4111-1111-1111-1111"])]
    values = texts(n=25) + near_copies() + marked
    table = pa.table({"doc_id": pa.array(range(len(values)), pa.int64()), "text": pa.array(values, pa.string()), "lang": ["en"] * len(values), "source": ["s"] * len(values), "n_chars": pa.array([len(t or "") for t in values], pa.int64())})
    rows = corpus_pipeline.run(spark, write(tmp_path, documents=table)).collect()
    kept = {r.doc_id for r in quality.quality_rules(documents(spark, values)).filter("kept").collect()}
    assert not any(len(WORD.findall(values[i] or "")) < 10 for i in kept) and kept
    order = sorted(kept)
    found = brute_components([values[i] for i in order], 5, 80)
    stay = [order[k] for k, (_, first) in found.items() if first == k]
    assert {r.doc_id for r in rows} == set(stay)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    masked_some = 0
    for i in stay:
        spans = sorted((m.start(), -m.end(), kind) for kind, (p, ok) in BASE_PII.items() for m in re.finditer(p, values[i]) if ok(m[0]))
        masked, at = "", 0
        for start, end, kind in spans:
            if start >= at:
                masked += values[i][at:start] + f"<{kind.upper()}>"
            at = max(at, -end)
        masked += values[i][at:]
        masked_some += masked != values[i]
        ids = [*tokenizer.encode(masked, add_special_tokens=False).ids, 2]
        for r in pieces[i]:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[r.start : r.start + r.length]))
    assert masked_some >= 3
    assert corpus_pipeline.ORACLE_SQL is None and [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "PII", "packing"]


def test_pipeline_decides_by_row(spark):
    import corpus_pipeline

    long = [" ".join(f"{a}{k * 7919 % 1000}x{k}" for k in range(60)) for a in ("red", "blue", "green", "grey")]
    rows = [(1, long[0] + " mail a.b@c.de"), (1, "too short"), (1, "x " + long[1] + " mail someone.else@example.org now"), (2, long[2]), (2, long[2]), (None, long[3]), (None, long[3]), (None, long[2]), (None, "short")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = lambda df: sorted(((r.doc_id or 0, r.text) for r in df.collect()))
    good = corpus_pipeline.keep_quality(spark, docs, "")
    assert found(good) == sorted((i or 0, t) for i, t in rows if "short" not in t)
    first = corpus_pipeline.keep_first_of_near_duplicates(spark, good, "")
    assert found(first) == sorted([(1, rows[0][1]), (1, rows[2][1]), (2, long[2]), (0, long[3])])
    masked = corpus_pipeline.mask_personal_data(spark, first, "")
    assert found(masked) == sorted([(1, rows[0][1].replace("a.b@c.de", "<EMAIL>")), (1, rows[2][1].replace("someone.else@example.org", "<EMAIL>")), (2, long[2]), (0, long[3])])


def test_pipeline_stages_on_empty_tables_and_null_texts(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    none = spark.createDataFrame([], schema)
    nulls = spark.createDataFrame([(1, None, None, None, None), (None, None, None, None, None), (1, None, None, None, None)], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, "").count() == 0, name
        assert stage(spark, nulls, "").count() == (0 if name == "quality rules" else 3), name
    assert corpus_pipeline.pack_windows(spark, none, "").count() == 0
    assert [(r.doc_id, r.length) for r in corpus_pipeline.pack_windows(spark, nulls.filter("doc_id is null"), "").collect()] == [(None, 1)]


def test_a_word_of_all_documents_is_one_number_a_block(spark, monkeypatch):
    """Whatever the number of documents that have a word, what meets by words has one count of it for each block."""
    monkeypatch.setattr(lm, "WORD_SLICE", 4000)
    values = [f"common common w{i} common w{i % 7}" for i in range(600)]
    docs = documents(spark, values).select("doc_id", F.xxhash64("doc_id").alias("key"), "text").coalesce(1)
    rows = docs.mapInArrow(lm._deal_words(3), lm.DEALT).collect()
    blocks = {r.block for r in rows if r.range < 0}
    assert 1 < len(blocks) == len([r for r in rows if r.range < 0])
    hashes = np.concatenate([np.frombuffer(r.hashes, np.uint64) for r in rows if r.range >= 0])
    assert np.unique(hashes, return_counts=True)[1].max() == len(blocks)
    assert rows == docs.mapInArrow(lm._deal_words(3), lm.DEALT).collect()  # a task that is repeated gives the same blocks
    train = Counter(w for i, v in enumerate(values) if not lm.held_out(i) for w in v.split())
    n, v = sum(train.values()) + sum(not lm.held_out(i) for i in range(600)), len(train) + 1
    ends = sum(not lm.held_out(i) for i in range(600))
    for r in lm.word_scores(docs).collect():
        words = values[r.doc_id].split()
        want = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        assert r.base_score == pytest.approx(want) and r.n_known == sum(train[w] > 0 for w in words) + 1
