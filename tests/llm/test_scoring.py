"""LM scores against a dictionary model, base scores against SQL-like sums."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from weftline.llm import scoring

BITS = 24


def brute(docs):
    toks = lambda t: [*(t or "").encode().lower().split(), "END"]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    one, two = Counter(), Counter()
    for d, t in docs:
        if not held(d):
            w = toks(t)
            one.update(w)
            two.update(zip(["START", *w], w))
    n, v = sum(one.values()), len(one)
    total = n + 0.5 * (v + 1)
    word = lambda w: {"END": scoring._END, "START": scoring._START}[w] if isinstance(w, str) else scoring.word_hashes(w)[0]
    value = lambda key, c: scoring.VALUES[scoring.level_of(key, np.array([c]))[0]] if c else 0.0
    pair = lambda a, b: value(scoring.pair_keys(np.array([word(a)]), np.array([word(b)])), two[a, b])
    least = min((1 << k for k in range(50) if sum(c >= 1 << k for c in one.values()) <= scoring.FREQUENT), default=0)
    single = lambda w: one[w] if one[w] >= least else value(scoring.word_keys(np.array([word(w)])), one[w])
    for d, t in docs:
        w = toks(t)
        score = 0.0
        for a, b in zip(["START", *w], w):
            seen, share = single("END" if a == "START" else a), (single(b) + 0.5) / total
            score += math.log10((min(pair(a, b), seen) + scoring.MU * share) / (seen + scoring.MU))
        base = sum(math.log10((one[x] + 0.5) / total) for x in w)
        yield d, held(d), len(w), sum(one[x] > 0 for x in w), n, base, score


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(4)
    vocab = [f"w{k}é" for k in range(300)]
    out = [(k, " ".join(vocab[min(int(rng.expovariate(0.02)), 299)] for _ in range(rng.randint(0, 60)))) for k in range(120)]
    return [*out, (500, None), (501, ""), (None, "W1é new\tW2é"), (3, "again W1é"), (3, "again W1é"), (502, "w0é " * 5000)]


def frame(spark, docs):
    return spark.createDataFrame([(d, t, 1, 2.0, "c") for d, t in docs], "doc_id long, text string, n int, score double, key string")


@pytest.mark.parametrize("frequent", [10**6, 40, 0])
def test_scores_equal_brute_force(spark, docs, monkeypatch, frequent):
    monkeypatch.setattr(scoring, "FREQUENT", frequent)
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    got = sorted(map(tuple, scoring.scores(frame(spark, docs), BITS).collect()), key=key)
    want = sorted(brute(docs), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], abs=1e-6)


def test_empty_tables(spark, docs):
    df = frame(spark, docs)
    assert scoring.scores(df.limit(0), BITS).count() == 0
    none = scoring.score(df, scoring.fit(df.limit(0), filter_bits=BITS)).collect()
    assert {(r.n_known, r.train_tokens) for r in none} == {(0, 0)} and all(abs(r.base_score) < 1e-9 for r in none)


def test_filter_keeps_every_count_and_few_others(spark, docs):
    model, _ = scoring.fit(frame(spark, docs), filter_bits=17)
    counts = Counter(w for _, t in docs for w in (t or "").encode().lower().split())
    keys = scoring.word_keys(np.array([scoring.word_hashes(w)[0] for w in counts], np.uint64))
    exact = scoring.VALUES[scoring.level_of(keys, np.array(list(counts.values())))]
    assert (model.count(keys) >= exact).all() and (model.count(keys) > exact).mean() < 0.1
    unseen = scoring.word_keys(scoring.word_hashes(" ".join(f"u{k}" for k in range(5000)).encode()))
    assert (model.count(unseen) > 0).mean() < 0.1


def test_model_beats_the_base_on_held_out_text(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = scoring.scores(df, BITS).filter("held_out").toPandas()
    assert len(got) > 100 and got.score.sum() > got.base_score.sum()
    assert (got.score < 0).all()


@pytest.mark.parametrize("packet", [10**9, 200])
def test_a_filter_too_large_to_broadcast_is_joined(spark, docs, monkeypatch, packet):
    monkeypatch.setattr(scoring, "FILTER_BITS", 16)
    monkeypatch.setattr(scoring, "ERROR", 1e-9, raising=False)
    monkeypatch.setattr(scoring, "PACKET", packet, raising=False)
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    got = sorted(map(tuple, scoring.scores(frame(spark, docs), 16).collect()), key=key)
    for g, w in zip(got, sorted(brute(docs), key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], abs=1e-6)


def test_wrong_answers_do_not_rise_with_the_entries(spark, monkeypatch):
    unseen = scoring.word_keys(scoring.word_hashes(" ".join(f"u{k}" for k in range(20000)).encode()))
    for n in (2_000, 40_000):  # 2**15 bits would be full at the second
        df = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k, n, 10))) for k in range(10)], "doc_id long, text string")
        model, _ = scoring.fit(df, filter_bits=15)
        assert (model.count(unseen) > 0).mean() < 1.5 * scoring.ERROR
    bits = scoring.segment_bits(10**6, 17, scoring.ERROR)
    places = [scoring._places(scoring.mixed(np.arange(1 << 16, dtype=np.uint64)), 1, b) for b in (bits, np.full(1 << 16, 23))]
    assert bits == 24 and all(x.max() > 0.9 * 2**b for p, b in zip(places, (24, 23), strict=True) for x in p)


def test_levels_are_right_on_the_mean():
    assert scoring.VALUES[:15].tolist() == [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24]
    keys = scoring.mixed(np.arange(40000, dtype=np.uint64))
    for n in (1, 2, 3, 4, 5, 7, 9, 11, 100, 12345, 10**12):
        got = scoring.VALUES[scoring.level_of(keys, np.full(len(keys), n))]
        assert got.mean() == pytest.approx(n, rel=0.01) and len(set(got)) <= 2


def test_probabilities_add_up_to_one(spark, monkeypatch):
    monkeypatch.setattr(scoring, "FILTER_BITS", 28)
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model, _ = scoring.fit(df, filter_bits=28)
    words = sorted({w for r in df.select("text").collect() for w in (r.text or "").encode().lower().split()})
    vocab = np.array([*(scoring.word_hashes(w)[0] for w in words), scoring._END, np.uint64(5)], np.uint64)  # 5: a word not seen
    assert len(words) + 1 == model.distinct
    common = vocab[np.argsort(-model.word_count(scoring.word_keys(vocab)))]
    sums = []
    for before in [scoring._START, *common[[0, 1, 5, 50, 500, 5000]], *vocab[[7, 700, -1]]]:
        sums.append((10 ** model.log_probabilities(vocab, np.full(len(vocab), before))).sum())
    assert all(0.9 < s < 1.1 for s in sums) and abs(np.mean(sums) - 1) < 0.04, sums
