"""Quality, language and decontamination against brute force and held-out rows."""

import random
import string
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import decontaminate as dec
from weftline.llm import common, language, quality, queries

SF = "/root/testdata/sf0.01"
EXTRA = [(1, None), (2, ""), (None, "the reesanes instti of"), (2, ""), (3, "12 ½ ² !!"), (4, "zähle é" * 40000)]


def odd(spark):
    return spark.createDataFrame([(i, t, "en", 1.5, "x", "y", 2) for i, t in EXTRA], "doc_id long, text string, lang string, score double, lang_pred string, predicted string, tile int")


# --- quality -------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    got = queries.op5_quality_votes(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert got.count() == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_votes_equal_brute_force():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["ab!!", "cd", "ef", "gh|", "IJ"]) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    model = quality.fit_vectors(quality.term_counts(texts[:40]), np.arange(40) % 2.0)
    for t, got in zip(texts[40:], model.score(texts[40:]), strict=True):
        v = model.embed(quality.term_counts([t]))[0].astype(float)
        near = sorted(((float(v @ w), y) for w, y in zip(model.vectors.astype(float), model.labels)), reverse=True)[: quality.NEIGHBOURS]
        assert got == pytest.approx(sum(max(s, 0) ** 8 * y for s, y in near) / sum(max(s, 0) ** 8 for s, _ in near), abs=1e-3)


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1, 0), (3, 0, 0), (3, 0, 1), (2, 0, 0), (2, 1, 0), (None, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.scores(odd(spark), labels).collect()
    assert len(got) == len(EXTRA) and all(0 <= r.score <= 1 for r in got)
    model = quality.fit(odd(spark), labels, F.lit(True))
    assert quality.classify(odd(spark), model).columns == ["doc_id", "text", "lang", "lang_pred", "tile", "score", "predicted"]
    assert quality.scores(odd(spark).limit(0), labels).count() == 0
    assert {r.score for r in quality.scores(odd(spark), labels.limit(0)).collect()} == {1.0}


def test_columns_of_documents_do_not_clash_with_labels(spark):
    labels = spark.createDataFrame([(4, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    more = odd(spark).withColumns({c: F.lit(7) for c in ("label", "quality", "most", "n", "term")})
    assert sorted(r.score for r in quality.scores(more, labels).collect()) == sorted(r.score for r in quality.scores(odd(spark), labels).collect())


def test_a_bounded_sample_keeps_the_balance_of_labels(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["ab!!", "cd", "ef", "gh|", "IJ"]) for _ in range(20)), int(k % 20 >= 3)) for k in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id long, quality int, toxic int")
    every, some = (quality.fit(docs, labels, F.lit(True), n) for n in (1000, 60))
    assert len(every.labels) == 600 and len(some.labels) == 120
    texts = [" ".join(rng.choice(["ab!!", "cd", "ef", "gh|", "IJ"]) for _ in range(20)) for _ in range(200)]
    for model in (every, some):
        assert model.prior == pytest.approx(0.85) and model.score([None])[0] == pytest.approx(0.85)
        assert model.score(texts).mean() == pytest.approx(0.85, abs=0.06)


# --- language ------------------------------------------------------------------------------------


def test_language_on_held_out_rows(spark):
    got = queries.op9_language(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    rows = got.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000 and np.mean([r.lang == r.lang_pred for r in rows if r.held_out]) > 0.98


def test_bayes_equals_brute_force(spark):
    texts = [("en", "the cat and the dog"), ("en", "An end"), ("fr", "l'été où déjà"), ("fr", "le chat et le chien"), (None, "zzz"), ("de", None)]
    df = spark.createDataFrame([(k, t, x) for k, (x, t) in enumerate(texts)], "doc_id long, text string, lang string")
    langs, table = language.fit(df, F.lit(True))
    bits = language.BITS
    assert langs == ["en", "fr"]

    def grams(t):
        chars = [ord(c.lower()) if c.isascii() and c.isalpha() else 32 if c.isascii() else ord(c) for c in t] + [1, 1]
        for n in language.ORDERS:
            for k in range(len(t)):
                h = 0
                for c in chars[k : k + n]:
                    h = (h * 0x100000001B3 + c) % 2**64
                yield ((h + n) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - bits)

    counts = {x: np.full(1 << bits, language.SMOOTHING) for x in langs}
    for x, t in texts[:4]:
        for g in grams(t):
            counts[x][g] += 1
    for t in ("the chat", "été", "a", "x" * 50):
        want = np.array([np.log(0.5) + sum(np.log(counts[x][g] / counts[x].sum()) for g in grams(t)) for x in langs])
        got = language.predict(spark.createDataFrame([(t,)], "text string"), (langs, table)).first()
        assert got.lang_pred == langs[int(want.argmax())]
        assert got.score == pytest.approx(1 / np.exp(want - want.max()).sum(), abs=1e-4)


def test_too_many_languages_are_refused(spark):
    df = spark.range(language.LANGUAGES + 1).select(F.lit("a").alias("text"), F.col("id").cast("string").alias("lang"), F.col("id").alias("doc_id"))
    with pytest.raises(ValueError):
        language.fit(df, F.lit(True))


def test_a_text_scores_alike_in_any_company():
    a = [language.gram_buckets([t], 15)[0] for t in ("été", "b", "long text")]
    both, starts = language.gram_buckets(["été", "b", "long text"], 15)
    for k, t in enumerate(("été", "b", "long text")):
        for x, y in zip(a[k], both, strict=True):
            assert x[: len(t)].tolist() == y[starts[k] : starts[k] + len(t)].tolist()


def test_language_of_odd_rows(spark):
    got = {r.doc_id: r.lang_pred for r in language.predictions(odd(spark)).collect()}
    assert (got[1], got[2], got[3], got[4]) == ("und", "und", "und", "en")
    assert language.predictions(odd(spark).limit(0)).count() == 0
    none = language.predictions(odd(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}


# --- decontamination -----------------------------------------------------------------------------


def smith_waterman(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (dec.MATCH if a[i - 1] == b[j - 1] else dec.MISMATCH), h[i - 1][j] + dec.GAP, h[i][j - 1] + dec.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_brute_force():
    rng = random.Random(2)
    a = [np.array([rng.randint(0, 4) for _ in range(rng.randint(1, 12))], np.uint32) for _ in range(200)]
    b = [np.array([rng.randint(0, 4) for _ in range(rng.randint(1, 20))], np.uint32) for _ in range(200)]
    score, start, stop = dec.align(a, b)
    for x, y, s, i, j in zip(a, b, score, start, stop, strict=True):
        assert s == smith_waterman(x.tolist(), y.tolist())
        if s:
            assert smith_waterman(x.tolist(), y[i:j].tolist()) == s


def test_planted_copies(spark):
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(400)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, say(rng.randint(12, 60))) for k in range(12)]
    docs, want = [], set()
    for k, (i, words) in enumerate(items):
        edited = [w if rng.random() > 0.15 else "new" for w in words]
        edited.insert(len(edited) // 2, "inserted")
        for kind, passage in enumerate((words, [w.upper() + "," for w in words], edited, words[: len(words) // 4], [])):
            docs.append((10 * k + kind, " ".join(say(rng.randint(0, 300)) + passage + say(rng.randint(0, 90)))))
            if kind < 3:
                want.add((10 * k + kind, i))
    docs += [(None, " ".join(items[0][1])), (500, None), (501, ""), (501, ""), (502, " ".join(items[1][1] * 400)), (503, "W1!"), (504, "w1 w2"), (505, "w2"), (506, "w2 w1")]
    want |= {(None, 0), (502, 1), (503, 91), (504, 92)}
    df = spark.createDataFrame([(d, t, "s", "c", 1) for d, t in docs], "doc_id long, text string, source string, item_id string, n int")
    bench = spark.createDataFrame([(i, " ".join(w), "c") for i, w in items] + [(90, None, "c"), (91, "w1", "c"), (92, "w1, w2", "c"), (0, " ".join(items[0][1]), "c")], "item_id long, text string, seeds string")
    got = dec.matches(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.similarity == 1 for r in got if r.doc_id is not None and r.doc_id % 10 < 2 and r.doc_id < 500)
    text = dict(docs)
    by = dict(items) | {91: ["w1"], 92: ["w1", "w2"]}
    for r in got:
        assert smith_waterman(by[r.item_id], [w.strip(",!").lower() for w in text[r.doc_id].split()][r.start : r.stop]) == pytest.approx(r.similarity * dec.MATCH * len(by[r.item_id]))
    left = {r.doc_id for r in dec.clean(df, bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want}
    assert dec.matches(df.limit(0), bench).count() == 0 and dec.matches(df, bench.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_copies_that_share_only_common_seeds(spark, monkeypatch, broadcast):
    monkeypatch.setattr(dec, "BROADCAST_SEEDS", broadcast, raising=False)
    item = [f"w{k}" for k in range(16)]
    edited = [w if k not in (5, 8, 11, 14) else f"x{k}" for k, w in enumerate(item)]
    docs = [(0, " ".join(item)), *((k, f"a{k} b{k} " + " ".join(edited)) for k in range(1, 60)), (99, "w0 w1 w2 and no more")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.similarity for r in dec.matches(df, bench).collect()}
    assert got == {0: 1.0, **{k: 0.625 for k in range(1, 60)}}
    assert {r.doc_id for r in dec.clean(df, bench).collect()} == {99}


def test_items_of_very_different_lengths(spark):
    rng = random.Random(6)
    items = {i: [f"i{i}w{k}" for k in range(n)] for i, n in enumerate([3, 20, 64, 65, 250, 3000])}
    noise = lambda n: [f"n{rng.randint(0, 10**9)}" for _ in range(n)]
    docs, want = [], {}
    for i, words in items.items():
        # Words put in between cost a fifth of the score, and make the copy longer than the item.
        wide = [w for k, word in enumerate(words) for w in ([word, f"x{k}"] if k % 5 < 2 else [word])]
        for k, copy in enumerate([words, wide, words[: len(words) // 3]]):
            docs.append((10 * i + k, " ".join(noise(40 * i + 7 * k) + copy + noise(500))))
            share = smith_waterman(words, copy) / (dec.MATCH * len(words)) if len(words) < 300 else [1.0, 0.8, 1 / 3][k]
            if share >= dec.LEAST:
                want[10 * i + k, i] = share
    docs.append((99, "i0w0 i0w1 i0w2"))
    want |= {(0, 0): 1.0, (99, 0): 1.0}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    assert dec.widths(dec.item_words(bench)) == {0: 129, 1: 501, 3: 6001}
    got = {(r.doc_id, r.item_id): r.similarity for r in dec.matches(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert {k: round(v, 2) for k, v in got.items()} == {k: round(v, 2) for k, v in want.items()}


def test_decontamination_finds_all_whole_copies(spark):
    norm = lambda t: " " + " ".join(t.lower().split()) + " "
    docs = [(r.doc_id, norm(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, norm(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {(d, i) for d, t in docs for i, x in items if x in t}
    got = {(r.doc_id, r.item_id) for r in queries.op6_decontamination(spark, SF).collect()}
    assert whole and whole <= got and len(got) <= len(whole) + 5


def every_third_left_out(w):
    return [x for k, x in enumerate(w) if k % 3 != 2]


def every_third_replaced(w):
    return [f"new{k}" if k % 3 == 2 else x for k, x in enumerate(w)]


def one_put_in_after_two(w):
    return [x for k, y in enumerate(w) for x in ([y, f"put{k}"] if k % 2 else [y])]


def one_put_in_after_each(w):
    return [x for k, y in enumerate(w) for x in (y, f"put{k}")]


def test_copies_without_three_words_in_a_row_are_found(spark):
    rnd = np.random.default_rng(3)
    items = [[f"w{x}" for x in rnd.integers(0, 5000, n)] for n in (31, 30, 64, 12, 4, 5, 7, 3, 90)]
    rows, want = [], {}
    for k, item in enumerate(items):
        for j, edit in enumerate((every_third_left_out, every_third_replaced, one_put_in_after_two, one_put_in_after_each, list)):
            text = [f"x{x}" for x in rnd.integers(0, 5000, 40)] + edit(item) + [f"y{x}" for x in rnd.integers(0, 5000, 40)]
            words = [dec.words_of(" ".join(t)) for t in (item, text)]
            score = int(dec.align(words[:1], words[1:])[0][0])
            if score >= dec.LEAST * 2 * len(item):
                want[k * 10 + j, k] = score / (2 * len(item))
            rows.append((k * 10 + j, " ".join(text)))
    assert len(want) > 30
    # Seeds of every item are frequent, too.
    rows += [(1000 + k, " ".join(w for item in items for w in item[k % 7 :: 2])) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in dec.matches(docs, bench).collect() if r.doc_id < 1000}
    assert want.keys() <= got.keys()
    assert all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_matches_equal_the_alignment_of_all_pairs(spark):
    docs = [(r.doc_id, dec.words_of(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, dec.words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {}
    for item, own in items:
        able = [(d, w) for d, w in docs if np.isin(own, w).sum() >= dec.LEAST * len(own)]  # fewer words can't make up the score
        for k in range(0, len(able), 20):
            part = sorted(able, key=lambda x: len(x[1]))[k : k + 20]
            scores = dec.align([own] * len(part), [w for _, w in part])[0]
            want |= {(d, item): s / (2 * len(own)) for (d, _), s in zip(part, scores.tolist(), strict=True) if s >= dec.LEAST * 2 * len(own)}
    got = {(r.doc_id, r.item_id): r.similarity for r in dec.matches(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert len(want) > 5 and got.keys() == want.keys()
    assert all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_the_number_of_seeds_in_common_holds_for_all_small_alignments():
    from itertools import product

    for n in range(3, 9):  # each item word matched, replaced or left out, with 0 to 2 words put in after it
        for states in product((0, 1), repeat=n):
            if not any(states):
                continue
            lo, hi = states.index(1), n - states[::-1].index(1)
            m, u = sum(states), hi - lo - sum(states)
            near = [k for k in range(lo, hi - 1) if states[k] and states[k + 1]]
            most = 2 * m - u - n  # words that can be put in
            if most < 0:
                continue
            far = min(len(near), most // 2)
            held = len(near) - far + (n == 3 and states == (1, 0, 1))
            assert held >= dec.seeds_in_common(n), (n, states)


def test_words_of_many_texts_are_hashed_together():
    rnd = random.Random(3)
    texts = [None, "", " \t", "Ab, aB a.b \x0b\x0c\r\n é É", "x" * 100 + " " + "X" * 99 + "x " + "x" * 99 + "y", "A", *(" ".join("".join(rnd.choices("abcdefgh.", k=rnd.randrange(1, 12))) for _ in range(400)) for _ in range(400))]
    plain = [(t or "").encode().translate(None, string.punctuation.encode()).lower().split() for t in texts]
    words, n = dec.joined_words(texts)
    assert n.tolist() == list(map(len, plain)) and words.tolist() == [h for t in texts for h in dec.words_of(t).tolist()]
    flat = [w for ws in plain for w in ws]
    assert len(set(zip(flat, words.tolist(), strict=True))) == len(set(flat)) == len(np.unique(words))

    def took(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    each = lambda: [common.word_hashes((t or "").encode().translate(None, string.punctuation.encode())) for t in texts]
    assert min(took(lambda: dec.joined_words(texts)) for _ in range(5)) < 0.8 * min(took(each) for _ in range(5))
