import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from weftline.llm import queries, suffixes

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def small_maps(monkeypatch):
    monkeypatch.setattr(suffixes, "MAP_BITS", 20)


def brute(rows, least):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode() if not isinstance(t, bytes) else t
        seen.update(b[i : i + least] for i in range(len(b) - least + 1))
    out = []
    for doc_id, t in rows:
        b = (t or "").encode() if not isinstance(t, bytes) else t
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if seen[b[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out.append((doc_id, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(df):
    return [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()]


def made_up(rnd, n, alphabet="ab"):
    """Texts that are put together of a few passages, parts of them and random signs."""
    say = lambda k: "".join(rnd.choice(alphabet) for _ in range(k))
    passages = [say(rnd.randrange(10, 120)) for _ in range(12)]
    rows = []
    for k in range(n):
        text = ""
        for _ in range(rnd.randrange(0, 6)):
            p = rnd.choice(passages)
            a = rnd.randrange(len(p))
            text += rnd.choice([say(rnd.randrange(0, 40)), p, p[a:], p[:a]])
        rows.append((k, text))
    return rows


@pytest.mark.parametrize("seed,alphabet,least", [(1, "abcdefgh é", 20), (2, "ab", 32), (3, "a\0", 16), (4, "abcd", 100)])
def test_made_up_texts_equal_brute_force(spark, seed, alphabet, least):
    rows = made_up(random.Random(seed), 250, alphabet) + [(None, None), (7, ""), (None, "a" * 90), (8, "ab" * 60), (8, "x" * least), (9, "y" * (least + 1))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(rows_of(suffixes.digests(suffixes.covered(df, least)))) == Counter(brute(rows, least))


def test_crowded_suffixes_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(5)
    say = lambda k: "".join(rnd.choice("abcdef") for _ in range(k))
    passage = say(75)
    rows = [(k, say(rnd.randrange(30)) + passage[rnd.randrange(0, 12) : 75 - rnd.randrange(0, 12)] + say(rnd.randrange(30))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(brute(rows, 64))
    assert any(r[2] for r in want) and any(not r[2] for r in want)
    assert Counter(rows_of(suffixes.digests(suffixes.covered(df, 64)))) == want
    monkeypatch.setattr(suffixes, "CROWD", 3)
    monkeypatch.setattr(suffixes, "KEYS", 400)
    assert Counter(rows_of(suffixes.digests(suffixes.covered(df, 64, batches=7)))) == want


def test_crowded_suffixes_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "KEYS", 2000)
    rnd = random.Random(6)
    say = lambda k: bytes(rnd.choice(b"abcdef") for _ in range(k))
    s, left, right = suffixes.Suffixes(64), say(40), say(64)
    rows = []
    for k in range(600):
        a, b = rnd.randrange(20, 41), rnd.randrange(30, 65)
        rows.append((7, k, left[:a] + say(40 - a), right[:b] + say(64 - b)))
    h, ctx, before, after = (list(x) for x in zip(*rows, strict=True))
    low, high = suffixes.reach(np.array(h), before, after, s.least, s.span)
    parts = suffixes._counted(spark.createDataFrame(rows, "h long, ctx long, before binary, after binary"), s).rdd.glom().collect()
    got = {}
    for r in (r for p in parts for r in p):
        x = got.setdefault(r.ctx, [0, 0])
        x[:] = max(x[0], r.low), max(x[1], r.high)
    assert got == {k: [low[k], high[k]] for k in ctx if low[k] >= 0}
    assert 300 < len(got) < 600
    # Before, one small file was one task, whatever it had to hash.
    assert max(len(p) for p in parts) < 120


@pytest.mark.parametrize("least", [64, 400])
def test_work_on_crowded_suffixes_follows_their_number(spark, monkeypatch, least):
    """Runs of one word of many lengths, with texts around them that two suffixes share in part."""
    monkeypatch.setattr(suffixes, "KEYS", {64: 500, 400: 2000}[least])
    s, hashes = suffixes.Suffixes(least), spark.sparkContext.accumulator(0)

    class Counting:
        def __init__(self, counter):
            self.counter = counter

        def xxh3_64_intdigest(self, *what):
            self.counter.add(1)
            return xxhash.xxh3_64_intdigest(*what)

    monkeypatch.setattr(suffixes, "xxhash", Counting(hashes))
    n, rnd, spent = {64: 120, 400: 60}[least], random.Random(7), []
    say = lambda k: bytes(rnd.choice(b"abcdefgh") for _ in range(k))
    for times in (1, 4):
        rows = []
        for k in range(n * times):
            i, j = rnd.randrange(s.span + 20), rnd.randrange(s.key, least + 80)
            if k % 3 != 1:
                left, right = (b" fo" * least)[:i] + say(s.span), (b"of " * least)[:j] + say(least)
            i, j = rnd.randrange(s.span * 3 // 4, s.span), rnd.randrange(least * 7 // 8, least)
            rows.append((9, k, (left[:i] + say(s.span))[: s.span - 1], (right[:j] + say(least))[:least]))
        h, ctx, before, after = (list(x) for x in zip(*rows, strict=True))
        low, high = suffixes.reach(np.array(h), before, after, s.least, s.span)
        was = hashes.value
        got = suffixes._counted(spark.createDataFrame(rows, "h long, ctx long, before binary, after binary"), s).groupBy("h", "ctx").agg({"low": "max", "high": "max"}).collect()
        spent.append(hashes.value - was)
        assert {r.ctx: (r["max(low)"], r["max(high)"]) for r in got} == {k: (low[k], high[k]) for k in ctx if low[k] >= 0}
        assert n * times // 4 < len(got) < n * times
    # Before, all strings were hashed again for each block of those that stand twice, so that the work grew with the square.
    assert spent[1] < 5 * spent[0], spent


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = Counter(brute([(r.doc_id, r.text) for r in docs.collect()], 400))
    got = rows_of(queries.op12_suffix_dedup(spark, SF))
    assert Counter(got) == want
    assert any(r[2] for r in got)


def test_levels_merge_geometrically(spark):
    family = suffixes.IndexFamily(20)
    rows = made_up(random.Random(8), 40, "abc")
    sizes = []
    for k in range(6):
        family.add(spark.createDataFrame(rows[6 * k : 6 * k + 6], "doc_id long, text string"))
        sizes.append([n for n, _ in family.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2]]
    for _, level in family.levels:
        parts = level.rdd.mapPartitions(lambda rows: [[tuple(r)[:3] for r in rows]]).collect()
        assert all(p == sorted(set(p)) for p in parts)


def test_every_string_has_a_suffix_at_one_place():
    rnd = random.Random(9)
    s = suffixes.Suffixes(30)
    for alphabet in ("a", "ab", "abcdefghij"):
        text = "".join(rnd.choice(alphabet) for _ in range(700)).encode()
        whole = s.of([text, text[5:300], b"", text[:29]])[2]
        own = np.array(whole)
        assert (own < 995).all()
        for i in range(0, 671):
            inside = own[(own >= i) & (own < i + s.span)]
            alone = s.of([text[i : i + 30]])[2]
            assert len(alone) == 1 and i + alone[0] in inside


def test_bytes_that_are_no_utf8_and_long_texts(spark):
    rnd = random.Random(2)
    text = bytes(rnd.randrange(256) for _ in range(3000))
    rows = [(1, text), (2, b"\xff" + text[100:700]), (3, bytes(500))]
    df = spark.createDataFrame(rows, "doc_id long, text binary")
    assert Counter(rows_of(suffixes.digests(suffixes.covered(df)))) == Counter(brute(rows, 400))
    long = "".join(rnd.choice("abcdefgh ") for _ in range(2_000_000))
    got = {r[0]: r[1:4] for r in rows_of(suffixes.digests(suffixes.covered(spark.createDataFrame([(1, long), (2, long[1_000_000:1_000_500]), (3, "z" * 1_000_000)], "doc_id long, text string"))))}
    assert got == {1: (2_000_000, 500, 1), 2: (500, 500, 1), 3: (1_000_000, 1_000_000, 1)}


def test_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a" * 50, "x", 5)], "doc_id long, text string, spans string, h int")
    got = suffixes.covered(df, 20)
    assert [tuple(r) for r in got.collect()] == [(1, 50, [(0, 50)], b"")]
    assert suffixes.covered(df.limit(0), 20).count() == 0
