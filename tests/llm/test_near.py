"""Near-duplicate groups against all pairs by brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import near, queries


def brute(docs, width, percent=80):
    def own(t):
        w = (t or "").encode().lower().split()
        return {tuple(w)} if 0 < len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if w else set()

    sets = [own(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                common = len(x & y)
                if 100 * common >= percent * (len(x) + len(y) - common):
                    root[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(docs):
        r = find(k)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    return [(d, len(sets[k]), least[find(k)], d == least[find(k)]) for k, (d, _) in enumerate(docs)]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(6)
    vocab = [f"w{k}" for k in range(500)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    out = []
    for _ in range(40):
        base = say(rng.choice([3, 20, 60, 200]))
        for _ in range(rng.choice([1, 2, 5, 9])):
            out.append([w if rng.random() > rng.choice([0, 0.02, 0.05, 0.1]) else rng.choice(vocab) for w in base])
    chain = say(100)  # each is a copy of the one before, the ends aren't alike
    for _ in range(25):
        out.append(list(chain))
        chain[rng.randrange(100)] = rng.choice(vocab)
    rng.shuffle(out)
    rows = [(3 * k, " ".join(w)) for k, w in enumerate(out)]
    return [*rows, (1, None), (4, ""), (7, " \t\n"), (10, "one"), (13, "ONE"), (16, "one two"), (19, "one"), (None, "lonely null id here"), (None, rows[0][1]), (22, "w1 " * 30000), (25, "w1 w1"), (25, "w1 w1")]


@pytest.mark.parametrize("width", [2, 5])
def test_groups_equal_brute_force(spark, docs, width):
    df = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in docs], "doc_id long, text string, n int, region string, comp int").repartition(5)
    got = near.near_groups(df, width)
    assert got.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert order(map(tuple, got.collect())) == order(brute(docs, width))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_groups_of_a_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = order(map(tuple, queries.op2_lsh_forest(spark, f"/root/testdata/{sf}").collect()))
    assert got == order(brute(rows, 2))
    assert len({r[2] for r in got}) < len(got)


def test_one_copy_of_each_group_stays(spark, docs):
    df = spark.createDataFrame([d for d in docs if d[0] is not None], "doc_id long, text string").dropDuplicates(["doc_id"])
    want = {r[0] for r in brute([tuple(r) for r in df.collect()], 5) if r[3]}
    assert {r.doc_id for r in near.without_copies(df).collect()} == want
    assert near.near_groups(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(400).select((F.col("id") * 7919 % 401).alias("a"), ((F.col("id") + 1) * 7919 % 401).alias("b"))
    assert {r.comp for r in near.components(links).collect()} == {0}


def test_similar_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    both = rng.integers(0, 2**63, 1000).astype(np.uint64)
    a, b = np.unique(both[:900]), np.unique(both[100:])
    assert abs((near.signature(a) == near.signature(b)).mean() - 0.8) < 0.1


@pytest.mark.parametrize("crowd", [2])
def test_crowded_regions_are_deepened_and_lose_no_link(spark, docs, monkeypatch, crowd):
    monkeypatch.setattr(near, "CROWD", crowd)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert order(map(tuple, near.near_groups(df, 2).collect())) == order(brute(docs, 2))


def test_regions_are_as_deep_as_their_size_asks(spark, monkeypatch):
    monkeypatch.setattr(near, "CROWD", 2)
    place = lambda *v: sum(x << 16 * (3 - k) for k, x in enumerate(v)) - (1 << 64 if v[0] >> 15 else 0)
    rows = [(1, place(7, 7, 1, 1), 0, 9, 0), (1, place(7, 7, 2, 1), 1, 9, 1), (1, place(7, 8, 2, 1), 2, 9, 2), (1, place(65535, 8, 2, 1), 3, 9, 3), (2, place(1, 1, 1, 1), 4, 9, 4), (2, place(2, 1, 1, 1), 5, 9, 5), (3, 0, 6, 9, 6), (3, 0, 7, 9, 6)]
    got = near._regions(spark.createDataFrame(rows, "region long, place long, text long, n long, comp long")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.region, set()).add(r.text)
    assert sorted(map(sorted, groups.values())) == [[0, 1], [4, 5]]
    a = np.array([place(7, 7, 1, 1), place(7, 7, 1, 1)], np.int64).view(np.uint64)
    assert near.prefix_lengths(a, np.array([place(7, 7, 1, 1), place(7, 1, 1, 1)], np.int64).view(np.uint64)).tolist() == [4, 1]


def test_maps_never_rule_out_what_is_common():
    rng = np.random.default_rng(2)
    for size in (1, 50, 3000):
        pool = rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2)
        a, b = (np.unique(rng.choice(pool, size)) for _ in range(2))
        maps = [np.frombuffer(near.shingle_map(x), np.uint64) for x in (a, b)]
        assert near.most_common(len(a), np.array([len(b)]), maps[0], maps[1][None])[0] >= len(np.intersect1d(a, b))
