"""Chunking and substring dedup against brute force and planted passages."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import common, queries, substrings


def brute_chunks(text):
    raw, h, hashes = text.encode(), 0, []
    for b in b"\0" * 16 + raw:
        h = ((h << 1) + int(substrings._GEAR[b])) & 0xFFFF
        hashes.append(h)
    hashes = hashes[16:]
    whole = [k for k in range(1, len(raw)) if raw[k] & 0xC0 != 0x80]
    cuts = [0, *(k for k in whole if hashes[k - 1] >> (16 - substrings.CUT_BITS) == 0), len(raw)]
    out = []
    for begin, end in zip(cuts, cuts[1:]):
        while end - begin > substrings.LONGEST:
            at = min((k for k in range(begin + substrings.LONGEST // 2 + 1, begin + substrings.LONGEST + 1) if raw[k] & 0xC0 != 0x80), key=lambda k: hashes[k - 1])
            out.append((begin, at))
            begin = at
        out.append((begin, end))
    return [(raw[a:b].decode(), xxhash.xxh3_64_intdigest(raw[a:b])) for a, b in out] if raw else []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abé中 \n\0")), max_size=200), min_size=1, max_size=4))
def test_chunks_equal_brute_force(texts):
    c = substrings.chunks(texts)
    start, stop, words = c.places()
    for k, t in enumerate(texts):
        own = np.flatnonzero(c.text == k)
        want = brute_chunks(t)
        assert c.number[own].tolist() == list(range(len(want)))
        assert [t[a:b] for a, b in zip(start[own], stop[own])] == [x for x, _ in want]
        assert c.digest[own].tolist() == [h for _, h in want]
        if "\0" not in t:
            assert words[own].sum() == len(t.encode().split())


def test_a_stretch_without_cuts_is_cut_alike_wherever_it_stands():
    c = substrings.chunks(["x" * 100_000, "ab" * 50_000])
    assert (c.high - c.low).max() <= substrings.LONGEST and len(c.low) > 6000


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioubcdfgé") for _ in range(rng.randint(2, 9)))
    say = lambda n: " ".join(word() for _ in range(n))
    passages = [say(70) for _ in range(30)]
    docs = []
    for k in range(150):
        docs.append((k, f"{say(rng.randint(0, 80))} {passages[k % 30] if k % 3 else ''} {say(rng.randint(0, 80))}"))
    docs += [(900, None), (901, ""), (902, "same words " * 500), (None, f"{say(9)} {passages[1]} {say(5)}"), (903, say(300)), (903, say(300))]
    return docs, passages


def frame(spark, docs):
    return spark.createDataFrame([(d, t, 1, "x", 2) for d, t in docs], "doc_id long, text string, n int, h string, run int")


def test_passages_are_found_and_clean_documents_left(spark, planted):
    docs, passages = planted
    got = substrings.repeats(frame(spark, docs)).collect()
    holding = {d: next((p for p in passages if p in (t or "")), None) for d, t in docs}
    assert {r.doc_id for r in got} == {d for d, p in holding.items() if p}
    texts = dict(docs)
    for r in got:
        assert texts[r.doc_id][r.start : r.stop].strip() in holding[r.doc_id] or r.stop - r.start < len(holding[r.doc_id]) + 40
        first = min(d for d, p in holding.items() if p == holding[r.doc_id] and d is not None)
        assert r.first_doc_id == first and (r.n_cut == 0) == (r.doc_id == first)


def test_cut_texts_keep_one_copy(spark, planted):
    docs, passages = planted
    docs = [d for d in docs if d[0] not in (None, 903)]
    before = dict(docs)
    twins = substrings.without_repeats(frame(spark, [(None, "x " + passages[0]), (None, passages[0]), (5, "y " + passages[0]), (5, "short")])).collect()
    assert sorted(len(r.text) > 0.9 * len(passages[0]) for r in twins) == [False, False, False, True]
    after = {r.doc_id: r.text for r in substrings.without_repeats(frame(spark, docs)).collect()}
    assert set(after) == set(before)
    for p in passages:
        holders = [d for d, t in docs if p in (t or "")]
        if holders:
            assert after[holders[0]] == before[holders[0]]
            for d in holders[1:]:
                gone = len(before[d]) - len(after[d])
                assert p not in after[d] and 0.4 * len(p) < gone <= len(p) + 40
    assert after[902] == before[902] and after[900] is None


def test_pieces_of_many_documents_are_no_repeat(spark):
    rng = random.Random(8)
    docs = [(k, " ".join("".join(rng.choice("aeioubcdfg") for _ in range(rng.randint(2, 9))) for _ in range(120))) for k in range(12)]
    mosaic = " ".join(" ".join(t.split()[40:52]) for _, t in docs)
    assert substrings.repeats(frame(spark, [*docs, (99, mosaic)])).count() == 0


def is_letter(b):
    return b > 127 or chr(b).isalnum()


def brute_repeats(docs, least):
    """Runs of windows of other documents, by dictionaries, each end held against all places of its window, byte by byte."""
    own, where, raws = [], {}, [(t or "").encode() for _, t in docs]
    for k, (_, t) in enumerate(docs):
        cs, at, out = [c.encode() for c, _ in brute_chunks(t or "")], 0, []
        for c in cs:
            out.append((at, at + len(c)))
            at += len(c)
        size = min(substrings.WINDOW, len(cs))
        own.append([(n, tuple(cs[n - size + 1 : n + 1]), out[n - size + 1][0], out[n][1]) for n in range(size - 1, len(cs)) if size])
        for n, w, a, b in own[-1]:
            where.setdefault(w, []).append((docs[k][0] is None, docs[k][0] or 0, k, n, a, b))

    def first_byte(raw, p):
        return is_letter(raw[p]) and not (p and is_letter(raw[p - 1]))

    def last_byte(raw, p):
        return is_letter(raw[p]) and not (p + 1 < len(raw) and is_letter(raw[p + 1]))

    def begun(raw, a, b):
        return sum(not raw[j : j + 1].isspace() and (j == 0 or raw[j - 1 : j].isspace()) for j in range(a, b))

    def beyond(k, w, edge, after):
        """Bytes that the document shares with another beyond a run's end, up to a whole word, and the words."""
        best, raw = 0, raws[k]
        for *_, other, _, a, b in where[w]:
            if docs[other] == docs[k]:
                continue
            to, at = raws[other], b if after else a
            for x in range(1, (substrings.AFTER if after else substrings.BEFORE) + 1):
                p, q = (edge + x - 1, at + x - 1) if after else (edge - x, at - x)
                if min(p, q) < 0 or p >= len(raw) or q >= len(to) or raw[p] != to[q]:
                    break
                if (last_byte if after else first_byte)(raw, p) and (last_byte if after else first_byte)(to, q):
                    best = max(best, x)
        if after or not best:
            return best, begun(raw, edge, edge + best)
        return best, begun(raw, edge - best, edge) + (not begun(raw, edge - best, edge - best + 1))

    got = []
    for k, (d, _) in enumerate(docs):
        runs, last = [], None
        for n, w, a, b in own[k]:
            if len({x[2] for x in where[w]}) > 1:
                if last != n - 1:
                    runs.append([a, b, set(), w, w])
                runs[-1][1], runs[-1][4] = b, w
                runs[-1][2].add(min(where[w])[:2])
                last = n
        for a, b, firsts, opening, closing in runs:
            words, before, after = begun(raws[k], a, b), 0, 0
            if words < least:
                before, more = beyond(k, opening, a, False)
                after, further = beyond(k, closing, b, True)
                words += more + further
            if words >= least:
                chars = [len(raws[k][:x].decode()) for x in (a - before, b + after)]
                got.append((d, *chars, words))
    return got


@pytest.mark.parametrize("least", [20, substrings.LEAST_WORDS])
def test_runs_equal_brute_force(spark, planted, least):
    docs = [(d, t) for d, t in planted[0] if t is None or "\0" not in t]
    docs += [(300 + k, f"{'no and ' * k}{docs[1][1][3 * k:][:400]} {k} end.") for k in range(20)]
    got = substrings.repeats(frame(spark, docs), least_words=least).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:4])
    want = sorted(brute_repeats(docs, least), key=key)
    assert sorted([tuple(r)[:4] for r in got], key=key) == want and len(want) > 100


@pytest.mark.parametrize("letters", [(2, 9), (1, 5), (3, 3)])
def test_passages_of_51_words_are_found_and_of_45_are_not(spark, letters):
    rng = random.Random(11)
    say = lambda n: " ".join("".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(*letters))) for _ in range(n))
    docs = []
    for k in range(400):
        long, short = say(51), say(45)
        docs += [(4 * k + j, f"{say(60)} {p} {say(60)}") for j, p in enumerate((long, long, short, short))]
    got = {r.doc_id: r for r in substrings.repeats(frame(spark, docs)).collect()}
    wanted = {d for d, _ in docs if d % 4 < 2}
    assert len(wanted - set(got)) <= 2 and not set(got) - wanted
    texts = dict(docs)
    assert all(" ".join(texts[d].split()[60:111]) in texts[d][r.start : r.stop] for d, r in got.items())


def test_empty_table(spark, planted):
    assert substrings.repeats(frame(spark, planted[0]).limit(0)).count() == 0


def test_every_copied_document_has_its_repeat(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    copies = docs.groupBy("text").agg(F.count("*").alias("n")).filter("n > 1").join(docs, "text").filter(F.size(F.split("text", r"\s+")) > 60)
    got = queries.op7_substring_dedup(spark, sf)
    ids = {r.doc_id for r in copies.select("doc_id").collect()}
    assert ids and ids <= {r.doc_id for r in got.select("doc_id").collect()}


def test_a_step_takes_little_memory():
    # An executor's workers hold a step each, next to its JVM.
    rnd = random.Random(5)
    texts = pa.RecordBatch.from_pydict({"text": [" ".join("".join(rnd.choices("abcdefgh", k=5)) for _ in range(500)) for _ in range(1000)]})
    tracemalloc.start()
    try:
        for (own,) in common.pieces_of([texts], ["text"], "text", substrings.STEP):
            c = substrings.chunks(own)
            first, last, h = substrings.windows(c)
            for after in (False, True):
                substrings.surroundings(c, first[: substrings.ENDS], last[: substrings.ENDS], h[: substrings.ENDS], after)
        assert tracemalloc.get_traced_memory()[1] < 64_000_000
    finally:
        tracemalloc.stop()
