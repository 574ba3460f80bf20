"""Token files, exact dedup, chat rotation and mixing against SQL, brute force and round trips."""

import glob
import hashlib
import math
import re
import statistics
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import assert_same
from pyspark.sql import functions as F

from weftline.llm import chat, common, exact, mixing, queries, token_files
from weftline.llm.common import shared_folder

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, place int, name string, shard int, start long, copy_no string"
ODD = [
    (5, "a  b\n\nc", "en", "s", 7),
    (5, "a  b\n\nc", "en", "s", 7),
    (2, None, None, None, None),
    (None, "", "en", None, 0),
    (9, "a b c", "en", "s", 5),
    (7, "x" * 1024 + "y", "en", "s", 0),
    (8, "x" * 1024 + "z", "en", "s", 0),
    (6, "x" * 1024 + "y", "en", "t", 0),
    (11, " lead  two   three\t tab \n line<|endoftext|> end's it'll 12 ½ 中文 é  ", "en", "t", 0),
    (12, "word " * 40000, "en", "t", 0),
    (13, "word " * 40000 + "!", "en", "t", 0),
]


def odd(spark):
    return spark.createDataFrame([(*r, "clash", 1, "clash", 3, 4, "clash") for r in ODD], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF)


# --- token files ---------------------------------------------------------------------------------


def brute_tokens(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    at, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_tokens_of_a_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op1_token_files(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(brute_tokens(rows))
    assert dict(got.dtypes) == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}


def test_tokens_of_odd_rows(spark):
    got = token_files.token_digests(odd(spark), queries.tokenizer_path()).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(brute_tokens([r[:2] for r in ODD]), key=key)


def test_tokens_of_an_empty_table(spark):
    assert token_files.token_digests(odd(spark).limit(0), queries.tokenizer_path()).count() == 0


def test_files_give_back_all_ids_in_order(spark):
    path = shared_folder(spark, "test")
    token_files.write_token_files(spark.read.parquet(f"{SF}/documents.parquet"), path, queries.tokenizer_path())
    rows = token_files.read_token_files(spark, path, "ids array<int>", lambda ids: (ids.astype(np.int32),)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    counts = np.bincount([i for r in rows for i in r.ids])
    ranks = {r["rank"]: r["id"] for r in spark.read.parquet(f"{path}/ranks").collect()}
    by_rank = [counts[ranks[k]] for k in range(len(ranks))]
    assert by_rank == sorted(by_rank, reverse=True) and len(ranks) == (counts > 0).sum()


@given(st.lists(st.lists(st.sampled_from([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1]) | st.integers(0, 2**32 - 1), max_size=9), max_size=6))
def test_coding_round_trip(rows):
    n = np.array([len(r) for r in rows], np.int64)
    flat = np.array([x for r in rows for x in r], np.uint32)
    control, control_ends, data, data_ends = token_files.control_and_data(flat, n)
    assert token_files.ranks_from(control, data, n).tolist() == flat.tolist()
    at = [0, 0]
    for r, a, b in zip(rows, control_ends, data_ends, strict=True):  # each row by itself too
        assert a - at[0] == -(-len(r) // 4)
        assert token_files.ranks_from(control[at[0] : a], data[at[1] : b], np.array([len(r)])).tolist() == r
        at = [a, b]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab'sé1 \n\t\r.  中<|>")) | st.characters(exclude_categories=["Cs"]), max_size=40))
def test_pieces_encode_as_the_whole(text):
    encoder = token_files._encoder(queries.tokenizer_path())
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.encode([text, text])[1].tolist() == want
    assert encoder.encode_long(text).tolist() == want


def test_a_nul_after_a_space_is_kept():
    encoder = token_files.Encoder(queries.tokenizer_path())
    for text in ("a \0b", "\0", " \0", "\0 \0.", "a \0", "x \0b c \0b. \0\0", "\0a \0a!"):
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode([text])[0].tolist() == want and encoder.encode_long(text).tolist() == want


def test_words_beside_line_feeds_and_signs_are_known_again():
    encoder = token_files.Encoder(queries.tokenizer_path())
    encoder.encode(["one two.\nThree, four two, one.\nThree. two"])
    assert sorted(encoder.numbers) == ["\0\n", "\0,", "\0.", "\0Three", "\0one", "four", "one", "two"]


def test_words_in_one_string_encode_as_alone():
    encoder = token_files.Encoder(queries.tokenizer_path())
    words = ["".join(chr(97 + (k * 7 + j * j) % 26) for j in range(k % 9 + 1)) for k in range(3 * token_files.WORDS + 5)] + ["é", "ñandú", "中文", "日", "Ωmega"]
    alone = [" " * (k % 2) + w for k, w in enumerate(words)]
    want = [encoder.tokenizer.encode(w, add_special_tokens=False).ids for w in alone]
    ids, lengths = encoder._words(alone)
    assert ids.tolist() == sum(want, []) and lengths.tolist() == [len(w) for w in want]
    encoder.between = None  # vocabularies without a byte for it
    ids, lengths = encoder._words(alone)
    assert ids.tolist() == sum(want, []) and lengths.tolist() == [len(w) for w in want]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "é", "s", "1", " ", " ", "\n", "\t", "\0", ".", ",", "'", "\x1c", "\u3000", "<|endoftext|>", ".\n", ", "]), max_size=30).map("".join))
def test_cuts_change_no_ids(text):
    encoder = token_files._encoder(queries.tokenizer_path())
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.encode(["x, y", text, "b.\nc"])[1].tolist() == want
    assert encoder.encode_long(text).tolist() == want


def test_files_lie_in_order(spark):
    # The shards differ in size, so that Spark reads them in another order than they have.
    docs = spark.range(400).select("id", F.concat(F.lit("w"), F.repeat(F.lit(" some more"), F.when(F.col("id") < 200, 3).otherwise(((F.col("id") * 37) % 800).cast("int"))), F.col("id").cast("string")).alias("text")).withColumnRenamed("id", "doc_id")
    path = shared_folder(spark, "test")
    token_files.write_token_files(docs, path, queries.tokenizer_path())
    ids = [i for f in sorted(glob.glob(f"{path.removeprefix('file://')}/docs/*.parquet")) for i in pq.read_table(f)["doc_id"].to_pylist()]
    assert ids == list(range(400))


def test_forgetting_changes_nothing(monkeypatch):
    texts = [r"one two three, two Éa éa! four", "two three five.\nsix two", "été one. four four"]
    encoder = token_files.Encoder(queries.tokenizer_path())
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for limit in (2, 12):
        monkeypatch.setattr(token_files, "CACHE_ENTRIES", limit)
        for k in range(9):
            assert encoder.encode([texts[k % 3]])[0].tolist() == want[k % 3]


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_kinds_of_tokenizers(spark, name):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(name)
    t = Tokenizer.from_file(path)
    got = {r.doc_id: r.n_tokens for r in token_files.token_digests(odd(spark), path).collect()}
    assert all(got[r[0]] == len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in ODD)


# --- exact dedup ---------------------------------------------------------------------------------


def test_exact_groups_of_odd_rows(spark):
    got = exact.exact_groups(odd(spark)).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    groups = {}
    for r in ODD:
        groups.setdefault(norm(r[1]), []).append(r[0])
    assert len(got) == len(ODD)
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        rows = [r for r in got if r.text_sha256 == sha]
        keep = min((i for i in ids if i is not None), default=None)
        assert len(rows) == len(ids) and sum(r.kept for r in rows) == 1
        assert all(r.keep_id == keep and r.group_size == len(ids) for r in rows)
        assert next(r for r in rows if r.kept).doc_id == keep


@pytest.mark.parametrize("block", [1, 3, 7])
def test_small_blocks_give_the_same_groups(spark, block):
    texts = ["abcabcabc", "abcabcab", "abcabcabc", "", None, "aaaaaaa", "aaaaaaaa", "é中" * 9, "é中" * 9, "a" * 65, "a" * 64]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_groups(df, block=block).collect()}
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if (u or "") == (t or "")]
        assert got[i] == (same[0], len(same))


def test_blocks_of_one_hash_are_told_apart(spark):
    texts = ["abcdef", "abcdeg", "abcdef", "xbcdef", "abc", "abc", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_groups(df, block=3, hashed=lambda b: F.length(b).cast("long")).collect()}
    assert got == {0: (0, 2), 1: (1, 1), 2: (0, 2), 3: (3, 1), 4: (4, 2), 5: (4, 2), 6: (6, 2), 7: (6, 2)}


def test_bit_maps_hold_just_the_hashes_given(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63), 12345678901234567, *range(7, 10**16, 10**14)]
    df = spark.createDataFrame([(v,) for v in values], "h long")
    packed = common.bitmap_of(df, 20)
    assert common.in_bitmap(np.array(values, np.int64).view(np.uint64), packed, 20).all()
    assert np.unpackbits(packed).sum() == len({(v % 2**64) >> 44 for v in values})
    some = spark.range(2000).select(F.xxhash64("id").alias("h"))
    both = some.withColumn("bucket", F.shiftrightunsigned("h", 64 - 20 + 15)).join(common.bitmap_rows(df, 20), "bucket", "left")
    rows = both.select("h", common.has_bit(F.col("h"), 20, F.col("map")).alias("has")).collect()
    assert [r.has for r in rows] == common.in_bitmap(np.array([r.h for r in rows], np.int64).view(np.uint64), packed, 20).tolist()


def test_exact_groups_of_an_empty_table(spark):
    assert exact.exact_groups(odd(spark).limit(0)).count() == 0


# --- chat ----------------------------------------------------------------------------------------


def test_rotation_with_three_speakers(spark):
    rows = [(1, 0, "system", "be kind", 9), (1, 1, "Ann B", "hi <|im_end|>", 9), (1, 2, "bo", None, 9), (1, 300, None, "late", 9), (1, None, "bo", "when", 9), (2, 0, "system", "alone", 9), (None, 1, "bo", "x", 9), (None, 1, "bo", "x", 9)]
    got = {(r.conv_id, r.speaker, r.part): r for r in chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")).collect()}
    a = got[1, "Ann B", 0]
    assert a.text == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n<|im_start|>user name=bo\n<|im_end|>\n"
    assert [a.text[s.start : s.stop] for s in a.mask] == ["hi < |im_end|><|im_end|>"] and (a.n_turns, a.n_own) == (3, 1)
    b = got[1, "bo", 0]
    assert "<|im_start|>user name=Ann_B\n" in b.text and [b.text[s.start : s.stop] for s in b.mask] == ["<|im_end|>"]
    assert got[1, "unknown", 1].text == "<|im_start|>assistant\nlate<|im_end|>\n"
    assert {k[1] for k in got if k[0] == 1} == {"Ann B", "bo", "unknown"} and not [k for k in got if k[0] == 2]
    assert got[None, "bo", 0].n_own == 2
    assert len([k for k in got if k[:2] == (1, "bo") and k[2] < 0]) == 1


def test_every_turn_is_trained_on_once(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    got = chat.rotate(table)
    assert got.agg(F.sum("n_own")).first()[0] == table.filter("role <> 'system'").count()
    assert chat.rotate(table.limit(0)).count() == 0


def test_crowded_parts_are_cut_and_keep_all_rows_in_order(spark):
    rows = [(1, t, "ab"[t % 2], f"{t:03d} plain") for t in range(20)] + [(1, 7, "a", f"007 row {k}") for k in range(700)] + [(1, 9, "b", "009 same")] * 900 + [(1, None, "b", "000 none")] * 300
    rows += [(None, 5, "a", "005 same")] * 500 + [(2, t, "a", f"{t:03d} calm") for t in range(40)]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), part=32, crowd=64).collect()
    assert max(r.n_turns for r in got) <= 4 * 32 and len({(r.conv_id, r.speaker, r.part, r.slice) for r in got}) == len(got)
    for conv, speaker in {(r[0], r[2]) for r in rows}:
        own, turns = [], []
        for r in sorted((r for r in got if (r.conv_id, r.speaker) == (conv, speaker)), key=lambda r: (r.part, r.slice)):
            own += [r.text[m.start : m.stop] for m in r.mask]
            turns += re.findall(r"^(\d{3}) ", r.text, re.M)
            assert (r.n_turns, r.n_own) == (r.text.count(chat.END), len(r.mask))
        assert turns == sorted(f"{t or 0:03d}" for c, t, _, _ in rows if c == conv)
        assert sorted(own) == sorted(x + chat.END for c, _, w, x in rows if (c, w) == (conv, speaker))
    assert {r.slice for r in got if r.conv_id == 2} == {0}


# --- mixing --------------------------------------------------------------------------------------


def poisson_inverse(mean, u):
    n, p = 0, math.exp(-mean)
    c = p
    while c <= u:
        n += 1
        p *= mean / n
        c += p
    return n


def row_name(r, seen):
    """The digest of a row with its number among equal rows."""
    digest = hashlib.md5("".join("-" if c is None else f"{len(str(c))}:{c}" for c in r).encode()).hexdigest()
    seen[digest] += 1
    return f"{digest}#{seen[digest] - 1}"


def test_mixing_of_odd_rows(spark):
    got = mixing.mix(odd(spark), total=40 * len(ODD), seed=4)
    assert got.columns == [c for c in odd(spark).columns if c != "copy_no"] + ["copy_no"]
    sizes = {s: sum(r[3] == s for r in ODD) for s in {r[3] for r in ODD}}
    want, seen = Counter(), Counter()
    names = odd(spark).columns
    for r in ODD:
        rate = 40 * len(ODD) / len(sizes) / sizes[r[3]]
        m = max(1, math.ceil(rate / 32))
        own = tuple(c for c, n in zip((*r, "clash", 1, "clash", 3, 4, "clash"), names, strict=True) if n != "copy_no")
        name, copies = row_name(own, seen), 0
        for j in range(1, m + 1):
            copies += poisson_inverse(rate / m, int(hashlib.md5(f"4:{name}:{j}".encode()).hexdigest()[:13], 16) / 2**52)
        want.update((*own, k) for k in range(1, copies + 1))
    assert Counter(map(tuple, got.collect())) == want
    assert mixing.mix(odd(spark).limit(0)).count() == 0


def test_weights_and_spread(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("source"))
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("none", 5.0)], "source string, weight double").filter("source <> 'none'")
    got = mixing.mix(docs, weights, total=40000)
    n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["a"] - 10000) < 500 and abs(n["b"] - 30000) < 1000
    counts = docs.join(got.groupBy("doc_id").count(), "doc_id", "left").filter("source = 'b'").agg(F.avg(F.coalesce("count", F.lit(0))), F.var_samp(F.coalesce("count", F.lit(0)))).first()
    assert abs(counts[0] - 15) < 0.5 and abs(counts[1] - 15) < 2
    order = [r.doc_id for r in got.select("doc_id").limit(2000).collect()]
    assert abs(np.corrcoef(np.arange(len(order)), order)[0, 1]) < 0.1


def test_sources_without_a_weight_go(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "doc_id long, source string")
    got = mixing.mix(docs, spark.createDataFrame([(None, 2.0)], "source string, weight double"), total=50)
    assert {r.doc_id for r in got.collect()} == {2}


def test_no_python_on_the_main_path(spark, monkeypatch):
    plans = []

    def saved(df, *more, then=common.saved):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return then(df, *more)

    for module in (exact, mixing):
        monkeypatch.setattr(module, "saved", saved)
    for name in ("op3_exact_dedup", "op10_mixing", "op4_chat_rotation"):
        plans.append(queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 9 and not any("Python" in p or "Arrow" in p for p in plans)


@pytest.mark.parametrize("one_id,alike", [(5, False), (6, False), (7, True), (None, True)])
def test_rows_that_share_an_id_are_drawn_by_themselves(spark, one_id, alike):
    text = F.lit("same") if alike else F.concat(F.lit("t"), F.col("id").cast("string"))
    docs = spark.range(30000).select(F.when(F.col("id") < 10000, F.lit(one_id)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 10000, text).otherwise("x").alias("text"), F.lit("s").alias("source"))
    got = mixing.mix(docs.repartition(5))
    parts = [r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    n = got.filter(F.col("doc_id").eqNullSafe(one_id)).count()
    assert abs(sum(parts) - 30000) < 900 and abs(n - 10000) < 500
    assert max(parts) < 2 * statistics.median(parts)
    if alike:
        assert mixing.mix(docs.repartition(9)).groupBy("doc_id", "copy_no").count().exceptAll(got.groupBy("doc_id", "copy_no").count()).isEmpty()


def test_own_columns_stay_where_no_number_is_asked_for(spark):
    docs = spark.createDataFrame([(k, f"t{k}", "s", 7, 1.5, "o", "n") for k in range(50)], "doc_id long, text string, source string, copy_no int, cdf double, row string, `a.b` string")
    got = mixing.mix(docs, copy_col=None)
    assert got.columns == docs.columns and {r.copy_no for r in got.collect()} == {7}
    assert mixing.mix(docs).columns == [c for c in docs.columns if c != "copy_no"] + ["copy_no"]


def test_null_ids_are_drawn_by_their_texts(spark):
    docs = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    n = mixing.mix(docs).groupBy("text").count().groupBy("count").count().count()
    assert n > 3 and abs(mixing.mix(docs).count() - 2000) < 200


@pytest.mark.parametrize("texts", ["alike", "different"])
def test_rows_without_an_id_go_to_many_tasks(spark, texts):
    text = F.lit("same words") if texts == "alike" else F.concat(F.lit("t"), F.col("id").cast("string"))
    docs = spark.range(12000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).alias("doc_id"), text.alias("text"), F.lit(0).alias("place"))
    path = shared_folder(spark, "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few bytes are one task's
    try:
        token_files.write_token_files(docs.repartition(6), path, queries.tokenizer_path())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = [r["count"] for r in spark.read.parquet(f"{path}/docs").groupBy("shard").count().collect()]
    assert len(rows) > 4 and max(rows) < 2 * statistics.median(rows)
    got = sorted(token_files.read_token_files(spark, path, "crc long", token_files.crc_of).collect(), key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids) and len(ids) == 12000
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:])) and got[0].start == 0


def test_starts_of_many_shards(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_BLOCK", 7)
    n = [(3 * k, (k * 37) % 11) for k in range(100)]
    got = {r.shard: r.base for r in token_files.shard_starts(spark.createDataFrame(n, "shard int, n long").repartition(5)).collect()}
    assert got == {s: sum(x for t, x in n if t < s) for s, _ in n}
    assert token_files.shard_starts(spark.createDataFrame([], "shard int, n long")).count() == 0
