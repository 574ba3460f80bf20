import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from weftline.llm import align, queries

SF = "/root/testdata/sf0.001"
A, B = queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model")
ODD = ["", None, " ", "  ", "a", "a ", " a", "a  b ", "▁a b", "<|endoftext|> </s> <0x0A>", "ﬁ é é 日本 😀\n\tx\0y", "x" * 300, "\n\n\n", "word " * 400, "▁", "of the of the of the"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = {c: b for b, c in enumerate(bytes_to_signs())}
    return one, two, {k: bytes(byte[c] for c in e) if all(c in byte for c in e) else e.encode() for e, k in one.get_vocab().items()}


def bytes_to_signs():
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


def tokens(text, libraries):
    """(id, first byte, end) of the tokens of both, or nothing."""
    one, two, spelt = libraries
    if not text:
        return [], []
    a = [(i, spelt[i]) for i in one.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()) for i in two.encode(text) for p in [two.id_to_piece(i)]]
    whole = (" " + text).encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return [], []
    out = []
    for side in (a, b):
        at, rows = 0, []
        for i, x in side:
            rows.append((i, at, at + len(x)))
            at += len(x)
        out.append(rows)
    return tuple(out)


def brute(rows, libraries):
    each, count = [], Counter()
    for doc_id, text in rows:
        a, b = tokens(text, libraries)
        links, k = [], 0
        for i, lo, hi in a:
            while k and b[k][1] > lo:
                k -= 1
            while k < len(b) and b[k][1] < hi:
                if b[k][2] > lo:
                    links.append((i, b[k][0]))
                k += 1
            k = max(0, k - 1)
        count.update(links)
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        groups, at = [], [0, 0]
        for end in ends:
            sides = []
            for j, side in enumerate((a, b)):
                begin = at[j]
                while at[j] < len(side) and side[at[j]][2] <= end:
                    at[j] += 1
                sides.append(",".join(str(x[0]) for x in side[begin : at[j]]))
            groups.append("|".join(sides))
        each.append((doc_id, len(a), len(b), groups, links))
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for doc_id, n_a, n_b, groups, links in each:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), sha))
    return out


def rows_of(df):
    return [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()]


def same(got, want):
    assert Counter(got) == Counter(want)


def test_odd_texts_equal_brute_force(spark, libraries):
    rnd = random.Random(3)
    signs = "ab é日😀\n\t  ▁\0.,<|>s/0xA ️ﬁ "
    rows = list(enumerate(ODD)) + [(100 + k, "".join(rnd.choice(signs) for _ in range(rnd.randrange(1, 40)))) for k in range(300)]
    rows += [(None, "no id"), (None, "no id"), (5, "an id again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, libraries)
    same(rows_of(align.alignment_digests(df, A, B)), want)
    same(rows_of(align.alignment_digests(df, A, B, broadcast_pairs=0)), want)


def test_documents_equal_brute_force_both_ways(spark, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], libraries)
    same(rows_of(queries.op13_alignment(spark, SF)), want)
    same(rows_of(align.alignment_digests(docs, A, B, broadcast_pairs=0)), want)


def test_pieces_equal_the_library(libraries):
    rnd = random.Random(4)
    e = align.PieceEncoder(B)
    assert e.by_pieces
    texts = ["".join(rnd.choice("ab é日\n  ▁\0.") for _ in range(rnd.randrange(0, 15))) for _ in range(5000)]
    assert [x.tolist() for x in e.encode(texts)] == [libraries[1].encode(t) for t in texts]


def test_a_long_text_in_steps(spark, libraries, monkeypatch):
    text = "  " + "some words, and more  of them. " * 3000 + "   "
    monkeypatch.setattr(align, "STEP", 1000)
    for e, want in ((align.PieceEncoder(B), libraries[1].encode(text)), (align.LevelEncoder(A), libraries[0].encode(text, add_special_tokens=False).ids)):
        assert e.encode_long(text).tolist() == want


def test_products_of_groups(spark):
    df = spark.createDataFrame([(1, "3,4|7;5|8,9"), (2, "")], "doc_id long, groups string")
    got = sorted(map(tuple, align.group_products(df).collect()))
    assert got == [(1, 0, 3, 7), (1, 0, 4, 7), (1, 1, 5, 8), (1, 1, 5, 9)]


def test_clashing_columns_and_empty_tables(spark, libraries):
    df = spark.createDataFrame([(1, "one two", "x", 5, b"y")], "doc_id long, text string, groups string, n_a int, codes binary")
    same(rows_of(align.alignment_digests(df, A, B)), brute([(1, "one two")], libraries))
    for most in (0, 10):
        assert align.alignment_digests(df.limit(0), A, B, most).count() == 0
        assert align.alignment_digests(df.select("doc_id", F.lit("").alias("text")), A, B, most).count() == 1
