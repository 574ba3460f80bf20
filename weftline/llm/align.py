"""Cross-tokenizer alignment by elementary intervals: the token ends of both tokenizers cut a text into overlaps."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import pieces_of, saved
from weftline.llm.token_files import _BYTES, Encoder

#: Bytes of text that are encoded at once; a longer text is a step of its own.
STEP = 1_000_000
#: Links whose distinct pairs a task merges before it passes them on.
MERGE = 4_000_000
#: Id pairs up to which their counts are broadcast (13 bytes each); beyond, they are joined with the pairs of packets of documents.
BROADCAST_PAIRS = 2_000_000
#: Bytes of text of the documents whose pairs are looked up together where the counts aren't broadcast.
PACKET = 8_000_000

_SPACE = "▁"
_CUT = re.compile(f"(?<=[^ {_SPACE}]) ")


class PieceEncoder(Encoder):
    """encode() of the sentencepiece library, with the ids of pieces of text kept.

    A space is part of the piece that follows it, and no entry of the vocabulary holds one after another
    character; so nothing is merged over a space that follows another character, and the text is cut there. Each different
    piece is encoded by the library once. Vocabularies that do hold such entries get their texts whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        entries = [self.model.id_to_piece(k) for k in range(self.size)]
        self.by_pieces = not any(_SPACE in e.lstrip(_SPACE) for e in entries) and self.model.encode("a a", out_type=str)[:1] == [_SPACE + "a"]
        byte = [bytes([int(e[3:5], 16)]) if self.model.is_byte(k) else e.replace(_SPACE, " ").encode() for k, e in enumerate(entries)]
        self.token_bytes = byte
        self.clear()

    def pieces(self, text: str) -> list[str]:
        """Pieces without the one space that the library itself puts first. Spaces at the end stay with the last one."""
        body = text.rstrip(" ")
        parts = _CUT.split(body) if "  " in body or body[:1] == " " or _SPACE in body else body.split(" ")
        parts[-1] += text[len(body) :]
        return parts

    def _learn(self, known: int) -> None:
        fresh = self._from(known)
        if (more := len(self.numbers) - len(self.start)) > 0:
            self.start, self.length, self.seen = (np.pad(x, (0, max(more, len(x)))) for x in (self.start, self.length, self.seen))
        ids = self.model.encode(fresh, num_threads=1)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self._keep(np.arange(known, known + len(fresh)), np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths)

    def encode_long(self, text: str) -> np.ndarray:
        out, at, body = [], 0, len(text.rstrip(" "))
        while at < len(text):
            cut = _CUT.search(text, min(body, at + STEP), body)
            out += self.encode([text[at : cut.start() if cut else len(text)]])
            at = cut.end() if cut else len(text)
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


class LevelEncoder(Encoder):
    """Encoder of a byte-level vocabulary that takes the strings of special tokens for plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        shown = {chr(c): b for b, c in _BYTES.items()}
        self.token_bytes = [b""] * self.size
        for entry, k in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.token_bytes[k] = bytes(shown[c] for c in entry) if set(entry) <= shown.keys() else entry.encode()


_pairs: dict[tuple[str, str], tuple[Encoder, Encoder]] = {}


def encoders(a: str, b: str) -> tuple[Encoder, Encoder]:
    if (a, b) not in _pairs:
        _pairs[a, b] = LevelEncoder(a), PieceEncoder(b)
    return _pairs[a, b]


class Intervals:
    """Elementary intervals of texts that lie one after the other: ids, and ends in bytes, of each tokenizer's tokens.

    union: the ends of all intervals; own_a, own_b: the token of each tokenizer that an interval lies in;
    shared: the ends that both have, each of which closes a group.
    """

    def __init__(self, ends_a: np.ndarray, ends_b: np.ndarray):
        self.union = np.union1d(ends_a, ends_b)
        self.own_a, self.own_b = np.searchsorted(ends_a, self.union), np.searchsorted(ends_b, self.union)
        self.shared = self.union[(ends_a[self.own_a] == self.union) & (ends_b[self.own_b] == self.union)] if len(self.union) else self.union
        self.group_a, self.group_b = np.searchsorted(self.shared, ends_a), np.searchsorted(self.shared, ends_b)


def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal signs of the numbers below size, with one place more, and how many there are of each."""
    n = np.array([len(str(k)) for k in range(size)])
    wide = int(n.max(initial=1)) + 1
    return np.frombuffer("".join(str(k).ljust(wide) for k in range(size)).encode(), np.uint8).reshape(size, wide), n


def groups_text(at: Intervals, ids_a: np.ndarray, ids_b: np.ndarray, stops: np.ndarray, digits: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Groups as text, `a1,a2|b1;a3|b2,b3`, of all texts in a row, and where each text's ends; stops: the ends of the texts in bytes."""
    before_a = np.searchsorted(at.group_a, np.arange(len(at.shared)), "right")
    before_b = np.searchsorted(at.group_b, np.arange(len(at.shared)), "left")
    ids, sign = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
    place_a, place_b = np.arange(len(ids_a)) + before_b[at.group_a], np.arange(len(ids_b)) + before_a[at.group_b]
    ids[place_a], ids[place_b] = ids_a, ids_b
    sign[place_a[before_a - 1]] = ord("|")
    last = np.append(before_b[1:], len(ids_b))[: len(at.shared)] - 1
    sign[place_b[last]] = ord(";")
    table, lengths = digits
    rows, n = table[ids], lengths[ids]
    rows[np.arange(len(ids)), n] = sign
    ends = np.cumsum(n + 1)
    closing = place_b[last][np.searchsorted(at.shared, stops)]  # the last token of each text
    keep = np.arange(table.shape[1]) <= n[:, None]
    keep[closing, n[closing]] = False
    return rows[keep], ends[closing] - np.arange(1, len(stops) + 1)


def alignments(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, packet, codes, times: one row a document, repeated rows too.

    a: the file of a byte-level vocabulary, which encodes a space and the text; b: that of a piece vocabulary, which
    encodes the text and adds the space itself. Both take special tokens' strings for plain text. A link is a
    token of a and a token of b whose byte ranges overlap; each elementary interval between neighbouring ends is one. A
    group ends where a token of both does. groups: `a1,a2|b1;a3|b2,b3`. codes: the different id pairs of the
    links (a * size of b + b) in ascending order, times: how many links each has, both as little-endian numbers of
    code_type() and 32 bits.

    Texts that are null, empty, or not what the tokens of a or of b spell (as where b writes a character in another
    way) have no tokens: zeros, empty groups and codes. Null ids stay; other columns are left out; an empty table gives no rows. A
    text is held whole: memory grows with the longest one (by about 60 bytes for each of its own).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.make_valid_utf8(F.col(text_col)).alias("text"))
    wide = code_type(a, b)

    def aligned(batches):
        one, two = encoders(a, b)
        digits = _digits(max(one.size, two.size))
        length_a, length_b = (np.array([len(x) for x in e.token_bytes], np.int64) for e in (one, two))
        base, used = TaskContext.get().partitionId() << 33, 0
        for ids, texts in pieces_of(batches, ["doc_id", "text"], "text", STEP):
            full = [k for k, t in enumerate(texts) if t]
            encode = lambda e, ts: [e.encode_long(t) for t in ts] if len(ts) == 1 else e.encode(ts)
            each = zip(full, encode(one, [" " + texts[k] for k in full]), encode(two, [texts[k] for k in full]), strict=True)
            good = [(k, x, y) for k, x, y in each if _spelt(one, x) == _spelt(two, y) == b" " + texts[k].encode()]
            counts = np.zeros((4, len(texts)), np.int64)
            groups, codes, times = [""] * len(texts), [b""] * len(texts), [b""] * len(texts)
            if good:
                which = np.array([k for k, _, _ in good])
                flat_a, flat_b = (np.concatenate([g[j] for g in good]).astype(np.int64) for j in (1, 2))
                n_a, n_b = (np.array([len(g[j]) for g in good]) for j in (1, 2))
                ends_a, ends_b = np.cumsum(length_a[flat_a]), np.cumsum(length_b[flat_b])
                stops = ends_a[np.cumsum(n_a) - 1]
                at = Intervals(ends_a, ends_b)
                links, closed = (np.searchsorted(x, stops, "right") for x in (at.union, at.shared))
                counts[:, which] = n_a, n_b, np.diff(closed, prepend=0), np.diff(links, prepend=0)
                text, cuts = groups_text(at, flat_a, flat_b, stops, digits)
                text = text.tobytes().decode("ascii")
                pair = flat_a[at.own_a] * two.size + flat_b[at.own_b]
                doc = np.repeat(np.arange(len(good)), counts[3, which])
                order = np.lexsort((pair, doc))
                pair, doc = pair[order], doc[order]
                first = np.flatnonzero((np.diff(pair, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
                n = np.diff(np.append(first, len(pair))).astype("<u4")
                pair, bounds = pair[first].astype(wide), np.searchsorted(doc[first], np.arange(len(good) + 1))
                for j, k in enumerate(which.tolist()):
                    groups[k] = text[cuts[j - 1] if j else 0 : cuts[j]]
                    codes[k], times[k] = (x[bounds[j] : bounds[j + 1]].tobytes() for x in (pair, n))
            packet = [base + used // PACKET] * len(texts)
            used += sum(len(t or "") for t in texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, counts), pa.array(groups), pa.array(packet, pa.int64()), pa.array(codes), pa.array(times)], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "packet", "codes", "times"])
        one.clear()
        two.clear()

    return rows.mapInArrow(aligned, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, packet long, codes binary, times binary")


def _spelt(encoder: Encoder, ids: np.ndarray) -> bytes:
    return b"".join(map(encoder.token_bytes.__getitem__, ids.tolist()))


def code_type(a: str, b: str) -> str:
    one, two = encoders(a, b)
    return "<u4" if one.size * two.size <= 1 << 32 else "<i8"


def group_products(aligned: DataFrame) -> DataFrame:
    """doc_id, group, a, b: every id of a group's first part with every one of its second, for rows of alignments().

    Rows are made one after the other, never held; a group has as many as the product of its two sides.
    """
    one = aligned.filter("groups <> ''").select("doc_id", F.posexplode(F.split("groups", ";")).alias("group", "g"))
    sides = one.select("doc_id", "group", F.split(F.split_part("g", F.lit("|"), F.lit(1)), ",").cast("array<int>").alias("x"), F.split(F.split_part("g", F.lit("|"), F.lit(2)), ",").cast("array<int>").alias("y"))
    return sides.select("doc_id", "group", F.explode("x").alias("a"), "y").select("doc_id", "group", "a", F.explode("y").alias("b"))


def pair_counts(aligned: DataFrame, wide: str, size_b: int) -> DataFrame:
    """Written rows pair (code), n (links of all documents that hold it), best (no pair of its second id has more)."""

    def merged(batches):
        kept, held = [], 0

        def summed():
            codes, times = (np.concatenate([k[j] for k in kept]) for j in (0, 1))
            order = np.argsort(codes)
            codes = codes[order]
            first = np.flatnonzero(np.diff(codes, prepend=-1))
            n = np.add.reduceat(times[order], first) if len(first) else times
            return codes[first], n

        for batch in batches:
            codes, times = (np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in batch.column(k))]).astype(np.int64) for k, kind in ((0, wide), (1, "<u4")))
            kept.append((codes, times))
            held += len(codes)
            if held > MERGE:
                kept = [summed()]
                held = len(kept[0][0])
                if 2 * held > MERGE:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, kept[0])), names=["pair", "n"])
                    kept, held = [], 0
        if kept:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, summed())), names=["pair", "n"])

    counts = aligned.select("codes", "times").mapInArrow(merged, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = saved(counts, "pairs")
    # As many rows as the second vocabulary has ids at most.
    most = F.broadcast(counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("n").alias("most")))
    return saved(counts.join(most, F.col("pair") % size_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


def with_counts(aligned: DataFrame, a: str, b: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """aligned (a written table of alignments()) with n_best, the links whose pair no other of its b id exceeds in the whole corpus, and count_sum, the sum of the pairs' counts over the links.

    Counts are broadcast where there are broadcast_pairs different pairs at most; beyond, they are joined with the
    different pairs of each packet of documents, so that a frequent pair is one row for each packet, not for each document.
    """
    wide, spark = code_type(a, b), aligned.sparkSession
    counts = pair_counts(aligned, wide, encoders(a, b)[1].size)
    names = [c for c in aligned.columns if c not in ("packet", "codes", "times")]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema if f.name in names) + ", n_best long, count_sum long"

    def summed(batch, pairs, n, best):
        codes, times = batch.column(batch.schema.get_field_index("codes")), batch.column(batch.schema.get_field_index("times"))
        sums = np.zeros((2, batch.num_rows), np.int64)
        for k, (x, y) in enumerate(zip(codes, times, strict=True)):
            at = np.searchsorted(pairs, np.frombuffer(x.as_buffer(), wide).astype(np.int64))
            times_ = np.frombuffer(y.as_buffer(), "<u4").astype(np.int64)
            sums[:, k] = times_[best[at]].sum(), (times_ * n[at]).sum()
        return [*(batch.column(batch.schema.get_field_index(c)) for c in names), *map(pa.array, sums)]

    if counts.limit(broadcast_pairs + 1).count() <= broadcast_pairs:
        got = counts.toArrow().sort_by("pair")
        table = spark.sparkContext.broadcast((got["pair"].to_numpy(), got["n"].to_numpy(), got["best"].to_numpy()))

        def looked_up(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays(summed(batch, *table.value), names=[*names, "n_best", "count_sum"])

        return aligned.mapInArrow(looked_up, kinds)

    def different(group: pa.Table) -> pa.Table:
        pairs = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), wide) for x in group["codes"]])).astype(np.int64)
        return pa.Table.from_arrays([pa.array(np.full(len(pairs), group["packet"][0].as_py(), np.int64)), pa.array(pairs)], names=["packet", "pair"])

    def answered(own: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("pair")
        batch = own.combine_chunks().to_batches()[0]
        return pa.Table.from_arrays(summed(batch, *(found[c].to_numpy() for c in ("pair", "n", "best"))), names=[*names, "n_best", "count_sum"])

    asked = aligned.select("packet", "codes").groupBy("packet").applyInArrow(different, "packet long, pair long")
    answers = asked.join(counts, "pair").select("packet", "pair", "n", "best")
    return aligned.groupBy("packet").cogroup(answers.groupBy("packet")).applyInArrow(answered, kinds)


def alignment_digests(docs: DataFrame, a: str, b: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (of groups; empty where there are none)."""
    made = alignments(docs, a, b).withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))).drop("groups")
    return with_counts(saved(made, "aligned"), a, b, broadcast_pairs)
