"""Token ids in files: frequency-ranked, byte-aligned, control bytes apart from data bytes.

Format of a folder:
  ranks/   Parquet (rank int, id int): rank 0 is the id that all documents hold most often, ties by id.
  docs/    Parquet, one row a document: shard int, start long (ids before it in its shard), doc_id,
           n_tokens long, control binary, data binary. Files by name, and rows in them, ascend by shard and start.
A document's ids are replaced by their ranks; each rank takes 1 to 4 little-endian bytes in `data`, and a
2-bit code (bytes - 1) in `control`, four codes a byte, the first in the low bits. Decoding looks a
control byte's codes up in a table of 256, so numpy does it without a loop over ids.
Parquet is the container because Spark's commit protocol makes it whole on any shared store when executors are lost.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from collections import defaultdict
from itertools import chain, compress, count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import CACHE_ENTRIES, broadcast_if_small, broadcast_value, discard, pieces_of, saved, shared_folder

#: Characters that are cut into pieces at once.
STEP = 1_000_000
#: Shards whose starts are summed together; shards up to which the starts are broadcast.
SHARD_BLOCK, BROADCAST_SHARDS = 1000, 200_000

#: White space (Python's, which has all of the pattern's) other than the space and the line feed, and the ways in which those two can meet.
_ODD_SPACES = ["  ", " \n", "\n ", "\n\n", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]
_SPACED = re.compile(r"\s ")
_CUT = re.compile(r"(?<!\s)(?= )")


#: Signs that, at the end of a piece and after a letter or digit, are a token group of their own.
_SIGNS = ".,!?;:|&%$*#()[]{}\"-"


#: The character that byte-level vocabularies write for each byte: itself where it is visible in Latin-1, else one from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b if b in _SHOWN else 256 + b - sum(x < b for x in _SHOWN) for b in range(256)}


#: Bytes that no UTF-8 has.
_NO_UTF8 = (0xC0, 0xC1, *range(0xF5, 0x100))
#: Words that go to the BPE model in one string.
WORDS = 64


class Encoder:
    """encode() of the tokenizers library, with the ids of pieces kept.

    Not every text goes through the library's encode as a whole: it is cut into pieces, and pieces that are one word go to the
    library's BPE model alone, many at once. Tests hold the ids against the library's own.

    The byte-level pattern always starts a new token group at a space that follows a character other
    than white space, before and after a line feed without white space beside it, and at a sign that follows a letter or digit; so
    the text is cut at the spaces and such line feeds, signs at a new piece's end are cut off, and each different piece is encoded by
    the library once. Between two words that go to the model in one string stands a byte that no UTF-8 has and no merge takes, so
    none goes over it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.model = self.tokenizer.model
        split = self.tokenizer.pre_tokenizer
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: The rules below hold for this kind only; texts are encoded whole by others.
        self.by_pieces = isinstance(split, ByteLevel) and split.use_regex and not split.add_prefix_space and self.tokenizer.normalizer is None and isinstance(self.model, BPE) and not any(" " in t or "\n" in t or t.isalpha() or (t.rstrip(_SIGNS) != t and t.rstrip(_SIGNS)[-1:].isalnum()) for t in added)
        self.between = None
        if self.by_pieces:
            #: The model without the pattern, and a byte to put between words with its id.
            self.bare, vocab = Tokenizer(self.model), self.tokenizer.get_vocab(with_added_tokens=False)
            plain = not any((self.model.dropout, self.model.unk_token, self.model.continuing_subword_prefix, self.model.end_of_word_suffix, self.model.ignore_merges))
            merged = set(chain.from_iterable(t for t in vocab if len(t) > 1))
            free = [b for b in _NO_UTF8 if chr(_BYTES[b]) in vocab and chr(_BYTES[b]) not in merged]
            if plain and free:
                self.between = chr(0xDC00 + free[0]), vocab[chr(_BYTES[free[0]])]
        self.clear()

    def clear(self) -> None:
        self.numbers = defaultdict(count().__next__)  # piece -> its number, in the order in which they are met
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length, self.seen = (np.zeros(1 << 12, np.int64) for _ in range(3))

    def forget(self) -> None:
        """Keeps the pieces seen more than once, or none where those are too many."""
        old = list(compress(self.numbers, self.seen[: len(self.numbers)] > 1))
        at = np.flatnonzero(self.seen[: len(self.numbers)] > 1)
        ids, lengths = self._gather(at)[0], self.length[at]
        self.clear()
        if len(old) < CACHE_ENTRIES // 2:
            for p in old:
                self.numbers[p]
            self.start, self.length, self.seen = (np.zeros(len(old) + 1, np.int64) for _ in range(3))
            self._keep(np.arange(len(old)), ids, lengths)

    def pieces(self, text: str) -> list[str]:
        """Pieces of text: after a leading "\0" as they are; all others, which have no "\0" there, after a space."""
        if "\0" not in text and not any(map(text.__contains__, _ODD_SPACES)):
            text = "\0" + text.replace("\n", " \0\n \0")
            for sign in ".,":
                *parts, last = text.split(sign + " ")
                before = "".join([p[-1:] for p in parts])
                if len(before) == len(parts) and before.isalnum():
                    text = (" \0" + sign + " ").join([*parts, last])
                else:
                    text = "".join([p + (" \0" if p[-1:].isalnum() else "") + sign + " " for p in parts]) + last
            return text.split(" ")
        if _SPACED.search(text):
            return ["\0" + p for p in _CUT.split(text)]
        parts = text.split(" ")
        if "\0" in text:
            parts = ["\0 " + p if p[:1] == "\0" and k else p for k, p in enumerate(parts)]
        parts[0] = "\0" + parts[0]
        return parts

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered pieces in a row, and where each piece's ids end."""
        n = self.length[at]
        ends = np.cumsum(n)
        return self.ids[np.repeat(self.start[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)], ends

    def _keep(self, numbers: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        end = self.used + len(ids)
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(end, len(self.ids)), np.uint32)])
        self.ids[self.used : end] = ids
        self.start[numbers] = self.used + np.cumsum(lengths) - lengths
        self.length[numbers] = lengths
        self.used = end

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, each one token group, in a row, and how many each has."""
        if self.between:
            sign, own = self.between
            joined = (sign.join(words[k : k + WORDS]) + sign for k in range(0, len(words), WORDS))
            shown = [x.encode("utf-8", "surrogateescape").decode("latin-1").translate(_BYTES) for x in joined]
            flat = _flat([x.ids for x in self.bare.encode_batch_fast(shown, add_special_tokens=False)])
            ends = np.flatnonzero(flat == own)
            return flat[flat != own], np.diff(ends, prepend=-1) - 1
        ids = [[t.id for t in self.model.tokenize(w.encode().decode("latin-1").translate(_BYTES))] for w in words]
        return _flat(ids), np.fromiter(map(len, ids), np.int64, len(ids))

    def _from(self, known: int) -> list[str]:
        """The pieces numbered from known on."""
        return list(islice(reversed(self.numbers), len(self.numbers) - known))[::-1]

    def _learn(self, known: int) -> None:
        """Encodes the pieces numbered from known on."""
        numbers, whole, texts, joined, words, alone = self.numbers, [], [], [], [], []
        n = known
        while n < len(numbers):  # grows by the parts of its members
            for n, p in enumerate(self._from(n), n):
                body = p.rstrip(_SIGNS)
                if body != p and body[-1:].isalnum():
                    joined += (n, numbers[body], numbers["\0" + p[len(body) :]])
                    continue
                word = p[1:] if p[:1] == "\0" else p
                if word.isalpha():  # one token group: the model alone will do
                    words.append(n)
                    alone.append(word if word is not p else " " + p)
                else:
                    whole.append(n)
                    texts.append(word if p[:1] == "\0" else " " + p)
            n += 1
        if (more := len(numbers) - len(self.start)) > 0:
            self.start, self.length, self.seen = (np.pad(x, (0, max(more, len(x)))) for x in (self.start, self.length, self.seen))
        if words:
            self._keep(np.array(words), *self._words(alone))
        if whole:
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self._keep(np.array(whole), _flat(ids), np.fromiter(map(len, ids), np.int64, len(ids)))
        if joined:
            parts = np.array(joined).reshape(-1, 3)
            flat, _ = self._gather(parts[:, 1:].ravel())
            self._keep(parts[:, 0], flat, self.length[parts[:, 1]] + self.length[parts[:, 2]])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """ids of each text."""
        if not texts:
            return []
        if not self.by_pieces:
            return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if len(self.numbers) > CACHE_ENTRIES:
            self.forget()
        each = [self.pieces(t) for t in texts]
        known = len(self.numbers)
        at = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(each)), np.int64, sum(map(len, each)))
        if len(self.numbers) > known:
            gc.disable()  # many small lists at once; none of them in a cycle
            try:
                self._learn(known)
            except BaseException:
                self.clear()  # some have numbers, but no ids
                raise
            finally:
                gc.enable()
        self.seen[: len(self.numbers)] += np.bincount(at, minlength=len(self.numbers))
        ids, ends = self._gather(at)
        last = np.cumsum([len(ps) for ps in each]) - 1
        return np.split(ids, ends[last][:-1])

    def encode_long(self, text: str) -> np.ndarray:
        """encode() of one text in steps, so that a very long one needs little more than its ids."""
        if not self.by_pieces:
            return self.encode([text])[0]
        out, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, min(len(text), at + STEP))
            end = cut.start() if cut and cut.start() > at else len(text)
            out += self.encode([text[at:end]])
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.uint32, sum(map(len, lists)))


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _used(control_ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which of the four codes of each control byte a rank has: all but the last ones of a row."""
    used = np.ones(4 * int(control_ends[-1]) if len(counts) else 0, bool)
    for k in range(3):
        used[4 * control_ends[-counts % 4 > k] - 1 - k] = False
    return used


def _stored(code: np.ndarray, wide: int) -> np.ndarray:
    """Which of the wide bytes of each rank are in the data, one rank after the other."""
    out = np.ones((len(code), wide), bool)
    for k in range(1, wide):
        np.greater_equal(code, k, out=out[:, k])
    return out.ravel()


def control_and_data(ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes rows of ranks that lie one after the other, counts of them: control bytes, their ends by row, data bytes, their ends."""
    code = (ranks > 0xFF).view(np.uint8)
    most = int(ranks.max(initial=0))
    for k in (16, 24):
        if most >> k:
            code = code + (ranks >= 1 << k)
    wide = 1 if most <= 0xFF else 2 if most <= 0xFFFF else 4
    data = ranks.astype(f"<u{wide}").view(np.uint8)[_stored(code, wide)]
    ends, control_ends = np.cumsum(counts), np.cumsum(-(-counts // 4))
    data_ends = ends + np.concatenate([[0], np.cumsum(code, dtype=np.int64)])[ends]
    used = _used(control_ends, counts)
    quads = np.zeros(len(used), np.uint8)
    quads[used] = code
    quads = quads.view("<u4")
    control = (quads | quads >> 6 | quads >> 12 | quads >> 18).astype(np.uint8)
    return control, control_ends, data, data_ends


#: For each control byte its four codes.
CODES = np.array([[c >> 2 * k & 3 for k in range(4)] for c in range(256)], np.uint8).view("<u4").ravel()


def ranks_from(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranks of all rows, one after the other, from their control and data bytes."""
    code = CODES[control].view(np.uint8)[_used(np.cumsum(-(-counts // 4)), counts)]
    wide = (1, 2, 4, 4)[int(code.max(initial=0))]
    out = np.zeros(len(code) * wide, np.uint8)
    out[_stored(code, wide)] = data
    return out.view(f"<u{wide}").astype(np.uint32)


def _bytes_of(column: pa.Array) -> np.ndarray:
    """All bytes of a binary column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else [0]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of consecutive pieces of data."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", ordered: bool = True) -> None:
    """Encodes docs' whole texts and writes the folder.

    ordered: shards and rows ascend by id (null ids first; rows of one id stay whole, in any order among
    themselves); else the order of docs is kept as it is read. Null texts count as empty, so such a row
    has the end id only (end_id None: no end ids). Other columns are left out. An empty table gives an
    empty folder. Ids of a document stay in one row: memory is bounded by the longest document.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if ordered:
        # Rows of one id, or of none, go to as many tasks as others do: their places part them.
        rows = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place")
    tail = np.array([] if end_id is None else [end_id], np.uint32)

    wide = "<u2" if max(_encoder(tokenizer).size, *tail, 0) <= 1 << 16 else "<u4"

    def tokens(batches):
        encoder = _encoder(tokenizer)
        counts, shard, start = np.zeros(max(encoder.size, *(x + 1 for x in tail), 1), np.int64), TaskContext.get().partitionId(), 0
        names = ["kind", "shard", "start", "doc_id", "n_tokens", "ids"]
        for ids, texts in pieces_of(batches, ["doc_id", "text"], "text", STEP):
            each = [encoder.encode_long(t) for t in texts] if len(texts) == 1 else encoder.encode(texts)
            flat = np.concatenate([y for x in each for y in (x, tail)]).astype(wide)
            n = np.array([len(x) + len(tail) for x in each], np.int64)
            counts += np.bincount(flat, minlength=len(counts))
            begin = start + np.cumsum(n) - n
            start += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(n), pa.int32()), pa.array([shard] * len(n), pa.int32()), pa.array(begin), pa.array(ids, pa.int64()), pa.array(n), _binary(flat.view(np.uint8), np.cumsum(n) * flat.itemsize)], names=names)
        if start:
            yield pa.RecordBatch.from_arrays([pa.array([len(counts)], pa.int32()), pa.array([shard], pa.int32()), pa.array([0], pa.int64()), pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], names=names)

    made = saved(rows.mapInArrow(tokens, "kind int, shard int, start long, doc_id long, n_tokens long, ids binary"), "tokens")
    spark = docs.sparkSession

    def summed(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                x = np.frombuffer(x, "<i8")
                total = np.pad(total, (0, max(0, len(x) - len(total)))) + np.pad(x, (0, max(0, len(total) - len(x))))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["id", "n"])

    # At most as many rows as the vocabulary has ids.
    counts = made.filter("kind > 0").select("ids").mapInArrow(summed, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow().sort_by([("n", "descending"), ("id", "ascending")])
    ids = counts["id"].to_numpy()
    rank = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
    rank[ids] = np.arange(len(ids), dtype=np.uint32)
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
    ranks = broadcast_value(spark, rank)

    def coded(batches):
        for batch in batches:
            n = batch.column(4).to_numpy()
            control, control_ends, data, data_ends = control_and_data(ranks.value[_bytes_of(batch.column(5)).view(wide)], n)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (1, 2, 3, 4)), _binary(control, control_ends), _binary(data, data_ends)], names=["shard", "start", "doc_id", "n_tokens", "control", "data"])

    # Spark packs files into tasks by size; each shard to the task of its number, they are written in order.
    shards = (made.agg(F.max("shard")).first()[0] or 0) + 1
    placed = made.filter("kind = 0").repartitionById(shards, "shard").sortWithinPartitions("shard", "start")
    placed.mapInArrow(coded, "shard int, start long, doc_id long, n_tokens long, control binary, data binary").write.option("compression", "zstd").parquet(f"{path}/docs")
    discard(made)


def shard_starts(shards: DataFrame) -> DataFrame:
    """shard, base (ids of all shards before it) of rows shard, n: a running sum within blocks of shards, by many tasks, and one over the blocks' sums."""
    held = shards.withColumn("block", F.floor(F.col("shard") / SHARD_BLOCK))
    blocks = held.groupBy("block").agg(F.sum("n").alias("all"))
    blocks = blocks.select("block", (F.sum("all").over(Window.orderBy("block")) - F.col("all")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("shard")) - F.col("n")
    return held.withColumn("inside", inside).join(blocks, "block").select("shard", (F.col("before") + F.col("inside")).alias("base"))


def read_token_files(spark: SparkSession, path: str, schema: str, per_document) -> DataFrame:
    """Decodes a folder; per_document(ids: uint32 array) gives the values of the columns named in schema.

    Rows: doc_id, start long (ids of all documents before it), n_tokens, and those columns.
    """
    docs = spark.read.parquet(f"{path}/docs")
    ranked = spark.read.parquet(f"{path}/ranks").orderBy("rank").toArrow()  # as many rows as the vocabulary has ids at most
    ids = broadcast_value(spark, ranked["id"].to_numpy().astype(np.uint32))
    shards = broadcast_if_small(saved(shard_starts(docs.groupBy("shard").agg(F.sum("n_tokens").alias("n"))), "shards"), BROADCAST_SHARDS)
    names = [f.split()[0] for f in schema.split(",")]

    def decoded(batches):
        for batch in batches:
            cols = {c: batch.column(batch.schema.get_field_index(c)) for c in ("shard", "start", "doc_id", "n_tokens")}
            n = cols["n_tokens"].to_numpy()
            flat = ids.value[ranks_from(*(_bytes_of(batch.column(batch.schema.get_field_index(c))) for c in ("control", "data")), n)]
            rows = [per_document(x) for x in np.split(flat, np.cumsum(n)[:-1])] if len(n) else []
            yield pa.RecordBatch.from_arrays([*cols.values(), *(pa.array(x) for x in zip(*rows, strict=True))], names=[*cols, *names])

    out = docs.mapInArrow(decoded, f"shard int, start long, doc_id long, n_tokens long, {schema}").join(shards, "shard")
    return out.select("doc_id", (F.col("start") + F.col("base")).cast("long").alias("start"), "n_tokens", *names)


def crc_of(ids: np.ndarray) -> tuple[int]:
    return (zlib.crc32(ids.astype("<u4").tobytes()),)


def token_digests(docs: DataFrame, tokenizer: str, ordered: bool = True) -> DataFrame:
    """Writes docs to a new folder, reads it again and gives doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = shared_folder(spark, "token-files")
    write_token_files(docs, path, tokenizer, ordered=ordered)
    return read_token_files(spark, path, "ids_crc32 long", crc_of)
