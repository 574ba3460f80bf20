"""LM scoring with a log-frequency Bloom filter of quantised n-gram counts."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import id_remainder, mixed, pieces_of, saved, word_hashes

#: The filter has 2**FILTER_BITS bits (8 MB) at least, and is broadcast if it has no more: every worker holds it.
#: A segment with more entries is made larger, so that a probe's share of wrong answers stays at ERROR at most.
FILTER_BITS, PROBES, ERROR = 26, 3, 0.02
#: Segments are 2**SEGMENT_BITS for up to SEGMENT_BYTES of training text, and twice as many for each doubling of it.
SEGMENT_BITS, SEGMENT_BYTES = 12, 4 << 30
#: Bits of a key within its segment.
KEY_BITS = 32
#: Weight, in counts, of the one-word distribution in the two-word one.
MU = 8.0
#: Words whose exact counts are broadcast, the most frequent ones; all others' counts are joined.
FREQUENT = 1_000_000
#: Tokens whose n-grams a task merges before it passes them on.
MERGE = 4_000_000
STEP = 2_000_000
#: Bytes of text whose keys are looked up together where the filter is too large to be broadcast.
PACKET = 10_000_000

_START, _END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"  ", b" "))  # no words


def word_keys(words: np.ndarray) -> np.ndarray:
    return mixed(words) & ~np.uint64(1)


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(mixed(before) * np.uint64(3) + words) | np.uint64(1)


def token_rows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts (words, then one end each), the token before each, and the number of tokens of each text."""
    each = [word_hashes((t or "").encode("utf-8", "replace")) for t in texts]
    tokens = np.concatenate([x for w in each for x in (w, [_END])]).astype(np.uint64)
    n = np.array([len(w) + 1 for w in each])
    before = np.concatenate([[_START], tokens[:-1]]).astype(np.uint64)
    before[np.cumsum(n)[:-1]] = _START
    return tokens, before, n


#: Counts that the levels 0, 1, 2, ... stand for: 0 to 8, 10, 12, 14, 16, 20, ...: four for each doubling.
VALUES = np.array([0.0, 1.0, 2.0, 3.0, *((4.0 + k % 4) * 2.0 ** (k // 4) for k in range(200))])


def level_of(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The level of each count: one of the two whose values are next to it, by a hash of the key, so that the value is the count on the mean."""
    low = np.searchsorted(VALUES, counts, "right") - 1
    share = (counts - VALUES[low]) / (VALUES[low + 1] - VALUES[low])
    return low + ((mixed(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(11)) / 2.0**53 < share)


def segment_number(text_bytes: int) -> int:
    """Segments of the filter, 2 to this power."""
    return SEGMENT_BITS + max(0, int(np.ceil(np.log2(max(1, text_bytes) / SEGMENT_BYTES))))


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (keys >> np.uint64(64 - segments)).astype(np.int32)


def short_of(keys: np.ndarray, segments: int) -> np.ndarray:
    """The keys cut to the bits that the filter knows them by: those of the segment and KEY_BITS more."""
    cut = np.uint64(64 - segments - KEY_BITS)
    return keys >> cut << cut


def segment_bits(entries: int, least: int, error: float) -> int:
    """A segment of 2 to this power bits answers wrongly with a chance of error at most: (1 - exp(-PROBES * entries / bits)) ** PROBES."""
    need = PROBES * entries / -np.log1p(-(error ** (1 / PROBES)))
    return max(least, 3, int(np.ceil(np.log2(max(need, 1)))))


def _places(keys: np.ndarray, level: int, bits: int | np.ndarray) -> list[np.ndarray]:
    """Bits, within the key's segment of 2**bits, of the entry (key, level)."""
    mask = (np.uint64(1) << np.asarray(bits).astype(np.uint64)) - np.uint64(1)
    with np.errstate(over="ignore"):
        x = mixed(keys + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))
        if np.max(bits, initial=0) <= 21:
            return [(x >> np.uint64(21 * k)) & mask for k in range(PROBES)]
        return [np.where(np.asarray(bits) > 21, mixed(x + np.uint64(k + 1)), x >> np.uint64(21 * k)) & mask for k in range(PROBES)]


@dataclass
class Filter:
    packed: np.ndarray  # bytes
    most: int  # the highest level there is
    segments: int
    bits: int | np.ndarray  # of each segment, 2 to this power; one number where all are alike
    starts: np.ndarray  # first bit of each segment

    @staticmethod
    def of(rows: dict[int, bytes], least: int, most: int, segments: int) -> Filter:
        bits = np.full(1 << segments, max(least, 3), np.int64)
        for k, x in rows.items():
            bits[k] = (len(x) * 8).bit_length() - 1
        ends = np.cumsum(1 << bits)
        packed = np.zeros(ends[-1] >> 3, np.uint8)
        for k, x in rows.items():
            packed[ends[k] - len(x) * 8 >> 3 : ends[k] >> 3] = np.frombuffer(x, np.uint8)
        return Filter(packed, most, segments, int(bits[0]) if (bits == bits[0]).all() else bits, (ends - (1 << bits)).astype(np.uint64))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The last level found of each key, probed level by level; 0 for none."""
        segment = segment_of(keys, self.segments)
        base, bits = self.starts[segment], self.bits if np.ndim(self.bits) == 0 else self.bits[segment]
        return levels_in(self.packed, short_of(keys, self.segments), base, bits, self.most)


@dataclass
class Levels:
    """Levels that were looked up for some keys, as Filter.levels gives them; all others have none."""

    keys: np.ndarray  # short, ascending
    found: np.ndarray
    segments: int

    def levels(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        keys = short_of(keys, self.segments)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.found[at], 0)


def levels_in(packed: np.ndarray, keys: np.ndarray, base: np.ndarray | np.uint64, bits: int | np.ndarray, most: int) -> np.ndarray:
    """The last of the levels 1, 2, ... up to most that a (short) key is found with, one after the other; 0 for none."""
    found, alive, level = np.zeros(len(keys), np.int64), np.arange(len(keys)), 1
    while len(alive) and level <= most:
        hit = np.ones(len(alive), bool)
        start = base[alive] if np.ndim(base) else base
        for p in _places(keys[alive], level, bits[alive] if np.ndim(bits) else bits):
            at = start + p
            hit &= (packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        alive = alive[hit]
        found[alive] = level
        level += 1
    return found


@dataclass
class Model:
    filter: Filter | Levels | None  # None: too large to be broadcast
    most: int
    segments: int
    words: np.ndarray  # keys of the frequent words, ascending
    counts: np.ndarray
    tokens: int
    distinct: int
    complete: bool  # words has all of them
    table: DataFrame | None = None  # segment, bits: the filter that is too large

    @property
    def total(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Counts as the filter has them."""
        return VALUES[self.filter.levels(keys)]

    def word_count(self, keys: np.ndarray) -> np.ndarray:
        """Exact counts of frequent words, else as the filter has them."""
        if not len(self.words):
            return self.count(keys)
        at = np.minimum(np.searchsorted(self.words, keys), len(self.words) - 1)
        known = self.words[at] == keys
        out = self.counts[at].astype(float)
        out[~known] = self.count(keys[~known])
        return out

    def log_probabilities(self, tokens: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log10 P(token | the one before): Dirichlet smoothing over the one-word distribution.

        Over the vocabulary and one unknown word the probabilities add up to 1 where the filter's counts of the pairs
        of a context add up to the context's own. They do so to within a tenth: values are rounded up and down alike, by
        an eighth at most. Wrong answers of the filter (ERROR of the pairs not seen, at most) come on top.
        """
        context = np.where(before == _START, _END, before)  # as many texts start as end
        words, at = np.unique(word_keys(np.concatenate([tokens, context])), return_inverse=True)
        return self.log_of(words, at[: len(tokens)], at[len(tokens) :], *np.unique(pair_keys(before, tokens), return_inverse=True))

    def log_of(self, words: np.ndarray, at: np.ndarray, before_at: np.ndarray, pairs: np.ndarray, pair_at: np.ndarray) -> np.ndarray:
        """log_probabilities() by ascending keys, each once, and the places of tokens, those before and pairs in them."""
        counts = self.word_count(words)
        seen = counts[before_at]
        together = np.minimum(self.count(pairs)[pair_at], seen)
        return np.log10((together + MU * ((counts + 0.5) / self.total)[at]) / (seen + MU))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(id_remainder(doc_id, 5) == 1, F.lit(False))


def _slices(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary column of the slices of data between the cuts."""
    own = np.ascontiguousarray(data[cuts[0] : cuts[-1]])
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(((cuts - cuts[0]) * own.itemsize).astype(np.int32)), pa.py_buffer(own)])


def _groups(batches):
    """Tables of the consecutive rows with one value in the first column."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        first = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(first)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if rest and rest[-1].column(0)[0].as_py() != first[a]:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(batch.slice(a, b - a))
    if rest:
        yield pa.Table.from_batches(rest)


def count_tables(train: DataFrame, text_col: str, filter_bits: int, segments: int) -> DataFrame:
    """Written rows: segment and bits of the filter with n its highest level, or key and n of a word (exact, over all texts)."""

    def counted(batches):
        kept: list[np.ndarray] = []

        def merged():
            keys, n = np.unique(np.concatenate(kept), return_counts=True)
            kept.clear()
            own = segment_of(keys, segments)
            cuts = np.append(np.flatnonzero(np.diff(own, prepend=-1)), len(own))
            for a in range(0, len(cuts) - 1, 512):
                at = cuts[a : a + 513]
                lists = [_slices(x, at) for x in (keys, n.astype(np.uint32))]
                yield pa.RecordBatch.from_arrays([pa.array(own[at[:-1]]), *lists], names=["segment", "keys", "n"])

        for (texts,) in pieces_of(batches, ["text"], "text", STEP):
            tokens, before, _ = token_rows(texts)
            kept += [word_keys(tokens), pair_keys(before, tokens)]
            if sum(map(len, kept)) > 2 * MERGE:
                yield from merged()
        if kept:
            yield from merged()

    least, error = filter_bits - segments, ERROR

    def segment_row(segment, keys, level):
        bits = segment_bits(int(level.sum(dtype=np.int64)), least, error)
        out = np.zeros(1 << bits, bool)
        for j in range(1, int(level.max()) + 1):
            for p in _places(short_of(keys[level >= j], segments), j, bits):
                out[p] = True
        return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.nulls(1, pa.int64()), pa.array([int(level.max())], pa.int64()), pa.array([np.packbits(out, bitorder="little").tobytes()])], names=["segment", "key", "n", "bits"])

    def built(batches):
        for group in _groups(batches):
            keys, n = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in group[c]]) for c, t in (("keys", np.uint64), ("n", np.uint32)))
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.diff(keys, prepend=keys[0] - np.uint64(1)))
            keys, n = keys[first], np.add.reduceat(n[order], first, dtype=np.int64)
            yield segment_row(group["segment"][0].as_py(), keys, level_of(keys, n))
            word = keys & np.uint64(1) == 0
            yield pa.RecordBatch.from_arrays([pa.nulls(int(word.sum()), pa.int32()), pa.array(keys[word].view(np.int64)), pa.array(n[word]), pa.nulls(int(word.sum()), pa.binary())], names=["segment", "key", "n", "bits"])

    # What a task has merged of a segment is one row. Dealt by segment, so that one task has all of it.
    rows = train.select(F.col(text_col).alias("text")).mapInArrow(counted, "segment int, keys binary, n binary")
    return saved(rows.repartition("segment").sortWithinPartitions("segment").mapInArrow(built, "segment int, key long, n long, bits binary"), "ngrams")


def fit(train: DataFrame, text_col: str = "text", filter_bits: int = FILTER_BITS) -> tuple[Model, DataFrame]:
    """The model, and the exact counts (key, n) of the words that aren't among its frequent ones."""
    text_bytes = train.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    segments = segment_number(text_bytes)
    table = count_tables(train, text_col, filter_bits, segments)
    rows, least = table.filter("bits is not null").select("segment", "n", "bits"), filter_bits - segments
    got = rows.agg(F.count("*").alias("rows"), F.sum(F.length("bits")).alias("bytes"), F.max("n").alias("most")).first()
    most, whole = got.most or 0, 8 * (got.bytes or 0) + (((1 << segments) - got.rows) << max(least, 3))
    held = Filter.of({r.segment: bytes(r.bits) for r in rows.toLocalIterator()}, least, most, segments) if whole <= 1 << FILTER_BITS else None
    words = table.filter("key is not null").select("key", "n")
    # How many words have counts of each size: few rows, whatever the text.
    sizes = words.groupBy(F.floor(F.log2("n")).alias("size")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect()
    tokens, distinct = sum(r.tokens for r in sizes), sum(r.words for r in sizes)
    least, taken = None, 0
    for r in sorted(sizes, key=lambda r: -r["size"]):
        if taken + r.words > FREQUENT:
            break
        least, taken = 1 << r["size"], taken + r.words
    frequent = words.filter(F.col("n") >= least) if least is not None else words.limit(0)
    got = frequent.toArrow()
    keys = got["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    model = Model(held, most, segments, keys[order], got["n"].to_numpy()[order], tokens, distinct, taken == distinct, None if held else rows)
    return model, words.filter(F.col("n") < least) if least is not None else words


def _looked_up(rows: DataFrame, model: Model) -> DataFrame:
    """Where the filter is too large to be broadcast: packet, segment, levels, a byte for each of the packet's short keys in the segment.

    rows: packet, text. All keys of a packet that fall into one segment make one row; they go to the segment's bits.
    """
    segments, most = model.segments, model.most
    shift = np.uint64(64 - segments - KEY_BITS)

    def asked(table: pa.Table) -> pa.Table:
        tokens, before, _ = token_rows(table["text"].to_pylist())
        keys = np.unique(short_of(np.concatenate([word_keys(tokens), pair_keys(before, tokens)]), segments))
        own = segment_of(keys, segments)
        cuts = np.append(np.flatnonzero(np.diff(own, prepend=-1)), len(own))
        data = (keys >> shift).astype(np.uint32)
        found = _slices(data, cuts)
        packet = np.full(len(cuts) - 1, table["packet"][0].as_py(), np.int64)
        return pa.Table.from_arrays([pa.array(own[cuts[:-1]]), pa.nulls(len(packet), pa.binary()), pa.array(packet), found], names=["segment", "bits", "packet", "keys"])

    lookups = rows.groupBy("packet").applyInArrow(asked, "segment int, bits binary, packet long, keys binary")
    both = model.table.select("segment", "bits", F.lit(None).cast("long").alias("packet"), F.lit(None).cast("binary").alias("keys")).unionAll(lookups)

    def answered(batches):
        segment, packed, bits = None, None, 0
        for batch in batches:
            own = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a < b and own[a] != segment:
                    segment, packed = own[a], None
                if a < b and batch.column(1)[a].is_valid:  # a segment's bits come before the keys
                    packed = np.frombuffer(batch.column(1)[a].as_buffer(), np.uint8).copy()
                    bits, a = (len(packed) * 8).bit_length() - 1, a + 1
                if a == b:
                    continue
                keys = [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(3).slice(a, b - a)]
                short = np.concatenate(keys).astype(np.uint64) << shift | np.uint64(segment) << np.uint64(64 - segments)
                found = np.zeros(len(short), np.uint8) if packed is None else levels_in(packed, short, np.uint64(0), bits, most).astype(np.uint8)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
                levels = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends), pa.py_buffer(found)])
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(a, b - a), batch.column(0).slice(a, b - a), levels], names=["packet", "segment", "levels"])

    dealt = both.repartition("segment").sortWithinPartitions("segment", F.col("packet").asc_nulls_first())
    return dealt.mapInArrow(answered, "packet long, segment int, levels binary")


def score(docs: DataFrame, fitted: tuple[Model, DataFrame], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row a document, repeated rows too.

    score is the model's log10 probability of the text: sum of log10 P(token | token before), P from the
    filter's counts. base_score is the one-word sum with exact counts: those of frequent words from the
    broadcast table, those of all others by a join. Null texts count as empty: one end token. With nothing
    learned, every token has base log10 1 and score log10 1. Other columns are left out.
    """
    model, others = fitted
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, table=None))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    names = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "known", "score", "key", "times"]
    kinds = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, known double, score double, key long, times long"

    def scored_rows(m, rid, ids, held, texts, looked=None):
        tokens, before, n = token_rows(texts)
        begins = np.cumsum(n) - n
        words, at = np.unique(word_keys(tokens), return_inverse=True)
        before_at = np.roll(at, 1)
        before_at[begins] = at[-1]  # the end's place, for as many texts start as end
        pairs, pair_at = np.unique(pair_keys(before, tokens), return_inverse=True)
        if looked is not None:
            keys = np.unique(short_of(np.concatenate([words, pairs]), m.segments))
            if len(looked) != len(keys):
                raise RuntimeError("the documents were read in another order the second time")
            m = replace(m, filter=Levels(keys, looked, m.segments))
        total = np.add.reduceat(m.log_of(words, at, before_at, pairs, pair_at), begins)
        place = np.minimum(np.searchsorted(m.words, words), max(0, len(m.words) - 1))
        common = m.words[place] == words if len(m.words) else np.zeros(len(words), bool)
        value = np.where(common, np.log10((m.counts[place] if len(m.words) else 0) + 0.5), 0.0)
        known, sums = (np.add.reduceat(x[at], begins) for x in (common.astype(np.int64), value))
        yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(ids, pa.int64()), pa.array(held), pa.array(n), pa.array(known), pa.array(sums), pa.array(total), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64())], names=names)
        if not m.complete:
            rare = np.flatnonzero(~common[at])
            text = np.repeat(np.arange(len(n)), n)[rare]
            both, times = np.unique(text * len(words) + at[rare], return_counts=True)
            k = len(both)
            yield pa.RecordBatch.from_arrays([pa.array(rid[both // len(words)]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_()), *(pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())), pa.array(words[both % len(words)].view(np.int64)), pa.array(times)], names=names)

    def scored(batches):
        for rid, ids, held, texts in pieces_of(batches, ["rid", "doc_id", "held_out", "text"], "text", STEP):
            yield from scored_rows(shared.value, np.array(rid), ids, held, texts)

    def scored_packet(own: pa.Table, looked: pa.Table) -> pa.Table:
        found = np.frombuffer(b"".join(looked.sort_by("segment")["levels"].to_pylist()), np.uint8)
        columns = (own[c].to_pylist() for c in ("doc_id", "held_out", "text"))
        return pa.Table.from_batches(list(scored_rows(shared.value, own["rid"].to_numpy(), *columns, found)))

    if model.filter:
        made = rows.mapInArrow(scored, kinds)
    else:
        packets = max(1, -(-(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // PACKET))
        # By a hash of the row's number, so that copies don't come together.
        rows = rows.withColumn("packet", F.pmod(F.xxhash64("rid"), F.lit(packets)))
        made = rows.groupBy("packet").cogroup(_looked_up(rows, model).groupBy("packet")).applyInArrow(scored_packet, kinds)
    done = saved(made, "scores")
    rest = done.filter("key is not null").select("rid", "key", "times").join(others, "key")
    rest = rest.groupBy("rid").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("sum"))
    both = done.filter("key is null").drop("key", "times").join(rest, "rid", "left")
    found = F.col("n_known") + F.coalesce("more", F.lit(0))
    base = F.col("known") + F.coalesce("sum", F.lit(0.0)) + (F.col("n_tokens") - found) * float(np.log10(0.5)) - F.col("n_tokens") * float(np.log10(model.total))
    return both.select("doc_id", "held_out", "n_tokens", found.alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def scores(docs: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """score() of docs by a model of those whose crc32(doc_id) modulo 5 isn't 1 (a null id's isn't)."""
    return score(docs, fit(docs.filter(~held_out(F.col("doc_id"))), filter_bits=filter_bits))
