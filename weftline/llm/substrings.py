"""Substring dedup by content-defined chunking with a gear rolling hash; what is found is extended to both sides."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import bitmap_of, broadcast_value, discard, in_bitmap, mixed, pieces_of, saved

#: A chunk ends where the top CUT_BITS bits of the hash of the last 16 bytes are 0: every 16 bytes on the mean.
CUT_BITS = 4
#: Bytes of a chunk at most. A longer stretch without cuts is cut where the hash is least in the second half of so many
#: bytes, again and again: places that the text after the last cut decides, so that they move along with it.
LONGEST = 32
#: Chunks in a row whose digests make one window. Windows are what is looked for elsewhere: two in a row share all chunks
#: but one, so a run of them follows its source, and doesn't go from piece to piece of many sources.
WINDOW = 4
#: Words of a run with its extensions, from which on it counts: passages of over 50 words.
LEAST_WORDS = 51
#: Bytes that the gear hash at a byte depends on.
SPAN = 16
#: Bytes compared before a run and after it, at most; see Chunks.back and Chunks.on, which are mostly less. A stretch
#: without cuts of more than BEFORE - SPAN bytes comes with a chance of 1 in 4000.
BEFORE, AFTER = 144, LONGEST
#: Bits of a filter over digests that is broadcast. A full one lets more rows pass, but no result changes.
FILTER_BITS = 26
#: Bytes of texts that are chunked at once. Arrays over them take about 65 bytes for each, in every worker of an executor.
STEP = 500_000
#: Bits of each of six small numbers of a window that go in one long: a window has at most WINDOW * LONGEST characters.
FIELD = 10
#: Ends of runs go by the words they lack, in classes from these numbers on, each with a filter of so many bits.
LACK, END_BITS = (-(1 << 30), 3, 5, 8), 24
#: Ends of runs whose surroundings are hashed at a time.
ENDS = 2048
_PAD = b"\0" * 16
_PRIME = np.uint64(0x9E3779B97F4A7C15)

_GEAR = (mixed(np.arange(1, 257, dtype=np.uint64) * _PRIME) & np.uint64(0xFFFF)).astype(np.uint16)
_BYTES = mixed(np.arange(257, 513, dtype=np.uint64) * _PRIME)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LETTER = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.full(max(BEFORE, AFTER), np.uint64(0xD6E8FEB86659FD93)))


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the hash that h = (h << 1) + gear[byte], in 16 bits, has there: made up by doubling the window."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        older = np.zeros_like(h)
        older[k:] = h[:-k] << np.uint16(k)
        h = h + older
    return h


def further_cuts(start: np.ndarray, stop: np.ndarray, h: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Cuts of the stretches that have over LONGEST bytes; all stretches go on together."""
    steps, half = np.arange(LONGEST // 2 + 1, LONGEST + 1), []
    while True:
        long = stop - start > LONGEST
        if not long.any():
            return np.concatenate(half) if half else start[:0]
        start, stop = start[long], stop[long]
        ends = start[:, None] + steps
        # A place within a character isn't one to cut at.
        value = np.where(whole[ends], h[ends - 1].astype(np.int64), 1 << 16)
        start = start + steps[value.argmin(axis=1)]
        half.append(start)


class Chunks(NamedTuple):
    """Arrays over the chunks of some texts, which lie one after the other in data."""

    #: Of each chunk: text, number in it, first and end byte in data, 64-bit digest, where its text begins and ends.
    text: np.ndarray
    number: np.ndarray
    low: np.ndarray
    high: np.ndarray
    digest: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    #: Bytes before each chunk, and after it, that another text can share without sharing a whole chunk more. If it shared
    #: the SPAN bytes before the last cut by the hash too, it would be cut from there on in the same places; so with
    #: the bytes up to the next one.
    back: np.ndarray
    on: np.ndarray
    #: Bytes of all texts; characters and words begun before each of them.
    data: np.ndarray
    chars: np.ndarray
    begun: np.ndarray

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each chunk the first and end character in its text, and the words begun."""
        base = self.chars[self.begins]
        return self.chars[self.low] - base, self.chars[self.high] - base, self.begun[self.high] - self.begun[self.low]


def chunks(texts: list[str | None]) -> Chunks:
    """Cuts keep to whole characters. Each text is hashed after 16 zero bytes, so other texts don't matter."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    joined = _PAD + _PAD.join(raw) + _PAD
    data = np.frombuffer(joined, np.uint8)
    lengths = np.array([len(r) for r in raw], np.int64)
    begins = 16 + np.cumsum(lengths + 16) - (lengths + 16)
    ends = begins + lengths
    whole = (data & 0xC0) != 0x80
    h = gear(data)
    cut = np.flatnonzero((h >> np.uint16(16 - CUT_BITS) == 0)[:-1] & whole[1:]) + 1
    at = np.searchsorted(begins, cut, "right") - 1
    cut = cut[(at >= 0) & (cut > begins[at]) & (cut < ends[at])]
    full = lengths > 0
    start = np.sort(np.concatenate([begins[full], cut]))
    stop = np.sort(np.concatenate([ends[full], cut]))
    more = further_cuts(start, stop, h, whole)
    hashed = start, stop
    start, stop = np.sort(np.concatenate([start, more])), np.sort(np.concatenate([stop, more]))
    text = np.searchsorted(begins[full], start, "right") - 1
    number = np.arange(len(start)) - np.searchsorted(start, begins[full])[text]
    text = np.flatnonzero(full)[text]
    before = np.maximum(np.searchsorted(hashed[0], start, "left") - 1, 0)
    back = np.minimum(np.minimum(start - begins[text], BEFORE), start - hashed[0][before] + SPAN)
    after = np.minimum(np.searchsorted(hashed[1], stop, "right"), len(hashed[1]) - 1)
    on = np.minimum(np.minimum(ends[text] - stop, AFTER), hashed[1][after] - stop)
    chars = np.concatenate([[0], np.cumsum(whole)])
    space = _SPACE[data] | (data == 0)
    begun = np.concatenate([[0, 0], np.cumsum(~space[1:] & space[:-1])])
    digest = np.fromiter((xxhash.xxh3_64_intdigest(joined[a:b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)), np.uint64, len(start))
    return Chunks(text, number, start, stop, digest, begins[text], ends[text], back, on, data, chars, begun)


def windows(c: Chunks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of WINDOW chunks: its first chunk, its last chunk, hash. A text of fewer chunks is one window."""
    ends = np.append(c.number[1:] == 0, True)[: len(c.number)]
    last = np.flatnonzero((c.number >= WINDOW - 1) | ends)
    first = last - np.minimum(c.number[last], WINDOW - 1)
    h = np.zeros(len(last), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(WINDOW):
            h = np.where(first + j <= last, mixed(h * _PRIME + c.digest[np.minimum(first + j, last)] + np.uint64(1)), h)
    return first, last, h


def identities(ids: list[int | None], texts: list[str | None]) -> np.ndarray:
    """64-bit hash of id and text. Rows that are alike in both share all windows to their ends, so nothing tells them apart here."""
    text = np.fromiter((xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "replace")) for t in texts), np.uint64, len(texts))
    own = np.fromiter((0 if i is None else 2 * (i % (1 << 63)) + 1 for i in ids), np.uint64, len(ids))
    with np.errstate(over="ignore"):
        return mixed(text + mixed(own * _PRIME)).view(np.int64)


def surroundings(c: Chunks, first: np.ndarray, last: np.ndarray, h: np.ndarray, after: bool) -> tuple[np.ndarray, ...]:
    """What stands before windows, or after them, as far as Chunks.back and Chunks.on go, up to each beginning, or end, of letters or digits in reach: window, bytes, words begun, hash of the window with it."""
    reach = AFTER if after else BEFORE
    edge = c.high[last] if after else c.low[first]
    room = c.on[last] if after else c.back[first]
    steps = np.arange(reach)
    at = np.clip(edge[:, None] + (steps if after else -1 - steps), 0, len(c.data) - 1)
    letter = _LETTER[c.data[at]]
    beyond = np.clip(at + (1 if after else -1), 0, len(c.data) - 1)
    # The last byte before a place must be of a word, the one behind it not; texts have zero bytes around them.
    row, k = np.nonzero(letter & ~_LETTER[c.data[beyond]] & (steps < room[:, None]))
    with np.errstate(over="ignore"):
        sums = np.cumsum(_BYTES[c.data[at]] * _POWERS[:reach], axis=1, dtype=np.uint64)[row, k]
        key = mixed(mixed(h[row] + _PRIME * np.uint64(2 if after else 1)) + mixed(sums + k.astype(np.uint64)))
    place = edge[row] + k + 1 if after else edge[row] - k - 1
    # A word that opens with signs is begun before its letters.
    inside = 0 if after else (c.begun[place + 1] == c.begun[place]).astype(np.int64)
    words = np.abs(c.begun[place] - c.begun[edge[row]]) + inside
    return row, place, words, key


def repeated_hashes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """h: windows that two documents have; counted over all. Each task merges its own first."""

    def found(batches):
        base, row = TaskContext.get().partitionId() << 33, 0
        for (texts,) in pieces_of(batches, ["text"], "text", STEP):
            c = chunks(texts)
            _, last, h = windows(c)
            order = np.argsort(h, kind="stable")  # so that rows of a window stay in order
            h, first = np.unique(h[order], return_index=True)
            end = np.append(first[1:], len(order)) - 1
            rows = base + row + c.text[last][order] if len(order) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(rows[first]), pa.array(rows[end])], names=["h", "low", "high"])
            row += len(texts)

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(found, "h long, low long, high long")
    return saved(rows.groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high").select("h"), "hashes")


def extensions(rows: DataFrame, repeated, runs: DataFrame, least_words: int) -> DataFrame:
    """rows (doc_id, text); repeated, a broadcast bit map of the windows that two documents have; runs (rid, doc_id, ident, run, w, low_n, low_h, start, before, high_n, high_h, stop, after): what runs share with another document beyond their ends, in the form of repeated_windows().

    Each document with a run's end window hashes what surrounds it, up to each word in reach that brings as many words
    as the run lacks with all that its other end can bring; hashes that two documents
    have are shared, and the longest counts. So it is compared with all of them, not with the first only, and no task
    gets them all.
    """
    filters = []
    for side, other, h in (("before", "after", "low_h"), ("after", "before", "high_h")):
        lack = F.lit(least_words) - F.col("w") - F.col(other)
        for low, high in zip(LACK, (*LACK[1:], 1 << 30), strict=True):
            filters.append(bitmap_of(runs.filter((F.col(side) > 0) & (lack >= low) & (lack < high)).select(F.col(h).alias("h")), END_BITS))
    bits = broadcast_value(rows.sparkSession, filters)

    def hashed(batches):
        for ids, texts in pieces_of(batches, ["doc_id", "text"], "text", STEP):
            c = chunks(texts)
            first, last, h = windows(c)
            ok = in_bitmap(h, repeated.value, FILTER_BITS)
            first, last, h = first[ok], last[ok], h[ok]
            doc, ident = pa.array(ids, pa.int64()), identities(ids, texts)
            for after in (False, True):
                lack = np.full(len(h), 1 << 30)
                for k in reversed(range(len(LACK))):
                    lack[in_bitmap(h, bits.value[len(LACK) * after + k], END_BITS)] = LACK[k]
                some = np.flatnonzero(lack < 1 << 30)
                for k in range(0, len(some), ENDS):
                    w = some[k : k + ENDS]
                    found = surroundings(c, first[w], last[w], h[w], after)
                    row, place, words, key = (x[found[2] >= lack[w][found[0]]] for x in found)
                    end = last[w][row]
                    text, at = c.text[end], c.chars[place] - c.chars[c.begins[end]]
                    own = pa.array(text)
                    columns = [doc.take(own), pa.array(ident).take(own), pa.array(c.number[end].astype(np.int32)), pa.array(np.full(len(row), after)), pa.array(at.astype(np.int32)), pa.array(words.astype(np.int32)), pa.array(key.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ident", "n", "after", "at", "words", "key"])

    near = saved(rows.mapInArrow(hashed, "doc_id long, ident long, n int, after boolean, at int, words int, key long"), "surroundings")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "ident", "n")
    shared = near.groupBy("key").agg(F.min(place).alias("from"), F.min("ident").alias("low"), F.max("ident").alias("high")).filter("low < high")
    shared = saved(shared.select("key", F.col("from.doc_id").alias("first_doc"), F.col("from.ident").alias("first_ident"), F.col("from.n").alias("first_n")), "shared")
    held = near.join(shared, "key").select("ident", "n", "after", F.struct(F.when(F.col("after"), F.col("at")).otherwise(-F.col("at")).alias("reach"), "at", "words", "first_doc", ((F.col("ident") == F.col("first_ident")) & (F.col("n") == F.col("first_n"))).alias("first")).alias("x"))
    longest = saved(held.groupBy("ident", "n", "after").agg(F.max("x").alias("x")).select("ident", "n", "after", "x.at", "x.words", "x.first_doc", "x.first"), "longest")
    discard(near, shared)

    low = runs.filter("before > 0").select("rid", "doc_id", "run", "ident", F.col("low_n").alias("n"), F.lit(False).alias("after"), F.col("start").alias("edge"))
    high = runs.filter("after > 0").select("rid", "doc_id", "run", "ident", F.col("high_n").alias("n"), F.lit(True).alias("after"), F.col("stop").alias("edge"))
    both = low.unionByName(high).join(longest, ["ident", "n", "after"])
    return both.select("rid", "doc_id", "run", F.least("edge", "at").alias("start"), F.greatest("edge", "at").alias("stop"), "words", "first_doc", "first")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """Windows that two documents have: rid (numbers the rows read), doc_id, run (of neighbours in a document), start, stop, words, first_doc, first boolean.

    start and words are those of what the window adds to its run: all of it for a run's first, else its last chunk.
    Runs that hold fewer than least_words, but can reach them with the words around, have a row more for each end
    beyond which another document shares words with them. Longer ones count as they are.
    """
    hashes = repeated_hashes(docs, text_col)
    bits = broadcast_value(docs.sparkSession, bitmap_of(hashes, FILTER_BITS))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def kept(batches):
        base, row = TaskContext.get().partitionId() << 33, 0
        for ids, texts in pieces_of(batches, ["doc_id", "text"], "text", STEP):
            c = chunks(texts)
            first, last, h = windows(c)
            ok = np.flatnonzero(in_bitmap(h, bits.value, FILTER_BITS))
            first, last = first[ok], last[ok]
            start, stop, words = c.places()
            low, high = c.low[first], c.high[last]
            before = c.begun[low] - c.begun[low - c.back[first]] + (c.back[first] > 0)
            after = c.begun[high + c.on[last]] - c.begun[high] + (c.on[last] > 0)
            small = [stop[last] - start[first], stop[last] - start[last], c.begun[high] - c.begun[low], words[last], before, after]
            numbers = [c.number[last].astype(np.int32), stop[last].astype(np.int32), sum(x.astype(np.int64) << (FIELD * k) for k, x in enumerate(small)), h[ok].view(np.int64)]
            own = pa.array(c.text[last])
            columns = [pa.array(base + row + c.text[last]), pa.array(ids, pa.int64()).take(own), pa.array(identities(ids, texts)).take(own), *map(pa.array, numbers)]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "doc_id", "ident", "n", "stop", "small", "h"])
            row += len(texts)

    some = saved(rows.mapInArrow(kept, "rid long, doc_id long, ident long, n int, stop int, small long, h long"), "windows")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "n")
    firsts = some.groupBy("h").agg(F.min(place).alias("at"), F.min("rid").alias("low"), F.max("rid").alias("high")).filter("low < high")
    firsts = saved(firsts.select("h", F.col("at.doc_id").alias("first_doc"), F.col("at.rid").alias("first_rid"), F.col("at.n").alias("first_n")), "firsts")
    both = some.join(firsts, "h").withColumn("first", (F.col("rid") == F.col("first_rid")) & (F.col("n") == F.col("first_n")))
    order = Window.partitionBy("rid").orderBy("n")
    both = both.withColumn("run", F.col("n") - F.row_number().over(order)).withColumn("opens", F.coalesce(F.col("n") - F.lag("n").over(order) > 1, F.lit(True)))
    length, own_length, words, own_words, before, after = (F.shiftright("small", FIELD * k).bitwiseAND(F.lit((1 << FIELD) - 1)).cast("int") for k in range(6))
    start = (F.col("stop") - F.when(F.col("opens"), length).otherwise(own_length)).alias("start")
    words = F.when(F.col("opens"), words).otherwise(own_words).alias("words")
    both = saved(both.select("rid", "doc_id", "ident", "run", "n", "h", start, "stop", words, before.alias("before"), after.alias("after"), "first_doc", "first"), "runs")
    discard(hashes, some, firsts)

    low, high = (f(F.struct("n", "h", x, y)).alias(name) for f, x, y, name in ((F.min, "start", "before", "low"), (F.max, "stop", "after", "high")))
    runs = both.groupBy("rid", "doc_id", "ident", "run").agg(low, high, F.sum("words").alias("w")).filter(f"w < {int(least_words)} AND w + low.before + high.after >= {int(least_words)}")
    runs = saved(runs.select("rid", "doc_id", "ident", "run", "w", *(F.col(f"{e}.{x}").alias(f"{e}_{x}") for e in ("low", "high") for x in ("n", "h")), "low.start", "low.before", "high.stop", "high.after"), "ends")
    return both.select("rid", "doc_id", "run", "start", "stop", "words", "first_doc", "first").unionByName(extensions(rows, bits, runs, least_words))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, start, stop, n_words, first_doc_id, n_cut: each run of windows that other documents have too, of least_words or more. A shorter run goes on beyond its windows as far as any of them shares its words, and counts if it so has least_words.

    start and stop are characters of the text; n_words the words begun in between; first_doc_id the smallest id with one of the windows; n_cut the
    characters of the run that stand elsewhere first (in the order of ids, null ids last, rows, places), so
    that cutting them keeps one copy of everything. Repeats within one document alone don't count. Documents
    without such a run have no row, nor do null and empty texts; rows that repeat an id are documents of their own.
    A shared passage is found if it holds one window, so of 51 words all but surely. Windows of a run can stand in
    different documents, as can what lies before and after it.
    """
    found = repeated_windows(docs, id_col, text_col, least_words).groupBy("rid", "doc_id", "run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("words").alias("n_words"), F.min("first_doc").alias("first_doc_id"), F.sum(F.when(F.col("first"), 0).otherwise(F.col("stop") - F.col("start"))).alias("n_cut")
    )
    return found.filter(F.col("n_words") >= least_words).select("doc_id", "start", "stop", "n_words", "first_doc_id", "n_cut")


def without_repeats(docs: DataFrame, text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with the texts cut to what stands in no row before; only runs of least_words or more are cut. Each row goes by itself, whatever its id."""
    rows = saved(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    marked = saved(repeated_windows(rows, "__row", text_col, least_words), "marked")
    runs = saved(marked.groupBy("rid", "run").agg(F.sum("words").alias("w")).filter(F.col("w") >= least_words).drop("w"), "runs")
    spans = marked.filter(~F.col("first")).join(runs, ["rid", "run"]).groupBy(F.col("doc_id").alias("__id")).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("__spans"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("kept"))

    def step(acc, s):
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["kept"], F.substring(F.col(text_col), acc["at"] + 1, s["start"] - acc["at"])).alias("kept"))

    left = F.aggregate("__spans", start, step)
    rest = F.concat(left["kept"], F.substring(F.col(text_col), left["at"] + 1, F.length(text_col)))
    joined = rows.join(spans, rows["__row"] == F.col("__id"), "left")
    return joined.withColumn(text_col, F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(rest)).drop("__id", "__spans", "__row")
