"""Suffix-array dedup: a logarithmic family of sorted suffix arrays finds every long byte string that stands twice."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bitmap_of, discard, in_bitmap, mixed, pieces_of, saved

#: Bytes of the strings that are looked for.
LEAST = 400
#: Batches that a table is dealt into; each is one entry of the index family.
BATCHES = 4
#: Different surroundings of one suffix up to which they are compared by one task; beyond, their strings are counted over all tasks.
CROWD = 4096
#: Bits of the maps that are broadcast (16 MB each), 2 to this power. A full one lets more rows pass, but no result changes.
MAP_BITS = 27
#: Surroundings that a task compares at once, suffixes or ranges of strings it gathers before it passes them on, strings around crowded suffixes dealt to a task.
TOGETHER, MERGE, KEYS = 20_000, 400_000, 2_000_000
#: Ranges that a range of strings around a crowded suffix is parted into.
PARTS = 6
STEP = 1_000_000

_SIGN = np.uint64(1 << 63)


class Suffixes:
    """The suffixes of texts that take part, their orders, and the strings of `least` bytes around them.

    Not every suffix does: of each `span` neighbouring places the one whose next `gram` bytes have the least hash,
    the first of several. So every string of `least` bytes has one in its first `span` places, and equal
    strings have it at the same place, wherever they stand. It is followed there by `key` bytes at least.
    """

    def __init__(self, least: int = LEAST):
        if least < 16:
            raise ValueError("strings must have 16 bytes or more")
        self.least, self.span, self.gram = least, least * 16 // 25 + 1, 16 if least >= 64 else 4
        self.key = least - self.span + 1

    def places(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places, ascending, of the suffixes of texts data[begin:end] that lie one after the other."""
        n, k = len(data), 1
        if n < self.least:
            return np.zeros(0, np.int64)
        h = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[data]
        with np.errstate(over="ignore"):
            while k < self.gram:
                older = h[: len(h) - k] * np.uint64(0xD1342543DE82EF95 + 2 * k)
                older += h[k:]
                h, k = older, 2 * k
        h = mixed(h)
        h >>= np.uint64(32)
        h <<= np.uint64(32)
        h |= np.arange(len(h), dtype=np.uint64)
        k = 1
        while 2 * k <= self.span:
            h = np.minimum(h[:-k], h[k:])
            k *= 2
        if rest := self.span - k:
            h = np.minimum(h[:-rest], h[rest:])
        at = (h & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # Only strings that lie within one text count.
        inside = np.zeros(n + 1, np.int8)
        full = ends - begins >= self.least
        np.add.at(inside, begins[full], 1)
        np.add.at(inside, ends[full] - self.least + 1, -1)
        at = at[np.cumsum(inside)[: len(at)] > 0]
        return at[np.append(True, at[1:] != at[:-1])] if len(at) else at

    def of(self, texts: list[bytes | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts in a row, where each begins, and of each suffix: place, hash of its first key bytes, hash of its surroundings."""
        joined = b"".join(t or b"" for t in texts)
        lengths = np.array([len(t or b"") for t in texts], np.int64)
        ends = np.cumsum(lengths)
        begins = ends - lengths
        at = self.places(np.frombuffer(joined, np.uint8), begins, ends)
        text = np.searchsorted(ends, at, "right")
        low, high = np.maximum(begins[text], at - self.span + 1), np.minimum(ends[text], at + self.least)
        digest, key = xxhash.xxh3_64_intdigest, self.key
        places = at.tolist()
        first = np.fromiter((digest(joined[p : p + key]) for p in places), np.uint64, len(at))
        around = np.fromiter((digest(joined[a:b], p - a) for a, p, b in zip(low.tolist(), places, high.tolist(), strict=True)), np.uint64, len(at))
        return joined, begins, at, first, around


def _head(joined: bytes, at: np.ndarray) -> np.ndarray:
    """The first 8 bytes of the suffixes as numbers in the same order."""
    data = np.frombuffer(joined + b"\0" * 8, np.uint8)
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | data[at + k]
    return (out ^ _SIGN).view(np.int64)


def suffix_rows(docs: DataFrame, suffixes: Suffixes, text_col: str) -> DataFrame:
    """head, h, ctx, n: sorted suffixes of the texts, task by task; those that are alike up to the end of their surroundings in one row with their number."""

    def found(batches):
        kept, held = [], 0

        def merged():
            head, h, ctx = (np.concatenate([k[j] for k in kept]) for j in range(3))
            order = np.lexsort((ctx, h, head))
            head, h, ctx = head[order], h[order], ctx[order]
            first = np.flatnonzero((np.diff(head, prepend=0) != 0) | (np.diff(h, prepend=0) != 0) | (np.diff(ctx, prepend=0) != 0) | (np.arange(len(h)) == 0))
            n = np.diff(np.append(first, len(h)))
            return pa.RecordBatch.from_arrays([pa.array(head[first]), pa.array(h[first]), pa.array(ctx[first]), pa.array(n)], names=["head", "h", "ctx", "n"])

        for (texts,) in pieces_of(batches, ["text"], "text", STEP):
            joined, _, at, h, ctx = suffixes.of(texts)
            kept.append((_head(joined, at), h.view(np.int64), ctx.view(np.int64)))
            held += len(at)
            if held > MERGE:
                yield merged()
                kept, held = [], 0
        if held:
            yield merged()

    return docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(found, "head long, h long, ctx long, n long")


class IndexFamily:
    """Suffix arrays of all batches so far, of 1, 2, 4, ... batches each, no two of the same size.

    add() makes the suffix array of a batch, scans it against all others in their order for suffixes that go on
    alike for `key` bytes (the only ones that can lie in a repeated string), and merges arrays of the same size
    until sizes differ, so that a suffix is merged as often as the logarithm of the number of batches says. An array is
    dealt over files by a hash of its entries; each file is sorted by suffix (its first 8 bytes, then a hash of its
    first key bytes, then one of all its surroundings).
    """

    ENTRY = ("head", "h", "ctx")

    def __init__(self, least: int = LEAST, text_col: str = "text"):
        self.suffixes, self.text_col = Suffixes(least), text_col
        self.levels: list[tuple[int, DataFrame]] = []
        self.found: list[DataFrame] = []

    def _array(self, rows: DataFrame) -> DataFrame:
        return saved(rows.groupBy(*self.ENTRY).agg(F.sum("n").alias("n")).sortWithinPartitions(*self.ENTRY), "suffixes")

    def add(self, docs: DataFrame) -> DataFrame:
        """Takes a batch in; head, h of the suffixes of the batch that stand in it twice or in a batch before."""
        array = self._array(suffix_rows(docs, self.suffixes, self.text_col))
        own = array.groupBy("head", "h").agg(F.sum("n").alias("n"))
        twice = own.filter("n > 1").select("head", "h")
        before = [level.select("head", "h") for _, level in self.levels]
        if before:
            scanned = reduce(DataFrame.unionAll, before).distinct().hint("merge").join(own.select("head", "h"), ["head", "h"], "left_semi")
            twice = twice.unionAll(scanned).distinct()
        self.found.append(saved(twice, "found"))
        self.levels.append((1, array))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, one), (_, two) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * size, self._array(one.unionAll(two))))
            discard(one, two)
        return self.found[-1]

    def entries(self) -> DataFrame:
        """Written rows head, h, ctx, n of the suffixes that stand twice."""
        # Written, so that the join deals both its sides out and Spark can split a suffix with many surroundings.
        found = saved(reduce(DataFrame.unionAll, self.found).distinct(), "found")
        rows = reduce(DataFrame.unionAll, [level for _, level in self.levels])
        twice = rows.hint("merge").join(found, ["head", "h"], "left_semi")
        out = saved(twice.groupBy("h", "ctx").agg(F.sum("n").alias("n")), "entries")
        discard(found, *self.found, *(level for _, level in self.levels))
        self.found, self.levels = [], []
        return out


def _deal(docs: DataFrame, batches: int, id_col: str, text_col: str) -> list[DataFrame]:
    at = F.pmod(F.xxhash64(F.col(id_col), F.length(text_col)), F.lit(batches))
    return [docs.filter(at == k) for k in range(batches)]


def _placed(docs: DataFrame, suffixes: Suffixes, entries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written rows row, doc_id, text (bytes), p, h, ctx (arrays): all documents with those of their suffixes that stand twice."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap_of(entries.select("h"), MAP_BITS))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))

    def found(batches):
        base, row = TaskContext.get().partitionId() << 33, 0
        for ids, texts in pieces_of(batches, ["doc_id", "text"], "text", STEP):
            _, begins, at, h, ctx = suffixes.of(texts)
            ok = in_bitmap(h, bits.value, MAP_BITS)
            at, h, ctx = at[ok], h[ok].view(np.int64), ctx[ok].view(np.int64)
            # Empty texts begin where the next one does: the last that begins at or before a place has it.
            text = np.searchsorted(begins, at, "right") - 1
            cuts = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in ((at - begins[text]).astype(np.int32), h, ctx)]
            yield pa.RecordBatch.from_arrays([pa.array(base + row + np.arange(len(texts))), pa.array(ids, pa.int64()), pa.array(texts, pa.binary()), *lists], names=["row", "doc_id", "text", "p", "h", "ctx"])
            row += len(texts)

    out = saved(rows.mapInArrow(found, "row long, doc_id long, text binary, p array<int>, h array<long>, ctx array<long>"), "placed")
    bits.destroy()
    return out


def _surroundings(placed: DataFrame, suffixes: Suffixes, classes: DataFrame) -> DataFrame:
    """hot, h, ctx, before (reversed), after: surroundings of the suffixes in classes (h, m), from each task once."""
    context = placed.sparkSession.sparkContext
    some, hot = (context.broadcast(bitmap_of(classes.filter(c).select("h"), MAP_BITS)) for c in (f"m <= {CROWD}", f"m > {CROWD}"))
    least, span = suffixes.least, suffixes.span

    def found(batches):
        known: set[tuple[int, int]] = set()
        for texts, ps, hs, ctxs in pieces_of(batches, ["text", "p", "h", "ctx"], "text", STEP):
            n = [len(p) for p in ps]
            text = np.repeat(np.arange(len(texts)), n).tolist()
            p, h, ctx = (np.fromiter((x for xs in lists for x in xs), np.int64, sum(n)) for lists in (ps, hs, ctxs))
            crowded = in_bitmap(h.view(np.uint64), hot.value, MAP_BITS)
            out = []
            for k in np.flatnonzero(crowded | in_bitmap(h.view(np.uint64), some.value, MAP_BITS)).tolist():
                at = int(h[k]), int(ctx[k])
                if at not in known:
                    if len(known) > MERGE:
                        known.clear()
                    known.add(at)
                    t, q = texts[text[k]], int(p[k])
                    out.append((bool(crowded[k]), *at, t[max(0, q - span + 1) : q][::-1], t[q : q + least]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["hot", "h", "ctx", "before", "after"])

    rows = placed.filter(F.size("p") > 0).select("text", "p", "h", "ctx")
    return saved(rows.mapInArrow(found, "hot boolean, h long, ctx long, before binary, after binary"), "surroundings")


def _common(order: np.ndarray, h: np.ndarray, texts: list[bytes], wide: int) -> np.ndarray:
    """Bytes that each text in this order has in common with the one before; -1 at the first of a class."""
    size = np.array([len(t) for t in texts])[order]
    flat = np.frombuffer(b"".join(texts[k].ljust(wide, b"\0") for k in order), np.uint8).reshape(len(order), wide)
    apart = flat[1:] != flat[:-1]
    length = np.where(apart.any(axis=1), apart.argmax(axis=1), wide)
    length = np.minimum(length, np.minimum(size[1:], size[:-1]))
    return np.append(-1, np.where(h[order][1:] == h[order][:-1], length, -1))


def reach(h: np.ndarray, before: list[bytes], after: list[bytes], least: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Of different surroundings of suffixes in classes h: the bytes before and after each suffix that strings of `least`
    bytes around it cover which other surroundings of its class have too; -1 where there is none.

    Sorted by what follows and by what precedes (reversed), each with the bytes in common with its neighbour; a string with o bytes before
    the suffix stands in all that are not parted by fewer than least - o common bytes in the one order and o in the other.
    """
    low, high = np.full(len(h), -1), np.full(len(h), -1)
    alive = np.arange(len(h))
    for last in (False, True):
        if len(alive) < 2:
            return low, high
        own, left, right = h[alive], [before[k] for k in alive], [after[k] for k in alive]
        orders, common = [], []
        for texts, wide in ((right, least), (left, span - 1)):
            size = np.array([len(t) for t in texts])
            order = np.lexsort((size, np.array(texts, f"S{wide}"), own))
            orders.append(order)
            common.append(_common(order, own, texts, wide))
        if not last:  # only these can have a string in common with another
            most = [np.zeros(len(alive), np.int64) for _ in orders]
            for m, order, c in zip(most, orders, common, strict=True):
                m[order] = np.maximum(c, np.append(c[1:], -1))
            alive = alive[(most[0] + most[1] >= least) & (most[0] >= 0)]
    group = np.zeros((2, len(alive)), np.int64)
    for o in range(span):
        for g, order, c, need in zip(group, orders, common, (least - o, o), strict=True):
            g[order] = np.cumsum(c < need)
        both = group[0] * (len(alive) + 1) + group[1]
        order = np.argsort(both)
        same = np.append(False, both[order][1:] == both[order][:-1])
        twice = alive[order[same | np.append(same[1:], False)]]
        low[twice] = o
        high[twice] = np.where(high[twice] < 0, least - o, high[twice])
    return low, high


def _compared(rows: DataFrame, suffixes: Suffixes) -> DataFrame:
    """h, ctx, low, high of the surroundings that reach() finds, class by class; rows: _surroundings() of classes of up to CROWD."""
    dealt = rows.select("h", "ctx", "before", "after").repartition("h").sortWithinPartitions("h", "ctx")

    def solved(h, ctx, before, after):
        new = np.append(True, (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1]))
        at = np.flatnonzero(new)
        low, high = reach(h[at], [before[k] for k in at], [after[k] for k in at], suffixes.least, suffixes.span)
        ok = np.flatnonzero(low >= 0)
        return pa.RecordBatch.from_arrays([pa.array(h[at][ok]), pa.array(ctx[at][ok]), pa.array(low[ok].astype(np.int32)), pa.array(high[ok].astype(np.int32))], names=["h", "ctx", "low", "high"])

    def found(batches):
        h, ctx, before, after = np.zeros(0, np.int64), np.zeros(0, np.int64), [], []
        for batch in batches:
            h, ctx = np.concatenate([h, batch.column(0).to_numpy()]), np.concatenate([ctx, batch.column(1).to_numpy()])
            before, after = before + batch.column(2).to_pylist(), after + batch.column(3).to_pylist()
            while len(h) > TOGETHER:
                cut = np.flatnonzero(h[1:] != h[:-1]) + 1
                inside = cut[cut <= TOGETHER]
                end = int(inside[-1]) if len(inside) else int(cut[0]) if len(cut) else 0
                if not end:
                    break
                yield solved(h[:end], ctx[:end], before[:end], after[:end])
                h, ctx, before, after = h[end:], ctx[end:], before[end:], after[end:]
        if len(h):
            yield solved(h, ctx, before, after)

    return dealt.mapInArrow(found, "h long, ctx long, low int, high int")


def _counted(rows: DataFrame, suffixes: Suffixes) -> DataFrame:
    """h, ctx, low, high as by _compared(), for classes of any size: hashes (64 bits) of what strings around a suffix have in common are counted over all tasks.

    A string is named by the bytes it has before the suffix, 0 to span - 1. These are parted into ranges, the ranges into PARTS
    again and so on, down to single strings. For each range of a suffix's surroundings two hashes are counted: of the bytes that all its
    strings share (inner) and of all that they cover (outer). Where the outer one stands twice, so do all strings of the range; one of
    the surroundings that are alike there goes on, for others to meet. Where the inner one stands once, none does. Only the rest are
    parted again, so that the work follows the rows and not the strings that stand twice.
    """
    total = rows.count() * suffixes.span
    if not total:
        return rows.selectExpr("h", "ctx", "0 as low", "0 as high").limit(0)
    # Surroundings of one suffix are alike and make small files, each of them the work of many hashes: dealt by number, not by bytes.
    tasks = -(-total // KEYS)
    hot = saved(rows.repartition(tasks, "h", "ctx").groupBy("h", "ctx").agg(F.first("before").alias("before"), F.first("after").alias("after")), "crowded")
    least, span, digest = suffixes.least, suffixes.span, xxhash.xxh3_64_intdigest
    bits = int(np.clip(np.ceil(np.log2(total / KEYS)) + 3, 3, 24))
    kind = np.dtype([("inner", np.uint64), ("outer", np.uint64), ("h", np.int64), ("ctx", np.int64), ("begin", np.int32), ("many", np.int32)])
    out = "h long, ctx long, low int, high int, part int, data binary"

    def extents(h, ctx, low, high):
        n = len(h)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(ctx), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["h", "ctx", "low", "high", "part", "data"])

    def packed(of, data):
        """data, many to a row, by their part (ascending)."""
        cuts = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
        n = len(cuts) - 1
        blobs = [data[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([*(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())), pa.array(of[cuts[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], names=["h", "ctx", "low", "high", "part", "data"])

    def alike(x):
        """x in the order of its hashes, and where other inner hashes, and other pairs of hashes begin."""
        x = x[np.lexsort((x["outer"], x["inner"]))]
        other = np.append(True, x["inner"][1:] != x["inner"][:-1])[: len(x)]
        return x, other, other | np.append(True, x["outer"][1:] != x["outer"][:-1])[: len(x)]

    def ends(x, width):
        return np.minimum(x["begin"] + width, span) - 1, least - x["begin"]

    def hashed(wide: int, width: int, known):
        """Ranges of width places within those of wide places that known has (all without it), packed, one of those alike in the task; extents of those that aren't alone there."""
        begins = np.arange(0, span, wide)

        def flushed(kept):
            x, _, new = alike(np.concatenate(kept))
            n = np.diff(np.append(np.flatnonzero(new), len(x)))
            same = x[np.repeat(n > 1, n)]
            if len(same):
                same = same[np.lexsort((same["ctx"], same["h"]))]
                at = np.flatnonzero(np.append(True, (same["h"][1:] != same["h"][:-1]) | (same["ctx"][1:] != same["ctx"][:-1])))
                low, high = (np.maximum.reduceat(y, at) for y in ends(same, width))
                yield extents(same["h"][at], same["ctx"][at], low, high)
            x = x[new]
            x["many"] = n > 1
            yield packed(x["inner"] >> np.uint64(64 - bits), x)

        def found(batches):
            kept, held = [], 0
            for batch in batches:
                h, ctx = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                before, after = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                ids = (h ^ ctx).view(np.uint64)[:, None] ^ (begins.astype(np.uint64) << np.uint64(55))
                ok = in_bitmap(ids, known.value, MAP_BITS) if known else np.ones(ids.shape, bool)
                rows = []
                for k, j in zip(*(x.tolist() for x in np.nonzero(ok)), strict=True):
                    text, left, right = before[k][::-1] + after[k], len(before[k]), len(after[k])
                    for a in range(j * wide, min((j + 1) * wide, span), width):
                        b = min(a + width, span) - 1
                        if a > left or least - b > right:
                            continue
                        seed = int(h[k]) & 0xFFFFFFFFFFFFFFFF ^ a
                        inner = digest(text[left - a : left + least - b], seed)
                        if b > left or least - a > right:  # not all strings of the range are there: parted anyway
                            outer = int(ctx[k]) & 0xFFFFFFFFFFFFFFFF
                        else:
                            outer = digest(text[left - b : left + least - a], seed) if a < b else inner
                        rows.append((inner, outer, int(h[k]), int(ctx[k]), a, 0))
                if rows:
                    kept.append(np.array(rows, kind))
                    held += len(rows)
                if held > MERGE:
                    yield from flushed(kept)
                    kept, held = [], 0
            if kept:
                yield from flushed(kept)

        return saved(hot.mapInArrow(found, out), "ranges")

    def met(ranges: DataFrame, width: int) -> DataFrame:
        """Extents of ranges that are alike in different tasks; ids of the ranges that are to be parted, packed."""

        def solved(kept):
            x, other, new = alike(np.concatenate(kept))
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(x)))
            same = x[np.repeat(n > 1, n) & (x["many"] == 0)]
            if len(same):
                yield extents(same["h"], same["ctx"], *ends(same, width))
            # One of each that are alike, where others have the same inner hash.
            several = np.add.reduceat(new.astype(np.int64), np.flatnonzero(other))[np.cumsum(other) - 1] > 1
            x = x[new & several]
            ids = np.sort((x["h"] ^ x["ctx"]).view(np.uint64) ^ (x["begin"].astype(np.uint64) << np.uint64(55)))
            if width > 1 and len(ids):
                yield packed(ids >> np.uint64(58), ids)

        def found(batches):
            part, kept, held = None, [], 0
            for batch in batches:
                for p, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if p != part and held > MERGE:
                        yield from solved(kept)
                        kept, held = [], 0
                    part = p
                    kept.append(np.frombuffer(x.as_py(), kind))
                    held += len(kept[-1])
            if kept:
                yield from solved(kept)

        return saved(ranges.filter("part is not null").select("part", "data").repartition("part").sortWithinPartitions("part").mapInArrow(found, out), "met")

    def map_of(ids: DataFrame) -> np.ndarray:
        """The bit map of packed ids on the driver, in 64 parts; more that pass it do no harm."""

        def made(batches):
            part, own = None, None
            for batch in batches:
                for p, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if p != part:
                        if own is not None:
                            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own.tobytes()])], names=["part", "map"])
                        part, own = p, np.zeros(1 << (MAP_BITS - 9), np.uint8)
                    at = (np.frombuffer(x.as_py(), np.uint64) >> np.uint64(64 - MAP_BITS)) & np.uint64((1 << (MAP_BITS - 6)) - 1)
                    np.bitwise_or.at(own, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
            if own is not None:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own.tobytes()])], names=["part", "map"])

        found = np.zeros((64, 1 << (MAP_BITS - 9)), np.uint8)
        for r in ids.repartition("part").sortWithinPartitions("part").mapInArrow(made, "part int, map binary").toLocalIterator():
            found[r.part] = np.frombuffer(r.map, np.uint8)
        return found.reshape(-1)

    wide, width, known, results = span, 1, None, []
    while width * PARTS**2 <= span:
        width *= PARTS
    while True:
        ranges = hashed(wide, width, known)
        if known:
            known.destroy()
        both = met(ranges, width)
        results += [saved(x.filter("h is not null").select("h", "ctx", "low", "high"), "extents") for x in (ranges, both)]
        on = map_of(both.filter("part is not null").select("part", "data")) if width > 1 else np.zeros(1)
        discard(ranges, both)
        if not on.any():
            break
        wide, width, known = width, width // PARTS, rows.sparkSession.sparkContext.broadcast(on)
    discard(hot)
    return reduce(DataFrame.unionAll, results).repartition(tasks, "h", "ctx").groupBy("h", "ctx").agg(F.max("low").alias("low"), F.max("high").alias("high"))


def covered(docs: DataFrame, least: int = LEAST, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans array<struct<start,stop>>, kept binary: one row a document, repeated rows too.

    spans: the maximal runs of bytes that lie in a string of `least` bytes which also starts anywhere else, in
    another document or the same one, overlapping or not; kept: the other bytes. Strings don't go over the end of a
    document, and are judged on what is given, so that no copy is left. A cut can fall within a character.

    The documents are dealt into batches and added to an IndexFamily; what its scans find is followed up: a
    suffix whose whole surroundings stand twice is covered with them; other surroundings of one suffix are compared with each
    other. Suffixes and surroundings are known by hashes of 64 bits, surroundings are compared by their bytes, except that
    those of a suffix with over CROWD different ones are compared by hashes of their strings.

    Null texts count as empty: no spans. Null ids stay, rows that repeat an id are documents of their own. Other columns are
    left out; an empty table gives no rows. A text is held whole, in one task.
    """
    family = IndexFamily(least, text_col)
    suffixes = family.suffixes
    for batch in _deal(docs, batches, id_col, text_col):
        family.add(batch)
    entries = family.entries()
    placed = _placed(docs, suffixes, entries, id_col, text_col)
    classes = entries.groupBy("h").agg(F.count("*").alias("m"), F.min("n").alias("least")).filter("m > 1 and least = 1")
    around = _surroundings(placed, suffixes, saved(classes, "classes"))
    parts = [entries.filter("n > 1").select("h", "ctx", F.lit(suffixes.span - 1).alias("low"), F.lit(least).alias("high")), _compared(around.filter("not hot"), suffixes)]
    parts.append(_counted(around.filter("hot"), suffixes))
    extents = saved(reduce(DataFrame.unionAll, parts), "extents")
    discard(around)
    size = F.length("text")
    held = placed.filter(F.size("p") > 0).select("row", size.alias("n"), F.explode(F.arrays_zip("p", "h", "ctx")).alias("s")).select("row", "n", "s.p", "s.h", "s.ctx")
    spans = held.join(extents, ["h", "ctx"]).select("row", F.greatest(F.col("p") - F.col("low"), F.lit(0)).alias("start"), F.least(F.col("p") + F.col("high"), F.col("n")).alias("stop"))
    spans = saved(spans.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")
    none = F.expr("cast(null as array<struct<start:int,stop:int>>)")
    rows = placed.select("row", "doc_id", "text", F.size("p").alias("n"))
    # Texts without a suffix that stands twice aren't moved.
    both = rows.filter("n > 0").drop("n").join(spans, "row", "left").unionByName(rows.filter("n = 0").drop("n").withColumn("spans", none))

    def cut(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for ids, texts, lists in pieces_of(batches, ["doc_id", "text", "spans"], "text", STEP):
            runs, kept = [], []
            for text, own in zip(texts, lists, strict=True):
                merged: list[list[int]] = []
                for a, b in sorted((s["start"], s["stop"]) for s in own or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                ends = [0, *(x for m in merged for x in m), len(text)]
                runs.append([{"start": a, "stop": b} for a, b in merged])
                kept.append(b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return both.select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:int,stop:int>>, kept binary")


def digests(made: DataFrame) -> DataFrame:
    """made (of covered()) as doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return made.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
