"""Benchmark decontamination: rare seeds of two words, then Smith-Waterman alignment of words."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import Intermediates, bitmap_of, broadcast_if_small, broadcast_value, free_name, in_bitmap, mixed, ngram_hashes, pieces_of, saved

#: An item of fewer words is one seed as a whole, and so is a document of fewer.
SEED = 3
#: Alignment score of two equal words, two different ones, and a word left out; a pair counts from this share of the score of a whole copy on.
MATCH, MISMATCH, GAP, LEAST = 2, -1, -1, 0.5
#: Bits of the filter over seeds that is broadcast, whatever the size of the benchmark.
FILTER_BITS = 25
#: Items up to which their words are broadcast, if none has more than so many words.
BROADCAST_ITEMS, BROADCAST_WORDS = 20_000, 500
#: Items of up to so many words are one class, those of up to 4 times as many the next one, and so on.
CLASS = 64
#: Seeds up to which they are broadcast, and in how many parts each is dealt where they are more.
BROADCAST_SEEDS, SALT = 200_000, 16
STEP = 2_000_000
#: Seeds whose counts a task holds before it passes them on.
KNOWN = 1_000_000
#: Pairs of an item and a stretch that are looked at together before they are aligned.
PAIRS = 500

_SIGNS = string.punctuation.encode()
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def _of_bytes(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of each byte, of A-Z in lower case, with its place in a word."""
    lower = np.where((data >= 65) & (data <= 90), data + 32, data)
    with np.errstate(over="ignore"):
        return mixed(mixed(place.astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15) * (lower.astype(np.uint64) + np.uint64(1)))


#: Hashes of bytes at places from 1 to PLACES, by place * 256 + byte.
PLACES = 32
_HASHED = _of_bytes(np.tile(np.arange(256), PLACES + 1), np.repeat(np.arange(PLACES + 1), 256))


def words_of(text: str | None) -> np.ndarray:
    """Hashes of the words in lower case without ASCII punctuation."""
    return joined_words([text])[0]


def joined_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """words_of() of all texts, one after the other, and how many each has. A word's hash is made up of one for each of its bytes and the byte's place, for all words together."""
    each = [(t or "").encode("utf-8", "replace").translate(None, _SIGNS) for t in texts]
    data = np.frombuffer(b" ".join([b"", *each, b""]), np.uint8)
    space = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    begins, ends = edges[::2], edges[1::2]
    if len(begins):
        place = np.arange(1, len(data) + 1, dtype=np.int32)
        place[begins[0] :] -= np.repeat(begins.astype(np.int32), np.diff(begins, append=len(data)))
        values = _HASHED[np.minimum(place, PLACES) * 256 + data]
        far = np.flatnonzero((place > PLACES) & ~space)
        values[far] = _of_bytes(data[far], place[far])
        values[space] = 0
        hashes = mixed(np.add.reduceat(values, begins))
    else:
        hashes = np.zeros(0, np.uint64)
    return hashes, np.diff(np.searchsorted(begins, np.cumsum([len(t) + 1 for t in each])), prepend=0)


def pairs_of(words: np.ndarray, apart: int) -> np.ndarray:
    """Hash of each word with the one that stands `apart` words on; the distance itself doesn't count."""
    if len(words) <= apart:
        return words[:0]
    with np.errstate(over="ignore"):
        return mixed(words[:-apart] * np.uint64(0x9E3779B97F4A7C15) + words[apart:])


def whole_seed(words: np.ndarray) -> np.ndarray:
    return mixed(ngram_hashes(words, max(1, len(words))) ^ np.uint64(0x5851F42D4C957F2D))


def item_seeds(words: np.ndarray) -> np.ndarray:
    """The seeds of an item: each two neighbouring words (of three words, the outer two as well), repeats kept."""
    if len(words) < SEED:
        return whole_seed(words)
    return np.concatenate([pairs_of(words, 1), pairs_of(words, 2)]) if len(words) == SEED else pairs_of(words, 1)


def held_seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The seeds of a document, two words next to each other or with one between, and the place of each in it."""
    if len(words) < SEED:
        own = whole_seed(words)
        return own, np.zeros(len(own), np.int64)
    one, two = pairs_of(words, 1), pairs_of(words, 2)
    return np.concatenate([one, two]), np.concatenate([np.arange(len(one)), np.arange(len(two))])


def seeds_in_common(n):
    """Of an item's n words, how many seeds a stretch holds at least where it aligns with LEAST of the score.

    With m words matched, t left out at the ends, u within and v put in, the score 2m - u - v is at least half of the item's 2n where
    m >= t + 2u + v. At least m - 1 - u neighbours are then matched both; at most v / 2 of them have two
    words or more put between. So (m + t) / 2 - 1 or more stand at a distance of 1 or 2; as n = m + t + u and 3u <= n, that is n / 3 - 1.
    Of three words the outer two alone can do, and they are a seed too.
    """
    return np.maximum(1, -(-n // 3) - 1)


def item_words(benchmark: DataFrame) -> DataFrame:
    """item_id, n (words), words (hashes as uint32), seeds, item and kind (class by length); repeated rows of one id and text count once."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).distinct()

    def hashed(batches):
        for ids, texts in pieces_of(batches, ["item_id", "text"], "text", STEP):
            words = [words_of(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int32()), pa.array([w.astype("<u4").tobytes() for w in words]), pa.array([item_seeds(w).view(np.int64) for w in words], pa.list_(pa.int64()))],
                names=["item_id", "n", "words", "seeds"],
            )

    kind = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("n"), F.lit(1)) / CLASS) / 2)).cast("int")
    found = rows.mapInArrow(hashed, "item_id long, n int, words binary, seeds array<long>")
    return saved(found.withColumn("item", F.monotonically_increasing_id()).withColumn("kind", kind), "items")


def widths(items: DataFrame) -> dict[int, int]:
    """Words of a document that an alignment over the least score can span, for each class: twice those of its longest item, as every word left out or put in takes from the score. There are at most 14 classes."""
    return {r.kind: 2 * r.n + 1 for r in items.groupBy("kind").agg(F.max("n").alias("n")).toLocalIterator()}


def seed_counts(docs: DataFrame, seeds: DataFrame, text_col: str = "text") -> DataFrame:
    """h, times: how often each of the seeds stands in the documents without a word between; others that the filter takes for some come too. Each task merges its own first."""
    bits = broadcast_value(docs.sparkSession, bitmap_of(seeds.select("h"), FILTER_BITS))

    def counted(batches):
        total: dict[int, int] = {}
        for (texts,) in pieces_of(batches, ["text"], "text", STEP):
            words, n = joined_words(texts)
            found = pairs_of(words, 1)
            ok = in_bitmap(found, bits.value, FILTER_BITS)
            ends = np.cumsum(n) - 1
            ok[ends[(ends >= 0) & (ends < len(ok))]] = False  # a text's last word and the next one's first
            h, n = np.unique(found[ok].view(np.int64), return_counts=True)
            for k, x in zip(h.tolist(), n.tolist(), strict=True):
                total[k] = total.get(k, 0) + x
            if len(total) > KNOWN:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["h", "n"])
                total = {}
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["h", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("times"))


def rare_seeds(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """Written rows item, kind, h: of each item's seeds the rarest in the documents, so many that no alignment over the least score does without all of them.

    A stretch lacks all but seeds_in_common() of an item's seeds at most, so that one more than it can lack are looked up.
    """
    each = saved(items.select("item", "kind", "n", F.size("seeds").alias("size"), F.posexplode("seeds").alias("pos", "h")), "seeds")
    times = saved(seed_counts(docs, each, text_col), "times")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("times", F.lit(0)), "h", "pos"))
    common = F.greatest(F.lit(1), F.ceil(F.col("n") / 3) - 1)
    chosen = each.join(times, "h", "left").withColumn("rank", rank).filter(F.col("rank") <= F.col("size") - common + 1)
    return saved(chosen.select("item", "kind", "h").distinct(), "chosen")


def with_items(tiles: DataFrame, seeds: DataFrame) -> DataFrame:
    """rid, kind, tile, item: each stretch with all items of its class that share a seed. Where seeds are too many to be broadcast, each is dealt SALT times, so that a frequent one is many tasks' work."""
    held = tiles.select("rid", "kind", "tile", F.explode("seeds").alias("h"))
    if seeds.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS:
        both = held.join(F.broadcast(seeds), ["h", "kind"])
    else:
        salted = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        both = held.withColumn("salt", F.pmod(F.xxhash64("rid", "tile"), F.lit(SALT)).cast("int")).join(salted, ["h", "kind", "salt"])
    return both.select("rid", "kind", "tile", "item").distinct()


def tiles_with_seeds(docs: DataFrame, seeds: DataFrame, width: dict[int, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each class of items, stretches of 2 * width words, each width words further on, that hold a seed of the class: rid, kind, tile, doc_id, words, seeds.

    Every passage of up to the class's width lies within one of them. rid numbers the rows read.
    """
    bits = {kind: broadcast_value(docs.sparkSession, bitmap_of(seeds.filter(F.col("kind") == kind).select("h"), FILTER_BITS)) for kind in width}
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def tiled(batches):
        base, row = TaskContext.get().partitionId() << 33, 0
        for ids, texts in pieces_of(batches, ["doc_id", "text"], "text", STEP):
            out = []
            words, n = joined_words(texts)
            ends = np.cumsum(n)
            begins = ends - n
            short = np.flatnonzero((n > 0) & (n < SEED))
            text_of = np.repeat(np.arange(len(texts)), n)
            grams = [pairs_of(words, 1), pairs_of(words, 2)]
            # Both words of a pair stand in one text, and it is long enough not to be a seed as a whole.
            inside = [(text_of[: len(g)] == text_of[len(text_of) - len(g) :]) & (n[text_of[: len(g)]] >= SEED) for g in grams]
            for kind, w in width.items():
                hits = [np.flatnonzero(in_bitmap(g, bits[kind].value, FILTER_BITS) & ok) for g, ok in zip(grams, inside, strict=True)]
                at, seeds_ = np.concatenate(hits), np.concatenate([g[h] for g, h in zip(grams, hits, strict=True)])
                if len(short):
                    whole = [whole_seed(words[begins[k] : ends[k]])[0] for k in short]
                    own = in_bitmap(np.array(whole, np.uint64), bits[kind].value, FILTER_BITS)
                    at, seeds_ = np.concatenate([at, begins[short[own]]]), np.concatenate([seeds_, np.array(whole, np.uint64)[own]])
                order = np.argsort(at, kind="stable")
                at, seeds_ = at[order], seeds_[order].view(np.int64)
                text = text_of[at]
                at = at - begins[text]
                # Each place lies in two stretches, in the first w words of a text in one.
                tile = np.concatenate([at // w, (at // w - 1)])
                two = np.stack([np.tile(text, 2), tile])[:, tile >= 0]
                cuts = np.searchsorted(text, np.arange(len(texts) + 1))
                for t, k in np.unique(two, axis=1).T.tolist():
                    own = slice(cuts[t], cuts[t + 1])
                    lo, hi = np.searchsorted(at[own], [k * w, (k + 2) * w]) + cuts[t]
                    stretch = words[begins[t] + k * w : min(ends[t], begins[t] + (k + 2) * w)]
                    out.append((base + row + t, kind, k, ids[t], stretch.astype("<u4").tobytes(), np.unique(seeds_[lo:hi])))
            row += len(texts)
            if out:
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int64()), pa.array(c[4]), pa.array(c[5], pa.list_(pa.int64()))], names=["rid", "kind", "tile", "doc_id", "words", "seeds"])

    return saved(rows.mapInArrow(tiled, "rid long, kind int, tile int, doc_id long, words binary, seeds array<long>"), "tiles")


def align(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each a (item) with its b (stretch): score, first word in b, end in b.

    All pairs go row by row at once. A cell holds score * 2**32 + start, so that a maximum carries
    the start along; along a row, gaps are a running maximum of the values made up for the gap's cost.
    """
    unit = np.int64(1 << 32)
    la, lb = max(map(len, a)), max(map(len, b))
    pa_, pb = np.full((len(a), la), -1, np.int64), np.full((len(b), lb), -2, np.int64)
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        pa_[k, : len(x)], pb[k, : len(y)] = x, y
    empty = np.arange(1, lb + 1, dtype=np.int64)
    ramp = -GAP * unit * np.arange(lb, dtype=np.int64)
    above = np.tile(empty, (len(a), 1))
    best, end = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for i in range(la):
        diagonal = np.concatenate([np.zeros((len(a), 1), np.int64), above[:, :-1]], axis=1)
        row = diagonal + np.where(pb == pa_[:, i : i + 1], MATCH, MISMATCH) * unit
        row = np.maximum(np.maximum(row, above + GAP * unit), empty)
        row = np.maximum.accumulate(row + ramp, axis=1) - ramp
        at = row.argmax(axis=1)
        top = row[np.arange(len(a)), at]
        better = (top >> 32) > (best >> 32)
        best, end = np.where(better, top, best), np.where(better, at + 1, end)
        above = row
    return best >> 32, best & (unit - 1), end


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, similarity, start, stop: documents with a copy, whole, edited or cut, of an item.

    similarity (LEAST to 1) is the alignment's score over that of a whole copy; start and stop number the
    document's words the alignment spans. The best alignment of each pair; rows that share an id count as one
    document, null ids too. Null and empty texts match nothing. An item under SEED words has no seed in a longer text and
    so matches only documents that are that item and nothing else. Of all others no alignment over LEAST is lost: see
    seeds_in_common() and rare_seeds(), which hold for these scores (equal hashes of words apart). Items are aligned with stretches as wide as their
    own class by length asks, so that one long item doesn't widen all. Other columns are left out.
    """
    items = item_words(benchmark)
    width = widths(items)
    seeds = rare_seeds(docs, items, text_col)
    tiles = tiles_with_seeds(docs, seeds, width, id_col, text_col)
    pairs = with_items(tiles, seeds)
    known = items.select("item", "item_id", F.col("words").alias("item_words"))
    if max(width.values(), default=0) <= 2 * BROADCAST_WORDS + 1:
        known = broadcast_if_small(known, BROADCAST_ITEMS)
    both = pairs.join(tiles.select("rid", "kind", "tile", "doc_id", "words"), ["rid", "kind", "tile"]).join(known, "item").select("doc_id", "item_id", "kind", "tile", "words", "item_words")

    def aligned(batches):
        for batch in batches:
            doc, item, kind, tile, words, own = (c.to_pylist() for c in batch.columns)
            words, own = ([np.frombuffer(x, "<u4").astype(np.uint64) for x in side] for side in (words, own))
            able = np.concatenate([can_match(words[k : k + PAIRS], own[k : k + PAIRS]) for k in range(0, len(own), PAIRS)]) if own else []
            for at in _alike([len(x) * len(y) if ok else 0 for x, y, ok in zip(words, own, able, strict=True)]):
                a = [own[k] for k in at]
                score, start, stop = align(a, [words[k] for k in at])
                share = score / (MATCH * np.array([len(x) for x in a]))
                good = np.flatnonzero(share >= LEAST)
                first = np.array([tile[k] * width[kind[k]] for k in at], np.int64)[good]
                yield pa.RecordBatch.from_arrays([pa.array([doc[at[k]] for k in good], pa.int64()), pa.array([item[at[k]] for k in good], pa.int64()), pa.array(share[good]), pa.array(first + start[good]), pa.array(first + stop[good])], names=["doc_id", "item_id", "similarity", "start", "stop"])

    found = both.mapInArrow(aligned, "doc_id long, item_id long, similarity double, start long, stop long")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("before"), "stop")).alias("m"))
    return best.select("doc_id", "item_id", "m.similarity", (-F.col("m.before")).alias("start"), "m.stop")


def can_match(words: list[np.ndarray], own: list[np.ndarray]) -> np.ndarray:
    """Whether each stretch has enough of its item's words, and of its seeds, for the least score: equal words alone add to a score, MATCH for each of the item's."""
    n = np.array([len(x) for x in own])
    enough = np.ones(len(own), bool)
    for parts, held, least in ((lambda x: [x], lambda x: [x], LEAST * n), (lambda x: [item_seeds(x)], lambda x: [pairs_of(x, 1), pairs_of(x, 2)], np.where(n < SEED, 0, seeds_in_common(n)))):
        k = np.flatnonzero(enough)
        if not len(k):
            break
        ours, theirs = ([[p for p in f(x[j])] for j in k] for f, x in ((parts, own), (held, words)))
        # One sorted list for all pairs: the number of the pair parts equal words of different ones.
        keys = []
        for side in (ours, theirs):
            flat = np.concatenate([p for ps in side for p in ps])
            pair = np.repeat(np.arange(len(k)), [sum(map(len, ps)) for ps in side])
            with np.errstate(over="ignore"):
                keys.append((mixed(flat + pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), pair))
        both = np.isin(keys[0][0], keys[1][0])
        enough[k] = np.bincount(keys[0][1], both, len(k)) >= least[k]
    return enough


def _alike(sizes: list[int], cells: int = 4_000_000) -> Iterator[list[int]]:
    """Pairs in groups of similar size that take about `cells` cells in all."""
    group, used = [], 0
    for k in np.argsort(sizes, kind="stable").tolist():
        if not sizes[k]:
            continue
        if group and used + sizes[k] > cells:
            yield group
            group, used = [], 0
        group.append(k)
        used += sizes[k]
    if group:
        yield group


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that have a match, each row by itself, whatever its doc_id. Other columns stay, whatever their names; an empty table stays empty."""
    row, bad = free_name(docs, "row"), free_name(docs, "bad")
    with Intermediates(docs.sparkSession) as made:
        rows = made.kept(saved(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"))
        found = made.kept(saved(matches(rows, benchmark, id_col=row).select(F.col("doc_id").alias(bad)).distinct(), "leaks"))
    return rows.join(broadcast_if_small(found, 1_000_000), F.col(row) == F.col(bad), "left_anti").drop(row)
