"""Near-duplicate groups: MinHash LSH forest, links confirmed on full shingle sets, connected components."""

from __future__ import annotations

import struct
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Intermediates, bitmap_of, broadcast_if_small, discard, free_name, in_bitmap, mixed, ngram_hashes, pieces_of, saved, word_hashes

#: Sorted orders of the forest; MinHash values of a base region; further ones that decide the order within it.
#: At a similarity of 0.8 all orders miss a pair with a chance of (1 - 0.8**5)**40 = 1e-7 in base regions, and of
#: (1 - 0.8**9)**40 = 0.003 if all its regions are so crowded that they're taken at the full depth.
TREES, DEPTH, LANES = 40, 5, 4
#: Rows up to which a region isn't deepened. One that stays larger at the full depth is compared in blocks of so many rows, whole.
CROWD = 2048
#: Standard errors of the estimated similarity below the one asked for at which a pair isn't confirmed any more (a chance of 3e-7).
ERRORS = 5
#: Bits of the filter over texts whose sets are needed; a full one lets more sets pass, but no result changes.
FILTER_BITS = 26
#: Bits of a text's map of its shingles, 2 to this power.
MAP_BITS = 12
STEP = 1_000_000
#: Digests a task remembers, so as to pass on each set once; when full it starts anew.
KNOWN = 200_000
#: Rows up to which the rows to drop are broadcast.
BROADCAST_ROWS = 200_000

_MULTIPLIERS = mixed(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles; of the whole text where it has fewer words; none without words."""
    words = word_hashes((text or "").encode("utf-8", "replace"))
    return np.unique(ngram_hashes(words, min(width, len(words)))) if len(words) else words


def signature(own: np.ndarray) -> np.ndarray:
    """The least product of a shingle's hash with each multiplier."""
    least = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    own = mixed(own)
    with np.errstate(over="ignore"):
        for k in range(0, len(own), 512):
            least = np.minimum(least, (own[k : k + 512] * _MULTIPLIERS[:, None]).min(axis=1))
    return least


def forest_keys(signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text and order: the region, a hash of the order's DEPTH values, and the place in it: 16 bits of each of the LANES next values."""
    per = signatures.reshape(len(signatures), TREES, DEPTH)
    region = np.broadcast_to(np.arange(TREES, dtype=np.uint64), per.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(DEPTH):
            region = mixed(region * np.uint64(0x9E3779B97F4A7C15) + per[:, :, k])
    place = np.zeros_like(region)
    after = mixed(np.roll(per, -1, axis=1)) >> np.uint64(48)
    for k in range(LANES):
        place = place << np.uint64(16) | after[:, :, k]
    return region, place


def shingle_map(own: np.ndarray) -> bytes:
    bits = np.zeros(1 << MAP_BITS, bool)
    bits[own >> np.uint64(64 - MAP_BITS)] = True
    return np.packbits(bits).tobytes()


def most_common(na, nb, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shingles that sets of na and nb with maps a (one) and b (rows) can have in common at most: a bit that only one map has stands for a shingle that only that set has."""
    return np.minimum(na - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), nb - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))


def _digests(sets: list[np.ndarray]) -> list[tuple[int, int] | None]:
    """128 bits of each set as two signed numbers; None for an empty one."""
    return [struct.unpack(">qq", xxhash.xxh3_128_digest(s.tobytes())) if len(s) else None for s in sets]


def _first_seen(digests: list, known: set) -> list[int]:
    """Where a digest stands that the task doesn't remember."""
    new = []
    for k, d in enumerate(digests):
        if d is not None and d not in known:
            if len(known) > KNOWN:
                known.clear()
            known.add(d)
            new.append(k)
    return new


def _halves(digests: list) -> list[pa.Array]:
    return [pa.array([d and d[x] for d in digests], pa.int64()) for x in (0, 1)]


def texts_by_set(docs: DataFrame, width: int, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    """Written rows row (row_col's number; null without), doc_id, n, hi and lo (128 bits of a digest of the set; null for an empty one), and where a task sees a digest first, its regions and places, a byte of each MinHash value, and a bit map of the set."""
    row = F.col(row_col) if row_col else F.lit(None)
    rows = docs.select(row.cast("long").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def found(batches):
        known: set[tuple[int, int]] = set()
        for numbers, ids, texts in pieces_of(batches, ["row", "doc_id", "text"], "text", STEP):
            sets = [shingles(t, width) for t in texts]
            digests = _digests(sets)
            new = _first_seen(digests, known)
            signatures = np.stack([signature(sets[k]) for k in new]) if new else np.zeros((0, len(_MULTIPLIERS)), np.uint64)
            signs = [x.tobytes() for x in (mixed(signatures) >> np.uint64(56)).astype(np.uint8)]
            first = dict(zip(new, zip(*(x.view(np.int64) for x in forest_keys(signatures)), signs, [shingle_map(sets[k]) for k in new], strict=True), strict=True))
            lists = [pa.array([first[k][x] if k in first else None for k in range(len(texts))], t) for x, t in enumerate((pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *_halves(digests), *lists], names=["row", "doc_id", "n", "hi", "lo", "region", "place", "signs", "map"])

    return saved(rows.mapInArrow(found, "row long, doc_id long, n long, hi long, lo long, region array<long>, place array<long>, signs binary, map binary"), "texts")


def prefix_lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the first LANES 16-bit values of the places a and b are equal."""
    apart = np.stack([(a ^ b) >> np.uint64(16 * (LANES - 1 - k)) != 0 for k in range(LANES)])
    return LANES - apart.sum(axis=0)


def _neighbours(rows: DataFrame) -> DataFrame:
    """Each text's neighbour with the longest common prefix in any of the sorted orders. Tasks deal by range, so a large region is many tasks' work."""
    ordered = rows.select("region", "place", "text", "n").repartitionByRange("region", "place", "text").sortWithinPartitions("region", "place", "text")

    def paired(batches):
        last = None
        for batch in batches:
            region, text, n, place = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("region", "text", "n", "place"))
            if last is not None:
                region, text, n, place = (np.concatenate([[a], b]) for a, b in zip(last, (region, text, n, place), strict=True))
            if len(region):
                last = region[-1], text[-1], n[-1], place[-1]
            # A pair across two tasks is not lost: it stays for the regions with two components.
            k = np.flatnonzero((region[1:] == region[:-1]) & (text[1:] != text[:-1]))
            common = prefix_lengths(place[k].view(np.uint64), place[k + 1].view(np.uint64))
            both = [np.concatenate([x[k], x[k + 1]]) for x in (text, n)] + [np.concatenate([x[k + 1], x[k]]) for x in (text, n)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, both), pa.array(np.tile(common, 2))], names=["text", "n", "other", "m", "common"])

    pairs = ordered.mapInArrow(paired, "text long, n long, other long, m long, common long")
    best = pairs.groupBy("text", "n").agg(F.max(F.struct("common", "other", "m")).alias("at"))
    return _ordered(best.select("text", "n", F.col("at.other").alias("other"), F.col("at.m").alias("m")))


def _ordered(pairs: DataFrame) -> DataFrame:
    """a, b, na, nb with a < b of pairs text, n, other, m."""
    low = F.col("text") < F.col("other")
    return pairs.select(F.least("text", "other").alias("a"), F.greatest("text", "other").alias("b"), F.when(low, F.col("n")).otherwise(F.col("m")).alias("na"), F.when(low, F.col("m")).otherwise(F.col("n")).alias("nb"))


def _leaders(crowd: DataFrame) -> DataFrame:
    """Pairs of each text in a region with the text there whose regions are largest in all: the one that edited copies of a text gather around."""
    sizes = crowd.groupBy("region").agg(F.count("*").alias("size"))
    weights = saved(crowd.join(sizes, "region").groupBy("text").agg(F.sum("size").alias("weight")), "weights")
    leaders = crowd.join(weights, "text").groupBy("region").agg(F.max(F.struct("weight", "text", "n")).alias("leader"))
    leaders = saved(leaders.select("region", F.col("leader.text").alias("other"), F.col("leader.n").alias("m")), "leaders")
    return _ordered(crowd.join(leaders, "region").filter("text <> other"))


def _regions(rows: DataFrame) -> DataFrame:
    """Written rows of the regions that hold two components, each region as deep as it takes to have CROWD rows at most, or at the full depth.

    rows: region, place, text, n, comp; size is added. A crowded region is parted by one more value, where the prefixes of its texts part.
    """
    done = []
    for depth in range(LANES + 1):
        sizes = rows.groupBy("region").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size"))
        both = saved(rows.join(saved(sizes.filter("low < high").select("region", "size"), "sizes"), "region"), "regions")
        crowded = both.filter(F.col("size") > CROWD)
        if depth == LANES or crowded.isEmpty():
            done.append(both)
            return reduce(DataFrame.unionAll, done)
        done.append(both.filter(F.col("size") <= CROWD))
        lane = F.shiftrightunsigned("place", 16 * (LANES - 1 - depth)).bitwiseAND(F.lit(0xFFFF))
        rows = crowded.drop("size").withColumn("region", F.xxhash64("region", lane))


def _across(rows: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Pairs of texts of two components that share a region and whose MinHash values and maps don't rule a link out.

    rows: those of _regions; signed: text, signs, map. A region that is larger than CROWD at the full depth is dealt in
    blocks and each pair of blocks compared by itself, so nothing is left out.
    """
    blocks = F.ceil(F.col("size") / CROWD).cast("int")
    dealt = rows.join(signed, "text").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("text"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("region", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "text", "n", "comp", "signs", "map")
    dealt = dealt.repartition("region", "low", "high").sortWithinPartitions("region", "low", "high", "text")
    least = percent / 100 - ERRORS * (percent / 100 * (1 - percent / 100) / len(_MULTIPLIERS)) ** 0.5

    def compared(group):
        block, text, n, comp = (group.column(k).to_numpy() for k in (3, 4, 5, 6))
        apart = group.column(1)[0].as_py() != group.column(2)[0].as_py()
        signs = np.array([np.frombuffer(x.as_buffer(), np.uint8) for x in group.column(7)])
        maps = np.array([np.frombuffer(x.as_buffer(), np.uint64) for x in group.column(8)])
        values, counts = np.unique(comp, return_counts=True)
        minor = comp != values[counts.argmax()]
        for k in np.flatnonzero(minor):
            ok = (comp != comp[k]) & (~minor | (text < text[k])) & (100 * np.minimum(n, n[k]) >= percent * np.maximum(n, n[k]))
            if apart:
                ok &= block != block[k]
            at = np.flatnonzero(ok)
            at = at[(signs[at] == signs[k]).mean(axis=1) >= least]
            common = most_common(n[k], n[at], maps[k], maps[at])
            at = at[100 * common >= percent * (n[k] + n[at] - common)]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(text[at], text[k])), pa.array(np.maximum(text[at], text[k])), pa.array(np.where(text[at] < text[k], n[at], n[k])), pa.array(np.where(text[at] < text[k], n[k], n[at]))], names=["a", "b", "na", "nb"])

    def streamed(batches):
        rest: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in (0, 1, 2)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if rest and tuple(keys[:, a]) != key:
                    yield from compared(pa.Table.from_batches(rest).combine_chunks())
                    rest = []
                key = tuple(keys[:, a])
                rest.append(batch.slice(a, b - a))
        if rest:
            yield from compared(pa.Table.from_batches(rest).combine_chunks())

    return dealt.mapInArrow(streamed, "a long, b long, na long, nb long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b with 100 * common >= percent * all shingles."""
    able = pairs.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b").distinct()
    one, two = (sets.select(F.col("text").alias(x), F.col("own").alias(f"own_{x}")) for x in "ab")

    def checked(batches):
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                if 100 * common >= percent * (len(x) + len(y) - common):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], names=["a", "b"])

    return able.join(one, "a").join(two, "b").select("a", "b", "own_a", "own_b").mapInArrow(checked, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, comp for all nodes of links (a, b): comp is the least node reachable.

    Each round takes the least label among neighbours and then the label of the label, so that the
    rounds grow with the logarithm of a chain's length; labels are written after each round.
    """
    both = saved(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("comp").alias("before"), F.least("comp", "c").alias("comp"))
        lower = saved(lower, "lower")
        jump = lower.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        after = saved(lower.join(jump, "comp").select("node", "before", F.least("comp", "next").alias("comp")), "labels")
        discard(lower, labels)
        if after.filter("before <> comp").isEmpty():
            discard(both)
            return after.select("node", "comp")
        labels = after.select("node", "comp")
        labels.written_to = after.written_to


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    Documents are linked when 100 * common shingles >= percent * all their shingles; a shingle is width words in
    a row (ASCII lower case, split at ASCII white space), or a whole text with fewer words. Documents
    without words are linked with nothing. Equal sets (by 128 bits of a digest) are one text from the start.

    Texts are sorted in TREES orders by their MinHash values. First each text is compared with its neighbour of the
    longest common prefix, and with the most central text of each of its regions (texts that share DEPTH values).
    Then, in every region that still holds two components, the texts of different components are compared; a
    region of more than CROWD texts is deepened, value by value, until it is no larger, and compared in blocks
    where even the full depth doesn't part it. Candidates are left out only if MinHash values or maps of
    shingles rule a link out. Every other one is confirmed on its full sets (of 64-bit hashes).

    Null ids: such documents are linked and grouped, but have no smallest id; component_id is null and kept true
    where a whole component has none. Rows that repeat an id share its fate. Other columns are left out; an
    empty table gives no rows.
    """
    out = _grouped(docs, width, percent, id_col, text_col)
    component = F.when(F.col("hi").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _grouped(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    """One row a document: row, doc_id, n, hi and lo (null without words), comp (a text for each group) and component_id."""
    every = texts_by_set(docs, width, id_col, text_col, row_col)
    # A text's number names it from here on: of two digests of 128 bits none is alike by chance.
    texts = saved(every.filter("region is not null").dropDuplicates(["hi", "lo"]).drop("row", "doc_id").withColumn("text", F.monotonically_increasing_id()), "texts")
    forest = texts.select("text", "n", F.explode(F.arrays_zip("region", "place")).alias("k")).select("text", "n", "k.region", "k.place")
    shared = forest.groupBy("region").agg(F.min("text").alias("low"), F.max("text").alias("high")).filter("low < high").select("region")
    crowd = saved(forest.join(shared, "region"), "crowd")
    wanted = saved(texts.select("text", "hi", "lo").join(crowd.select("text").distinct(), "text"), "wanted")
    needed = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted.select("hi"), FILTER_BITS))

    def kept(batches):
        known: set[tuple[int, int]] = set()
        for (texts,) in pieces_of(batches, ["text"], "text", STEP):
            sets = [s for s in (shingles(t, width) for t in texts) if len(s)]
            digests = _digests(sets)
            ok = in_bitmap(np.array([d[0] for d in digests], np.int64).view(np.uint64), needed.value, FILTER_BITS)
            new = _first_seen([d if x else None for d, x in zip(digests, ok, strict=True)], known)
            yield pa.RecordBatch.from_arrays([*_halves([digests[k] for k in new]), pa.array([sets[k].tobytes() for k in new], pa.binary())], names=["hi", "lo", "own"])

    sets = docs.select(F.col(text_col).alias("text")).mapInArrow(kept, "hi long, lo long, own binary").dropDuplicates(["hi", "lo"])
    sets = saved(sets.join(wanted, ["hi", "lo"]).select("text", "own"), "sets")
    needed.destroy()
    pairs = _neighbours(crowd).unionAll(_leaders(crowd))
    links = saved(_confirmed(pairs, sets, percent), "links")
    first = components(links)
    known = crowd.join(first, F.col("text") == F.col("node"), "left").select("region", "place", "text", "n", F.coalesce("comp", "text").alias("comp"))
    more = saved(_confirmed(_across(_regions(known), texts.select("text", "signs", "map"), percent), sets, percent), "links")
    groups = first if more.isEmpty() else components(links.unionAll(more))
    discard(sets, crowd, wanted)
    groups = texts.select("text", "hi", "lo").join(groups, F.col("text") == F.col("node"), "left").select("hi", "lo", F.coalesce("comp", "text").alias("comp"))
    least = every.filter("hi is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("least")).join(groups, ["hi", "lo"])
    least = saved(least, "least")
    # Written before it is joined, so that Spark can split a large group.
    smallest = saved(least.groupBy("comp").agg(F.min("least").alias("component_id")), "smallest")
    ids = saved(least.join(smallest, "comp").select("hi", "lo", "comp", "component_id"), "ids")
    return every.select("row", "doc_id", "n", "hi", "lo").join(ids, ["hi", "lo"], "left")


def without_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group, the first written of those with the smallest id, or of all where none has an id. Rows without words all stay. Other columns stay, whatever their names."""
    row, away = free_name(docs, "row"), free_name(docs, "gone")
    with Intermediates(docs.sparkSession) as made:
        rows = made.kept(saved(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"))
        found = _grouped(rows, width, percent, "doc_id", "text", row).filter("hi is not null")
        found = saved(found.select("row", "comp", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("at")), "grouped")
        stay = saved(found.groupBy("comp").agg(F.min("at").alias("first")), "stay")
        gone = made.kept(saved(found.join(stay, "comp").filter("row <> first.row").select(F.col("row").alias(away)), "gone"))
    return rows.join(broadcast_if_small(gone, BROADCAST_ROWS), F.col(row) == F.col(away), "left_anti").drop(row)


#: near_groups() at two words and 80 percent in SQL, with all pairs that share a shingle; doc_id must not repeat.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
n AS (SELECT w.doc_id AS doc_id, count(s.g) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
t AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS comp FROM n UNION SELECT t.b, r.comp FROM r JOIN t ON t.a = r.node AND r.comp < t.b),
m AS (SELECT node, min(comp) AS component_id FROM r GROUP BY node)
SELECT n.doc_id AS doc_id, n.n AS n_shingles, m.component_id AS component_id, n.doc_id = m.component_id AS kept FROM n JOIN m ON m.node = n.doc_id
"""
