"""What the operators share: the shared folder, word hashing, batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Entries of a per-process cache before it is emptied; the results don't depend on it.
CACHE_ENTRIES = 500_000
WORD_ENTRIES = 250_000


class Intermediates:
    """Folders and broadcasts made between its start and its end; the end deletes and destroys those that aren't kept. What is kept is left to the ones around it, if any.

    Only for steps whose result is written within: a frame that reads a folder of it later finds nothing.
    """

    _open: list[Intermediates] = []

    def __init__(self, spark: SparkSession, keep: tuple[str, ...] = ("token-files",)):
        self.spark, self.keep = spark, [f"/weftline-{name}-" for name in keep]
        self.paths: list[str] = []
        self.broadcasts: list = []

    def __enter__(self) -> Intermediates:
        Intermediates._open.append(self)
        return self

    def kept(self, df: DataFrame) -> DataFrame:
        """df, of saved(), stays."""
        self.keep.append(df.written_to)
        return df

    def __exit__(self, *error) -> None:
        Intermediates._open.remove(self)
        for x in self.broadcasts:
            x.destroy()
        for path in self.paths:
            if not any(k in path for k in self.keep):
                _delete(self.spark, path)
            else:
                for scope in Intermediates._open[-1:]:
                    scope.paths.append(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def broadcast_value(spark: SparkSession, value):
    """A broadcast that the Intermediates around it, if any, destroy."""
    out = spark.sparkContext.broadcast(value)
    for scope in Intermediates._open[-1:]:
        scope.broadcasts.append(out)
    return out


_own_base: dict[str, str] = {}


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    # A running session can't be given the setting: the folder is remembered here.
    return _own_base.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="weftline-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a temporary one only where that is unset and all runs on this machine."""
    path = f"{_base(spark).rstrip('/')}/weftline-{name}-{uuid.uuid4().hex}"
    for scope in Intermediates._open[-1:]:
        scope.paths.append(path)
    return path


def saved(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*written: DataFrame) -> None:
    """Deletes the files of saved() frames that nothing reads any more."""
    for df in written:
        _delete(df.sparkSession, df.written_to)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores as it takes to be no column of df (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null stays null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint when df (a saved table) has at most so many rows; else Spark chooses the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_columns(schema: StructType, more: str) -> StructType:
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_ENTRIES:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = WordHashes()


def word_hashes(text: bytes | None) -> np.ndarray:
    """uint64 hash of each word [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased (bytes.lower and bytes.split do just that)."""
    words = text.lower().split() if text else ()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; order counts."""
    if len(words) < n:
        return words[:0]
    out = words[: len(words) - n + 1]
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k] + np.uint64(k))
    return out


def pieces_of(batches, columns: list[str], size_of: str, most: int, rows: int = 1 << 20) -> Iterator[list[list]]:
    """Column lists of at most `rows` consecutive rows whose size_of column adds up to about `most` bytes, so that memory per step is bounded. At the end a worker, which Spark uses again, gives back what its caches hold."""
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)) for c in columns]
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(size_of))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        ends = np.cumsum(sizes)
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            end = min(at + rows, max(at + 1, int(np.searchsorted(ends, base + most, "right"))))
            yield [c.slice(at, end - at).to_pylist() for c in cols]
            at = end
    _hashes.clear()
    pa.default_memory_pool().release_unused()


def arrow_steps(batches, size_of: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose size_of column adds up to about `most` bytes each; a larger value is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(size_of))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end
    pa.default_memory_pool().release_unused()


#: Bits of one row of a bit map, those of the built-in bitmap functions.
MAP_ROW = 1 << 15


def bitmap_rows(hashes: DataFrame, bits: int) -> DataFrame:
    """bucket, map: a bit map of 2**bits bits over the top bits of the first column (long), in rows of MAP_ROW bits; merged by all tasks."""
    at = F.shiftrightunsigned(F.col(hashes.columns[0]), 64 - bits)
    rows = hashes.select(F.shiftright(at, 15).alias("bucket"), at.bitwiseAND(F.lit(MAP_ROW - 1)).alias("bit"))
    return rows.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map"))


def has_bit(h: Column, bits: int, bitmap: Column) -> Column:
    """Whether the map of h's bucket, null without one, has h's bit."""
    bit = F.shiftrightunsigned(h, 64 - bits).bitwiseAND(F.lit(MAP_ROW - 1))
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1, F.lit(False))


def bitmap_of(hashes: DataFrame, bits: int) -> np.ndarray:
    """The bit map of 2**bits bits as bytes on the driver: its size is fixed."""
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in bitmap_rows(hashes, bits).toLocalIterator():
        at = r.bucket * (MAP_ROW >> 3)
        out[at : at + (MAP_ROW >> 3)] = np.frombuffer(r.map, np.uint8)
    return out


def in_bitmap(hashes: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    at = hashes >> np.uint64(64 - bits)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
