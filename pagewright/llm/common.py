"""Helpers that the training-data operators share: tables, stored stages, words, polynomial hashes."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of Arrow data that an operator works on at a time, about; a longer row is worked on alone.
SLICE = 2 << 20
#: Every fold of the learned operators: rows whose crc32(id as text) modulo this is 0 are held out.
FOLDS = 5

MASK64 = (1 << 64) - 1
#: ASCII bytes that `[^\x20\x09-\x0D]+` words are split at; ``bytes.split()`` splits at exactly these.
BLANKS = " \t\n\r\x0b\x0c"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Lower-cases A-Z and turns every byte outside 0-9, a-z and 0x80-0xFF into a blank.
_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else (b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32)
    for b in range(256)
)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # no glibc
    _trim = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterator[pa.RecordBatch], limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in parts of about ``limit`` bytes, one row at least, whatever the size of the batches that come."""
    for batch in batches:
        n = batch.num_rows
        if batch.nbytes <= limit:
            if n:
                yield batch
            continue
        size = np.zeros(n, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                size += np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1])
            elif pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
                size += np.diff(np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1])
            else:
                size += column.nbytes // n + 1
        part = np.cumsum(size) // limit
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for a, b in zip(cuts, np.r_[cuts[1:], n], strict=True):
            yield batch.slice(int(a), int(b - a))


def release() -> None:
    """Gives unused memory back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The batch function with ``release`` at its end: Python workers outlive their tasks, several beside a busy one."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return tidied


def free_names(frame: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column of ``frame``."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a folder of its own; on a cluster that is an error, as
    a folder of one machine would lose what the others write.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file:///tmp/pagewright-checkpoints"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Paths that a ``scope`` has to clear, innermost last.
_scopes: list[list[tuple[SparkSession, str]]] = []


def _path(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage and survives the loss of executors: nothing is recomputed and no block lives on one
    machine only. All tables of an application lie in one folder named by it, which goes away with the
    driver's JVM; after a driver that was killed that one folder can be removed.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/pagewright-{spark.sparkContext.applicationId}"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, files = _path(spark, folder)
    files.deleteOnExit(where)
    back = spark.read.schema(df.schema).parquet(path)
    back._pagewright_path = path
    if _scopes:
        _scopes[-1].append((spark, path))
    return back


def unstash(*frames: DataFrame) -> None:
    """Drop stored stages that nothing reads any more, so that disk is used by one stage at a time."""
    for df in frames:
        path = getattr(df, "_pagewright_path", None)
        if path:
            where, files = _path(df.sparkSession, path)
            files.delete(where, True)


@contextmanager
def scope(kept: list[DataFrame]) -> Iterator[None]:
    """Drops every table that was stored within, but those that the caller has put into ``kept`` by its end."""
    _scopes.append([])
    try:
        yield
    finally:
        staying = {getattr(df, "_pagewright_path", None) for df in kept}
        for spark, path in _scopes.pop():
            if path not in staying:
                where, files = _path(spark, path)
                files.delete(where, True)


def held_out(doc_id: Column) -> Column:
    """True for ids of the held-out fold; a null id is not held out (and is never learned from)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def plain_words(data: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of A-Z-lower-cased UTF-8 bytes."""
    return data.translate(_LOWER).split()


def alnum_words(data: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of A-Z-lower-cased UTF-8 bytes."""
    return data.translate(_ALNUM).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (xor-shift-multiply), elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PolyHash:
    """Prefix polynomial hashes of one byte buffer modulo two primes of 31 bits, the bases given by a seed.

    ``span(i, n)`` is the hash (62 bits) of the ``n`` bytes that start at ``i``, independent of ``i``; both
    may be arrays. The prefix sums are of ``(byte + 1) * base**position``, so a span is one subtraction and one
    multiplication with the inverse power; all products fit 64 bits. Different strings of n bytes share a
    hash for at most n bases in 2**31 of either prime; what a result depends on is verified against the bytes.
    """

    PRIMES = (2**31 - 1, 2**31 - 19)
    _powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int = 1) -> None:
        self.n = len(data)
        codes = data.astype(np.uint64) + np.uint64(1)
        self.sides = []
        for k, prime in enumerate(self.PRIMES):
            base = int(mix64(np.array([2 * seed + k + 1], np.uint64))[0]) % (prime - 1000) + 500
            power, inverse = self._table(base, prime, self.n + 1)
            prefix = np.zeros(self.n + 1, np.uint64)
            # A term is under 2**39, so sums of 2**25 of them fit; longer buffers carry the rest on.
            step = 1 << 24
            for at in range(0, self.n, step):
                part = prefix[at + 1 : at + 1 + step]
                np.cumsum(codes[at : at + step] * power[at : min(at + step, self.n)], out=part)
                part += prefix[at]
                part %= np.uint64(prime)
            self.sides.append((np.uint64(prime), prefix, inverse))

    @classmethod
    def _table(cls, base: int, prime: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get((base, prime))
        if have is None or len(have[0]) < n:
            size = 1 << max(16, (n - 1).bit_length())
            grown = []
            for factor in (base, pow(base, -1, prime)):
                out, made = np.ones(size, np.uint64), 1
                while made < size:
                    out[made : 2 * made] = out[:made] * np.uint64(pow(factor, made, prime)) % np.uint64(prime)
                    made *= 2
                grown.append(out)
            have = cls._powers[base, prime] = tuple(grown)
        return have

    def span(self, start, n):
        high, low = ((prefix[start + n] + prime - prefix[start]) * inverse[start] % prime for prime, prefix, inverse in self.sides)
        return high << np.uint64(31) | low


def in_bitmap(values: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which 64-bit values have their bit set."""
    at = values.view(np.uint64) & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


#: Bytes of the bitmaps that Spark's bitmap functions make.
_BITMAP = 4096


def merged_bitmap(rows: DataFrame, bits: int) -> np.ndarray:
    """A bitmap with a bit for each 64-bit value of the only column (bigint, or binary: packed values).

    ``bits`` is a power of two. The bitmap is made in parts of 4 KB, grouped by their place with partial
    aggregates in all tasks; one bitmap of that fixed size comes back, whatever the number of rows. A value
    may share a bit, so a hit is a maybe and a miss is certain.
    """
    if len(rows.columns) != 1:
        raise ValueError("a bitmap is made of one column")
    column = rows.columns[0]
    if rows.schema[0].dataType.typeName() == "binary":

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(max(bits >> 3, _BITMAP), np.uint8)
            for batch in batches:
                for values in (np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(0) if x.is_valid):
                    at = np.unique(values & np.uint64(bits - 1))
                    if len(at):
                        byte = (at >> np.uint64(3)).astype(np.int64)
                        first = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
                        out[byte[first]] |= np.bitwise_or.reduceat(np.uint8(1) << (at & np.uint64(7)).astype(np.uint8), first)
            parts = out.reshape(-1, _BITMAP)
            some = np.flatnonzero(parts.any(axis=1))
            for at in range(0, len(some), 256):
                chosen = some[at : at + 256]
                yield pa.RecordBatch.from_arrays([pa.array(chosen + 1, pa.int64()), pa.array([parts[k].tobytes() for k in chosen], pa.binary())], ["place", "part"])

        merged = rows.mapInArrow(tidy(fill), "place bigint, part binary").groupBy("place").agg(F.bitmap_or_agg("part").alias("part"))
    else:
        at = F.col(column).bitwiseAND(F.lit(bits - 1)) + 1
        merged = rows.groupBy(F.bitmap_bucket_number(at).alias("place")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("part"))
    out = np.zeros(max(bits >> 3, _BITMAP), np.uint8)
    for place, part in merged.filter("place is not null").collect():
        out[(place - 1) * _BITMAP : place * _BITMAP] |= np.frombuffer(part, np.uint8)
    return out[: bits >> 3]


def maybe_in(keys: DataFrame):
    """From a bigint column to whether a value may be in ``keys`` (one bigint column), by a broadcast bitmap of 16 MB at most.

    Only the key goes to Python and back; the rest of a row stays in the JVM. A miss is certain, so it tells
    most rows apart without a shuffle.
    """
    bits = 1 << min(27, max(16, (16 * keys.count()).bit_length()))
    bitmap = keys.sparkSession.sparkContext.broadcast(merged_bitmap(keys, bits))

    def hit(x: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(x.to_numpy(np.int64), bitmap.value))

    return F.pandas_udf(hit, "boolean")


def content_key(*columns: Column) -> Column:
    """128 bits of hashes of the columns, nulls told from empty values: what rows are known by across passes."""
    marked = [x for c in columns for x in (c.isNull(), c)]
    return F.struct(F.xxhash64(F.lit(1), *marked).alias("a"), F.xxhash64(F.lit(2), *marked).alias("b"))


def with_key(docs: DataFrame, *columns: str) -> tuple[DataFrame, str]:
    """All columns after a key (see ``content_key``) of the named ones, and the key's name; repeated rows share it."""
    (key,) = free_names(docs, "_pw_key")
    return docs.select(content_key(*(F.col(c) for c in columns)).alias(key), *(F.col(c) for c in docs.columns)), key


def without(keyed: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of ``keyed`` (see ``with_key``) whose key is not in ``keys`` (one column of that name).

    Only rows that the bitmap cannot clear are shuffled, so texts that stay travel nowhere.
    """
    maybe = maybe_in(keys.select(F.col(key)["a"].alias("a")))
    near = keyed.filter(maybe(F.col(key)["a"])).join(keys, key, "left_anti")
    return keyed.filter(~maybe(F.col(key)["a"])).unionByName(near)
