"""Shared plumbing of the corpus operators: table access, durable intermediates and
vectorised word handling on Arrow string buffers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes handled at once inside a Python worker; bounds its memory.
CHUNK_BYTES = 750_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one of our own only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "/tmp/checkpoints/lodestone"
    return found.rstrip("/")


def materialize(df: DataFrame, name: str = "part", rows: int | None = None) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: cuts lineage, survives lost
    executors, and lets later jobs prune columns. rows: about how many there are, so that few rows make few
    files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    (df if rows is None else df.coalesce(max(8, rows // FILE_ROWS))).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a materialized frame that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of a file where a table's size is known.
FILE_ROWS = 200_000
#: Bits of a sieve.
SIEVE_BITS = 1 << 25


class Sieve:
    """Which 64-bit hashes may be in a column of `df`: a bitmap of SIEVE_BITS bits whatever the table's size.
    No hash of the column is ever missed; others pass the more often the larger the table is. What it
    keeps out of a shuffle is a saving only: a join must follow."""

    def __init__(self, df: DataFrame, column: str):
        at = F.pmod(F.col(column), F.lit(SIEVE_BITS)) + 1
        rows = df.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
        bits = np.zeros(SIEVE_BITS // 8, np.uint8)
        for r in rows.collect():  # SIEVE_BITS / 32768 rows of 4 KB
            part = np.frombuffer(r["bits"], np.uint8)
            at_ = (r["b"] - 1) * 4096
            bits[at_ : at_ + len(part)] |= part
        self.sent = df.sparkSession.sparkContext.broadcast(bits)

    def test(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(_U) & _U(SIEVE_BITS - 1)
        return (self.sent.value[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1

    def passes(self, column: str):
        """Whether a row's hash may be in the set, as a column."""

        @F.arrow_udf("boolean")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for h in batches:
                yield pa.array(self.test(h.to_numpy(zero_copy_only=False)))

        return run(F.col(column))


def release() -> None:
    """Give memory that this worker has freed back to the system: workers outlive their tasks, and an executor's memory
    counts them all."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library, which has no such call
        pass


def ascii_lower(col):
    """A-Z to a-z, everything else unchanged."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd multiplier of the polynomial word hash and its inverse modulo 2**64.
_R = 0x9E3779B97F4A7C15
_RI = pow(_R, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits (splitmix64)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; tables up to a few chunks' length are kept."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.ones(1 << max(10, n).bit_length(), _U)
        m = 1
        while m < len(have):
            have[m : 2 * m] = have[:m] * _U(pow(base, m, 1 << 64))
            m *= 2
        if len(have) <= 4 * CHUNK_BYTES:
            _POWERS[base] = have
    return have[:n]


class Words:
    """The words of a run of texts as flat arrays: `start`/`end` byte offsets into `buf`, and
    `first[i]:first[i + 1]` the words of text i."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets = buf, offsets
        ink = ~_SPACE[buf]
        prev = np.empty_like(ink)
        prev[:1] = False
        prev[1:] = ink[:-1]
        cut = offsets[:-1][offsets[:-1] < len(buf)]
        prev[cut] = False
        begins = ink & ~prev
        after = np.empty_like(ink)
        after[-1:] = True
        after[:-1] = ~ink[1:] | begins[1:]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ink & after) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.first) - 1

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.buf)
        if not len(self.start):
            return np.zeros(0, _U)
        values = mix(np.arange(1, 257, dtype=_U) + _U((seed * 0x632BE59BD9B4E019) & (2**64 - 1)))
        total = np.zeros(n + 1, _U)
        np.cumsum(values[self.buf] * powers(_R, n), out=total[1:])
        inverse = powers(_RI, n)
        own = (total[self.end] - total[self.start]) * inverse[self.start]
        return mix(own ^ (self.end - self.start).astype(_U))


def rolling(h: np.ndarray, k: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of every k consecutive entries of h (64 bits, position independent)."""
    n = len(h)
    if n < k:
        return np.zeros(0, _U)
    total = np.zeros(n + 1, _U)
    np.cumsum(h * powers(base, n), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(pow(base, -1, 1 << 64), n - k + 1))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and its offsets, starting at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    if not large and not pa.types.is_string(column.type):
        column, large = column.cast(pa.large_string()), True
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text each (one row at least, whole texts)."""
    at = batch.schema.get_field_index(text)
    _, offsets = text_buffer(batch.column(at))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = j


def words_of(column: pa.Array, lower: bool = False) -> Words:
    buf, offsets = text_buffer(column)
    return Words(_LOWER[buf] if lower else buf, offsets)
