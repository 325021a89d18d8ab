"""What the operators share: tables, shared folders, Arrow maps, folds and word hashes."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Rows of one Arrow batch; texts are a few KB, so a batch stays at a few MB.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches and lets local Python workers import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared folder (spark.checkpoint.dir).

    Only where that setting is absent and Spark runs on this machine alone, as in
    tests, a temporary folder is set; on a cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="waymark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Tables of one job in the shared folder, by name; a new one replaces its namesake."""

    def __init__(self, spark: SparkSession, job: str) -> None:
        self.spark, self.job = spark, job
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """Writes `df` and reads it back: cuts lineage, computes once."""
        path = shared_dir(self.spark, f"{self.job}-{name}")
        release(self.spark)
        df.write.option("compression", compression).parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        for name in names:
            if name in self.paths:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back."""
    return Scratch(df.sparkSession, name).write(df, "table")


#: Bits of the filters below: 16 MB in a broadcast, whatever the corpus.
FILTER_BITS = 1 << 27


def bitmap(hashes: DataFrame, column: str, size: int = FILTER_BITS) -> np.ndarray:
    """A filter of `size` bits in which the low bits of each value of a long column are set.

    The driver sees size / 32768 rows of 4 KB at most. A false positive costs work only.
    """
    bit = F.col(column).bitwiseAND(F.lit(size - 1)) + 1
    parts = (
        hashes.select(bit.alias("x"))
        .groupBy(F.call_function("bitmap_bucket_number", F.col("x")).alias("b"))
        .agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col("x"))).alias("v"))
    )
    out = np.zeros(size // 8, np.uint8)
    for r in parts.collect():
        own = np.frombuffer(r.v, np.uint8)[: len(out) - (r.b - 1) * 4096]
        out[(r.b - 1) * 4096 : (r.b - 1) * 4096 + len(own)] = own
    return out


def has_bits(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h.astype(np.uint64) & np.uint64(len(bits) * 8 - 1)
    return ((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % F.lit(n)


def arrow_columns(
    df: DataFrame,
    compute: Callable[[pa.RecordBatch], list[pa.Array]],
    fields: list[StructField],
    keep: list[str] | None = None,
) -> DataFrame:
    """`df` (or its columns `keep`) with the columns that `compute` makes of each batch."""
    keep = df.columns if keep is None else keep
    names = [*keep, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *compute(batch)], names=names)

    return df.mapInArrow(run, StructType([*(df.schema[c] for c in keep), *fields]))


def as_bytes(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of items whose sizes add up to `most` at most, or of one larger item."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept for the short words seen of late."""

    LIMIT, LONGEST = 400_000, 64

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: Bytes to word bytes: A-Z lower-cased, digits, a-z and non-ASCII kept, all else a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def plain_words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    return text.translate(WORD_BYTES).split() if text else []


#: White space of the contracts: [\x20\x09-\x0D], as bytes.split() has it.
GAPS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LETTERS = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes that are hashed at once; longer words than LONG_WORD are hashed one by one.
PIECE, LONG_WORD = 1 << 17, 256
POWERS, INVERSES = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(PIECE, x))]) for x in (BASE, INVERSE))


class Words:
    """The words of texts (bytes) between white space, hashed in bulk.

    `hashes`, `starts`, `ends` (offsets in `raw`, the texts joined by newlines) of all
    words; text i has those from `bounds[i]` to `bounds[i + 1]`. A word's hash does not
    depend on what surrounds it: a sum of its bytes' random values times powers of BASE,
    taken from running sums, and its length.
    """

    def __init__(self, texts: list[bytes], lower: bool = False) -> None:
        raw = b"\n".join(texts)
        self.raw = raw = raw.lower() if lower else raw
        view = np.frombuffer(raw, np.uint8)
        edges = np.flatnonzero(np.diff(GAPS[view].view(np.int8), prepend=np.int8(1), append=np.int8(1)))
        self.starts, self.ends = starts, ends = edges[::2], edges[1::2]
        first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
        self.bounds = np.searchsorted(starts, first)
        h = np.zeros(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            lo = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, lo + PIECE, "right")))
            hi = int(ends[j - 1])
            if hi - lo <= PIECE:
                sums = np.zeros(hi - lo + 1, np.uint64)
                np.cumsum(LETTERS[view[lo:hi]] * POWERS[: hi - lo], out=sums[1:])
                a, b = starts[i:j] - lo, ends[i:j] - lo
                h[i:j] = (sums[b] - sums[a]) * INVERSES[a]
            i = j
        self.lengths = ends - starts
        self.hashes = mix(h + self.lengths.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        for i in np.flatnonzero(self.lengths > LONG_WORD):
            self.hashes[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]])

    def text(self, a: int, b: int) -> bytes:
        """Words a to b (exclusive) of the joined texts, with what stands between them."""
        return self.raw[self.starts[a] : self.ends[b - 1]]
