"""What the operators share: tables in the cluster's shared folder, joins that survive hot keys, and words of Arrow text columns."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are turned into arrays at a time; a single longer text is taken whole.
CHUNK_BYTES = 1 << 20


@cache
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="rangeloom-")


#: The setting that bounds Arrow batches, its default, and what batches of whole texts are bounded to.
_BATCH, _DEFAULT, _BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 15 << 18
#: The setting of rows that a Parquet reader decodes at a time, its default, and what it is set to for whole texts.
_ROWS, _DEFAULT_ROWS, _TEXTS = "spark.sql.parquet.columnarReaderBatchSize", 4096, 1024


def small_batches(spark: SparkSession) -> None:
    """Bound the batches of Arrow and of Parquet readers in this session unless it has bounds of its own: thousands of whole texts
    would be held several times over, by the executor and by each Python worker."""
    if int(str(spark.conf.get(_BATCH)).rstrip("b")) == _DEFAULT:
        spark.conf.set(_BATCH, str(_BYTES))
    if int(spark.conf.get(_ROWS)) == _DEFAULT_ROWS:
        spark.conf.set(_ROWS, str(_TEXTS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, local masters (tests) use a temporary folder; a cluster must set it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_folder()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it is removed when the driver ends."""
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder that no later plan reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read from there: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Saved tables that go when they are no longer needed: all at the end of the block, one that takes another's place at once."""

    def __init__(self):
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for df, path in self.paths.values():
            drop_path(df.sparkSession, path)
        self.paths.clear()

    def saved(self, df: DataFrame, name: str, instead: DataFrame | None = None) -> DataFrame:
        """As saved; `instead` is a table of this scratch that df may read, and nothing after it."""
        spark = df.sparkSession
        small_batches(spark)
        path = new_path(spark, name)
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        if instead is not None and (old := self.paths.pop(id(instead), None)):
            drop_path(spark, old[1])
        return out


#: Bits of the bitmaps by which rows are told apart before a join, in words of 64: a bitmap is 2^18 rows at most.
BITMAP = 1 << 24


def marked(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows with maybe: false where the key is surely not in keys (one column); true where it may be.

    A Bloom filter of one hash: its words are a table of bounded size, which is broadcast, so rows that have
    no partner in a join need not be shuffled for it. With many more keys than bits all rows are true, and the join is as without it.
    """
    bit = lambda c: F.xxhash64(c).bitwiseAND(F.lit(BITMAP - 1))
    word, place = F.shiftright("bit", 6), F.col("bit").bitwiseAND(F.lit(63)).cast("int")
    held = keys.select(bit(F.col(keys.columns[0])).alias("bit")).groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias("bits"))
    found = rows.withColumn("bit", bit(key)).withColumn("at", word).join(F.broadcast(held), F.col("at") == F.col("word"), "left")
    maybe = F.coalesce(F.call_function("shiftright", F.col("bits"), place).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return found.select(*rows.columns, maybe.alias("maybe"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1 and so on, so that none clashes with a column that an operator adds; toDF(*df.columns) names them back."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def number_of(df: DataFrame, column: str) -> str:
    """The column's name in numbered(df)."""
    return f"c{[c.lower() for c in df.columns].index(column.lower())}"


def without(columns: list[str], added) -> list[str]:
    """The columns that none of the added ones replaces."""
    gone = {c.lower() for c in added}
    return [c for c in columns if c.lower() not in gone]


def chunks(batch: pa.RecordBatch, column: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about limit bytes of text, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    first = 0
    while first < batch.num_rows:
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(first, last - first)
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits (public domain constants)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def release_memory() -> None:
    """Give freed memory back to the system: Python workers stay for the tasks that follow."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function of Arrow batches, its memory released when a task ends."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return whole


class Text(NamedTuple):
    """The bytes of a text column, null as empty: row i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray


def text_bytes(column: pa.Array) -> Text:
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return Text(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return Text(data, offsets - offsets[0])


#: Bytes with A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that end at white space: all but space and tab to carriage return.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words of letters and digits: 0-9, a-z and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


class Words(NamedTuple):
    """Words of a text column in order: codes index distinct; rows[i] words are of row i; starts and ends are byte positions in the column's data."""

    codes: np.ndarray
    distinct: pa.Array
    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def words_of(text: Text, kept: np.ndarray) -> Words:
    """Maximal runs of kept bytes after A-Z is lower-cased; no run crosses a row's end."""
    data = LOWER[text.data]
    inside = kept[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    bounds = text.offsets[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < len(data))]
    before[bounds], after[bounds - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    rows = np.diff(np.searchsorted(starts, text.offsets))
    return Words(found.indices.to_numpy(), found.dictionary, rows, starts, ends)


class Table(NamedTuple):
    """Open-addressed table of non-negative 64-bit keys."""

    keys: np.ndarray
    at: np.ndarray  # position of the key among those given

    @classmethod
    def of(cls, keys: np.ndarray) -> Table:
        size = 1 << max(4, (2 * len(keys)).bit_length())
        table, into = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        at, pending = cls._slot(keys, size - 1), np.arange(len(keys))
        while len(pending):
            open_ = np.flatnonzero(table[at[pending]] == -1)
            _, one = np.unique(at[pending[open_]], return_index=True)
            put = pending[open_[one]]
            table[at[put]], into[at[put]] = keys[put], put
            pending = np.setdiff1d(pending, put, assume_unique=True)
            at[pending] = (at[pending] + 1) & (size - 1)
        return cls(table, into)

    @staticmethod
    def _slot(keys: np.ndarray, mask: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, -1 where it isn't there."""
        mask = len(self.keys) - 1
        at = self._slot(keys, mask)
        held = self.keys[at]
        out = np.where(held == keys, self.at[at], -1)
        on = np.flatnonzero((held != keys) & (held != -1))
        while len(on):
            at[on] = (at[on] + 1) & mask
            held = self.keys[at[on]]
            hit = held == keys[on]
            out[on[hit]] = self.at[at[on[hit]]]
            on = on[~hit & (held != -1)]
        return out


def passed_through(batch: pa.RecordBatch, extra: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns added at its end."""
    return pa.RecordBatch.from_arrays([*batch.columns, *extra.values()], names=[*batch.schema.names, *extra])


def list_array(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
