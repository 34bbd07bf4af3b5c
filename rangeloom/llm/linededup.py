"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

State, all of it in the shared folder: postings (key, doc_id), one per line key of a document; refs
(key, n, lo, hi), the exact reference count of each key with the smallest and
largest document that hold it; and one cuckoo filter per shard. An insertion counts its keys, so that a
line of every document is one row, and streams them through their shard's filter: keys the filter has not
seen are new and skip the exact table; the others are looked up in it. A deletion recounts only the keys of the deleted
documents and takes keys without references out of the filters, so it undoes the insertion.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, number_of, numbered, saved, small_batches, tidy, without

SPACE = b" \t\n\x0b\x0c\r"
#: A null doc_id stands for one document after all others.
NO_ID = (1 << 63) - 1


class CuckooFilter:
    """Cuckoo filters of 16-bit fingerprints, four to a bucket, each twice the size of the one before it; a new one begins when the last is full.

    Keys that look alike in a table (a fingerprint and its buckets) look alike in all smaller ones. A key goes into the first table that
    holds one like it, and only without such a table into the last; so what one key takes out again, from the first table
    too, is never the only entry of another. Where that table has no room, the key is kept whole, in `extra`.
    """

    KICKS = 200

    def __init__(self, buckets: int = 1 << 10):
        self.tables = [array("H", bytes(8 * buckets))]
        self.counts = [0]
        self.extra: list[int] = []

    @staticmethod
    def _mark(h: int) -> int:
        return (h >> 48) or 1

    @staticmethod
    def _other(at: int, mark: int, mask: int) -> int:
        return at ^ (mark * 0x5BD1E995 & mask)

    def holder(self, h: int) -> int:
        """The first table with an entry like the key's, -1 for none."""
        mark = self._mark(h)
        for i, table in enumerate(self.tables):
            mask = len(table) // 4 - 1
            at = h & mask
            if mark in table[4 * at : 4 * at + 4]:
                return i
            at = self._other(at, mark, mask)
            if mark in table[4 * at : 4 * at + 4]:
                return i
        return -1

    def __contains__(self, h: int) -> bool:
        return self.holder(h) >= 0 or (bool(self.extra) and h in self.extra)

    def add(self, h: int) -> None:
        self.put(h, self.holder(h))

    def put(self, h: int, holder: int) -> None:
        """Add a key whose holder is known."""
        if holder >= 0:
            if not self._place(h, holder):
                self.extra.append(h)
            return
        if self.counts[-1] >= len(self.tables[-1]) * 9 // 10 or not self._place(h, len(self.tables) - 1):
            self.tables.append(array("H", bytes(4 * len(self.tables[-1]))))
            self.counts.append(0)
            self._place(h, len(self.tables) - 1)

    def _place(self, h: int, i: int) -> bool:
        """Put the fingerprint into table i, moving others out of its way; whether that worked."""
        table, mark = self.tables[i], self._mark(h)
        mask = len(table) // 4 - 1
        at, moved = h & mask, []
        for kick in range(self.KICKS):
            for place in (at, self._other(at, mark, mask)):
                for slot in range(4 * place, 4 * place + 4):
                    if not table[slot]:
                        table[slot] = mark
                        self.counts[i] += 1
                        return True
            slot = 4 * self._other(at, mark, mask) + (mark + kick) % 4
            moved.append(slot)
            mark, table[slot] = table[slot], mark
            at = slot // 4
        for slot in reversed(moved):  # full: put back what was moved
            mark, table[slot] = table[slot], mark
        return False

    def discard(self, h: int) -> bool:
        """Take out one entry; h must have been added."""
        if h in self.extra:
            self.extra.remove(h)
            return True
        i, mark = self.holder(h), self._mark(h)
        if i < 0:
            return False
        table = self.tables[i]
        mask = len(table) // 4 - 1
        for at in (h & mask, self._other(h & mask, mark, mask)):
            for slot in range(4 * at, 4 * at + 4):
                if table[slot] == mark:
                    table[slot] = 0
                    self.counts[i] -= 1
                    return True
        return False

    def __len__(self) -> int:
        return sum(self.counts) + len(self.extra)

    def to_bytes(self) -> bytes:
        head = np.array([len(self.tables), len(self.extra), *(len(t) for t in self.tables), *self.counts], "<i8")
        return head.tobytes() + np.array(self.extra, "<u8").tobytes() + b"".join(np.frombuffer(t, np.uint16).astype("<u2").tobytes() for t in self.tables)

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        n, m = np.frombuffer(data, "<i8", 2).tolist()
        sizes = np.frombuffer(data, "<i8", 2 * n, 16).tolist()
        out, at = cls.__new__(cls), 16 + 16 * n + 8 * m
        out.tables, out.counts, out.extra = [], sizes[n:], np.frombuffer(data, "<u8", m, 16 + 16 * n).tolist()
        for size in sizes[:n]:
            out.tables.append(array("H", np.frombuffer(data, "<u2", size, at).astype(np.uint16).tobytes()))
            at += 2 * size
        return out


def line_key(line: bytes, shortest: int) -> bytes | None:
    """The 16-byte key of a line, stripped and in lower case; None if it has under `shortest` code points."""
    line = line.strip(SPACE)
    if len(line) < shortest or (len(line) < 4 * shortest and len(line.decode()) < shortest):
        return None
    return hashlib.blake2b(line.lower(), digest_size=16).digest()


def _texts(batches, text_at: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for whole in batches:
        for batch in chunks(whole, text_at):
            yield batch, [t or b"" for t in batch.column(text_at).cast(pa.large_binary()).to_pylist()]


def _postings(shortest: int):
    def run(batches):
        for batch, texts in _texts(batches, 1):
            keys, docs = [], []
            for doc, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                found = {k for line in text.split(b"\n") if (k := line_key(line, shortest))}
                keys += sorted(found)
                docs += [NO_ID if doc is None else doc] * len(found)
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "doc_id": pa.array(docs, pa.int64())})

    return run




def _by_shard(batches) -> Iterator[tuple[int, bytes | None, list[tuple]]]:
    """Rows sorted by shard, the filter first, piece by piece: (shard, its filter, key rows); the last piece of a shard has no rows."""
    shard, state = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        shards, first = columns[0], 0
        while first < batch.num_rows:
            if shards[first] != shard:
                if shard is not None:
                    yield shard, state, []
                shard, state = shards[first], None
            last = bisect_right(shards, shard, first)
            if columns[1][first] is not None:
                state, first = columns[1][first], first + 1
            if first < last:
                yield shard, state, list(zip(*(c[first:last] for c in columns[2:]), strict=True))
            first = last
    if shard is not None:
        yield shard, state, []


COUNTED_COLUMNS = "shard int, filter binary, key binary, n long, lo long, hi long, known boolean"
_COUNTED = pa.schema([("shard", pa.int32()), ("filter", pa.binary()), ("key", pa.binary()), ("n", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("known", pa.bool_())])


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _COUNTED, strict=True)], schema=_COUNTED)


def _change(add: bool):
    """Each shard's filter with the keys put in or taken out. A key put in comes back with known: the filter held one like it, so the exact table may have it."""

    def run(batches):
        kept = None
        for shard, state, rows in _by_shard(batches):
            if kept is None:
                kept = CuckooFilter.from_bytes(state) if state else CuckooFilter()
            hashes = [int.from_bytes(r[0][:8], "little") for r in rows]
            if not rows:
                yield _emit([(shard, kept.to_bytes(), None, None, None, None, None)])
                kept = None
            elif add:
                out = []
                for row, h in zip(rows, hashes, strict=True):
                    holder = kept.holder(h)
                    known = holder >= 0 or h in kept
                    if not known or row[1] == 0:  # rows of no count are put in whatever is there
                        kept.put(h, holder)
                    out.append((shard, None, *row, known))
                yield _emit(out)
            else:
                for h in hashes:
                    kept.discard(h)

    return run


def _drop(shortest: int):
    def run(batches):
        for batch, texts in _texts(batches, 0):
            out, n_lines, n_dropped = [], [], []
            for text, keys in zip(texts, batch.column(1).to_pylist(), strict=True):
                lines = text.split(b"\n")
                n_lines.append(len(lines))
                if keys:
                    keys = set(keys)
                    lines = [x for x in lines if line_key(x, shortest) not in keys]
                    text = b"\n".join(lines)
                out.append(text)
                n_dropped.append(n_lines[-1] - len(lines))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, pa.binary()).cast(pa.string()), *batch.columns[2:], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=["text", *batch.schema.names[2:], *COUNTS]
            )

    return run


#: Columns of what was done to a document.
COUNTS = ["_n_lines", "_n_dropped"]


class LineIndex:
    """The state of the lines of the documents inserted so far. Lines with keys of at least `shortest` code points count.

    Shards: about one for each `ROWS` keys, as a shard's filter is in one task's memory; an insertion that brings more
    than twice as many lays the filters out anew, from the exact table. Keys stream past the filters, each once.
    """

    ROWS = 500_000

    def __init__(self, spark: SparkSession, shortest: int = 10, shards: int | None = None):
        small_batches(spark)
        self.spark, self.shortest, self.shards = spark, shortest, shards
        self.postings = spark.createDataFrame([], "key binary, doc_id long")
        self.refs = spark.createDataFrame([], "key binary, n long, lo long, hi long")
        self.filters = spark.createDataFrame([], "shard int, filter binary")
        self.keys = 0

    def _sharded(self, keys: DataFrame, add: bool, filters: DataFrame) -> DataFrame:
        """The keys' shards with new filters, and the keys put in. keys: key, n, lo, hi."""
        last = F.conv(F.hex(F.substring("key", 9, 4)), 16, 10).cast("long")
        parts = keys.select(F.pmod(last, F.lit(self.shards)).cast("int").alias("shard"), F.lit(None).cast("binary").alias("filter"), "key", "n", "lo", "hi")
        held = filters.select("shard", "filter", *(F.lit(None).cast(t).alias(c) for c, t in (("key", "binary"), ("n", "long"), ("lo", "long"), ("hi", "long"))))
        rows = parts.unionByName(held).repartition(self.shards, "shard").sortWithinPartitions("shard", F.col("filter").isNull())
        return saved(rows.mapInArrow(tidy(_change(add)), COUNTED_COLUMNS), "shards")

    def _changed(self, keys: DataFrame, add: bool, filters: DataFrame) -> DataFrame:
        """The filters once the keys are put in or taken out."""
        bare = keys.select("key", *(F.lit(0).cast("long").alias(c) for c in ("n", "lo", "hi")))
        return self._sharded(bare, add, filters).where("filter is not null").select("shard", "filter")

    def insert(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> LineIndex:
        """Add documents. A document may be inserted once; rows that repeat an id within the batch are the same document."""
        found = saved(docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(tidy(_postings(self.shortest)), "key binary, doc_id long"), "postings")
        size = found.count()
        empty, self.keys = not self.keys, self.keys + size
        if self.shards is None:
            self.shards = max(8 * self.spark.sparkContext.defaultParallelism, -(-size // self.ROWS))
        elif self.keys > 2 * self.shards * self.ROWS:
            self.shards = -(-self.keys // self.ROWS)
            self.filters = self._changed(self.refs, True, self.filters.limit(0))
        # One row a key: combined before the shuffle, so a line of every document is a row of each task.
        counted = found.groupBy("key").agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        counted = self._sharded(counted, True, self.filters)
        self.filters = counted.where("filter is not null").select("shard", "filter")
        keys = counted.where("key is not null")
        refs = ["key", "n", "lo", "hi"]
        claimed = keys.where("known").select(*refs)
        missing = claimed if empty else claimed.join(self.refs, "key", "left_anti")
        missing = saved(missing.select("key"), "missing")
        if not missing.isEmpty():  # these only looked like others
            self.filters = self._changed(missing, True, self.filters)
        if empty:
            self.refs = keys.select(*refs)
        else:
            both = self.refs.unionByName(keys.select(*refs)).groupBy("key").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            self.refs = self.refs.unionByName(keys.select(*refs)) if claimed.isEmpty() else saved(both, "refs")
        self.postings = self.postings.unionByName(found)
        return self

    def delete(self, ids: DataFrame, doc_id: str = "doc_id") -> LineIndex:
        """Take documents out again: counts, first holders and filters are then as if they had never been inserted."""
        ids = ids.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id")).distinct()
        touched = saved(self.postings.join(ids, "doc_id", "left_semi").select("key").distinct(), "touched")
        self.postings = saved(self.postings.join(ids, "doc_id", "left_anti").select("key", "doc_id"), "postings")
        again = saved(
            self.postings.join(touched, "key", "left_semi").groupBy("key").agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")), "recount"
        )
        self.refs = saved(self.refs.join(touched, "key", "left_anti").select("key", "n", "lo", "hi").unionByName(again), "refs")
        self.filters = self._changed(touched.join(again, "key", "left_anti"), False, self.filters)
        return self

    def apply(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counts: bool = True) -> DataFrame:
        """The documents without the lines whose keys a smaller document holds too; other columns stay. With `counts` also
        _n_lines and _n_dropped, for which columns of these names give way. A null text is returned as an empty one.

        A hot line's postings are many rows of one key: both sides of the first join are read from tables, so the skew join can split it.
        """
        repeated = self.refs.where("lo < hi").select("key", "lo")
        pairs = self.postings.join(repeated, "key").where("doc_id > lo").select("doc_id", "key")
        drops = pairs.groupBy(F.col("doc_id").alias("held")).agg(F.collect_set("key").alias("drop"))
        rows, body = numbered(docs), number_of(docs, text)
        others = [c for c in rows.columns if c != body]
        joined = rows.join(drops, F.coalesce(F.col(number_of(docs, doc_id)).cast("long"), F.lit(NO_ID)) == F.col("held"), "left")
        of = dict(rows.dtypes)
        columns = ", ".join(["text string", *(f"{c} {of[c]}" for c in others), *(f"{c} long" for c in COUNTS)])
        out = joined.select(body, "drop", *others).mapInArrow(tidy(_drop(self.shortest)), columns).withColumnRenamed("text", body)
        if not counts:
            return out.select(*rows.columns).toDF(*docs.columns)
        return out.select(*(F.col(number_of(docs, c)).alias(c) for c in without(docs.columns, COUNTS)), *COUNTS)


def dedup_lines(docs: DataFrame, shortest: int = 10, counts: bool = True) -> DataFrame:
    """Documents whose repeated lines stay only in the smallest doc_id that holds them. A null or empty text is one empty line; all texts stay rows."""
    return LineIndex(docs.sparkSession, shortest).insert(docs).apply(docs, counts=counts)


def line_report(docs: DataFrame) -> DataFrame:
    """Per document: n_lines before dropping, n_dropped, kept_sha256 of the rest."""
    kept = dedup_lines(docs.select("doc_id", "text"))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
