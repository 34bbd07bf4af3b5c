"""Sources and sinks: tables with declared schemas, and traces as JSON events or compact binary files."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.plans import observe

#: Set to a path: traces are written there; set but empty: summaries are shown.
PROFILE_VARIABLE = "RANGELOOM_PROFILE"
MAGIC = b"RLTP"


def serialize(df: DataFrame, path: str) -> None:
    """A typed table to Parquet."""
    df.write.mode("overwrite").parquet(path)


def deserialize(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table with its declared schema."""
    return spark.read.schema(schema).parquet(path)


def write_chrome_trace(segments: DataFrame, path: str) -> None:
    """One JSON event per line; a viewer takes them wrapped in a list."""
    observe.chrome_trace(segments).select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def encode_trace(segments: list[tuple]) -> bytes:
    """(uid, worker, level, name, type, beg_us, end_us) rows: a string table, then rows by begin as varints, begins as differences."""
    strings: dict[str, int] = {}
    body = bytearray()
    last = 0
    for uid, worker, level, name, kind, beg, end in sorted(segments, key=lambda s: (s[5], s[6], s[0])):
        fields = (uid, worker, level, strings.setdefault(name or "", len(strings)), strings.setdefault(kind or "", len(strings)), beg - last, end - beg)
        for x in fields:
            body += _varint(x)
        last = beg
    table = b"".join(_varint(len(s.encode())) + s.encode() for s in strings)
    return MAGIC + struct.pack("<II", len(strings), len(segments)) + table + bytes(body)


def decode_trace(data: bytes) -> Iterator[tuple]:
    if data[:4] != MAGIC:
        raise ValueError("not a trace file")
    n_strings, n = struct.unpack_from("<II", data, 4)
    at = 12

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    strings = []
    for _ in range(n_strings):
        size = varint()
        strings.append(data[at : at + size].decode())
        at += size
    last = 0
    for _ in range(n):
        uid, worker, level, name, kind, delta, size = (varint() for _ in range(7))
        last += delta
        yield uid, worker, level, strings[name], strings[kind], last, last + size


def encoded_traces(segments: DataFrame, by: list[str]) -> DataFrame:
    """One compact binary trace per key, such as the uid of a run: the key's columns and trace."""
    import pandas as pd

    schema = {f.name: f.dataType.simpleString() for f in segments.schema}

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [tuple(r) for r in pdf[["uid", "worker", "level", "name", "type", "beg_us", "end_us"]].itertuples(index=False)]
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in by}, "trace": [encode_trace(rows)]})

    return segments.groupBy(*by).applyInPandas(encode, ", ".join(f"{k} {schema[k]}" for k in by) + ", trace binary")


def decoded_traces(traces: DataFrame) -> DataFrame:
    """The segments of a column trace; `spark.read.format("binaryFile")` gives one as content."""

    def decode(batches):
        for batch in batches:
            rows = [r for t in batch["trace"].to_pylist() for r in decode_trace(t)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["uid", "worker", "level", "name", "type", "beg_us", "end_us"])

    return traces.select("trace").mapInArrow(decode, observe.SEGMENT)


def profile(segments: DataFrame) -> None:
    """Write or show the trace as the environment says."""
    target = os.environ.get(PROFILE_VARIABLE)
    if target:
        write_chrome_trace(segments, target)
    elif target is not None:
        for name, table in observe.summary(segments).items():
            print(name)
            table.show()
