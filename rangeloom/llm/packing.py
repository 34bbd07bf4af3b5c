"""Token ids and packing: byte-level BPE ids, best-fit-decreasing packing over a segment tree, packed id matrices.

Documents are encoded and packed in blocks of a bounded number of tokens within each
task, so nothing is shuffled and a lost task is redone from its input split alone.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

#: The pattern of the rank files' pretokens, and the free id that ends a document.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_TEXT = 50256
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Tokens of a block that is packed together.
BLOCK_TOKENS = 1 << 20


#: White space (as the pattern's \\s) in runs that are encoded apart: the pattern's matcher steps back over a run, and its stack ends at about a million.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def encoding_of(ranks: bytes, pattern: str = PATTERN) -> tiktoken.Encoding:
    """Byte-level BPE over the bytes of a rank file."""
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


class Tokenizer:
    """The ids of whole texts, whatever their runs of white space."""

    def __init__(self, ranks: bytes):
        self.ranks, self.words, self.piece = ranks, encoding_of(ranks), None

    def ids(self, text: str) -> np.ndarray:
        """A long run is one pretoken: all of it at the text's end, else all but its last character, which goes with what follows."""
        parts, at = [], 0
        for run in LONG_SPACE.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            self.piece = self.piece or encoding_of(self.ranks, r"[\s\S]+")
            parts += [self._encoded(self.words, text[at : run.start()]), self._encoded(self.piece, text[run.start() : end])]
            at = end
        return np.concatenate([*parts, self._encoded(self.words, text[at:])])

    @staticmethod
    def _encoded(encoding: tiktoken.Encoding, text: str) -> np.ndarray:
        return encoding.encode_to_numpy(text, disallowed_special=()).astype(np.uint16)


class CapacityTree:
    """Segment tree over capacities 0 to size: which of them open bins have, and the smallest that is large enough."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.counts = [0] * (2 * self.leaves)

    def change(self, capacity: int, by: int) -> None:
        at = self.leaves + capacity
        while at:
            self.counts[at] += by
            at >>= 1

    def smallest(self, least: int) -> int | None:
        """The smallest capacity of at least `least` that a bin has."""
        counts, at = self.counts, self.leaves + least
        if counts[at]:
            return least
        while at > 1 and not (at % 2 == 0 and counts[at + 1]):
            at >>= 1
        if at <= 1:
            return None
        at += 1
        while at < self.leaves:
            at = 2 * at if counts[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit_decreasing(sizes: list[int], size: int) -> list[list[int]]:
    """Bins of items, by index: items by size downwards, then by index, each into the fullest bin that has room."""
    tree, bins = CapacityTree(size), []
    by_room: dict[int, list[int]] = {}
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        room = tree.smallest(sizes[item])
        if room is None:
            bins.append([])
            at, room = len(bins) - 1, size
        else:
            at = by_room[room].pop()
            tree.change(room, -1)
        bins[at].append(item)
        left = room - sizes[item]
        if left:
            by_room.setdefault(left, []).append(at)
            tree.change(left, 1)
    return bins


PACKED_COLUMNS = "block long, sequence int, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<{key}>, starts array<long>"


def packed_schema(key: pa.DataType) -> pa.Schema:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(key), pa.list_(pa.int64())]
    return pa.schema([(c.split()[0], kind) for c, kind in zip(PACKED_COLUMNS.split(", "), kinds, strict=True)])


def _packed(block: int, docs: list[tuple[object, np.ndarray]], length: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    pieces = [(doc, at, ids[at : at + length]) for doc, ids in docs for at in range(0, len(ids), length)]
    rows = []
    for n, members in enumerate(best_fit_decreasing([len(p[2]) for p in pieces], length)):
        parts = [pieces[i] for i in members]
        sizes = [len(p[2]) for p in parts]
        ids, positions = np.full(length, END_OF_TEXT, "<u2"), np.zeros(length, "<u2")
        used = sum(sizes)
        ids[:used] = np.concatenate([p[2] for p in parts])
        positions[:used] = np.concatenate([np.arange(s) for s in sizes])
        rows.append((block, n, used, ids.tobytes(), positions.tobytes(), [0, *np.cumsum(sizes).tolist()], [p[0] for p in parts], [p[1] for p in parts]))
    for i in range(0, len(rows), 256):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 256], strict=True), schema, strict=True)], schema=schema)


def _pack(ranks, length: int):
    def run(batches):
        from pyspark import TaskContext

        tokenizer, docs, n = Tokenizer(ranks.value), [], 0
        block, schema = TaskContext.get().partitionId() << 32, packed_schema(pa.int64())
        for batch in batches:
            schema = packed_schema(batch.column(0).type)
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(tokenizer.ids(text.as_py() or ""), np.uint16(END_OF_TEXT))
                docs.append((doc.as_py(), ids))
                n += len(ids)
                if n >= BLOCK_TOKENS:
                    yield from _packed(block, docs, length, schema)
                    docs, n, block = [], 0, block + 1
        if docs:
            yield from _packed(block, docs, length, schema)

    return run


def pack_documents(docs: DataFrame, length: int = 2048, ranks: str = RANKS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Packed sequences of `length` tokens (65,536 at most).

    ids: the row of the id matrix, little-endian 16-bit, filled up with the end id; positions: 16-bit positions
    that restart at each segment; cu_seqlens: cumulative segment lengths up to n_tokens; doc_ids and starts: the
    document of each segment and the token of it that the segment begins with. A document ends with one end id, so null and empty
    texts are one token, and no rows give none; documents longer than `length` are split, and joined by starts they are whole again.
    """
    small_batches(docs.sparkSession)
    with open(ranks, "rb") as file:
        table = docs.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary: of fixed size
    rows = docs.select(F.col(doc_id), F.col(text))
    return rows.mapInArrow(tidy(_pack(table, length)), PACKED_COLUMNS.format(key=rows.schema[0].dataType.simpleString()))
