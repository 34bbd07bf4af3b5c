"""Language-model scores from a backoff model of all word n-grams, looked up shard by shard.

Texts are cut into chunks. A chunk sends each of its distinct n-grams (of words to order 3) once to the shard that
owns the n-gram's 64-bit key, with its training count; the shard adds the counts of all chunks and sends the
totals back. Weights are absolutely discounted: an n-gram seen at least `least` times, a number that does not
depend on the corpus, has an arc from its prefix; what a prefix lacks goes through its failure arc, to
the suffix, with the mass that is left. The sums over a prefix's arcs are gathered the same way: one chunk that
holds an arc's n-gram adds it, and shards add the chunks' sums. No table is broadcast or collected, and a frequent
n-gram costs its shard one entry a chunk.
"""

from __future__ import annotations

import gc
import math
import pickle
import time
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, chunks, mixed, release_memory, saved, text_bytes, words_of

#: Order of the model; n-grams counted less often have no arc (1: all have one); discount of counts of n-grams longer than a word.
ORDER, LEAST, DISCOUNT = 3, 1, 0.75
#: Text of a chunk, in units of 32 KB; chunks' worth of text whose n-grams a shard owns.
LANE, SHARE = 128, 1
#: Bits of hash beyond those that number the corpus's n-grams.
SPARE = 20
#: Bits of hash at least: small corpora can have more than they need.
FEWEST = 50
#: Words of more bytes are hashed one by one.
LONG = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: The end token's index among a chunk's words; texts begin after it.
END = 0
_END_WORD = pa.array([b"\n"], pa.large_binary())
#: Rows between chunks and shards. Of a chunk's own state, shard is STATE; of a shard's figures, chunk is.
_MAIL, STATE = "chunk long, shard int, a binary", -1
_MAIL_ARROW = pa.schema([("chunk", pa.int64()), ("shard", pa.int32()), ("a", pa.binary())])


def _packed_apart(cuts, *arrays: np.ndarray) -> list[bytes]:
    """The arrays from cut to cut. Bytes of one place stand together, each place compressed by itself (none if all are zero): those of keys are noise, those of counts are few."""
    codec = pa.Codec("zstd", compression_level=1)
    places = [(a.dtype.str, np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize)) for a in arrays]
    places = [(kind, [np.ascontiguousarray(of[:, i]) for i in range(of.shape[1])]) for kind, of in places]
    return [pickle.dumps([(kind, int(b - a), [codec.compress(x[a:b], asbytes=True) if x[a:b].any() else b"" for x in of]) for kind, of in places]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of 8 or fewer bytes a value; they may differ in length."""
    return pickle.dumps([_packed_apart([0, len(a)], a)[0] for a in arrays])


def _joined(blobs: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """The arrays of what was packed apart, end to end, and the length of each part."""
    codec, parts = pa.Codec("zstd"), [pickle.loads(b) for b in blobs]
    lengths, out = np.array([part[0][1] for part in parts], np.int64), []
    for of in zip(*parts, strict=True):
        values = np.zeros(int(lengths.sum()), of[0][0])
        into = values.view(np.uint8).reshape(len(values), values.itemsize)
        for i in range(values.itemsize):
            if any(places[i] for _, _, places in of):
                into[:, i] = np.frombuffer(b"".join(codec.decompress(places[i], n, asbytes=True) if places[i] else bytes(n) for _, n, places in of), np.uint8)
        out.append(values)
    return out, lengths


def _unpacked(blob: bytes) -> list[np.ndarray]:
    return [_joined([b])[0][0] for b in pickle.loads(blob)]


def _steps(keys: np.ndarray, cuts) -> np.ndarray:
    """Each key less the one before it; the first after a cut stays."""
    out = np.diff(keys, prepend=np.uint64(0))
    first = np.asarray(cuts[:-1], np.int64)
    out[first] = keys[first]
    return out


def _summed(steps: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The keys whose steps these are, part by part."""
    for part in np.split(steps, np.cumsum(lengths)[:-1]):
        np.cumsum(part, out=part)
    return steps


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, where each is first found, and each key's rank among them.

    Keys are sorted as single numbers, their high bits over their positions, which takes a fraction of an argsort's
    time. Where keys differ only in bits that find no room, a sort that keeps order puts them right.
    """
    n = len(keys)
    if not n:
        return keys, np.zeros(0, np.int64), np.zeros(0, np.int32)
    place, low = (n - 1).bit_length(), keys.min()
    lost = max(0, int(keys.max() - low).bit_length() + place - 64)
    order = ((keys - low) >> np.uint64(lost)) << np.uint64(place)
    order |= np.arange(n, dtype=np.uint64)
    order.sort()
    order = (order & np.uint64((1 << place) - 1)).astype(np.int64)
    found = keys[order]
    if lost and (found[1:] < found[:-1]).any():
        again = np.argsort(found, kind="stable")
        order, found = order[again], found[again]
    new = np.ones(n, bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    rank = np.empty(n, np.int32)
    rank[order] = np.cumsum(new, dtype=np.int32) - 1
    return found[new], order[new], rank


def _word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of binary values: those of up to LONG bytes are mixed in eight bytes at a time, all values side by side."""
    data, offsets = text_bytes(words)
    starts, sizes = offsets[:-1], np.diff(offsets)
    eights = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    out = mixed((sizes.astype(np.uint64) + np.uint64(1)) * _ODD)
    for done in range(0, LONG, 8):
        at = np.flatnonzero((sizes > done) & (sizes <= LONG))
        if not len(at):
            break
        spare = 8 * np.maximum(8 - (sizes[at] - done), 0).astype(np.uint64)
        eight = (eights[starts[at] + done] << spare) >> spare
        out[at] = mixed((out[at] ^ eight) * _ODD)
    for i in np.flatnonzero(sizes > LONG):
        out[i] = int.from_bytes(blake2b(words[int(i)].as_py(), digest_size=8).digest(), "little")
    return out


def _level(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(3)).astype(np.int64)


class Layout(NamedTuple):
    """How n-grams are named and dealt: keys of `bits` bits of hash with the order in two bits below, shards that own ranges of keys."""

    order: int
    shards: int
    bits: int

    @classmethod
    def of(cls, size: int, order: int) -> Layout:
        """For texts of so many bytes. An n-gram shares its key with another with probability 2^-SPARE at most, whatever the size."""
        return cls(order, max(4, -(-size // (SHARE * (LANE << 15)))), min(62, max(FEWEST, (order * max(size, 1)).bit_length() - 1 + SPARE)))

    def hashes(self, words: pa.Array) -> np.ndarray:
        """Of the words' hashes what keys can hold."""
        return _word_hashes(words) >> np.uint64(64 - self.bits)

    def raw(self, hashes: np.ndarray) -> np.ndarray:
        return hashes << np.uint64(64 - self.bits)

    def keys(self, raw: np.ndarray, k: int) -> np.ndarray:
        return ((raw >> np.uint64(64 - self.bits)) << np.uint64(2)) | np.uint64(k)

    def by_shard(self, keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The shards that own keys, the keys' positions shard by shard, and where each shard's begin and the last's end."""
        owner = (((keys >> np.uint64(self.bits - 30)) * np.uint64(self.shards)) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(owner, kind="stable").astype(np.int32)
        owner = owner[order]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        return owner[first].tolist(), order, np.append(first, len(keys))


class Shape(NamedTuple):
    """A chunk's n-grams. keys: by order, then sorted, the order in the lowest two bits; prefix and suffix: their positions among keys, -1 for words; at[k - 1]: position of the k-gram that ends at each token, -1 for none."""

    keys: np.ndarray
    prefix: np.ndarray
    suffix: np.ndarray
    at: list[np.ndarray]
    row: np.ndarray
    own: np.ndarray  # tokens that are not the end token before a row

    @classmethod
    def of(cls, ids: np.ndarray, hashes: np.ndarray, lengths: np.ndarray, layout: Layout) -> Shape:
        """ids: of each row the end token before it, its words and its end token, lengths of them in all. Each of the hashed words occurs."""
        row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        depth = np.arange(len(ids), dtype=np.int32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
        hashes = layout.raw(hashes)
        found, _, rank = _ranked(layout.keys(hashes, 1))
        none = np.full(len(found), -1, np.int32)
        raw, keys, prefix, suffix, at, base = hashes[ids], [found], [none], [none], [rank[ids]], len(found)
        for k in range(2, layout.order + 1):
            raw = mixed(np.concatenate([raw[:1], raw[:-1]]) * _ODD + hashes[ids])
            places = np.flatnonzero(depth >= k - 1)
            found, first, rank = _ranked(layout.keys(raw[places], k))
            here = np.full(len(ids), -1, np.int32)
            here[places] = rank + np.int32(base)
            first = places[first]
            keys.append(found)
            prefix.append(at[-1][first - 1])
            suffix.append(at[-1][first])
            at.append(here)
            base += len(found)
        return cls(np.concatenate(keys), np.concatenate(prefix), np.concatenate(suffix), at, row, depth > 0)


def _mail(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    chunk, shard, a = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.Table.from_arrays([pa.array(chunk, pa.int64()), pa.array(shard, pa.int32()), pa.array(a, pa.binary())], schema=_MAIL_ARROW)


def _states(limit: int, layout: Layout):
    """Each chunk's state: tokens, word hashes, rows."""

    def state(batch: pa.RecordBatch) -> bytes:
        found = words_of(text_bytes(batch.column(2)), NOT_SPACE)
        hashes = np.concatenate([layout.hashes(_END_WORD), layout.hashes(found.distinct)])
        lengths = found.rows + 2
        ids = np.full(int(lengths.sum()), END, np.int32)
        ids[np.arange(len(found.codes)) + np.repeat(2 * np.arange(batch.num_rows) + 1, found.rows)] = found.codes + 1
        held = np.array(batch.column(1).to_pylist(), bool)
        valid = np.array(batch.column(0).is_valid().to_pylist(), bool)
        docs = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        return _packed(ids, hashes, lengths.astype(np.int64), held, valid, docs)

    def run(batches):
        chunk = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in chunks(whole, 2, limit):
                yield from _mail([(chunk, STATE, state(batch))]).to_batches()
                release_memory()
                chunk += 1

    return run


def _ask(layout: Layout, all_wanted: bool):
    """To each shard: a chunk's keys, training counts, and whether the sums over the n-gram's arcs may be wanted."""

    def asked(chunk: int, state: bytes) -> pa.Table:
        ids, hashes, lengths, held, *_ = _unpacked(state)
        shape = Shape.of(ids, hashes, lengths, layout)
        learnt = ~held[shape.row]
        counts, wanted = np.zeros(len(shape.keys), np.int64), np.zeros(len(shape.keys), bool)
        for at in shape.at:
            counts += np.bincount(at[shape.own & learnt & (at >= 0)], minlength=len(counts))
            wanted[at[(at >= 0) & (all_wanted | ~learnt)]] = True
        shards, order, cuts = layout.by_shard(shape.keys)
        return _mail([(chunk, shard, a) for shard, a in zip(shards, _packed_apart(cuts, _steps(shape.keys[order], cuts), (counts * 2 + wanted)[order]), strict=True)])

    def run(batches):
        for batch in batches:
            for chunk, state in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                yield from asked(chunk, state.as_py()).to_batches(max_chunksize=200)
                release_memory()

    return run


def _freed(run):
    """The function of a group's table, its memory released after each."""

    def whole(table: pa.Table) -> pa.Table:
        out = run(table)
        release_memory()
        return out

    return whole


def _in_turn(table: pa.Table, by: str) -> list[tuple[int, bytes]]:
    table = table.sort_by(by)
    return list(zip(table[by].to_pylist(), table["a"].to_pylist(), strict=True))


def _counted(layout: Layout):
    """A shard's answers: of each n-gram its count in all, whether this chunk is the one to add it to its prefix, and whether its own sums are wanted. And the shard's figures of words: tokens, kinds, kinds seen once and twice."""

    def run(table: pa.Table) -> pa.Table:
        shard, mail = table["shard"][0].as_py(), _in_turn(table, "chunk")
        (steps, flagged), lengths = _joined([a for _, a in mail])
        keys, _, rank = _ranked(_summed(steps, lengths))
        counts, wanted = np.bincount(rank, flagged >> 1, len(keys)).astype(np.int64), np.zeros(len(keys), bool)
        wanted[rank[(flagged & 1) > 0]] = True
        seen, one, adds = np.flatnonzero(flagged > 1), np.zeros(len(keys), np.int64), np.zeros(len(flagged), np.int64)
        one[rank[seen]] = seen
        adds[one[counts > 0]] = 1
        answers = _packed_apart([0, *np.cumsum(lengths)], counts[rank] * 4 + adds * 2 + wanted[rank])
        rows = [(chunk, shard, a) for (chunk, _), a in zip(mail, answers, strict=True)]
        words = counts[(_level(keys) == 1) & (keys != layout.keys(layout.raw(layout.hashes(_END_WORD)), 1))]
        mine = counts[_level(keys) == 1]
        rows.append((STATE, shard, _packed(np.array([mine.sum(), (mine > 0).sum(), (words == 1).sum(), (words == 2).sum()], np.int64))))
        return _mail(rows)

    return _freed(run)


class Unigram(NamedTuple):
    """Discounted word probabilities: n tokens of v kinds; what the discount frees is dealt evenly over the kinds and one unknown word."""

    n: int
    v: int
    discount: float

    @property
    def freed(self) -> float:
        return self.discount * self.v / (self.v + 1) if self.v else 1.0

    def probability(self, count):
        return (np.maximum(count - self.discount, 0) + self.freed) / max(self.n, 1)


class Known(NamedTuple):
    """A chunk with its n-grams' counts in all; p: probabilities of those that have an arc, and of all words."""

    shape: Shape
    state: list[np.ndarray]
    counts: np.ndarray
    adds: np.ndarray
    wanted: np.ndarray
    arc: np.ndarray
    p: np.ndarray

    @classmethod
    def of(cls, state: bytes, answers: list[bytes], layout: Layout, unigram: Unigram, least: int) -> Known:
        state = _unpacked(state)
        shape = Shape.of(*state[:3], layout)
        answer = np.empty(len(shape.keys), np.int64)
        answer[layout.by_shard(shape.keys)[1]] = _joined(answers)[0][0]
        counts, level = answer >> 2, _level(shape.keys)
        arc = (level > 1) & (counts >= least)
        p = np.where(level == 1, unigram.probability(counts), 0.0)
        p[arc] = (counts[arc] - min(DISCOUNT, 1)) / counts[shape.prefix[arc]]
        return cls(shape, state, counts, (answer & 2) > 0, (answer & 1) > 0, arc, p)

    def asking(self) -> np.ndarray:
        """Positions of the n-grams that this chunk adds arcs of, or may need the sums of: both only where some chunk may need them."""
        at = np.zeros(len(self.counts), bool)
        at[self.shape.prefix[self.arc & self.adds]] = True
        used = np.zeros(len(self.counts), bool)
        used[self.shape.prefix[(self.shape.prefix >= 0) & ~self.arc]] = True
        return np.flatnonzero(self.wanted & (at | used))


def _add_arcs(layout: Layout, unigram: Unigram, least: int):
    def run(table: pa.Table) -> pa.Table:
        chunk, mail = table["chunk"][0].as_py(), _in_turn(table, "shard")
        known = Known.of(mail[0][1], [a for _, a in mail[1:]], layout, unigram, least)
        shape, mine = known.shape, known.arc & known.adds
        prefix, n = shape.prefix[mine], len(shape.keys)
        sums = [np.bincount(prefix, minlength=n), np.bincount(prefix, known.counts[mine], n).astype(np.int64), np.bincount(prefix, known.counts[shape.suffix[mine]], n).astype(np.int64)]
        ask = known.asking()
        shards, order, cuts = layout.by_shard(shape.keys[ask])
        ask = ask[order]
        return _mail([(chunk, shard, a) for shard, a in zip(shards, _packed_apart(cuts, _steps(shape.keys[ask], cuts), *(s[ask] for s in sums)), strict=True)])

    return _freed(run)


def _added(table: pa.Table) -> pa.Table:
    """A shard's answers: over all chunks, each prefix's arcs, their counts and their suffixes' counts."""
    shard, mail = table["shard"][0].as_py(), _in_turn(table, "chunk")
    (steps, *sums), lengths = _joined([a for _, a in mail])
    keys, _, rank = _ranked(_summed(steps, lengths))
    sums = [np.bincount(rank, s, len(keys)).astype(np.int64)[rank] for s in sums]
    return _mail([(chunk, shard, a) for (chunk, _), a in zip(mail, _packed_apart([0, *np.cumsum(lengths)], *sums), strict=True)])


SCORED_COLUMNS = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(layout: Layout, unigram: Unigram, least: int):
    """Weights of a chunk's n-grams, order by order, and the sums over its rows."""

    def run(table: pa.Table) -> pa.Table:
        # answers of the second round have shards from 2^30
        mail = _in_turn(table, "shard")
        known = Known.of(mail[0][1], [a for s, a in mail[1:] if s < _SECOND], layout, unigram, least)
        shape, (_, _, lengths, held, valid, docs) = known.shape, known.state
        ask, backoff = known.asking(), np.zeros(len(shape.keys))
        if len(ask):
            arcs, n, lower = _joined([a for s, a in mail if s >= _SECOND])[0]
            ask = ask[layout.by_shard(shape.keys[ask])[1]]
            some = arcs > 0
            ask, arcs, n, lower = ask[some], arcs[some], n[some], lower[some]
            left = 1 - (n - min(DISCOUNT, 1) * arcs) / known.counts[ask]
            # the suffixes of a prefix's arcs are words, or n-grams of one prefix themselves
            of_words = (lower + (unigram.freed - unigram.discount) * arcs) / max(unigram.n, 1)
            below = 1 - np.where(shape.suffix[ask] < 0, of_words, (lower - min(DISCOUNT, 1) * arcs) / np.maximum(known.counts[shape.suffix[ask]], 1))
            backoff[ask] = np.log10(np.maximum(left, 1e-9) / np.maximum(below, 1e-9))
        level, weight = _level(shape.keys), np.zeros(len(shape.keys))
        direct = (level == 1) | known.arc
        weight[direct] = np.log10(known.p[direct])
        for k in range(2, layout.order + 1):
            fails = np.flatnonzero((level == k) & ~known.arc)
            weight[fails] = backoff[shape.prefix[fails]] + weight[shape.suffix[fails]]
        longest = shape.at[0]
        for at in shape.at[1:]:
            longest = np.where(at >= 0, at, longest)
        own, rows = shape.own, len(lengths)
        row, words = shape.row[own], known.counts[shape.at[0][own]]
        base = np.bincount(row, np.log10(words + 0.5), rows) - (lengths - 1) * math.log10(unigram.n + 0.5 * (unigram.v + 1))
        return pa.Table.from_pydict({
            "doc_id": pa.array(docs, pa.int64(), mask=~valid),
            "held_out": pa.array(held),
            "n_tokens": pa.array(lengths - 1, pa.int64()),
            "n_known": pa.array(np.bincount(row, words > 0, rows).astype(np.int64)),
            "train_tokens": pa.array(np.full(rows, unigram.n, np.int64)),
            "base_score": pa.array(base),
            "score": pa.array(np.bincount(row, weight[longest[own]], rows)),
        })

    return _freed(run)


#: Added to the shards of the second round's answers.
_SECOND = 1 << 30


def score_documents(docs: DataFrame, held_out: F.Column, order: int = ORDER, states: int | None = None, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """Train on the documents that aren't held out and score all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    N-grams counted at least `least` times have arcs; with `states`, at most so many of each order (those counted
    tokens / states times), whatever the corpus. Order: 3 at most.
    Null texts are empty: one end token. A null doc_id, or a null held_out, is a training document. Without
    training documents every token is unknown. Rows that repeat are each scored and each learnt from.
    """
    if not 1 <= order <= 3:
        raise ValueError("order is 1 to 3")
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    limit = LANE << 15
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    layout = Layout.of(size, order)

    def kept(df: DataFrame, name: str) -> DataFrame:
        out = saved(df, name)
        for _ in range(2):  # Spark removes shuffle files when the driver has collected their plans, which takes two passes
            gc.collect()
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)
        return out

    state = kept(rows.mapInArrow(_states(limit, layout), _MAIL), "state")
    counted = kept(state.mapInArrow(_ask(layout, states is not None or least > 1), _MAIL).groupBy("shard").applyInArrow(_counted(layout), _MAIL), "counted")
    figures = [_unpacked(bytes(r[0]))[0] for r in counted.where(F.col("chunk") == STATE).select("a").collect()]  # four numbers a shard
    n, v, once, twice = (int(x) for x in np.sum(figures, axis=0)) if figures else (0, 0, 0, 0)
    unigram = Unigram(n, v, once / (once + 2 * twice) if once else 0.5)
    if states is not None:
        least = max(least, -(-n // states))
    counts = state.unionByName(counted.where(F.col("chunk") >= 0))
    arcs = counts.groupBy("chunk").applyInArrow(_add_arcs(layout, unigram, least), _MAIL)
    added = kept(arcs.groupBy("shard").applyInArrow(_added, _MAIL).withColumn("shard", (F.col("shard") + _SECOND).cast("int")), "added")
    return counts.unionByName(added).groupBy("chunk").applyInArrow(_score(layout, unigram, least), SCORED_COLUMNS)


def score_corpus(docs: DataFrame) -> DataFrame:
    """Scores with the documents held out whose crc32 of the id, as text, leaves 1 when divided by 5."""
    return score_documents(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)
