"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketching places every shingle in a bin by one hash per round; a coordinate keeps the
smallest (round, hash), and after as many rounds as there are coordinates each further round
is tied to one bin, so every coordinate fills. Equal shingle sets are one class from the
start. Classes that agree on a band are candidates: each is compared with its bucket's
leader first, and pairs across the components that result are then compared within
mixed buckets, so no group is expanded into all its pairs. Links are
confirmed on full shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, Scratch, chunks, marked, mixed, number_of, numbered, saved, text_bytes, tidy, words_of

#: Bands and coordinates in each. At a similarity of 0.8 two sets share no band with probability (1 - 0.8^6)^42 = 3e-6.
BANDS, WIDTH = 42, 6
SIZE = BANDS * WIDTH
#: Pairs whose estimate is lower are not compared exactly: five standard deviations (0.026 at 0.8) below the threshold, 3e-7 of the pairs at it.
MARGIN = 0.13
#: Bits kept of each coordinate for estimates, packed into words of 64 bits.
BITS = 4
PACKED = -(-SIZE * BITS // 64)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit keys of each text's k-word shingles; fewer words are one shingle, none give an empty set."""
    words = words_of(text_bytes(column), NOT_SPACE)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words.distinct.to_pylist()], np.uint64)
    hashes = hashes[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    n = max(0, len(hashes) - k + 1)

    def keys(size: int, first: np.ndarray | slice) -> np.ndarray:
        x = np.full(1, size, np.uint64)
        for j in range(size):
            x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + (hashes[j : j + n] if isinstance(first, slice) else hashes[first + j]))
        return x

    whole = keys(k, slice(None)) if n else hashes[:0]
    ends = np.cumsum(words.rows)
    out = []
    for start, end in zip((ends - words.rows).tolist(), ends.tolist(), strict=True):
        if end - start >= k:
            out.append(np.unique(whole[start : end - k + 1]))
        elif end > start:
            out.append(keys(end - start, np.array([start])))
        else:
            out.append(hashes[:0])
    return out


@cache
def _seeds() -> np.ndarray:
    return mixed(np.arange(1, 2 * SIZE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketch(items: np.ndarray) -> np.ndarray:
    """SIZE coordinates of a non-empty set of 64-bit keys; each is (round << 32) + hash of its smallest element."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(SIZE, empty)
    at, step, low = 0, max(1, min(SIZE, math.ceil(1600 / len(items)))), np.uint64(0xFFFFFFFF)
    while at < SIZE:
        rounds = np.arange(at, min(at + step, SIZE))
        h = mixed(items[None, :] ^ _seeds()[rounds][:, None])
        bins = ((h >> np.uint64(32)) * np.uint64(SIZE) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(out, bins.ravel(), ((h & low) + (rounds.astype(np.uint64) << np.uint64(32))[:, None]).ravel())
        if not (out == empty).any():
            return out
        at += step
    for bin_ in np.flatnonzero(out == empty):
        out[bin_] = (mixed(items ^ _seeds()[SIZE + bin_]) & low).min() + (np.uint64(SIZE + int(bin_)) << np.uint64(32))
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    x = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in coordinates.reshape(BANDS, WIDTH).T:
        x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + column)
    return x.view(np.int64)


def signature(coordinates: np.ndarray) -> np.ndarray:
    """The coordinates' low bits in PACKED words."""
    low = np.zeros(PACKED * 64 // BITS, np.uint64)
    low[:SIZE] = coordinates & np.uint64((1 << BITS) - 1)
    shifts = np.arange(0, 64, BITS, dtype=np.uint64)
    return np.bitwise_or.reduce(low.reshape(PACKED, -1) << shifts, axis=1).view(np.int64)


def estimated(a: str, b: str) -> Column:
    """The similarity that two signature columns suggest: their share of equal coordinates, less the chance of equal low bits."""
    unequal = F.lit(0)
    for i in range(PACKED):
        z = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        for shift in (1, 2):  # any bit of the four
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
        unequal = unequal + F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))
    by_chance = 2.0**-BITS
    return (1 - unequal / F.lit(float(SIZE)) - by_chance) / (1 - by_chance)


FEATURE_COLUMNS = "doc_id long, n long, digest binary, bands array<long>, sig array<long>"


def _features(k: int):
    def run(batches):
        for whole in batches:
            for batch in chunks(whole, 1):
                sets = shingle_sets(batch.column(1), k)
                sketches = [sketch(s) if len(s) else None for s in sets]
                bands = [None if s is None else band_keys(s) for s in sketches]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                        pa.array([None if s is None else signature(s) for s in sketches], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n", "digest", "bands", "sig"],
                )

    return run


#: Bits of a parity sketch in words of 64, and the most elements of a set that it takes as they are.
PARITY, WHOLE = 16, 512


def parity_sketch(items: np.ndarray, level: int) -> np.ndarray:
    """The parity, bit by bit, of the set's elements in a sample of one in 2^level. Two sketches never differ in more bits than the sampled sets differ in elements."""
    h = mixed(items ^ np.uint64(0xA0761D6478BD642F))
    h = h[(h & np.uint64((1 << level) - 1)) == 0] >> np.uint64(40)
    counts = np.bincount((h % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


PARITY_WORDS = [f"p{i}" for i in range(PARITY)]


def _parities(k: int):
    """Each set's sketch at its own level and at the next, as two rows: linked sets are at most one level apart."""

    def run(batches):
        for whole in batches:
            for batch in chunks(whole, 1):
                rows = []
                for node, items in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), k), strict=True):
                    own = max(0, math.ceil(math.log2(max(len(items), 1) / WHOLE)))
                    rows += [(node, own, level, *parity_sketch(items, level).tolist()) for level in (own, own + 1)]
                names = ["node", "own_level", "level", *PARITY_WORDS]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if "level" in name else pa.int64()) for c, name in zip(zip(*rows, strict=True), names, strict=True)], names=names)

    return run


def may_link(percent: int) -> Column:
    """Whether two sets (n, own_level, level, the parity words, and the same with x_) meet at the larger of their levels and can be linked:
    linked sets differ in at most (1 - s) / (1 + s) of their sizes' sum. Exact for sets of up to WHOLE elements; for samples with
    five standard deviations to spare."""
    unequal = F.lit(0)
    for word in PARITY_WORDS:
        unequal = unequal + F.bit_count(F.col(word).bitwiseXOR(F.col(f"x_{word}")))
    most = F.lit((100 - percent) / (100 + percent)) * (F.col("n") + F.col("x_n")) / F.pow(F.lit(2.0), F.col("level"))
    return (F.col("level") == F.greatest("own_level", "x_own_level")) & (unequal <= most + F.when(F.col("level") > 0, 5 * F.sqrt(most)).otherwise(F.lit(1e-6)))


def _confirmed(k: int, percent: int):
    def run(batches):
        for whole in batches:
            for batch in chunks(whole, 2):
                left = shingle_sets(batch.column(2), k)
                distinct = batch.column(3).dictionary_encode()  # a leader's text comes with each of its members
                right = shingle_sets(distinct.dictionary, k)
                linked = []
                for x, code in zip(left, distinct.indices.to_pylist(), strict=True):
                    y = right[code]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(100 * common >= percent * (len(x) + len(y) - common))
                mask = pa.array(linked, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(mask)

    return run


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) of every node of the edges a, b: smallest labels of neighbours, then of labels, until nothing changes."""
    with Scratch() as scratch:
        both = scratch.saved(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
        labels = scratch.saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
        while True:
            near = both.join(labels.select(F.col("node").alias("a"), "component"), "a").groupBy(F.col("b").alias("node")).agg(F.min("component").alias("near"))
            down = labels.select("node", "component").join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
            up = labels.select(F.col("node").alias("new"), F.col("component").alias("top"))
            # a label's own label of the last round is never larger
            moved = down.join(up, "new").select("node", F.least("new", "top").alias("component"), (F.least("new", "top") < F.col("old")).alias("changed"))
            labels = scratch.saved(moved, "labels", instead=labels)
            if labels.where("changed").isEmpty():
                return saved(labels.select("node", "component"), "components")


class NearDuplicates:
    """Links documents whose k-word shingle sets have 100 * common >= percent * union.

    Null or empty texts have empty sets and link with nothing. Rows that repeat a document are each returned. A null doc_id is
    grouped with equal sets but is never a component's name. doc_id should otherwise name one text.
    """

    def __init__(self, k: int = 5, percent: int = 80):
        self.k, self.percent = k, percent

    def _rated(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs a, b with the sketches' estimate, those whose set sizes exclude a link left out."""
        of = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
        sized = pairs.join(of("a"), "a").join(of("b"), "b").where(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b"))
        return sized.select("a", "b", estimated("sig_a", "sig_b").alias("estimate"))

    def _links(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Those of the pairs that are linked."""
        left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        both = left.join(right, "b").select("a", "b", "text_a", "text_b")
        return both.mapInArrow(tidy(_confirmed(self.k, self.percent)), "a long, b long")

    def _merged(self, scratch: Scratch, labels: DataFrame | None, links: DataFrame) -> DataFrame:
        """Labels after further links; links are between nodes."""
        if labels is None:
            return components(links)
        ends = links
        for c in ("a", "b"):
            of = labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
            ends = ends.join(of, c, "left").withColumn(f"{c}_of", F.coalesce(f"{c}_of", c))
        top = components(scratch.saved(ends.select(F.col("a_of").alias("a"), F.col("b_of").alias("b")).where("a <> b"), "links"))
        over = top.select(F.col("node").alias("component"), F.col("component").alias("top"))
        moved = labels.join(over, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        new = top.join(labels, "node", "left_anti")
        return scratch.saved(moved.unionByName(new.select("node", "component")), "labels")

    def _apart(self, pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """The pairs whose ends are in different components."""
        out = pairs
        for c in ("a", "b"):
            out = out.join(labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of")), c, "left").withColumn(f"{c}_of", F.coalesce(f"{c}_of", c))
        return out.where("a_of <> b_of").select(*pairs.columns)

    def find(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """Per row: doc_id, n_shingles, component_id (smallest linked doc_id, itself included), kept (doc_id = component_id)."""
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        features = saved(rows.mapInArrow(tidy(_features(self.k)), FEATURE_COLUMNS), "features")
        with Scratch() as scratch:
            named = features.where("n > 0 and doc_id is not null")
            nodes = scratch.saved(named.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "nodes")
            banded = nodes.select(F.explode("bands").alias("band"), "node", "n")
            leaders = banded.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").select("band", "leader")
            leaders = scratch.saved(leaders, "leaders")
            members = scratch.saved(banded.join(leaders, "band").select("band", "node", "n", "leader"), "members", instead=leaders)
            labels = self._labels(scratch, rows, nodes.select("node", "n", "sig"), members)
            classes = nodes.select("digest", "node")
            if labels is not None:
                classes = classes.join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
            else:
                classes = classes.select("digest", F.col("node").alias("component_id"))
            classes = saved(classes, "classes")
        full = features.where("n > 0").select("doc_id", "n", "digest").join(classes, "digest", "left").select("doc_id", "n", "component_id")
        empty = features.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
        return full.unionByName(empty).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))

    def _labels(self, scratch: Scratch, rows: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame | None:
        """node and component of the linked nodes; None without candidates."""
        star = members.where("node <> leader").groupBy(F.col("node").alias("a"), F.col("leader").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
        star = scratch.saved(star, "star")
        if star.isEmpty():
            return None
        # Texts of the candidates: most others are left out before the join that is sure of it.
        chosen = scratch.saved(members.select("node").distinct(), "chosen")
        likely = marked(rows.withColumnRenamed("doc_id", "node"), F.col("node"), chosen).where("maybe")
        texts = scratch.saved(likely.join(chosen, "node", "left_semi").select("node", "text"), "texts")
        floor = self.percent / 100 - MARGIN
        rated = scratch.saved(self._rated(star.select("a", "b"), nodes), "rated")
        near = rated.where(F.col("estimate") >= floor)
        # 1: every node with the best of its leaders.
        first = near.groupBy("a").agg(F.max_by("b", F.struct("estimate", -F.col("b"))).alias("b"))
        links = scratch.saved(self._links(first, texts), "links")
        labels = self._merged(scratch, None, links)
        # 2: every other leader, where that would join components.
        rest = scratch.saved(self._apart(near.select("a", "b").join(first, ["a", "b"], "left_anti"), labels), "rest")
        if not rest.isEmpty():
            labels = self._merged(scratch, labels, scratch.saved(self._links(rest, texts), "links"))
        # 3: pairs across components within buckets. Distance is a metric: estimates to the leader that differ by more than
        # the largest distance, and twice the margin, exclude a link; so do parity sketches, within the join.
        of = labels.select("node", "component")
        placed = members.join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = placed.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("band")
        inside = placed.join(scratch.saved(mixed, "mixed"), "band", "left_semi")
        to_leader = rated.select(F.col("a").alias("node"), F.col("b").alias("leader"), "estimate")
        inside = inside.join(to_leader, ["node", "leader"], "left").withColumn("estimate", F.when(F.col("node") == F.col("leader"), 1.0).otherwise(F.coalesce("estimate", F.lit(-1.0))))
        lead = inside.where("node = leader").select("band", F.col("component").alias("lead"))
        step = math.log(100 / self.percent)
        inside = scratch.saved(inside, "mixed-members")
        parities = texts.join(inside.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(tidy(_parities(self.k)), f"node long, own_level int, level int, {', '.join(f'{w} long' for w in PARITY_WORDS)}")
        signed = inside.join(scratch.saved(parities.dropDuplicates(["node", "level"]), "parities"), "node")
        inside = scratch.saved(signed.join(lead, "band").withColumn("size_class", F.floor(F.log("n") / step).cast("int")), "inside")
        minor = inside.where("component <> lead").select("band", F.explode(F.array(*(F.col("size_class") + i for i in (-1, 0, 1)))).alias("size_class"), F.col("node").alias("x"), F.col("component").alias("x_of"), F.col("estimate").alias("x_est"), F.col("n").alias("x_n"), "level", *(F.col(c).alias(f"x_{c}") for c in ("own_level", *PARITY_WORDS)))
        known = lambda c: F.col(c) >= 0
        reach = 1 - self.percent / 100 + 2 * MARGIN
        apart = inside.join(minor, ["band", "size_class", "level"]).where(
            (F.col("component") != F.col("x_of"))
            & (F.col("node") != F.col("leader"))
            & ((F.col("component") == F.col("lead")) | (F.col("node") < F.col("x")))
            & (100 * F.least("n", "x_n") >= self.percent * F.greatest("n", "x_n"))
            & ~(known("estimate") & known("x_est") & (F.abs(F.col("estimate") - F.col("x_est")) > reach))
            & may_link(self.percent)
        )
        pairs = scratch.saved(apart.select(F.greatest("node", "x").alias("a"), F.least("node", "x").alias("b")).distinct(), "pairs")
        if pairs.isEmpty():
            return labels
        return self._merged(scratch, labels, scratch.saved(self._links(pairs, texts), "links"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one of each group, the smallest doc_id; columns stay. Rows that repeat that doc_id stay too."""
    gone = saved(NearDuplicates(k, percent).find(docs, doc_id, text).where(~F.col("kept")).select(F.col("doc_id").alias("gone")), "gone")
    rows, id_ = numbered(docs), F.col(number_of(docs, doc_id)).cast("long")
    told = marked(rows, id_, gone)
    stay = told.where("maybe").join(gone, id_ == F.col("gone"), "left_anti").unionByName(told.where("not maybe"))
    return stay.select(*rows.columns).toDF(*docs.columns)
