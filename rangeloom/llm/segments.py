"""SentencePiece encoding and decoding, with distinct sampled segmentations.

A text's lattice has an edge for every vocabulary piece that occurs in it, and one of
byte pieces for a character without a piece of its own. A segmentation's probability is the
product of its pieces' weights, normalised over the lattice. Gumbel top-k draws k
distinct segmentations without replacement by a perturbed A-star search: the agenda holds
cells (a prefix in the lattice and the edges excluded after it) with the perturbed value of their best member, whose
bound is exact: the cell's mass in the lattice. Popping a cell completes its best
segmentation and splits the rest of the cell, one new cell for each node on the way. All
draws come from a counter-based generator keyed by the row's key, so neither batches nor retries change them.

The lattice falls apart at characters no piece runs across (before a run of spaces, around line ends): distinct
units are laid out once for a batch, and all rows walk through them side by side.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, Text, chunks, list_array, mixed, small_batches, text_bytes, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The character that stands for a space in pieces, and the form of byte pieces.
MARK, BYTE = "▁", "<0x{:02X}>"
#: Code point of a literal mark in a text, beyond all characters, so that no piece matches it.
LITERAL = 0x110000
#: Log weight of a byte piece below that of the last piece.
BYTE_PENALTY = 4.0
#: Bytes of text whose lattice is laid out at a time; a longer text is taken whole.
CHUNK = 1 << 19


class Vocabulary(NamedTuple):
    """A trie of pieces with log weights by a Zipf law of their rank: -log(rank + 1), the order in which the model lists its pieces."""

    children: Table  # node << 21 | code point
    child: np.ndarray
    piece: np.ndarray  # of each node, -1 for none
    weight: np.ndarray  # of each piece
    byte_ids: np.ndarray
    byte_weight: float
    longest: int
    splits: bool  # no piece has a space after another character, or a line end
    pieces: list[bytes]  # what each id decodes to


def vocabulary(pieces: list[tuple[str, int]], n_ids: int, byte_ids: list[int]) -> Vocabulary:
    """pieces: (piece, id) in rank order."""
    nodes: dict[tuple[int, int], int] = {}
    of, decoded, weight = [-1], [b""] * n_ids, np.zeros(n_ids)
    for rank, (piece, id_) in enumerate(pieces):
        at = 0
        for c in piece:
            at = nodes.setdefault((at, ord(c)), len(nodes) + 1)
        of += [-1] * (len(nodes) + 1 - len(of))
        of[at] = id_
        decoded[id_] = piece.replace(MARK, " ").encode()
        weight[id_] = -math.log(rank + 1)
    for byte, id_ in enumerate(byte_ids):
        decoded[id_] = bytes([byte])
    keys = np.array([(node << 21) | c for node, c in nodes], np.int64)
    splits = not any("\n" in p or any(b == MARK != a for a, b in zip(p, p[1:], strict=False)) for p, _ in pieces)
    return Vocabulary(Table.of(keys), np.fromiter(nodes.values(), np.int64), np.array(of), weight, np.array(byte_ids), -math.log(len(pieces)) - BYTE_PENALTY, max(len(p) for p, _ in pieces), splits, decoded)


def load(model: str = MODEL) -> Vocabulary:
    """The vocabulary of a SentencePiece model file with byte fallback."""
    import sentencepiece

    file = sentencepiece.SentencePieceProcessor(model_file=model)
    n = file.vocab_size()
    plain = [i for i in range(n) if not (file.is_byte(i) or file.is_control(i) or file.is_unknown(i) or file.is_unused(i))]
    return vocabulary([(file.id_to_piece(i), i) for i in plain], n, [file.piece_to_id(BYTE.format(b)) for b in range(256)])


class Lattice(NamedTuple):
    """Edges of all units by start, and normalised: edge e of node i leaves with probability chance[e]. The nodes of a unit follow one another, the last one without edges."""

    first: np.ndarray  # of each node: its first edge; one more at the end
    length: np.ndarray  # characters
    id: np.ndarray  # -1: the character's bytes
    chance: np.ndarray  # log
    upto: np.ndarray  # cumulative chance within the node, at least 1 at its last edge
    unit_start: np.ndarray
    unit_end: np.ndarray
    lone: np.ndarray  # the edges without a piece of their own, in order,
    lone_at: np.ndarray  # where in data their bytes begin
    lone_size: np.ndarray  # and how many these are
    data: np.ndarray


def lattice(units: pa.Array, vocab: Vocabulary, alpha: float) -> Lattice:
    """The units' lattices under pieces' weights to the power alpha."""
    raw = text_bytes(units)
    points = np.frombuffer(raw.data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    is_first = (raw.data & 0xC0) != 0x80
    byte_at = np.flatnonzero(is_first).astype(np.int32)
    n_bytes = np.diff(np.append(byte_at, np.int32(len(raw.data))))
    spans = np.diff(np.concatenate([[0], np.cumsum(is_first)])[raw.offsets])
    points = np.where(points == ord(MARK), LITERAL, np.where(points == 32, ord(MARK), points))
    # Nodes: one for each character, and one more at each unit's end.
    unit_end = (np.cumsum(spans + 1) - 1).astype(np.int32)
    unit_start = (unit_end - spans).astype(np.int32)
    n = len(points) + len(spans)
    node_of = np.arange(len(points), dtype=np.int32) + np.repeat(np.arange(len(spans), dtype=np.int32), spans)
    seen = np.zeros(n, np.int64)
    seen[node_of] = points
    # Pieces by walking the trie from every character at once, one character further each time; an end stops it.
    found, degree = [], np.zeros(n, np.int8)
    at, node = node_of, np.zeros(len(points), np.int64)
    for size in range(1, vocab.longest + 1):
        child = vocab.children.find((node << 21) | seen[at + (size - 1)])
        ok = child >= 0
        at, node = at[ok], vocab.child[child[ok]]
        piece = vocab.piece[node]
        ends = piece >= 0
        found.append((at[ends], piece[ends].astype(np.int32), size, degree[at[ends]]))
        degree[at[ends]] += 1
        if size == 1:  # characters that are no piece become bytes
            bare = np.flatnonzero(degree[node_of] == 0)
            lone = node_of[bare]
            found.append((lone, np.full(len(lone), -1, np.int32), 1, degree[lone]))
            degree[lone] += 1
        if not len(at):
            break
    first = np.zeros(n + 1, np.int32)
    np.cumsum(degree, out=first[1:])
    ids, lengths = np.empty(first[-1], np.int32), np.empty(first[-1], np.int8)
    for start, piece, size, rank in found:
        place = first[start] + rank
        ids[place], lengths[place] = piece, size
    del found, at, node, seen
    lone = first[lone]
    weight = (alpha * vocab.weight)[ids]
    weight[lone] = alpha * vocab.byte_weight * n_bytes[bare]
    # Backward masses, by distance to the unit's end, all units at once. Sums are taken relative to the next character's mass.
    mass = np.zeros(n)
    by_length = unit_end[np.argsort(-spans, kind="stable")]
    alive = len(spans) - np.searchsorted(np.sort(spans), np.arange(int(spans.max(initial=0)) + 1))
    for distance in range(1, len(alive)):
        here = by_length[: alive[distance]] - distance
        edge, left, beside = first[here], degree[here], mass[here + 1]
        total = np.exp(np.minimum(weight[edge] + mass[here + lengths[edge]] - beside, 700.0))
        on, rank = np.flatnonzero(left > 1), 1
        while len(on):
            e = edge[on] + rank
            total[on] += np.exp(np.minimum(weight[e] + mass[here[on] + lengths[e]] - beside[on], 700.0))
            rank += 1
            on = on[left[on] > rank]
        mass[here] = beside + np.log(total)
    starts = np.repeat(np.arange(n, dtype=np.int32), degree)
    weight += mass[starts + lengths]
    weight -= mass[starts]
    chance = np.minimum(weight, 0.0, out=weight)
    chance[first[np.flatnonzero(degree == 1)]] = 0.0
    upto = np.exp(chance)
    on, rank = first[np.flatnonzero(degree > 1)], 1
    left = degree[starts[on]]
    while len(on):
        upto[on + rank] += upto[on + rank - 1]
        rank += 1
        on, left = on[left > rank], left[left > rank]
    upto[first[1:][degree > 0] - 1] = 2.0
    return Lattice(first, lengths, ids, chance, upto, unit_start, unit_end, lone, byte_at[bare], n_bytes[bare], raw.data)


def seeds(keys: np.ndarray, stream: int) -> np.ndarray:
    """The generators' states of row keys for a stream of draws."""
    return mixed(np.atleast_1d(keys) + np.uint64(stream * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def uniform(seed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) fixed by state and position."""
    x = mixed(seed ^ (at.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def walk(lat: Lattice, node: np.ndarray, end: np.ndarray, seed: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sampled edges from each node to its unit's end, walk by walk, and their numbers. at: the node's position in its row, which picks the numbers drawn."""
    edges, walks, active = [], [], np.flatnonzero(node < end).astype(np.int32)
    node, at = node[active], at[active]
    counts = np.zeros(len(end), np.int32)
    while len(active):
        edge = lat.first[node]
        on = np.flatnonzero(lat.first[node + 1] - edge > 1)
        draw = uniform(seed[active[on]], at[on])
        while len(on):
            past = lat.upto[edge[on]] <= draw
            on, draw = on[past], draw[past]
            edge[on] += 1
        edges.append(edge)
        walks.append(active)
        counts[active] += 1
        step = lat.length[edge]
        node, at = node + step, at + step
        left = node < end[active]
        active, node, at = active[left], node[left], at[left]
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.int32)
    for i, (e, w) in enumerate(zip(edges, walks, strict=True)):
        out[first[w] + i] = e
    return out, counts


def _truncated(mass: np.ndarray, bound: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Gumbel variables at log mass, given that they are below the bound."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        return np.where(mass > -np.inf, mass - np.log(np.exp(np.minimum(mass - bound, 700.0)) - np.log(draw)), -np.inf)


class Units(NamedTuple):
    """Rows as units: codes by row, with positions in characters."""

    lat: Lattice
    codes: np.ndarray
    rows: np.ndarray
    place: np.ndarray  # of each unit among all characters
    row_place: np.ndarray  # of each row's first character; one more at the end


def units_of(text: Text, vocab: Vocabulary, alpha: float) -> Units:
    data, n = text.data, len(text.data)
    cut = np.zeros(n, bool)
    if vocab.splits and n:
        space, line = data == 32, data == 10
        cut[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    inner = text.offsets[:-1]
    cut[inner[inner < n]] = True
    at = np.append(np.flatnonzero(cut), n)
    found = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    lat = lattice(found.dictionary, vocab, alpha)
    codes = found.indices.to_numpy()
    rows = np.diff(np.searchsorted(at[:-1], text.offsets))
    ends = np.concatenate([[0], np.cumsum((lat.unit_end - lat.unit_start)[codes], dtype=np.int64)])
    return Units(lat, codes, rows, ends[:-1], ends[np.concatenate([[0], np.cumsum(rows)])])


#: No draw of 53 bits lifts a Gumbel variable further above its log mass.
REACH = 38.0
#: Nodes of a path that are looked at first for its best cells.
NEAR = 96


class Cells(NamedTuple):
    """The best cells of some paths, a row for each path: perturbed value (-inf for none), and the edges, log probability and characters before the cell."""

    value: np.ndarray
    at: np.ndarray
    before: np.ndarray
    place: np.ndarray


def _cells(lat: Lattice, edges: np.ndarray, begin: np.ndarray, count: np.ndarray, start: Cells, seed: np.ndarray, most: int) -> Cells:
    """The `most` best cells of the paths whose edges from `begin` on, `count` of them, may have cells. start: for each path
    the bound of the values, and what is before the first of these edges. Edges are looked at until the mass that is
    left cannot bring a cell among the best; no more than these are ever popped."""
    m = len(begin)
    out = Cells(np.full((m, most), -np.inf), np.zeros((m, most), np.int64), np.zeros((m, most)), np.zeros((m, most), np.int64))
    rows, width = np.flatnonzero(count), NEAR
    while len(rows):
        near = np.arange(max(most, min(width, int(count[rows].max()))))
        inside = near < count[rows, None]
        e = edges[np.minimum(begin[rows, None] + near, len(edges) - 1)]
        chance = np.where(inside, lat.chance[e], 0.0)
        run = np.cumsum(chance, axis=1)
        before = start.before[rows, None] + run - chance
        with np.errstate(divide="ignore"):
            mass = before + np.log(-np.expm1(chance))
        index = start.at[rows, None] + near
        value = _truncated(mass, start.value[rows, None], uniform(seed[rows, None], index))
        steps = np.where(inside, lat.length[e], 0)
        place = start.place[rows, None] + np.cumsum(steps, axis=1) - steps
        best = np.argpartition(-value, most - 1, axis=1)[:, :most]
        for held, found in zip(out, (value, index, before, place), strict=True):
            held[rows] = np.take_along_axis(found, best, axis=1)
        more = (count[rows] > len(near)) & (start.before[rows] + run[:, -1] + REACH >= out.value[rows].min(axis=1))
        rows, width = rows[more], 4 * width
    return out


class Draw(NamedTuple):
    """One segmentation of each of some rows, by perturbed value the same in number from the top."""

    rows: np.ndarray
    edges: np.ndarray
    counts: np.ndarray  # edges of each row
    log_prob: np.ndarray
    value: np.ndarray
    log_inclusion: np.ndarray


def _ragged(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers first[i], first[i] + 1 and so on, counts[i] of them, for each i."""
    return np.arange(int(counts.sum())) + np.repeat(first - (np.cumsum(counts) - counts), counts)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of counts[i] values; 0 of none."""
    out, some = np.zeros(len(counts), values.dtype), np.flatnonzero(counts)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some])
    return out


def draws(units: Units, keys: np.ndarray, k: int) -> list[Draw]:
    """Up to k distinct segmentations of each row, by perturbed value downwards: fewer only where the lattice has no more."""
    lat, n, most = units.lat, len(units.rows), k + 1
    starts, ends = lat.unit_start[units.codes], lat.unit_end[units.codes]
    last_unit = np.cumsum(units.rows)
    cell_seeds = seeds(keys, 1)
    agenda = Cells(np.full((n, k, most), -np.inf), np.zeros((n, k, most), np.int64), np.zeros((n, k, most)), np.zeros((n, k, most), np.int64))
    taken = np.full((n, k, most, k), -1, np.int64)  # edges excluded from each cell beside its path's own
    pool, at_pool, found = np.zeros(0, np.int32), np.zeros((k, n), np.int64), []  # all paths' edges, and where each row's begin
    for draw in range(k):
        if draw == 0:
            rows, bound = np.arange(n), -np.log(-np.log(uniform(seeds(keys, 1_000_003), np.zeros(n, np.int64))))
            row_of = np.repeat(rows, units.rows)
            edges, counts = walk(lat, starts, ends, seeds(keys, 0)[row_of], units.place - units.row_place[row_of])
            counts = np.bincount(row_of, counts, n).astype(np.int64)
            zero = np.zeros(n, np.int64)
            begin, rest, start, cell_seed = np.cumsum(counts) - counts, counts, Cells(bound, zero, np.zeros(n), zero), cell_seeds
        else:
            top = agenda.value.reshape(n, -1).argmax(axis=1)
            bound = agenda.value.reshape(n, -1)[np.arange(n), top]
            rows = np.flatnonzero(bound > -np.inf)
            if not len(rows):
                break
            edges, counts, begin, rest, start = _popped(units, starts, ends, last_unit, keys, agenda, taken, pool, at_pool, rows, *divmod(top[rows], most), draw)
            bound, cell_seed = bound[rows], seeds(keys, 2 * draw + 1)[rows]
        for held, best in zip(agenda, _cells(lat, edges, begin, rest, start, cell_seed, most), strict=True):
            held[rows, draw] = best
        at_pool[draw, rows] = len(pool) + np.cumsum(counts) - counts
        pool = np.concatenate([pool, edges])
        found.append((rows, edges, counts, _sums(lat.chance[edges], counts), bound))
    threshold = agenda.value.reshape(n, -1).max(axis=1)  # the next value is the threshold of the inclusion scores
    return [Draw(*x, _log_inclusion(x[3] - threshold[x[0]])) for x in found]


def _log_inclusion(x: np.ndarray) -> np.ndarray:
    """log(1 - exp(-exp(x))): a Gumbel variable of log mass x over the threshold exceeds it."""
    middle = np.log(-np.expm1(-np.exp(np.clip(x, -30.0, 30.0))))
    return np.where(x > 30, 0.0, np.where(x < -30, x, middle))


def _popped(units: Units, starts, ends, last_unit, keys, agenda: Cells, taken, pool, at_pool, rows, path, slot, draw: int):
    """Pop a cell of each of the rows: complete its best segmentation and put what is left of the cell back.

    Returns the new paths' edges with their numbers, where the new cells begin in them, how many edges they have
    from there, and what is before these."""
    lat = units.lat
    here = (rows, path, slot)
    value, at, before, place = (x[here] for x in agenda)
    picks, rests = seeds(keys, 2 * draw)[rows], seeds(keys, 3_000_017 + draw)[rows]
    unit = np.searchsorted(units.place, units.row_place[rows] + place, "right") - 1
    node = starts[unit] + (units.row_place[rows] + place - units.place[unit])
    parent = at_pool[path, rows]
    excluded = np.concatenate([pool[parent + at][:, None], taken[here]], axis=1)
    degree = lat.first[node + 1] - lat.first[node]
    nth = np.arange(int(degree.max()))
    options = lat.first[node][:, None] + nth
    free = (nth < degree[:, None]) & (options[:, :, None] != excluded[:, None, :]).all(axis=2)
    chance = np.where(free, np.exp(lat.chance[np.minimum(options, len(lat.chance) - 1)]), 0.0)
    upto = np.cumsum(chance, axis=1)
    drawn = uniform(picks, place) * upto[:, -1]
    index = np.minimum((upto <= drawn[:, None]).sum(axis=1), len(nth) - 1 - free[:, ::-1].argmax(axis=1))
    pick = options[np.arange(len(rows)), index]
    left = np.cumsum(np.where(nth == index[:, None], 0.0, chance), axis=1)[:, -1]
    with np.errstate(divide="ignore"):
        agenda.value[here] = _truncated(before + np.log(left), value, uniform(rests, at))
    taken[(*here, (excluded >= 0).sum(axis=1) - 1)] = pick
    # The units from the cell's on are walked anew, the first from the node behind the picked edge.
    step, sizes = lat.length[pick], last_unit[rows] - unit
    walked, heads = _ragged(unit, sizes), np.cumsum(sizes) - sizes
    node_from, position = starts[walked], units.place[walked] - np.repeat(units.row_place[rows], sizes)
    node_from[heads], position[heads] = node + step, place + step
    tail, counts = walk(lat, node_from, ends[walked], np.repeat(picks, sizes), position)
    rest = np.add.reduceat(counts, heads).astype(np.int64)
    total = at + 1 + rest
    begin = np.cumsum(total) - total
    edges = np.empty(int(total.sum()), np.int32)
    edges[_ragged(begin, at)] = pool[_ragged(parent, at)]
    edges[begin + at] = pick
    edges[_ragged(begin + at + 1, rest)] = tail
    return edges, total, begin + at + 1, rest, Cells(value, at + 1, before + lat.chance[pick], place + step)


class Sample(NamedTuple):
    edges: np.ndarray
    log_prob: float
    value: float
    log_inclusion: float


def sample(units: Units, keys: np.ndarray, k: int) -> list[list[Sample]]:
    """The draws row by row."""
    out: list[list[Sample]] = [[] for _ in units.rows]
    for d in draws(units, keys, k):
        for row, edges, *rest in zip(d.rows.tolist(), np.split(d.edges, np.cumsum(d.counts)[:-1]), d.log_prob.tolist(), d.value.tolist(), d.log_inclusion.tolist(), strict=True):
            out[row].append(Sample(edges, *rest))
    return out


def piece_ids(lat: Lattice, edges: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the edges, and how many each has; a character without a piece becomes its bytes."""
    ids, width = lat.id[edges], np.ones(len(edges), np.int64)
    wide = np.flatnonzero(ids < 0)
    if not len(wide):
        return ids, width
    of = np.searchsorted(lat.lone, edges[wide])
    size = lat.lone_size[of].astype(np.int64)
    width[wide] = size
    out = np.repeat(ids, width)
    first = (np.cumsum(width) - width)[wide]
    out[_ragged(first, size)] = vocab.byte_ids[lat.data[_ragged(lat.lone_at[of], size)]]
    return out, width


def decode(ids: list[int], vocab: Vocabulary) -> str:
    """The text of the ids; the space put before every text is taken off."""
    return b"".join([vocab.pieces[i] for i in ids]).decode()[1:]


def prefixed(column: pa.Array) -> pa.Array:
    """The texts with a space in front; null and empty ones stay empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return pc.if_else(pc.equal(pc.binary_length(column), 0), column, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), column, pa.scalar(" ", pa.large_string())))


SAMPLE_COLUMNS = "sample int, n_pieces int, ids array<int>, log_prob double, perturbed double, log_inclusion double"


def _sampled(vocab, k: int, alpha: float, key: str):
    def run(batches):
        for whole in batches:
            for batch in chunks(whole, 1, CHUNK):
                units = units_of(text_bytes(prefixed(batch.column(1))), vocab.value, alpha)
                for n, d in enumerate(draws(units, batch.column(2).to_numpy().view(np.uint64), k)):
                    ids, width = piece_ids(units.lat, d.edges, vocab.value)
                    sizes = _sums(width, d.counts)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(d.rows)), pa.array(np.full(len(d.rows), n + 1, np.int32)), pa.array(sizes.astype(np.int32)), list_array(pa.array(ids), sizes), *map(pa.array, (d.log_prob, d.value, d.log_inclusion))],
                        names=[key, "sample", "n_pieces", "ids", "log_prob", "perturbed", "log_inclusion"],
                    )

    return run


def sample_segmentations(docs: DataFrame, k: int = 3, alpha: float = 0.5, seed: int = 0, model: str = MODEL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Up to k distinct segmentations of each text: key, sample (1 to k by perturbed value), n_pieces, ids, log_prob (of the
    segmentation), perturbed, log_inclusion (log of the probability that it is among the first k, given the threshold).

    Draws depend on seed and key alone, so rows that repeat are sampled alike; null keys are one key. A null or
    empty text has one segmentation of no pieces. Every sample decodes to the whole text.
    A text is one row in and k rows out, so the longest must fit in a task, with about 60 bytes for each of its own.
    """
    small_batches(docs.sparkSession)
    vocab = docs.sparkSession.sparkContext.broadcast(load(model))  # a vocabulary: of fixed size
    rows = docs.select(F.col(key), F.col(text), F.xxhash64(F.lit(seed), F.col(key).cast("string")).alias("_key"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(tidy(_sampled(vocab, k, alpha, key)), f"`{key}` {kind}, {SAMPLE_COLUMNS}")
