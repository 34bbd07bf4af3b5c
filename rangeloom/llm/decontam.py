"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

The items are the stated query set. Their text is dealt into blocks of bounded size, long items
cut into overlapping pieces, and each block's automaton is broadcast to one narrow pass over the documents and
taken back before the next block's is built. Training tokens stream through the automaton; the longest match that ends
at each word is tracked, and words inside matched windows become spans. With several blocks, each pass saves
the spans of the texts in which it found some, by the text's digest, and their union is joined back.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Words, chunks, list_array, number_of, numbered, passed_through, saved, small_batches, text_bytes, tidy, without, words_of

#: Bytes of item text in one automaton, about; this bounds what is broadcast.
BLOCK_BYTES = 1 << 20


class ItemAutomaton:
    """Suffix automaton over the word ids of several items; no match runs over an item's end."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.arcs: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.window_items: dict[int, set[str]] = {}
        self.shortest = window
        texts = []
        for item, text in items:
            found = words_of(text_bytes(pa.array([text], pa.string())), ALNUM)
            distinct = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in found.distinct.to_pylist()]
            ids = [distinct[c] for c in found.codes.tolist()]
            if ids:
                texts.append((item, ids))
                self._add(ids)
        short: dict[int, list[tuple[int, str]]] = {}
        for item, ids in texts:
            if len(ids) < window:
                self.shortest = min(self.shortest, len(ids))
                short.setdefault(self._state_of(ids), []).append((len(ids), item))
            else:
                state = size = 0
                for word in ids:
                    state, size = self.step(state, size, word)
                    size = min(size, window)
                    state = self._suffix(state, size)
                    if size == window:
                        self.window_items.setdefault(state, set()).add(item)
        self.short_items = self._with_suffixes(short)

    def _add(self, ids: list[int]) -> None:
        last = 0
        for word in ids:
            last = self._extend(last, word)

    def _new(self, length: int, arcs: dict[int, int], link: int) -> int:
        self.arcs.append(arcs)
        self.length.append(length)
        self.link.append(link)
        return len(self.arcs) - 1

    def _split(self, state: int, via: int, word: int) -> int:
        """The state that holds only the strings of `via` reached from `state` at length + 1."""
        if self.length[via] == self.length[state] + 1:
            return via
        copy = self._new(self.length[state] + 1, dict(self.arcs[via]), self.link[via])
        self.link[via] = copy
        while state >= 0 and self.arcs[state].get(word) == via:
            self.arcs[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.arcs[last]:
            return self._split(last, self.arcs[last][word], word)
        new = self._new(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.arcs[last]:
            self.arcs[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, self.arcs[last][word], word)
        return new

    def _suffix(self, state: int, size: int) -> int:
        """The state of the suffix of that size."""
        while state and self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _state_of(self, ids: list[int]) -> int:
        state = 0
        for word in ids:
            state = self.arcs[state][word]
        return self._suffix(state, len(ids))

    def _with_suffixes(self, short: dict[int, list[tuple[int, str]]]) -> dict[int, list[tuple[int, str]]]:
        """For each state the short items that end where it ends."""
        found: dict[int, list[tuple[int, str]]] = {}
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            if here := short.get(state, []) + found.get(self.link[state], []):
                found[state] = here
        return found

    def step(self, state: int, size: int, word: int) -> tuple[int, int]:
        """The longest suffix of what was read, with word, that occurs in an item."""
        while word not in self.arcs[state]:
            if not state:
                return 0, 0
            state = self.link[state]
            size = self.length[state]
        return self.arcs[state][word], size + 1

    def matches(self, ids: list[int], spans: list[tuple[int, int]], items: set[str], offset: int) -> None:
        """Add the spans [first, end) of words inside matched windows, shifted by offset, and the items whose windows occur."""
        state = size = 0
        for at, word in enumerate(ids, offset + 1):
            state, size = self.step(state, size, word)
            hit = 0
            if size >= self.window:
                hit = self.window
                items |= self.window_items[self._suffix(state, hit)]
            for length, item in self.short_items.get(state, ()):
                if length <= size:
                    hit = max(hit, length)
                    items.add(item)
            if hit:
                first = at - hit
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, at))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def _found_in(automaton: ItemAutomaton, words: Words) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
    """Rows with matches. Only runs of words of the items, as long as the shortest window, are streamed: any other word leads back to the root."""
    known = np.array([automaton.vocabulary.get(w, -1) for w in words.distinct.to_pylist()], np.int64)
    if not len(known):
        return
    ids = known[words.codes]
    row_ends = np.cumsum(words.rows)
    inside = np.append(ids >= 0, False)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    at_row = row_ends[row_ends < len(ids)]
    starts[at_row] = inside[at_row]
    firsts = np.flatnonzero(starts)
    stops = np.flatnonzero(~inside)
    ends = np.minimum(stops[np.searchsorted(stops, firsts)], row_ends[np.searchsorted(row_ends, firsts, "right")] if len(firsts) else 0)
    long = ends - firsts >= automaton.shortest
    row_of = np.searchsorted(row_ends, firsts, "right")
    row, spans, items = -1, [], set()
    for first, end, of in zip(firsts[long].tolist(), ends[long].tolist(), row_of[long].tolist(), strict=True):
        if of != row:
            if spans:
                yield row, spans, items
            row, spans, items = of, [], set()
        automaton.matches(ids[first:end].tolist(), spans, items, first - int(row_ends[of] - words.rows[of]))
    if spans:
        yield row, spans, items


#: Columns that find_spans adds.
SPANS = ["_dc_words", "_dc_spans", "_dc_items"]
_FOUND = "words long, spans array<int>, items array<string>"


def _pass(automaton, names: list[str], hits_only: bool):
    """Of batches whose first column is a text: the columns `names` with the text's words, flat spans and items; with hits_only no other rows than those with spans."""

    def run(batches):
        for whole in batches:
            for batch in chunks(whole, 0):
                words = words_of(text_bytes(batch.column(0)), ALNUM)
                spans: list[list[tuple[int, int]]] = [[] for _ in range(batch.num_rows)]
                items: list[set[str]] = [set() for _ in range(batch.num_rows)]
                for row, more, of in _found_in(automaton.value, words):
                    spans[row], items[row] = _merged(more), of
                flat = [x for row in spans for span in row for x in span]
                found = passed_through(
                    batch.select(names),
                    {
                        "words": pa.array(words.rows, pa.int64()),
                        "spans": list_array(pa.array(flat, pa.int32()), np.array([2 * len(s) for s in spans])),
                        "items": pa.array([sorted(s) for s in items], pa.list_(pa.string())),
                    },
                )
                yield found.filter(pa.array([bool(s) for s in spans])) if hits_only else found

    return run


def _pieces(window: int, limit: int):
    """Items in pieces of about limit bytes that overlap by a window less one word, so that each window is whole in one of them."""

    def run(batches):
        for batch in batches:
            names, texts = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None or len(text) <= limit // 4:
                    names.append(name)
                    texts.append(text)
                    continue
                raw = text.encode()
                words = words_of(text_bytes(pa.array([raw], pa.binary())), ALNUM)
                first, n = 0, len(words.starts)
                while first < n:
                    last = max(min(n, first + window), int(np.searchsorted(words.ends, words.starts[first] + limit, "right")))
                    names.append(name)
                    texts.append(raw[words.starts[first] : words.ends[last - 1]].decode())
                    first = n if last == n else last - window + 1
            yield pa.RecordBatch.from_pydict({"item": pa.array(names, pa.string()), "text": pa.array(texts, pa.string())})

    return run


def _union(spans: F.Column) -> F.Column:
    """Flat, disjoint, sorted spans of an array of flat spans."""
    pairs = F.array_sort(F.flatten(F.transform(spans, lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - 2, F.lit(2)), lambda i: F.struct(F.get(x, i).alias("first"), F.get(x, i + 1).alias("end"))))))

    def put(done, span):
        last = F.get(done, F.size(done) - 1)
        apart = (F.size(done) == 0) | (last < span["first"])
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.greatest(last, span["end"])))
        return F.when(apart, F.concat(done, F.array(span["first"], span["end"]))).otherwise(joined)

    return F.aggregate(pairs, F.array().cast("array<int>"), put)


def _blocks(items: DataFrame, window: int) -> tuple[DataFrame, int]:
    """The items' pieces with their block, and the number of blocks; a block has about BLOCK_BYTES of text."""
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.lit(16)), F.lit(0))).first()[0]
    blocks = -(-total // BLOCK_BYTES) or 1
    if blocks == 1:
        return items.withColumn("block", F.lit(0)), 1
    pieces = items.mapInArrow(_pieces(window, BLOCK_BYTES // 4), "item string, text string")
    return saved(pieces.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)).cast("int")), "items"), blocks


class _Search:
    """A search of documents for items. Rows have numbered columns, `body` is the text's."""

    def __init__(self, docs: DataFrame, items: DataFrame, window: int, text: str, item_id: str, item_text: str):
        small_batches(docs.sparkSession)
        self.spark, self.window, self.rows, self.body = docs.sparkSession, window, numbered(docs), number_of(docs, text)
        self.items, self.blocks = _blocks(items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")), window)

    def automaton(self, block: int) -> Broadcast:
        part = [(r["item"] or "", r["text"]) for r in self.items.where(F.col("block") == block).collect()]  # a block of bounded size
        return self.spark.sparkContext.broadcast(ItemAutomaton(sorted(part, key=lambda r: (r[0], r[1] or "")), self.window))

    def passed(self, of: DataFrame, automaton: Broadcast, names: list[str], hits_only: bool) -> DataFrame:
        """The columns `names` of the rows, with words, spans and items, after one block's pass."""
        kinds = dict(of.dtypes)
        sent = of.select(self.body, *(c for c in names if c != self.body))
        return sent.mapInArrow(tidy(_pass(automaton, names, hits_only)), ", ".join([*(f"`{c}` {kinds[c]}" for c in names), _FOUND]))

    def joined(self) -> DataFrame:
        """The rows with the spans and items of all blocks: block by block, each automaton taken back before the next."""
        keyed, hits = self.rows.withColumn("digest", F.md5(self.body)), []
        for block in range(self.blocks):
            automaton = self.automaton(block)
            found = self.passed(keyed, automaton, ["digest"], True)
            hits.append(saved(found.dropDuplicates(["digest"]).select("digest", "spans", "items"), "hits"))
            automaton.destroy()
        whole = reduce(DataFrame.unionByName, hits).groupBy("digest").agg(F.collect_list("spans").alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        none = lambda kind: F.array().cast(f"array<{kind}>")
        out = keyed.join(saved(whole.select("digest", _union(F.col("spans")).alias("spans"), "items"), "hits"), "digest", "left")
        return out.withColumns({"words": word_count(F.col(self.body)), "spans": F.coalesce("spans", none("int")), "items": F.coalesce("items", none("string"))})


def find_spans(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents with _dc_words (words of the text), _dc_spans (flat first, end word positions of hit runs) and _dc_items (ids, as strings, of items with occurring windows).

    Words are runs of 0-9, a-z and characters beyond ASCII after A-Z is lower-cased. A
    window is `window` consecutive item words; an item of fewer, but at least one, is one
    window. Null or empty texts have no words, items without words are ignored, an item
    without an id never counts (its words do), repeated rows are each searched. Columns of the documents with the names of the added ones give way.
    """
    search = _Search(docs, items, window, text, item_id, item_text)
    out = search.joined() if search.blocks > 1 else search.passed(search.rows, search.automaton(0), search.rows.columns, False)
    named = [F.col(number_of(docs, c)).alias(c) for c in without(docs.columns, SPANS)]
    return out.select(*named, F.col("words").alias("_dc_words"), F.col("spans").alias("_dc_spans"), F.array_remove("items", "").alias("_dc_items"))


#: Words as in common.ALNUM.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def word_count(text: F.Column) -> F.Column:
    """Words of a text, a null one has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def span_words() -> F.Column:
    """Words inside the spans."""
    return F.aggregate(
        F.transform("_dc_spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x
    )


def _cut_out(raw: bytes, starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]], longest: int) -> str:
    """The text without its spans of at least `longest` words; starts and ends are the words' byte positions in it."""
    kept, at = [], 0
    for first, end in spans:
        if end - first >= longest:
            kept.append(raw[at : starts[first]])
            at = int(ends[end - 1])
    return b"".join([*kept, raw[at:]]).decode()


def _cleaned(spans_of, longest: int, coverage: float):
    """Batches whose first column is a text, without the rows that are mostly spans and with the spans of others cut out. spans_of: (batch, its words) to (row, spans)."""

    def run(batches):
        for whole in batches:
            for batch in chunks(whole, 0):
                text = text_bytes(batch.column(0))
                words = words_of(text, ALNUM)
                last = np.cumsum(words.rows)
                keep, column = np.ones(batch.num_rows, bool), None
                for row, spans in spans_of(batch, words):
                    if sum(end - first for first, end in spans) > coverage * words.rows[row]:
                        keep[row] = False
                        continue
                    column = column or batch.column(0).to_pylist()
                    own, at = slice(last[row] - words.rows[row], last[row]), text.offsets[row]
                    column[row] = _cut_out(text.data[at : text.offsets[row + 1]].tobytes(), words.starts[own] - at, words.ends[own] - at, spans, longest)
                done = batch if column is None else batch.set_column(0, batch.schema.names[0], pa.array(column, pa.string()))
                yield done if keep.all() else done.filter(pa.array(keep))

    return run


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, longest: int = 1, coverage: float = 0.5, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without test items: spans of at least `longest` hit words are cut out of the text, and documents with more than `coverage` of their words in hit spans are dropped. Other rows and columns stay as they are."""
    search = _Search(docs, items, window, text, item_id, item_text)
    rows, body, kinds = search.rows, search.body, dict(search.rows.dtypes)
    others = [c for c in rows.columns if c != body]
    if search.blocks == 1:  # spans are found and cut in one pass
        automaton, sent = search.automaton(0), rows.select(body, *others)
        run = _cleaned(lambda _, words: ((row, _merged(spans)) for row, spans, _ in _found_in(automaton.value, words)), longest, coverage)
    else:
        sent = search.joined().select(body, *others, F.col("spans").alias("spans"))
        found = lambda batch, _: ((row, list(zip(flat[::2], flat[1::2], strict=True))) for row, flat in enumerate(batch.column(batch.num_columns - 1).to_pylist()) if flat)
        run = _cleaned(found, longest, coverage)
        kinds["spans"] = "array<int>"
    out = sent.mapInArrow(tidy(run), ", ".join(f"{c} {kinds[c]}" for c in sent.columns))
    return out.select(*rows.columns).toDF(*docs.columns)


def contamination_report(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 of the item ids sorted as strings and comma-joined, contaminated."""
    found = find_spans(docs.select("doc_id", "text"), items, window)
    hit = span_words()
    return found.select(
        "doc_id",
        F.col("_dc_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("_dc_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_dc_items"), ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
