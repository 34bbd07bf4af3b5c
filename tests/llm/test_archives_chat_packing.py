"""Web archives, chat formatting and packing."""

import base64
import hashlib
import io
import itertools
import random
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rangeloom.llm import chat, packing, warc
from rangeloom.llm.common import new_path


class Buffer(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def zipped(members, zip64=False):
    out = Buffer()
    w = warc.ZipWriter(out, zip64)
    for name, data in members:
        w.add(name, data)
    w.close()
    return out


@pytest.mark.parametrize("zip64", [False, True])
def test_directory(zip64):
    members = [("archive/a.warc.gz", b"x" * 1000), ("indexes/i.cdxj", b""), ("näme", b"yz")]
    out = zipped(members, zip64)
    found = warc.directory(out)
    assert [(m.name, m.size) for m in found] == [(n, len(d)) for n, d in members]
    for m, (_, d) in zip(found, members, strict=True):
        assert warc._at(out, warc.data_offset(out, m), m.size) == d
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as other:
        assert other.testzip() is None and other.namelist() == [n for n, _ in members]


def test_directory_of_other_writers_and_damage():
    raw = Buffer()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("archive/a", b"abc" * 100)
        z.writestr("archive/b", b"abc" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 a comment with the mark"
    found = warc.directory(raw)
    assert warc._at(raw, warc.data_offset(raw, found[0]), 300) == b"abc" * 100
    with pytest.raises(ValueError, match="stored"):
        warc.data_offset(raw, found[1])
    with pytest.raises(ValueError, match="not a ZIP"):
        warc.directory(Buffer(b"nothing here at all, no archive"))
    with pytest.raises(ValueError):
        list(warc.records(warc._record(1, "u", b"some payload", "A" * 32, None)[:-12]))


def test_ranges_join_neighbours_and_do_without_an_index():
    records = [warc._record(i, None, b"p" * i, warc.base32(hashlib.sha1(b"p" * i).hexdigest()), None) for i in range(5)]
    whole = zipped([("archive/d.warc.gz", b"".join(records))])
    (start, end), = warc.ranges(whole)
    assert [len(b) for _, b in warc.records(warc._at(whole, start, end - start))] and len(list(warc.records(warc._at(whole, start, end - start)))) == 5


@pytest.mark.parametrize("zip64", [False, True])
def test_pages_round_trip(spark, zip64):
    pages = [(1, "http://a/ü\r\nX: y", "<p>é</p>"), (2, None, None), (3, "u", ""), (4, "u", "<p>é</p>"), (4, "u", "<p>é</p>"), (None, "u", "<p>é</p>"), (6, "u", "z" * 300_000), (7, "", "one")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "'x' AS payload")
    rows = warc.read_archives(warc.write_archives(df, zip64)).collect()
    assert len(rows) == len(pages)
    by = {}
    for r in rows:
        by.setdefault(r.page_id, []).append(r)
    digest = lambda x: base64.b32encode(hashlib.sha1((x or "").encode()).digest()).decode()
    for i, url, html in pages:
        for r in by[i]:
            assert r.payload_digest == digest(html) and r.payload_bytes == len((html or "").encode()) and r.url == url
            if r.record_type == "response":
                assert r.refers_to is None and bytes(r.payload) == (html or "").encode()
    assert [r.record_type for r in by[4]] == ["response"] * 2 and by[1][0].refers_to == by[None][0].refers_to == 4
    assert by[2][0].refers_to == 3 and by[3][0].record_type == "response"
    assert warc.page_records(df.limit(0)).count() == 0


def test_small_payloads_need_not_be_shared(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    assert {r.record_type for r in warc.read_archives(warc.write_archives(df, at_least=3)).collect()} == {"response"}
    assert new_path(spark, "x").count("x-") == 1


PIECES = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "s>", "[", "/INST]", "a", "é", "\n"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "<s>"]), PIECES), min_size=1, max_size=5))
def test_template_is_reversible(turns):
    text, mask = chat.format_turns(turns)
    assert chat.parse_turns(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in zip(mask[::2], mask[1::2], strict=True)] == [t for r, t in turns if r == "assistant"]
    assert not any(c in chat.escape(t) for _, t in turns for c in (chat.OPEN, chat.CLOSE, chat.ROLE, chat.TEXT))


def test_branches_of_a_tree(spark):
    nodes = [("t", "r", None, "user", "hi", 0.0), ("t", "a", "r", "assistant", "A", 3.0), ("t", "b", "r", "assistant", "B", 5.0), ("t", "c", "a", "user", "more", 9.0), ("u", "x", "gone", "user", "alone", None), ("v", "p", "q", "user", "cycle", 0.0), ("v", "q", "p", "user", "cycle", 0.0)]
    df = spark.createDataFrame(nodes, "tree string, node string, parent string, role string, text string, score double")
    got = {(r.tree, r.branch): (r.leaf, chat.parse_turns(r.formatted)) for r in chat.format_trees(df).collect()}
    assert got == {("t", 1): ("c", [("user", "hi"), ("assistant", "A"), ("user", "more")]), ("t", 2): ("b", [("user", "hi"), ("assistant", "B")]), ("u", 1): ("x", [("user", "alone")])}
    assert chat.format_trees(df, branches=1).count() == 2


def test_long_conversations_and_odd_rows(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(70)] + [(2, 0, None, None), (2, 0, "assistant", "</s>"), (None, 0, "user", "n"), (3, 5, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS tree", "2 AS key")
    got = {r.conv_id: r for r in chat.conversation_digests(df).collect()}
    turns = "".join(f"{r}\n{t}\n" for _, _, r, t in rows[:70])
    assert got[1].n_turns == 70 and got[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256("".join(f"t{t}" for t in range(1, 70, 2)).encode()).hexdigest()
    assert got[2].n_turns == 2 and got[2].loss_chars == 4 and got[None].n_turns == 1 and got[3].loss_chars == 0
    assert chat.conversation_digests(df.limit(0)).count() == 0


def test_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(200):
        size = rng.choice([4, 16, 33])
        sizes = [rng.randint(1, size) for _ in range(rng.randrange(30))]
        plain: list[list[int]] = []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [(size - sum(sizes[j] for j in b) - sizes[i], -n) for n, b in enumerate(plain) if sum(sizes[j] for j in b) + sizes[i] <= size]
            if fits:
                room = min(fits)[0]
                candidates = [n for n, b in enumerate(plain) if size - sum(sizes[j] for j in b) - sizes[i] == room]
                plain[candidates[-1]].append(i)
            else:
                plain.append([i])
        got = packing.best_fit_decreasing(sizes, size)
        assert sorted(itertools.chain(*got)) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= size for b in got)
        assert len(got) == len(plain)


def test_packing_is_lossless(spark):
    docs = [(0, None), (1, ""), (2, "Hello  world\n"), (3, "日本語 " * 300), (3, "twice"), (None, "no id"), (5, "<|endoftext|> x")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS ids")
    encoding = packing.encoding_of(open(packing.RANKS, "rb").read())
    want, parts = {}, {}
    for i, t in docs:
        want.setdefault(i, []).append([*encoding.encode_ordinary(t or ""), packing.END_OF_TEXT])
    for r in packing.pack_documents(df, length=64).collect():
        ids, at = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == 64 and r.cu_seqlens[-1] == r.n_tokens <= 64
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert at[a:b].tolist() == list(range(b - a))
            parts.setdefault(doc, []).append((start, ids[a:b].tolist()))
    for i in want:
        if len(want[i]) == 1:
            assert [x for _, p in sorted(parts[i]) for x in p] == want[i][0]
    assert sum(len(p) for x in parts.values() for _, p in x) == sum(len(x) for w in want.values() for x in w)
    assert packing.pack_documents(df.limit(0)).count() == 0 and pa.__version__


def test_replies_in_a_cycle_are_in_no_path(spark):
    nodes = [("r", None), ("a", "r"), ("b", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("below", "x"), ("self", "self"), ("lost", "gone")]
    rows = [("t", n, p, "user", n, None) for n, p in nodes]
    df = spark.createDataFrame(rows, "tree string, node string, parent string, role string, text string, score double")
    assert sorted((r.leaf, r.node, r.up) for r in chat.paths(df).collect()) == [("b", "a", 1), ("b", "b", 0), ("b", "r", 2), ("lost", "lost", 0)]
    assert {r.leaf: [t for _, t in chat.parse_turns(r.formatted)] for r in chat.format_trees(df).collect()} == {"b": ["r", "a", "b"], "lost": ["lost"]}
    assert chat.format_trees(df.limit(0)).count() == 0


def test_long_runs_are_packed_whole(spark):
    """Runs of one kind of character that the pretoken pattern's matcher can't step back over."""
    tokenizer = packing.Tokenizer(open(packing.RANKS, "rb").read())
    rng = random.Random(1)
    for _ in range(20):
        text = "".join(rng.choice([" ", "\n", "\t", "　"]) * rng.choice([1, 2, 5000]) + rng.choice(["word", "", "9", "!?", "é"]) for _ in range(6))
        assert tokenizer.ids(text).tolist() == tokenizer.words.encode_ordinary(text)
        mixed = "".join(rng.choices(" \n\t ", k=6000)) + text
        assert tokenizer.ids(mixed).tolist() == tokenizer.words.encode_ordinary(mixed)
    docs = [("a", " " * 1_000_000 + "end"), ("b", "x" + "\n" * 1_000_000), ("c", "z" * 300_000), ("d", "?" * 300_000)]
    parts = {}
    for r in packing.pack_documents(spark.createDataFrame(docs, "doc_id string, text string")).collect():
        ids = np.frombuffer(r.ids, "<u2")
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            parts.setdefault(doc, []).append((start, ids[a:b].tolist()))
    for i, t in docs:
        ids = [x for _, p in sorted(parts[i]) for x in p]
        assert ids[-1] == packing.END_OF_TEXT and tokenizer.words.decode(ids[:-1]) == t
