"""Quality rules, decontamination, line dedup, near-duplicates, sharding: against brute force, and on odd inputs."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rangeloom.llm import decontam, linededup, neardup, quality, sharding
from rangeloom.llm.common import saved

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def odd_texts(seed=0, n=40):
    rng = random.Random(seed)
    vocab = ["the", "The", "a", "é", "x9", "#", "ok.", "zz", "q|q", "日本"]
    texts = [None, "", " ", "\n\n", "one", "A b\tc\x0bd", "x " * 500, "same line here\nsame line here\nother"]
    for _ in range(n):
        texts.append("".join(rng.choice(vocab) + rng.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(rng.randrange(60))))
    return texts + texts[8:12]


def brute_rules(text):
    w, t = words(text), text or ""
    keys = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if keys[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_document_rules(spark):
    texts = odd_texts()
    df = documents(spark, [(i, t, None if i % 7 == 0 else f"s{i % 3}") for i, t in enumerate(texts)]).withColumn("base_failed2", F.lit(1)).withColumn("n", F.lit("x"))
    got = {r.doc_id: r for r in quality.quality_verdicts(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(t)
        assert not (r.base_failed and r.kept)
    assert quality.quality_verdicts(df.limit(0)).count() == 0


def test_hosts_that_mostly_fail_are_rejected(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(i, good, f"h{i % 20}") for i in range(400)] + [(1000 + i, "bad", "spam") for i in range(50)] + [(2000, good, "spam"), (2001, good, "small"), (2002, "bad", "small2"), (2003, good, None)]
    kept = {r.doc_id for r in quality.keep_good(documents(spark, rows)).collect()}
    assert 2000 not in kept and {2001, 2003} <= kept and set(range(400)) <= kept and 2002 not in kept
    assert quality.keep_good(documents(spark, rows)).columns == [c.split()[0] for c in SCHEMA.split(", ")]


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute_hits(text, items, window):
    w, hit, ids = alnum(text), set(), set()
    for item, t in items:
        v = alnum(t)
        n = min(window, len(v))
        for k in {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == k:
                    hit |= set(range(i, i + n))
                    ids.add(str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("seed,block", [(1, 1 << 20), (2, 100)])
def test_decontamination(spark, monkeypatch, seed, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("ABCdé") for _ in range(n))
    items = [(i, text(rng.randrange(8))) for i in range(12)] + [(12, None), (13, ""), (14, "a b"), (15, "b c d A, b-c")]
    docs = [(i, text(rng.randrange(30)).replace(" ", rng.choice([" ", ", ", "\n"]))) for i in range(40)] + [(40, None), (41, ""), (42, "zz " * 300 + "a b")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontam.contamination_report(df, bench, window=4).collect()}
    for i, t in docs:
        assert got[i] == brute_hits(t, items, 4), (i, t)
    assert decontam.contamination_report(df.limit(0), bench).count() == 0
    assert decontam.contamination_report(df, bench.limit(0)).where("contaminated").count() == 0


def test_spans_are_cut_and_full_copies_dropped(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"before it, {item}. after that one"), (2, item), (3, "clean"), (4, None), (5, "x " * 40 + item.upper() + " y")], "doc_id long, text string")
    kept = {r.doc_id: r.text for r in decontam.decontaminate(docs.withColumn("item", F.lit(1)), spark.createDataFrame([(7, item)], "item_id long, text string"), coverage=0.8).collect()}
    assert kept == {1: "before it, . after that one", 3: "clean", 4: None, 5: "x " * 40 + " y"}


def brute_lines(docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    holders = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        out[i] = [x for x in lines if not (len(holders[key(x)]) > 1 and min(holders[key(x)]) != i)]
    return out


def line_docs(seed, n=40):
    rng = random.Random(seed)
    pool = ["A shared line of text", " a shared line OF text\t", "short", "", "éééééééééé", "another shared line", *(f"line number {i} here" for i in range(15))]
    return [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(9)))) for i in range(n)] + [(n, None), (n + 1, "")]


def test_line_dedup(spark):
    docs = line_docs(3)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit("k")).withColumn("_n", F.lit(1))
    got = {r.doc_id: r for r in linededup.dedup_lines(df).collect()}
    for i, lines in brute_lines(docs).items():
        assert got[i].text == "\n".join(lines) and got[i]._n_dropped == got[i]._n_lines - len(lines)
    report = {r.doc_id: r for r in linededup.line_report(df).collect()}
    assert report[0].kept_sha256 == hashlib.sha256("\n".join(brute_lines(docs)[0]).encode()).hexdigest()
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def state(index):
    filters = {r.shard: len(linededup.CuckooFilter.from_bytes(bytes(r["filter"]))) for r in index.filters.collect()}
    return sorted(map(tuple, ((bytes(r.key), r.n, r.lo, r.hi) for r in index.refs.collect()))), {k: v for k, v in filters.items() if v}


def test_line_index_is_reversible(spark):
    docs = line_docs(4, 30)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    first, rest = df.where("doc_id % 3 <> 0"), df.where("doc_id % 3 = 0")
    index = linededup.LineIndex(spark, shards=3).insert(first)
    before = state(index)
    index.insert(rest)
    assert {r.doc_id: r.text for r in index.apply(df).collect()} == {i: "\n".join(x) for i, x in brute_lines(docs).items()}
    index.delete(rest)
    assert state(index) == before


def test_cuckoo_filter():
    rng = random.Random(5)
    keys = [rng.getrandbits(64) for _ in range(3000)]
    f = linededup.CuckooFilter(4)
    for k in keys:
        f.add(k)
    f = linededup.CuckooFilter.from_bytes(f.to_bytes())
    assert len(f) == 3000 and all(k in f for k in keys)
    for k in keys[:2900]:
        assert f.discard(k)
    assert all(k in f for k in keys[2900:]) and len(f) == 100
    assert sum(rng.getrandbits(64) in f for _ in range(5000)) < 50


def shingles(text, k):
    w = words((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(docs, k, percent):
    sets, top = {i: shingles(t, k) for i, t in docs}, {i: i for i, _ in docs}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in docs}, {i: len(s) for i, s in sets.items()}


def near_docs(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs, i = [(0, None), (1, ""), (2, "one two"), (3, "ONE two"), (4, "solo")], 10
    for family in range(6):
        base = [word() for _ in range(rng.choice([8, 60, 200]))]
        for _ in range(rng.choice([1, 3, 25])):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = word()
            docs.append((i, " ".join(copy)))
            i += rng.randrange(1, 4)
            if rng.random() < 0.2:
                docs.append((i, " ".join(copy).upper()))
                i += 1
            base = copy if rng.random() < 0.3 else base
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    docs = near_docs(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("node", F.lit("x"))
    got = {r.doc_id: r for r in neardup.NearDuplicates(4, 80).find(df).collect()}
    top, sizes = brute_components(docs, 4, 80)
    assert {i: r.component_id for i, r in got.items()} == top
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_near_duplicates_of_nothing_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.NearDuplicates().find(empty).count() == 0
    twice = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (6, "a b c d e f"), (None, "a b c d e f"), (None, "other words here")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id) for r in neardup.NearDuplicates().find(twice).collect() if r.component_id) == [(-1, 5), (5, 5), (5, 5), (6, 5)]
    assert sorted(r.doc_id or -1 for r in neardup.drop_near_duplicates(twice).collect()) == [-1, -1, 5, 5]


def test_sketches():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 300, 3000):
        items = rng.integers(0, 2**63, n, dtype=np.uint64)
        assert (neardup.sketch(items) == neardup.sketch(rng.permutation(items))).all()
        assert neardup.sketch(items).max() < 2**63  # every coordinate is filled
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:889], rng.integers(0, 2**63, 111, dtype=np.uint64)])  # similarity 0.8
    same = (neardup.sketch(a) == neardup.sketch(b)).mean()
    assert abs(same - 0.8) < 0.15
    for level in (0, 1):
        x, y = neardup.parity_sketch(a, level), neardup.parity_sketch(b, level)
        assert sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= 222


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 105), (105, 103), (200, 201)]
    got = {r.node: r.component for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 103: 100, 105: 100, 200: 200, 201: 200}


def test_shards(spark):
    rng = random.Random(1)
    texts = ["x" * rng.randrange(200) for _ in range(300)] + ["é" * 50] * 40 + [None] * 5 + [""] * 3
    df = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    rows = sharding.shard_documents(df, 5).collect()
    assert len(rows) == len(texts)
    loads, slots, places = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        t = texts[r.doc_id]
        raw = (t or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        if t is not None:
            places[t].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(p) == 1 for p in places.values())
    assert max(loads.values()) - min(loads.values()) < 0.02 * sum(loads.values())
    assert sorted(map(tuple, rows), key=lambda r: r[0]) == sorted(map(tuple, sharding.shard_documents(df.repartition(3), 5).collect()), key=lambda r: r[0])
    assert sharding.shard_documents(df.limit(0), 5).count() == 0


def test_schedule_is_longest_first():
    assert sharding.schedule([("a", 7), ("b", 7), ("c", 6), ("d", 6), ("e", 5), ("f", 5), ("g", 4), ("h", 4), ("i", 4)], 4) == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 2, "f": 3, "g": 0, "h": 1, "i": 0}


def test_saved_tables_keep_their_schema(spark):
    df = spark.createDataFrame([(1, None)], "a long, b string")
    assert saved(df, "t").schema == df.schema and pa.__version__


def test_sharding_spreads_null_texts(spark):
    docs = [(i, None if i % 3 else f"text {i}") for i in range(3000)]
    rows = sharding.shard_documents(spark.createDataFrame(docs, "doc_id long, text string"), 5).collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    sizes, nulls = [0] * 5, [0] * 5
    for r in rows:
        sizes[r.shard] += r.size
        nulls[r.shard] += r.doc_id % 3 > 0
    assert max(sizes) - min(sizes) <= 100 and max(nulls) < 2 * 2000 / 5
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows))) for s in range(5))


#: Names that the operators use inside, or add.
CLASHING = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept _host _words _failed _rejected _row words c0 c1 held drop key shard _n_lines _n_dropped _drop _id _dc_words _dc_spans _dc_items spans items digest gone _gone component node n bands sig".split()


def clashing(df):
    return df.select("*", *(F.concat(F.lit(f"{c}-"), F.col("doc_id")).alias(c) for c in CLASHING))


def test_stages_keep_clashing_columns(spark):
    good = lambda i: " ".join(f"word{i}x{j}" for j in range(30))
    item = " ".join(f"item{j}" for j in range(12))
    rows = [(i, good(i), f"h{i % 3}") for i in range(6)] + [(6, good(2), "h1"), (7, "short", "h1"), (8, f"{good(8)} {item}", "h0"), (9, None, None), (10, f"{good(10)}\n{good(3)}", "h0")]
    docs = clashing(documents(spark, rows))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    stages = {
        "quality": (quality.keep_good(docs), {7, 9}),
        "lines": (linededup.dedup_lines(docs, counts=False), set()),
        "near": (neardup.drop_near_duplicates(docs), {6}),
        "decontamination": (decontam.decontaminate(docs, bench), set()),
    }
    for name, (out, gone) in stages.items():
        assert out.dtypes == docs.dtypes, name
        got = {r.doc_id: r for r in out.collect()}
        assert set(got) == set(range(11)) - gone, name
        assert all(r[c] == f"{c}-{i}" for i, r in got.items() for c in CLASHING), name
    assert {r.doc_id: r.text for r in stages["decontamination"][0].collect()}[8] == f"{good(8)} "
    assert {r.doc_id: r.text for r in stages["lines"][0].collect()}[10] == good(10)


def test_operators_replace_clashing_columns(spark):
    docs = clashing(documents(spark, [(1, "a b c " * 10, "h"), (2, None, "h"), (2, None, "h")]))
    verdicts = quality.quality_verdicts(docs).collect()
    assert sorted(r.n_words for r in verdicts) == [0, 0, 30] and all(r.base_failed and not r.kept and r["_row"] == f"_row-{r.doc_id}" for r in verdicts)
    assert all(r["_n_lines"] == 1 and r["_drop"] == f"_drop-{r.doc_id}" for r in linededup.dedup_lines(docs).collect())
    spans = decontam.find_spans(docs, spark.createDataFrame([(1, "b c")], "item_id long, text string"), window=2).collect()
    assert sorted(r["_dc_words"] for r in spans) == [0, 0, 30] and all(r.spans == f"spans-{r.doc_id}" for r in spans)


def test_quality_of_a_host_column_that_gives_way(spark):
    rows = [(i, "bad", "x") for i in range(40)] + [(40, " ".join(f"w{i}" for i in range(30)), "x")] + [(50 + i, " ".join(f"v{i}{j}" for j in range(30)), f"y{i}") for i in range(30)]
    docs = documents(spark, rows).withColumnRenamed("source", "kept")
    assert {r.doc_id for r in quality.quality_verdicts(docs, host="kept").collect() if r.kept} == set(range(50, 80))


def test_long_texts_and_repeated_rows(spark):
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(5000)) for _ in range(300_000))
    lines = "\n".join(long[i : i + 60] for i in range(0, len(long), 60))
    rows = [(1, long, "a"), (1, long, "a"), (2, lines, "b"), (3, lines, "b"), (4, "x" * 3_000_000, "c"), (5, "word " * 30, "c"), (5, "word " * 30, "c")]
    df = documents(spark, rows)
    got = sorted(tuple(r) for r in quality.quality_verdicts(df).select("doc_id", *quality.RULES).collect())
    assert got == sorted((i, *brute_rules(t)) for i, t, _ in rows)
    kept = sorted((r.doc_id, r._n_lines, r._n_dropped) for r in linededup.dedup_lines(df).collect())
    n = lines.count("\n") + 1
    assert [k[:2] for k in kept] == [(1, 1), (1, 1), (2, n), (3, n), (4, 1), (5, 1), (5, 1)] and kept[3][2] >= n - 1 and all(k[2] == 0 for k in kept if k[0] != 3)
    item = " ".join(long.split()[1000:1020])
    spans = {r.doc_id: r for r in decontam.contamination_report(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert spans[1].n_words == 300_000 and spans[1].n_hit == 20 and spans[4].n_words == 1 and not spans[5].contaminated
    near = sorted((r.doc_id, r.component_id, r.n_shingles) for r in neardup.NearDuplicates(4, 80).find(df).collect())
    assert [x[:2] for x in near] == [(1, 1), (1, 1), (2, 2), (3, 2), (4, 4), (5, 5), (5, 5)] and near[0][2] == len(shingles(long, 4))
    sizes = sorted((r.doc_id, r["size"]) for r in sharding.shard_documents(df, 4).collect())
    assert sizes == sorted((i, len(t) + 8) for i, t, _ in rows)


def test_benchmark_of_many_blocks(spark, monkeypatch):
    """Items in many blocks, one of them longer than a block."""
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 2000)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 20, 40])))) for i in range(60)] + [(99, " ".join(word() for _ in range(2500)))]
    docs = [(i, " ".join([word(), word(), *rng.choice(items)[1].split()[rng.randrange(3) :][:30], word()])) for i in range(50)]
    huge = items[-1][1].split()
    docs += [(60 + i, " ".join(huge[i * 100 : i * 100 + 60])) for i in range(20)] + [(90, None), (91, docs[0][1]), (91, docs[0][1])]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in decontam.contamination_report(df, bench).collect())
    assert got == sorted((i, *brute_hits(t, items, 10)) for i, t in docs)


def test_cuckoo_filter_takes_out_look_alikes():
    for seed in range(4):
        rng, f, held = random.Random(seed), linededup.CuckooFilter(4), set()
        for step in range(4000):
            if held and rng.random() < 0.45:
                k = rng.choice(sorted(held))
                assert f.discard(k)
                held.remove(k)
            else:  # few fingerprints in few buckets
                k = (rng.randrange(1, 1 + 3 ** (seed + 1)) << 48) | (rng.getrandbits(30) << 16) | rng.randrange(256)
                if k not in held:
                    f.add(k)
                    held.add(k)
            if step % 500 == 0:
                f = linededup.CuckooFilter.from_bytes(f.to_bytes())
                assert all(k in f for k in held) and len(f) == len(held)


def test_line_index_is_laid_out_anew(spark, monkeypatch):
    monkeypatch.setattr(linededup.LineIndex, "ROWS", 20)
    docs = [(i, "\n".join(f"line of text number {j}" for j in range(i, i + 12))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = linededup.LineIndex(spark, shards=1).insert(df.where("doc_id < 2"))
    before = state(index)[0]
    index.insert(df.where("doc_id >= 2"))
    assert index.shards > 10 and {r.doc_id: r.text for r in index.apply(df).collect()} == {i: "\n".join(x) for i, x in brute_lines(docs).items()}
    index.delete(df.where("doc_id >= 2"))
    assert state(index)[0] == before and sum(state(index)[1].values()) == len(before)


def test_deal_is_the_heap_step_by_step():
    rng = random.Random(4)
    for _ in range(300):
        shards, loads = rng.randrange(1, 7), []
        loads = [rng.randrange(40) for _ in range(shards)]
        size, count = rng.randrange(0, 9), rng.randrange(0, 60)
        want, now = [0] * shards, list(loads)
        for _ in range(count):
            i = now.index(min(now))
            want[i], now[i] = want[i] + 1, now[i] + size
        assert sharding.deal(loads, size, count) == want


@pytest.mark.parametrize("seed,shards", [(1, 3), (2, 24), (3, 5)])
def test_shards_are_those_of_the_heap_over_all_groups(spark, seed, shards):
    rng = random.Random(seed)
    texts = [rng.choice([None, "", "a" * rng.randrange(60), chr(97 + rng.randrange(26)) * rng.randrange(4), "é" * rng.randrange(9)]) for _ in range(400)]
    texts += ["copies of one text"] * 150 + ["word " * rng.randrange(2000) for _ in range(10)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 5
    rows = sharding.shard_documents(spark.createDataFrame(docs, "doc_id long, text string"), shards).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in docs)
    groups, text_of = Counter(), dict(docs)
    for n, (i, t) in enumerate(docs):
        groups[(1, n) if t is None else (0, t)] += len((t or "").encode()) + 8
    numbered = {g: i for i, g in enumerate(groups)}
    at = sharding.schedule([(numbered[g], s) for g, s in groups.items()], shards)
    want, got = Counter(), Counter()
    for g, s in groups.items():
        want[at[numbered[g]]] += s
    where = defaultdict(set)
    for r in rows:
        got[r.shard] += r["size"]
        where[text_of[r.doc_id]].add(r.shard)
    assert got == want  # groups of one size are alike: the loads are those of the schedule
    assert all(len(s) == 1 for t, s in where.items() if t is not None)
    for s in range(shards):
        mine = sorted((r.slot, r.doc_id) for r in rows if r.shard == s)
        assert [m[0] for m in mine] == list(range(len(mine))) and [m[1] for m in mine] == sorted(m[1] for m in mine)


def test_spans_are_cut_alike_with_many_blocks(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(15))) for i in range(40)]
    docs = [(i, f"{word()} É, {rng.choice(items)[1]}! {' '.join(word() for _ in range(rng.randrange(40)))}\n{rng.choice(items)[1][:30]}") for i in range(40)] + [(50, None), (51, "")]
    df, bench = documents(spark, [(i, t, "s") for i, t in docs]), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(decontam.decontaminate(df, bench).collect(), key=lambda r: r.doc_id)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 500)
    assert sorted(decontam.decontaminate(df, bench).collect(), key=lambda r: r.doc_id) == one
    assert 2 <= len(one) < 42 and any(r.text != dict(docs)[r.doc_id] for r in one)
