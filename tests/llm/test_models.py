"""Sampled segmentations, language model and the corpus pipeline."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rangeloom.llm import langmodel, segments
from rangeloom.llm.common import NOT_SPACE, text_bytes, words_of

TINY = [("▁", 3), ("▁a", 4), ("a", 5), ("b", 6), ("ab", 7), ("ba", 8), ("▁▁", 9), ("aba", 10)]


@pytest.fixture(scope="module")
def tiny():
    return segments.vocabulary(TINY, 300, list(range(20, 276)))


def everything(text, vocab, alpha):
    """All segmentations with their probabilities, by brute force."""
    marked = text.replace(" ", "▁")
    ids = dict(TINY)

    def walk(at):
        if at == len(marked):
            yield (), 0.0
        for end in range(at + 1, len(marked) + 1):
            if (id_ := ids.get(marked[at:end])) is not None:
                head, w = (id_,), vocab.weight[id_]
            elif end == at + 1 and marked[at] not in ids:
                head = tuple(vocab.byte_ids[list(text[at].encode())].tolist())
                w = vocab.byte_weight * len(head)
            else:
                continue
            for rest, v in walk(end):
                yield head + rest, alpha * w + v

    found = dict(walk(0))
    total = math.log(sum(map(math.exp, found.values())))
    return {k: math.exp(v - total) for k, v in found.items()}


def drawn(texts, keys, vocab, k, alpha=0.7):
    units = segments.units_of(text_bytes(segments.prefixed(pa.array(texts, pa.string()))), vocab, alpha)
    found = segments.sample(units, np.asarray(keys, np.uint64), k)
    return [[(tuple(segments.piece_ids(units.lat, s.edges, vocab)[0].tolist()), s) for s in row] for row in found]


def test_samples_follow_the_distribution(tiny):
    n, text = 20_000, "aba  b"
    chances = everything(" " + text, tiny, 0.7)
    rows = drawn([text] * n, np.arange(n) * 7919, tiny, 2)
    first, second = Counter(r[0][0] for r in rows), Counter(r[1][0] for r in rows)
    for ids, p in chances.items():
        assert abs(first[ids] / n - p) < 0.015
        q = sum(o * p / (1 - o) for other, o in chances.items() if other != ids)
        assert abs(second[ids] / n - q) < 0.015
    weights = [sum(math.exp(s.log_prob - s.log_inclusion) for _, s in r) for r in rows]
    assert abs(np.mean(weights) - 1) < 0.03  # inverse inclusion weighting is unbiased
    assert all(abs(math.exp(s.log_prob) - chances[ids]) < 1e-9 for r in rows[:200] for ids, s in r)


def test_all_segmentations_come_out_once(tiny):
    for text in ("ab", "aba b", "a\na", "z", " "):
        chances = everything(" " + text, tiny, 0.7)
        (row,) = drawn([text], [3], tiny, len(chances) + 5)
        assert {ids for ids, _ in row} == set(chances) and len(row) == len(chances)
        assert [s.value for _, s in row] == sorted((s.value for _, s in row), reverse=True)
        assert all(s.log_inclusion == 0 for _, s in row)


def test_draws_depend_on_the_key_alone(tiny):
    rng = random.Random(0)
    texts = ["".join(rng.choice("ab é\n▁") for _ in range(rng.randrange(50))) for _ in range(30)]
    whole = drawn(texts, range(30), tiny, 3)
    for i in (0, 7, 29):
        assert [ids for ids, _ in drawn([texts[i]], [i], tiny, 3)[0]] == [ids for ids, _ in whole[i]]
        assert all(segments.decode(list(ids), tiny) == texts[i] for ids, _ in whole[i])


def test_segmentations_query(spark):
    docs = [(1, None), (2, ""), (3, "Hello  world\n\nagain ▁ 日本 👍"), (3, "Hello  world\n\nagain ▁ 日本 👍"), (None, "x"), (4, "long " * 3000), (5, "z" * 5000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS ids", "'k' AS _k")
    rows = segments.sample_segmentations(df, k=2).collect()
    vocab, texts = segments.load(), {i: t or "" for i, t in docs}
    assert all(segments.decode(r.ids, vocab) == texts[r.doc_id] and r.n_pieces == len(r.ids) for r in rows)
    assert Counter(r.doc_id for r in rows) == {1: 1, 2: 1, 3: 4, None: 2, 4: 2, 5: 2}
    three = sorted((r.sample, r.ids) for r in rows if r.doc_id == 3)
    assert three[0] == three[1] and three[2] == three[3] and three[0] != three[2]
    assert segments.sample_segmentations(df.limit(0)).count() == 0


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower()) + ["\n"]


def brute_model(train, least, order):
    """Counts and probability function by dictionaries."""
    counts = [Counter() for _ in range(order + 1)]
    for t in train:
        seq = tokens(t)
        counts[1].update((w,) for w in seq)
        padded = ["\n", *seq]
        for k in range(2, order + 1):
            counts[k].update(tuple(padded[i : i + k]) for i in range(len(padded) - k + 1))
    n, v = sum(counts[1].values()), len(counts[1])
    words_only = [c for w, c in counts[1].items() if w != ("\n",)]
    once, twice = words_only.count(1), words_only.count(2)
    d = once / (once + 2 * twice) if once else 0.5
    kept = [set(), {w for w, c in counts[1].items() if c >= least or w == ("\n",)}]
    for k in range(2, order + 1):
        kept.append({g for g, c in counts[k].items() if c >= least and g[:-1] in kept[k - 1] and g[1:] in kept[k - 1]})

    def unigram(w):
        return (max(counts[1][(w,)] - d, 0) + d * v / (v + 1)) / n

    def direct(g):
        return unigram(g[0]) if len(g) == 1 else (counts[len(g)][g] - langmodel.DISCOUNT) / counts[len(g) - 1][g[:-1]]

    def chance(history, w):
        for k in range(min(len(history), order - 1), 0, -1):
            h = tuple(history[-k:])
            if h not in kept[k]:
                continue
            if (*h, w) in kept[k + 1]:
                return direct((*h, w))
            after = [g for g in kept[k + 1] if g[:-1] == h]
            left = max(1 - sum(map(direct, after)), 1e-9) / max(1 - sum(direct(g[1:]) for g in after), 1e-9) if after else 1.0
            return left * chance(h[1:], w)
        return unigram(w)

    return counts, n, v, chance


def test_language_model(spark, monkeypatch):
    monkeypatch.setattr(langmodel, "LANE", 8)
    rng = random.Random(3)
    vocab = ["a", "b", "c", "D", "e1", *(f"rare{i}" for i in range(30))]
    docs = [(i, " ".join(rng.choice(vocab[: 5 if rng.random() < 0.8 else 35]) for _ in range(rng.randrange(40)))) for i in range(60)] + [(60, None), (61, ""), (62, "new words only")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n")
    held = F.col("doc_id") % 5 == 2
    states = 150
    got = {r.doc_id: r for r in langmodel.score_documents(df, held, states=states).collect()}
    train = [t for i, t in docs if i % 5 != 2]
    total = sum(len(tokens(t)) for t in train)
    counts, n, v, chance = brute_model(train, max(1, -(-total // states)), langmodel.ORDER)
    for i, t in docs:
        seq, r = tokens(t), got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i % 5 == 2, len(seq), sum(counts[1][(w,)] > 0 for w in seq), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[1][(w,)] + 0.5) / (n + 0.5 * (v + 1))) for w in seq), rel=1e-9)
        padded = ["\n", *seq]
        assert r.score == pytest.approx(sum(math.log10(chance(padded[max(0, j - 2) : j], padded[j])) for j in range(1, len(padded))), rel=1e-6)


def test_language_model_keeps_what_is_seen_once(spark):
    """More training tokens than any bound on the n-grams of an order; the threshold doesn't follow them."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    docs = [(i, " ".join(rng.choices(vocab, k=1000))) for i in range(300)]
    held = " ".join([*docs[7][1].split()[10:16], "new", *docs[8][1].split()[500:503], *rng.choices(vocab, k=4)])
    rows = {r.doc_id: r for r in langmodel.score_documents(spark.createDataFrame([*docs, (300, held)], "doc_id long, text string"), F.col("doc_id") == 300).collect()}
    _, n, _, chance = brute_model([t for _, t in docs], 1, langmodel.ORDER)
    assert n == 300_300 > 1 << 18
    for i, t in ((300, held), docs[0]):
        padded = ["\n", *tokens(t)]
        assert rows[i].score == pytest.approx(sum(math.log10(chance(padded[max(0, j - 2) : j], padded[j])) for j in range(1, len(padded))), rel=1e-6)


def test_language_model_without_rows_or_training(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert langmodel.score_corpus(df.limit(0)).count() == 0
    rows = langmodel.score_documents(df, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.held_out for r in rows)


def test_language_model_does_no_step_a_word(monkeypatch):
    """A chunk is named by whole arrays: no digest a word, no argsort of its tokens; its shape is that of slow sorts."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 30) for _ in range(rng.randrange(60))) for _ in range(50)]
    found = words_of(text_bytes(pa.array(texts)), NOT_SPACE)
    layout, lengths = langmodel.Layout.of(1 << 20, 3), found.rows + 2
    rows = [[langmodel.END, *(x + 1 for x in r), langmodel.END] for r in np.split(found.codes, np.cumsum(found.rows)[:-1])]
    with monkeypatch.context() as m:
        for owner, name in ((langmodel, "blake2b"), (np, "unique"), (np, "argsort")):
            m.setattr(owner, name, lambda *a, name=name, **b: pytest.fail(name))
        hashes = np.concatenate([layout.hashes(pa.array([b"\n"], pa.large_binary())), layout.hashes(found.distinct)])
        shape = langmodel.Shape.of(np.concatenate(rows).astype(np.int32), hashes, lengths, layout)
    grams = [{tuple(r[i - k + 1 : i + 1]) for r in rows for i in range(k - 1, len(r))} for k in (1, 2, 3)]
    assert len(shape.keys) == len(set(shape.keys.tolist())) == sum(map(len, grams))
    named, start = {}, 0
    for r in rows:
        for i, k in itertools.product(range(len(r)), (1, 2, 3)):
            at = shape.at[k - 1][start + i]
            if k > i + 1:
                assert at == -1
                continue
            assert named.setdefault(at, r[i - k + 1 : i + 1]) == r[i - k + 1 : i + 1]
            if k > 1:
                assert (shape.prefix[at], shape.suffix[at]) == (shape.at[k - 2][start + i - 1], shape.at[k - 2][start + i])
        start += len(r)
    assert sorted(named) == list(range(len(shape.keys)))


@pytest.mark.parametrize("low", [0, 1 << 62])
def test_keys_are_ranked_as_by_unique(low):
    rng = np.random.default_rng(4)
    # the keys of a cluster differ only in bits that find no room above the positions
    wide = rng.integers(0, 1 << 62, 40).astype(np.uint64)
    for keys in (wide[rng.integers(0, 40, 5000)] + rng.integers(0, 3, 5000).astype(np.uint64), wide, wide[:1], wide[:0], np.zeros(9, np.uint64)):
        keys = keys + np.uint64(low)
        want, first, rank = np.unique(keys, return_index=True, return_inverse=True)
        got = langmodel._ranked(keys)
        assert (got[0] == want).all() and (got[1] == first).all() and (got[2] == rank).all() and len(got[0]) == len(want)


def test_word_hashes_depend_on_the_word_alone():
    words = [b"", b"a", b"a\0", b"aa", *(b"x" * n for n in range(7, 140)), *(b"x" * n + b"y" for n in range(7, 140)), "ünïcode".encode()]
    column = pa.array(words, pa.large_binary())
    hashes = langmodel._word_hashes(column).tolist()
    assert len(set(hashes)) == len(words)
    assert [int(langmodel._word_hashes(column.slice(i, 1))[0]) for i in range(len(words))] == hashes
    assert langmodel._word_hashes(column.slice(0, 0)).tolist() == []


def test_keys_of_small_corpora_have_room():
    """With 46 bits two n-grams of the 25 MB of sf0.1 shared a key, and five rows were scored otherwise."""
    assert langmodel.Layout.of(25_000_000, 3).bits == langmodel.Layout.of(0, 3).bits == 50
    assert langmodel.Layout.of(900_000_000, 3).bits == 51 and langmodel.Layout.of(1 << 50, 3).bits == 62


def test_packed_parts_are_joined_again():
    rng = np.random.default_rng(6)
    keys = np.concatenate([np.sort(rng.integers(0, 1 << 63, n)).astype(np.uint64) for n in (5, 1, 700)])
    counts, cuts = rng.integers(0, 1 << 40, 706) * (np.arange(706) > 5), [0, 5, 6, 706]
    (steps, got), lengths = langmodel._joined(langmodel._packed_apart(cuts, langmodel._steps(keys, cuts), counts))
    assert lengths.tolist() == [5, 1, 700] and (got == counts).all()
    assert (langmodel._summed(steps, lengths) == keys).all()
    flags, none = rng.random(30) < 0.5, np.zeros(0, np.int64)
    back = langmodel._unpacked(langmodel._packed(flags, none, counts))
    assert all(a.dtype == b.dtype and (a == b).all() and len(a) == len(b) for a, b in zip(back, (flags, none, counts), strict=True))


def test_words_of_text():
    rng = random.Random(1)
    texts = ["".join(rng.choice(" \t\nAbé\x0b") for _ in range(rng.randrange(20))) for _ in range(50)] + [None, "", "a"]
    found = words_of(text_bytes(pa.array(texts)), NOT_SPACE)
    want = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("A", "a"))) for t in texts]
    assert found.rows.tolist() == list(map(len, want))
    assert [found.distinct[c].as_py().decode() for c in found.codes] == list(itertools.chain(*want))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as pipeline

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    item = " ".join(word() for _ in range(14))
    base = [" ".join(word() for _ in range(25)) for _ in range(12)]
    shared = "this line is in many documents"
    texts = [f"{b}\n{shared}\n{word()} {word()}" for b in base]
    long = [word() for _ in range(60)]
    texts += [" ".join(long), " ".join([*long[:30], word(), *long[31:]]), f"{base[2]} {word()} {word()} {' '.join(word() for _ in range(60))} {item} {' '.join(word() for _ in range(20))}", item + " " + " ".join(word() for _ in range(8)), "too short", None]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for n, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if n < len(pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{n}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{n}"))
        seen.append({r.doc_id: r.text for r in docs.collect()} if n < 4 else docs.collect())
    assert set(seen[0]) == set(range(16))  # too short ones go
    assert seen[1][0].count(shared) == 1 and all(shared not in seen[1][i] for i in range(1, 14))
    assert set(seen[2]) == set(range(16)) - {13}  # a near copy of 12
    assert item not in seen[3][14] and 15 not in seen[3]
    vocab = segments.load()
    assert all(segments.decode(r.ids, vocab) == (seen[3][r.doc_id] or "") for r in seen[4])
    assert {r.doc_id for r in seen[4]} == set(seen[3])
    final = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(final, key=lambda r: (r.doc_id, r.sample)) == sorted(seen[4], key=lambda r: (r.doc_id, r.sample))
