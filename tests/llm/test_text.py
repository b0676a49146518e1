"""Decontamination, tokens, packing and classifiers against brute force, exact round trips or held-out accuracy."""

import random
import zlib

import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoweave.llm import decontaminate, encoding, packing, quality, samples, tokencounts, toxicity
from tests.conftest import SF_SMALL
from tests.llm import brute

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, score double, row int, h long"
ODD = [None, "", "   ", "don't WE'LL I'd 'S", "İstanbul ΣΑΣ ς", "áe café x", "12 345a6", "!!! ??? a'b 'tis ,,.,", "x\x1cy\x00z", "ﬀ ǅ ß ẞ ÿŸ",
       "<|endoftext|>hi", "日本語 テスト", "µ ª º ² ³ ¼", "—–‘q’ “z”", "​zero﻿w", " line\u0085nel\x0b", "ab " * 9000, "x" * 5000]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, 1, 2) for i, t in rows], SCHEMA).repartition(3)


@given(st.lists(st.integers(0, 2), max_size=24), st.lists(st.integers(0, 2), max_size=14))
@settings(max_examples=150, deadline=None)
def test_tiles_follow_the_definition(doc, item):
    k = 3
    where = [i for i in range(len(item) - k + 1)]
    places = [[d for d in range(len(doc) - k + 1) if doc[d:d + k] == item[i:i + k]] for i in where]
    ends = np.cumsum([0] + [len(p) for p in places])
    found = decontaminate.runs(np.array(doc), np.array(item), k, np.array([d for p in places for d in p], int), ends[:-1], ends[1:],
                               np.array(where)) if ends[-1] else []
    assert decontaminate.tile(found, k) == brute.tiling(doc, item, k)


def test_repetitive_texts_and_shared_templates():
    """A million equal words against an item of the same word, and ten thousand items that share a template."""
    items = decontaminate.Items([(1, "w " * 40), (2, "w " * 40), (3, "w " * 300 + "end")], 5)
    got = list(decontaminate.leaks(pa.array(["w " * 1_000_000, "w " * 39, None]), items, 0.5))
    assert sorted(got) == [(0, 0, 40, 40, 1), (0, 1, 40, 40, 1), (0, 2, 301, 300, 1), (1, 0, 40, 39, 1), (1, 1, 40, 39, 1)]
    template = " ".join(f"t{i}" for i in range(20))
    items = decontaminate.Items([(i, f"{template} {' '.join(f'own{i}x{j}' for j in range(30))}") for i in range(10_000)], 5)
    texts = pa.array([f"before {template} after", f"{template} {' '.join(f'own77x{j}' for j in range(30))}"] * 20)
    assert {x[1:] for x in decontaminate.leaks(texts, items, 0.5)} == {(77, 50, 50, 1)}


def test_short_items_and_other_scripts():
    items = decontaminate.Items([(1, "too short"), (2, "lone"), (3, "日本語のテキスト、漢字。"), (4, "“quoted—words” of five tokens"), (5, "สวัสดีครับ"), (6, "")], 5)
    texts = pa.array(["this is too short, really", "lone too", "前置き日本語のテキスト漢字後", "quoted words of five tokens", "too\u00a0SHORT", "ก สวัสดีครับ"])
    assert sorted((r, items.ids[i]) for r, i, *_ in decontaminate.leaks(texts, items, 0.5)) == [(0, 1), (2, 3), (3, 4), (4, 1), (5, 5)]


def test_leaks(spark):
    rng = random.Random(1)
    words = lambda n: [f"t{rng.randrange(10**6)}" for _ in range(n)]
    items = [(1, " ".join(a := words(40))), (2, " ".join(b := words(30))), (3, None), (4, "two words"), (2, " ".join(b)), (None, " ".join(c := words(12)))]
    docs = [(1, " ".join(words(30) + a + words(30))), (2, " ".join(words(9) + a[20:] + words(9) + a[:20])),
            (3, " ".join(a[:15] + words(40))), (4, ", ".join(b).upper()), (5, None), (6, ""), (7, " ".join(words(80))), (None, " ".join(c)),
            (8, " ".join(a + b)), (8, " ".join(a + b)), (9, " ".join(words(40_000) + b + words(300_000)))]
    documents = frame(spark, docs)
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    want = []
    for i, t in docs[:-1]:
        for j, s in {x for x in items if x[1]}:
            x, y = brute.tokens(t), brute.tokens(s)
            covered, tiles = brute.tiling(x, y, 5)
            if len(y) >= 5 and covered >= 0.5 * len(y):
                want.append((i, j, len(y), covered, covered / len(y), tiles))
    want.append((9, 2, 30, 30, 1.0, 1))
    for size in (8_000_000, 200):  # one block and several
        got = decontaminate.contaminated(documents, benchmark, block_bytes=size)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
        left = decontaminate.decontaminate(documents, benchmark, block_bytes=size)
        assert left.columns == documents.columns and sorted(r.doc_id for r in left.collect()) == [3, 5, 6, 7]
    assert decontaminate.contaminated(documents.where("false"), benchmark).count() == 0
    assert decontaminate.decontaminate(documents, benchmark.where("false")).count() == len(docs)


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").collect()] + ODD


def test_word_ids_are_those_of_the_library(texts):
    from tokenizers import Tokenizer

    path = encoding.default_vocabulary("word_bpe_49k.json")
    exact, fast = Tokenizer.from_file(path), encoding.WordEncoder(path, limit=500)
    for t in texts:
        assert np.frombuffer(fast.packed(t), "<u4").tolist() == exact.encode(t or "", add_special_tokens=False).ids


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_word_ids_of_any_text(text):
    encoder = encoding.word_encoder(encoding.default_vocabulary("word_bpe_49k.json"))
    assert np.frombuffer(encoder.packed(text), "<u4").tolist() == encoder.exact.encode(text, add_special_tokens=False).ids


def test_pieces_and_places(spark, texts):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(encoding.default_vocabulary("word_bpe_49k.json"))
    rows = [(i if i % 40 else None, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3])]
    cap = packing.Capacity(tokens=512, documents=7, attention=200_000)
    got = packing.pack(frame(spark, rows), cap=cap, with_ids=True, group_pieces=150).collect()
    want = []
    for i, t in rows:
        ids = exact.encode(t or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 512)):
            part = np.array(ids[at:at + 512], "<u4").tobytes()
            want.append((i, k, at, len(part) // 4, zlib.crc32(part), part))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 512 and len(parts) <= 7
        assert len(parts) == 1 or sum(n * n for _, n in parts) <= 200_000
    assert packing.pack(frame(spark, rows).where("false")).count() == 0


def test_few_sequences(spark):
    got = packing.pack(spark.read.parquet(f"{SF}/documents.parquet"))
    total, used = got.selectExpr("sum(length)", "count(distinct sequence_id)").first()
    assert used <= 1.01 * total / 4096 + 1


@given(st.lists(st.integers(1, 100), max_size=60))
@settings(max_examples=150, deadline=None)
def test_best_fit_takes_the_smallest_norm(lengths):
    cap = packing.Capacity(100, 4, 3000, (1.0, 0.5, 0.3))
    bins, open_ = packing.Bins(cap), []
    for n in lengths:
        fits = [(bins.norm(t - n, d - 1, a - n * n), t, d, a, k) for k, (t, d, a) in enumerate(open_) if t >= n and d >= 1 and a >= n * n]
        b, offset = bins.add(n)
        if not fits:
            assert b == len(open_) and offset == 0
            open_.append((100 - n, 3, 3000 - n * n))
        else:
            assert b == min(fits)[4] and offset == 100 - open_[b][0]
            t, d, a = open_[b]
            open_[b] = (t - n, d - 1, a - n * n)


def test_section_tokens(spark, texts):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(encoding.default_vocabulary("byte_bpe_50k.json"))
    exact.encode_special_tokens = True
    rows = list(enumerate(texts))
    for rule in ("most", "first"):
        got = {r.doc_id: r for r in tokencounts.section_tokens(frame(spark, rows), rule=rule).collect()}
        for i, t in rows:
            t = t or ""
            e = exact.encode(t, add_special_tokens=False)
            assert got[i].n_tokens == len(e.ids) == sum(got[i].section_tokens)
            lines = t.split("\n")
            assert got[i].n_sections == len(got[i].section_tokens) == max(1, len(lines) - (len(lines) > 1 and not lines[-1]))
            if t.isascii() and rule == "first":
                own = [0] * got[i].n_sections
                for a, _ in e.offsets:
                    own[t.count("\n", 0, a)] += 1
                assert own == got[i].section_tokens
    own, crossing = tokencounts.allocate(np.array([0, 2, 5]), np.array([2, 5, 9]), np.array([0, 3, 8, 9]), "most")
    assert own.tolist() == [0, 1, 1] and crossing.tolist() == [False, True, True]


def test_quality_on_the_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    extra = frame(spark, [(10**6, None), (10**6 + 1, ""), (None, "a b c")]).select("doc_id", "text")
    found = quality.quality(docs.select("doc_id", "text").unionByName(extra), labels).toPandas()
    assert found.score.between(0, 1).all() and len(found) == docs.count() + 3
    assert (found.held_out == [x == x and zlib.crc32(str(int(x)).encode()) % 4 == 2 for x in found.doc_id]).all()
    joined = found.merge(labels.toPandas(), on="doc_id")
    test = joined[joined.held_out]
    assert (test.predicted == test.quality).mean() >= 0.95


def test_rules_compile_to_what_they_mean(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.4)).astype(float)
    rules = quality.boosted_rules(x, y, ["a", "b", "c"])
    w = quality.lasso(np.array([r.holds(dict(zip("abc", x.T, strict=True))) for r in rules]).T.astype(float), y, 0.002)
    model = object.__new__(quality.Quality)
    model.intercept, model.rules = float(w[0]), [(r, float(k)) for r, k in zip(rules, w[1:], strict=True) if k]
    assert len(model.rules) < len(rules)
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    got = np.array([r[0] for r in df.select(model.column({c: df[c] for c in "abc"})).collect()])
    held = sum(k * r.holds(dict(zip("abc", x.T, strict=True))) for r, k in model.rules) + model.intercept
    assert np.allclose(got, 1 / (1 + np.exp(-held))) and ((got > 0.5) == (y == 1)).mean() > 0.97


def test_toxicity_on_the_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    extra = frame(spark, [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " 12 "), (None, "a b c")]).select("doc_id", "text")
    found = toxicity.toxicity(docs.select("doc_id", "text").unionByName(extra), labels).toPandas()
    assert found.score.between(0, 1).all() and len(found) == docs.count() + 4
    assert (found[found.doc_id >= 10**6].score == 0).all()
    assert (found.held_out == [x == x and zlib.crc32(str(int(x)).encode()) % 3 == 1 for x in found.doc_id]).all()
    test = found.merge(labels.toPandas(), on="doc_id")
    test = test[test.held_out]
    good, bad = test[test.toxic == 0], test[test.toxic == 1]
    assert good.predicted.mean() <= 0.04 and bad.predicted.mean() >= 0.5  # few labels at this size


def test_classifiers_without_labels(spark):
    docs = frame(spark, [(1, "a b"), (None, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    assert {r.score for r in quality.quality(docs, none).collect()} == {0.5}
    kept = toxicity.reject_toxic(docs, none)
    assert kept.columns == docs.columns and kept.count() == 2
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality(docs.where("false"), odd).count() == 0 and toxicity.toxicity(docs.where("false"), odd).count() == 0


def test_sample_leaves_out_the_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    ids = [r.doc_id for r in samples.labelled_sample(docs, labels, "toxic", 3, 1, 10, 20, 10**6).collect()]
    assert 0 < len(ids) <= 30 and all(zlib.crc32(str(i).encode()) % 3 != 1 for i in ids)


def test_compression_distances_by_definition():
    """Window lengths from a compressor per call, features by hand; kept windows change nothing."""
    bad, good = toxicity.dictionaries(toxicity.Counter({"vile": 9, "foul": 8, "and": 9}), 10, toxicity.Counter({"and": 50, "the": 60, "tree": 9}), 60, 10)
    pairs = [(bad, good)] * 2
    text = "The tree, and the vile FOUL vile thing 77 und " * 30
    w = [x for x in "".join(c if c.isalpha() else " " for c in text.lower()).split()]
    want = []
    for _, phase in toxicity.VIEWS:
        parts = [w[:phase]] + [w[i:i + 8] for i in range(phase, len(w), 8)]
        d = [len(toxicity.compressor(good).compress(x)) - len(toxicity.compressor(bad).compress(x))
             for x in ((" " + " ".join(p) + " ").encode() for p in parts if p)]
        top = sorted(d, reverse=True)
        want += [min(top[0], 10), min(sum(top[:2]), 16), min(sum(top[:4]), 30), max(-2, min(3, sum(d) / len(d))),
                 *(sum(x >= k for x in d) / len(d) for k in (2, 3, 4)), sum(x < 0 for x in d) / len(d), math.log1p(len(d)),
                 *(math.log1p(sum(x >= k for x in d)) for k in (3, 4, 5)), sum(max(x - 1, 0) for x in d) / len(d)]
    known = [toxicity._Lengths(*p) for p in pairs]
    for kept in (None, known, known):
        assert np.allclose(toxicity.distances(text, pairs, kept), want)
    assert top[0] > 0 and toxicity.distances("", pairs) == toxicity.distances("7 !", pairs)
