"""Near-duplicates and repeated strings against brute force, with nulls, empties, copies and long texts."""

import random

import numpy as np
import pandas as pd
import pytest

from geoweave.llm import minhash, suffixes
from tests.conftest import SF_SMALL
from tests.llm import brute

SCHEMA = "doc_id long, text string, th string, cls int, row string, n_chars long"


def near_copies(n, words=90, edits=6, seed=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs]
    rows += [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "one two"), (9004, "One  TWO"), (9005, "one two three"),
             (None, "alone and without any id here"), (9006, rows[0][1]), (9006, rows[0][1])]
    rows += [(9100 + i, t) for i, t in enumerate(near_copies(70))]
    return rows


@pytest.fixture(scope="module")
def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, None, len(t or "")) for i, t in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize(("small", "block"), [(16, 256), (1, 16)])
def test_near_duplicates(rows, documents, monkeypatch, small, block):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", small)  # 1: every bucket takes the way of large ones
    monkeypatch.setattr(minhash.similar_in_blocks, "__defaults__", (block,))
    got = sorted(map(tuple, minhash.near_duplicates(documents).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    comp, sets = brute.components([t for _, t in rows], 85)
    low = {}
    for (i, _), c in zip(rows, comp, strict=True):
        low[c] = min((x for x in (low.get(c), i) if x is not None), default=None)
    want = sorted(((i, len(s), low[c] if s else i, (low[c] if s else i) == i) for (i, _), c, s in zip(rows, comp, sets, strict=True)), key=str)
    assert got == want


def test_deduplicate_keeps_one_of_each_group(rows, documents):
    kept = minhash.deduplicate(documents, 80)
    assert kept.columns == documents.columns
    ids = [(r.doc_id, r.text) for r in kept.collect()]
    comp, sets = brute.components([t for _, t in rows], 80)
    groups = {c for c, s in zip(comp, sets, strict=True) if s}
    full = [x for x in ids if brute.shingles(x[1])]
    assert len(full) == len(groups) and len(ids) == len(groups) + 3  # three texts without words stay
    assert len({comp[rows.index(x)] for x in full}) == len(groups)


def test_no_documents(spark, documents):
    none = documents.where("false")
    assert minhash.near_duplicates(none).count() == 0 and minhash.deduplicate(none).count() == 0
    assert suffixes.repeat_digest(none).count() == 0 and suffixes.remove_repeats(none).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(f"{rng.randrange(300):03}", f"{rng.randrange(300):03}") for _ in range(220)] + [("a", "a")]
    got = {r.node: r.comp for r in minhash.components(spark.createDataFrame(edges, "x string, y string")).collect()}
    low = {x: x for e in edges for x in e}
    for _ in range(300):
        for x, y in edges:
            low[x] = low[y] = min(low[x], low[y])
    assert got == {x: c for x, c in low.items() if x != "a"} or got == {x: c for x, c in low.items() if x in got}
    assert all(x in got for e in edges if e[0] != e[1] for x in e)


@pytest.fixture(scope="module")
def passages(rows):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghij klmno\n") for _ in range(n))
    shared = noise(260)
    return (rows[:60] + rows[200:209] + [(8000, shared[:200]), (8001, "é" * 150 + shared[30:]), (8002, noise(199)), (8003, "ab" * 400),
            (8004, noise(90) + shared[:199] + noise(80)), (8005, noise(300) + "é" * 99 + shared[10:250] + noise(300)),
            (8006, "x" * 200), (8007, "x" * 201), (8008, noise(1_200_000) + shared + noise(300)), (None, noise(400)), (None, noise(400))])


def test_repeats(spark, passages):
    documents = spark.createDataFrame([(i, t, "x", 1, None, len(t or "")) for i, t in passages], SCHEMA).repartition(4)
    want = brute.removed([t for _, t in passages])
    got = sorted(map(tuple, suffixes.repeat_digest(documents).collect()), key=str)
    assert got == sorted(((i, *w[:4]) for (i, _), w in zip(passages, want, strict=True)), key=str)
    cleaned = suffixes.remove_repeats(documents)
    assert cleaned.columns == documents.columns
    texts = sorted(((r.doc_id, r.text, r.n_chars) for r in cleaned.collect()), key=str)
    rest = [None if t is None else w[4].decode("utf-8", "ignore") for (_, t), w in zip(passages, want, strict=True)]
    assert texts == sorted(((i, t, len(t or "")) for (i, _), t in zip(passages, rest, strict=True)), key=str)


def test_suffix_levels():
    rng = np.random.default_rng(2)
    family, seen = suffixes.SuffixLevels(3), {}
    for b in range(40):
        w = [bytes(x) for x in rng.integers(97, 104, (rng.integers(1, 30), 3), dtype=np.uint8)]
        owner = np.arange(len(w)) + 100 * b
        family.add(np.array(w, "S3"), owner)
        for x, o in zip(w, owner.tolist(), strict=True):
            seen.setdefault(x, []).append(o)
    matched = set(np.concatenate(family.matched).tolist())
    assert all((len(o) > 1) == (o[0] in matched) and (len(o) == 1 or set(o) <= matched) for o in seen.values())
    sizes = [len(k) for k, _ in family.levels]
    assert sum(sizes) == len(seen) and all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def test_blocks_find_what_pairs_find(spark):
    sets = [np.unique(np.random.default_rng(k % 3).integers(0, 1000, 50 + k % 2)) for k in range(30)]
    frame = spark.createDataFrame(pd.DataFrame({"key": 1, "m": 30, "cls": [bytes([k]) for k in range(30)],
                                                "comp": [bytes([k]) for k in range(30)], "set": [s.tolist() for s in sets]}),
                                  "key long, m long, cls binary, comp binary, set array<long>")
    links = minhash.similar_in_blocks(frame, 85, 7)
    got = {bytes(r.node)[0]: bytes(r.comp)[0] for r in minhash.components(links).collect()}
    root = list(range(30))
    for i in range(30):
        for j in range(i):
            if brute.linked(set(sets[i].tolist()), set(sets[j].tolist()), 85):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert [got.get(k, k) for k in range(30)] == root
