"""Collocations against their definition; the index against plain counting."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoweave.llm import phrases


def brute(rows, longest, least, held, top):
    out = []
    for lang in {r[0] or "und" for r in rows}:
        f, n = Counter(), 0
        for own, text in rows:
            if (own or "und") != lang:
                continue
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
                w = re.findall(r"[^\x20\x09]+", piece)
                n += len(w)
                f.update(tuple(w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
        good = {p: a for p, a in f.items() if a >= least}
        found = []
        for p, a in good.items():
            k = len(p)
            if k < 2 or any(len(q) > k and 100 * b >= held * a and any(q[i:i + k] == p for i in range(len(q) - k + 1))
                            for q, b in good.items()):
                continue
            score, cut = min((1000 * a * n // (f[p[:c]] * f[p[c:]]), c) for c in range(1, k))
            found.append((score, a, " ".join(p), f[p[:cut]], f[p[cut:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, left, right, n, s) for i, (s, a, p, left, right) in enumerate(found[:top])]
    return sorted(out)


@pytest.mark.parametrize("size, least, held, top", [(30, 3, 80, 7), (3_000_000, 5, 100, 2000)])
def test_collocations_against_definition(spark, monkeypatch, size, least, held, top):
    rng = np.random.default_rng(1)
    words = ["a", "B", "c", "É", "dd", "e\x0bf", "x y", "g!", "h.", "\tq", "<0>"]
    rows = [(["en", "de", None][int(rng.integers(3))], "  ".join(rng.choice(words, rng.integers(0, 40)))) for _ in range(60)]
    rows += [rows[0]] * 5 + [("en", None), (None, None), ("fr", ""), ("de", " \t"), ("en", "the same words all over " * 400)]
    df = spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], "lang string, text string, phrase string, n int").repartition(3)
    monkeypatch.setattr(phrases, "SHARD_WORDS", size)
    monkeypatch.setattr(phrases, "OPEN_WORDS", 2 * size)
    got = sorted(tuple(r) for r in phrases.collocations(df, 5, least, held, top).collect())
    assert got == brute(rows, 5, least, held, top)
    assert phrases.collocations(df.where("text = ''" if size == 30 else "false")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), max_size=12), min_size=1, max_size=6), st.integers(2, 5))
def test_enumeration_counts_every_phrase(pieces, depth):
    text = np.array([x for p in pieces for x in [*p, 0]], np.int64)
    want = Counter(tuple(p[i:i + k]) for p in pieces for k in range(2, depth + 1) for i in range(len(p) - k + 1))
    got = Counter()
    for words, counts in phrases.enumerate_phrases(text, depth, 5):
        for w, n in zip(words.tolist(), counts.tolist(), strict=True):
            assert tuple(w) not in got
            got[tuple(w)] = n
    assert got == want


def test_exact_score_beyond_64_bits(spark):
    row = spark.sql("SELECT cast(900000000000 as decimal(17,0)) * cast(8000000000000001 as decimal(17,0)) * cast(1000 as decimal(4,0)) "
                    "div (cast(900000000000 as decimal(19,0)) * cast(7000000000001 as decimal(19,0))) AS s").first()
    assert row.s == 900000000000 * 8000000000000001 * 1000 // (900000000000 * 7000000000001)
