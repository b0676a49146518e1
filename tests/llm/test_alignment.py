"""Token alignment against its definition with both libraries, and the merge against sets."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from geoweave.llm import alignment
from geoweave.llm.encoding import _byte_symbols, default_vocabulary

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
SYMBOLS = _byte_symbols()


def tokens(text):
    """Ids and bytes of both sides, or none."""
    if not text:
        return [], []
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    a = [(i, bytes(SYMBOLS[c] for c in A.id_to_token(i))) for i in a]
    b = [(i, bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()) for i in b]
    whole = (" " + text).encode()
    return (a, b) if b"".join(x[1] for x in a) == whole == b"".join(x[1] for x in b) else ([], [])


def groups(a, b):
    ends = [set(np.cumsum([len(x[1]) for x in side]).tolist()) for side in (a, b)]
    cuts = sorted(ends[0] & ends[1])
    out = [([], []) for _ in cuts]
    for side, tokens_ in ((0, a), (1, b)):
        at = 0
        for i, raw in tokens_:
            at += len(raw)
            out[int(np.searchsorted(cuts, at))][side].append(i)
    return out


def brute(rows):
    docs, count = [], Counter()
    for doc_id, text in rows:
        a, b = tokens(text)
        g = groups(a, b)
        links = [(x, y) for p, q in g for x in p for y in q]
        count.update(set(links))
        docs.append((doc_id, len(a), len(b), g, links))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for doc_id, na, nb, g, links in docs:
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in g)
        out.append((doc_id, na, nb, len(g), len(links), sum(count[x] == top[x[0]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out


def test_alignment_against_definition(spark, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).collect()]
    rows += [(901, None), (902, ""), (903, " "), (904, "a▁b c"), (905, " x　y   z"), (906, "<|endoftext|> <s> </s> <0x0A>"),
             (907, "\n\n  a\n b\t\tc  "), (908, "日本語のテキスト 漢字。" * 30), (909, "x" * 5000), (910, "\U0001f600 ok \x00 \x85"), (None, "same text"),
             (912, "same text"), (912, "same text"), (913, "ﬁne ½ ①"), (914, "\U00010348" * 300)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, pair string, place int").repartition(3)
    want = sorted(brute(rows), key=str)
    for size in (2000, 6_000_000):
        monkeypatch.setattr(alignment, "BLOCK_BYTES", size)
        assert sorted((tuple(r) for r in alignment.align_tokens(df).collect()), key=str) == want
    assert alignment.align_tokens(df.where("false")).count() == 0
    assert [tuple(r) for r in alignment.align_tokens(df.where("doc_id = 902")).collect()] == [(902, 0, 0, 0, 0, 0, 0, "")]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab é\n\t .,'1 日▁\x1c"), max_size=25))
def test_chunks_encode_as_the_whole_text(text):
    encoder = alignment.pair_encoder(default_vocabulary(alignment.BYTE_VOCABULARY), default_vocabulary(alignment.PIECE_VOCABULARY))
    got = encoder.encode(text)
    a, b = tokens(text)
    assert ([[x & 0xFFFF for x in np.frombuffer(p, np.uint32).tolist()] for p in got] if got else [[], []]) == [[x[0] for x in a], [x[0] for x in b]]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 60), min_size=1), st.sets(st.integers(1, 60), min_size=1), st.integers(1, 9))
def test_merge_path_pieces_find_all_common_ends(x, y, steps):
    a, b = np.array(sorted(x)), np.array(sorted(y))
    i, j = alignment.merge_path(a, b, steps)
    assert (np.diff(i + j)[:-1] == steps).all() and i[-1] == len(a) and j[-1] == len(b)
    ga, gb = alignment.common_ends(a, b, steps)
    assert a[ga - 1].tolist() == b[gb - 1].tolist() == sorted(x & y)


def test_large_groups_count_as_products(monkeypatch):
    a, b = np.array([5, 5, 7, 1]), np.array([2, 2, 3, 9])
    ends = np.array([3, 4]), np.array([3, 4]), np.array([0, 0])
    one = alignment.group_links(a, b, *ends)
    monkeypatch.setattr(alignment, "GROUP_LINKS", 2)
    two = alignment.group_links(a, b, *ends)
    assert [x.tolist() for x in one] == [x.tolist() for x in two]
