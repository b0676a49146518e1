"""op12 on texts with carriage returns: the piece vocabulary has tokens such as ``;\\r`` and `` \\r`` that join one to what is before it."""

import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from geoweave.llm.alignment import align_tokens

TEXTS = ["a\rb ", "x\r\r \ry", "f();\r\n  g();\r\n", "one \r two\tthree", "if (a) {\r\n}\r\n\r\n// end", "plain words\nand lines", "\r", "\r\n", "end\r", None, ""]


def expected(texts):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows, docs, links = [], Counter(), []
    for text in texts:
        if not text:
            rows.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        a = tok.encode(" " + text, add_special_tokens=False)
        b = pieces.encode(text)
        ends_a = [e for _, e in a.offsets]  # the texts are ASCII: characters are bytes
        ends_b, at = [], 0
        for i in b:
            at += 1 if pieces.is_byte(i) else len(pieces.id_to_piece(i))
            ends_b.append(at)
        assert ends_a[-1] == ends_b[-1] == len(text) + 1
        groups, own, i, j = [], [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            ga = [x for x, y in zip(a.ids[i:], ends_a[i:], strict=True) if y <= e]
            gb = [x for x, y in zip(b[j:], ends_b[j:], strict=True) if y <= e]
            i, j = i + len(ga), j + len(gb)
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            own += [(x, y) for x in ga for y in gb]
        rows.append((len(a.ids), len(b), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(own)
        docs.update(set(own))
    top = Counter()
    for (x, _), n in docs.items():
        top[x] = max(top[x], n)
    return [(k, *r[:4], sum(docs[p] == top[p[0]] for p in own), sum(docs[p] for p in own), r[4]) for k, (r, own) in enumerate(zip(rows, links, strict=True))]


def test_carriage_returns_are_aligned(spark):
    got = align_tokens(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).orderBy("doc_id")
    assert [tuple(r) for r in got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()] == expected(TEXTS)
