"""Plain Python versions of the operators, for comparison on small tables."""

import hashlib
import re
from collections import Counter

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def linked(a, b, threshold):
    n = len(a & b)
    return n > 0 and 100 * n >= threshold * (len(a) + len(b) - n)


def components(texts, threshold):
    """Smallest index reachable, for each text."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if linked(sets[i], sets[j], threshold):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(sets))], sets


def removed(texts, length=200):
    """(n_bytes, n_removed, n_spans, sha256 of the rest, rest) of each text."""
    raw = [(t or "").encode() for t in texts]
    often = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if often[b[i:i + length]] > 1:
                gone[i:i + length] = b"\x01" * length
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest(), rest))
    return out


def tiling(doc, item, k):
    """Greedy string tiling, from its definition: (covered item tokens, tiles)."""
    md, mi, tiles = [False] * len(doc), [False] * len(item), 0
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while (i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n]
                       and not mi[i + n] and not md[d + n]):
                    n += 1
                if n >= k and (best is None or (-n, i, d) < best):
                    best = (-n, i, d)
        if best is None:
            return sum(mi), tiles
        n, i, d = -best[0], best[1], best[2]
        mi[i:i + n] = [True] * n
        md[d:d + n] = [True] * n
        tiles += 1


def tokens(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
