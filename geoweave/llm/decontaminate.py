"""Benchmark decontamination by greedy string tiling over shared-token seeds.

The benchmark is read in blocks of bounded size; each block is one pass over the documents without a shuffle.
In a task a rolling Karp-Rabin hash of ``min_tile`` tokens finds which seeds of an item a document holds; items whose seeds could
not cover enough are passed over.  For each other item, one at a time, the seeds' places join to maximal runs; the longest
that is still unmarked on both sides becomes a tile, again and again, down to ``min_tile`` tokens.  An item counts as leaked if its
tiles cover ``threshold`` of its tokens, in whatever order they stand.  Memory follows the texts, not the pairs of places.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import U64, mix, slices, small_batches, text_buffer, word_table, words

#: Tokens are runs of ASCII letters and digits and of other characters that are no punctuation, symbol or space, lower-cased; each
#: character of a script written without spaces is one.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
MARKS = r"[\x{80}-\x{A9}\x{AB}-\x{B1}\x{B4}\x{B6}-\x{B8}\x{BB}-\x{BF}\x{D7}\x{F7}\x{2000}-\x{206F}\x{20A0}-\x{20CF}\x{2190}-\x{2BFF}\x{2E00}-\x{2E7F}\x{3000}-\x{303F}\x{FE10}-\x{FE6F}\x{FEFF}-\x{FF0F}\x{FF1A}-\x{FF20}]"
UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
MIN_TILE = 5
THRESHOLD = 0.5
#: Items below ``min_tile`` tokens match as one whole tile if they have at least so many; a lone word is no passage.
SHORTEST = 2
#: Bytes of benchmark text that one pass carries to the tasks.
BLOCK_BYTES = 8_000_000
#: Pairs of places looked at together.
PAIRS = 1_000_000

_FACTORS = mix(np.arange(1, 65, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)


def _seeds(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places at which ``k`` tokens of one row begin, and their hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.flatnonzero(row[:n] == row[k - 1:])
    total = np.zeros(len(at), U64)
    for j in range(k):
        total += h[at + j] * _FACTORS[j]
    return at, mix(total)


def tokenised(texts: pa.Array) -> pa.Array:
    """Lower-cased texts in which separators are ASCII and every token of an unspaced script stands alone."""
    texts = pc.utf8_lower(texts)
    for pattern, new in ((MARKS, " "), (UNSPACED, r" \0 ")):
        found = pc.fill_null(pc.match_substring_regex(texts, pattern), False)
        if pc.any(found).as_py():
            texts = pc.if_else(found, pc.replace_substring_regex(texts, pattern, new), texts)
    return texts


class Items:
    """One block of the benchmark: distinct token sequences, indexed by their seeds of ``k`` tokens."""

    def __init__(self, rows: list[tuple[int | None, str | None]], k: int):
        self.ids, self.k = [r[0] for r in rows], k
        h, row, _, _ = words(*text_buffer(tokenised(pa.array([r[1] or "" for r in rows], pa.string()))), word_table("", LETTERS))
        self.h, self.first = h, np.searchsorted(row, np.arange(len(rows) + 1))
        same: dict[bytes, list[int]] = {}
        for i in range(len(rows)):
            same.setdefault(h[self.first[i]:self.first[i + 1]].tobytes(), []).append(i)
        self.rows = {own[0]: own for own in same.values()}  # rows with the same tokens share a result
        lead = np.isin(row, list(self.rows))
        self.by_seed = {}
        size = np.diff(self.first)
        for n in {k, *(x for x in np.unique(size).tolist() if SHORTEST <= x < k)}:
            at, seed = _seeds(h, row, n)
            own = lead[at] & (size[row[at]] == n if n < k else True)
            at, seed = at[own], seed[own]
            order = np.argsort(seed, kind="stable")
            self.by_seed[n] = (seed[order], row[at][order], (at - self.first[row[at]])[order])

    def tokens(self, item: int) -> np.ndarray:
        return self.h[self.first[item]:self.first[item + 1]]


def runs(doc: np.ndarray, item: np.ndarray, k: int, place: np.ndarray, of: np.ndarray, upto: np.ndarray, where: np.ndarray
         ) -> list[tuple[int, int, int]]:
    """Maximal common runs of ``k`` tokens or more as (-length, item place, document place), from the seeds' places.

    Seed j stands in the item at ``where[j]`` and in the document at ``place[of[j]:upto[j]]``.  Of runs over the same tokens of the item
    only the first are kept that the tiles, which mark no more tokens than the item has, cannot all block.
    """
    out = []
    enough = len(item) + len(item) ** 2 // k + 1
    for q, a, b in zip(where.tolist(), of.tolist(), upto.tolist(), strict=True):
        found = []
        for c in range(a, b, PAIRS):
            p = place[c:min(b, c + PAIRS)]
            if q:  # a run that begins earlier holds this seed
                p = p[(p == 0) | (doc[p - 1] != item[q - 1])]
            n = np.full(len(p), k)
            open_ = np.arange(len(p))
            while len(open_):
                open_ = open_[(p[open_] + n[open_] < len(doc)) & (q + n[open_] < len(item))]
                open_ = open_[doc[p[open_] + n[open_]] == item[q + n[open_]]]
                n[open_] += 1
            found.append((n, p))
        if not found:
            continue
        n, p = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(-n, kind="stable")
        n, p = n[order], p[order]
        new = np.r_[True, n[1:] != n[:-1]] if len(n) else np.zeros(0, bool)
        rank = np.arange(len(n)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(n) else n
        out += [(-int(x), q, int(y)) for x, y in zip(n[rank < enough], p[rank < enough], strict=True)]
    return out


def tile(heap: list[tuple[int, int, int]], k: int) -> tuple[int, int]:
    """Covered item tokens and number of tiles, from the maximal runs ``(-length, item place, document place)``.

    Longest first; ties go to the earlier place in the item, then in the document.
    """
    heapq.heapify(heap)
    in_doc: set[int] = set()
    in_item: set[int] = set()
    tiles = 0
    while heap:
        n, i, d = heapq.heappop(heap)
        free = [d + x not in in_doc and i + x not in in_item for x in range(-n)]
        if all(free):
            in_doc.update(range(d, d - n))
            in_item.update(range(i, i - n))
            tiles += 1
            continue
        x = 0
        while x < -n:
            y = x
            while y < -n and free[y]:
                y += 1
            if y - x >= k:
                heapq.heappush(heap, (x - y, i + x, d + x))
            x = y + 1
    return len(in_item), tiles


def leaks(texts: pa.Array, items: Items, threshold: float) -> Iterator[tuple[int, int, int, int, int]]:
    """``(row, item, tokens, covered, tiles)`` of every document and item with enough coverage."""
    buf, start, end = text_buffer(tokenised(texts))
    table = word_table("", LETTERS)
    for i, j in slices(start, end):
        h, row, _, _ = words(buf, start[i:j], end[i:j], table)
        first = np.searchsorted(row, np.arange(j - i + 1))
        for k, (seeds, item_of, item_at) in items.by_seed.items():
            at, seed = _seeds(h, row, k)
            low = np.searchsorted(seeds, seed)
            hit = np.flatnonzero(seeds[np.minimum(low, len(seeds) - 1)] == seed) if len(seeds) else []
            if not len(hit):
                continue
            hit = hit[np.lexsort((low[hit], row[at[hit]]))]  # by document and seed, places in order
            place, low = at[hit], low[hit]
            r = row[place]
            local = place - first[r]
            group = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (low[1:] != low[:-1])])
            upto = np.r_[group[1:], len(place)]
            high = np.searchsorted(seeds, seeds[low[group]], "right")
            many = high - low[group]
            head = np.flatnonzero(np.diff(r[group], prepend=-1))  # first seed of each document
            for a, b in slices(np.zeros(len(head), np.int64), np.add.reduceat(many, head), PAIRS):
                g = np.arange(head[a], head[b] if b < len(head) else len(group))
                of = np.repeat(g, many[g])  # every place of an item at which one of the document's seeds stands
                entry = np.arange(len(of)) - np.repeat(np.cumsum(many[g]) - many[g], many[g]) + low[group][of]
                order = np.lexsort((item_at[entry], item_of[entry], r[group][of]))
                of, entry = of[order], entry[order]
                key = r[group][of] * len(items.ids) + item_of[entry]
                new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                q = item_at[entry]
                reach = np.minimum(np.diff(q, append=0), k)
                reach[np.r_[new[1:], len(q)] - 1] = k
                bound = np.add.reduceat(reach, new)  # tokens that the seeds can cover at most
                for x, y, most in zip(new.tolist(), np.r_[new[1:], len(q)].tolist(), bound.tolist(), strict=True):
                    item, d = int(item_of[entry[x]]), int(r[group][of[x]])
                    tokens = items.tokens(item)
                    if most < threshold * len(tokens):
                        continue
                    doc = h[first[d]:first[d + 1]]
                    covered, tiles = tile(runs(doc, tokens, k, local, group[of[x:y]], upto[of[x:y]], q[x:y]), k)
                    if covered >= threshold * len(tokens):
                        for same in items.rows[item]:
                            yield i + d, same, len(tokens), covered, tiles


def benchmark_blocks(benchmark: DataFrame, min_tile: int, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The benchmark's distinct (item_id, text) rows in blocks of about ``block_bytes`` of text."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else rows
        yield Items(sorted((tuple(r) for r in part.toLocalIterator()), key=str), min_tile)


def contaminated(documents: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, threshold: float = THRESHOLD,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, n_tokens, covered, coverage, n_tiles`` of each document that holds an item of the benchmark.

    Only leaks have rows.  Null and empty texts, and items of a lone token, match nothing; an item of fewer than ``min_tile`` tokens
    matches as a whole; an empty table gives no rows; each of repeated documents has its rows, repeated items count once.  Texts
    of any length, repetitive ones too, are tiled whole.  Other columns are not read.
    """
    small_batches(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for items in benchmark_blocks(benchmark, min_tile, block_bytes):
        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(leaks(batch.column(1), items, threshold))
                ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                rest = [[items.ids[r[1]], r[2], r[3], r[3] / r[2], r[4]] for r in rows]
                cols = list(zip(*rest, strict=True)) or [()] * 5
                types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                                                 ["doc_id", "item_id", "n_tokens", "covered", "coverage", "n_tiles"])

        one = texts.mapInArrow(run, "doc_id long, item_id long, n_tokens long, covered long, coverage double, n_tiles long")
        out = one if out is None else out.unionByName(one)
    return out


def decontaminate(documents: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, threshold: float = THRESHOLD,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``documents`` without those that hold an item of ``benchmark``; all columns, and rows with null text, stay."""
    small_batches(documents.sparkSession)
    place, out = documents.columns.index("text"), documents
    for items in benchmark_blocks(benchmark, min_tile, block_bytes):
        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = np.zeros(batch.num_rows, bool)
                for r in leaks(batch.column(place), items, threshold):
                    bad[r[0]] = True
                yield batch.filter(pa.array(~bad))

        out = out.mapInArrow(run, documents.schema)
    return out
