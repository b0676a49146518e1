"""Alignment of two tokenizers' tokens on the same bytes, and how many documents link each pair of token ids.

A text is encoded by both vocabularies; the bytes at which both end a token cut it into groups.  The two lists of token ends
(of a block of documents, which share their last byte) are merged by merge-path partitioning: diagonals of the merge grid are
binary-searched for equal-work pieces, each piece finds the ends that both lists hold, and groups that cross pieces are
stitched from the pieces' results.  A block keeps its documents' links as places in its list of distinct id pairs, so only
distinct pairs of a block are shuffled to be counted and to bring their counts back.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import small_batches, stored
from geoweave.llm.encoding import byte_encoder, default_vocabulary

BYTE_VOCABULARY = "byte_bpe_50k.tiktoken"
PIECE_VOCABULARY = "piece_bpe_32k.model"
#: Bytes of text in one block; a longer document makes a block of its own.
BLOCK_BYTES = 6_000_000
#: Steps (token ends of both lists) of one piece of the merge.
PIECE_STEPS = 1 << 16
#: Links enumerated at a time, and the largest group whose links are enumerated one by one.
LINK_CHUNK, GROUP_LINKS = 2_000_000, 4096
#: Marks a chunk whose bytes the tokens do not give back.
LOST = 0xFFFFFFFF

BLOCK = ("block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
         "groups_sha256 array<string>, entries array<long>, place binary, times binary, pair array<long>, docs array<long>")
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


class _Chunks(dict):
    """``chunk -> tokens`` as packed ``id | bytes << 16``; emptied when it holds ``limit`` chunks."""

    def __init__(self, encode, limit: int = 250_000):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, chunk: str) -> bytes:
        packed = array("I", self.encode(chunk)).tobytes()
        if len(chunk) <= 60:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = packed
        return packed


class PairEncoder:
    """Tokens of both vocabularies for space + text.

    Neither vocabulary has a token in which white space other than a carriage return follows another character, so a text is
    encoded in chunks that end before such white space, and each distinct chunk once.  Texts with unusual white space are encoded whole.
    """

    CHUNK = re.compile(r"[\t-\r ]*[^\t-\r ]+(?:\r[\t-\r ]*[^\t-\r ]*)*|[\t-\r ]+")
    UNUSUAL = re.compile("[\x1c-\x1f\x85\xa0  -     ▁　﻿\x00]")

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        own = byte_encoder(byte_path)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        p = self.pieces
        self.raw_b = [bytes([int(s[3:5], 16)]) if p.is_byte(i) else s.replace("▁", " ").encode()
                      for i in range(p.get_piece_size()) for s in [p.id_to_piece(i)]]
        self.space = p.piece_to_id("▁")
        self.encode_a, self.width_a = own.encoding.encode_ordinary, own.width
        self.raw_a = own.encoding.decode_bytes
        self.a, self.b = _Chunks(self.chunk_a), _Chunks(self.chunk_b)

    def chunk_a(self, chunk: str) -> list[int]:
        ids = self.encode_a(chunk)
        if self.raw_a(ids) != chunk.encode():
            return [LOST]
        return [i | int(self.width_a[i]) << 16 for i in ids]

    def chunk_b(self, chunk: str) -> list[int]:
        raw = self.raw_b
        if chunk[0] == " ":
            ids = self.pieces.encode(chunk[1:], num_threads=1) or [self.space]  # the processor puts the space back, but for no text
        else:  # after the first chunk, one may start with a tab or line feed, which joins no other character
            ids = self.pieces.encode(chunk, num_threads=1)
            if ids[0] != self.space:
                return [LOST]
            ids = ids[1:]
        if b"".join(map(raw.__getitem__, ids)) != chunk.encode():
            return [LOST]
        return [i | len(raw[i]) << 16 for i in ids]

    def encode(self, text: str) -> tuple[bytes, bytes] | None:
        """Packed tokens of both sides; None if there is no text or a side's bytes differ from it."""
        if not text:
            return None
        text = " " + text
        chunks = [text] if self.UNUSUAL.search(text) else self.CHUNK.findall(text)
        b = b"".join(map(self.b.__getitem__, chunks))
        a = b"".join(map(self.a.__getitem__, chunks))
        return None if _LOST in a and LOST in np.frombuffer(a, np.uint32) or _LOST in b and LOST in np.frombuffer(b, np.uint32) else (a, b)


_LOST = LOST.to_bytes(4, "little")


@cache
def pair_encoder(byte_path: str, piece_path: str) -> PairEncoder:
    return PairEncoder(byte_path, piece_path)


def merge_path(a: np.ndarray, b: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts ``(i, j)`` of two sorted lists into pieces of ``steps`` merge steps (equal values: ``a`` first).

    A cut lies on the diagonal ``i + j = k * steps``; all diagonals are binary-searched at once.
    """
    n = len(a) + len(b)
    d = np.minimum(np.arange(0, n + steps, steps), n)
    lo, hi = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (lo < hi).any():
        open_ = lo < hi
        mid = (lo + hi) // 2
        x, y = a[np.minimum(mid, len(a) - 1)], b[np.clip(d - 1 - mid, 0, len(b) - 1)]
        first = open_ & (x <= y)
        lo = np.where(first, mid + 1, lo)
        hi = np.where(open_ & ~first, mid, hi)
    return lo, d - lo


def common_ends(a: np.ndarray, b: np.ndarray, steps: int = PIECE_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Token counts ``(i, j)`` of both lists at every end that both hold, each piece of the merge on its own."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = merge_path(a, b, steps)
    out = []
    for i0, i1, j0, j1 in zip(i[:-1], i[1:], j[:-1], j[1:], strict=True):
        if i0 and j0 < j1 and a[i0 - 1] == b[j0]:  # a pair of equal ends cut apart: stitched to the piece before
            out.append((np.array([i0]), np.array([j0 + 1])))
        own, other = a[i0:i1], b[j0:j1]
        if len(own) and len(other):
            at = np.searchsorted(other, own)
            both = other[np.minimum(at, len(other) - 1)] == own
            out.append((i0 + 1 + np.flatnonzero(both), j0 + 1 + at[both]))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2


def group_links(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``doc << 32 | a id << 16 | b id`` of all links and how often each occurs.

    ``ga`` and ``gb`` end the groups in both token lists, ``doc`` is each group's document.  Links of a large group are
    counted as the products of its ids' counts.
    """
    na, nb = np.diff(ga, prepend=0), np.diff(gb, prepend=0)
    links = na * nb
    keys, times = [], []
    small = np.flatnonzero(links <= GROUP_LINKS)
    total = np.cumsum(links[small])
    for k in range(0, int(total[-1]) if len(total) else 0, LINK_CHUNK):
        g = small[np.searchsorted(total, k, "right"): np.searchsorted(total, k + LINK_CHUNK, "right")]
        if not len(g):
            continue
        n = links[g]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(nb[g], n)
        x = a[np.repeat(ga[g] - na[g], n) + within // wide]
        y = b[np.repeat(gb[g] - nb[g], n) + within % wide]
        u, c = np.unique(np.repeat(doc[g] << 32, n) | x << 16 | y, return_counts=True)
        keys.append(u)
        times.append(c)
    for g in np.flatnonzero(links > GROUP_LINKS):
        x, cx = np.unique(a[ga[g] - na[g]: ga[g]], return_counts=True)
        y, cy = np.unique(b[gb[g] - nb[g]: gb[g]], return_counts=True)
        keys.append((int(doc[g]) << 32 | x[:, None] << 16 | y).ravel())
        times.append((cx[:, None] * cy).ravel())
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(keys) == 1:
        return keys[0], times[0]
    key, n = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[new], np.add.reduceat(n, new)


@cache
def _numerals() -> np.ndarray:
    """Decimal ids with the signs ``,``, ``|`` and ``;`` behind them: row ``3 * id + sign``, padded with zeros."""
    text = np.array([f"{i}{s}".encode() for i in range(1 << 16) for s in ",|;"], "S6")
    return text.view(np.uint8).reshape(-1, 6)


def spelled(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3;`` of one document's ids and group ends."""
    sa, sb = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    sa[ga - 1], sb[gb - 1] = 1, 2
    group_a = np.repeat(np.arange(len(ga)), np.diff(ga, prepend=0))
    group_b = np.repeat(np.arange(len(gb)), np.diff(gb, prepend=0))
    code = np.empty(len(a) + len(b), np.int64)
    code[np.arange(len(a)) + np.r_[0, gb][group_a]] = 3 * a + sa
    code[np.arange(len(b)) + ga[group_b]] = 3 * b + sb
    raw = _numerals()[code].ravel()
    return raw[raw != 0].tobytes()


def block_row(block: int, ids: list, packed: list[tuple[bytes, bytes] | None]) -> list:
    """One block's digest columns, its distinct id pairs and each document's links as places among them."""
    sides = []
    for side in (0, 1):
        tokens = np.frombuffer(b"".join(p[side] for p in packed if p), np.uint32).astype(np.int64)
        count = np.array([len(p[side]) // 4 if p else 0 for p in packed], np.int64)
        sides.append((tokens & 0xFFFF, np.cumsum(tokens >> 16), count, np.cumsum(count)))
    (a, end_a, na, upto_a), (b, end_b, nb, upto_b) = sides
    ga, gb = common_ends(end_a, end_b)
    doc = np.searchsorted(upto_a, ga - 1, "right")
    n_groups = np.bincount(doc, minlength=len(ids)).astype(np.int64)
    upto_g = np.cumsum(n_groups)
    total = np.r_[0, np.cumsum(np.diff(ga, prepend=0) * np.diff(gb, prepend=0))]
    n_links = total[upto_g] - total[upto_g - n_groups]
    sha = []
    for d in range(len(ids)):
        if not n_groups[d]:
            sha.append("")
            continue
        g = slice(upto_g[d] - n_groups[d], upto_g[d])
        i, j = upto_a[d] - na[d], upto_b[d] - nb[d]
        sha.append(hashlib.sha256(spelled(a[i:upto_a[d]], b[j:upto_b[d]], ga[g] - i, gb[g] - j)[:-1]).hexdigest())
    key, times = group_links(a, b, ga, gb, doc)
    pair, place, docs = np.unique(key & LOST, return_inverse=True, return_counts=True)
    entries = np.bincount(key >> 32, minlength=len(ids))
    return [block, ids, na, nb, n_groups, n_links, sha, entries, place.astype(np.uint32).tobytes(),
            times.astype(np.uint64).tobytes() if len(times) and times.max() > 65535 else times.astype(np.uint16).tobytes(), pair, docs]


def align_blocks(byte_path: str, piece_path: str):
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())),
                        *((c, pa.list_(pa.int64())) for c in ("n_a", "n_b", "n_groups", "n_links")),
                        ("groups_sha256", pa.list_(pa.string())), ("entries", pa.list_(pa.int64())), ("place", pa.binary()),
                        ("times", pa.binary()), ("pair", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])

    def record(row: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pair_encoder(byte_path, piece_path)
        block, ids, packed, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                tokens = encoder.encode(text.as_py())
                ids.append(doc_id.as_py())
                packed.append(tokens)
                size += 2 * sum(map(len, tokens)) // 4 if tokens else 16
                if size >= BLOCK_BYTES:
                    yield record(block_row(block, ids, packed))
                    block, ids, packed, size = block + 1, [], [], 0
        if ids:
            yield record(block_row(block, ids, packed))
    return run


def sum_counts(blocks: pa.Table, counts: pa.Table) -> pa.Table:
    """Documents of one block with the corpus counts of their links; ``counts`` has the block's pairs by place."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    schema = pa.schema([(c, pa.string() if c == "groups_sha256" else pa.int64()) for c in names])
    if not blocks.num_rows:
        return schema.empty_table()
    column = {c: blocks.column(c)[0] for c in blocks.column_names}
    entries = column["entries"].values.to_numpy()
    place = np.frombuffer(column["place"].as_py(), np.uint32)
    raw = column["times"].as_py()
    times = np.frombuffer(raw, np.uint16 if len(raw) == 2 * len(place) else np.uint64).astype(np.int64)
    n, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, np.int64)
    if counts.num_rows:
        at = counts.column("place").to_numpy()
        n[at], best[at] = counts.column("n").to_numpy(), counts.column("best").to_numpy(zero_copy_only=False)
    upto = np.cumsum(entries)
    sums = [np.r_[0, np.cumsum(times * x[place])] for x in (best, n)]
    out = {"n_best": pa.array(sums[0][upto] - sums[0][upto - entries]), "count_sum": pa.array(sums[1][upto] - sums[1][upto - entries])}
    return pa.Table.from_arrays([out[c] if c in out else column[c].values for c in names], schema=schema)


def align_tokens(documents: DataFrame, byte_vocabulary: str | None = None, piece_vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per row.

    A null or empty text, or one that a vocabulary does not give back byte for byte, has no tokens: zeros and an empty digest.
    Repeated rows count each; a null doc_id is kept; an empty table gives no rows; a text of any length is encoded whole; other
    columns are not read.  Ties for an id's best count all count.
    """
    small_batches(documents.sparkSession)
    paths = byte_vocabulary or default_vocabulary(BYTE_VOCABULARY), piece_vocabulary or default_vocabulary(PIECE_VOCABULARY)
    blocks = stored(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(align_blocks(*paths), BLOCK), "aligned")
    each = blocks.select("block", F.posexplode(F.arrays_zip("pair", "docs"))).select(
        F.col("block").alias("of"), F.col("pos").alias("place"), F.col("col.pair").alias("pair"), F.col("col.docs").alias("docs"))
    counts = stored(each.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.shiftright("pair", 16)), "pair-counts")
    highest = counts.groupBy("a").agg(F.max("n").alias("top"))
    valued = counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    back = each.select("of", "place", "pair").join(valued, "pair").select("of", "place", "n", "best")
    return blocks.drop("pair", "docs").groupBy("block").cogroup(back.groupBy("of")).applyInArrow(sum_counts, RESULT)
