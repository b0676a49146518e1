"""Best-fit packing of tokenised documents into training sequences under several capacities.

Tokenising is one pass over the documents; what is shuffled is one narrow row per piece.  Pieces are
dealt to groups of bounded size at random (a hash of content and place, so copies and hot sources spread),
each group packed on its own in decreasing order of length; a group leaves at most a few open
sequences among thousands.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import small_batches, stored
from geoweave.llm.encoding import default_vocabulary, word_encoder

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Pieces packed together; memory and time of one task follow this, not the corpus.
GROUP_PIECES = 16_384


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds; attention cost is the sum of squared piece lengths.

    Weights scale the residuals, each taken as a share of its capacity, in the fit of a piece.
    """

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)


class Bins:
    """Open sequences; a piece goes where the weighted norm of what stays free is smallest.

    Bins are kept by free tokens.  The token share alone bounds the norm from below, so the search
    from the tightest bin upwards ends as soon as that share exceeds the best norm: the choice is exact.
    """

    def __init__(self, cap: Capacity):
        self.cap = cap
        self.free: dict[int, dict[tuple[int, int], list[int]]] = {}
        self.sizes: list[int] = []
        self.used: list[int] = []

    def norm(self, tokens: int, documents: int, attention: int) -> float:
        w, c = self.cap.weights, self.cap
        return (w[0] * (tokens / c.tokens) ** 2 + w[1] * (documents / c.documents) ** 2
                + w[2] * (attention / c.attention) ** 2)

    def add(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of ``length`` tokens; a new bin is opened if none can take it."""
        cap, cost = self.cap, length * length
        best = None
        for k in range(bisect_left(self.sizes, length), len(self.sizes)):
            tokens = self.sizes[k]
            if best and cap.weights[0] * ((tokens - length) / cap.tokens) ** 2 > best[0]:
                break
            for documents, attention in self.free[tokens]:
                if documents >= 1 and attention >= cost:
                    fit = (self.norm(tokens - length, documents - 1, attention - cost), tokens, documents, attention)
                    if best is None or fit < best:
                        best = fit
        if best is None:
            b, tokens, documents, attention = len(self.used), cap.tokens, cap.documents, cap.attention
            self.used.append(0)
        else:
            _, tokens, documents, attention = best
            same = self.free[tokens]
            b = heapq.heappop(same[documents, attention])
            if not same[documents, attention]:
                del same[documents, attention]
                if not same:
                    del self.free[tokens]
                    self.sizes.pop(bisect_left(self.sizes, tokens))
        offset = self.used[b]
        self.used[b] += length
        tokens, documents, attention = tokens - length, documents - 1, attention - cost
        if tokens > 0 and documents > 0:
            if tokens not in self.free:
                self.free[tokens] = {}
                insort(self.sizes, tokens)
            heapq.heappush(self.free[tokens].setdefault((documents, attention), []), b)
        return b, offset


def fit(lengths: list[int], cap: Capacity) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, given in the order to be packed."""
    bins = Bins(cap)
    return [bins.add(n) for n in lengths]


def pieces(documents: DataFrame, vocabulary: str | None = None, tokens: int = 4096, with_ids: bool = False) -> DataFrame:
    """Token pieces of every whole text: ``doc_id, piece, start, length, ids_crc32, spread`` and ``ids`` if asked.

    A document's ids end with ``END_ID``; a null or empty text is that one id.  Only documents of more
    than ``tokens`` ids are cut, every ``tokens`` ids.  Repeated rows and rows without doc_id are documents of
    their own.  ``ids`` are packed little-endian uint32 bytes.
    """
    small_batches(documents.sparkSession)
    path = vocabulary or default_vocabulary(VOCABULARY)
    end, width = END_ID.to_bytes(4, "little"), 4 * tokens

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.packed(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at: at + width]
                    rows.append((doc_id, k, k * tokens, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            keep = slice(None) if with_ids else slice(0, 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)][keep], names[keep])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    out = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, schema)
    return out.withColumn("spread", F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()))


def pack(documents: DataFrame, vocabulary: str | None = None, cap: Capacity | None = None, with_ids: bool = False,
         group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack every document's pieces into sequences; one row per piece with ``sequence_id`` and ``offset``.

    Vector best fit: pieces in decreasing length, each into the open sequence of its group whose weighted residual
    norm over free tokens, document places and attention cost is smallest, under all three capacities;
    ties go to the oldest sequence.  Offsets run from 0 without gaps.  A piece that alone breaks the
    attention capacity gets a sequence of its own.  An empty table gives no rows; a null or empty text
    is one piece of one id; repeated rows are packed each.  Other columns of ``documents`` are not read.
    """
    cap = cap or Capacity()
    cut = stored(pieces(documents, vocabulary, cap.tokens, with_ids), "pieces")
    groups = max(1, -(-cut.count() // group_pieces))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def place(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "spread"], ascending=[False, True], kind="stable").reset_index(drop=True)
        at = fit(part["length"].tolist(), cap)
        part["sequence_id"] = [int(key[0]) << 32 | b for b, _ in at]
        part["offset"] = [o for _, o in at]
        return part[[*columns, "sequence_id", "offset"]]

    kinds = dict(cut.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sequence_id long, offset long"
    return (cut.withColumn("grp", F.pmod("spread", F.lit(groups))).groupBy("grp").applyInPandas(place, schema))
