"""Token counts of a document's sections: each whole text is encoded once, its tokens are attributed by offsets.

The byte-level vocabulary gives every token's byte span; an interval join against the sections' spans says which
sections a token touches.  A token that crosses a boundary goes to one section by an explicit rule: ``first`` (the
section of its first byte) or ``most`` (the one holding most of its bytes, ties to the earlier).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import small_batches
from geoweave.llm.encoding import byte_encoder, default_vocabulary

VOCABULARY = "byte_bpe_50k.tiktoken"


def allocate(start: np.ndarray, end: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token span and whether it crosses a boundary; section i holds ``bounds[i]`` to ``bounds[i + 1]``."""
    first = np.searchsorted(bounds, start, "right") - 1
    last = np.searchsorted(bounds, end - 1, "right") - 1
    own, crossing = first.copy(), last > first
    if rule == "most":
        for k in np.flatnonzero(crossing):
            edges = np.clip(bounds[first[k]: last[k] + 2], start[k], end[k])
            own[k] = first[k] + int(np.argmax(np.diff(edges)))
    elif rule != "first":
        raise ValueError(rule)
    return own, crossing


def line_bounds(raw: bytes) -> np.ndarray:
    """Byte bounds of a text's lines; a line feed ends the line it closes.  Empty text: one empty section."""
    data = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(data == 10) + 1
    if not len(ends) or ends[-1] != len(raw):
        ends = np.append(ends, len(raw))
    return np.concatenate([[0], ends])


def section_tokens(documents: DataFrame, vocabulary: str | None = None, rule: str = "most") -> DataFrame:
    """``doc_id, n_tokens, n_sections, n_crossing, section_tokens`` per row; sections are the lines of the whole text.

    ``section_tokens`` has each line's tokens in order and sums to ``n_tokens``.  A null text counts as empty: no tokens, one
    section.  Repeated rows count each; an empty table gives none; other columns are not read.
    """
    small_batches(documents.sparkSession)
    path = vocabulary or default_vocabulary(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(path)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                ids, start = encoder.spans(text)
                bounds = line_bounds(text.encode())
                own, crossing = allocate(start, start + encoder.width[ids], bounds, rule)
                rows.append((len(ids), len(bounds) - 1, int(crossing.sum()), np.bincount(own, minlength=len(bounds) - 1)))
            n, sections, cross, each = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(sections, pa.int64()), pa.array(cross, pa.int64()),
                 pa.array(each, pa.list_(pa.int64()))], ["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, n_sections long, n_crossing long, section_tokens array<long>")
