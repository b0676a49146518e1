"""Token ids of the public vocabularies inside Spark tasks.

``WordEncoder`` gives exactly the ids of ``tokenizers`` for a lower-casing word BPE with ``</w>`` word
ends, but encodes each distinct white-space separated chunk once per worker: ids are kept as packed
little-endian uint32 bytes, so a document's ids are one ``bytes.join``.  Chunks outside the plain
Latin range (where normalisation or lower-casing has special rules) go through ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import json
import re
import sys
from array import array
from functools import cache

import numpy as np


@cache
def default_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_symbols() -> dict[str, int]:
    """Printable stand-ins that byte-level BPE vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordEncoder(dict):
    """``piece -> packed ids`` of plain lower-case pieces; missing ones are encoded on first use.

    A piece is a white-space separated chunk of a text whose punctuation runs were set apart.
    ``limit``: distinct pieces kept in memory; the table is emptied when it is full.
    """

    #: Texts of ASCII and Latin-1 letters, whose lower case is one character and that NFC leaves alone.
    PLAIN = re.compile("[\t-\r\x20-\x7e¡-§©«®°±»¿-ÿ‘-‟]*")
    PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
    PUNCTUATION = re.compile("[^a-z0-9ß-öø-ÿ\\s]+")
    RUNS = re.compile("[^a-z0-9ß-öø-ÿ\\s]{2}")

    def __init__(self, path: str, limit: int = 600_000):
        super().__init__()
        import tiktoken
        from tokenizers import Tokenizer

        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("packed ids need little-endian 32-bit integers")
        self.limit = limit
        self.exact = Tokenizer.from_file(path)
        symbols = _byte_symbols()
        ranks = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["id"] for x in spec["added_tokens"]}
        self.special = re.compile("|".join(re.escape(x["content"]) for x in spec["added_tokens"]) or r"(?!)")
        for token, i in spec["model"]["vocab"].items():
            if i not in special:
                end = token.endswith("</w>")
                raw = bytes(symbols[c] for c in (token[:-4] if end else token))
                ranks[raw + b"\xff" * end] = i
        self.encode = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks,
                                        special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, chunk: str) -> bytes:
        encode = self.encode
        if chunk.isalpha():
            packed = array("I", encode(chunk.encode() + b"\xff")).tobytes()
        else:
            packed = array("I", [i for piece in self.PIECES.findall(chunk)
                                 for i in encode(piece.encode() + b"\xff")]).tobytes()
        if len(chunk) <= 100:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = packed
        return packed

    def packed(self, text: str | None) -> bytes:
        """Ids of the whole text as little-endian uint32 bytes (empty for null or blank text)."""
        if not text:
            return b""
        if not self.PLAIN.fullmatch(text) or self.special.search(text):
            return array("I", self.exact.encode(text, add_special_tokens=False).ids).tobytes()
        text = text.lower()
        if "'" not in text:  # set punctuation apart, so that fewer distinct chunks remain
            if self.RUNS.search(text):
                text = self.PUNCTUATION.sub(r" \g<0> ", text)
            else:
                text = text.replace(",", " , ").replace(".", " . ")
        return b"".join(map(self.__getitem__, text.split()))


@cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class ByteEncoder:
    """Byte-level BPE from a rank file, with each token's byte span."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for raw, i in ranks.items():
            self.width[i] = len(raw)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the whole text and the byte at which each token starts."""
        ids = np.asarray(self.encoding.encode_ordinary(text), np.int64)
        ends = np.cumsum(self.width[ids])
        return ids, ends - self.width[ids]


@cache
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)
