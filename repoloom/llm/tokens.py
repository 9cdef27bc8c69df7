"""Token ids of a public byte-level BPE, inside tasks."""

from __future__ import annotations

import base64
import sys
from array import array
from functools import lru_cache

CACHE_WORDS = 400_000
SPECIAL = "<|endoftext|>"


class _Unsafe(Exception):
    """A piece between blanks that can't be encoded apart from its neighbours."""


class _Pieces(dict):
    """Ids of a piece between two blanks, with the blank before it, as little-endian bytes.

    The pattern that cuts texts before the merges starts a new piece at every
    blank that stands between two other characters than white space, so pieces
    are encoded on their own and met again from the cache.
    """

    def __init__(self, encode, lead: str):
        super().__init__()
        self.encode, self.lead = encode, lead

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Unsafe
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self.encode(self.lead + piece)
        if len(piece) <= 64:
            self[piece] = out
        return out


class Encoder:
    """Ids equal those of `tokenizers` for the same vocabulary, without added special tokens."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        self.path = path
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.own = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.inner = _Pieces(self.plain, " ")
        self.first = _Pieces(self.plain, "")
        self.full = None

    def plain(self, text: str) -> bytes:
        ids = array("I", self.own.encode_ordinary(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def special(self, text: str) -> bytes:
        """A text with the string of a special token, by the slower library that knows it."""
        import numpy as np
        from tokenizers import Tokenizer

        self.full = self.full or Tokenizer.from_file(self.path)
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """The ids as unsigned 32-bit little-endian bytes."""
        if not text:
            return b""
        if SPECIAL in text:
            return self.special(text)
        head, *rest = text.split(" ")
        try:
            return self.first[head] + b"".join(map(self.inner.__getitem__, rest))
        except _Unsafe:
            return self.plain(text)


@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> Encoder:
    """The encoder of a vocabulary file, one for each worker process."""
    import public_tokenizers

    return Encoder(path or public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
