"""Token ids of the public byte-level BPE, as little-endian bytes.

The rank file holds the same vocabulary as ``byte_bpe_50k.json``; the library for it is
several times faster, and the tests hold its ids against those of ``tokenizers``.
Texts are split at the added tokens that the JSON file of the same name lists; each of them is one id.
"""

from __future__ import annotations

import base64
import json
from array import array
from functools import lru_cache

# Fixed value: the vocabulary's word pattern, in the form that avoids backtracking.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


class ByteBpe:
    """Encoder for a ``.tiktoken`` rank file; ids of 2 or 4 bytes each."""

    def __init__(self, path: str, width: int = 4):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        with open(path.removesuffix(".tiktoken") + ".json") as description:
            tokens = json.load(description)["added_tokens"]
        if any(t[flag] for t in tokens for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that depend on their surroundings are not supported")
        self.added = {t["content"]: t["id"] for t in tokens}
        self.library = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=self.added)
        self.code = {2: "H", 4: "I"}[width]
        self.pieces = {rank: piece for piece, rank in ranks.items()} | {rank: token.encode() for token, rank in self.added.items()}

    def encode(self, text: str) -> list[int]:
        if any(token in text for token in self.added):
            return self.library.encode(text, allowed_special=set(self.added))
        return self.library.encode_ordinary(text)

    def ids(self, text: str | None) -> bytes:
        """Ids of the whole text, in the byte order of the machine (little-endian)."""
        return array(self.code, self.encode(text)).tobytes() if text else b""

    def text(self, ids: bytes) -> str:
        return b"".join(map(self.pieces.__getitem__, array(self.code, ids))).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def byte_bpe(path: str, width: int = 4) -> ByteBpe:
    return ByteBpe(path, width)


def default_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
