"""Token ids of public vocabularies, with a cache of the chunks between spaces."""

from __future__ import annotations

import base64
import functools

import numpy as np

#: Chunks kept in a worker's cache, and the longest one that is kept; a full cache starts afresh.
CACHE_CHUNKS, CACHE_LENGTH = 400_000, 64


@functools.cache
def byte_ranks(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class ChunkEncoder(dict):
    """Ids of whole texts as little-endian 32-bit bytes, equal to Tokenizer.encode(text, add_special_tokens=False).

    Word boundaries of the vocabulary's pattern lie before every space that does not continue or end a run of white
    space, so the ids of a text are those of its chunks between spaces, one after another. A text where that does not
    hold, or that holds a special token's string, is encoded whole. The dict maps a chunk to the ids of " " + chunk,
    None where a chunk is no safe unit.
    """

    def __init__(self, json_path: str, ranks_path: str):
        self.whole = tokenizer(json_path)
        self.ranks = byte_ranks(ranks_path)

    def __missing__(self, chunk: str):
        if not chunk or chunk[-1].isspace() or "<|" in chunk:
            ids = None
        else:
            ids = np.array(self.ranks.encode_ordinary(" " + chunk), dtype="<u4").tobytes()
        if len(chunk) <= CACHE_LENGTH:
            if len(self) >= CACHE_CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        parts = list(map(self.__getitem__, rest))
        if None in parts or not first or first[-1].isspace() or "<|" in first:
            ids = self.whole.encode(text, add_special_tokens=False).ids if "<|" in text else self.ranks.encode_ordinary(text)
            return np.array(ids, dtype="<u4").tobytes()
        return np.array(self.ranks.encode_ordinary(first), dtype="<u4").tobytes() + b"".join(parts)


@functools.cache
def chunk_encoder(name: str = "byte_bpe_50k") -> ChunkEncoder:
    """One for each Python worker, as the cache serves all of its tasks."""
    import public_tokenizers

    return ChunkEncoder(public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken"))
