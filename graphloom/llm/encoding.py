"""Token ids of whole texts with a byte-level BPE, and the bytes that each token covers.

The vocabulary is a file of ranks; its path is a parameter. A byte-level BPE loses nothing: the tokens' bytes in a row
are the text's bytes, so where each token begins and ends follows from the lengths of the tokens alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from pathlib import Path

import numpy as np

#: A public vocabulary of 50,256 tokens; one id more marks the end of a text.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that vocabulary's tokenizer cuts a text into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Long runs of what `\s` means there.
_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{512,}")


class Encoder:
    """Encodes texts with the ranks of a vocabulary file; `bytes_of[id]` is a token's length in bytes."""

    def __init__(self, vocabulary: bytes) -> None:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
        self._encoding = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.bytes_of = np.zeros(self.end + 1, np.int64)
        for token, rank in ranks.items():
            self.bytes_of[rank] = len(token)

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids of the whole text; a null has none. What looks like a special token is ordinary text.

        The pattern walks back through a run of white space, and its stack gives out on a very long one. Such a run is
        one piece but for its last character, which begins the next piece unless the text ends: it is encoded as that,
        and what lies between such runs by the pattern, which gives the same ids.
        """
        if not text:
            return np.zeros(0, np.int32)
        parts, done = [], 0
        for m in _BLANK.finditer(text):
            end = m.end() - (m.end() < len(text))
            parts += [self._encoding.encode_ordinary(text[done : m.start()]), self._encoding._encode_single_piece(text[m.start() : end])]
            done = end
        parts.append(self._encoding.encode_ordinary(text[done:] if done else text))
        return np.concatenate([np.array(p, np.int32) for p in parts])

    def decode(self, ids: np.ndarray) -> str:
        return self._encoding.decode_bytes(np.asarray(ids).tolist()).decode()


@lru_cache(maxsize=2)
def encoder(vocabulary: bytes) -> Encoder:
    """One encoder for each process and vocabulary."""
    return Encoder(vocabulary)


@lru_cache(maxsize=2)
def vocabulary_of(path: str = VOCABULARY) -> bytes:
    """The vocabulary file, which the driver alone reads: executors get its content with their tasks."""
    return Path(path).read_bytes()


def digest(ids: np.ndarray) -> str:
    """SHA-256 of the ids as little-endian 32-bit integers."""
    return hashlib.sha256(np.ascontiguousarray(ids, "<i4").tobytes()).hexdigest()
