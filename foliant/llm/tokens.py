"""Token counts with a public byte-level BPE; the vocabulary's path is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the public pre-splitting pattern of this vocabulary
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str = RANKS):
    """One encoder per worker process and vocabulary file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, path: str = RANKS) -> int:
    return len(encode(text, path))


def encode(text: str | None, path: str = RANKS) -> list[int]:
    """Lone surrogates, which no UTF-8 text has, read as replacement characters; missing text is empty."""
    if not text:
        return []
    try:
        return encoding(path).encode_ordinary(text)
    except UnicodeEncodeError:
        return encoding(path).encode_ordinary(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))
