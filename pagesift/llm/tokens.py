"""Token counts by a public tokenizer whose file is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

#: Fixed value: the pattern that belongs to the rank files of this tokenizer family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

DEFAULT_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def encoding(file: str):
    """The encoding of a rank file (one base64 token and its rank a line), loaded once per worker."""
    import tiktoken

    with open(file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
