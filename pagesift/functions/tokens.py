"""Token counts; the tokenizer is a parameter, a pattern-based stand-in the default."""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words and single signs; special tokens at both ends make two more.
PATTERN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"
SPECIAL = 2
_PATTERN = re.compile(PATTERN, re.ASCII)  # white space as the engine's own patterns have it


def token_length(text: Column, special: int = SPECIAL) -> Column:
    """Tokens of a text by the stand-in, special tokens included; null for null."""
    return F.when(text.isNotNull(), F.size(F.regexp_extract_all(text, F.lit(f"({PATTERN})"), F.lit(1))) + special)


def count_tokens(text: Column, tokenizer=None) -> Column:
    """Tokens of a text without special ones: by the stand-in inside the engine, or by ``tokenizer`` in Arrow batches; null for null."""
    if tokenizer is None:
        return token_length(text, 0)

    @F.pandas_udf("int")
    def counted(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: None if t is None else tokenizer.count(t) - tokenizer.special).astype("Int32")

    return counted(text)


def word_length(text: Column) -> Column:
    """Words parted by white space."""
    return F.when(text.isNotNull(), F.size(F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1))))


class PatternTokenizer:
    """The stand-in for use in Python: ``spans`` of tokens and their number."""

    special = SPECIAL

    def count(self, text: str) -> int:
        return len(_PATTERN.findall(text)) + self.special

    def pieces(self, text: str, size: int) -> list[str]:
        """The text in runs of ``size`` tokens; white space stays with the token before it."""
        starts = [m.start() for m in _PATTERN.finditer(text)]
        cuts = [0, *starts[size::size], len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if text[a:b].strip()]


@lru_cache(maxsize=4)
def _ranks(file: str, pattern: str):
    import tiktoken

    with open(file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@dataclass(frozen=True)
class RankTokenizer:
    """Byte-pair tokens of a rank file (one base64 token and its rank a line), loaded once per worker.

    Counts aren't additive: a text cut in two may have more tokens than it had.
    """

    file: str
    pattern: str = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    special: int = SPECIAL

    def count(self, text: str) -> int:
        return len(_ranks(self.file, self.pattern).encode_ordinary(text)) + self.special

    def pieces(self, text: str, size: int) -> list[str]:
        """The text in runs of ``size`` tokens at most; a cut within a letter moves to the letter's start."""
        enc = _ranks(self.file, self.pattern)
        ids = enc.encode_ordinary(text)
        raw, ends, at = text.encode(), [], 0
        for i, token in enumerate(ids):
            at += len(enc.decode_single_token_bytes(token))
            ends.append(at)
        out, begin, first = [], 0, 0
        while first < len(ids):
            last = min(first + size, len(ids))
            cut = ends[last - 1]
            while cut > begin and cut < len(raw) and raw[cut] & 0xC0 == 0x80:
                cut -= 1
            if cut == begin:  # a letter of more tokens than fit
                cut = ends[last - 1]
                while cut < len(raw) and raw[cut] & 0xC0 == 0x80:
                    cut += 1
            out.append(raw[begin:cut].decode())
            begin = cut
            while first < len(ids) and ends[first] <= cut:
                first += 1
        return [x for x in out if x.strip()]
