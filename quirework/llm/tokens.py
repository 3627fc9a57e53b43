"""Token counts by a public tokenizer's vocabulary file, which is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Callable

#: Any file of ranks in tiktoken's format: a base64 token and its rank in each line.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenizer that belongs to this vocabulary.
DEFAULT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_REMEMBERED = 500_000


class _Counts(dict):
    def __init__(self, encode: Callable[[str], list[int]]):
        self.encode = encode

    def __missing__(self, word: str) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        n = len(self.encode(word))
        if len(word) < 100:
            self[word] = n
        return n


def token_counter(vocabulary: str = DEFAULT_VOCABULARY, pattern: str = DEFAULT_PATTERN) -> Callable[[str | None], int]:
    """Maps a text to its number of tokens; null has none.

    No token of this pre-tokenizer reaches over the start of a run of white space, so a text's count is the sum over its
    words, each with the white space before it, and repeated words are counted once.
    """
    import re

    import tiktoken

    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    counts = _Counts(encoding.encode_ordinary)
    words = re.compile(r"\s*\S+|\s+").findall
    return lambda text: sum(map(counts.__getitem__, words(text))) if text else 0
