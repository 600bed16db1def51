"""Sizes of texts in tokens of a public byte-level BPE vocabulary.

The vocabulary is a file of ranks whose path is a parameter; every executor reads it
from there. A text is cut into words by the vocabulary's pattern and each distinct word
is encoded once per task, which gives exactly the count of encoding the whole text.
"""

import base64
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The pattern of words that belongs to the vocabulary, and its form for Python's own
# expressions, equal on texts without characters of the last class.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
QUICK = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
NOT_QUICK = r"[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ̀-ͯ‐-‧‰-⁞€]"

_ENCODINGS: dict[str, object] = {}


def encoding(path: str = VOCABULARY):
    """The encoding of a file of ranks, read once per process."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def counter(path: str = VOCABULARY, most_words: int = 500_000) -> Callable[[str | None], int]:
    """A function from text to its number of tokens; 0 for None and ""."""
    enc, words, odd = encoding(path), re.compile(QUICK).findall, re.compile(NOT_QUICK).search

    class Sizes(dict):
        def __missing__(self, word: str) -> int:
            if len(self) >= most_words:
                self.clear()
            n = self[word] = len(enc.encode_ordinary(word))
            return n

    sizes = Sizes()

    def count(text: str | None) -> int:
        if not text:
            return 0
        if odd(text):
            return len(enc.encode_ordinary(text))
        return sum(map(sizes.__getitem__, words(text)))

    return count


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """The number of tokens of a text; 0 for NULL."""

    @F.pandas_udf("bigint")
    def size(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:  # one counter for all batches of a task
        count = counter(path)
        for texts in batches:
            yield pd.Series([count(t) for t in texts], index=texts.index, dtype="int64")

    return size(text)
