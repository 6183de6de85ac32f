"""Token counts of a byte-level BPE by heap-and-linked-list merging (no identifiers are emitted).

A text is cut into words by the tokenizer's own split rule. A word counts as
its initial symbols (bytes) minus the merges that ``bpe.Ranks.merge`` makes.
Special strings of the tokenizer inside a text count as one token each.

Defined results: a null or empty text has 0 bytes and 0 tokens; rows are
independent, so ties, repeated rows and an empty table need no rule; extra
columns are kept as they are and the new columns are appended (an input column
of the same name is replaced). Very long texts and words are handled whole.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import small_batches, text_or_empty

#: fixed value: the split rule of byte-level BPE vocabularies of this kind
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: white space beside a blank, or at an end: then a text cannot be cut at single blanks first
_UNEVEN = re.compile(f" [{bpe.SPACE}]|[{bpe.SPACE}] |^[{bpe.SPACE}]|[{bpe.SPACE}]$")


class Counter:
    """Counts tokens; word counts are remembered in bounded caches that never change a result."""

    def __init__(self, path: str):
        self.ranks = r = bpe.ranks(path)
        find = regex.compile(WORDS).findall

        def word(w: str) -> int:
            start = r.start(r.symbols(w))
            return len(start) - r.merge(start)[1]

        words = self.words = bpe.Cache(word)
        #: what stands between two single blanks, counted with the blank before it
        self.chunks = bpe.Cache(lambda chunk: sum(map(words.__getitem__, find(" " + chunk))))
        self.find = find

    def plain(self, text: str) -> int:
        if not text:
            return 0
        if _UNEVEN.search(text):
            return sum(map(self.words.__getitem__, self.find(text)))
        first, *rest = text.split(" ")
        return sum(map(self.words.__getitem__, self.find(first))) + sum(map(self.chunks.__getitem__, rest))

    def count(self, text: str) -> int:
        special = self.ranks.special_re
        if special is None or "<|" not in text:
            return self.plain(text)
        return sum(1 if part in self.ranks.special else self.plain(part) for part in special.split(text))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def n_tokens(text: Column, path: str) -> Column:
    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(path)
        for texts in batches:
            yield pd.Series([c.count(t or "") for t in texts], dtype="int64")

    return count(text)


def with_token_counts(docs: DataFrame, path: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    small_batches(docs.sparkSession)
    body = text_or_empty(text)
    out = docs.withColumns({"n_bytes": F.octet_length(body).cast("long"), "n_tokens": n_tokens(body, path)})
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
