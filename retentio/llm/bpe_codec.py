"""BPE encoding and decoding: speculate by greedy longest match, verify adjacent pairs, merge exactly where that fails.

For a word, greedy longest match proposes tokens. The proposal is the BPE
result if and only if each token is reachable and no merge crosses a border
between two adjacent tokens. ``compatible`` tests all borders of a batch of
words at once with numpy; only words with a failing border are merged exactly
on the heap (``bpe.Ranks.merge``).

The border test walks back in time over the right spine of the left token and
the left spine of the right token. Two spine symbols x, y stand side by side
from their creation until the earlier of their next merges; a merge of (x, y)
crosses the border if its rank comes before that. It holds for rank tables
whose parts are always made before the whole, which is checked when the table
is loaded; a table that fails the check is merged exactly throughout.

Defined results: null or empty text has no ids and decodes to ""; rows are
independent; extra columns are kept, columns of the same names replaced; long
texts and words are handled whole.
"""

from __future__ import annotations

import gc
import hashlib
import re
import unicodedata
from functools import lru_cache
from typing import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .bpe_batch import BatchMerger
from .common import small_batches, text_or_empty

#: fixed value: the split rule of the lower-case vocabulary with word ends
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
#: str.split() takes these as white space, the tokenizer does not
_CONTROL = re.compile("[\x1c-\x1f]")
_NEVER = np.iinfo(np.int64).max


class Codec:
    def __init__(self, path: str):
        self.ranks = r = bpe.ranks(path)
        self.find = regex.compile(WORDS).findall
        self.find_lines = regex.compile(WORDS + r"|\n").findall
        self.names = {i: t for t, i in r.vocab.items()} | {i: t for t, i in r.special.items()}
        size = max(self.names) + 1
        self.size = size
        self.made = np.full(size, -1, np.int64)  # rank of the merge that makes a token; -1: a single byte
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.sound = len({m for _, m in r.pairs.values()}) == len(r.pairs)
        keys = np.empty(len(r.pairs), np.int64)
        rank = np.empty(len(r.pairs), np.int64)
        for k, ((a, b), (n, m)) in enumerate(r.pairs.items()):
            self.made[m], self.left[m], self.right[m] = n, a, b
            keys[k], rank[k] = a * size + b, n
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], rank[order]
        whole = np.array([m for _, m in r.pairs.values()], np.int64)
        if len(whole):
            own = self.made[whole]
            self.sound &= bool(((self.made[self.left[whole]] < own) & (self.made[self.right[whole]] < own)).all())
        reach = {i for i in r.vocab.values() if self.made[i] < 0}
        if self.sound and len(whole):
            ok = self.compatible(self.left[whole], self.right[whole], self.made[whole])
            for m, good in sorted(zip(whole.tolist(), ok.tolist()), key=lambda x: self.made[x[0]]):
                if good and int(self.left[m]) in reach and int(self.right[m]) in reach:
                    reach.add(m)
        #: what greedy matching may propose, inside a word and at its end
        end = r.suffix
        self.inner = {t: i for t, i in r.vocab.items() if i in reach and not (end and t.endswith(end))}
        self.final = {t[: len(t) - len(end)]: i for t, i in r.vocab.items() if i in reach and t.endswith(end)} if end else self.inner
        #: the longest token that begins with two given characters
        self.span: dict[str, int] = {}
        for t in [*self.inner, *self.final]:
            self.span[t[:2]] = max(self.span.get(t[:2], 1), len(t))
        #: words and chunks as ids, as digest parts and as bytes; a job fills one of them. Digest parts hold the ids and
        #: the decoded text as strings, several times the bytes of ids alone
        self.words, self.chunks, self.raw = bpe.Cache(), bpe.Cache(limit=4 * bpe.MAX_BYTES), bpe.Cache(limit=2 * bpe.MAX_BYTES)
        self.merger = BatchMerger(r)

    # -- verify ---------------------------------------------------------------------------------------------
    def pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        code = x * self.size + y
        at = np.minimum(np.searchsorted(self.keys, code), len(self.keys) - 1)
        return np.where(self.keys[at] == code, self.rank[at], _NEVER)

    def compatible(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair of adjacent tokens: no merge crosses their border before ``limit`` (a rank; none: ever)."""
        x, y = x.copy(), y.copy()
        n = len(x)
        limit = np.full(n, _NEVER, np.int64) if limit is None else limit.copy()
        good, live = np.ones(n, bool), np.arange(n)
        while len(live):
            a, b = x[live], y[live]
            crosses = self.pair_rank(a, b) < limit[live]
            good[live[crosses]] = False
            keep = ~crosses & ((self.made[a] >= 0) | (self.made[b] >= 0))
            live, a, b = live[keep], a[keep], b[keep]
            late = self.made[a] > self.made[b]  # of two equal tokens the left one is made first
            x[live] = np.where(late, self.right[a], a)
            y[live] = np.where(late, b, self.left[b])
            limit[live] = np.where(late, self.made[a], self.made[b] + 1)
        return good

    # -- speculate ------------------------------------------------------------------------------------------
    def propose(self, s: str) -> list[int]:
        ids, i, n = [], 0, len(s)
        inner, final, span, stop = self.inner, self.final, self.span, n - bool(self.ranks.suffix)
        while i < n:
            longest = span.get(s[i : i + 2], 1)
            if n - i <= longest and (hit := final.get(s[i:])) is not None:
                ids.append(hit)
                break
            for j in range(min(stop, i + longest), i, -1):
                if (hit := inner.get(s[i:j])) is not None:
                    ids.append(hit)
                    i = j
                    break
        return ids

    def exact(self, symbols: str) -> list[int]:
        return self.ranks.merge(self.ranks.start(symbols))[0]

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word: proposals of all words, one vectorised test of all borders, exact merges where it fails."""
        symbols = [self.ranks.symbols(w) for w in words]
        if not self.sound:
            return [tuple(self.exact(s)) for s in symbols]
        got = [self.propose(s) for s in symbols]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((t for ids in got for t in ids), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(got)), sizes)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        if len(inside):
            code, back = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
            good = self.compatible(code // self.size, code % self.size)[back]
            for k in np.unique(owner[inside[~good]]).tolist():
                got[k] = self.exact(symbols[k])
        return [tuple(ids) for ids in got]

    # -- texts ----------------------------------------------------------------------------------------------
    def parts(self, text: str) -> list[tuple[list[str], int]]:
        """The text as runs of white-space-free chunks, each run followed by a special id (-1: none)."""
        special = self.ranks.special_re
        pieces = special.split(text) if special is not None and "<|" in text else [text]
        out = []
        for k in range(0, len(pieces), 2):
            body = pieces[k]
            if not body.isascii():
                body = unicodedata.normalize("NFC", body).replace("Σ", "σ")
            body = body.lower()
            chunks = self.find(body) if _CONTROL.search(body) else body.split()
            out.append((chunks, self.ranks.special[pieces[k + 1]] if k + 1 < len(pieces) else -1))
        return out

    def learn(self, parts: list[list[tuple[list[str], int]]], cache: bpe.Cache, values, join) -> dict:
        """The value of every chunk of a batch: ``values`` gives those of a list of words, ``join`` that of several words.

        ``cache`` keeps the values of words and of chunks of several words alike: a word is the chunk that holds it alone.
        It is returned and holds every chunk of the batch until the next call.
        """
        cache.turn()
        new = cache.recall(set().union(*(chunks for doc in parts for chunks, _ in doc)))
        mixed = [c for c in new if not (c.isascii() and c.isalpha())]
        # one search over all of them: a chunk holds no white space, so the line breaks that come back part them
        found = self.find_lines("\n".join(mixed))
        words = {c for c in new if c.isascii() and c.isalpha()}
        words.update(found)
        words.discard("\n")
        fresh = cache.recall(words)
        cache.add(fresh, list(values(fresh)))
        value, begin, chunks, joined = cache.__getitem__, 0, [], []
        ends = [k for k, w in enumerate(found) if w == "\n"]
        for c, end in zip(mixed, [*ends, len(found)]):
            if c not in cache:
                chunks.append(c)
                joined.append(join(list(map(value, found[begin:end]))))
            begin = end + 1
        cache.add(chunks, joined)
        return cache

    def encode(self, text: str) -> list[int]:
        parts = [self.parts(text)]
        view = self.learn(parts, self.words, self.encode_words, lambda runs: tuple(i for ids in runs for i in ids))
        return [i for chunks, end in parts[0] for i in [*(i for c in chunks for i in view[c]), *([end] if end >= 0 else [])]]

    def decode(self, ids) -> str:
        """As the library decodes when the file names no decoder: the token strings joined by blanks."""
        return " ".join(self.names[i] for i in ids)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    made = Codec(path)
    gc.freeze()  # the tables stay: later collections need not walk them
    return made


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` array<int>."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path)
        for texts in batches:
            yield pd.Series([c.encode(t) for t in texts])

    return docs.withColumn("ids", ids(text_or_empty(text)))


def decode(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``docs`` with ``decoded``: the text that the library's decode gives for ``ids`` (null ids: "")."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path)
        for rows in batches:
            yield pd.Series([c.decode(row) if row is not None else "" for row in rows], dtype=object)

    return docs.withColumn("decoded", decoded(F.col(ids)))


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256; ids and decoded text stay inside one batch."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(path)

        def shown(ids) -> tuple[int, str, str]:
            return len(ids), " ".join(map(str, ids)), c.decode(ids)

        def joined(runs: list[tuple[int, str, str]]) -> tuple[int, str, str]:
            return sum(r[0] for r in runs), " ".join([r[1] for r in runs]), " ".join([r[2] for r in runs])

        for texts in batches:
            parts = [c.parts(t) for t in texts]
            view = c.learn(parts, c.chunks, lambda ws: map(shown, c.encode_words(ws)), joined)
            rows = []
            for doc in parts:
                got = []
                for chunks, end in doc:
                    got += map(view.__getitem__, chunks)
                    if end >= 0:
                        got.append(shown([end]))
                got = [g for g in got if g[0]]
                rows.append((sum(g[0] for g in got), *(hashlib.sha256(" ".join([g[k] for g in got]).encode()).hexdigest() for k in (1, 2))))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    out = docs.withColumn("_codec", digests(text_or_empty(text)))
    return out.withColumns({n: F.col(f"_codec.{n}") for n in ("n_tokens", "ids_sha256", "decoded_sha256")}).drop("_codec")
