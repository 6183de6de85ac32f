"""Byte-pair encoding: the rank table and the exact merge on a heap and a linked list.

``merge`` keeps the symbols of one word in a doubly linked list and all
adjacent pairs in a heap keyed by (rank, position). The lowest pair is popped,
checked for staleness and merged; its two new neighbours are pushed. A word of
n symbols costs O(n log n), so a megabyte without a space is no special case.
"""

from __future__ import annotations

import json
import re
import sys
from functools import lru_cache
from heapq import heapify, heappop, heappush

#: white space as the tokenizers' regular expressions define it (Unicode White_Space)
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: caches keep words up to this length, in two generations of at most so many bytes
MAX_CACHED_CHARS, MAX_BYTES = 48, 40 << 20
#: what an entry takes beside its key and value
_ENTRY = 110


def _weight(value) -> int:
    return sys.getsizeof(value) + (sum(map(sys.getsizeof, value)) if type(value) is tuple else 0)


def _weights(values: list) -> int:
    return sum(map(_weight if values and type(values[0]) is tuple else sys.getsizeof, values))


class Cache(dict):
    """A bounded memo: when it is full, it becomes the old generation, of which only words seen again return."""

    def __init__(self, make=None, limit: int = MAX_BYTES):
        super().__init__()
        self.make, self.limit, self.old, self.held, self.long = make, limit, {}, 0, []

    def keep(self, key: str, value):
        if len(key) <= MAX_CACHED_CHARS:
            if self.held >= self.limit:
                self.old, self.held = dict(self), 0
                self.clear()
            self[key] = value
            self.held += _ENTRY + sys.getsizeof(key) + _weight(value)
        return value

    def turn(self) -> None:
        """Between batches: a full generation becomes the old one, and keys too long to keep go."""
        for key in self.long:
            del self[key]
        self.long = []
        if self.held >= self.limit:
            self.old, self.held = dict(self), 0
            self.clear()

    def recall(self, keys) -> list[str]:
        """Of ``keys`` those without a value; what only the old generation holds comes back into the present one."""
        old, new = self.old, [k for k in keys if k not in self]
        known = [k for k in new if k in old]
        if known:
            self.add(known, [old[k] for k in known])
            new = [k for k in new if k not in old]
        return new

    def add(self, keys: list[str], values: list) -> None:
        """Hold new keys at least until ``turn``: a batch reads its values here."""
        self.update(zip(keys, values))
        self.held += _ENTRY * len(keys) + _weights(keys) + _weights(values)
        if max(map(len, keys), default=0) > MAX_CACHED_CHARS:
            self.long += [k for k in keys if len(k) > MAX_CACHED_CHARS]

    def __missing__(self, key: str):
        hit = self.old.get(key)
        return self.keep(key, self.make(key) if hit is None else hit)


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of every byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Ranks:
    """Vocabulary and merge ranks of a tokenizer file of the public ``tokenizers`` layout."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        v = self.vocab
        #: (left id, right id) -> (rank, merged id)
        self.pairs = {(v[a], v[b]): (r, v[a + b]) for r, (a, b) in enumerate(merges)}
        self.byte = byte_alphabet()
        self.shift = str.maketrans({chr(b): c for b, c in self.byte.items()})
        self.last = {c: v[c + self.suffix] for c in self.byte.values()} if self.suffix else {}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def symbols(self, word: str) -> str:
        """The word's UTF-8 bytes in the byte alphabet."""
        if word.isascii() and word.isprintable() and " " not in word:
            return word
        return word.encode("utf-8").decode("latin-1").translate(self.shift)

    def start(self, symbols: str) -> list[int]:
        """Initial symbol ids: one per byte; the last one carries the word-end mark if the model has one."""
        ids = [self.vocab[c] for c in symbols]
        if self.suffix and symbols:
            ids[-1] = self.last[symbols[-1]]
        return ids

    def merge(self, ids: list[int]) -> tuple[list[int], int]:
        """(the merged ids, number of merges); ``ids`` is used up."""
        n, pairs = len(ids), self.pairs
        heap = [(hit[0], i, hit[1], ids[i], ids[i + 1]) for i in range(n - 1) if (hit := pairs.get((ids[i], ids[i + 1])))]
        if not heap:
            return ids, 0
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            _, i, new, left, right = heappop(heap)
            if ids[i] != left:
                continue
            j = after[i]
            if j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = new, -1
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if hit := pairs.get((new, ids[k])):
                    heappush(heap, (hit[0], i, hit[1], new, ids[k]))
            h = before[i]
            if h >= 0 and (hit := pairs.get((ids[h], new))):
                heappush(heap, (hit[0], h, hit[1], ids[h], new))
        return [t for t in ids if t >= 0], merges


@lru_cache(maxsize=4)
def ranks(path: str) -> Ranks:
    return Ranks(path)
