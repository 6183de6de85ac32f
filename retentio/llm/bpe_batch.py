"""Exact byte-pair merging of many short words at once, with numpy.

All words of a batch lie in one flat array of symbols. Each round finds the
lowest-rank pair of every word (leftmost of equal ones), merges it and looks up
the ranks of its two new neighbours only; words without a pair leave the array.
Words of more than ``LONGEST`` symbols are merged on the heap instead, so that
rounds stay few.
"""

from __future__ import annotations

import numpy as np

from .bpe import Ranks

LONGEST = 32
SLOTS, _MIX = 18, np.uint64(0x9E3779B97F4A7C15)
_NONE = np.int64(1) << 30
_INDEX = (np.int64(1) << 32) - 1


class BatchMerger:
    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        self.size = max(ranks.vocab.values()) + 1
        made = sorted((a * self.size + b, rank, whole) for (a, b), (rank, whole) in ranks.pairs.items())
        self.keys, self.rank, self.whole = (np.array(c, np.int64) for c in zip(*made))
        #: the first symbol of every byte, within a word and at its end
        self.inner = np.array([ranks.vocab[ranks.byte[b]] for b in range(256)], np.int64)
        self.final = np.array([ranks.last[ranks.byte[b]] for b in range(256)], np.int64) if ranks.suffix else self.inner

        #: a slot for each pair by a hash; pairs that find theirs taken stay in the sorted table alone
        self.slot = np.full(1 << SLOTS, -1, np.int32)
        at = self.hashed(self.keys)
        self.slot[at[::-1]] = np.arange(len(self.keys), dtype=np.int32)[::-1]
        self.crowded = np.zeros(1 << SLOTS, bool)
        self.crowded[at[self.slot[at] != np.arange(len(self.keys))]] = True

    def hashed(self, code: np.ndarray) -> np.ndarray:
        return (code.astype(np.uint64) * _MIX >> np.uint64(64 - SLOTS)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each pair in the table, its rank; _NONE where the table lacks it)."""
        code = left * self.size + right
        h = self.hashed(code)
        at = self.slot[h].astype(np.int64)
        hit = self.keys[at] == code
        rest = np.flatnonzero(~hit & self.crowded[h])
        if len(rest):
            at[rest] = np.minimum(np.searchsorted(self.keys, code[rest]), len(self.keys) - 1)
            hit[rest] = self.keys[at[rest]] == code[rest]
        return at, np.where(hit, self.rank[at], _NONE)

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit numbers."""
        out: list[bytes] = [b""] * len(words)
        coded = list(map(str.encode, words))
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        for k in np.flatnonzero(sizes > LONGEST).tolist():
            out[k] = np.array(self.ranks.merge(self.ranks.start(self.ranks.symbols(words[k])))[0], "<u4").tobytes()
        number = np.flatnonzero((sizes > 0) & (sizes <= LONGEST))
        if not len(number):
            return out
        sizes = sizes[number]
        code = np.frombuffer(b"".join([coded[k] for k in number.tolist()]), np.uint8)
        ids, last = self.inner[code], np.cumsum(sizes) - 1
        ids[last] = self.final[code[last]]
        rank = np.full(len(ids), _NONE)
        place = np.zeros(len(ids), np.int64)
        place[:-1], rank[:-1] = self.find(ids[:-1], ids[1:])
        rank[last] = _NONE
        while len(ids):
            starts = np.cumsum(sizes) - sizes
            best = np.minimum.reduceat((rank << 32) + np.arange(len(ids)), starts)
            done = best >> 32 >= _NONE
            if done.any():
                gone = np.repeat(done, sizes)
                data, end = ids[gone].astype("<u4").tobytes(), 0
                for k, n in zip(number[done].tolist(), sizes[done].tolist()):
                    out[k] = data[end : end + 4 * n]
                    end += 4 * n
                moved = np.cumsum(gone)
                best = best[~done] & _INDEX
                best -= moved[best]
                ids, rank, place = ids[~gone], rank[~gone], place[~gone]
                number, sizes = number[~done], sizes[~done]
                if not len(ids):
                    break
            else:
                best &= _INDEX
            # the left symbol of each best pair becomes the whole, the right one goes
            ids[best] = self.whole[place[best]]
            stay = np.ones(len(ids), bool)
            stay[best + 1] = False
            ids, rank, place = ids[stay], rank[stay], place[stay]
            best = best - np.arange(len(best))  # each word before this one lost a symbol
            sizes = sizes - 1
            ends = np.cumsum(sizes)
            touched = np.concatenate([best[best < ends - 1], best[best > ends - sizes] - 1])
            rank[best] = _NONE
            place[touched], rank[touched] = self.find(ids[touched], ids[touched + 1])
        return out
