"""Elias-Fano sequences and a trie of trigrams over them, in one memory map.

A level of the trie holds, for each node, the number of its parent times the
vocabulary's size plus its own word, so the level is one ascending sequence; a
node's children are the range between two of its pointers, which ascend as
well. Both are Elias-Fano coded. A node is found by successor search within the
range of its context. Probabilities and weights are quantised to a byte.
"""

from __future__ import annotations

import mmap

import numpy as np

U64 = np.uint64
#: Steps of a quantised value, in decades; the code 0 says that there is none.
STEP = 1 / 32
VALUE = np.concatenate([[0.0], 10.0 ** (-STEP * np.arange(255))])

_bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
#: Place of the k-th set bit of a byte.
_place = np.argsort(-_bits, 1, kind="stable").astype(np.int64)


def quantised(p: np.ndarray) -> np.ndarray:
    """Codes of values in (0, 1]; rounded down, so that what is a distribution does not come to more than 1."""
    with np.errstate(divide="ignore"):
        code = 1 + np.ceil(-np.log10(p) / STEP - 1e-9)
    return np.where(code <= 255, np.maximum(code, 1), 0).astype(np.uint8)


class EliasFano:
    """An ascending sequence of n whole numbers: the low bits of each as they are, the high ones in unary. Set and clear bits are counted by byte when it is read."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low = n, low_bits, low
        self.bytes = high.view(np.uint8)
        count = np.bitwise_count(self.bytes)
        self.ones = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 8 - self.ones
        self.top = int(self.zeros[-1])

    @staticmethod
    def arrays(values: np.ndarray) -> list[np.ndarray]:
        """(n and low bits), low, high."""
        values = np.asarray(values, np.int64)
        n, u = len(values), int(values[-1]) + 1 if len(values) else 1
        k = max(0, (u // max(1, n)).bit_length() - 1)
        low = np.zeros((n * k >> 6) + 2, U64)
        if n and k:
            at, own = np.arange(n) * k, (values & ((1 << k) - 1)).view(U64)
            word, off = at >> 6, (at & 63).astype(U64)
            # some value begins in every word, as none is longer than a word
            low[: word[-1] + 1] = np.bitwise_or.reduceat(own << off, np.searchsorted(word, np.arange(word[-1] + 1)))
            over = np.flatnonzero(off + U64(k) > U64(64))
            low[word[over] + 1] |= own[over] >> (U64(64) - off[over])
        bits = np.zeros((u >> k) + n + 1, np.uint8)
        bits[(values >> k) + np.arange(n)] = 1
        raw = np.packbits(bits, bitorder="little")
        high = np.zeros(-(-len(raw) // 8), U64)
        high.view(np.uint8)[: len(raw)] = raw
        return [np.array([n, k], np.int64), low, high]

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i * self.low_bits
        word, off = at >> 6, (at & 63).astype(U64)
        # shifted in two steps, as a shift by 64 is none
        both = (self.low[word] >> off) | ((self.low[word + 1] << U64(1)) << (U64(63) - off))
        return (both & U64((1 << self.low_bits) - 1)).astype(np.int64)

    def select(self, i: np.ndarray, one: bool) -> np.ndarray:
        """Place of the i-th set (or clear) bit of high."""
        before = self.ones if one else self.zeros
        byte = np.searchsorted(before, i, "right") - 1
        own = self.bytes[byte] if one else ~self.bytes[byte]
        return byte * 8 + _place[own, i - before[byte]]

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return ((self.select(i, True) - i) << self.low_bits) | self.lows(i)

    def find(self, x: np.ndarray, begin: np.ndarray | int = 0, end: np.ndarray | None = None) -> np.ndarray:
        """Index of each x within [begin, end) of the sequence, or -1: the successor of x there, if it is x."""
        out = np.full(len(x), -1, np.int64)
        h = x >> self.low_bits
        ok = np.flatnonzero((h >= 0) & (h < self.top))
        if not len(ok):
            return out
        x, h = x[ok], h[ok]
        lo = np.where(h > 0, self.select(np.maximum(h - 1, 0), False) - (h - 1), 0)
        hi = self.select(h, False) - h
        if end is not None:
            lo, hi = np.maximum(lo, begin[ok]), np.minimum(hi, end[ok])
        last, low = np.minimum(hi, self.n), x & ((1 << self.low_bits) - 1)
        hi = last.copy()
        at = np.flatnonzero(lo < hi)
        while len(at):
            mid = (lo[at] + hi[at]) >> 1
            less = self.lows(mid) < low[at]
            lo[at], hi[at] = np.where(less, mid + 1, lo[at]), np.where(less, hi[at], mid)
            at = at[lo[at] < hi[at]]
        found = lo < last
        found[found] = self.lows(lo[found]) == low[found]
        out[ok[found]] = lo[found]
        return out


class Trie:
    """Vocabulary, first words, pairs and triples, read from one block of bytes."""

    SEQUENCES = ("words", "first", "first_to", "second", "second_to", "third")
    KINDS = [np.int64, U64, U64] * len(SEQUENCES) + [np.uint8] * 3

    def __init__(self, data):
        """data: bytes, or a memory map, as `levels` gives."""
        view, arrays = memoryview(data), []
        at = len(self.KINDS) * 8
        for size, kind in zip(np.frombuffer(view, np.int64, len(self.KINDS)).tolist(), self.KINDS, strict=True):
            arrays.append(np.frombuffer(view, kind, size, at))
            at += -(-arrays[-1].nbytes // 8) * 8
        for k, name in enumerate(self.SEQUENCES):
            own = arrays[3 * k : 3 * k + 3]
            setattr(self, name, EliasFano(int(own[0][0]), int(own[0][1]), *own[1:]))
        self.pair_code, self.weight_code, self.triple_code = arrays[-3:]

    @classmethod
    def levels(cls, words: np.ndarray, first: np.ndarray, second: np.ndarray, total: np.ndarray, context: np.ndarray, third: np.ndarray, count: np.ndarray, priors: tuple[float, float]) -> mmap.mmap:
        """The levels as a memory map.

        words: distinct, ascending. first, second: places of each pair's words,
        ascending by pair; total: how often its first word begins a pair
        anywhere. context, third: place of each triple's pair and last word,
        ascending by triple; count: how often it was seen. What was never seen
        is left out.
        """
        seen = count > 0
        context, third, count = context[seen], third[seen], count[seen]
        pair = np.zeros(len(first), bool)
        pair[context] = True
        first, second, total, context = first[pair], second[pair], total[pair], (np.cumsum(pair) - 1)[context]
        word = np.zeros(len(words), bool)
        word[first] = word[second] = word[third] = True
        place = np.cumsum(word) - 1
        words, first, second, third = words[word], place[first], place[second], place[third]
        size, of_pair = len(words), np.bincount(context, weights=count, minlength=len(first))
        new = np.flatnonzero(np.diff(first, prepend=-1))
        parent = np.cumsum(np.diff(first, prepend=-1) != 0) - 1
        level = [words, first[new], np.append(new, len(first)), parent * size + second, np.searchsorted(context, np.arange(len(first) + 1)), context * size + third]
        arrays = [x for values in level for x in EliasFano.arrays(values)]
        arrays += [quantised(of_pair / (total + priors[0])), quantised(priors[1] / (of_pair + priors[1])), quantised(count / (of_pair[context] + priors[1]))]
        # an own map, not the heap: its pages go back to the system with it
        out = mmap.mmap(-1, len(arrays) * 8 + sum(-(-x.nbytes // 8) * 8 for x in arrays))
        out.write(np.array([len(x) for x in arrays], np.int64).tobytes())
        for x in arrays:
            out.write(x.tobytes() + bytes(-x.nbytes % 8))
        return out

    def look_up(self, words: np.ndarray, first: np.ndarray, second: np.ndarray, context: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of pairs, of their weights as contexts, and of triples, given as for `levels`."""
        word = self.words.find(words)
        pair = self.down(self.first.find(word)[first], word[second], self.first_to, self.second)
        triple = self.down(pair[context], word[third], self.second_to, self.third)
        code = lambda codes, at: np.where(at >= 0, codes[np.maximum(at, 0)], 0).astype(np.uint8) if len(codes) else np.zeros(len(at), np.uint8)
        return code(self.pair_code, pair), code(self.weight_code, pair), code(self.triple_code, triple)

    def down(self, node: np.ndarray, word: np.ndarray, pointers: EliasFano, level: EliasFano) -> np.ndarray:
        """The child of each node (-1: none) for a word."""
        out = np.full(len(node), -1, np.int64)
        ok = np.flatnonzero((node >= 0) & (word >= 0))
        n = node[ok]
        out[ok] = level.find(n * self.words.n + word[ok], pointers[n], pointers[n + 1])
        return out
