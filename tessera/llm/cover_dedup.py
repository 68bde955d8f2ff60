"""Operator 9: removal of 50-word windows that start in an earlier document, with difference-cover anchors.

Anchors are 20-word strings at the word positions of a document that are in a
difference cover modulo 31: for any two positions i and j there is an l below
31 with i + l and j + l both in the cover, so two equal windows of 50 words
share an aligned anchor wherever they lie. A match then extends to the windows
around the anchor (`windows` has the plan).

Defined cases: see `windows`; words are runs of bytes other than space and
\\t \\n \\v \\f \\r, compared as they are; texts under 50 words lose nothing.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import arrays
from tessera.llm.suffix_dedup import rewritten
from tessera.llm.windows import Anchors, Block, Scheme, remove_windows

LENGTH = 50
PERIOD = 31
#: Every difference modulo 31 occurs once among these.
COVER = (1, 5, 11, 24, 25, 27)
GRAM = LENGTH - PERIOD + 1
U64 = np.uint64


def word_values(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the first word of each row (and the end)."""
    values, first = [np.zeros(0, U64)], [np.zeros(1, np.int64)]
    total = 0
    for i, j in arrays.slices(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        s, e = arrays.words(part, at)
        values.append(arrays.span_hash(arrays.prefix(arrays.BYTE_VALUE[part]), s, e))
        first.append(np.searchsorted(s, at[1:]) + total)
        total += len(s)
    return np.concatenate(values), np.concatenate(first)


def load(texts: pa.ChunkedArray) -> Block:
    values, starts = word_values(*arrays.utf8(texts))
    sums = arrays.prefix(values)
    size = np.diff(starts)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(values)) - starts[:-1][row]
    chosen = np.zeros(PERIOD, bool)
    chosen[list(COVER)] = True
    at = np.flatnonzero(chosen[place % PERIOD] & (place + GRAM <= size[row]) & (size[row] >= LENGTH))
    row, place = row[at], place[at]
    first = np.maximum(place - PERIOD + 1, 0)
    count = np.minimum(place, size[row] - LENGTH) - first + 1
    ok = count > 0
    at, row, place, first, count = at[ok], row[ok], place[ok], first[ok], count[ok]
    begin = starts[:-1][row] + first
    end = begin + count - 1 + LENGTH
    context = arrays.mix(arrays.span_hash(sums, begin, end) + (place - first).astype(U64))
    check = arrays.span_hash(arrays.prefix(arrays.mix(values)), begin, end).astype(np.uint32)
    return Block(starts, Anchors(row, arrays.span_hash(sums, at, at + GRAM), context, check, begin, count), extra={"sums": sums})


def payloads(block: Block, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], count)
    return hashes(block, at).view(np.uint8), 8 * offsets


def classes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    count = np.diff(offsets) // 8
    owner = np.repeat(np.arange(len(count)), count)
    place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return owner, place, np.unique(np.frombuffer(data.tobytes(), U64), return_inverse=True)[1]


def hashes(block: Block, at: np.ndarray) -> np.ndarray:
    return arrays.span_hash(block.extra["sums"], at, at + LENGTH)


#: Windows are told apart by their hashes, so windows of one hash are equal.
SCHEME = Scheme(K=LENGTH, load=load, payloads=payloads, hashes=hashes, same=lambda _, at, other: np.ones(len(at), bool), classes=classes)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""

    def finish(block: Block, covered: np.ndarray, t: pa.Table) -> pa.Table:
        at = block.starts
        total = np.concatenate([[0], np.cumsum(covered)])
        removed = total[at[1:]] - total[at[:-1]]
        sha = []
        for i, text in enumerate(t.column("text").cast(pa.binary())):
            own = (text.as_py() or b"").split()
            if removed[i]:
                own = compress(own, (~covered[at[i] : at[i + 1]]).tolist())
            sha.append(hashlib.sha256(b" ".join(own)).hexdigest())
        return pa.table([t.column("key"), pa.array(np.diff(at)), pa.array(removed), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return remove_windows(docs.select("doc_id", "text"), SCHEME, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows and columns of docs, the kept words of the text joined by one space."""

    def kept(block: Block, covered: np.ndarray, t: pa.Table) -> list[str | None]:
        at = block.starts
        texts = [x.as_py() for x in t.column("text").cast(pa.binary())]
        return [None if own is None else b" ".join(compress(own.split(), (~covered[at[i] : at[i + 1]]).tolist())).decode() for i, own in enumerate(texts)]

    return rewritten(docs, SCHEME, kept, text, key)
