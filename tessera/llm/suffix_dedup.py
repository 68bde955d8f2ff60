"""Operator 6: removal of 50-byte strings that start in an earlier document, with suffix sorting by bucket-pointer refinement.

Windows are 50 bytes; their anchor is the leftmost least hash among their
16-byte grams, so equal windows have equal anchors (`windows` has the plan).
Contexts that share an anchor but differ are laid end to end and their
suffixes sorted to depth 50: 8-byte grams give the first buckets, and each
bucket of several suffixes is refined by the bucket identifiers at later
offsets (8, 16, 32, ...), which the pass before has just made finer.

Defined cases: see `windows`; texts under 50 bytes lose nothing; strings that
only repeat within one document (or among rows of one doc_id) stay; if a cut
splits a character of several bytes, `dedup` drops the bytes that are left of
it, while digests are of the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import arrays
from tessera.llm.windows import Anchors, Block, Scheme, remove_windows

LENGTH = 50
GRAM = 16
U64 = np.uint64


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for each i, by doubling."""
    have = 1
    while 2 * have <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if w > have else x


def anchors(data: np.ndarray, offsets: np.ndarray) -> Anchors:
    """Anchors of the windows of each row, in slices."""
    found = [[np.zeros(0, k) for k in (np.int64, U64, U64, np.uint32, np.int64, np.int64)]]
    span = LENGTH - GRAM + 1
    for i, j in arrays.slices(offsets):
        base, at = offsets[i], offsets[i : j + 1] - offsets[i]
        part = data[offsets[i] : offsets[j]]
        n = len(part)
        if n < LENGTH:
            continue
        sums = arrays.prefix(arrays.BYTE_VALUE[part])
        starts = np.arange(n - GRAM + 1)
        grams = arrays.span_hash(sums, starts, starts + GRAM)
        bits = U64((1 << n.bit_length()) - 1)
        least = sliding_least((grams & ~bits) | starts.astype(U64), span)
        full = np.diff(at) >= LENGTH
        step = np.zeros(n + 1, np.int8)
        step[at[:-1][full]] += 1
        step[at[1:][full] - LENGTH + 1] -= 1
        ok = np.flatnonzero(np.cumsum(step[: n - LENGTH + 1], dtype=np.int8))
        if not len(ok):
            continue
        place = (least[ok] & bits).astype(np.int64)
        new = np.ones(len(ok), bool)
        new[1:] = place[1:] != place[:-1]
        head = np.flatnonzero(new)
        first, count, place = ok[head], np.diff(np.append(head, len(ok))), place[head]
        # mixed: least hashes crowd near zero, and buckets are ranges
        gram, end = arrays.mix(grams[place]), first + count - 1 + LENGTH
        context = arrays.mix(arrays.span_hash(sums, first, end) + (place - first).astype(U64))
        del grams, least, sums
        check = arrays.span_hash(arrays.prefix(arrays.OTHER_VALUE[part]), first, end).astype(np.uint32)
        found.append([arrays.row_of(first, at) + i, gram, context, check, first + base, count])
    return Anchors(*(np.concatenate(x) for x in zip(*found, strict=True)))


def load(texts: pa.ChunkedArray) -> Block:
    data, offsets = arrays.utf8(texts)
    return Block(offsets, anchors(data, offsets), data)


def suffix_classes(joined: np.ndarray, places: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """For suffixes at places: equal numbers exactly where the first depth bytes are equal. places + depth must not pass the end.

    Bucket-pointer refinement: `rank` holds the bucket of a suffix by its first
    `known` bytes; only suffixes in buckets of several are sorted again, by
    their bucket and the bucket at a later offset. A pass sorts the suffixes
    that a later one looks at, and no others: of a window alone these are 8.
    """
    n = len(joined)
    passes, known = [], 8
    while known < depth:
        passes.append(min(known, depth - known))
        known += passes[-1]
    need = np.zeros(n, bool)
    need[places] = True
    wanted = [need]
    for offset in reversed(passes):
        need = need.copy()
        need[offset:] |= wanted[-1][:-offset]
        wanted.append(need)
    padded = np.concatenate([joined, np.zeros(8, np.uint8)])
    where = np.flatnonzero(wanted.pop())
    grams = np.ndarray((n,), ">u8", padded, 0, (1,))[where].astype(U64)
    rank = np.zeros(n, np.int64)
    rank[where] = np.unique(grams, return_inverse=True)[1]
    low, top = 0, n
    for offset in passes:
        bucket = rank[where] - low
        where = where[(np.bincount(bucket)[bucket] > 1) & wanted.pop()[where]]
        if not len(where):
            break
        key = rank[where] * (top + 1) + rank[np.minimum(where + offset, n - 1)]
        o = np.argsort(key)
        key = key[o]
        new = np.ones(len(o), bool)
        new[1:] = key[1:] != key[:-1]
        rank[where[o]] = top + np.cumsum(new)
        low, top = top, top + len(o) + 1
    return rank[places]


def classes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of each payload: the payload, the window's place in it, the class of equal windows."""
    count = np.diff(offsets) - LENGTH + 1
    owner = np.repeat(np.arange(len(count)), count)
    place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return owner, place, suffix_classes(data, offsets[:-1][owner] + place)


def payloads(block: Block, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = count - 1 + LENGTH
    offsets = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(offsets[-1]), np.uint8)
    for i, j in arrays.slices(offsets):
        at = np.arange(offsets[i], offsets[j]) + np.repeat(first[i:j] - offsets[i:j], size[i:j])
        out[offsets[i] : offsets[j]] = block.data[at]
    return out, offsets


def hashes(block: Block, at: np.ndarray) -> np.ndarray:
    if not len(at):
        return np.zeros(0, U64)
    return arrays.span_hash(arrays.prefix(arrays.BYTE_VALUE[block.data]), at, at + LENGTH)


def same(block: Block, at: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Byte by byte, a slice at a time."""
    out = at == other
    todo = np.flatnonzero(~out)
    for i in range(0, len(todo), 1 << 16):
        k = todo[i : i + (1 << 16)]
        step = np.arange(LENGTH)
        out[k] = (block.data[at[k][:, None] + step] == block.data[other[k][:, None] + step]).all(1)
    return out


SCHEME = Scheme(
    K=LENGTH,
    load=load,
    payloads=payloads,
    hashes=hashes,
    same=same,
    classes=classes,
)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def finish(block: Block, covered: np.ndarray, t: pa.Table) -> pa.Table:
        at, n = block.starts, t.num_rows
        total = np.concatenate([[0], np.cumsum(covered)])
        rise = covered.copy()
        rise[1:] &= ~covered[:-1]
        begins = at[:-1][(np.diff(at) > 0)]
        rise[begins] = covered[begins]
        rises = np.concatenate([[0], np.cumsum(rise)])
        removed = total[at[1:]] - total[at[:-1]]
        sha = []
        for i in range(n):
            own = block.data[at[i] : at[i + 1]]
            sha.append(hashlib.sha256(own[~covered[at[i] : at[i + 1]]] if removed[i] else own).hexdigest())
        return pa.table([t.column("key"), pa.array(np.diff(at)), pa.array(removed), pa.array(rises[at[1:]] - rises[at[:-1]]), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return remove_windows(docs.select("doc_id", "text"), SCHEME, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows and columns of docs, with the covered bytes of the text removed."""

    def kept(block: Block, covered: np.ndarray, t: pa.Table) -> list[str | None]:
        at, valid = block.starts, t.column("text").is_valid().to_pylist()
        return [block.data[i:j][~covered[i:j]].tobytes().decode("utf-8", "ignore") if ok else None for i, j, ok in zip(at[:-1].tolist(), at[1:].tolist(), valid, strict=True)]

    return rewritten(docs, SCHEME, kept, text, key)


def rewritten(docs: DataFrame, scheme: Scheme, kept: Callable[[Block, np.ndarray, pa.Table], list[str | None]], text: str, key: str) -> DataFrame:
    """The rows and columns of docs, the text as `kept` gives it for each block."""
    others = [c for c in docs.columns if c not in (key, text)]
    fields = [T.StructField("key", T.LongType()), T.StructField("text", T.StringType()), *[T.StructField(f"o{i}", docs.schema[c].dataType) for i, c in enumerate(others)]]

    def finish(block: Block, covered: np.ndarray, t: pa.Table) -> pa.Table:
        names = [f.name for f in fields]
        return pa.table([t.column("key"), pa.array(kept(block, covered, t), pa.string()), *[t.column(x) for x in names[2:]]], names=names)

    out = remove_windows(docs, scheme, finish, T.StructType(fields), others, text, key)
    place = {key: "key", text: "text"} | {c: f"o{i}" for i, c in enumerate(others)}
    return out.select(*[F.col(place[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
