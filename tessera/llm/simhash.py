"""Operator 3: SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits (each the majority of the XXH64 of the text's word
shingles). Two fingerprints link at 4 or fewer differing bits. The 64 bits are
cut in three parts; in some two of them together at most 2 bits differ. The
anchors of a pair of parts are the pairs of words of a perfect code of length
23 and covering radius 3 (shorter parts are padded with zeros): every
fingerprint has one home anchor, and it is replicated to every anchor that a
fingerprint within 2 bits can have as its home: 3 bits a part, and 2 more
between them. So of two that link one is at home where the other is a replica.
Members are compared per anchor.

Scale: equal fingerprints are one row before anything else (a group of copies
is one fingerprint). A pair of parts has 2**24 anchors, so an anchor has few
members and comparisons stay near linear until billions of fingerprints;
replicas go only to anchors where one is at home (a bitmap of 2 MB a pair, of
fixed size). An anchor with more than `CELL` homes is dealt out to a grid of
tasks; a task returns, for each fingerprint that has links, one edge to the
least it is connected with there, never all pairs. Components are found over
(least doc_id, fingerprint), so a root has its component_id in it. Texts are
read once and never shuffled.

Defined cases: a null or empty text, or one without words, has fingerprint
zero, and links like any other; fewer words than a shingle give one shingle;
a null doc_id is never the least of a component unless it is alone there
(component_id null); repeated rows each give a row; doc_ids are whole numbers,
others fail when they are read.
"""

from __future__ import annotations

import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import LATEST, components, cut, keep_first, row_keys

BITS = 4
CELL = 16_384
#: First bit and width of each part; which two make a pair.
PARTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Anchors of a pair: 12 bits of each code word tell it from the others.
ANCHORS = 1 << 24
PAGE = 32_768
#: Columns of a grid for each of its rows; fingerprints replicated at once.
WIDE = 4
STEP = 4096
U64 = np.uint64

# Fixed value: a generator polynomial of the binary code of length 23, dimension 12 and distance 7.
GENERATOR = 0b101011100011

_code: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the generator."""
    words = words.astype(np.int64).copy()
    for shift in range(11, -1, -1):
        words ^= ((words >> (shift + 11)) & 1) * (GENERATOR << shift)
    return words


def code() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each syndrome: the error of weight 3 or less that leads home; where its errors of weight 5 or less begin, lightest first; the errors, and what each weighs beyond 3."""
    global _code
    if _code is None:
        single = 1 << np.arange(23, dtype=np.int64)
        layers = [np.zeros(1, np.int64)]
        for weight in range(1, 6):
            grown = np.unique((layers[-1][:, None] | single[None, :]).ravel())
            layers.append(grown[np.bitwise_count(grown) == weight])
        errors = np.concatenate(layers)
        of = syndrome(errors)
        order = np.lexsort((np.bitwise_count(errors), of))
        errors, of = errors[order], of[order]
        beyond = np.maximum(np.bitwise_count(errors).astype(np.int64) - 3, 0)
        home = np.zeros(2048, np.int64)
        near = np.bitwise_count(errors) <= 3
        home[of[near]] = errors[near]
        assert near.sum() == 2048, "the code is perfect: one home for each syndrome"
        _code = home, np.searchsorted(of, np.arange(2049)), errors, beyond
    return _code


def fingerprint(text: bytes, k: int = 4) -> int:
    """64 bits: 1 where more than half of the shingle hashes have it."""
    words = text.lower().split()  # bytes: A-Z only, and white space as it is defined here
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else [b" ".join(words)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), U64)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        votes += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for each row."""

    def run(parts):
        for b in parts:
            fps = [fingerprint(t.as_py() or b"", k) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(np.array(fps, U64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def words_near(fps: np.ndarray, part: int, slack: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The home code word (12 bits) of a part of each fingerprint; and for each excess up to slack the (index, code word) of words at that many bits beyond 3 (excess 0: home)."""
    low, width = PARTS[part]
    own = ((fps >> U64(low)) & U64((1 << width) - 1)).astype(np.int64)
    home, edges, errors, beyond = code()
    s = syndrome(own)
    size = (edges[1:] - edges[:-1])[s]
    which = np.repeat(np.arange(len(fps)), size)
    at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(edges[:-1][s], size)
    word, excess = (own[which] ^ errors[at]) >> 11, beyond[at]
    return (own ^ home[s]) >> 11, [(which[excess == e], word[excess == e]) for e in range(slack + 1)]


def crossed(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, anchor) of every pair of a word of one part and a word of the other, for each of n fingerprints."""
    (ia, wa), (ib, wb) = a, b
    many = np.bincount(ib, minlength=n)
    begin = np.cumsum(many) - many
    size = many[ia]
    left = np.repeat(np.arange(len(ia)), size)
    right = np.arange(len(left)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[ia], size)
    return ia[left], wa[left] << 12 | wb[right]


def homes(fps: np.ndarray) -> np.ndarray:
    """The home anchor of each fingerprint for each pair, numbered over all pairs: a row a pair."""
    own = [words_near(fps, p, 0)[0] for p in range(len(PARTS))]
    return np.stack([k * ANCHORS + (own[p] << 12 | own[q]) for k, (p, q) in enumerate(PAIRS)])


def reached(fps: np.ndarray, slack: int):
    """(index, anchor) of the anchors in reach, some at a time: with as many bits beyond 3 a part as slack allows for both together."""
    near = [words_near(fps, p, slack)[1] for p in range(len(PARTS))]
    for k, (p, q) in enumerate(PAIRS):
        for e in range(slack + 1):
            for f in range(slack + 1 - e):
                index, anchor = crossed(near[p][e], near[q][f], len(fps))
                yield index, k * ANCHORS + anchor


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least index that each of n nodes reaches by links (a[i], b[i])."""
    root = np.arange(n)
    while True:
        before = root
        low = np.minimum(root[a], root[b])
        root = root.copy()
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        while not np.array_equal(root[root], root):
            root = root[root]
        if np.array_equal(root, before):
            return root


def linked(homes: np.ndarray, others: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, least fingerprint it is connected with) among members of a cell. Links are folded as they are found, so memory stays with the members."""
    nodes = np.unique(np.concatenate([homes, others]))
    h, o = np.searchsorted(nodes, homes), np.searchsorted(nodes, others)
    root = np.arange(len(nodes))
    step = max(1, (1 << 21) // max(1, len(others)))
    for i in range(0, len(homes), step):
        near = np.bitwise_count(homes[i : i + step, None] ^ others[None, :]) <= bits
        x, y = np.nonzero(near)
        a, b = root[h[i + x]], root[o[y]]
        keep = a != b
        if keep.any():
            pairs = np.unique(np.stack([a[keep], b[keep]], 1), axis=0)
            root = roots(pairs[:, 0], pairs[:, 1], len(nodes))[root]
    some = root != np.arange(len(nodes))
    return nodes[some], nodes[root[some]]


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """Edges (a, b) that connect every two of the distinct fingerprints (column fp) at `bits` or fewer differing bits."""
    if not 0 <= bits <= 4:
        raise ValueError("two parts with two bits of slack reach 4 differing bits")
    slack = 2 * bits // 3

    def settle(parts):
        for b in parts:
            yield pa.record_batch([pa.array(homes(b.column(0).to_numpy().view(U64)).ravel())], names=["anchor"])

    settled = cut(distinct.select("fp").mapInArrow(settle, "anchor long").groupBy("anchor").agg(F.count("*").alias("n")))
    # pages of a bitmap of 3 x 2**24 bits: 6 MB, whatever the corpus
    pages = settled.groupBy((F.col("anchor") / PAGE).cast("long").alias("page")).agg(F.bitmap_construct_agg((F.col("anchor") % PAGE)).alias("bits")).collect()
    known = np.zeros(len(PAIRS) * ANCHORS // 8, np.uint8)
    for r in pages:
        known[r.page * PAGE // 8 : (r.page + 1) * PAGE // 8] = np.frombuffer(r.bits, np.uint8)[: PAGE // 8]
    packed = zlib.compress(known.tobytes(), 1)
    split = sorted((r.anchor, -(-r.n // CELL)) for r in settled.where(f"n > {CELL}").collect())
    large, high = np.array([*split, (1 << 40, 1)], np.int64).T

    def deal(parts):
        known = np.frombuffer(zlib.decompress(packed), np.uint8)
        for b in parts:
            for i in range(0, b.num_rows, STEP):
                fps = b.column(0)[i : i + STEP].to_numpy().view(U64)
                spread = ((fps * U64(0x9E3779B97F4A7C15)) >> U64(33)).astype(np.int64)
                every = np.arange(len(fps))
                for kind, index, anchor in [*((0, every, h) for h in homes(fps)), *((1, *r) for r in reached(fps, slack))]:
                    if kind:
                        some = (known[anchor >> 3] >> (anchor & 7).astype(np.uint8)) & 1 == 1
                        index, anchor = index[some], anchor[some]
                    at = np.searchsorted(large, anchor)
                    hot = large[at] == anchor
                    rows = np.where(hot, high[at], 1)
                    columns = np.where(hot, WIDE * high[at], 1)
                    copies = columns if kind == 0 else rows  # a home meets every column, a replica every row
                    at = np.repeat(np.arange(len(anchor)), copies)
                    other = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
                    own = spread[index[at]] % (rows if kind == 0 else columns)[at]
                    row, column = (own, other) if kind == 0 else (other, own)
                    # one long per cell: pair and anchor (26 bits), row and column of the grid
                    cell = (anchor[at] << 36) | (row << 18) | column
                    yield pa.record_batch([pa.array(cell), pa.array(np.full(len(at), kind, np.int8)), pa.array(fps[index[at]].view(np.int64))], names=["cell", "kind", "fp"])

    def compare(parts):
        """Cells come sorted; each is held whole (CELL homes and CELL replicas at about the most)."""
        held: list[pa.Table] = []

        def run(t: pa.Table):
            cell, kind, fp = t.column("cell").to_numpy(), t.column("kind").to_numpy(), t.column("fp").to_numpy().view(U64)
            edges = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
            found = []
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                k, f = kind[s:e], fp[s:e]
                if (homes := f[k == 0]).size and (others := f[k == 1]).size > 1:
                    found.append(linked(homes, others, bits))
            a, b = (np.concatenate([x[i] for x in found] or [np.zeros(0, U64)]) for i in (0, 1))
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in parts:
            held.append(pa.Table.from_batches([batch]))
            t = pa.concat_tables(held)
            if t.num_rows < 100_000:
                continue
            cell = t.column("cell").to_numpy()
            last = int(np.searchsorted(cell, cell[-1]))
            if last:
                yield run(t.slice(0, last))
            held = [t.slice(last)]
        if held:
            yield run(pa.concat_tables(held))

    return distinct.select("fp").mapInArrow(deal, "cell long, kind byte, fp long").repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "a long, b long").distinct()


def membership(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """fp, root: the (at, fp) that links reach, at being the least doc_id of a fingerprint (`LATEST`: none)."""
    distinct = cut(prints.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(LATEST)).alias("at")))
    node = F.struct("at", "fp")
    end = lambda c: distinct.select(F.col("fp").alias(c), node.alias(f"node_{c}"))
    edges = links(distinct, bits).join(end("a"), "a").join(end("b"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    member = components(edges).select(F.col("node.fp").alias("fp"), "root")
    return distinct.join(member, "fp", "left").select("fp", F.coalesce("root", node).alias("root"))


def near_duplicates(docs: DataFrame, k: int = 4, bits: int = BITS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links reach, for each row."""
    prints = cut(fingerprints(docs, k, text, key))
    named = membership(prints, bits).select("fp", F.when(F.col("root.at") != LATEST, F.col("root.at")).alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """The rows and columns of docs, one row of each component: the smallest doc_id (null last), then the least by a hash of the row."""

    def run(parts):
        for b in parts:
            fps = [fingerprint(t.as_py() or b"") for t in b.column(3)]
            ids = [None if i == LATEST else i for i in b.column(0).to_pylist()]
            yield pa.record_batch([*b.columns[:3], pa.array(ids, pa.int64()), pa.array(np.array(fps, U64).view(np.int64))], names=["__at", "__h", "__g", "doc_id", "fp"])

    rows = row_keys(docs).select("__at", "__h", "__g", F.col("row.text").cast("string").cast("binary").alias("text"))
    prints = cut(rows.mapInArrow(run, "__at long, __h long, __g int, doc_id long, fp long"))
    return keep_first(docs, prints.join(membership(prints).select("fp", F.col("root.fp").alias("root")), "fp").select("__at", "__h", "__g", "root"))
