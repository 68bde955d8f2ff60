"""Exact removal of windows that also start in an earlier document: the plan shared by operators 6 and 9.

A window is K consecutive units (bytes, or words) of one document. A scheme
chooses *anchors* so that two equal windows always hold an equal anchor at the
same place; an anchor stands for the windows around it, and its *context* is
all they cover. The plan, with every exchange keyed so that no group grows
with the size of a group of copies:

1. documents are dealt to blocks by a hash of doc_id (one exchange of texts,
   reused by the later steps); a block finds its distinct (anchor, context)
   pairs, keeps the earliest document of each, and sends those, packed, to the
   bucket of the anchor; of an anchor with many contexts in the block it sends
   only that;
2. a bucket sorts them: a context that an earlier document has is covered
   whole; an anchor with several contexts is unresolved, the earliest document
   of each context has to be compared window by window;
3. blocks send the contexts of unresolved anchors; the scheme finds equal
   windows among them (for bytes a suffix sort by bucket-pointer refinement).
   Of a hot anchor (with very many contexts, or many in some block) a block
   sends each distinct window once, with its earliest document, to a place of
   the window's own: what one group gets grows with the number of blocks, not
   of documents, and only its earliest row is held;
4. blocks mark what is covered and rewrite their documents.

Anchors are told apart by 48 bits of a hash (two that fall together are only
compared in vain), contexts of one anchor by 96 bits of two hashes. Defined
cases: a null doc_id counts as later than every other; rows that share a doc_id
are not earlier than each other, so neither removes the other, and they need
not share a block (a block is chosen by doc_id and text); a null text has no
windows; other columns keep their names, whatever they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.llm import arrays

#: UTF-8 bytes of text in a block; blocks and buckets grow in number with the corpus, not in size.
BLOCK = 2 << 20
#: Blocks to a bucket (what a worker holds of one grows with it), and blocks to a task, on average: tasks grow in number, not in size.
SHARE = 1
TASK = 8
#: Contexts of one anchor from which its windows are dealt out singly, by their own hash.
HOT = 20_000
#: Contexts of one anchor in a block from which the block doesn't send them, and the anchor is hot everywhere.
LOCAL = 32
#: Rows that are resolved at once in a bucket of unresolved contexts.
CHUNK_ROWS = 10_000
LATEST = np.iinfo(np.int64).max
U64 = np.uint64


@dataclass
class Anchors:
    """Arrays by anchor: row, hash, two context hashes, unit of the first window, number of windows."""

    row: np.ndarray
    key: np.ndarray
    context: np.ndarray
    check: np.ndarray
    first: np.ndarray
    count: np.ndarray


@dataclass
class Block:
    """The units of some documents, one after another. starts: first unit of each row, and the end."""

    starts: np.ndarray
    anchors: Anchors
    data: object = None
    extra: dict = field(default_factory=dict)


@dataclass
class Scheme:
    """K: units in a window. load: Arrow texts to a Block. payloads: the windows [first, first + count) of each pair as bytes, one after another, and where each begins. hashes: of the windows at some units. same: whether windows at units of one hash are equal. classes: of such payloads the payload, the place and the class of each window."""

    K: int
    load: Callable[[pa.ChunkedArray], Block]
    payloads: Callable[[Block, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    hashes: Callable[[Block, np.ndarray], np.ndarray]
    same: Callable[[Block, np.ndarray, np.ndarray], np.ndarray]
    classes: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def short(values: np.ndarray, width: int) -> bytes:
    """Little-endian integers of width bytes each."""
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def long(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").reshape(-1)


def order_keys(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(LATEST).to_numpy() if len(column) else np.zeros(0, np.int64)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Whether each row but the first differs from the one before."""
    return np.logical_or.reduce([c[1:] != c[:-1] for c in columns])


def representatives(block: Block, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct (anchor, context) pairs, by anchor and context: index of an occurrence in the earliest document, its order; for each anchor its pair; whether its document is later."""
    a = block.anchors
    d = order[a.row]
    by = np.lexsort((d, a.check, a.context, a.key))
    new = np.ones(len(by), bool)
    new[1:] = changes(a.key[by], a.context[by], a.check[by])
    pair = np.empty(len(by), np.int64)
    pair[by] = np.cumsum(new) - 1
    rep = by[new]
    return rep, d[rep], pair, d > d[rep][pair]


def crowded(keys: np.ndarray, least: int) -> np.ndarray:
    """Of ascending keys those that occur `least` times or more."""
    edges = np.flatnonzero(np.diff(keys, prepend=~keys[:1], append=~keys[-1:]) != 0)
    size = np.diff(edges)
    return np.repeat(size >= least, size)


@dataclass
class Singles:
    """The windows of some pairs, by equal windows of one anchor, each group by document: the pair, place, unit and document of each, its group, and where groups begin."""

    pair: np.ndarray
    window: np.ndarray
    at: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    group: np.ndarray
    head: np.ndarray

    @classmethod
    def of(cls, block: Block, pairs: np.ndarray, rep: np.ndarray, d: np.ndarray, scheme: Scheme) -> Singles:
        a, own = block.anchors, rep[pairs]
        count = a.count[own]
        owner = np.repeat(np.arange(len(pairs)), count)
        window = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        at, doc = a.first[own][owner] + window, d[pairs][owner]
        hashes = scheme.hashes(block, at)
        both = arrays.mix(hashes ^ a.key[own][owner])
        o = np.lexsort((doc, both))
        new = np.ones(len(o), bool)
        new[1:] = both[o][1:] != both[o][:-1]
        first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(o) else np.zeros(0, np.int64)
        # windows that only share a hash are groups of their own
        new |= ~scheme.same(block, at[o], at[o][first])
        return cls(pairs[owner[o]], window[o], at[o], doc[o], hashes[o], np.cumsum(new) - 1, np.flatnonzero(new))


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Ranges of the key, so that sorted keys have sorted buckets."""
    return ((keys >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def remove_windows(docs: DataFrame, scheme: Scheme, finish: Callable, schema: str | StructType, others: list[str] = (), text: str = "text", key: str = "doc_id") -> DataFrame:
    """finish(block, covered units, Arrow table of the block) gives the resulting record batch of a block. The table has key, text and o0, o1, ... for the other columns."""
    size = docs.select(F.sum(F.octet_length(docs[text]).cast("long"))).first()[0] or 0
    n = max(1, -(-size // BLOCK))
    buckets = -(-n // SHARE)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK))
    order, own = docs[f"`{key}`"].cast("long"), docs[f"`{text}`"].cast("string")
    place = F.pmod(F.xxhash64(order, own), F.lit(n)).cast("int")
    keyed = docs.select(order.alias("key"), own.alias("text"), place.alias("block"), *[docs[f"`{c}`"].alias(f"o{i}") for i, c in enumerate(others)])

    def read(t: pa.Table) -> tuple[Block, np.ndarray]:
        arrays.release()  # what the group before has left
        return scheme.load(t.column("text")), order_keys(t.column("key"))

    def send(t: pa.Table) -> pa.Table:
        block, order = read(t)
        rep, d, _, _ = representatives(block, order)
        a, out = block.anchors, []
        low = int(d.min()) if len(d) else 0
        width = max(1, (int(d.max()) - low).bit_length() + 7 >> 3) if len(d) else 1
        many = crowded(a.key[rep], LOCAL)
        marks, rep, d = np.unique(a.key[rep[many]]), rep[~many], d[~many]
        keys, contexts, checks = a.key[rep], a.context[rep], a.check[rep]
        edges, marked = (np.searchsorted(bucket_of(k, buckets), np.arange(buckets + 1)) for k in (keys, marks))
        for p in np.flatnonzero(np.diff(edges) + np.diff(marked)).tolist():
            s, m = slice(edges[p], edges[p + 1]), slice(marked[p], marked[p + 1])
            out.append((p, int(t.column("block")[0].as_py()), low, width, short(keys[s], 6), short(contexts[s], 8), short(checks[s], 4), short((d[s] - low).view(U64), width), short(marks[m], 6)))
        cols = list(zip(*out, strict=True)) or [[]] * 9
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5), strict=True)], names=["bucket", "block", "low", "width", "keys", "contexts", "checks", "docs", "marks"])

    def judge(t: pa.Table) -> pa.Table:
        """0: nothing known, 1: covered, 2: to be compared, 3: the same of a hot anchor."""
        arrays.release()
        rows = t.select(["block", "low", "width", "keys", "contexts", "checks", "docs", "marks"]).to_pylist()
        size = [len(r["keys"]) // 6 for r in rows]
        joined = lambda c, kind: np.frombuffer(b"".join([r[c] for r in rows]), kind)
        keys, contexts, checks = np.concatenate([long(r["keys"], 6) for r in rows]), joined("contexts", "<u8"), joined("checks", "<u4")
        docs_at = np.concatenate([long(r["docs"], r["width"]).view(np.int64) + r["low"] for r in rows])
        hot = np.unique(np.concatenate([long(r["marks"], 6) for r in rows]))
        verdict = np.zeros(len(keys), np.uint8)
        # a share of the anchors at a time: sorting holds several arrays
        for share in range(SHARE):
            own = np.flatnonzero(keys % U64(SHARE) == share)
            by = own[np.argsort(keys[own], kind="stable")]
            same = keys[by][1:] == keys[by][:-1]
            several = np.zeros(len(by), bool)
            several[1:] |= same
            several[:-1] |= same
            several |= np.isin(keys[by], hot)
            at = by[several]
            if not len(at):
                continue
            key, context, check, d = keys[at], contexts[at], checks[at], docs_at[at]
            o = np.lexsort((d, check, context, key))
            key, context, check, d, at = key[o], context[o], check[o], d[o], at[o]
            new_key = np.ones(len(o), bool)
            new_key[1:] = key[1:] != key[:-1]
            new = new_key.copy()
            new[1:] |= changes(context, check)
            first = np.flatnonzero(new)
            group = np.cumsum(new_key) - 1
            several_contexts = np.bincount(group[first])[group]
            earliest = d[first][np.cumsum(new) - 1]
            verdict[at[d > earliest]] = 1
            dealt = (several_contexts > HOT) | np.isin(key, hot)
            open_ = (d == earliest) & ((several_contexts > 1) | dealt)
            verdict[at[open_]] = np.where(dealt[open_], 3, 2)
        edges = np.cumsum([0, *size])
        found = [(rows[i]["block"], verdict[edges[i] : edges[i + 1]].tobytes()) for i in range(len(rows))]
        return pa.table([pa.array([b for b, _ in found], pa.int32()), pa.array([t.column("bucket")[0].as_py()] * len(found), pa.int32()), pa.array([v for _, v in found], pa.binary())], names=["block", "bucket", "verdict"])

    def verdicts(t: pa.Table, keys: np.ndarray) -> np.ndarray:
        rows = sorted((r["bucket"], r["verdict"]) for r in t.select(["bucket", "verdict"]).to_pylist() if r["verdict"] is not None)
        raw, many = np.frombuffer(b"".join([v for _, v in rows]), np.uint8), crowded(keys, LOCAL)
        assert len(raw) == len(keys) - many.sum(), f"{len(raw)} verdicts for {len(keys) - many.sum()} contexts"
        out = np.full(len(keys), 3, np.uint8)
        out[~many] = raw
        return out

    def show(t: pa.Table, known: pa.Table) -> pa.Table:
        block, order = read(t)
        rep, d, _, _ = representatives(block, order)
        a = block.anchors
        verdict = verdicts(known, a.key[rep])
        number = t.column("block")[0].as_py() if t.num_rows else 0
        todo = np.flatnonzero(verdict == 2)
        own = rep[todo]
        one = Singles.of(block, np.flatnonzero(verdict == 3), rep, d, scheme)
        h = one.head
        parts = [(a.key[own], np.zeros(len(own), U64), todo, np.zeros(len(own), np.int64), d[todo], a.first[own], a.count[own])]
        parts.append((a.key[rep[one.pair[h]]], one.hash[h], one.pair[h], one.window[h], one.doc[h], one.at[h], np.ones(len(h), np.int64)))
        tables = []
        for key, salt, pair, window, doc, first, count in parts:
            data, offsets = scheme.payloads(block, first, count)
            raw = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
            columns = [pa.array(key.view(np.int64)), pa.array(salt.view(np.int64)), pa.array(np.full(len(key), number, np.int32)), pa.array(pair.astype(np.int32)), pa.array(window.astype(np.int32)), pa.array(doc), raw]
            tables.append(pa.table(columns, names=["key", "salt", "block", "pair", "window", "doc", "payload"]))
        return pa.concat_tables(tables)

    def compare(batches):
        """Equal windows of contexts that share an anchor; rows come sorted by (key, salt, doc), so groups are seen whole while a chunk is held, and of a single window only its earliest row is."""
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < CHUNK_ROWS:
                continue
            t = pa.Table.from_batches(held)
            k, s = t.column("key").to_numpy(), t.column("salt").to_numpy()
            cut = int(np.argmax((k == k[-1]) & (s == s[-1])))
            if cut:
                yield from resolve(t.slice(0, cut))
                t = t.slice(cut)
            elif s[-1]:
                yield from resolve(t)
                kinds = t.column("payload").combine_chunks().dictionary_encode().indices.to_numpy()
                t = t.take(pa.array(np.unique(kinds, return_index=True)[1]))
            held = t.combine_chunks().to_batches()
            rows = t.num_rows
        if held:
            yield from resolve(pa.Table.from_batches(held))

    def resolve(t: pa.Table):
        arrays.release()
        d = t.column("doc").to_numpy()
        owner, place, kind = scheme.classes(*arrays.utf8(t.column("payload")))
        if not len(kind):
            return
        least = np.full(int(kind.max()) + 1, LATEST)
        np.minimum.at(least, kind, d[owner])
        hit = d[owner] > least[kind]
        window = t.column("window").to_numpy()[owner[hit]] + place[hit]
        masks = np.zeros(t.num_rows, U64)
        np.bitwise_or.at(masks, owner[hit], U64(1) << window.astype(U64))
        rows = np.flatnonzero(masks)
        if len(rows):
            yield pa.record_batch([t.column("block").take(rows).combine_chunks(), t.column("pair").take(rows).combine_chunks(), pa.array(masks[rows].view(np.int64))], names=["block", "pair", "mask"])

    def mark(t: pa.Table, known: pa.Table) -> pa.Table:
        if not t.num_rows:
            return empty
        block, order = read(t)
        rep, d, pair, later = representatives(block, order)
        a = block.anchors
        covered = np.zeros(int(block.starts[-1]) + 1, np.int32)
        if len(rep):
            verdict = verdicts(known, a.key[rep])
            whole = later | (verdict[pair] == 1)
            np.add.at(covered, a.first[whole], 1)
            np.add.at(covered, a.first[whole] + a.count[whole] - 1 + scheme.K, -1)
            part = known.filter(pc.is_valid(known.column("mask")))
            mask = np.zeros(len(rep), U64)
            np.bitwise_or.at(mask, part.column("pair").to_numpy(), part.column("mask").to_numpy().view(U64))
            one = Singles.of(block, np.flatnonzero(verdict == 3), rep, d, scheme)
            if len(one.pair):
                # an earlier document elsewhere covers the whole group, one of the block those after it
                bit = U64(1) << one.window.astype(U64)
                hit = (mask[one.pair] & bit)[one.head] != 0
                gone = hit[one.group] | (one.doc > one.doc[one.head][one.group])
                mask[verdict == 3] = 0
                np.bitwise_or.at(mask, one.pair[gone], bit[gone])
            some = np.flatnonzero(~whole & (mask[pair] != 0))
            bits = mask[pair[some]]
            for w in range(int(a.count.max())):
                at = a.first[some[(bits >> U64(w)) & U64(1) == 1]] + w
                np.add.at(covered, at, 1)
                np.add.at(covered, at + scheme.K, -1)
        return finish(block, np.cumsum(covered[:-1]) > 0, t)

    empty = to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).empty_table()
    blocks = keyed.repartition(parts, "block").groupBy("block")
    sent = blocks.applyInArrow(send, "bucket int, block int, low long, width int, keys binary, contexts binary, checks binary, docs binary, marks binary")
    known = sent.repartition(parts, "bucket").groupBy("bucket").applyInArrow(judge, "block int, bucket int, verdict binary")
    shown = blocks.cogroup(known.repartition(parts, "block").groupBy("block")).applyInArrow(show, "key long, salt long, block int, pair int, window int, doc long, payload binary")
    masks = shown.repartition(parts, "key", "salt").sortWithinPartitions("key", "salt", "doc").mapInArrow(compare, "block int, pair int, mask long")
    both = known.select("block", "bucket", "verdict", F.lit(None).cast("int").alias("pair"), F.lit(None).cast("long").alias("mask")).unionByName(masks, allowMissingColumns=True)
    return blocks.cogroup(both.repartition(parts, "block").groupBy("block")).applyInArrow(mark, schema)
