"""Operator 4: conflict-constrained best-fit packing.

Documents are packed into bins of `CAPACITY` tokens. Open bins are ordered by
residual room; each carries a bitmap of its sources and one of its duplicate
clusters. A piece goes to the tightest bin that holds it and shares neither:
the search starts at the successor of the piece's size and goes on until a bin
is compatible; if none is, a bin is opened. Pieces come largest first (ties by
doc_id, then by cluster and source).

A document longer than a bin is cut in pieces of a whole bin each, which need
no search, and a rest. Documents are dealt to shards of about `SHARD` by a hash
of doc_id and content, so a source with a third of all documents, or a large
group of copies, spreads over all shards; each shard packs alone, which costs
at most its last few bins. Texts do not travel: only lengths and keys do.

Defined cases: a null or empty text has no tokens and no bin (bin_id and
bin_offset null); a null source shares with nothing; equal texts are one
cluster unless a cluster column is given, and a null cluster shares with
nothing; repeated rows are packed apart; null doc_ids stay.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.token_counts import count_texts

CAPACITY = 8192
SHARD = 8192
MASK = (1 << 63) - 1


def best_fit(items: list[tuple[int, object, object]], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item (size, source, cluster), sizes 1 to capacity, in the order given."""
    bits: list[dict] = [{}, {}]
    rooms: list[tuple[int, int]] = []  # residual room and bin, in order
    sources: list[int] = []
    clusters: list[int] = []
    bins, offsets = [], []
    for size, source, cluster in items:
        s = 0 if source is None else 1 << bits[0].setdefault(source, len(bits[0]))
        c = 0 if cluster is None else 1 << bits[1].setdefault(cluster, len(bits[1]))
        k = bisect_left(rooms, (size, -1))
        while k < len(rooms) and (sources[rooms[k][1]] & s or clusters[rooms[k][1]] & c):
            k += 1
        if k < len(rooms):
            room, b = rooms.pop(k)
        else:
            room, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= s
        clusters[b] |= c
        bins.append(b)
        offsets.append(capacity - room)
        if room > size:
            insort(rooms, (room - size, b))
    return bins, offsets


def sizes(docs: DataFrame, path: str, cluster: str | None = None) -> DataFrame:
    """doc_id, source, cluster, n_tokens of each row: one scan, nothing moves."""

    def run(parts):
        for b in parts:
            texts = b.column(2).to_pylist()
            own = b.column(3) if cluster else pa.array([xxhash.xxh64_intdigest(t) & MASK if t else None for t in texts], pa.int64())
            yield pa.record_batch([b.column(0), b.column(1), own, pa.array(count_texts(texts, path))], names=["doc_id", "source", "cluster", "n_tokens"])

    chosen = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")]
    if cluster:
        chosen.append(F.col(cluster).cast("long").alias("cluster"))
    return docs.select(*chosen).mapInArrow(run, "doc_id long, source string, cluster long, n_tokens long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, cluster: str | None = None, shard: int = SHARD) -> DataFrame:
    """doc_id, piece, n_tokens, source, bin_id, bin_offset: a row for each piece of each row of docs."""
    n = max(1, -(-docs.count() // shard))
    # rows without a doc_id may all be alike; they are dealt by their place in the scan
    own = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("doc_id", "cluster", "n_tokens"))
    dealt = sizes(docs, path, cluster).withColumn("shard", F.pmod(own, F.lit(n)))

    def run(t: pa.Table) -> pa.Table:
        number = t.column("shard")[0].as_py()
        rows = sorted(t.select(["doc_id", "source", "cluster", "n_tokens"]).to_pylist(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["cluster"] or 0, r["source"] or ""))
        out, rest, bins = [], [], 0
        for r in rows:
            whole, left = divmod(r["n_tokens"], capacity)
            for k in range(whole):
                out.append((r["doc_id"], k, capacity, r["source"], bins, 0))
                bins += 1
            if left:
                rest.append((left, whole, r))
            elif not whole:
                out.append((r["doc_id"], 0, 0, r["source"], None, None))
        rest.sort(key=lambda x: -x[0])
        at, offsets = best_fit([(left, r["source"], r["cluster"]) for left, _, r in rest], capacity)
        out += [(r["doc_id"], k, left, r["source"], bins + b, o) for (left, k, r), b, o in zip(rest, at, offsets, strict=True)]
        cols = list(zip(*out, strict=True))
        ids = [None if b is None else number << 32 | b for b in cols[4]]
        return pa.table([pa.array(c, k) for c, k in zip((*cols[:4], ids, cols[5]), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "n_tokens", "source", "bin_id", "bin_offset"])

    return dealt.groupBy("shard").applyInArrow(run, "doc_id long, piece long, n_tokens long, source string, bin_id long, bin_offset long")
