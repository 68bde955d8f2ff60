"""HDBSCAN over any number of vectors: a spanning tree of mutual reachability in rounds, then its condensed tree.

Distances are 1 - cosine. The k-th nearest distance of each vector and, in each
round, the cheapest edge that leaves each component are found pair of strips by
pair of strips (`pairs.Strips`): of a pair, a row a vector or a component comes
back. Components at least halve in number with each round (Boruvka); edges are
ordered by (weight, keys), so no round makes a cycle. The tree has one edge a
vector, of three numbers; those alone are folded in order, in one task, to the
condensed tree, whose clusters of most excess of mass are the result.

Defined cases: keys are whole numbers, one a vector; vectors of length 0 (or
null) and all vectors of a table with fewer than `least` are noise, -1; of equal
weights the edge of the lesser keys counts; clusters are numbered by their
least key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.iterate import cut
from tessera.operators.pairs import SLICE, Strips


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rounded, as the last bits of a product depend on the shapes of its parts, and equal weights have to be equal everywhere."""
    return np.round(np.maximum(0.0, 1.0 - x @ y.T), 12)


def core_distances(strips: Strips, least: int) -> DataFrame:
    """key, core: the distance to the least-th nearest vector, itself counted."""

    def compare(ta, x, tb, y, same) -> Iterator[pa.RecordBatch]:
        # a vector's distance to itself is 0 in the product but for rounding
        for table, own, other in ((ta, x, y), (tb, y, x))[: 1 if same else 2]:
            keys = table.column("key").combine_chunks()
            for i in range(0, len(own), SLICE):
                d = distances(own[i : i + SLICE], other)
                k = min(least, d.shape[1])
                near = np.partition(d, k - 1, 1)[:, :k]
                yield pa.RecordBatch.from_arrays([keys.slice(i, len(near)), pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * k, pa.int32()), pa.array(near.reshape(-1)))], names=["key", "near"])

    every = np.arange(len(strips.bounds()[0]))
    found = strips.compared(every, compare, f"key {strips.kind}, near array<double>")
    all_near = F.sort_array(F.flatten(F.collect_list("near")))
    return found.groupBy("key").agg(all_near[F.least(F.lit(least), F.size(all_near)) - 1].alias("core"))


def cheapest(strips: Strips, state: DataFrame) -> DataFrame:
    """comp, w, a, b, other: the cheapest edge from each component to another. state: key, core, comp."""

    def compare(ta, x, tb, y, same) -> Iterator[pa.RecordBatch]:
        ka, kb = (t.column("key").to_numpy().astype(np.int64) for t in (ta, tb))
        ca, cb = (t.column("comp").to_numpy() for t in (ta, tb))
        ra, rb = (t.column("core").to_numpy() for t in (ta, tb))
        best: dict[int, tuple] = {}
        for i in range(0, len(x), SLICE):
            w = np.maximum(np.maximum(distances(x[i : i + SLICE], y), ra[i : i + SLICE, None]), rb[None, :])
            own = ca[i : i + SLICE]
            w[own[:, None] == cb[None, :]] = np.inf
            for comps, others, least, axis in ((own, cb, w.min(1), 0), (cb, own, w.min(0), 1))[: 1 if same else 2]:
                names, at = np.unique(comps, return_inverse=True)
                low = np.full(len(names), np.inf)
                np.minimum.at(low, at, least)
                hit = np.isfinite(least) & (least == low[at])
                rows = np.flatnonzero(hit)
                part = w[rows] if axis == 0 else w[:, rows].T
                p, q = np.nonzero(part == low[at[rows]][:, None])
                mine, far = (rows[p] + i, q) if axis == 0 else (q + i, rows[p])
                lo, hi = np.minimum(ka[mine], kb[far]), np.maximum(ka[mine], kb[far])
                o = np.lexsort((hi, lo, at[rows[p]]))
                head = o[np.flatnonzero(np.diff(at[rows[p]][o], prepend=-1))]
                for h in head.tolist():
                    c = int(names[at[rows[p[h]]]])
                    value = (float(low[at[rows[p[h]]]]), int(lo[h]), int(hi[h]), int(others[q[h]]))
                    if c not in best or value < best[c]:
                        best[c] = value
        rows = [(c, *v) for c, v in best.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()))], names=["comp", "w", "a", "b", "other"])

    every = np.arange(len(strips.bounds()[0]))
    found = strips.compared(every, compare, "comp long, w double, a long, b long, other long", state)
    return found.groupBy("comp").agg(F.min(F.struct("w", "a", "b", "other")).alias("m")).select("comp", "m.*")


def roots(edges: DataFrame) -> DataFrame:
    """comp, root: where the cheapest edges (comp, a, b, other) lead. Two components with the same edge make the end of each path; the lesser is the root."""
    back = edges.select(F.col("comp").alias("other"), F.col("a").alias("_a"), F.col("b").alias("_b"))
    both = edges.join(back, "other", "left")
    ends = (F.col("_a") == F.col("a")) & (F.col("_b") == F.col("b")) & (F.col("comp") < F.col("other"))
    now = cut(both.select("comp", F.when(ends, F.col("comp")).otherwise(F.col("other")).alias("root")))
    while True:
        up = now.select(F.col("comp").alias("root"), F.col("root").alias("above"))
        new = cut(now.join(up, "root").select("comp", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")))
        if not new.agg(F.max("moved")).first()[0]:
            return new.select("comp", "root")
        now = new.select("comp", "root")


def spanning_tree(strips: Strips, least: int) -> DataFrame:
    """w, a, b: the edges of the least spanning tree of mutual reachability."""
    core = core_distances(strips, least)
    state = cut(core.withColumn("comp", F.col("key").cast("long")))
    tree, left = None, strips.n
    while left > 1:
        edges = cut(cheapest(strips, state))
        own = edges.select("w", "a", "b").distinct()
        tree = own if tree is None else tree.unionByName(own)
        state = cut(state.join(roots(edges), "comp").select("key", "core", F.col("root").alias("comp")))
        left = state.agg(F.count_distinct("comp")).first()[0]
    return tree


def condensed(keys: np.ndarray, w: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Labels of keys (ascending) from the edges of their tree, cheapest first; arrays of one number a node, no lists of members."""
    n = len(keys)
    a, b = np.searchsorted(keys, a), np.searchsorted(keys, b)
    top, parent = list(range(2 * n - 1)), np.arange(2 * n - 1)
    left, right, size = np.full(2 * n - 1, -1), np.full(2 * n - 1, -1), np.ones(2 * n - 1, np.int64)

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    for k in range(n - 1):
        x, y, node = find(int(a[k])), find(int(b[k])), n + k
        left[node], right[node], size[node] = x, y, size[x] + size[y]
        top[x] = top[y] = node
        parent[x] = parent[y] = node
    lam = 1 / np.maximum(w, 1e-12)
    # clusters from the root down: where each begins, its stability, the clusters it splits into
    begin, stability, parts, queue = [], [], [], [(2 * n - 2, 0.0, -1)]
    while queue:
        node, born, above = queue.pop()
        own = len(begin)
        begin.append(node)
        stability.append(0.0)
        parts.append([])
        if above >= 0:
            parts[above].append(own)
        while True:
            if node < n:
                stability[own] += 1e12 - born
                break
            at, big = float(lam[node - n]), [int(x) for x in (left[node], right[node]) if size[x] >= least]
            if len(big) == 2:
                stability[own] += int(size[node]) * (at - born)
                queue += [(x, at, own) for x in big]
                break
            stability[own] += (int(size[node]) - (int(size[big[0]]) if big else 0)) * (at - born)
            if not big:
                break
            node = big[0]
    best, chosen = list(stability), [True] * len(begin)
    for k in range(len(begin) - 1, -1, -1):
        below = sum(best[c] for c in parts[k])
        if below > stability[k]:
            best[k], chosen[k] = below, False
    label, queue = np.full(n, -1), [0]
    found = []
    while queue:
        k = queue.pop()
        if not chosen[k]:
            queue += parts[k]
            continue
        leaves, walk = [], [begin[k]]
        while walk:
            x = walk.pop()
            if x < n:
                leaves.append(x)
            else:
                walk += [int(left[x]), int(right[x])]
        found.append(leaves)
    for k, leaves in enumerate(sorted(found, key=min)):
        label[leaves] = k
    return label


def hdbscan(vectors: DataFrame, key: str, vec: str, least: int = 3) -> DataFrame:
    """key, cluster (noise -1) of each vector."""
    strips = Strips(vectors, key, vec)
    kind = vectors.schema[key].dataType.simpleString()
    every = vectors.select(F.col(f"`{key}`").alias(key))
    if strips.n < max(2, least):
        return every.withColumn("cluster", F.lit(-1).cast("long"))
    tree = spanning_tree(strips, least).select("w", "a", "b", F.lit(0).alias("all"))

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by([("w", "ascending"), ("a", "ascending"), ("b", "ascending")])
        w, a, b = (t.column(c).to_numpy() for c in ("w", "a", "b"))
        keys = np.unique(np.concatenate([a, b]))
        return pa.table([pa.array(keys), pa.array(condensed(keys, w, a, b, least))], names=["_key", "cluster"])

    labels = tree.groupBy("all").applyInArrow(fold, "_key long, cluster long")
    return every.join(labels, F.col(key).cast("long") == F.col("_key"), "left").select(F.col(key).cast(kind).alias(key), F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))
