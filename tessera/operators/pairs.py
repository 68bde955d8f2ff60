"""Exact pairs of similar vectors, and the extremes of all pairs, without a matrix and without the driver.

Vectors are scaled to unit length and dealt to cells around pivots (some of the
vectors themselves), cells to strips of a bounded number of bytes. By the
triangle inequality on angles two strips can hold a pair within an angle only
if their pivots' angle, less the strips' radii, is within it; all other pairs
of strips are left out before anything moves. A pair of strips that is left is
one group: a product of two bounded matrices, in slices. Every pair is found;
only where a bound proves that there is none is nothing compared.

A strip moves once for each strip it may match, so what moves grows with the
number of vectors times the number of strips that a strip can match: few for a
high similarity, all for a low one, as any exact method must compare them.

Defined cases: a vector of length 0 (or null) has similarity 0 to every other;
vectors of different lengths in one table are an error; repeated keys are
vectors of their own, pairs of one key with itself are left out; ties are
ordered by key; fewer than two vectors have no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import dot, norm

#: Bytes of a strip's vectors; pivots at most; rows of a slice of a product.
STRIP = 8 << 20
PIVOTS = 512
SLICE = 64
#: Added to angles, for what floating-point numbers lose.
SLACK = 1e-6


class Strips:
    """The vectors of a table in strips: rows (key, v, strip, cell, angle), and what is known of each cell."""

    def __init__(self, vectors: DataFrame, key: str, vec: str):
        self.spark, self.kind = vectors.sparkSession, vectors.schema[key].dataType.simpleString()
        own = F.col(f"`{vec}`").cast("array<double>")
        size = norm(own)
        unit = vectors.select(F.col(f"`{key}`").alias("key"), F.when(size > 0, F.transform(own, lambda x: x / size)).alias("u"))
        self.zero = unit.where("u is null").select("key")
        self.unit = unit.where("u is not null")
        n, dims, other = self.unit.agg(F.count("*"), F.max(F.size("u")), F.min(F.size("u"))).first()
        self.n, self.dims = n, dims or 1
        if n and dims != other:
            raise ValueError(f"vectors of {other} and of {dims} numbers")
        rows = max(2, STRIP // (8 * self.dims))
        # a bounded number of bytes goes to every task
        p = max(1, min(PIVOTS, STRIP // (8 * self.dims), -(-n // rows)))
        found = self.unit.orderBy(F.xxhash64("key"), "key").limit(p).select("u").collect() if n else []
        self.pivots = np.array([r.u for r in found]).reshape(-1, self.dims)
        pivots = self.pivots

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = stacked(b.column(1))
                near = v @ pivots.T
                cell = near.argmax(1) if len(v) else np.zeros(0, np.int64)
                angle = angle_of(near[np.arange(len(v)), cell])
                raw = [x.tobytes() for x in v]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary()), pa.array(cell.astype(np.int32)), pa.array(angle)], names=["key", "v", "cell", "angle"])

        placed = self.unit.mapInArrow(place, f"key {self.kind}, v binary, cell int, angle double")
        # one row a pivot
        self.cells = {r.cell: (r.n, r.far) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("far")).collect()}
        split = {c: -(-size // rows) for c, (size, _) in self.cells.items()}
        self.first = dict(zip(split, np.cumsum([0, *split.values()])[:-1].tolist()))
        self.split = split
        table = self.spark.createDataFrame([(c, split[c], self.first[c]) for c in split], "cell int, parts int, first long")
        self.rows = placed.join(F.broadcast(table), "cell").withColumn("strip", F.col("first") + F.pmod(F.xxhash64("key", "v"), F.col("parts"))).select("key", "v", "strip")

    def bounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of cells, and the least and greatest angle that their vectors can have."""
        names = np.array(sorted(self.cells), np.int64)
        far = np.array([self.cells[c][1] for c in names.tolist()])
        between = angle_of(self.pivots[names] @ self.pivots[names].T)
        i, j = np.triu_indices(len(names))
        reach = far[i] + far[j] + SLACK
        return names[i], names[j], np.maximum(0.0, between[i, j] - reach), np.minimum(np.pi, between[i, j] + reach)

    def met(self, which: np.ndarray) -> DataFrame:
        """a, b: the pairs of strips of some pairs of cells (indices of `bounds`)."""
        i, j, _, _ = self.bounds()
        cells = self.spark.createDataFrame(pd.DataFrame({"a": i[which], "b": j[which]}), "a int, b int") if len(which) else self.spark.createDataFrame([], "a int, b int")
        parts = self.spark.createDataFrame([(c, self.first[c], self.first[c] + n - 1) for c, n in self.split.items()], "cell int, low long, high long")
        strips = parts.select("cell", F.explode(F.sequence("low", "high")).alias("strip"))
        a, b = strips.select(F.col("cell").alias("a"), F.col("strip").alias("x")), strips.select(F.col("cell").alias("b"), F.col("strip").alias("y"))
        met = cells.join(a, "a").join(b, "b")
        return met.where((F.col("a") != F.col("b")) | (F.col("x") <= F.col("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    def compared(self, which: np.ndarray, compare, schema: str, state: DataFrame | None = None) -> DataFrame:
        """compare(table, vectors, table, vectors, same) for each pair of strips that meets, as one table. The tables have the keys, and what `state` has by key."""
        met = self.met(which)
        rows = self.rows if state is None else self.rows.join(state, "key")
        more = [c for c in rows.columns if c not in ("key", "v", "strip")]
        sides = [rows.join(met, rows["strip"] == met[s]).select("a", "b", F.lit(s).alias("side"), "key", "v", *more) for s in "ab"]
        both = sides[0].unionByName(sides[1].where("a <> b"))
        dims = self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = pa.Table.from_batches(list(batches))
            left = np.array(held.column("side").to_pylist()) == "a"
            parts = []
            for side in (left, ~left):
                t = held.filter(pa.array(side))
                parts.append((t.drop(["a", "b", "side", "v"]), np.frombuffer(b"".join(t.column("v").to_pylist()), np.float64).reshape(-1, dims)))
            same = not len(parts[1][1])
            yield from compare(*parts[0], *(parts[0] if same else parts[1]), same)

        return both.groupBy("a", "b").applyInArrow(run, schema)


def stacked(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def angle_of(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def slices(x: np.ndarray, y: np.ndarray, same: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of the product of two strips; of a strip with itself what is left of the diagonal is -2 and to be left out."""
    for i in range(0, len(x), SLICE):
        out = x[i : i + SLICE] @ y.T
        if same:
            out[np.arange(len(out))[:, None] + i >= np.arange(out.shape[1])[None, :]] = -2.0
        yield i, out


def ordered(a: pa.Array, b: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The lesser and the greater of two columns of keys."""
    import pyarrow.compute as pc

    return pc.min_element_wise(a, b), pc.max_element_wise(a, b)


def similar(vectors: DataFrame, key: str, vec: str, least: float) -> DataFrame:
    """a, b, similarity: every pair of vectors with a cosine of `least` (above 0) or more, clamped to 1; a < b."""
    if least <= 0:
        raise ValueError("every pair has a similarity of 0 or more")
    strips = Strips(vectors, key, vec)

    def compare(ta, x, tb, y, same):
        ka, kb = ta.column("key").combine_chunks(), tb.column("key").combine_chunks()
        for i, s in slices(x, y, same):
            p, q = np.nonzero(s >= least)
            a, b = ordered(ka.take(pa.array(p + i)), kb.take(pa.array(q)))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(np.minimum(1.0, s[p, q]))], names=["a", "b", "similarity"])

    near = np.flatnonzero(strips.bounds()[2] <= np.arccos(min(1.0, least))) if strips.n else np.zeros(0, np.int64)
    return strips.compared(near, compare, f"a {strips.kind}, b {strips.kind}, similarity double").where("a < b")


def extremes(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """n, pairs, mean, most_a, most_b, most, least_a, least_b, least: the mean cosine of all pairs of different vectors, the most and the least similar pair (ties: the first by key).

    The mean follows from the length of the sum of unit vectors. For the
    extremes, pairs within a cell and the pivots with all vectors give a first
    bound; cells that cannot beat it are not compared.
    """
    strips = Strips(vectors, key, vec)
    spark, kind = strips.spark, strips.kind
    # a zero vector has cosine 0 with all others; it adds nothing to the sum
    total = strips.unit.select(F.posexplode("u").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s")).agg(F.sum(F.col("s") * F.col("s"))).first()[0] or 0.0
    zeros = [r.key for r in strips.zero.orderBy("key").limit(2).collect()]
    n = strips.n + strips.zero.count()
    pairs = n * (n - 1) // 2
    mean = (total - strips.n) / 2 / pairs if pairs else None

    def compare(ta, x, tb, y, same):
        ka, kb, best = ta.column("key").combine_chunks(), tb.column("key").combine_chunks(), []
        for i, s in slices(x, y, same):
            for sign in (1, -1):
                known = s > -1.5
                top = sign * (s.max if sign > 0 else s.min)(where=known, initial=-sign * np.inf)
                if top == -np.inf:
                    continue
                p, q = np.nonzero(known & (s == sign * top))
                a, b = ordered(ka.take(pa.array(p + i)), kb.take(pa.array(q)))
                first = min(zip(a.to_pylist(), b.to_pylist()))
                best.append((sign, sign * float(top), *first))
        rows = [min((r for r in best if r[0] == sign), key=lambda r: (-sign * r[1], r[2], r[3])) for sign in (1, -1) if any(r[0] == sign for r in best)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], ka.type), pa.array([r[3] for r in rows], ka.type)], names=["sign", "s", "a", "b"])

    def best(which: np.ndarray, known: dict) -> dict:
        """One row a sign from each pair of strips, of which the best comes back."""
        found = strips.compared(which, compare, f"sign int, s double, a {kind}, b {kind}")
        rows = found.groupBy("sign").agg(F.min(F.struct((-F.col("sign") * F.col("s")).alias("k"), "a", "b")).alias("m")).select("sign", "m.*").collect() if len(which) else []
        for r in rows:
            own = (r.k, r.a, r.b)
            if r.sign not in known or own < known[r.sign]:
                known[r.sign] = own
        return known

    known: dict[int, tuple] = {}
    if strips.n:
        i, j, low, high = strips.bounds()
        own = np.flatnonzero(i == j)
        known = best(own, known)
        most, least = -known[1][0] if 1 in known else -1.0, known[-1][0] if -1 in known else 1.0
        # the pivots with each other
        near = strips.pivots @ strips.pivots.T
        least = min(least, float(near.min()))
        more = np.flatnonzero((i != j) & ((np.cos(low) >= most - SLACK) | (np.cos(high) <= least + SLACK)))
        known = best(more, known)
    if zeros and n > 1:
        # with a zero vector: the first pair of those with similarity 0
        others = [r.key for r in vectors.select(F.col(f"`{key}`").alias("key")).orderBy("key").limit(2).collect()]
        mate = next((k for k in others if k != zeros[0]), zeros[-1])
        pair = (min(zeros[0], mate), max(zeros[0], mate))
        for sign in (1, -1):
            own = (0.0, *pair)
            if sign not in known or own < known[sign]:
                known[sign] = own
    m, x = known.get(1), known.get(-1)
    row = (n, pairs, mean, *((m[1], m[2], -m[0]) if m else (None,) * 3), *((x[1], x[2], x[0]) if x else (None,) * 3))
    return spark.createDataFrame([row], f"n long, pairs long, mean double, most_a {kind}, most_b {kind}, most double, least_a {kind}, least_b {kind}, least double")
