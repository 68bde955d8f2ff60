"""Comparison of documents: duplicates, line diffs, structure, composite scores, clustering of centroids."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalar import norm
from tessera.operators.iterate import bounded


#: Centroids of one distance matrix (200 MB).
CENTRES = 5_000
#: Documents of a cluster that meet as many others in a task.
GROUP = 1_000


def exact_duplicates(docs: DataFrame, key: str, hashed: Column) -> DataFrame:
    """content_hash, n, ids of groups of two or more."""
    own = docs.select(key, hashed.alias("content_hash")).groupBy("content_hash").agg(F.count("*").alias("n"), F.min(key).alias("first_id"), F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), ",").alias("ids"))
    return own.where("n > 1")


def versions(docs: DataFrame, path: str, *order: str) -> DataFrame:
    """docs with `version` and `is_latest` among those of one path: one sort of each path's rows, which a window streams."""
    own = Window.partitionBy(path).orderBy(*order)
    return docs.withColumn("version", F.row_number().over(own).cast("long")).withColumn("is_latest", F.lead(F.lit(1)).over(own).isNull())


def middle(a: list, b: list) -> tuple[int, int, int, int]:
    """Where the two halves of a shortest edit script meet: the run of equal elements from (x, y) to (u, v). Searched from both ends, so only two frontiers are held."""
    n, m = len(a), len(b)
    delta, ahead, back = n - m, {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for own, other, sign in ((ahead, back, 1), (back, ahead, -1)):
            for k in range(-d, d + 1, 2):
                x = own[k + 1] if k == -d or (k != d and own[k - 1] < own[k + 1]) else own[k - 1] + 1
                y = x - k
                u, v = x, y
                while u < n and v < m and (a[u] == b[v] if sign > 0 else a[n - 1 - u] == b[m - 1 - v]):
                    u, v = u + 1, v + 1
                own[k] = u
                meets = (delta & 1) == (sign > 0) and abs(delta - k) <= d - (sign > 0) and u + other.get(delta - k, -1) >= n
                if meets:
                    return (x, y, u, v) if sign > 0 else (n - u, m - v, n - x, m - y)
    raise AssertionError("two lists always meet")


def edit_script(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs (i, j) of equal elements of a longest common subsequence, by divide and conquer: memory is linear in the lists."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, p, j, q = todo.pop()
        while i < p and j < q and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < p and j < q and a[p - 1] == b[q - 1]:
            p, q = p - 1, q - 1
            out.append((p, q))
        if i < p and j < q:
            x, y, u, v = middle(a[i:p], b[j:q])
            out += [(i + x + t, j + y + t) for t in range(u - x)]
            todo += [(i, i + x, j, j + y), (i + u, p, j + v, q)]
    return sorted(out)


def operations(a: str, b: str) -> list[tuple[str, str, int, int, int]]:
    """The line diff of two texts: (equal, delete or insert; text; place in each; lines), runs joined."""
    x, y = a.splitlines(keepends=True), b.splitlines(keepends=True)
    steps: list[tuple[str, str]] = []
    i = j = 0
    for p, q in [*edit_script(x, y), (len(x), len(y))]:
        steps += [("delete", t) for t in x[i:p]] + [("insert", t) for t in y[j:q]] + [("equal", t) for t in x[p : p + 1]]
        i, j = p + 1, q + 1
    out: list[tuple[str, str, int, int, int]] = []
    at = [0, 0]
    for kind, run in groupby(steps, key=lambda s: s[0]):
        texts = [t for _, t in run]
        whole = "".join(texts)
        out.append((kind, whole, *at, len(texts)))
        at = [at[0] + len(whole) * (kind != "insert"), at[1] + len(whole) * (kind != "delete")]
    return out


def compared(pairs: DataFrame, docs: DataFrame, key: str, text: str, most: int = 1000) -> DataFrame:
    """pairs (a, b) with operations (the first `most`), how many there are of each kind, and similarity: both texts meet in one row, whoever asks for which pairs."""

    def run(parts):
        for pdf in parts:
            rows = []
            for i, j, x, y in zip(pdf["a"], pdf["b"], pdf["x"], pdf["y"], strict=True):
                x, y = x or "", y or ""
                ops = operations(x, y)
                n = {k: sum(o[0] == k for o in ops) for k in ("insert", "delete", "equal")}
                same = sum(len(o[1]) for o in ops if o[0] == "equal")
                rows.append((i, j, [dict(zip(("kind", "text", "offset_a", "offset_b", "lines"), o, strict=True)) for o in ops[:most]], len(ops), len(ops) > most, n["insert"], n["delete"], n["equal"], round(2 * same / (len(x) + len(y)), 4) if x or y else 1.0))
            yield pd.DataFrame(rows, columns=["a", "b", "operations", "total_operations", "truncated", "insertions", "deletions", "unchanged", "similarity"])

    own = lambda i, t: docs.select(F.col(key).alias(i), F.col(text).alias(t))
    kind = docs.schema[key].dataType.simpleString()
    met = pairs.select("a", "b").join(own("a", "x"), "a").join(own("b", "y"), "b")
    return met.select("a", "b", "x", "y").mapInPandas(run, f"a {kind}, b {kind}, operations array<struct<kind:string,text:string,offset_a:int,offset_b:int,lines:int>>, total_operations int, truncated boolean, insertions int, deletions int, unchanged int, similarity double")


def cluster_pairs(members: DataFrame, cluster: object, key: str, facts: DataFrame | None = None) -> DataFrame:
    """All pairs (a, b), a < b, of the documents of one cluster; with `facts` of documents, of those that have them, as <name>_a and <name>_b.

    There are as many pairs as the square of the cluster. Documents are dealt to
    groups of about `GROUP`; two groups meet at a time, so nothing is held whole
    and nothing sent to all tasks; a row moves once for each group, not once for
    each pair.
    """
    own = members.where(F.col("cluster") == cluster).select(key).distinct()
    own = own if facts is None else own.join(facts, key)
    n = max(1, -(-own.count() // GROUP))
    dealt = own.withColumn("_g", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    sides = []
    for end, x, y in (("a", "_g", "_o"), ("b", "_o", "_g")):
        sides.append(dealt.select(F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(key).alias(end), *[F.col(c).alias(f"{c}_{end}") for c in own.columns if c != key]))
    # the rows are few and their pairs many: without a number of parts they would be put together in one task
    a, b = (x.repartition(min(n * n, 4096), "_x", "_y") for x in sides)
    return a.hint("merge").join(b, ["_x", "_y"]).where("a < b").drop("_x", "_y")


def side_by_side(pairs: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """pairs (a, b) with the facts of both documents, as <name>_a and <name>_b."""
    names = [c for c in facts.columns if c != key]
    for end in "ab":
        pairs = pairs.join(facts.select(F.col(key).alias(end), *[F.col(c).alias(f"{c}_{end}") for c in names]), end, "left")
    return pairs


def comparison_summary(name_a: Column, name_b: Column, similarity: Column, insertions: Column, deletions: Column, unchanged: Column, pages_a: Column, pages_b: Column) -> Column:
    """A comparison in words."""
    text = F.format_string('Comparison of "%s" vs "%s". Text similarity: %d%%. %d insertions, %d deletions, %d unchanged sections.', name_a, name_b, F.round(100 * similarity).cast("int"), insertions, deletions, unchanged)
    pages = F.abs(F.coalesce(pages_a, F.lit(0)) - F.coalesce(pages_b, F.lit(0)))
    return F.concat(text, F.when(pages > 0, F.format_string(" Page count difference: %d pages.", pages)).otherwise(""))


def line_ratio(a: str, b: str) -> float:
    """2 x equal characters / all characters of a line diff, rounded to 4 digits; 1 for two empty texts."""
    if not a and not b:
        return 1.0
    x, y = a.splitlines(keepends=True), b.splitlines(keepends=True)
    return round(2 * sum(len(x[i]) for i, _ in edit_script(x, y)) / (len(a) + len(b)), 4)


@F.arrow_udf(T.DoubleType())
def line_diff_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """`line_ratio` of two texts. Of a batch one pair at a time is taken out of Arrow's memory."""
    return pa.array((line_ratio(x.as_py() or "", y.as_py() or "") for x, y in zip(a, b, strict=True)), pa.float64())


def map_cosine(a: Column, b: Column) -> Column:
    """Cosine of two count maps."""
    shared = F.map_filter(F.map_zip_with(a, b, lambda _, x, y: x * y), lambda _, v: v.isNotNull())
    total = lambda m, f: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + f(x))
    size = F.sqrt(total(a, lambda x: x * x)) * F.sqrt(total(b, lambda x: x * x))
    return F.when(size > 0, total(shared, lambda x: x) / size).otherwise(F.lit(0.0))


def composite(text: Column, embedding: Column, structure: Column, quality: Column) -> Column:
    """0.4 text, 0.3 embedding, 0.2 structure, 0.1 quality alignment; without quality the rest is scaled up."""
    rest = 0.4 * text + 0.3 * embedding + 0.2 * structure
    return F.when(quality.isNull(), rest / 0.9).otherwise(rest + 0.1 * quality)


def linkage(points: np.ndarray, n_clusters: int | None, distance: float | None, how: str = "average") -> np.ndarray:
    """Agglomerative labels of unit vectors by cosine distance: average, complete or single."""
    if how not in ("average", "complete", "single"):
        raise ValueError(f"no linkage {how!r} of cosine distances")
    n = len(points)
    d = 1 - points @ points.T
    np.fill_diagonal(d, np.inf)
    size, members = np.ones(n), {i: [i] for i in range(n)}
    while len(members) > (n_clusters or 1):
        i, j = divmod(int(d.argmin()), n)
        if distance is not None and d[i, j] > distance:
            break
        i, j = min(i, j), max(i, j)
        row = {"average": (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j]), "complete": np.maximum(d[i], d[j]), "single": np.minimum(d[i], d[j])}[how]
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        members[i] += members.pop(j)
    labels = np.empty(n, np.int64)
    for k, (_, own) in enumerate(sorted(members.items(), key=lambda x: min(x[1]))):
        labels[own] = k
    return labels


def density_labels(points: np.ndarray, least: int = 3) -> np.ndarray:
    """HDBSCAN labels (noise -1) of unit vectors by cosine distance: mutual reachability, spanning tree, condensed tree, excess of mass."""
    n = len(points)
    if n < max(2, least):
        return np.full(n, -1)
    d = np.clip(1 - points @ points.T, 0, None)
    core = np.sort(d, 1)[:, min(least, n) - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    # Prim's spanning tree
    best, source, inside, edges = reach[0].copy(), np.zeros(n, int), np.zeros(n, bool), []
    inside[0] = True
    for _ in range(n - 1):
        j = int(np.where(inside, np.inf, best).argmin())
        edges.append((best[j], source[j], j))
        inside[j] = True
        closer = reach[j] < best
        best[closer], source[closer] = reach[j][closer], j
    # single-linkage tree: node n + k joins two nodes at a distance
    parent, nodes = list(range(n)), {i: (None, None, 0.0, [i]) for i in range(n)}

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for w, a, b in sorted(edges):
        a, b = find(a), find(b)
        top = len(parent)
        parent.append(top)
        nodes[top] = (a, b, float(w), nodes[a][3] + nodes[b][3])
        parent[a] = parent[b] = top
    root = len(parent) - 1

    def condense(node: int, born: float) -> tuple[float, list[list[int]]]:
        """Stability of the cluster that begins at a node, and the clusters chosen below or at it."""
        members, stability = nodes[node][3], 0.0
        while True:
            a, b, w, own = nodes[node]
            lam = 1 / max(w, 1e-12)
            if a is None:
                return stability + (lam - born), [members]
            big = [x for x in (a, b) if len(nodes[x][3]) >= least]
            if len(big) == 2:
                stability += len(own) * (lam - born)
                parts = [condense(x, lam) for x in big]
                if sum(s for s, _ in parts) > stability and node != root:
                    return sum(s for s, _ in parts), [c for _, p in parts for c in p]
                return (stability, [members]) if sum(s for s, _ in parts) <= stability else (sum(s for s, _ in parts), [c for _, p in parts for c in p])
            gone = len(own) - (len(nodes[big[0]][3]) if big else 0)
            stability += gone * (lam - born)
            if not big:
                return stability, [members]
            node = big[0]

    labels = np.full(n, -1)
    for k, own in enumerate(sorted(condense(root, 0.0)[1], key=min)):
        labels[own] = k
    return labels


def cluster_centroids(centroids: DataFrame, key: str, how: str, **options) -> DataFrame:
    """key, cluster. hdbscan: any number of centroids (`density.hdbscan`); agglomerative: at most `CENTRES`, which is checked, as the distance matrix needs them together (use `kmeans` for more)."""
    if how == "hdbscan":
        from tessera.operators.density import hdbscan

        return hdbscan(centroids, key, "centroid", **options)
    centroids = bounded(centroids.select(key, "centroid"), CENTRES, "centroids")
    kind = centroids.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        points = np.stack(pdf["centroid"].to_numpy())
        labels = linkage(points, options.get("n_clusters"), options.get("distance"), options.get("how", "average"))
        return pd.DataFrame({key: pdf[key], "cluster": labels})

    return centroids.select(key, "centroid", F.lit(0).alias("_all")).groupBy("_all").applyInPandas(run, f"{key} {kind}, cluster long")


def kmeans(vectors: DataFrame, key: str, vec: str, k: int | None = None, seed: int = 7) -> DataFrame:
    """key, cluster: k-means by cosine; k is the root of the number of rows where not given."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    # a vector of length 0 (or null) has no direction: its cluster is null
    size = F.coalesce(norm(F.col(vec)), F.lit(0.0))
    rows = vectors.where(size > 0).select(key, array_to_vector(vec).alias("features"))
    if k is None:
        n = rows.count()
        k = max(2, min(n - 1, int(n**0.5)))
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=20).fit(rows)
    found = model.transform(rows).select(key, F.col("prediction").cast("long").alias("cluster"))
    return found.unionByName(vectors.where(~(size > 0)).select(key, F.lit(None).cast("long").alias("cluster")))
