import numpy as np
import pytest

from tessera.operators import compare, density, pairs


def points(seed, n, d=6):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, d))
    x = centres[r.integers(0, 5, n)] + r.choice([0.1, 0.25, 2.0], n)[:, None] * r.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def same_groups(a, b):
    return len(set(zip(a.tolist(), b.tolist()))) == len(set(a.tolist())) == len(set(b.tolist()))


@pytest.mark.parametrize("n, least", [(40, 2), (120, 3), (300, 5), (500, 8)])
def test_condensed_tree_equals_the_matrix_version(n, least):
    x = points(n, n)
    d = np.clip(1 - x @ x.T, 0, None)
    core = np.sort(d, 1)[:, least - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    inside, edges = {0}, []
    while len(inside) < n:
        rest = [j for j in range(n) if j not in inside]
        i, j = min(((i, j) for i in inside for j in rest), key=lambda e: reach[e]) if n < 50 else (None, None)
        if i is None:
            own = np.array(sorted(inside))
            k = reach[np.ix_(own, rest)]
            p, q = np.unravel_index(k.argmin(), k.shape)
            i, j = int(own[p]), rest[q]
        edges.append((reach[i, j], i, j))
        inside.add(j)
    w, a, b = map(np.array, zip(*sorted(edges)))
    got, want = density.condensed(np.arange(n), w, a, b, least), compare.density_labels(x, least)
    assert same_groups(got, want) and ((got == -1) == (want == -1)).all()


@pytest.mark.parametrize("strip", [8 << 20, 8 * 6 * 60])
def test_500_points_over_strips(spark, monkeypatch, strip):
    monkeypatch.setattr(pairs, "STRIP", strip)
    x = points(7, 500)
    df = spark.createDataFrame([(3 * i, [float(y) * (1 + i % 3) for y in v]) for i, v in enumerate(x)] + [(10**6, [0.0] * 6), (10**6 + 1, None)], "id long, v array<double>").repartition(3)
    got = {r.id: r.cluster for r in density.hdbscan(df, "id", "v", 4).collect()}
    assert got.pop(10**6) == got.pop(10**6 + 1) == -1
    own = np.array([got[3 * i] for i in range(500)])
    # all edges in the order of (weight, keys): mutual reachability has many equal weights, and their order decides
    d = np.round(np.clip(1 - x @ x.T, 0, None), 12)
    core = np.sort(d, 1)[:, 3]
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    i, j = np.triu_indices(500, 1)
    order = np.lexsort((j, i, reach[i, j]))
    top, edges = list(range(500)), []

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for a, b in zip(i[order].tolist(), j[order].tolist()):
        if find(a) != find(b):
            top[find(a)] = find(b)
            edges.append((reach[a, b], a, b))
    want = density.condensed(np.arange(500), *map(np.array, zip(*edges)), 4)
    assert own.tolist() == want.tolist() and len(set(want.tolist())) > 2
    # the version with a matrix breaks such ties in another order
    other = compare.density_labels(x, 4)
    assert np.mean((own[:, None] == own[None, :]) == (other[:, None] == other[None, :])) > 0.9


def test_equal_points_and_few_points(spark):
    df = spark.createDataFrame([(i, [1.0, float(i // 4)]) for i in range(12)], "id int, v array<double>")
    got = {r.id: r.cluster for r in density.hdbscan(df, "id", "v", 3).collect()}
    assert [got[i] for i in range(12)] == [0] * 4 + [1] * 4 + [2] * 4
    assert {r.cluster for r in density.hdbscan(df.limit(2), "id", "v", 3).collect()} == {-1}
    assert density.hdbscan(df.limit(0), "id", "v", 3).collect() == []


def test_kmeans_leaves_zero_vectors_aside(spark):
    df = spark.createDataFrame([(i, [1.0, 0.01 * i]) for i in range(6)] + [(i, [0.01 * i, 1.0]) for i in range(6, 12)] + [(50, [0.0, 0.0]), (51, None)], "id int, v array<double>")
    got = {r.id: r.cluster for r in compare.kmeans(df, "id", "v", 2).collect()}
    assert len(got) == 14 and got[50] is None and got[51] is None and {got[i] for i in range(12)} == {0, 1} and len({got[i] for i in range(6)}) == 1
