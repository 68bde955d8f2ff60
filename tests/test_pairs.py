import numpy as np
import pytest

from tessera.operators import pairs


def frame(spark, x, parts=3):
    return spark.createDataFrame([(i, None if v is None else [float(y) for y in v]) for i, v in enumerate(x)], "id long, v array<double>").repartition(parts)


def plain(x, least):
    u = [np.zeros(1) if v is None or not np.any(v) else np.array(v) / np.linalg.norm(v) for v in x]
    s = {(i, j): float(u[i] @ u[j]) if len(u[i]) == len(u[j]) and len(u[i]) > 1 else 0.0 for i in range(len(u)) for j in range(i + 1, len(u))}
    return s, {k for k, v in s.items() if v >= least}


def clusters(seed, n, d, noise):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, d))
    x = centres[r.integers(0, 6, n)] + noise * r.normal(size=(n, d))
    x[:5] = x[5]
    return x


@pytest.mark.parametrize("strip, pivots", [(8 << 20, 512), (8 * 8 * 20, 512), (8 * 8 * 7, 5), (8 * 8 * 1000, 1)])
@pytest.mark.parametrize("least", [0.95, 0.4, 1.0])
def test_every_pair_is_found(spark, monkeypatch, strip, pivots, least):
    monkeypatch.setattr(pairs, "STRIP", strip)
    monkeypatch.setattr(pairs, "PIVOTS", pivots)
    monkeypatch.setattr(pairs, "SLICE", 16)
    x = [*clusters(1, 180, 8, 0.2), np.zeros(8), None]
    least -= 1e-9
    s, want = plain(x, least)
    got = pairs.similar(frame(spark, x), "id", "v", least).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    assert all(abs(r.similarity - s[r.a, r.b]) < 1e-9 for r in got)


def test_strips_that_cannot_match_never_meet(spark, monkeypatch):
    monkeypatch.setattr(pairs, "STRIP", 8 * 8 * 20)
    strips = pairs.Strips(frame(spark, clusters(2, 400, 8, 0.01)), "id", "v")
    low = strips.bounds()[2]
    near = np.flatnonzero(low <= np.arccos(0.99))
    every = strips.met(np.arange(len(low))).count()
    assert strips.met(near).count() < 0.6 * every
    assert strips.rows.groupBy("strip").count().agg({"count": "max"}).first()[0] < 60


@pytest.mark.parametrize("strip", [8 << 20, 8 * 8 * 12])
@pytest.mark.parametrize("extra", [[], [np.zeros(8), None]])
def test_extremes(spark, monkeypatch, strip, extra):
    monkeypatch.setattr(pairs, "STRIP", strip)
    x = [*clusters(3, 90, 8, 0.3), *extra]
    s, _ = plain(x, 2)
    got = pairs.extremes(frame(spark, x), "id", "v").first()
    assert got.n == len(x) and got.pairs == len(s) and abs(got.mean - np.mean(list(s.values()))) < 1e-9
    assert abs(got.most - max(s.values())) < 1e-9 and abs(got.least - min(s.values())) < 1e-9
    assert abs(s[got.most_a, got.most_b] - got.most) < 1e-9 and abs(s[got.least_a, got.least_b] - got.least) < 1e-9


def test_few_vectors_and_errors(spark):
    for x in ([], [[1.0, 2.0]], [[0.0, 0.0], [0.0, 0.0]]):
        assert pairs.similar(frame(spark, x), "id", "v", 0.1).collect() == []
    assert tuple(pairs.extremes(frame(spark, []), "id", "v").first()) == (0, 0) + (None,) * 7
    assert pairs.extremes(frame(spark, [[1.0, 2.0]]), "id", "v").first().most is None
    assert tuple(pairs.extremes(frame(spark, [[0.0, 0.0], [1.0, 0.0]]), "id", "v").first()) == (2, 1, 0.0, 0, 1, 0.0, 0, 1, 0.0)
    with pytest.raises(ValueError, match="numbers"):
        pairs.similar(frame(spark, [[1.0], [1.0, 2.0]]), "id", "v", 0.5)
    with pytest.raises(ValueError):
        pairs.similar(frame(spark, [[1.0]]), "id", "v", 0.0)
    names = spark.createDataFrame([("x", [1.0, 0.1]), ("b", [1.0, 0.0]), ("b", [1.0, 0.0])], "id string, v array<double>")
    assert sorted(tuple(r)[:2] for r in pairs.similar(names, "id", "v", 0.9).collect()) == [("b", "x")] * 2
