import random

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash

SCHEMA = "doc_id long, text string, fp string, root long"


def plain(text, k=4):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, bits=4):
    fps = [plain(t) for _, t in rows]
    own = list(range(len(rows)))

    def find(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                own[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return sorted((d is None, d or 0, f"{f:016x}", least.get(find(i), -1)) for i, ((d, _), f) in enumerate(zip(rows, fps)))


def corpus(seed, n=150):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefÉß") for _ in range(r.randint(1, 6))) for _ in range(300)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.6:
            w = (r.choice(rows)[1] or "").split(" ")
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocab)
            t = " ".join(w)
        else:
            t = " ".join(r.choice(vocab) for _ in range(r.choice([1, 2, 3, 40, 200])))
        rows.append((i, t))
    return rows + [(900, None), (901, ""), (902, " \t\n"), (903, "A b C d E"), (903, "a B c D e"), (None, "lonely words of nobody at all"), (None, rows[0][1]), (5, rows[1][1])]


@pytest.mark.parametrize("cell", [7, simhash.CELL])
def test_matches_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    rows = corpus(cell)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(3)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in simhash.digests(df).collect())
    assert got == brute(rows)


def test_links_reach_every_pair_within_the_threshold():
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 400, dtype=np.uint64)
    far = base.copy()
    for i in range(len(far)):
        for b in r.choice(64, 4, replace=False):
            far[i] ^= np.uint64(1) << np.uint64(b)
    home, met = simhash.homes(base), np.zeros(len(base), bool)
    for index, anchor in simhash.reached(far, 2):
        for k in range(3):
            met[index[anchor == home[k][index]]] = True
    assert met.all()


def test_long_texts_names_that_clash_and_ties(spark):
    r = random.Random(8)
    words = [f"w{r.randrange(10**6)}" for _ in range(300_000)]
    rows = [(3, " ".join(words), 1, 2), (2, " ".join(words[:-1]), 1, 2), (1, "other text of its own", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int, root int")
    got = {x.doc_id: x.component_id for x in simhash.digests(df).collect()}
    assert got == {1: 1, 2: 2, 3: 2}
    assert sorted((x.doc_id, x.fp, x.root) for x in simhash.dedup(df).collect()) == [(1, 1, 2), (2, 1, 2)]


def test_empty_and_dedup(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x", 1), (2, "a b c d e f", "y", 2), (2, "a b c d e f", "y", 2), (3, None, None, None), (4, "", None, None), (1, "a b c d e f", "x", 1)], SCHEMA)
    assert simhash.digests(df.limit(0)).collect() == []
    kept = simhash.dedup(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
