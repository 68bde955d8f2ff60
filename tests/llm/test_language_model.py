import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import language_model
from tessera.llm.ngram_trie import STEP, VALUE, EliasFano, Trie


def sequence(values):
    n, low, high = EliasFano.arrays(np.array(values, np.int64))
    return EliasFano(int(n[0]), int(n[1]), low, high)


@pytest.mark.parametrize("values", [[], [0], [7], [2**40], [0] * 5, [3, 3, 3, 9, 9, 2**33], list(range(1000)), sorted(random.Random(1).randrange(10**6) for _ in range(5000)), sorted(random.Random(2).randrange(3000) ** 4 for _ in range(700))])
def test_sequences(values):
    s = sequence(values)
    assert s[np.arange(len(values))].tolist() == values
    asked = sorted({0, 1, 5, 2**41, *values, *[v + 1 for v in values], *[v - 1 for v in values if v]})
    assert s.find(np.array(asked, np.int64)).tolist() == [values.index(x) if x in values else -1 for x in asked]
    r = random.Random(3)
    for _ in range(20):
        i = r.randint(0, len(values))
        j = r.randint(i, len(values))
        own = values[i:j]
        got = s.find(np.array(asked, np.int64), np.full(len(asked), i), np.full(len(asked), j)).tolist()
        assert got == [i + own.index(x) if x in own else -1 for x in asked]


def test_sequences_are_compact():
    values = np.sort(np.random.default_rng(1).integers(0, 2**32, 100_000))
    assert sum(x.nbytes for x in EliasFano.arrays(values)) * 8 / len(values) < 2 + math.log2(2**32 / len(values)) + 0.1


def rounded(p):
    k = math.ceil(-math.log10(p) / STEP - 1e-9)
    return 10 ** (-STEP * max(k, 0)) if k <= 254 else 0.0


def plain(rows):
    """rows of (doc_id, text): the model in plain Python."""
    def tokens(t):
        return [x.encode() for x in re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] + ["end"]

    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    c1, c2, c3 = Counter(), Counter(), Counter()
    for (_, t), h in zip(rows, held):
        if not h:
            w = ["start", "start", *tokens(t)]
            c1.update(w[2:])
            c2.update(zip(w[1:], w[2:]))
            c2["start", "start"] += 1
            c3.update(zip(w, w[1:], w[2:]))
    n, kinds = sum(c1.values()), len(c1)
    c1["start"] = c1["end"]
    m2, m3 = language_model.PRIORS
    out = []
    for (d, t), h in zip(rows, held):
        own = tokens(t)
        w, base, score = ["start", "start", *own], 0.0, 0.0
        for x, y, z in zip(w, w[1:], w[2:]):
            p1 = (c1[z] + 0.1) / (n + 0.1 * (kinds + 1))
            p2 = (rounded(c2[y, z] / (c1[y] + m2)) if c2[y, z] else 0) + m2 / (c1[y] + m2) * p1
            p3 = (rounded(c3[x, y, z] / (c2[x, y] + m3)) if c3[x, y, z] else 0) + (rounded(m3 / (c2[x, y] + m3)) if c2[x, y] else 1.0) * p2
            base, score = base + math.log10(p1), score + math.log10(p3)
        out.append((d, h, len(own), sum(c1[z] > 0 for z in own), n, base, score))
    return out


def agree(got, want):
    order = lambda x: (x[0] is None, x[0] or 0, x[2], x[5])
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    np.testing.assert_allclose([x[5:] for x in got], [x[5:] for x in want], rtol=1e-9, atol=1e-9)


def test_query_equals_plain_python(spark, sf):
    from tessera.llm.queries import QUERIES

    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op12_language_model"](spark, sf).collect()
    agree(got, plain(rows))
    held = [x for x in got if x.held_out]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)


@pytest.mark.parametrize("split", [0, 3, 1 << 14])
def test_odd_rows_many_blocks_and_frequent_words(spark, monkeypatch, split):
    monkeypatch.setattr(language_model, "BLOCK", 2000)
    monkeypatch.setattr(language_model, "SPLIT", split)
    r = random.Random(split)
    words = ["the", "The", "of", *[f"w{i}" for i in range(60)], "é", "É", "中文", "end", "start"]
    texts = [None, "", " \n\t ", "the " * 3000, "x" * 50_000, "a\x0bb\x0cc\r\nd e", *[" ".join(r.choices(words, weights=[30, 5, 10, *[1] * 65], k=r.randint(1, 60))) for _ in range(80)]]
    rows = [(r.choice([None, *range(60)]), r.choice(texts)) for _ in range(160)] + [(None, "only here"), (12, "the the of")] * 3
    df = spark.createDataFrame([(*x, 1, 2, "z", False) for x in rows], "doc_id long, text string, block int, key int, words string, held boolean").repartition(5)
    agree(language_model.score(df).collect(), plain(rows))


def test_empty_tables_nothing_trained_and_types(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert language_model.score(df).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    out = language_model.score(spark.createDataFrame([(held, "a b")], df.schema))
    assert [tuple(x) for x in out.collect()] == [(held, True, 3, 0, 0, 0.0, 0.0)]
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]
    one = language_model.score(spark.createDataFrame([("k", "a b"), (None, "a")], "doc_id string, text string")).collect()
    assert {x.doc_id for x in one} == {"k", None}


def test_next_words_sum_to_at_most_one():
    """The probabilities of all words after each context, with what is left to unknown words."""
    r = np.random.default_rng(4)
    text = r.integers(2, 14, 600)
    m2, m3 = language_model.PRIORS
    total = Counter(text[:-2].tolist())
    words = np.arange(2, 14)
    pairs = sorted(set(zip(text[:-2].tolist(), text[1:-1].tolist())))
    seen = Counter(zip(text.tolist(), text[1:].tolist(), text[2:].tolist()))
    triples = sorted(seen)
    first, second = np.array(pairs).T - 2
    context, third = np.array([(pairs.index((a, b)), c - 2) for a, b, c in triples]).T
    trie = Trie(Trie.levels(words, first, second, np.array([total[a] for a, _ in pairs]), context, third, np.array([seen[x] for x in triples]), (m2, m3)))
    n = len(words)
    every = np.arange(n)
    for u in every:
        for v in every:
            a2, _, _ = trie.look_up(words, np.full(n, v), every, np.zeros(0, np.int64), np.zeros(0, np.int64))
            _, b3, a3 = trie.look_up(words, np.array([u]), np.array([v]), np.zeros(n, np.int64), every)
            left = VALUE[b3[0]] if b3[0] else 1.0
            began = total[int(v) + 2]
            sum_ = VALUE[a3].sum() + left * (VALUE[a2].sum() + m2 / (began + m2))
            assert 0.9 < sum_ < 1 + 2 / (began + m2)


def test_tries_are_read_in_place(spark):
    df = spark.createDataFrame([(1, "a b c a b d")], "doc_id long, text string")
    model = language_model.Model(df, language_model.held_out(df.doc_id))
    levels = model.tries().collect()[0].levels
    trie = Trie(bytes(levels))
    assert trie.third.n == 8 and trie.words.n == 7 and not trie.pair_code.flags.owndata
