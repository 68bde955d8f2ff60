import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tessera.llm import boosting, quality, stats


def plain(t):
    t = t or ""
    words = re.findall("[^\x20\x09-\x0d]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    tri = Counter(zip(words, words[1:], words[2:]))
    own = set()
    for i in range(len(words) - 2):
        if tri[tuple(words[i : i + 3])] >= 2:
            own |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", t)), dup, len(own)


def test_counts_match_plain_python(spark):
    r = random.Random(4)
    al = ["a", "bé", "中文", "the", "#", "|x|", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", " ", "$%&"]
    texts = [None, "", " \n ", "a a a a", "x y z x y z"] + ["".join(r.choice(al) for _ in range(r.randint(1, 120))) for _ in range(300)]
    df = spark.createDataFrame([(i if i else None, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, n_words double").repartition(3)
    forest = boosting.fit(np.zeros((0, len(stats.FEATURES))), np.zeros(0), quality.MONOTONE)
    got = {r.doc_id: r for r in quality.judge(df, forest).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i if i else None]
        want = plain(t)
        assert tuple(r[k] for k in stats.BASE) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed)
    assert quality.judge(df.limit(0), forest).collect() == []
    assert quality.keep(df, forest).columns == df.columns


def test_trees_learn_and_keep_their_direction():
    r = np.random.default_rng(2)
    x = r.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) & (x[:, 1] < 0.5) ^ (r.random(4000) < 0.05)).astype(float)
    f = boosting.fit(x, y, np.array([1, -1, 0]))
    assert ((f.probability(x) > 0.5) == (y > 0.5)).mean() > 0.9
    for feature, sign in ((0, 1), (1, -1)):
        for base in x[:50]:
            line = np.repeat(base[None], 60, 0)
            line[:, feature] = np.linspace(-3, 3, 60)
            assert (np.diff(f.margin(line)) * sign >= -1e-9).all()


def test_training_on_labels(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    f = quality.train(docs, labels)
    out = quality.judge(docs, f).join(labels, "doc_id").toPandas()
    assert out[out.quality == 1].kept.mean() > 0.9
    assert out[out.quality == 0].kept.mean() < 0.3
    assert len(quality.train(docs, labels.limit(0)).root) == 0


def test_verdicts_match_a_plain_walk_of_the_trees(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    f = quality.train(docs, labels)
    assert len(f.root) > 10
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    _, x = stats.measure(pa.array([t for _, t in texts]))
    got = {r.doc_id: r for r in quality.judge(docs, f).collect()}
    for (d, t), row in zip(texts, x):
        total = f.bias
        for at in f.root:
            while f.feature[at] >= 0:
                at = f.left[at] if row[f.feature[at]] <= f.threshold[at] else f.right[at]
            total += f.value[at]
        p = 1 / (1 + np.exp(-total))
        assert abs(got[d].quality_score - p) < 1e-9 and got[d].kept == (not got[d].base_failed and p >= quality.THRESHOLD)


def test_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(300_000)) + "\nline\nline"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = quality.judge(df, boosting.fit(np.zeros((0, len(stats.FEATURES))), np.zeros(0), quality.MONOTONE)).first()
    assert tuple(row[k] for k in stats.BASE) == plain(text)
