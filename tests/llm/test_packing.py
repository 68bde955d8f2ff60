import random
from collections import defaultdict

from tessera.llm import packing
from tessera.llm.queries import tokenizer
from tessera.llm.token_counts import count_texts


def plain(items, capacity):
    """Best fit by looking at every bin."""
    bins, out = [], []
    for size, s, c in items:
        fit = [(capacity - sum(x[0] for x in b), i) for i, b in enumerate(bins) if capacity - sum(x[0] for x in b) >= size and not any((s is not None and x[1] == s) or (c is not None and x[2] == c) for x in b)]
        if fit:
            i = min(fit)[1]
        else:
            i = len(bins)
            bins.append([])
        out.append((i, sum(x[0] for x in bins[i])))
        bins[i].append((size, s, c))
    return out


def test_best_fit_matches_a_plain_search():
    r = random.Random(8)
    for seed in range(20):
        items = sorted(((r.randint(1, 100), r.choice([None, "a", "a", "b", "c", str(seed)]), r.choice([None, 1, 2, 3, r.randint(4, 90)])) for _ in range(200)), key=lambda x: -x[0])
        bins, offsets = packing.best_fit(items, 100)
        assert list(zip(bins, offsets)) == plain(items, 100)


def test_whole_documents_are_packed(spark):
    path = tokenizer("byte_bpe_50k.json")
    r = random.Random(2)
    rows = [(i if i else None, " ".join(r.choice(["alpha", "beta", "é"]) for _ in range(r.choice([1, 10, 60, 900]))), r.choice(["hot", "hot", "b", None]), i) for i in range(300)]
    rows += [(1000, None, "b", 1), (1001, "", None, 1), (7, rows[7][1], rows[7][2], 7)] + [(2000 + i, "same text for all of these", None, 1) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard long").repartition(3)
    got = packing.pack(df, path, capacity=128, shard=64).collect()
    want = defaultdict(int)
    for (d, t, *_), n in zip(rows, count_texts([x[1] for x in rows], path).tolist()):
        want[d] += n
    have, bins = defaultdict(int), defaultdict(list)
    for x in got:
        have[x.doc_id] += x.n_tokens
        if x.bin_id is None:
            assert x.n_tokens == 0
        else:
            bins[x.bin_id].append(x)
    assert have == want
    text = {d: t for d, t, *_ in rows}
    for members in bins.values():
        members.sort(key=lambda x: x.bin_offset)
        end = 0
        for x in members:
            assert x.bin_offset == end
            end += x.n_tokens
        assert end <= 128
        own = [x.source for x in members if x.source is not None]
        assert len(own) == len(set(own))
        assert len({text[x.doc_id] for x in members}) == len(members)
    assert packing.pack(df.limit(0), path).collect() == []
