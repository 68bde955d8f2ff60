import hashlib
import random
import re

import pytest

from tessera.llm import spotsigs


def plain(text):
    words = [w for w in re.split("[^0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text)) if w]
    out = set()
    for i, w in enumerate(words):
        if w in spotsigs.COMMON:
            later = [x for x in words[i + 1 :] if x not in spotsigs.COMMON][:2]
            if len(later) == 2:
                out.add((w, *later))
    return out or {tuple(words[i : i + 2]) for i in range(len(words))}


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


@pytest.mark.parametrize("size", [300, 1 << 20])
def test_matches_plain_python(spark, monkeypatch, size):
    monkeypatch.setattr(spotsigs, "RANGE", size)
    r = random.Random(size)
    vocab = ["the", "of", "and", "la", "Der"] + ["".join(r.choice("abcé") for _ in range(r.randint(2, 5))) for _ in range(30)]
    rows = [(r.randint(0, 60) if r.random() < 0.95 else None, None if r.random() < 0.05 else r.choice([" ", ", ", "\n"]).join(r.choice(vocab) for _ in range(r.choice([0, 1, 5, 60])))) for _ in range(80)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fingerprint string").repartition(3)
    got = spotsigs.fingerprints(df).collect()
    order = sorted([(2**63 - 1 if d is None else d, t or "", d) for d, t in rows])
    want = []
    for i, (_, t, d) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        e = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        a = plain(t)
        want.append((-1 if d is None else d, len(t), hashlib.sha256(e.encode()).hexdigest(), round(jaccard(a, plain(e)), 9), round(jaccard(a, plain(nxt)), 9)))
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.n_chars, x.edited_sha256, round(x.near_edited, 9), round(x.near_next, 9)) for x in got) == sorted(want)
    # a fingerprint tells the length and the least signatures of a set, and is equal exactly where sets are
    sets = sorted((-1 if d is None else d, len(t), tuple(sorted(plain(t)))) for _, t, d in order)
    own = sorted((-1 if x.doc_id is None else x.doc_id, x.n_chars, x.fingerprint) for x in got)
    assert [(d, n, len(s)) for d, n, s in sets] == [(d, n, int(f.split(":")[0])) for d, n, f in own] or len({d for d, *_ in own}) < len(own)
    by_text = {}
    for x in got:
        by_text.setdefault(x.fingerprint, 0)
    assert len(by_text) == len({frozenset(plain(t)) for _, t, _ in order})


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(7, "the quick brown fox of my house big")], "doc_id long, text string")
    row = spotsigs.fingerprints(df).first()
    assert row.near_next == 1.0 and row.doc_id == 7
    assert spotsigs.fingerprints(df.limit(0)).collect() == []


def test_near_duplicates_lose_no_link(spark):
    r = random.Random(12)
    vocab = ["the", "of", "and", "la"] + ["w" + str(i) for i in range(200)]
    rows = []
    for i in range(120):
        if rows and r.random() < 0.6:
            w = r.choice(rows)[1].split()
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocab)
        else:
            w = [r.choice(vocab) for _ in range(r.randint(20, 150))]
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    members, links = spotsigs.near_duplicates(df)
    sets = {d: frozenset(plain(t)) for d, t in rows}
    least = {}
    for d, s in sets.items():
        least.setdefault(s, d)
    assert {tuple(x) for x in members.collect()} == {(d, least[s]) for d, s in sets.items()}
    reps = sorted(set(least.values()))
    want = {(a, b) for a in reps for b in reps if a < b and jaccard(sets[a], sets[b]) >= 0.8}
    assert {(x.a, x.b) for x in links.collect()} == want and len(want) > 5
    rows = {x.doc_id: (x["class"], x.n_links) for x in spotsigs.linked(df).collect()}
    assert rows == {d: (least[s], sum(least[s] in p for p in want)) for d, s in sets.items()}


def test_very_long_text(spark):
    text = "the quick brown fox " * 200_000
    row = spotsigs.fingerprints(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).collect()
    assert {(x.n_chars, x.near_next) for x in row} == {(len(text), 1.0)}
