import random

import numpy as np
import pytest

from tessera.llm import cover_dedup, suffix_dedup, windows
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int"


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(40)]
    shared = [" ".join(r.choice(vocab) for _ in range(r.randint(20, 120))) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 4)):
            parts.append(r.choice(shared) if r.random() < 0.4 else " ".join(r.choice(vocab) for _ in range(r.randint(1, 90))))
        t = r.choice([" ", "\n", ""]).join(parts)
        if r.random() < 0.3 and rows:
            t = r.choice(rows)[1] or ""
            k = r.randint(0, len(t))
            t = t[:k] + r.choice(["", "x", "yy zz"]) + t[k + r.randint(0, 3) :]
        rows.append((r.choice([i, i, i, i // 2, None]) if r.random() < 0.2 else i, t if r.random() > 0.05 else None))
    rows += [(500, "a" * 300), (501, "a" * 180), (502, "ab" * 90), (500, "a" * 60), (503, "x " * 200), (504, "x " * 120), (505, "word"), (506, "")]
    r.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame([(d, t, None, "s", None, 1) for d, t in rows], SCHEMA).repartition(3)


def key(row):
    return tuple((x is None, x) if not isinstance(x, str) else (False, x) for x in row)


@pytest.mark.parametrize("hot", [2, windows.HOT])
@pytest.mark.parametrize("block", [2000, 1 << 20])
def test_bytes_match_brute_force(spark, monkeypatch, block, hot):
    monkeypatch.setattr(windows, "BLOCK", block)
    monkeypatch.setattr(windows, "HOT", hot)
    rows = corpus(block + hot)
    want = [r[:5] for r in brute.remove_bytes(rows)]
    got = [tuple(r) for r in suffix_dedup.digests(table(spark, rows)).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("hot", [2, windows.HOT])
@pytest.mark.parametrize("block", [2000, 1 << 20])
def test_words_match_brute_force(spark, monkeypatch, block, hot):
    monkeypatch.setattr(windows, "BLOCK", block)
    monkeypatch.setattr(windows, "HOT", hot)
    rows = corpus(7 + block + hot)
    want = brute.remove_words(rows)
    got = [tuple(r) for r in cover_dedup.digests(table(spark, rows)).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("op", [suffix_dedup, cover_dedup])
def test_tables_keep_their_columns(spark, op):
    rows = [(1, "only one"), (2, None), (3, "w " * 80), (4, "w " * 80)]
    got = op.dedup(table(spark, rows))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "bucket"]
    out = {r.doc_id: r.text for r in got.collect()}
    assert out[1] == "only one" and out[2] is None and out[4] in ("", " ") and len(out) == 4
    assert op.dedup(table(spark, rows).limit(0)).collect() == []
    assert op.digests(table(spark, rows).limit(0)).collect() == []


def test_cover_has_every_difference():
    assert sorted({(a - b) % cover_dedup.PERIOD for a in cover_dedup.COVER for b in cover_dedup.COVER}) == list(range(cover_dedup.PERIOD))


def test_suffix_sort_is_exact():
    r = np.random.default_rng(3)
    joined = r.integers(97, 99, 5000).astype(np.uint8)
    joined[1000:1200] = joined[3000:3200]
    places = np.arange(len(joined) - 50)
    kinds = suffix_dedup.suffix_classes(joined, places)
    strings = [joined[p : p + 50].tobytes() for p in places]
    assert len(set(kinds.tolist())) == len(set(strings)) == len(set(zip(kinds.tolist(), strings)))


def test_a_window_alone_is_not_sorted_at_every_byte(monkeypatch):
    r = np.random.default_rng(4)
    pool = r.integers(97, 100, (300, 50)).astype(np.uint8)
    pool[:, :40] = pool[0, :40]
    own = pool[r.integers(0, 300, 4000)]
    sizes, sort, unique = [], np.argsort, np.unique
    monkeypatch.setattr(np, "argsort", lambda x, *a, **k: sizes.append(len(x)) or sort(x, *a, **k))
    monkeypatch.setattr(np, "unique", lambda x, *a, **k: sizes.append(len(x)) or unique(x, *a, **k))
    owner, place, kinds = suffix_dedup.classes(own.ravel(), np.arange(0, own.size + 1, 50))
    monkeypatch.undo()
    assert owner.tolist() == list(range(4000)) and not place.any() and max(sizes) <= 8 * 4000
    strings = [x.tobytes() for x in own]
    assert len(set(kinds.tolist())) == len(set(strings)) == len(set(zip(kinds.tolist(), strings)))


@pytest.mark.parametrize("op", [suffix_dedup, cover_dedup])
def test_no_name_clashes_and_long_texts(spark, op):
    r = random.Random(5)
    shared = " ".join(f"w{r.randrange(10**6)}" for _ in range(200_000))
    names = ["block", "key", "text", "doc_id", "o0", "__text", "bucket", "a b"]
    rows = [("b1", 7, shared + " end", 2, 8, "t", 9, 3), ("b2", 8, "start " + shared, 1, 8, "t", 9, 4), ("b3", 9, "own text", None, 8, None, None, 5)]
    got = op.dedup(spark.createDataFrame(rows, "block string, key long, text string, doc_id int, o0 int, __text string, bucket int, `a b` int"))
    assert got.columns == names and dict(got.dtypes)["doc_id"] == "int"
    out = {x["a b"]: x for x in got.collect()}
    assert out[4].text == "start " + shared and out[5].text == "own text"
    assert out[3].text.split() == ["end"] and [tuple(out[k])[:2] for k in (3, 4, 5)] == [("b1", 7), ("b2", 8), ("b3", 9)]


def test_null_ids_are_dealt_to_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(windows, "BLOCK", 2000)
    rows = [(None, f"{i} " * 100) for i in range(50)] + [(3, "7 " * 60), (None, "7 " * 40)]
    want = [r[:5] for r in brute.remove_bytes(rows)]
    got = [tuple(r) for r in suffix_dedup.digests(table(spark, rows)).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def passages(n, seed, size):
    """A passage in many documents of different surroundings, some with a second one; copies and plain texts between."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(10**6)}"
    one, two = (" ".join(word() for _ in range(size)) for _ in range(2))
    rows = []
    for i in range(n):
        own = " ".join(word() for _ in range(8))
        rows.append((r.choice([i, i, i, None]) if i % 50 else 3, f"{own} {one} {own[::-1]}" if i % 3 else f"{own} {two} x {one[:400]}" if i % 2 else own * 3))
    return rows


@pytest.mark.parametrize("op, plain", [(suffix_dedup, lambda rows: [r[:5] for r in brute.remove_bytes(rows)]), (cover_dedup, brute.remove_words)])
@pytest.mark.parametrize("local, hot", [(2, windows.HOT), (5, 3), (10**6, 5), (10**6, windows.HOT)])
def test_hot_passages_match_brute_force(spark, monkeypatch, op, plain, local, hot):
    monkeypatch.setattr(windows, "BLOCK", 8000)
    monkeypatch.setattr(windows, "LOCAL", local)
    monkeypatch.setattr(windows, "HOT", hot)
    monkeypatch.setattr(windows, "CHUNK_ROWS", 3)
    rows = passages(150, local + hot, 90)
    got = [tuple(r) for r in op.digests(table(spark, rows)).collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


@pytest.mark.parametrize("op", [suffix_dedup, cover_dedup])
def test_a_passage_everywhere_is_no_hot_group(spark, monkeypatch, op):
    """20,000 documents of different surroundings share a passage: what a bucket gets, and what is shown of one window, is a row a block."""
    r = random.Random(11)
    shared = " ".join(f"p{r.randrange(10**6)}" for _ in range(80))
    df = spark.range(20_000, numPartitions=4).selectExpr("id as doc_id", f"concat(sha2(cast(id as string), 256), ' {shared} ', sha2(cast(-id - 1 as string), 256)) as text")
    monkeypatch.setattr(windows, "BLOCK", 1 << 20)
    seen = []
    apply = type(df.groupBy("doc_id")).applyInArrow

    def watched(self, f, schema):
        out = apply(self, f, schema)
        if "marks binary" in str(schema):
            seen.append(out)
        return out

    monkeypatch.setattr(type(df.groupBy("doc_id")), "applyInArrow", watched)
    got = op.digests(df)
    sent = seen[0].selectExpr("sum(length(keys)) / 6 as contexts", "sum(length(marks)) / 6 as marks").first()
    # an anchor at the passage's edges has 20,000 contexts
    assert sent.contexts < 20_000 * 40 and sent.marks > 0
    rows = {x.doc_id: x for x in got.collect()}
    gone = {x.n_removed for i, x in rows.items() if i}
    # bytes around the passage may agree with an earlier document by chance
    assert rows[0].n_removed == 0 and (gone == {80} if op is cover_dedup else len(shared) + 2 <= min(gone) and max(gone) < len(shared) + 20)
