import numpy as np
import pytest

from tessera.llm import language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.identify(docs, language.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert 150 < len(held) < 350 and (held.lang == held.lang_pred).mean() > 0.97
    assert out.score.between(0, 1).all()


def test_only_text_decides_and_odd_rows(spark):
    rows = [(i, "the cat and the dog with this", "en", "s", 1.0) for i in range(20)] + [(20 + i, "le chat et les chiens avec une", "fr", "s", 1.0) for i in range(20)]
    rows += [(100, None, "en", None, None), (101, "", None, None, None), (102, "12 345 !!", "fr", None, None), (None, "Les chiens avec le chat", None, None, None), (103, "THE DOG" * 5000, None, None, None), (104, "中文", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double").repartition(3)
    p = language.learn(df)
    got = {r.doc_id: r for r in language.identify(df, p).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[102].score == 0
    assert got[None].lang_pred == "fr" and not got[None].held_out and got[103].lang_pred == "en" and got[104].lang_pred in ("en", "fr")
    assert language.identify(df.limit(0), p).collect() == []
    none = language.learn(df.limit(0))
    assert {r.lang_pred for r in language.identify(df, none).collect()} == {"und"}


def test_scores_are_cosines_of_the_bundles():
    texts = ["the dog and the cat", "le chat"]
    p = language.Profiles(["a", "b"], np.stack([np.bincount(language.trigrams([t])[1], minlength=language.K**3) for t in texts]))

    def bundle(t):
        g = language.trigrams([t])[1]
        return sum(np.roll(language._letters[x // 4096], 2).astype(float) * np.roll(language._letters[x // 64 % 64], 1) * language._letters[x % 64] for x in g)

    names, score = p.predict(["the cat"])
    v = bundle("the cat")
    cos = [float(v @ bundle(t) / np.linalg.norm(v) / np.linalg.norm(bundle(t))) for t in texts]
    assert names == ["a"] and abs(score[0] - max(cos)) < 1e-3


def test_predictions_match_plain_bundles(spark):
    """Letter vectors bound, bundled and compared one by one, for every document of a table."""
    import unicodedata
    import zlib

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()
    df = spark.createDataFrame([(r.doc_id, (r.text or "")[:600], r.lang) for r in rows], "doc_id long, text string, lang string")
    letter = lambda c: language.codes()[ord(c)] if unicodedata.category(c).startswith("L") else 0

    def bundle(text):
        out, c = np.zeros(language.SIZE), [0, *map(letter, text.lower()), 0]
        for i in range(1, len(c) - 1):
            if c[i]:
                out += np.roll(language._letters[c[i - 1]], 2).astype(float) * np.roll(language._letters[c[i]], 1) * language._letters[c[i + 1]]
        return out

    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    texts = {r.doc_id: (r.text or "")[:600] for r in rows}
    own = {d: bundle(t) for d, t in texts.items()}
    langs = sorted({r.lang for r in rows if r.lang and not held(r.doc_id)})
    proto = {x: sum(own[r.doc_id] for r in rows if r.lang == x and not held(r.doc_id)) for x in langs}
    for r in language.identify(df, language.learn(df)).collect():
        v = own[r.doc_id]
        cos = {x: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for x, p in proto.items()}
        best = max(langs, key=lambda x: cos[x])
        assert r.held_out == held(r.doc_id) and (r.lang_pred == best or cos[best] - cos[r.lang_pred] < 1e-4)
        assert abs(r.score - min(1.0, max(0.0, cos[best]))) < 1e-3


def test_ties_go_to_the_first_language(spark):
    df = spark.createDataFrame([(1, "same text", "xx"), (3, "same text", "aa"), (4, "same text", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify(df, language.learn(df)).collect()} == {"aa"}


def test_languages_are_bounded(spark, monkeypatch):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(4 * i + k, f"{letters[i]}{letters[(i + 1) % 26]}{letters[(i + 2) % 26]} " * 20, f"l{i:02}") for i in range(26) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    found = {r.doc_id: r.lang_pred for r in language.identify(df, language.learn(df)).collect()}
    assert all(found[d] == lang for d, _, lang in rows)
    monkeypatch.setattr(language, "MOST", 25)
    with pytest.raises(ValueError, match="more than 25 languages"):
        language.learn(df)
