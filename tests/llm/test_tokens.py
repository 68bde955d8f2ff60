import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

from tessera.llm import encoding, token_counts
from tessera.llm.queries import tokenizer

PIECES = ["a", "b", "Z", "'", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "1", "23", "é", "é", "ß", "中", "!", "…", "<|endoftext|>", "<|startoftext|>", " ", "İ", "Σ", "😀", "\x85", "\x1c", "'d", "'ve", "<", "_", "ſ", "Ⅷ", "²", "Ᲊ", "word", "-----", "the"]


def texts(n=4000):
    r = random.Random(6)
    return [None, "", "a" * 20_000, "ab1! " * 5000] + ["".join(r.choice(PIECES) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_counts_match_the_library():
    path = tokenizer("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    data = texts()
    want = [len(x.ids) for x in lib.encode_batch([t or "" for t in data], add_special_tokens=False)]
    assert token_counts.count_texts(data, path).tolist() == want


def test_ids_and_decoding_match_the_library(spark, monkeypatch):
    monkeypatch.setattr(encoding, "BLOCK", 20_000)
    path = tokenizer("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    data = texts()
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.ids, r.decoded) for r in encoding.encode(df, path).collect()}
    assert len(got) == len(data)
    for i, x in enumerate(lib.encode_batch([t or "" for t in data], add_special_tokens=False)):
        assert got[i] == (x.ids, lib.decode(x.ids, skip_special_tokens=False))


def test_rows(spark):
    path = tokenizer("byte_bpe_50k.json")
    df = spark.createDataFrame([(1, "a b c", 1), (1, "a b c", 1), (None, None, 2), (3, "x" * 3000, 1)], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, token_counts.count_tokens(df, path).collect()), key=str)
    assert got == sorted([(1, 5, 3, False)] * 2 + [(None, 0, 0, False), (3, 3000, token_counts.count_texts(["x" * 3000], path)[0], bool(token_counts.count_texts(["x" * 3000], path)[0] > 1024))], key=str)
    words = tokenizer("word_bpe_49k.json")
    full, short = encoding.encode(df, words), encoding.digests(df, words)
    whole = sorted((str(r.doc_id), len(r.ids), hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r.decoded.encode()).hexdigest()) for r in full.collect())
    assert whole == sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in short.collect())
    assert sorted(r.decoded for r in encoding.decode(full, words).collect()) == sorted(r.decoded for r in full.collect())
    assert token_counts.count_tokens(df.limit(0), path).collect() == [] and encoding.digests(df.limit(0), words).collect() == []
