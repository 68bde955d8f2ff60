"""Operator 5: language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds (by
products) its letters' vectors, permuted by their place; a text's vector
bundles (adds) its trigrams'. A language's prototype bundles all trigrams of
its training documents, so it follows from the trigram counts of the language:
a table of at most languages x 64**3 rows, whatever the corpus, for at most
`MOST` languages, which is checked. The language
whose prototype has the greatest cosine with the document is predicted.

Two scans: one counts trigrams by language (partial sums in each task), one
predicts. No text is shuffled.

Defined cases: a null text or one without letters is `und` with score 0, as is
every text when nothing was learned; a null
lang is never learned from, a null doc_id is never held out; ties go to the
language first in order; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm.arrays import mix

SIZE = 512
K = 64
#: Languages that may be learned; more are an error. A task has 1 MB for each, the driver their trigrams' counts.
MOST = 100
UNKNOWN = "und"
_codes: np.ndarray | None = None

_rng = np.random.Generator(np.random.PCG64(64))
_letters = (_rng.integers(0, 2, (K, SIZE)) * 2 - 1).astype(np.int8)
#: Bound pairs: first letter permuted twice, second once.
_pairs = (np.roll(_letters, 2, 1)[:, None, :] * np.roll(_letters, 1, 1)[None, :, :]).reshape(K * K, SIZE)


def codes() -> np.ndarray:
    """Letter code of each code point: 0 is no letter, a-z have their own, other letters share the rest by a hash."""
    global _codes
    if _codes is None:
        kinds = bpe.tables()[0]
        c = (27 + mix(np.arange(0x110000, dtype=np.uint64)) % np.uint64(K - 27)).astype(np.uint8)
        c[ord("a") : ord("z") + 1] = np.arange(1, 27)
        c[kinds != bpe.LETTER] = 0
        _codes = c
    return _codes


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, trigram) of every trigram: words with a boundary before and after, and trigrams with a boundary in the middle are left out."""
    joined = "\n".join([(t or "").lower() for t in texts])
    points = np.frombuffer(("\n" + joined + "\n").encode("utf-32-le"), np.uint32)
    c = codes()[points].astype(np.int64)
    ends = np.cumsum([len((t or "").lower()) + 1 for t in texts])
    at = np.flatnonzero(c[1:-1]) + 1
    return np.searchsorted(ends, at - 1, "right"), (c[at - 1] * K + c[at]) * K + c[at + 1]


def batches(texts: list[str | None]):
    return bpe.batches([t or "" for t in texts], 300_000)


def held_out(key: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


class Profiles:
    """Prototypes, and for each trigram its products with them."""

    def __init__(self, names: list[str], counts: np.ndarray):
        """counts: languages x K**3."""
        self.names = names
        self.scores = np.zeros((len(names), K**3), np.float32)
        pairs, letters = _pairs.astype(np.float32), _letters.astype(np.float32)
        for i in range(len(names)):
            bundle = (pairs * (counts[i].reshape(K * K, K).astype(np.float32) @ letters)).sum(0)
            bundle /= max(1e-9, float(np.linalg.norm(bundle)))
            self.scores[i] = ((pairs * bundle) @ letters.T).reshape(-1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.names:
            return names, score
        for i, j in batches(texts):
            row, gram = trigrams(texts[i:j])
            keys, n = np.unique(row * K**3 + gram, return_counts=True)
            row, gram = keys // K**3, keys % K**3
            edges = np.searchsorted(row, np.arange(j - i + 1))
            for k in np.flatnonzero(np.diff(edges)).tolist():
                g, w = gram[edges[k] : edges[k + 1]], n[edges[k] : edges[k + 1]].astype(np.float32)
                bundle = np.zeros(SIZE, np.float32)
                for p in range(0, len(g), 4096):
                    q = g[p : p + 4096]
                    bundle += w[p : p + 4096] @ (_pairs[q // K] * _letters[q % K]).astype(np.float32)
                cosine = self.scores[:, g] @ w / max(1e-9, float(np.linalg.norm(bundle)))
                best = int(cosine.argmax())
                names[i + k], score[i + k] = self.names[best], min(1.0, max(0.0, float(cosine[best])))
        return names, score


def learn(docs: DataFrame) -> Profiles:
    """Profiles from the documents that are not held out and have a lang."""

    def run(parts):
        for b in parts:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            # a language at a time, so that one table of counts is held
            for name in sorted(set(langs)):
                own, counts = [t for t, x in zip(texts, langs, strict=True) if x == name], np.zeros(K**3, np.int64)
                for i, j in batches(own):
                    counts += np.bincount(trigrams(own[i:j])[1], minlength=K**3)
                at = np.flatnonzero(counts)
                yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "gram", "n"])

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id")).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = [r[0] for r in rows.select("lang").distinct().limit(MOST + 1).collect()]
    if len(known) > MOST:
        raise ValueError(f"more than {MOST} languages: {sorted(known)[:5]} and others")
    got = rows.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((len(names), K**3), np.int64)
    which = {x: i for i, x in enumerate(names)}
    np.add.at(counts, ([which[x] for x in got.column("lang").to_pylist()], got.column("gram").to_numpy()), got.column("n").to_numpy())
    return Profiles(names, counts)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs."""

    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(parts):
        for b in parts:
            names, score = shared.value.predict(b.column(2).to_pylist())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
