"""Operator 12: scores of texts by a trigram model in Elias-Fano tries.

Smoothed by Dirichlet priors, each order on the one below:

    p1(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))
    p2(w|v) = (c(vw) + M2 p1(w)) / (c(v) + M2)
    p3(w|uv) = (c(uvw) + M3 p2(w|v)) / (c(uv) + M3)

so p3 = a3 + b3 (a2 + b2 p1). The tries hold a3 and b3 of each triple and
context and a2 of each pair as bytes (rounded down, hence a text's probability
is never overstated); b2 and p1 follow from exact counts of words.

1. Documents are dealt to blocks by a hash of doc_id and text (one exchange of
   texts, reused by the later steps). A block sends its distinct words, with
   their counts in training documents, to the words' buckets, and gets back the
   counts of the corpus and a number for each word.
2. A block sends its distinct triples, numbered and packed, to the bucket of
   their first word (of their first two, where the first is frequent). A bucket
   builds the trie of its trained triples in a memory map and looks up all that
   it was sent, by successor search within each context.
3. Blocks add up their documents.

Nothing is capped: every word, pair and triple of the training documents is
counted, and blocks and buckets grow in number with the corpus, not in size.
Only distinct triples of a block move, so a triple, pair or word that is
everywhere comes once a block. The sum of all counts and the number of words
are scalar subqueries.

Defined cases: a null or empty text has one token, its end; words are runs of
bytes other than space and \\t \\n \\v \\f \\r with A-Z in lower case, told apart
by 64 hash bits; a null doc_id is never held out; repeated rows each count and
each give a row; other columns are ignored, whatever their names; without
training documents every text scores 0; an empty table gives an empty result.
"""

from __future__ import annotations

import mmap

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import arrays
from tessera.llm.cover_dedup import word_values
from tessera.llm.encoding import packed, unpacked
from tessera.llm.ngram_trie import VALUE, Trie
from tessera.llm.windows import bucket_of

#: UTF-8 bytes of text in a block; blocks to a task, on average.
BLOCK = 6 << 20
TASK = 2
#: Priors M2 and M3.
PRIORS = (50.0, 5.0)
#: Triples whose first word is seen more often than this are dealt by their first two words: a small part of a bucket, at any size of the corpus.
SPLIT = 1 << 14
MODULUS = 10
U64 = np.uint64
END = U64(0x5DEECE66D1CE4E5B)
#: Numbers of what stands before and after a text.
START, PAD, WORD = 0, 1, 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % MODULUS == 0, F.lit(False))


def bundle(columns: list[np.ndarray]) -> bytes:
    """Whole numbers, compressed: their bytes by rank, so that what is zero in all costs nothing."""
    head, body = [], []
    for x in columns:
        x = np.ascontiguousarray(x, np.int64)
        width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
        head += [len(x), width]
        body.append(x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    return packed(np.array([len(columns), *head], np.int64).tobytes() + b"".join(body))


def unbundled(raw: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(unpacked(raw), np.uint8)
    n = int(raw[:8].view(np.int64)[0])
    head, at, out = raw[8 : 8 + 16 * n].view(np.int64).tolist(), 8 + 16 * n, []
    for size, width in zip(head[::2], head[1::2], strict=True):
        x = np.zeros((size, 8), np.uint8)
        x[:, :width] = raw[at : at + size * width].reshape(width, size).T
        out.append(x.view(np.int64).reshape(-1))
        at += size * width
    return out


def tokens(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each token, ends included, and the first token of each text (and the end)."""
    data, offsets = arrays.utf8(column)
    values, first = word_values(LOWER[data], offsets)
    return np.insert(values, first[1:], END), first + np.arange(len(first))


class Grams:
    """The pairs and triples of a block, in the order in which its buckets get them."""

    def __init__(self, values: np.ndarray, first: np.ndarray, known: pa.Table, buckets: int):
        """known: numbers and counts of the block's words."""
        words, which = np.unique(values, return_inverse=True)
        rows = sorted((b, w) for b, w in zip(known.column("bucket").to_pylist(), known.column("words").to_pylist(), strict=True))
        parts = [(b, *unbundled(w)) for b, w in rows]
        number = np.concatenate([rank * buckets + b + WORD for b, rank, _ in parts])
        count = np.concatenate([c for _, _, c in parts])
        assert len(number) == len(words), f"{len(number)} numbers for {len(words)} words"
        by = np.argsort(number)
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by)) + WORD
        ends = int(count[np.searchsorted(words, END)])
        #: By word of the block, in the order of the numbers.
        self.number, self.count = np.concatenate([[START, PAD], number[by]]), np.concatenate([[ends, 0], count[by]])
        size = np.diff(first)
        row = np.repeat(np.arange(len(size)), size)
        #: Of each token its word.
        self.word = place[which]
        text = np.zeros(len(values) + 3 * len(size), np.int64)
        text[np.arange(len(values)) + 3 * row + 2] = self.word
        close = first[1:] + 3 * np.arange(1, len(size) + 1) - 1
        text[close] = PAD
        whole = np.ones(len(text), bool)
        whole[close] = whole[close - 1] = False
        at = np.flatnonzero(whole)
        pairs, pair = np.unique((text[at] << 32) | text[at + 1], return_inverse=True)
        triples, triple = np.unique((pair << 32) | text[at + 2], return_inverse=True)
        self.first, self.second = pairs >> 32, pairs & 0xFFFFFFFF
        self.context, self.third = triples >> 32, triples & 0xFFFFFFFF
        #: Of each token the triple that ends in it and the pair, the row of each triple that is read.
        end = np.arange(len(values)) + row
        self.of_token, self.pair_of_token = triple[end], pair[end + 1]
        self.triple, self.row = triple, np.repeat(np.arange(len(size)), size + 1)
        seen = self.count[self.first]
        own, both = arrays.mix(self.number[self.first].astype(U64)), self.number[self.second].astype(U64)
        route = np.where((seen > SPLIT) | (self.first == START), arrays.mix(own ^ (both * U64(0x9E3779B97F4A7C15))), own)
        # a first word that was never trained begins nothing
        bucket = np.where(seen > 0, bucket_of(route, buckets), buckets)
        self.pair_order = np.argsort(bucket, kind="stable")
        self.triple_order = np.argsort(bucket[self.context], kind="stable")
        self.pair_edges = np.searchsorted(bucket[self.pair_order], np.arange(buckets + 1))
        self.triple_edges = np.searchsorted(bucket[self.context][self.triple_order], np.arange(buckets + 1))

    def packed(self, trained: np.ndarray) -> list[tuple[int, bytes]]:
        """For each bucket its pairs and triples, with counts in the trained rows."""
        counts = np.bincount(self.triple, weights=trained[self.row], minlength=len(self.third)).astype(np.int64)
        n = np.bincount(self.context, minlength=len(self.first))
        out = []
        for b in np.flatnonzero(np.diff(self.pair_edges)).tolist():
            p = self.pair_order[self.pair_edges[b] : self.pair_edges[b + 1]]
            t = self.triple_order[self.triple_edges[b] : self.triple_edges[b + 1]]
            head = np.flatnonzero(np.diff(self.first[p], prepend=-1))
            first = self.first[p[head]]
            out.append((b, bundle([self.number[first], np.diff(head, append=len(p)), self.count[first], self.number[self.second[p]], n[p], self.number[self.third[t]], counts[t]])))
        return out

    def codes(self, known: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all pairs, weights and triples from what the buckets have answered; 0 for what was not asked."""
        pairs, weights, triples = (np.zeros(n, np.uint8) for n in (len(self.first), len(self.first), len(self.third)))
        for b, raw in zip(known.column("bucket").to_pylist(), known.column("codes").to_pylist(), strict=True):
            p = self.pair_order[self.pair_edges[b] : self.pair_edges[b + 1]]
            t = self.triple_order[self.triple_edges[b] : self.triple_edges[b + 1]]
            own = np.frombuffer(unpacked(raw), np.uint8)
            pairs[p], weights[p], triples[t] = own[: len(p)], own[len(p) : 2 * len(p)], own[2 * len(p) :]
        return pairs, weights, triples


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first[:-1]) if len(first) > 1 else np.zeros(0)


class Sent:
    """What a bucket was sent by all blocks: its distinct words, pairs and triples, and of each block's which they are."""

    def __init__(self, t: pa.Table):
        own = [unbundled(x) for x in t.column("grams").to_pylist()]
        first, pairs, total, second, triples, third, count = (np.concatenate([x[k] for x in own]) for k in range(7))
        self.words, which = np.unique(np.concatenate([first, second, third]), return_inverse=True)
        n, size = len(first), len(self.words)
        parent = np.repeat(np.arange(n), pairs)
        key, self.pair = np.unique(which[:n][parent] * size + which[n : n + len(second)], return_inverse=True)
        self.first, self.second = key // size, key % size
        self.total = np.zeros(len(key), np.int64)
        self.total[self.pair] = total[parent]
        key, self.triple = np.unique(np.repeat(self.pair, triples) * size + which[n + len(second) :], return_inverse=True)
        self.context, self.third = key // size, key % size
        self.count = np.bincount(self.triple, weights=count, minlength=len(key)).astype(np.int64)
        self.pair_edges, self.triple_edges = np.cumsum([0, *[len(x[3]) for x in own]]), np.cumsum([0, *[len(x[5]) for x in own]])

    def levels(self) -> mmap.mmap:
        return Trie.levels(self.words, self.first, self.second, self.total, self.context, self.third, self.count, PRIORS)

    def answers(self) -> list[bytes]:
        """The codes of each block's pairs, weights and triples, in its order."""
        pairs, weights, triples = Trie(self.levels()).look_up(self.words, self.first, self.second, self.context, self.third)
        out = []
        for i in range(len(self.pair_edges) - 1):
            p, t = self.pair[self.pair_edges[i] : self.pair_edges[i + 1]], self.triple[self.triple_edges[i] : self.triple_edges[i + 1]]
            out.append(packed(pairs[p].tobytes() + weights[p].tobytes() + triples[t].tobytes()))
        return out


class Model:
    """The plan over some documents: `tries` of the training ones and `scores` of all."""

    def __init__(self, docs: DataFrame, held: Column, text: str = "text", key: str = "doc_id"):
        spark = docs.sparkSession
        size = docs.select(F.sum(F.octet_length(docs[f"`{text}`"].cast("string")).cast("long"))).first()[0] or 0
        n = max(1, -(-size // BLOCK))
        self.buckets = buckets = n
        self.parts = parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK))
        own = docs[f"`{text}`"].cast("string")
        self.kind = docs.schema[key].dataType.simpleString()
        keyed = docs.select(docs[f"`{key}`"].alias("key"), own.alias("text"), held.alias("held"), F.pmod(F.xxhash64(docs[f"`{key}`"], own), F.lit(n)).cast("int").alias("block"))
        self.blocks = keyed.repartition(parts, "block").groupBy("block")

        def name(t: pa.Table) -> pa.Table:
            arrays.release()
            values, first = tokens(t.column("text"))
            words, which = np.unique(values, return_inverse=True)
            trained = np.repeat(~t.column("held").to_numpy(), np.diff(first))
            counts = np.bincount(which, weights=trained, minlength=len(words)).astype(np.int64)
            edges = np.searchsorted(bucket_of(words, buckets), np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(edges)).tolist()
            lists = [bundle([(words[edges[b] : edges[b + 1]] >> U64(32)).view(np.int64), (words[edges[b] : edges[b + 1]] & U64(0xFFFFFFFF)).view(np.int64), counts[edges[b] : edges[b + 1]]]) for b in some]
            return pa.table([pa.array(some, pa.int32()), pa.array([t.column("block")[0].as_py()] * len(some), pa.int32()), pa.array(lists, pa.binary())], names=["bucket", "block", "words"])

        def count(t: pa.Table) -> pa.Table:
            """Numbers and counts of the words of each block; in the row without a block the sums."""
            arrays.release()
            own = [unbundled(w) for w in t.column("words").to_pylist()]
            hashes = np.concatenate([(x[0].view(U64) << U64(32)) | x[1].view(U64) for x in own])
            words, which = np.unique(hashes, return_inverse=True)
            total = np.bincount(which, weights=np.concatenate([x[2] for x in own]), minlength=len(words)).astype(np.int64)
            edges = np.cumsum([0, *[len(x[0]) for x in own]])
            lists = [bundle([which[i:j], total[which[i:j]]]) for i, j in zip(edges[:-1], edges[1:], strict=True)]
            blocks, bucket = t.column("block").to_pylist(), t.column("bucket")[0].as_py()
            none = [None] * len(lists)
            return pa.table(
                [pa.array([*blocks, None], pa.int32()), pa.array([bucket] * (len(lists) + 1), pa.int32()), pa.array([*lists, None], pa.binary()), pa.array([*none, int(total.sum())], pa.int64()), pa.array([*none, int((total > 0).sum())], pa.int64())],
                names=["block", "bucket", "words", "tokens", "kinds"],
            )

        named = self.blocks.applyInArrow(name, "bucket int, block int, words binary")
        counted = named.repartition(parts, "bucket").groupBy("bucket").applyInArrow(count, "block int, bucket int, words binary, tokens long, kinds long")
        self.totals = counted.where("block is null").agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds"))
        self.known = counted.where("block is not null").select("block", "bucket", "words")

        def send(t: pa.Table, known: pa.Table) -> pa.Table:
            arrays.release()
            values, first = tokens(t.column("text"))
            found = Grams(values, first, known, buckets).packed(~t.column("held").to_numpy())
            return pa.table([pa.array([b for b, _ in found], pa.int32()), pa.array([t.column("block")[0].as_py()] * len(found), pa.int32()), pa.array([x for _, x in found], pa.binary())], names=["bucket", "block", "grams"])

        sent = self.blocks.cogroup(self.known.repartition(parts, "block").groupBy("block")).applyInArrow(send, "bucket int, block int, grams binary")
        self.sent = sent.repartition(parts, "bucket").groupBy("bucket")

    def tries(self) -> DataFrame:
        """bucket, levels: the tries, each a block of bytes that `Trie` reads in place."""

        def run(t: pa.Table) -> pa.Table:
            arrays.release()
            return pa.table([t.column("bucket")[:1], pa.array([Sent(t).levels()[:]], pa.binary())], names=["bucket", "levels"])

        return self.sent.applyInArrow(run, "bucket int, levels binary")

    def scores(self) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
        buckets, parts = self.buckets, self.parts

        def answer(t: pa.Table) -> pa.Table:
            arrays.release()
            return pa.table([t.column("block"), t.column("bucket"), pa.array(Sent(t).answers(), pa.binary())], names=["block", "bucket", "codes"])

        def finish(t: pa.Table, known: pa.Table) -> pa.Table:
            arrays.release()
            values, first = tokens(t.column("text"))
            words = known.filter(pc.is_valid(known.column("words")))
            grams = Grams(values, first, words, buckets)
            pairs, weights, triples = grams.codes(known.filter(pc.is_valid(known.column("codes"))))
            n, kinds = words.column("tokens")[0].as_py(), words.column("kinds")[0].as_py()
            count = grams.count[grams.word]
            p = (count + 0.1) / (n + 0.1 * (kinds + 1))
            before = grams.count[grams.first[grams.pair_of_token]]
            low = VALUE[pairs[grams.pair_of_token]] + PRIORS[0] / (before + PRIORS[0]) * p
            code = weights[grams.context[grams.of_token]]
            score = VALUE[triples[grams.of_token]] + np.where(code > 0, VALUE[code], 1.0) * low
            size = np.diff(first)
            return pa.table(
                [t.column("key"), t.column("held"), pa.array(size), pa.array(sums((count > 0).astype(np.int64), first)), pa.array(np.full(len(size), n, np.int64)), pa.array(sums(np.log10(p), first)), pa.array(sums(np.log10(np.minimum(score, 1.0)), first))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

        answered = self.sent.applyInArrow(answer, "block int, bucket int, codes binary")
        total = lambda c: F.coalesce(self.totals.select(c).scalar(), F.lit(0).cast("long")).alias(c)
        both = self.known.select("block", "bucket", "words", total("tokens"), total("kinds")).unionByName(answered, allowMissingColumns=True)
        return self.blocks.cogroup(both.repartition(parts, "block").groupBy("block")).applyInArrow(finish, f"doc_id {self.kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs; rows that are held out are not learned from."""
    return Model(docs, held_out(docs[f"`{key}`"]), text, key).scores()
