"""Operator 10: BPE encoding and decoding through a distinct-word table.

1. Documents are dealt to blocks by a hash of doc_id and text (one exchange of
   texts, used twice); a block splits its texts into words and sends each
   distinct one to a bucket of the word table, chosen by the word's hash.
2. A bucket encodes each distinct word of the corpus once and returns to every
   block the ids of its words.
3. A block joins ids back by the words' positions; the ids of a text are
   decoded through the id-to-piece table (as large as the vocabulary, so every
   worker has it whole).

Scale: besides the texts only the distinct words of each block move (words
packed by bucket), about a tenth of the texts; blocks and buckets grow in
number, not in size. Words are matched by 64 hash bits inside a block and
letter by letter in a bucket.

Defined cases: a null or empty text has no ids and decodes to ''; special
strings inside texts are matched before anything else and give their own id;
repeated rows each give a row; null doc_ids stay; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import arrays
from tessera.llm.bpe import Bpe, Pieces, batches, lower, pieces

#: UTF-8 bytes of text in a block; blocks in a task, and to a bucket, on average.
BLOCK = 12 << 20
TASK = 2
U64 = np.uint64
_models: dict[str, tuple[Bpe, re.Pattern]] = {}


def model(path: str) -> tuple[Bpe, re.Pattern]:
    """The tokenizer and the pattern of its special strings, read once a process."""
    if path not in _models:
        bpe = Bpe(path)
        names = sorted(bpe.special, key=len, reverse=True)
        _models[path] = bpe, re.compile("(" + "|".join(map(re.escape, names)) + ")" if names else r"(?!)")
    return _models[path]


def parts_of(texts: list[str | None], path: str) -> tuple[list[str], list[int], dict[int, int]]:
    """Texts cut at special strings: the parts, the text of each, and the id of those that are special."""
    bpe, special = model(path)
    parts, rows, fixed = [], [], {}
    for k, t in enumerate(texts):
        if not t:
            continue
        for p in special.split(t) if "<" in t else (t,):
            if p in bpe.special:
                fixed[len(parts)] = bpe.special[p]
                parts.append("")
            else:
                parts.append(lower(p))
            rows.append(k)
    return parts, rows, fixed


def split(parts: list[str]) -> Iterator[tuple[int, int, Pieces]]:
    for i, j in batches(parts):
        yield i, j, pieces(parts[i:j], False)


def distinct(parts: list[str]) -> dict[int, str]:
    """The distinct words of some texts by their hash, ascending."""
    found: dict[int, str] = {}
    for _, _, own in split(parts):
        for i, k in enumerate(own.keys.tolist()):
            if k not in found:
                found[k] = own.word(i)
    return dict(sorted(found.items()))


def packed(raw: bytes) -> bytes:
    """Compressed; the size comes first."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)


def encoded(words: list[str], bpe: Bpe) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each word has, and all ids; as short numbers as the vocabulary allows."""
    ids = [bpe.encode(w.encode()) for w in words]
    return np.array([len(x) for x in ids], np.uint32), np.array([i for x in ids for i in x], np.min_scalar_type(len(bpe.pieces)))


def texts_to_ids(texts: list[str | None], path: str, count: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
    """The ids of each text: those of each word at the word's positions. count, ids: of the distinct words of the texts, ascending by hash."""
    parts, rows, fixed = parts_of(texts, path)
    cuts = list(split(parts))
    keys = np.unique(np.concatenate([np.zeros(0, U64), *[own.keys for _, _, own in cuts]]))
    assert len(keys) == len(count), f"{len(count)} entries for {len(keys)} words"
    begin = np.cumsum(count, dtype=np.int64) - count
    rows, special = np.array(rows, np.int64), np.array(sorted(fixed), np.int64)
    single = np.array([fixed[k] for k in special.tolist()], ids.dtype)
    runs: list[list[np.ndarray]] = [[] for _ in texts]
    for i, j, own in cuts:
        word = np.searchsorted(keys, own.keys)[own.which]
        size = count[word].astype(np.int64)
        flat = ids[np.repeat(begin[word] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
        owner = np.repeat(own.part + i, size)
        inside = special[(special >= i) & (special < j)]
        if len(inside):
            place = np.searchsorted(owner, inside)
            flat = np.insert(flat, place, single[np.searchsorted(special, inside)])
            owner = np.insert(owner, place, inside)
        text = rows[owner]
        edges = np.flatnonzero(np.diff(text, prepend=-1, append=-1))
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            runs[text[s]].append(flat[s:e])
    return [np.concatenate(x) if len(x) > 1 else x[0] if x else np.zeros(0, ids.dtype) for x in runs]


def coded(docs: DataFrame, path: str, finish, schema: str, text: str, key: str) -> DataFrame:
    """finish(doc_ids, ids of each text, pieces by id) gives the Arrow table of a block."""
    size = docs.select(F.sum(F.octet_length(docs[text].cast("string")).cast("long"))).first()[0] or 0
    n = max(1, -(-size // BLOCK))
    buckets = parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK))
    own = docs[text].cast("string")
    keyed = docs.select(docs[key].alias("doc_id"), own.alias("text"), F.pmod(F.xxhash64(docs[key], own), F.lit(n)).cast("int").alias("block"))

    def send(t: pa.Table) -> pa.Table:
        arrays.release()
        words = distinct(parts_of(t.column("text").to_pylist(), path)[0])
        keys, every = np.fromiter(words, U64, len(words)), list(words.values())
        edges = np.searchsorted((keys >> U64(32)) * U64(buckets) >> U64(32), np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(edges)).tolist()
        # a word has no white space, so a line keeps each apart
        lists = [packed("\n".join(every[edges[p] : edges[p + 1]]).encode()) for p in some]
        return pa.table([pa.array(some, pa.int32()), pa.array([t.column("block")[0].as_py()] * len(some), pa.int32()), pa.array(lists, pa.binary())], names=["bucket", "block", "words"])

    def look_up(t: pa.Table) -> pa.Table:
        bpe, _ = model(path)
        lists = [unpacked(x).decode().split("\n") for x in t.column("words").to_pylist()]
        place: dict[str, int] = {}
        which = [[place.setdefault(w, len(place)) for w in x] for x in lists]
        count, ids = encoded(list(place), bpe)
        end = np.cumsum(count, dtype=np.int64)
        begin, out = end - count, []
        for x in which:
            at = np.array(x)
            size = count[at].astype(np.int64)
            own = ids[np.repeat(begin[at] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
            out.append((packed(count[at].tobytes()), packed(own.tobytes())))
        return pa.table([t.column("block"), t.column("bucket"), pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], names=["block", "bucket", "counts", "ids"])

    def join(t: pa.Table, known: pa.Table) -> pa.Table:
        arrays.release()
        known = known.sort_by("bucket")
        names = model(path)[0].pieces
        raw = lambda c: b"".join(map(unpacked, known.column(c).to_pylist()))
        count, ids = np.frombuffer(raw("counts"), np.uint32), np.frombuffer(raw("ids"), np.min_scalar_type(len(names)))
        return finish(t.column("doc_id"), texts_to_ids(t.column("text").to_pylist(), path, count, ids), names)

    blocks = keyed.repartition(parts, "block").groupBy("block")
    table = blocks.applyInArrow(send, "bucket int, block int, words binary").repartition(parts, "bucket").groupBy("bucket")
    known = table.applyInArrow(look_up, "block int, bucket int, counts binary, ids binary").repartition(parts, "block").groupBy("block")
    return blocks.cogroup(known).applyInArrow(join, schema)


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, ids array<int>, decoded string for each row of docs."""

    def finish(keys: pa.ChunkedArray, ids: list[np.ndarray], names: list[str]) -> pa.Table:
        decoded = [" ".join([names[i] for i in x.tolist()]) for x in ids]
        return pa.table([keys, pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return coded(docs, path, finish, f"doc_id {docs.schema[key].dataType.simpleString()}, ids array<int>, decoded string", text, key)


def decode(encoded: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """doc_id, decoded: the pieces of the ids, joined by spaces. The id-to-piece table has one row an id of the vocabulary, so it is broadcast."""
    spark = encoded.sparkSession
    pieces = spark.createDataFrame(list(enumerate(Bpe(path).pieces)), "id int, piece string")
    rows = encoded.select(encoded[key].alias("doc_id"), F.monotonically_increasing_id().alias("row"), encoded[ids].alias("ids"))
    each = rows.select("doc_id", "row", F.posexplode_outer("ids").alias("pos", "id")).join(F.broadcast(pieces), "id", "left")
    return each.groupBy("row", "doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), " ").alias("decoded")).drop("row")


def digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: `encode` and the decoding, with digests made beside the texts so that neither travels."""

    def finish(keys: pa.ChunkedArray, ids: list[np.ndarray], names: list[str]) -> pa.Table:
        first = [hashlib.sha256(x.astype("<u4")).hexdigest() for x in ids]
        second = [hashlib.sha256(" ".join([names[i] for i in x.tolist()]).encode()).hexdigest() for x in ids]
        return pa.table([keys, pa.array([len(x) for x in ids], pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return coded(docs, path, finish, f"doc_id {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", text, key)
