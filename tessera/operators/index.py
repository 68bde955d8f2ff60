"""A written inverted index in segments: postings by term, read by searches in place of the texts."""

from __future__ import annotations

import posixpath
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import parse_query, stem_word
from tessera.operators.manifest import Manifest
from tessera.operators.search import idf_of, ranked, term_score, weighted

#: UTF-8 bytes of text whose postings make a file, on average, so that a task sorts them in memory; folders at most; texts that a worker turns to postings at once.
SHARE = 8 << 20
BUCKETS = 256
TEXTS = 256
#: Bytes of text that a worker turns to lists at once, if they are more than `TEXTS` texts.
PIECE = 4 << 20
#: Stems that a worker remembers.
KNOWN = 1 << 16
POSTING = "tag long, doc_len int, term string, tf int, positions array<int>"
#: Postings of a term in some texts as one row, in lists of small numbers: those of a salt (of a text itself: its file of items).
LISTS = "term string, counts binary, places binary, at int"
_stems: dict[str, str] = {}


def analyse(batches):
    """Postings of (key, tag, text): one row a text and distinct term, and one without a term for the text itself."""
    for b in batches:
        for i in range(0, b.num_rows, TEXTS):
            yield postings_of(b.slice(i, TEXTS))


def tokenized(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Tokens of each text; of every token its text, the number of its stem and its place; the stems by number."""
    if len(_stems) > KNOWN:
        _stems.clear()
    words, sizes = [], []
    for t in texts.to_pylist():
        own = re.findall(r"[^\W_]+", (t or "").lower())
        sizes.append(len(own))
        words += own
    each = pa.array(words, pa.string()).dictionary_encode()
    word = each.indices.to_numpy()
    stems = pa.array(map(stem_of, each.dictionary.to_pylist(), np.bincount(word, minlength=len(each.dictionary)).tolist()), pa.string()).dictionary_encode()
    size, code = np.array(sizes, np.int64), stems.indices.to_numpy()[word].astype(np.int64)
    doc = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    return size, doc, code, place, stems.dictionary


def stem_of(word: str, times: int) -> str:
    """A word's stem, remembered if some texts have the word twice: most words are rare and would only drive out the others."""
    stem = _stems.get(word)
    if stem is None:
        stem = stem_word(word)
        if times > 1:
            _stems[word] = stem
    return stem


def postings_of(b: pa.RecordBatch) -> pa.RecordBatch:
    size, doc, code, place, terms = tokenized(b.column(2))
    # by term, then text: rows of a term lie together, so the exchange packs them well
    group = code * max(1, len(size)) + doc
    order = np.argsort(group, kind="stable")
    new = np.flatnonzero(np.diff(group[order], prepend=-1))
    tf = np.diff(new, append=len(order))
    rows = np.concatenate([np.arange(len(size)), doc[order[new]]])
    none = pa.nulls(len(size), pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            b.column(0).take(pa.array(rows)),
            b.column(1).take(pa.array(rows)),
            pa.array(size[rows].astype(np.int32)),
            pa.concat_arrays([pa.nulls(len(size), pa.string()), terms.take(pa.array(code[order[new]]))]),
            pa.concat_arrays([none, pa.array(tf.astype(np.int32))]),
            pa.concat_arrays([pa.nulls(len(size), pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array(np.concatenate([new, [len(order)]]).astype(np.int32)), pa.array(place[order].astype(np.int32)))]),
        ],
        names=["key", "tag", "doc_len", "term", "tf", "positions"],
    )


def pack(batches):
    """What `analyse` gives, of (key, text, salt, item), in lists: one row for each distinct term and salt of some texts, and one without a term for each text."""
    for b in batches:
        ends, i = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy()), 0
        while i < b.num_rows:
            j = max(i + TEXTS, int(np.searchsorted(ends, ends[i] + PIECE)))
            yield lists_of(b.slice(i, j - i))
            i = j


def lists_of(b: pa.RecordBatch) -> pa.RecordBatch:
    size, doc, code, place, terms = tokenized(b.column(1))
    n, salt = len(size), b.column(2).to_numpy().astype(np.int64)
    cell = code * (salt.max(initial=0) + 1) + salt[doc]
    group = cell * max(1, n) + doc
    order = np.argsort(group, kind="stable")
    new = np.flatnonzero(np.diff(group[order], prepend=-1))
    first = np.flatnonzero(np.diff(cell[order[new]], prepend=-1))
    rows = np.concatenate([np.arange(n), doc[order[new]]])
    own, tf = order[new[first]], np.diff(new, append=len(order))
    each = np.concatenate([np.arange(n), n + first, [n + len(new)]])
    counts = np.stack([size[rows], np.concatenate([np.zeros(n, np.int64), tf])], axis=1)
    steps = np.diff(place[order], prepend=0)
    steps[new] = place[order[new]]
    return pa.RecordBatch.from_arrays(
        [
            pa.ListArray.from_arrays(pa.array(each.astype(np.int32)), b.column(0).take(pa.array(rows))),
            pa.concat_arrays([pa.nulls(n, pa.string()), terms.take(pa.array(code[own]))]),
            short(counts.ravel(), 2 * each),
            short(steps, np.concatenate([np.zeros(n, np.int64), new[first], [len(order)]])),
            pa.array(np.concatenate([b.column(3).to_numpy(), salt[doc[own]]]).astype(np.int32)),
        ],
        names=["keys", "term", "counts", "places", "at"],
    )


def short(x: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Numbers from zero up as bytes of seven bits each, the lowest first and all but a number's last marked; a value for each two edges."""
    size = np.ones(len(x), np.int64)
    for bits in (7, 14, 21, 28):
        size += x >= 1 << bits
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(ends[-1], np.uint8)
    for k in range(size.max(initial=0)):
        some = size > k
        out[ends[:-1][some] + k] = (x[some] >> 7 * k & 127) | np.where(size[some] > k + 1, 128, 0)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(ends[edges].astype(np.int32)), pa.py_buffer(out)])


def long_of(values: pa.Array) -> np.ndarray:
    """The numbers of all values of `short`, one after the other."""
    one = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), b"")
    flat = np.frombuffer(one[0].as_py(), np.uint8)
    ends = np.flatnonzero(flat < 128) + 1
    if not len(ends):
        return np.zeros(0, np.int64)
    begin = np.concatenate([[0], ends[:-1]])
    out, size = (flat[begin] & 127).astype(np.int64), ends - begin
    for k in range(1, size.max()):
        some = np.flatnonzero(size > k)
        out[some] += (flat[begin[some] + k] & 127).astype(np.int64) << 7 * k
    return out


def unpack(batches):
    """Rows of (key, tag, doc_len, term, tf, positions, bucket) from lists of them (keys, term, counts, places, bucket)."""
    for b in batches:
        keys, term, counts, places, bucket = b.columns
        which = pa.array(np.repeat(np.arange(b.num_rows), keys.value_lengths().to_numpy()))
        length, tf = long_of(counts).reshape(-1, 2).T
        item = tf == 0
        steps, edges = long_of(places), np.concatenate([[0], np.cumsum(tf)])
        total = np.concatenate([[0], np.cumsum(steps)])
        own = total[1:] - np.repeat(total[edges[:-1]], tf)
        lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(own.astype(np.int32)), mask=pa.array(item))
        yield pa.RecordBatch.from_arrays([keys.flatten(), pa.array(np.zeros(len(tf), np.int64)), pa.array(length.astype(np.int32)), term.take(which), pa.array(tf.astype(np.int32), mask=item), lists, bucket.take(which)], names=["key", "tag", "doc_len", "term", "tf", "positions", "bucket"])


class Index:
    """Segments of postings (term, key, tag, tf, doc_len, positions) in folders by a hash of the term, terms sorted within files, and a manifest.

    `tag` is a hash of the text: rows alike in key and text are one item, rows
    of one key with different texts are items of their own. In a segment whose
    keys are all different it is 0. A search reads the
    folders of its own terms (partition pruning) and of those the row groups
    that hold them; numbers of rows and tokens are in the manifest. Its cost
    follows the postings of its terms, not the corpus.

    Changes add a segment and tombstones: a segment's tombstones hide what
    earlier segments hold of their keys. `compact` merges all segments into one
    from their postings, without the texts. Each step ends with a manifest under
    the next number, so readers see the state before it or after it, and of two
    writers one fails.

    Folders and files follow the size of the texts: a frequent term's postings
    are dealt over all files of its folder by key.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.spark, self.path, self.key = spark, path, key
        self.manifest = Manifest(spark, path)
        self._state: dict | None = None

    @classmethod
    def build(cls, docs: DataFrame, key: str, text: str | Column, path: str, source: str | None = None) -> Index:
        """A new index of all rows, in place of what the folder has. source: the state of the table that the rows are from (`manifest.source_state`). Texts are read twice (their size, their tokens) and not shuffled; one exchange, of postings by bucket."""
        own = cls(docs.sparkSession, path, key)
        before = own.manifest.read()
        segment, n, tokens = own.segment(prepared(docs, key, text))
        own._state = own.manifest.write({"segments": [segment], "n": n, "tokens": tokens, "source": source, "type": docs.schema[key].dataType.simpleString(), "batches": {}}, before and before["version"])
        own.vacuum()
        return own

    @property
    def state(self) -> dict:
        if self._state is None:
            self._state = self.manifest.read()
            if self._state is None:
                raise FileNotFoundError(f"no index in {self.path}")
        return self._state

    def exists(self) -> bool:
        return self.manifest.read() is not None

    def segment(self, rows: DataFrame) -> tuple[dict, int, int]:
        """Write (key, tag, text) as a segment: its entry in the manifest, its items and tokens."""
        each = rows.groupBy("key").agg(F.sum(F.octet_length("text").cast("long")).alias("size"), F.count("*").alias("n"))
        size, most = each.agg(F.sum("size"), F.max("n")).first()
        kind = rows.schema["key"].dataType.simpleString()
        if (most or 0) > 1:
            return self.write(rows.select("key", "tag", "text").mapInArrow(analyse, f"key {kind}, {POSTING}"), size or 0, True)
        # where no key is repeated no row can be, and nothing has to tell rows of a key apart: a term's postings move in lists
        entry, salts = self.layout(size or 0)
        of = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
        lists = rows.select("key", "text", of(salts).alias("salt"), of(entry["items"]).alias("item")).mapInArrow(pack, f"keys array<{kind}>, {LISTS}")
        lists = lists.withColumn("bucket", F.when(F.col("term").isNull(), -1 - F.col("at")).otherwise(F.pmod(F.xxhash64("term"), F.lit(entry["buckets"]))).cast("int"))
        place = F.when(F.col("bucket") < 0, entry["buckets"] * salts + F.col("at")).otherwise(F.col("bucket") * salts + F.col("at"))
        # a file's lists are few beside its postings, which then come out in their order or nearly
        dealt = lists.repartitionById(entry["buckets"] * salts + entry["items"], place.cast("int")).select("keys", "term", "counts", "places", "bucket").sortWithinPartitions("term", F.get("keys", F.lit(0)))
        return self.store(dealt.mapInArrow(unpack, f"key {kind}, {POSTING}, bucket int"), entry, kind)

    def layout(self, size: int) -> tuple[dict, int]:
        """A segment's entry, and the files of each folder of terms."""
        files = -(-size // SHARE) or 1
        buckets = min(BUCKETS, max(8, files))
        return {"id": uuid.uuid4().hex, "buckets": buckets, "items": -(-files // 64), "size": size}, -(-files // buckets)

    def write(self, postings: DataFrame, size: int, repeats: bool) -> tuple[dict, int, int]:
        entry, salts = self.layout(size)
        buckets, items = entry["buckets"], entry["items"]
        bucket = F.when(F.col("term").isNull(), -1 - F.pmod(F.xxhash64("key"), F.lit(items))).otherwise(F.pmod(F.xxhash64("term"), F.lit(buckets)))
        # one task a file: of a folder's terms, the keys of one salt; then the files of items
        place = F.when(F.col("bucket") < 0, F.lit(buckets * salts - 1) - F.col("bucket")).otherwise(F.col("bucket") * salts + F.pmod(F.xxhash64("key"), F.lit(salts)))
        dealt = postings.withColumn("bucket", bucket.cast("int")).withColumn("place", place.cast("int")).repartitionById(buckets * salts + items, "place")
        if repeats:
            dealt = dealt.groupBy("place", "bucket", "term", "key", "tag").agg(*[F.first(c).alias(c) for c in ("doc_len", "tf", "positions")])
        return self.store(dealt, entry, postings.schema["key"].dataType.simpleString())

    def store(self, dealt: DataFrame, entry: dict, kind: str) -> tuple[dict, int, int]:
        once = dealt.sortWithinPartitions("bucket", "term", "key").select("key", "tag", "doc_len", "term", "tf", "positions", "bucket")
        once.write.partitionBy("bucket").option("compression", "zstd").parquet(posixpath.join(self.folder(entry), "postings"))
        n, tokens = self.read(entry, kind).where("bucket < 0").agg(F.count("*"), F.sum(F.col("doc_len").cast("long"))).first()
        return entry, n, tokens or 0

    def folder(self, segment: dict) -> str:
        return posixpath.join(self.path, "segments", segment["id"])

    def read(self, segment: dict, kind: str) -> DataFrame:
        return self.spark.read.schema(f"key {kind}, {POSTING}, bucket int").parquet(posixpath.join(self.folder(segment), "postings"))

    def gone(self, segments: list[dict]) -> DataFrame | None:
        """key, until: keys whose rows before a segment are hidden."""
        out = None
        for at, s in enumerate(segments):
            if s.get("gone"):
                one = self.spark.read.schema(f"key {self.state['type']}").parquet(posixpath.join(self.folder(s), "gone")).withColumn("until", F.lit(at))
                out = one if out is None else out.unionByName(one)
        return out if out is None else out.groupBy("key").agg(F.max("until").alias("until"))

    def live(self, part) -> DataFrame:
        """Rows of all segments that no tombstone hides. part(rows of a segment, its entry): those that are wanted."""
        segments, out = self.state["segments"], None
        for at, s in enumerate(segments):
            one = part(self.read(s, self.state["type"]), s).withColumn("at", F.lit(at))
            out = one if out is None else out.unionByName(one)
        gone = self.gone(segments)
        if gone is None:
            return out.drop("at")
        hidden = gone.withColumnRenamed("key", "_key")
        return out.join(hidden, F.col("key").eqNullSafe(F.col("_key")) & (F.col("at") < F.col("until")), "left_anti").drop("at")

    def postings(self) -> DataFrame:
        return self.live(lambda rows, _: rows.where("bucket >= 0")).drop("bucket")

    def items(self) -> DataFrame:
        """key, tag, doc_len of each item."""
        return self.live(lambda rows, _: rows.where("bucket < 0")).select("key", "tag", "doc_len")

    def terms(self) -> DataFrame:
        """term, df, cf."""
        return self.postings().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))

    def of(self, words: list[str]) -> DataFrame:
        """The postings of some terms."""

        def part(rows: DataFrame, s: dict) -> DataFrame:
            # folded to numbers when the plan is made, so other folders are not listed
            places = [F.pmod(F.xxhash64(F.lit(w)), F.lit(s["buckets"])).cast("int") for w in words]
            return rows.where(F.col("bucket").isin(*places) & F.col("term").isin(words))

        return self.live(part).drop("bucket")

    def status(self, table: DataFrame | None = None, source: str | None = None) -> DataFrame:
        """n_indexed, tokens, segments, version; of a table also n_rows and whether the index is stale: made from another state of it, or, where that is unknown, with a gap over a tenth."""
        s = self.state
        one = self.spark.createDataFrame([(s["n"], s["tokens"], len(s["segments"]), s["version"])], "n_indexed long, tokens long, segments int, version int")
        if table is None:
            return one
        known = source is not None and s.get("source") is not None
        stale = F.lit(known and source != s["source"]) if known else F.abs(F.col("n_rows") - F.col("n_indexed")) > 0.1 * F.col("n_rows")
        return one.withColumn("n_rows", table.agg(F.count("*").alias("n")).scalar()).withColumn("stale", stale)

    def apply(self, changes: DataFrame, text: str | Column = "text", op: str = "op", batch: tuple[str, int] | None = None, source: str | None = None) -> Index:
        """Add a segment: the batch's keys lose their earlier rows and get those of the batch whose `op` is not 'delete'.

        batch: a stream's name and number; a number that was already applied
        changes nothing, so a batch that is repeated counts once. A batch that
        failed before its manifest leaves nothing but files that `vacuum` deletes.
        """
        old = self.manifest.read()
        if old is None:
            raise FileNotFoundError(f"no index in {self.path}")
        self._state = old
        if batch and old["batches"].get(batch[0], -1) >= batch[1]:
            return self
        rows = prepared(changes, self.key, text, op)
        rows = rows.withColumn("key", F.col("key").cast(old["type"]))
        segment, n, tokens = self.segment(rows.where(~F.col("op").eqNullSafe(F.lit("delete"))))
        keys = posixpath.join(self.folder(segment), "gone")
        rows.select("key").distinct().write.parquet(keys)
        hidden = self.spark.read.schema(f"key {old['type']}").parquet(keys).withColumnRenamed("key", "_key")
        lost = self.items().join(hidden, F.col("key").eqNullSafe(F.col("_key")), "left_semi").agg(F.count("*"), F.sum(F.col("doc_len").cast("long"))).first()
        new = old | {"segments": [*old["segments"], segment | {"gone": True}], "n": old["n"] + n - lost[0], "tokens": old["tokens"] + tokens - (lost[1] or 0), "source": source}
        if batch:
            new["batches"] = old["batches"] | {batch[0]: batch[1]}
        new.pop("version")
        self._state = self.manifest.write(new, old["version"])
        return self

    def compact(self) -> Index:
        """Merge all segments into one, from their postings."""
        self._state = old = self.manifest.read()
        segment, n, tokens = self.write(self.live(lambda rows, _: rows).drop("bucket"), sum(s["size"] for s in old["segments"]), False)
        new = old | {"segments": [segment], "n": n, "tokens": tokens}
        new.pop("version")
        self._state = self.manifest.write(new, old["version"])
        return self

    def vacuum(self) -> None:
        """Delete what the newest manifest does not name. Searches that read older versions fail then."""
        self._state = self.manifest.read()
        self.manifest.keep([s["id"] for s in self.state["segments"]], "segments")

    def scored(self, query: str, phrase: bool = False) -> DataFrame:
        """key, score of each item that satisfies the query (see `search.bm25`)."""
        parsed = phrase_of(query) if phrase else parse_query(query, stem_word)
        positive = sorted({w for a in parsed for s, own in a if not s for w in own})
        every = sorted({w for a in parsed for _, own in a for w in own})
        own = self.of(every)
        n, tokens = self.state["n"], self.state["tokens"]
        # as many rows as the query has terms
        counts = own.groupBy("term").agg(F.count("*").alias("df")).agg(F.map_from_entries(F.collect_list(F.struct("term", "df")))).scalar()
        # a number a term leaves the folders; places only of words that stand in phrases
        phrased = sorted({w for a in parsed for _, own in a if len(own) > 1 for w in own})
        tf = {w: f"tf_{i}" for i, w in enumerate(every)}
        at = {w: f"at_{i}" for i, w in enumerate(phrased)}
        of = lambda w, c: F.when(F.col("term") == F.lit(w), F.col(c))
        rows = own.groupBy("key", "tag").agg(F.max("doc_len").alias("doc_len"), *[F.max(of(w, "tf")).alias(c) for w, c in tf.items()], *[F.max(of(w, "positions")).alias(c) for w, c in at.items()])
        rows = rows.where(satisfied(parsed, tf, at)).withColumn("df", counts)
        score = F.lit(0.0)
        for w in positive:
            score = score + term_score(idf_of(F.lit(n), F.coalesce(F.try_element_at("df", F.lit(w)), F.lit(0))), F.coalesce(tf[w], F.lit(0)), F.col("doc_len"), F.lit(tokens / max(1, n)))
        return rows.select(F.col("key").alias(self.key), score.alias("score"))

    def search(self, query: str, limit: int = 20, phrase: bool = False, quality: DataFrame | None = None) -> DataFrame:
        """key, score, rank. quality: (key, quality), weighting results before they are ranked."""
        return ranked(weighted(self.scored(query, phrase), self.key, quality), self.key, "score", limit)


def prepared(docs: DataFrame, key: str, text: str | Column, op: str | None = None) -> DataFrame:
    """key, tag, text (and op) of some rows."""
    own = F.coalesce((text if isinstance(text, Column) else F.col(f"`{text}`")).cast("string"), F.lit(""))
    more = [F.col(f"`{op}`").alias("op")] if op else []
    return docs.select(F.col(f"`{key}`").alias("key"), own.alias("text"), *more).withColumn("tag", F.xxhash64("text"))


def phrase_of(query: str) -> list[list[tuple[str, list[str]]]]:
    """A text as one phrase, cut into words as texts are."""
    words = [stem_word(w) for w in re.findall(r"[^\W_]+", query.lower())]
    if not words:
        raise ValueError("the query has no words")
    return [[("", words)]]


def satisfied(parsed: list[list[tuple[str, list[str]]]], tf: dict[str, str], at: dict[str, str]) -> Column:
    """Do a row's columns of counts and of places, by word, satisfy the query? Phrases by places."""

    def has(words: list[str]) -> Column:
        every = all_of([F.col(tf[w]).isNotNull() for w in words])
        if len(words) == 1:
            return every
        follows = lambda p: [F.array_contains(at[w], p + i) for i, w in enumerate(words) if i]
        return every & F.coalesce(F.exists(at[words[0]], lambda p: all_of(follows(p))), F.lit(False))

    return any_of([all_of([~has(w) if sign else has(w) for sign, w in a]) for a in parsed])


def all_of(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def any_of(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out
