"""Operator 8: document fingerprints by SpotSigs.

A signature is a common word (an anchor) and the two content words that follow
it. A text's signatures form a set; likeness is the Jaccard similarity of two
sets, pruned by their lengths: sets whose lengths have a ratio below a
threshold cannot reach it. `fingerprints` compares each document with its
edited text and with the next document; `near_duplicates` joins by likeness:
equal sets are one class, classes are partitioned by set length (only
neighbouring partitions can reach the threshold), and within a partition they
meet through their rarest signatures, as many as the threshold requires.

Scale: documents are dealt to ranges of doc_id (one exchange of texts) and
sorted; each range also gets the first document of the next, so neighbours
meet without a global sort. A task streams: it holds one batch.

Defined cases: a null or empty text has the empty set, likeness 1 to another
empty set and 0 to any other; a text with words but without signatures has one
signature of each word and its successor (the last word alone); documents are
ordered by doc_id (null last), rows that share it by text; a table of one
document is its own next; other columns are ignored; doc_ids are whole numbers,
others fail when they are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import arrays

U64 = np.uint64
LATEST = np.iinfo(np.int64).max
RANGE = 16 << 20
MAX_RANGES = 4096

# Common words of English, French, German and Spanish.
COMMON = (
    "a an and are as at be by for from had has have he her his i in is it its not of on or she that the their they this to was were which will with you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur ne nous on ou par pas pour que qui sa se ses son sur un une vous "
    "als am auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für im ist mit nach nicht noch sich sie sind so und von vor war wie wird zu zum zur "
    "al con del el ella en entre era es esta este fue ha la las lo los más no para pero por que se sin sobre su sus también un una y ya"
).split()

_SPACE = np.ones(256, bool)
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    _SPACE[ord(_a) : ord(_b) + 1] = False
_SPACE[0x80:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def word_keys(words: list[str]) -> np.ndarray:
    data, offsets = arrays.utf8(pa.array(words))
    return np.unique(arrays.span_hash(arrays.prefix(arrays.BYTE_VALUE[data]), offsets[:-1], offsets[1:]))


_common: np.ndarray | None = None


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All signatures, sorted and distinct for each text, and where each text's begin (and the end)."""
    global _common
    if _common is None:
        _common = word_keys(list(COMMON))
    data, offsets = arrays.utf8(texts)
    sets, size = [np.zeros(0, U64)], [np.zeros(1, np.int64)]
    for i, j in arrays.slices(offsets):
        part, at = _LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        n = j - i
        s, e = arrays.words(part, at, _SPACE)
        row = arrays.row_of(s, at)
        key = arrays.span_hash(arrays.prefix(arrays.BYTE_VALUE[part]), s, e)
        common = np.isin(key, _common)
        content = np.flatnonzero(~common)
        anchor = np.flatnonzero(common)
        first = np.searchsorted(content, anchor)
        ok = first + 1 < len(content)
        anchor, first = anchor[ok], first[ok]
        ok = row[content[first + 1]] == row[anchor] if len(anchor) else np.zeros(0, bool)
        anchor, first = anchor[ok], first[ok]
        sig = arrays.mix(arrays.mix(key[anchor] + U64(1)) + arrays.mix(key[content[first]] + U64(2)) * U64(3) + arrays.mix(key[content[first + 1]] + U64(3)) * U64(5))
        own = row[anchor]
        none = np.bincount(own, minlength=n) == 0
        rest = np.flatnonzero(none[row])
        if len(rest):
            after = np.minimum(rest + 1, len(row) - 1)
            inside = (rest + 1 < len(row)) & (row[after] == row[rest])
            pair = arrays.mix(key[rest] + U64(7)) + np.where(inside, arrays.mix(key[after] + U64(11)), U64(0))
            sig, own = np.concatenate([sig, arrays.mix(pair)]), np.concatenate([own, row[rest]])
        by = np.lexsort((sig, own))
        sig, own = sig[by], own[by]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])
        sets.append(sig[new])
        size.append(np.bincount(own[new], minlength=n))
    return np.concatenate(sets), np.cumsum(np.concatenate(size))


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 without comparing where their lengths alone rule out `least`."""
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)) or not len(a) or not len(b):
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(a) + len(b) - shared)


def printed(sigs: np.ndarray) -> str:
    """Length, the 8 least signatures (shortened) and a digest of all."""
    return f"{len(sigs)}:{''.join(f'{int(x) >> 32:08x}' for x in sigs[:8])}:{hashlib.blake2b(sigs.tobytes(), digest_size=8).hexdigest()}"


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many (or all) of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = docs.select(docs[key].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text")).withColumn("at", F.coalesce("doc_id", F.lit(LATEST)))
    size = rows.select(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = min(MAX_RANGES, max(1, -(-size // RANGE)))
    bounds = sorted({min(LATEST, int(x)) for x in rows.approxQuantile("at", [i / n for i in range(1, n)], 0.1 / n)}) if n > 1 else []
    place = F.size(F.filter(F.lit(bounds), lambda b: b <= F.col("at"))) if bounds else F.lit(0)
    rows = rows.withColumn("range", place)
    # the first document of each range: at most MAX_RANGES numbers
    firsts = sorted((r.range, r.first) for r in rows.groupBy("range").agg(F.min("at").alias("first")).collect())
    tail = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    if not firsts:
        return rows.sparkSession.createDataFrame([], schema)
    lent = F.create_map(*[F.lit(x) for pair in tail.items() for x in pair])
    both = F.when(F.col("at").isin(list(tail)), F.array(F.struct(F.col("range"), F.lit(False).alias("tail")), F.struct(lent[F.col("at")].alias("range"), F.lit(True).alias("tail")))).otherwise(F.array(F.struct(F.col("range"), F.lit(False).alias("tail"))))
    dealt = rows.select("doc_id", "at", "text", F.explode(both).alias("to")).select("to.range", "to.tail", "at", "text", "doc_id")

    def run(parts):
        held: pa.Table | None = None
        for b in parts:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows > 1:
                yield compare(held)
                held = held.slice(held.num_rows - 1)

    def compare(t: pa.Table):
        """All rows but the last, which begins the next batch; a range ends with the rows lent to it, of which the first counts."""
        texts = t.column("text").to_pylist()
        ranges, lent_rows = t.column("range").to_numpy(), t.column("tail").to_numpy(zero_copy_only=False)
        own = np.flatnonzero(~lent_rows[:-1])
        assert (ranges[own] == ranges[own + 1]).all(), "every range ends with a lent row"
        edits = [edited(texts[i], texts[i + 1]) for i in own.tolist()]
        a, at = signatures(t.column("text").combine_chunks())
        e, et = signatures(pa.array(edits, pa.string()))
        out = [[] for _ in range(6)]
        for k, i in enumerate(own.tolist()):
            x, y, z = a[at[i] : at[i + 1]], e[et[k] : et[k + 1]], a[at[i + 1] : at[i + 2]]
            for column, value in zip(out, (len(texts[i]), hashlib.sha256(edits[k].encode()).hexdigest(), printed(x), printed(y), likeness(x, y), likeness(x, z)), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.record_batch([t.column("doc_id").take(own).combine_chunks(), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names=names)

    return dealt.repartition("range").sortWithinPartitions("range", "tail", "at", "text").mapInArrow(run, schema)


def signature_sets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint, sigs of each row."""

    def run(parts):
        for b in parts:
            sets, at = signatures(b.column(1))
            prints = [printed(sets[at[i] : at[i + 1]]) for i in range(b.num_rows)]
            yield pa.record_batch([b.column(0), pa.array(prints, pa.string()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(sets.view(np.int64)))], names=["doc_id", "fingerprint", "sigs"])

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string, sigs array<long>")


def near_duplicates(docs: DataFrame, least: float = 0.8, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, class: the smallest doc_id with the same set) and links (a, b, likeness) between classes, a < b.

    No link is lost: two sets with a likeness of `least` share one of their
    n - ceil(least * n) + 1 rarest signatures, and lie in the same partition of
    set length or in neighbouring ones. Null doc_ids have classes only.
    """
    sets = signature_sets(docs, text, key)
    classes = sets.groupBy("fingerprint").agg(F.min("doc_id").alias("class"), F.any_value("sigs").alias("sigs"))
    members = sets.select("doc_id", "fingerprint").join(classes.select("fingerprint", "class"), "fingerprint").select("doc_id", "class")
    own = classes.where("class is not null and size(sigs) > 0").select("class", "sigs", F.size("sigs").alias("n"))
    each = own.select("class", "n", F.explode("sigs").alias("sig"))
    rarity = each.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = each.join(rarity, "sig").groupBy("class", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("s"))
    kept = F.slice("s", 1, (F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).cast("int"))
    part = F.floor(F.log(F.col("n").cast("double")) / -np.log(least) + 1e-9)
    probes = ranked.select("class", "n", part.alias("part"), F.explode(F.transform(kept, lambda x: x["sig"])).alias("sig"))
    home = probes.select(F.col("class").alias("a"), F.col("n").alias("na"), "part", "sig")
    visit = probes.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), "sig")
    fits = (F.col("a") != F.col("b")) & (F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9)
    found = home.join(visit, ["part", "sig"]).where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    x, y = own.select(F.col("class").alias("a"), F.col("sigs").alias("sa")), own.select(F.col("class").alias("b"), F.col("sigs").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    scored = found.join(x, "a").join(y, "b").select("a", "b", (shared / (F.size("sa") + F.size("sb") - shared)).alias("likeness"))
    return members, scored.where(F.col("likeness") >= least - 1e-9)


def linked(docs: DataFrame, least: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, class (see `near_duplicates`), n_links: with how many other classes a document's class is linked, for each row."""
    members, links = near_duplicates(docs, least, text, key)
    ends = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    return members.join(ends, "class", "left").select("doc_id", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"))
