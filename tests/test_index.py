"""The written index: odd tables, changes, compaction, replay, staleness."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import index, search
from tessera.operators.index import Index
from tessera.operators.manifest import source_state
from tessera.streaming import events as streaming

WORDS = "alpha beta gamma delta running runs the of U.S. law state-of-the-art école".split()


def frame(spark, rows, schema="id long, text string"):
    return spark.createDataFrame(rows, schema)


def texts(seed, n):
    r = random.Random(seed)
    return [(i, " ".join(r.choices(WORDS, k=r.randint(0, 12)))) for i in range(n)]


def same(own, docs, queries=("alpha OR the", "runs AND law", '"of the" OR beta', "gamma NOT delta", "ecole")):
    """An index and a scan of the table say the same."""
    plain = docs.where("text is not null or id is not null")
    for q in queries:
        a = sorted((x.id, round(x.score, 9)) for x in own.scored(q).collect())
        b = sorted((x.id, round(x.score, 9)) for x in search.bm25(search.analyzed(plain, "id", "text"), "id", q).collect())
        assert a == b, q


def test_repeated_keys_are_items_of_their_own(spark, tmp_path):
    docs = frame(spark, [(1, "a dog"), (1, "a dog and a cat"), (2, "dog dog"), (3, None), (None, "a dog without id"), (1, "a dog")])
    own = Index.build(docs, "id", "text", str(tmp_path / "i"))
    assert own.state["n"] == 5
    assert sorted((x.id or 0, round(x.score, 6)) for x in own.scored("dog").collect()) == sorted((x.id or 0, round(x.score, 6)) for x in search.bm25(search.analyzed(docs.distinct(), "id", "text"), "id", "dog").collect())
    assert [x.id for x in own.scored("cat").collect()] == [1]
    assert own.terms().where("term = 'dog'").select("df", "cf").first() == (4, 5)


def test_empty_tables(spark, tmp_path):
    own = Index.build(frame(spark, []), "id", "text", str(tmp_path / "i"))
    assert own.search("dog").collect() == [] and own.terms().count() == 0 and own.items().count() == 0
    assert own.status(frame(spark, [])).select("n_rows", "n_indexed", "stale").first() == (0, 0, False)
    own.apply(frame(spark, [(1, "a dog", "upsert")], "id long, text string, op string"))
    assert [x.id for x in own.search("dog").collect()] == [1]
    own.apply(frame(spark, [(1, None, "delete")], "id long, text string, op string")).compact()
    assert own.search("dog").collect() == [] and own.state["n"] == own.state["tokens"] == 0


@pytest.mark.parametrize("phrase", ["U.S. law", "state-of-the-art", '"quoted" words', "école RUNS"])
def test_phrases_are_cut_like_texts(spark, tmp_path, phrase):
    docs = frame(spark, [(1, f"what {phrase} says"), (2, "s u law art the of state"), (3, phrase.upper()), (4, "words quoted, law U S runs ecole")])
    own = Index.build(docs, "id", "text", str(tmp_path / "i"))
    assert sorted(x.id for x in own.search(phrase, phrase=True).collect()) == [1, 3]
    assert sorted(x.id for x in search.search(docs, "id", "text", phrase, phrase=True).collect()) == [1, 3]
    for nothing in ("", "?!"):
        with pytest.raises(ValueError):
            own.scored(nothing, phrase=True)


def test_changes_equal_a_new_index(spark, tmp_path):
    state = dict(texts(1, 60))
    own = Index.build(frame(spark, list(state.items())), "id", "text", str(tmp_path / "i"))
    r = random.Random(2)
    for k in range(4):
        batch = {i: (t, "upsert") for i, t in texts(10 + k, 80) if r.random() < 0.3} | {r.randrange(80): (None, "delete") for _ in range(6)}
        own.apply(frame(spark, [(i, t, op) for i, (t, op) in batch.items()], "id long, text string, op string"), batch=("s", k))
        for i, (t, op) in batch.items():
            state.pop(i, None)
            if op != "delete":
                state[i] = t
        now = frame(spark, list(state.items()))
        same(own, now)
        assert own.state["n"] == len(state) == own.items().count()
        assert own.state["tokens"] == own.items().agg(F.sum("doc_len")).first()[0]
    before = sorted(map(tuple, own.postings().select("term", "key", "tf", "positions").collect()))
    assert len(own.state["segments"]) == 5
    own.compact()
    assert len(own.state["segments"]) == 1 and before == sorted(map(tuple, own.postings().select("term", "key", "tf", "positions").collect()))
    same(Index(spark, own.path, "id"), now)
    own.vacuum()
    same(Index(spark, own.path, "id"), now)


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    own = Index.build(frame(spark, texts(3, 20)), "id", "text", str(tmp_path / "i"))
    one = frame(spark, [(1, "alpha beta", "upsert"), (1, "alpha", "upsert"), (2, None, "delete")], "id long, text string, op string")
    own.apply(one, batch=("s", 7))
    state, rows = own.state, sorted(map(tuple, own.scored("alpha").collect()))
    again = Index(spark, own.path, "id").apply(one, batch=("s", 7)).apply(one, batch=("s", 3))
    assert again.state == state and sorted(map(tuple, again.scored("alpha").collect())) == rows
    # another stream's batches are counted apart
    assert own.apply(one, batch=("t", 7)).state["version"] == state["version"] + 1


def test_of_two_writers_one_fails(spark, tmp_path):
    a = Index.build(frame(spark, texts(4, 10)), "id", "text", str(tmp_path / "i"))
    value = a.manifest.read()
    version = value.pop("version")
    a.manifest.write(value, version)
    with pytest.raises(RuntimeError, match="someone else"):
        a.manifest.write(value, version)
    same(Index(spark, a.path, "id"), frame(spark, texts(4, 10)))


def test_a_failed_batch_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    docs = frame(spark, texts(5, 20))
    own = Index.build(docs, "id", "text", str(tmp_path / "i"))
    one = frame(spark, [(1, "alpha beta", "upsert")], "id long, text string, op string")
    with monkeypatch.context() as m:
        m.setattr(type(own.manifest), "write", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            own.apply(one, batch=("s", 0))
    fresh = Index(spark, own.path, "id")
    same(fresh, docs)
    fresh.apply(one, batch=("s", 0)).vacuum()
    assert len(list((tmp_path / "i" / "segments").iterdir())) == 2


def test_a_stream_keeps_an_index(spark, tmp_path):
    """Adds, changes and deletes in several batches; the whole stream is then run once more."""
    steps = [[(i, t, "upsert") for i, t in texts(6, 30)], [(i, t, "upsert") for i, t in texts(7, 10)] + [(i, None, "delete") for i in range(20, 25)], [(22, "alpha again", "upsert"), (3, None, "delete")]]
    state = {}
    for k, rows in enumerate(steps):
        frame(spark, rows, "id long, text string, op string").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
        for i, t, op in rows:
            state.pop(i, None)
            if op == "upsert":
                state[i] = t
    path = str(tmp_path / "i")

    def run(checkpoint):
        stream = spark.readStream.schema("id long, text string, op string").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in" / "*"))
        q = stream.writeStream.foreachBatch(streaming.index_sink(path, "id", "text", "op", merge=2)).option("checkpointLocation", checkpoint).start()
        q.processAllAvailable()
        q.stop()

    run(str(tmp_path / "a"))
    own = Index(spark, path, "id")
    same(own, frame(spark, list(state.items())))
    version = own.state["version"]
    run(str(tmp_path / "b"))
    assert Index(spark, path, "id").state["version"] == version


def test_staleness_is_of_the_table(spark, tmp_path):
    from tessera.plans.search import shared_index

    folder = str(tmp_path / "t")
    rows = [(i, t) for i, t in texts(8, 40)]
    frame(spark, rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    a = shared_index(spark, folder)
    assert shared_index(spark, folder).state["version"] == a.state["version"]
    frame(spark, [(100, "zeta alpha")], "doc_id long, text string").write.mode("append").parquet(f"{folder}/documents.parquet")
    table = spark.read.parquet(f"{folder}/documents.parquet")
    assert a.status(table, source_state(spark, f"{folder}/documents.parquet")).first().stale and not a.status(table).first().stale
    b = shared_index(spark, folder)
    assert [x.doc_id for x in b.search("zeta").collect()] == [100] and not b.status(table, source_state(spark, f"{folder}/documents.parquet")).first().stale


def test_folders_and_files_follow_the_corpus(spark, tmp_path, monkeypatch):
    from tessera.operators import index

    monkeypatch.setattr(index, "SHARE", 200)
    monkeypatch.setattr(index, "BUCKETS", 4)
    docs = frame(spark, texts(9, 200))
    own = Index.build(docs, "id", "text", str(tmp_path / "i"))
    same(own, docs)
    entry = own.state["segments"][0]
    assert entry["buckets"] == 8 or entry["buckets"] == 4
    files = own.postings().select(F.input_file_name().alias("f"), "term").where("term = 'the'").select("f").distinct().count()
    assert files > 5  # a frequent term lies in many files
    plan = own.of(["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_a_task_sorts_one_file_and_only_phrases_read_places(spark, tmp_path, monkeypatch):
    from tessera.operators import index

    monkeypatch.setattr(index, "SHARE", 200)
    docs = frame(spark, texts(10, 100))
    own = Index.build(docs, "id", "text", str(tmp_path / "i"))
    same(own, docs, ("alpha OR the", '"of the" OR beta'))
    own_file = F.regexp_extract("f", r"bucket=(-?\d+)/part-(\d+)-", 2)
    files = own.live(lambda rows, _: rows).select(F.input_file_name().alias("f")).distinct().select(own_file.alias("task"))
    assert files.groupBy("task").count().where("count > 1").isEmpty()
    plan = lambda q: own.scored(q)._jdf.queryExecution().executedPlan().toString()
    assert "positions" in plan('"of the"') and "positions" not in plan("alpha OR the")


def test_items_without_repeated_keys_need_no_tags(spark, tmp_path):
    one = Index.build(frame(spark, [(1, "a"), (2, "a b")]), "id", "text", str(tmp_path / "i"))
    two = Index.build(frame(spark, [(1, "a"), (1, "a b"), (1, "a")]), "id", "text", str(tmp_path / "j"))
    assert {x.tag for x in one.items().collect()} == {0} and len({x.tag for x in two.items().collect()}) == 2
    assert one.state["n"] == two.state["n"] == 2


def test_postings_move_in_lists(spark, tmp_path, monkeypatch):
    """Lists hold what single rows hold, whatever the salts and lengths, and take fewer bytes than they."""
    r = random.Random(9)
    rows = [(k * 10**9, " ".join(r.choices([f"w{i}" for i in range(60)], k=r.choice([0, 1, 40, 900])))) for k in range(700)] + [(5, None), (7, "w1 " * 40_000 + "last")]
    texts = pa.record_batch([pa.array([k for k, _ in rows]), pa.array([0] * len(rows)), pa.array([t for _, t in rows])], names=["key", "tag", "text"])
    want = sorted((x["key"], x["tag"], x["doc_len"], x["term"] or "", x["tf"], x["positions"]) for b in index.analyse([texts]) for x in b.to_pylist())
    monkeypatch.setattr(index, "PIECE", 100_000)
    for salts in (1, 7):
        cells = pa.record_batch([texts.column(0), texts.column(2), pa.array([k % salts for k, _ in rows], pa.int32()), pa.array([k % 2 for k, _ in rows], pa.int32())], names=["key", "text", "salt", "item"])
        lists = [b.append_column("bucket", b.column("at")).drop_columns(["at"]) for b in index.pack([cells])]
        got = [x for b in index.unpack(lists) for x in b.to_pylist()]
        assert sorted((x["key"], x["tag"], x["doc_len"], x["term"] or "", x["tf"], x["positions"]) for x in got) == want
        assert all(x["bucket"] == (x["key"] % salts if x["term"] else x["key"] % 2) for x in got)
    assert sum(b.num_rows for b in lists) < len(want)
    edges = np.array([0, 2, 2, 5])
    assert index.long_of(index.short(np.array([0, 127, 128, 2**28, 2**31 - 1]), edges)).tolist() == [0, 127, 128, 2**28, 2**31 - 1]

    # a segment of different keys moves lists, one of repeated keys single rows
    monkeypatch.setattr(index, "SHARE", 1 << 12)
    monkeypatch.setattr(index, "BUCKETS", 8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a = index.Index.build(df, "doc_id", "text", f"{tmp_path}/a")
    b = index.Index.build(df.unionByName(df), "doc_id", "text", f"{tmp_path}/b")
    of = lambda x: sorted(map(str, x.postings().drop("tag").collect()))
    assert of(a) == of(b) and a.state["n"] == b.state["n"] == len(rows) and a.state["tokens"] == b.state["tokens"]


def test_rare_words_do_not_drive_out_the_others(spark, tmp_path):
    """Of a text's words only repeated ones are remembered, and lists are sorted before they are taken apart, so postings come in the files' order."""
    index._stems.clear()
    rare = [f"rare{i}x" for i in range(500)]
    size, doc, code, place, terms = index.tokenized(pa.array([" ".join(rare) + " often", None, "", "Often OFTEN running runs"]))
    assert size.tolist() == [501, 0, 0, 4] and doc.tolist() == [0] * 501 + [3] * 4 and place.tolist() == [*range(501), *range(4)]
    assert [terms[k].as_py() for k in code] == [*rare, "often", "often", "often", "run", "run"]
    assert set(index._stems) == {"often"}
    assert [len(x) for x in index.tokenized(pa.array([None, ""], pa.string()))] == [2, 0, 0, 0, 0]

    seen, store = [], Index.store

    def kept(self, dealt, entry, kind):
        seen.append(dealt.withColumn("at", F.monotonically_increasing_id()).select("bucket", "term", "key", F.spark_partition_id().alias("p")).collect())
        return store(self, dealt, entry, kind)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(Index, "store", kept)
        Index.build(frame(spark, texts(3, 300)).repartition(3), "id", "text", str(tmp_path / "i"))
    rows = [(x.p, x.bucket, x.term or "", x.key) for x in seen[0]]
    assert [r[:3] for r in rows] == sorted([r[:3] for r in rows], key=lambda r: (r[0], r[2])) and len(rows) > 1000
