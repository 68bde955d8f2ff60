"""Writes of records by document: repeated, broken, changed and empty batches."""

import pytest

from tessera.operators.manifest import Manifest
from tessera.sources.store import Store

SCHEMA = "document string, image_index int, content_hash string, vector array<float>"


def images(spark, rows):
    return spark.createDataFrame([(d, i, h, [float(i), 1.0]) for d, i, h in rows], SCHEMA)


def shown(store):
    return sorted((str(r.document), r.image_index, r.content_hash) for r in store.read().collect())


def segments(path):
    return len(list((path / "segments").iterdir())) if (path / "segments").exists() else 0


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path), "document", "content_hash")


def test_a_batch_twice_is_a_batch_once(spark, store, tmp_path):
    batch = images(spark, [("a", 0, "x"), ("a", 1, "y"), ("a", 2, "x"), ("b", 0, "x"), (None, 0, "z")])
    first = store.put(batch, batch=("run", 1))
    rows = shown(store)
    assert rows == [("None", 0, "z"), ("a", 0, "x"), ("a", 1, "y"), ("b", 0, "x")]  # one row of a document and content
    assert store.put(batch, batch=("run", 1)) == first and store.put(batch) == first and shown(store) == rows
    later = store.put(batch, batch=("run", 2))
    assert later["segments"] == first["segments"] and shown(store) == rows


def test_a_broken_batch_has_not_happened(spark, store, tmp_path, monkeypatch):
    store.put(images(spark, [("a", 0, "x"), ("b", 0, "y")]), batch=("run", 1))
    before = shown(store)
    batch = images(spark, [("b", 0, "new"), ("b", 1, "more"), ("c", 0, "z")])
    with monkeypatch.context() as m:
        m.setattr(Manifest, "write", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.put(batch, batch=("run", 2))
    assert shown(store) == before
    store.put(batch, batch=("run", 2))
    want = [("a", 0, "x"), ("b", 0, "new"), ("b", 1, "more"), ("c", 0, "z")]
    assert shown(store) == want
    # half of it again, then all of it
    store.put(images(spark, [("b", 0, "new"), ("b", 1, "more")]), batch=("run", 3))
    store.put(batch, batch=("run", 4))
    assert shown(store) == want
    store.compact()
    assert shown(store) == want and segments(tmp_path) == 1


def test_documents_lose_their_rows(spark, store):
    store.put(images(spark, [("a", 0, "x"), ("b", 0, "y"), (None, 3, "n")]))
    store.put(images(spark, [("a", 5, "w")]), spark.createDataFrame([("a",), (None,), ("unknown",)], "document string"))
    assert shown(store) == [("a", 5, "w"), ("b", 0, "y")]
    assert [r.image_index for r in store.read(spark.createDataFrame([("a",)], "document string")).collect()] == [5]
    store.put(images(spark, []), spark.createDataFrame([("a",), ("b",)], "document string"))
    assert shown(store) == []


def test_empty_store(spark, store):
    with pytest.raises(FileNotFoundError):
        store.read()
    store.put(images(spark, []), batch=("run", 0))
    store.put(images(spark, [("a", 0, "x")]))
    assert shown(store) == [("a", 0, "x")]
