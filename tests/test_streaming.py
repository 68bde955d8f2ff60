import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import workflow
from tessera.operators.index import Index
from tessera.streaming import events as streaming
from tessera.streaming import state


def run(query_df, name, mode="append"):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return query_df.sparkSession.table(name)


def events(spark, sf):
    static = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return static, stream


def test_windows_equal_the_batch(spark, sf):
    static, stream = events(spark, sf)
    for name, make in (("tumbling", lambda d: streaming.tumbling(d)), ("sliding", lambda d: streaming.tumbling(d, size="2 hours", slide="1 hour"))):
        want = {tuple(r)[:3] for r in make(static).collect()}
        got = {tuple(r)[:3] for r in run(make(stream), name, "complete").collect()}
        assert got == want


def test_sessions_close_behind_the_watermark(spark, sf):
    static, stream = events(spark, sf)
    want = {tuple(r) for r in streaming.sessions(static).collect()}
    got = {tuple(r) for r in run(streaming.sessions(stream), "sessions").collect()}
    assert got <= want and len(got) > 0.9 * len(want)


def test_state_machine(spark, tmp_path):
    rows = [(1, "draft", 1), (1, "submitted", 2), (1, "approved", 3), (1, "in_review", 4), (2, "submitted", 1)]
    spark.createDataFrame(rows, "doc long, state string, ts long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc long, state string, ts long").parquet(str(tmp_path / "in"))
    got = sorted((tuple(r) for r in run(streaming.states(stream, "doc", "state", "ts"), "states").collect()), key=str)
    assert got == sorted([(1, "draft", None, True), (1, "submitted", "draft", True), (1, "approved", "submitted", False), (1, "in_review", "submitted", True), (2, "submitted", None, False)], key=str)


def test_index_sink(spark, sf, tmp_path):
    static = spark.read.parquet(f"{sf}/documents.parquet")
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", "documents.parquet").parquet(sf)
    q = stream.writeStream.foreachBatch(streaming.index_sink(str(tmp_path / "index"), "doc_id", "text")).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    own = Index(spark, str(tmp_path / "index"))
    assert own.postings().agg(F.count_distinct("key")).first()[0] >= 190
    whole = Index.build(static, "doc_id", "text", str(tmp_path / "whole"))
    assert sorted(map(tuple, own.scored("the OR of").collect())) == sorted(map(tuple, whole.scored("the OR of").collect()))


def test_states_are_ordered_over_all_parts_of_a_batch(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rows = [(1, s, t) for t, s in enumerate(["draft", "submitted", "in_review", "approved"])]
        spark.createDataFrame(rows[::-1], "doc long, state string, ts long").coalesce(1).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("doc long, state string, ts long").parquet(str(tmp_path / "in"))
        got = {r.state: (r.previous, r.valid) for r in run(streaming.states(stream, "doc", "state", "ts"), "ordered").collect()}
        assert got == {"draft": (None, True), "submitted": ("draft", True), "in_review": ("submitted", True), "approved": ("in_review", True)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def steps(spark, folder, schema, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_locks_expire_by_timers(spark, tmp_path):
    """Late, repeated, overtaken and expired locks: the stream's state is the batch result, and each expiry is told."""
    schema = "event_id long, document_id long, user_id long, action string, ts timestamp"
    batches = [
        [(1, 1, 10, "lock", at(0)), (2, 2, 11, "lock", at(1)), (3, 3, 12, "lock", at(2)), (4, 3, 12, "unlock", at(3))],
        [(6, 4, 13, "lock", at(20)), (7, 2, 11, "lock", at(18)), (5, 2, 14, "unlock", at(12))],  # the unlock comes late and is overtaken
        [(8, 5, 15, "lock", at(41)), (9, 1, 16, "lock", at(40))],
        [(10, 6, 17, "lock", at(70))],
        [(11, 7, 18, "lock", at(71))],
    ]
    stream = steps(spark, tmp_path / "in", schema, batches)
    changes = run(state.lock_changes(stream), "lock_changes")
    got = {(r.document_id, int(r.user_id), r.expires_at) for r in state.locks_of(changes).collect()}
    events = spark.createDataFrame([r for b in batches for r in b], schema)
    # the watermark has passed minute 60
    want = {tuple(r) for r in workflow.locks(events, F.lit(at(60))).collect()}
    assert got == want and {g[0] for g in got} == {1, 5, 6, 7}
    told = {(r.document_id, r.at) for r in changes.where("status = 'expired'").collect()}
    assert told == {(1, at(30)), (2, at(48)), (4, at(50))}


def test_alerts_come_once(spark, tmp_path):
    schema = "doc_id long, text string, created_at timestamp"
    batches = [[(1, "a dog", at(0)), (2, "a cat", at(1)), (1, "a dog", at(0))], [(1, "a dog", at(0)), (3, "dog and cat", at(30))], [(4, "a dog", at(300)), (3, "dog and cat", at(30))], [(5, "cat", at(301))]]
    stream = steps(spark, tmp_path / "in", schema, batches)
    searches = spark.createDataFrame([(7, "dog", None), (8, "cat", at(5))], "search_id long, word string, last_alert timestamp")
    sink, path = state.epoch_sink(str(tmp_path / "out")), str(tmp_path / "out")
    hit = F.expr("contains(text, word)")

    def twice(df, epoch):
        df.persist()
        sink(df, epoch)
        sink(df, epoch)  # as after a failure
        df.unpersist()

    q = state.alerts_stream(stream, searches, hit).writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.search_id, r.doc_id) for r in spark.read.parquet(path).collect())
    docs = spark.createDataFrame([r for b in batches for r in b], schema).distinct()
    want = sorted((r.search_id, r.doc_id) for r in workflow.alerts(searches, docs, hit).collect())
    assert got == want == [(7, 1), (7, 3), (7, 4), (8, 3), (8, 5)]
