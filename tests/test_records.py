import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import clusters, compare, corpus, fusion, jobs, layout, lists, provenance, vectors, workflow
from tessera.operators.iterate import bounded

T0 = dt.datetime(2024, 1, 1)


def test_chain_hashes_keep_deep_and_lost_records(spark):
    rows = [(f"r{i}", f"r{i - 1}" if i else None, f"h{i}", "CHUNK") for i in range(12)]
    rows += [("o1", "gone", "x", "CHUNK"), ("o2", "o1", "x", "CHUNK"), ("c1", "c2", "x", "CHUNK"), ("c2", "c1", "x", "CHUNK")]
    df = spark.createDataFrame(rows, "id string, parent_id string, content_hash string, type string")
    got = {r.id: r.chain_hash for r in provenance.with_chain_hashes(df).collect()}
    assert got.keys() == {r[0] for r in rows}
    want, before = {}, None
    import hashlib

    for i in range(12):
        own = f"h{i}" if before is None else f"h{i}:{before}"
        want[f"r{i}"] = before = hashlib.sha256(own.encode()).hexdigest()
    assert {k: v for k, v in got.items() if v} == want
    walk = {r.id: (r.depth, r.path) for r in provenance.ancestors(df).collect()}
    assert walk["r11"] == (11, [f"r{i}" for i in range(10, -1, -1)]) and walk["o2"] == (1, ["o1"]) and walk["r0"] == (0, [])
    assert walk["c1"] == (1, ["c2"])


def test_provenance_is_created_checked_and_found(spark, tmp_path):
    parents = spark.createDataFrame([("d1", [], 0, "d1")], "id string, parent_ids array<string>, chain_depth int, root_document_id string")
    new = spark.createDataFrame([("o1", "OCR_RESULT", "d1"), ("d9", "DOCUMENT", None)], "id string, type string, source_id string")
    got = {r.id: r for r in provenance.create(new, parents).collect()}
    assert got["o1"].parent_ids == ["d1"] and got["o1"].chain_depth == 1 and got["o1"].root_document_id == "d1" and got["o1"].chain_path == ["DOCUMENT", "OCR_RESULT"]
    assert got["d9"].parent_ids == [] and got["d9"].chain_depth == 0 and got["d9"].root_document_id == "d9"
    for bad in (("x", "NOTHING", None), ("x", "CHUNK", "absent")):
        with pytest.raises(Exception, match="no such"):
            provenance.create(spark.createDataFrame([bad], new.schema), parents).collect()
    with pytest.raises(ValueError, match="order"):
        provenance.find(new, order="drop table")
    (tmp_path / "a.txt").write_text("text")
    (tmp_path / "b.txt").write_text("changed")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    path = lambda n: f"file:{tmp_path}/{n}"
    import hashlib

    known = spark.createDataFrame([(i, "DOCUMENT", path(n), "sha256:" + hashlib.sha256(b"text").hexdigest()) for i, n in ((1, "a.txt"), (2, "b.txt"), (3, "c.txt"))], "id int, type string, source_path string, file_hash string")
    assert {r.id: r.status for r in provenance.verify_files(known, files).collect()} == {1: "valid", 2: "changed", 3: "missing"}
    moved = provenance.with_orphaned_root(parents.select("id", "root_document_id"), spark.createDataFrame([("k",)], "id string"))
    assert {r.id: r.root_document_id for r in moved.collect()} == {"d1": "d1", "orphaned-root": "orphaned-root", "k": "orphaned-root"}


def test_states_follow_the_last_valid_one(spark):
    steps = ["draft", "approved", "executed", "submitted", "in_review", "draft", "approved", "executed"]
    rows = [(k, i, s) for k in ("a", "b", None) for i, s in enumerate(steps)]
    got = workflow.transitions(spark.createDataFrame(rows, "k string, i int, s string").repartition(3), "k", "s", "i").collect()
    for k in ("a", "b", None):
        own = sorted((r.i, r.previous, r.valid) for r in got if r.k == k)
        assert [v for *_, v in own] == [True, False, False, True, True, False, True, True] and own[2][1] == "draft" and own[0][1] is None


def test_jobs(spark):
    at = lambda m: F.lit(str(T0 + dt.timedelta(minutes=m))).cast("timestamp")
    log = spark.createDataFrame([(i, "pending", None, T0, 1) for i in range(6)], jobs.EVENTS)
    log = log.unionByName(jobs.claim(log, at(1), 4))
    assert sorted(r.document_id for r in jobs.status(log).where("status = 'processing'").collect()) == [0, 1, 2, 3]
    assert jobs.claim(log, at(2), 10).count() == 2

    def work(item):
        if item in ("1", "3"):
            raise OSError("no answer")
        return item * 2

    taken = jobs.status(log).where("status = 'processing' and document_id <> 2").withColumn("item", F.col("document_id").cast("string"))
    done = jobs.process(taken, "document_id", "item", work, attempts=2, tasks=1)
    log = log.unionByName(jobs.results(done, at(3), 3))
    assert {r.document_id: (r.status, r.error) for r in jobs.status(log).where("seq = 3").collect()} == {0: ("complete", None), 1: ("failed", "OSError: no answer"), 3: ("failed", "OSError: no answer")}
    assert [r.document_id for r in jobs.recover_stale(log, at(40)).collect()] == [2]
    assert sorted(r.document_id for r in jobs.retry_failed(log, at(5)).collect()) == [1, 3] and jobs.retry_failed(log, at(5), [3]).count() == 1
    many = spark.range(20).select(F.col("id").alias("k"), F.lit("1").alias("item"))
    errors = [r.error for r in jobs.process(many, "k", "item", work, attempts=1, failures=5, tasks=1).collect()]
    assert errors.count("aborted") == 15


def test_rate_limit_and_backoff():
    now = [0.0]
    own = jobs.RateLimit(2, 1000, 60, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    assert [own.acquire(100) for _ in range(2)] == [0, 0] and own.acquire(100) == 60
    now[0] += 61
    assert own.acquire(900) == 0 and own.acquire(200) == 60
    assert [jobs.backoff(k, 1, 10) for k in range(5)] == [1, 2, 4, 8, 10] and jobs.backoff(0, 4, 10, 0.5, 1.0) == 6


def test_layout_tree(spark):
    text = "# T\n\n| Name of it | Qty |\n|---|---|\n| a | 1 |\n| b | 2 |\n\n```py\nx = 1\ny\n```\nend\n\n{1}---\n\n| Name of it | Qty |\n|---|---|\n| c | 3 |\n"
    html = "<table><tr><th>Name of it</th>\n<th>Qty</th></tr><tr><td>a</td><td>1</td></tr><tr><td>b</td><td>2</td></tr></table>"
    tree = [{"block_type": "Page", "children": [{"block_type": "Text", "text": "Table 1. Things"}, {"block_type": "Table", "html": html}, {"block_type": "Code", "html": "<pre>x  =   1</pre>"}, {"block_type": "Figure", "html": "<p>nowhere to be found</p>"}]}]
    found = layout.tables(tree, text)
    assert len(found) == 1 and (found[0].headers, found[0].rows, found[0].columns, found[0].caption) == (["Name of it", "Qty"], 2, 2, "Table 1. Things")
    assert found[0].summary == "Table 1. Things. Table with 2 rows and columns: Name of it, Qty. Sample: a, 1"
    regions = layout.atomic_regions(tree, text)
    assert [(r.kind, text[r.start : r.end][:10], text[r.start : r.end][-4:]) for r in regions] == [("Table", "| Name of ", " 2 |"[:3] + "\n"), ("Code", "x = 1\ny\n``", "```\n")] or [r.kind for r in regions] == ["Table", "Code"]
    assert layout.containing(regions, text.index("| b")).kind == "Table" and layout.containing(regions, 0) is None
    group = {"block_type": "TableGroup", "html": html, "children": [{"block_type": "Table", "children": [{"block_type": "TableRow", "children": [{"block_type": "TableCell", "text": "Name of it"}, {"block_type": "TableCell", "text": "Qty"}]}] * 3}]}
    grouped = layout.tables([group], text)[0]
    assert grouped.rows == 3 and grouped.headers == ["Name of it", "Qty"]
    assert [t.continues for t in layout.tables([tree[0]["children"][1]] * 2, text)] == [None, 0]
    assert [(r.start, r.end, r.kind) for r in layout.merged([layout.Region(5, 9, "Code", 1), layout.Region(0, 5, "Table", 1), layout.Region(20, 30, "Figure", 2)])] == [(0, 9, "Table"), (20, 30, "Figure")]
    assert len(layout.table_summary(["h" * 300], 2, [], None)) == 200
    df = spark.createDataFrame([(1, json.dumps(tree), text), (2, "{broken", text), (3, None, None), (4, json.dumps(tree), "")], "id int, tree string, text string")
    assert {(r.id, r.kind) for r in layout.region_table(df, "id", "tree", "text").collect()} == {(1, "Table"), (1, "Code")}
    assert [(r.id, r.headers) for r in layout.table_structures(df, "id", "tree", "text").collect()] == [(1, ["Name of it", "Qty"])]
    assert sorted((r.id, r.row, r.col, r.text) for r in layout.table_cells(df.where("id = 1"), "id", "tree").collect())[:3] == [(1, 0, 0, "Name of it"), (1, 0, 1, "Qty"), (1, 1, 0, "a")]


def test_clusters(spark):
    own = spark.createDataFrame([(1, i, i % 3) for i in range(9)] + [(1, 99, None), (2, 0, 1)], "run_id int, document_id int, cluster_id int")
    moved = clusters.reassign(own, spark.createDataFrame([(0, 1, 2), (99, 1, 0)], "document_id int, run_id int, cluster_id int"))
    count = lambda df: {(r.run_id, r.cluster_id): r.document_count for r in clusters.counted(df).collect()}
    assert count(moved) == {(1, 0): 3, (1, 1): 3, (1, 2): 4, (2, 1): 1} and moved.count() == own.count()
    assert count(clusters.merge(moved, 1, 1, 2)) == {(1, 0): 3, (1, 1): 7, (2, 1): 1}
    assert count(clusters.without_run(own, 1)) == {(2, 1): 1}


def test_diff_keeps_memory_linear_and_rebuilds_both_texts(spark):
    a, b = "".join(f"a{i}\n" for i in range(3000)), "".join(f"b{i}\n" for i in range(3000))
    assert [o[0] for o in compare.operations(a, b)] in (["delete", "insert"], ["insert", "delete"]) or compare.line_ratio(a, b) == 0
    docs = spark.createDataFrame([(1, "x\ny\nz"), (2, "x\nq\nz"), (3, None)], "id int, text string")
    got = {(r.a, r.b): r for r in compare.compared(spark.createDataFrame([(1, 2), (1, 3), (3, 3)], "a int, b int"), docs, "id", "text", 2).collect()}
    assert got[1, 2].total_operations == 4 and got[1, 2].truncated and len(got[1, 2].operations) == 2 and got[1, 2].similarity == 0.6
    assert got[1, 3].similarity == 0.0 and got[3, 3].similarity == 1.0


def test_bounds_and_medians(spark):
    with pytest.raises(ValueError, match="more than 3 things"):
        bounded(spark.range(5), 3, "things")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0]), (None, [1.0, 1.0])], "g int, v array<double>")
    assert {r.g: (r.n, [round(x, 6) for x in r.centroid]) for r in vectors.centroids(v, "g", "v").collect()} == {1: (2, [0.707107, 0.707107]), 2: (1, [1.0, 0.0])}
    hits = spark.createDataFrame([(1, "a", 2), (2, "a", 1), (3, None, 3), (4, None, 4)], "id int, h string, rank int")
    assert sorted(r.id for r in fusion.first_by_hash(hits, "h", "rank").collect()) == [2, 3, 4]
    df = spark.range(5000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    one = corpus.fingerprint(df, "id", "h", 16).first()[0]
    assert one == corpus.fingerprint(df.repartition(7), "id", "h", 16).first()[0] != corpus.fingerprint(df.where("id <> 77"), "id", "h", 16).first()[0]


def test_model_answers(spark):
    df = spark.createDataFrame([("```json\n{\"a\": 1}\n```",), ("I think {\"a\": 2} fits",), ("none",), ("",), (None,)], "t string")
    assert [r[0] and r[0].a for r in df.select(lists.model_json("t", "a int")).collect()] == [1, 2, None, None, None]
    assert lists.safe_count(spark, "no_such_table") == 0


def test_pairs_of_a_cluster_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(compare, "CENTRES", 20)
    monkeypatch.setattr(compare, "GROUP", 7, raising=False)
    members = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(4, 0), (None, 0)], "id long, cluster int")
    got = sorted(map(tuple, compare.cluster_pairs(members, 0, "id").select("a", "b").collect()))
    assert got == [(a, b) for a in range(0, 60, 2) for b in range(a + 2, 60, 2)]
    facts = spark.createDataFrame([(i, f"s{i}") for i in range(50)] + [(2, "again")], "id long, source string")
    got = compare.cluster_pairs(members, 0, "id", facts).collect()
    assert sorted((r.a, r.source_a, r.b, r.source_b) for r in got) == sorted((a, x, b, y) for a in range(0, 50, 2) for b in range(a + 2, 50, 2) for x in ([f"s{a}", "again"] if a == 2 else [f"s{a}"]) for y in ([f"s{b}", "again"] if b == 2 else [f"s{b}"]))


def test_long_chains_take_few_rounds_and_records_move_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tessera.operators import provenance

    plans, cut = [], provenance.cut
    monkeypatch.setattr(provenance, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    chain = [(i, i - 1 if i % 20 else None) for i in range(60)]
    odd = [(200, 201), (201, 202), (202, 200), (203, 202), (204, 203), (300, 300), (400, 999), (401, 400)]
    records = spark.createDataFrame(chain + odd, "id long, parent_id long").withColumns({"type": F.lit("x"), "content_hash": F.col("id").cast("string")})
    found = {r.id: r.path for r in provenance.ancestors(records).collect()}
    assert len(plans) < 9
    up = dict(chain + odd)
    for i in up:
        path, at = [], up[i]
        while at in up and at != i and str(at) not in path:
            path.append(str(at))
            at = up[at]
        assert found.pop(i) == path
    assert not found
    plans.clear()
    hashed = {r.id: r.chain_hash for r in provenance.with_chain_hashes(records).collect()}
    assert len(hashed) == len(up) and {i for i, h in hashed.items() if h is None} == {i for i, _ in odd}
    assert all("InMemoryTableScan" in p for p in plans[1:])


def test_a_job_runs_each_row_once_and_steps_are_dealt_by_their_number(spark, sf, monkeypatch):
    from tessera.operators import workflow
    from tessera.plans import records, workflow as plans

    plan = records.jobs_processed(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1
    n = spark.range(10)
    assert workflow.parts(n) == 4 and workflow.parts(n, 1) == 10
    monkeypatch.setattr(workflow, "parts", lambda rows: 37)
    plan = plans.approval_progress(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "37), REPARTITION_BY_NUM" in plan


def test_line_diffs_take_texts_out_of_arrow_one_at_a_time(spark):
    from pyspark.sql import functions as F

    from tessera.operators import compare

    rows = spark.createDataFrame([(1, "a\nb\n", "a\nc\n"), (2, None, None), (3, "", "x"), (4, "é\n", "é\n")], "i int, a string, b string")
    out = rows.select("i", compare.line_diff_ratio("a", "b").alias("r"))
    assert [r.r for r in out.orderBy("i").collect()] == [0.5, 1.0, 0.0, 1.0]
    assert "pd.Series" not in str(compare.line_diff_ratio.__annotations__)
