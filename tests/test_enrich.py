from pyspark.sql import functions as F

from tessera.functions.register import register
from tessera.operators import enrich


def test_sql_names(spark):
    register(spark)
    assert spark.sql("select porter_stem('Running'), fold_diacritics('Été'), line_diff_ratio('a\nb\n', 'a\nc\n')").first()[:] == ("run", "Ete", 0.5)
    assert [r.kind for r in spark.sql("select kind from parse_blocks('# A\n\ntext') order by block_index").collect()] == ["heading", "paragraph"]
    assert spark.sql("select count(*) from (select '# A\n\ntext' as t) d, lateral chunk_text(d.t)").first()[0] == 1
    assert spark.sql("""select text from walk_json_blocks('{"block_type":"Text","text":"x"}')""").first()[0] == "x"


def test_levels_and_contexts(spark):
    rows = [("d", "ARTICLE 1", 1), ("d", "**Article 2**", 2), ("d", "article 3", 2), ("d", "Other", 4), ("e", "ARTICLE 1", 3)]
    out = {(r.doc, r.heading): r.level for r in enrich.levelled(spark.createDataFrame(rows, "doc string, heading string, level int"), "doc", "heading", "level").collect()}
    assert [out[("d", h)] for h in ("ARTICLE 1", "**Article 2**", "article 3", "Other")] == [2, 2, 2, 4] and out[("e", "ARTICLE 1")] == 3
    t = spark.createDataFrame([("word " * 1000,)], "t string")
    first, middle = t.select(enrich.page_context("t", F.lit(1), F.lit(3)), enrich.page_context("t", F.lit(2), F.lit(3))).first()
    assert first.startswith("word word") and 400 < len(first) <= 500 and 900 < len(middle) <= 1000


def test_page_pictures(spark):
    b = spark.createDataFrame([(1, 1, "Picture", "PageHeader"), (1, 1, "Figure", "Page"), (1, 2, "Picture", "Page")], "doc int, page int, kind string, parent_kind string")
    assert sorted(tuple(r) for r in enrich.page_pictures(b, "doc").collect()) == [(1, 1, True, 1, 0), (1, 2, False, 0, 1)]


def test_roles(spark):
    users = spark.createDataFrame([(1, "viewer"), (2, "admin")], "user_id int, role string")
    scopes = spark.createDataFrame([("viewer", "read"), ("admin", "read"), ("admin", "write")], "role string, scope string")
    tools = spark.createDataFrame([("search", "read"), ("delete", "write")], "tool string, scope string")
    assert sorted(tuple(r) for r in enrich.allowed(users, scopes, tools).collect()) == [(1, "search"), (2, "delete"), (2, "search")]


def test_sql_lineage_equals_the_operator_with_cycles(spark):
    from tessera.functions.register import lineage_view
    from tessera.operators import provenance

    # a chain, a fork, a loop that is entered from outside, a record that is its own parent, an absent parent
    rows = [("r", None), ("a", "r"), ("b", "a"), ("c", "a"), ("x", "y"), ("y", "z"), ("z", "y"), ("s", "s"), ("l", "gone")]
    df = spark.createDataFrame([(i, p, "T") for i, p in rows], "id string, parent_id string, type string")
    df.createOrReplaceTempView("walk_records")
    lineage_view(spark, "walk_records")
    got = {tuple(r) for r in spark.sql("select item, step, id, type from prov_lineage").collect()}
    assert got == {tuple(r) for r in provenance.lineage(df, df.select("id")).collect()}
    assert {(r.item, r.id) for r in spark.sql("select item, id from prov_lineage where cycle").collect()} == {("x", "z"), ("y", "z"), ("z", "y"), ("s", "s")}
    paths = {r.id: r.path for r in provenance.ancestors(df).collect()}
    assert paths == {"r": [], "a": ["r"], "b": ["a", "r"], "c": ["a", "r"], "x": ["y", "z"], "y": ["z"], "z": ["y"], "s": [], "l": []}


def test_long_walks_have_no_limit(spark, monkeypatch):
    from tessera.operators import provenance

    df = spark.createDataFrame([(i, i - 1 if i else None, "T") for i in range(40)], "id long, parent_id long, type string")
    assert provenance.lineage(df, df.where("id = 39").select("id")).count() == 40


def test_vectors_and_tables_in_sql(spark):
    from tessera.operators import vectors

    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, None)], "g int, v array<double>")
    df.createOrReplaceTempView("some_vectors")
    got = {r.g: r.c for r in spark.sql("select g, vec_centroid(v) as c from some_vectors group by g").collect()}
    want = {r.g: r.centroid for r in vectors.centroids(df.where("v is not null"), "g", "v").collect()}
    assert got[3] is None and all(all(abs(a - b) < 1e-12 for a, b in zip(got[g], want[g])) for g in (1, 2))
    cells = spark.sql("select * from html_tables('<table><tr><th>A</th><td> b <i>c</i></td></tr><tr><td>1</td></tr></table>')").collect()
    assert [tuple(r) for r in cells] == [(0, 0, "A"), (0, 1, "b c"), (1, 0, "1")]
    assert spark.sql("select * from html_tables(null)").collect() == []
