import difflib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import compare, parse, provenance, workflow
from tessera.sources import files

MD = """# Title

Intro text. More text.

**II. Second Part**

| a | b |
|---|---|
| 1 | 2 |

```python
x = 1

y = 2
```

<!-- Page 2 -->

- item one
- item two

## Sub

tail"""


def test_markdown_blocks():
    b = parse.blocks(MD)
    assert [x.kind for x in b] == ["heading", "paragraph", "heading", "table", "code", "page_marker", "list", "heading", "paragraph"]
    assert all(MD[x.start : x.end] == x.text for x in b)
    assert b[4].text.count("```") == 2 and b[2].level == 2 and b[2].heading == "II. Second Part"
    assert b[-1].section == "Title > Sub" and b[3].section == "Title > II. Second Part" and b[-1].page == 2


def test_chunks_are_bounded_ordered_and_complete():
    r = random.Random(1)
    text = "\n\n".join(["# H"] + ["Sentence number %d goes here. " % i * r.randint(1, 60) for i in range(40)])
    out = parse.chunks(text, 500, 2000)
    assert all(len(c.text) <= 501 for c in out)
    assert [c.start for c in out] == sorted(c.start for c in out)
    strip = lambda t: "".join(t.split())
    assert strip("".join(c.text for c in out)) == strip(text)
    big = "| a | b |\n|---|---|\n" + "| 1 | 2 |\n" * 1500
    parts = parse.chunks("# T\n\n" + big)
    assert all(c.atomic and len(c.text) <= 8000 and c.overlap_next == 0 for c in parts[1:]) and len(parts) == 2
    assert parse.chunks("") == [] and [c.text for c in parse.chunks("# Only heading\n\nshort")] == ["# Only heading\n\nshort"]


def test_parse_operators(spark):
    df = spark.createDataFrame([(1, MD), (2, None), (3, "")], "id long, text string")
    blocks = parse.markdown_blocks(df, "id", "text")
    assert {r.id for r in blocks.collect()} == {1}
    assert [r.heading for r in parse.outline(blocks, "id").orderBy("n").collect()] == ["Title", "II. Second Part", "Sub"]
    tree = {r.section: (r.depth, r.n_chunks) for r in parse.section_tree(parse.chunked(df, "id", "text"), "id").collect()}
    assert tree["Title"][0] == 1 and "Title > Sub" in tree
    assert spark.createDataFrame([("| a | b |\n|---|:-:|\n| 1 | 2 |",)], "t string").select(parse.pipe_cells(F.col("t"))).first()[0] == [["a", "b"], ["1", "2"]]
    layout = json.dumps({"block_type": "Document", "children": [{"block_type": "Page", "children": [{"block_type": "Text", "html": "<p>Hi <b>you</b></p>"}]}, {"block_type": "Page", "blocks": [{"block_type": "Table", "text": "t"}]}]})
    got = parse.layout_blocks(spark.createDataFrame([(1, layout), (2, "broken {")], "id long, j string"), "id", "j").collect()
    assert [(r.kind, r.page, r.text) for r in got if r.kind in ("Text", "Table")] == [("Text", 1, "Hi you"), ("Table", 1, "t")]


def test_line_diff():
    r = random.Random(5)
    for _ in range(200):
        a = [r.choice("abcd") for _ in range(r.randint(0, 12))]
        b = [r.choice("abcd") for _ in range(r.randint(0, 12))]
        pairs = compare.edit_script(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(set(pairs))
        lcs = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                lcs[i + 1][j + 1] = lcs[i][j] + 1 if x == y else max(lcs[i][j + 1], lcs[i + 1][j])
        assert len(pairs) == lcs[-1][-1]
    assert compare.line_ratio("", "") == 1.0 and compare.line_ratio("a\nb\n", "a\nc\n") == 0.5
    assert compare.line_ratio("x\n" * 30, "x\n" * 30) == difflib.SequenceMatcher(None, "x\n" * 30, "x\n" * 30).ratio()


def test_clusterings():
    r = np.random.default_rng(0)
    centres = np.eye(6)[:3]
    points = np.concatenate([c + 0.05 * r.normal(size=(12, 6)) for c in centres] + [-np.ones((1, 6))])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    truth = np.repeat([0, 1, 2], 12)
    for labels in (compare.linkage(points, 4, None), compare.density_labels(points, 4)):
        own = [set(labels[:36][truth == k]) for k in range(3)]
        assert all(len(o) == 1 for o in own) and len(set.union(*own)) == 3
    assert compare.linkage(points, None, 0.3)[36] not in compare.linkage(points, None, 0.3)[:36]
    assert compare.density_labels(points, 4)[36] == -1
    with pytest.raises(ValueError):
        compare.linkage(points, 2, None, "ward")


def test_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, body in (("a.txt", "one"), ("b.pdf", "two"), ("sub/c.txt", "one"), ("ignored.exe", "x")):
        (tmp_path / name).write_text(body)
    found = files.scan(spark, str(tmp_path))
    assert found.count() == 3
    one = found.where(F.endswith("path", F.lit("a.txt"))).first()
    known = spark.createDataFrame([(one.path, one.file_hash), (one.path.replace("a.txt", "b.pdf"), "sha256:old")], "path string, file_hash string")
    got = {r.path.rsplit("/", 1)[-1]: r.action for r in files.register(found, known).collect()}
    assert got == {"a.txt": "skip", "b.pdf": "version", "c.txt": "duplicate"}
    assert [(r.n, r.same_hash) for r in files.same_size_hints(found).collect()] == [(3, False)]
    files.export_csv(spark.createDataFrame([('x"y,z', 1)], "a string, b int"), str(tmp_path / "out"), quote_all=True)
    assert '"x""y,z","1"' in "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    docs = files.document_json(spark.createDataFrame([(1, "t")], "id int, title string"), spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "id int, chunk_index int, text string"), "id")
    assert [c["text"] for c in json.loads(docs.first().json)["chunks"]] == ["a", "b"]
    vec = spark.createDataFrame([("a b",), (None,)], "t string").select(files.adapter(files.stand_in_model(8))("t")).collect()
    assert len(vec[0][0]) == 8 and abs(sum(x * x for x in vec[0][0]) - 1) < 1e-5
    assert len(files.signature("k", "body")) == 64


def test_contracts_and_context(spark):
    df = spark.createDataFrame([(1, "Total value: $500\nThis agreement is governed by the laws of Ohio\nNet 30", "Governing Law")], "id long, text string, heading string")
    found = workflow.contract_fields(df, "id", "text", ["total_value", "governing_law", "custom_name"], "heading")
    best = {r.field: (r.value, r.confidence) for r in workflow.best_fields(found, "id").collect()}
    assert best["total_value"][1] == 0.7 and best["governing_law"][1] == 0.8 and "custom_name" not in best
    t = spark.createDataFrame([("x" * 100 + " hit  here " + "y" * 300,)], "t string")
    got = t.select(workflow.match_context(F.col("t"), F.lit(102), F.lit(3))).first()[0]
    assert got.startswith("...x") and got.endswith("y...") and "hit here" in got


def test_lineage_cycle_ends(spark):
    r = spark.createDataFrame([("a", "b", "T"), ("b", "a", "T")], "id string, parent_id string, type string")
    assert provenance.lineage(r, r.select("id")).count() == 2 * 2


@pytest.mark.parametrize("seed", range(6))
def test_chunks_lie_where_they_say(seed):
    """The source between a chunk's offsets is the chunk, but for markers, blank lines and tags."""
    import random
    import re

    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(1, 9)))
    prose = lambda: " ".join(word() + r.choice(["", "", ".", "?"]) for _ in range(r.randint(1, 160)))
    table = lambda n: "| a | <b>c</b> |\n|---|---|\n" + "\n".join(f"| {word()} | <i>{word()}</i> |" for _ in range(n))
    page = [0]

    def mark():
        page[0] += 1
        return f"{{{page[0]}}}" + "-" * 48

    parts = [r.choice([prose, prose, prose, lambda: "# " + word(), lambda: table(r.randint(1, 60)), lambda: "```\n" + prose() + "\n\n" + prose() + "\n```", mark, lambda: ""])() for _ in range(60)]
    source = "\n\n".join(parts)
    plain = lambda t: re.sub(r"\s+", "", re.sub("<[^>]*>", "", parse.PAGE.sub("", t)))
    out, marks, last = parse.chunks(source, 300, 900), parse.page_marks(source), 0
    assert len(out) > 20
    for c in out:
        assert last <= c.start < c.end <= len(source)
        assert plain(source[c.start : c.end]) == plain(c.text)
        for (at, origin), nxt in zip(c.pieces, [*c.pieces[1:], (len(c.text), None)]):
            run = c.text[at : nxt[0]].rstrip("\n")
            assert source[origin : origin + len(run)] == run
        assert c.page == parse.page_at(marks, c.start)
        end = parse.page_at(marks, c.end - 1)
        assert c.page_range == (None if c.page is None or end == c.page else f"{c.page}-{end}")
        last = c.end
    assert any(c.page_range for c in out)


def test_rows_of_a_batch_are_made_some_texts_at_a_time(spark, monkeypatch):
    from tessera.operators import parse

    sizes, frame = [], parse.pd.DataFrame
    texts = frame({"doc_id": range(3000), "text": ["a\n\nb"] * 3000})

    class Docs:
        schema = spark.range(1).withColumnRenamed("id", "doc_id").schema

        def select(self, *_):
            return self

        def mapInPandas(self, run, _):
            return [len(x) for x in run(iter([texts]))]

    sizes = parse.markdown_blocks(Docs(), "doc_id", "text")
    assert sum(sizes) == 6000 and max(sizes) <= 512
