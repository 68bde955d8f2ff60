

import __spark_entry__
import corpus_pipeline
from tessera.llm import packing, quality, secrets
from tessera.llm.queries import tokenizer
from tessera.llm.token_counts import count_texts
from tests.llm import brute
from tests.llm.test_minhash import brute as similar
from tests.llm.test_quality import plain as counts
from tests.llm.test_secrets import base

SF = "/root/testdata/sf0.001"


def test_stages_match_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] and "pipeline" in __spark_entry__.queries()
    rows = {r.doc_id: r for r in docs.collect()}

    # quality: base rules by plain code, the trees by the operator's own verdict
    forest = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = {r.doc_id: r.quality_score for r in quality.judge(docs, forest).collect()}
    kept = {}
    for d, r in rows.items():
        n, _, _, _, again = counts(r.text)
        if n >= 50 and 100 * again <= 50 * n and score[d] >= quality.THRESHOLD:
            kept[d] = r.text
    out = corpus_pipeline.quality_rules(spark, docs, SF)
    assert out.columns == columns and {r.doc_id: r.text for r in out.collect()} == kept

    # near-duplicates: the smallest doc_id of each component
    out = corpus_pipeline.near_duplicates(spark, out, SF)
    first = {d for _, d in similar(list(kept.items()))}
    kept = {d: t for d, t in kept.items() if d in first}
    assert out.columns == columns and {r.doc_id: r.text for r in out.collect()} == kept

    # passages
    out = corpus_pipeline.repeated_passages(spark, out, SF)
    kept = {d: k.decode("utf-8", "ignore") for (d, *_), k in zip(kept.items(), [x[5] for x in brute.remove_bytes(list(kept.items()))])}
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == columns and {d: r.text for d, r in got.items()} == kept and all(r.n_chars == len(r.text) for r in got.values())

    # secrets: every base span is gone, the rest stays
    spans = {r.doc_id: r.spans for r in secrets.digests(out).collect()}
    out = corpus_pipeline.hidden_secrets(spark, out, SF)
    for r in out.collect():
        found = sorted((int(s), int(e)) for _, s, e in (x.split(":") for x in filter(None, spans[r.doc_id].split(","))))
        assert {(s, e) for s, _, e, _ in base(kept[r.doc_id])} <= set(found)
        text, at = "", 0
        for s, e in found:
            if e > at:
                text += (kept[r.doc_id][at:s] + "[secret]") if s >= at else ""
                at = e
        kept[r.doc_id] = text + kept[r.doc_id][at:]
        assert r.text == kept[r.doc_id]

    # packing: one shard at this size
    got = sorted(map(tuple, corpus_pipeline.packed_bins(spark, out, SF).collect()), key=str)
    items = sorted(kept)
    n = dict(zip(items, count_texts([kept[d] for d in items], tokenizer("byte_bpe_50k.json")).tolist()))
    assert sorted((d, k) for d, k, *_ in got) == sorted((d, k) for d in items for k in range(max(1, -(-n[d] // packing.CAPACITY))))
    assert sum(x[2] for x in got) == sum(n.values())
    room = {}
    for d, _, size, source, b, _ in got:
        if b is not None:
            room.setdefault(b, []).append((size, source, kept[d]))
    assert all(sum(s for s, *_ in x) <= packing.CAPACITY and len({y[1] for y in x}) == len(x) == len({y[2] for y in x}) for x in room.values())

    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()), key=str) == got


NAMES = ["block", "key", "row", "__at", "__rank", "base", "spans", "shard", "cluster", "root", "fp", "a b"]


def odd_rows(n):
    words = [" ".join(f"w{(i * 7919 + k * k) % 100_003}" for k in range(120)) for i in range(n)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(words)]
    rows += [(3, words[3], "en", "s", len(words[3])), (None, words[4] + " more", None, None, None), (None, "null id " + words[n - 1][::-1], None, "s", 1), (None, None, None, None, None), (90, "", "en", "s", 0), (91, "short", None, "s", 5)]
    rows += [(92, " ".join(words) * 20 + " token=abcdef123456", "en", "s", 1)]
    return [(*r, *range(len(NAMES))) for r in rows]


def test_stages_on_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in NAMES)
    rows = odd_rows(30)
    df = spark.createDataFrame(rows, schema).repartition(4)
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        got = out.collect()
        assert out.columns == df.columns and all(tuple(r[c] for c in NAMES) == tuple(range(len(NAMES))) for r in got), name
        assert stage(spark, df.limit(0), SF).collect() == [], name
        n = {"quality rules": None, "simhash near-dedup": 30 + 1 + 1 + 1 + 1}.get(name, len(rows))
        assert n is None or len(got) == n, name
        if name == "quality rules":
            assert not [r for r in got if r.text in (None, "", "short")]
        if name == "simhash near-dedup":
            assert sum(not r.text for r in got) == 1 and sum(r.doc_id == 3 for r in got) == 1 and not any((r.text or "").endswith(" more") for r in got)
        if name == "suffix-array dedup":
            assert sum(r.text == rows[3][1] for r in got) == 2  # rows of one doc_id do not remove each other
            assert next(r.text for r in got if r.doc_id == 91) == "short" and sum(r.text is None for r in got) == 1
            assert all(r.n_chars == len(r.text) for r in got if r.text is not None)
        if name == "secret scan":
            assert next(r.text for r in got if r.doc_id == 92).endswith(" [secret]") and sum(r.text is None for r in got) == 1
    packed = stages["best-fit packing"](spark, df, SF).collect()
    assert len({(r.doc_id, r.piece) for r in packed}) >= 34 and sum(r.bin_id is None for r in packed) == 2
    assert stages["best-fit packing"](spark, df.limit(0), SF).collect() == []
