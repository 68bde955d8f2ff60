"""Queries over whole tables, held against plain code."""

import json
import re

import duckdb

from tessera.plans import catalog


def plain(t):
    return re.sub(r"\s+", " ", t.lower()).strip()


def test_repeated_chunk_match_takes_all_lines(spark, tmp_path):
    rows = [(i, f"Page {i} only\n  The  Footer of s{i % 2}\nbody {i} text", f"s{i % 2}") for i in range(120)]
    rows += [(200, "the footer of s0 x", "s0"), (201, "the footer of s0", "s1"), (202, None, "s0"), (203, "", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    # the query gives each text a header and a footer of its source
    rows = [(d, None if t is None or s is None else f"Report of {s}\n{t}\n  REPORT of {s} x", s) for d, t, s in rows]
    of = {}
    for d, t, s in rows:
        for x in {x.strip(" ").lower() for x in (t or "").split("\n")} - {""} if t is not None else ():
            of.setdefault((s, x), set()).add(d)
    n = {s: len([1 for _, t, x in rows if x == s and t is not None]) for *_, s in rows}
    known = [(s, plain(x)) for (s, x), ids in of.items() if len(ids) >= 2 and len(ids) > 0.5 * n[s]]
    assert len(known) == 6
    want = set()
    for d, t, s in rows:
        for line in (t or "").split("\n"):
            a = plain(line)
            if a and any(s == k and (a == b or len(a) <= 1.2 * len(b) and a in b or len(a) <= 1.5 * len(b) and b in a) for k, b in known):
                want.add((d, line))
    got = [tuple(r) for r in catalog.QUERIES["repeated_chunk_match"](spark, str(tmp_path)).select("doc_id", "line").collect()]
    assert sorted(got) == sorted(want) and len(want) == 121 + 2 * 122


def test_context_neighbours_of_every_hit(spark, sf):
    rows = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    hits = {k for k, r in rows.items() if "the" in (r.text or "").lower()}
    want = {k for k in rows if k not in hits and {(k[0], k[1] - 1), (k[0], k[1] + 1)} & hits}
    got = [(r.conv_id, r.turn) for r in catalog.QUERIES["context_neighbours"](spark, sf).collect()]
    assert sorted(got) == sorted(want) and any(c % 3 for c, _ in want)


def test_prov_exports_every_record(spark, sf):
    ids = [r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()]
    entities = {f"entity:{p}{d}" for p in "doce" for d in ids}
    got = catalog.QUERIES["prov_statements"](spark, sf).where("kind = 'entity'").collect()
    assert {r.subject for r in got} == entities and len(got) == len(entities)
    got = catalog.QUERIES["prov_json"](spark, sf).where("kind = 'entity'").collect()
    assert {r.root_document_id for r in got} == {f"d{d}" for d in ids} and len(got) == len(ids)
    assert all({s["subject"] for s in json.loads(r.statements)} == {f"entity:{p}{r.root_document_id[1:]}" for p in "doce"} for r in got)


def test_text_functions_normalise_whole_texts(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.normalized for r in catalog.QUERIES["text_functions"](spark, sf).collect()}
    long = [d for d, t in texts.items() if t and t.isascii() and len(plain(t)) > 200]
    assert long and all(got[d] == plain(texts[d]) for d in long)


def test_chains_are_hashed_without_the_texts(spark, sf, monkeypatch):
    from tessera.operators import provenance
    from tessera.plans import lineage

    seen, cut = [], provenance.cut
    monkeypatch.setattr(provenance, "cut", lambda df: seen.extend(df.columns) or cut(df))
    assert lineage.chain_hashes(spark, sf).columns == ["id", "chain_hash"] and lineage.verify_chain(spark, sf).columns[0] == "root_document_id"
    assert "content_hash" in seen and "content" not in seen


def test_block_counts_has_a_row_for_each_row(spark, tmp_path):
    texts = [(1, "a\n\nb"), (2, ""), (3, None), (4, "```\nx\n\ny\n```"), (5, "once"), (5, "once\n\nmore"), (5, "once"), (None, "no\n\nkey"), (2**53 + 1, "large"), (6, "\n" * 5), (7, "```open\n\nb\n\nc"), (8, "\n\na\r\n\r\nb\n\n")]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(path)
    sql = catalog.ORACLE_SQL["block_counts"].replace("from documents", f"from read_parquet('{path}/*.parquet')")
    order = lambda rows: sorted(map(tuple, rows), key=str)
    want = [(k, None if t is None else len(t.split("\n\n"))) for k, t in texts]
    assert order(catalog.QUERIES["block_counts"](spark, str(tmp_path)).collect()) == order(duckdb.sql(sql).fetchall()) == order(want)
