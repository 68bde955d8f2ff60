import random
import re
from itertools import permutations

import pytest

from tessera.llm import filter_audit

LATEST = 2**63


def plain(rows, labels):
    """rows of (doc_id, text, source): the contract in plain Python."""
    first = {}
    for d, t, _ in rows:
        first[t or ""] = min(first.get(t or "", LATEST), LATEST if d is None else d)
    good, toxic = ({d for d, *x in labels if d is not None and x[i] == 1} for i in (0, 1))
    parts = {}
    for d, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        fails = "".join(f for f, bad in zip("ABCDE", [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search("[#$%&*|]", t), first[t] < (LATEST if d is None else d)]) if bad)
        parts.setdefault(s or "", []).append((fails, d in good, d in toxic))
    out, shapley = {}, {}
    for part, docs in parts.items():
        for order in map("".join, permutations("ABCDE")):
            for k in range(5):
                f, prior = order[k], set(order[:k])
                gone = [x for x in docs if f in x[0] and not prior & set(x[0])]
                out[part, order, k + 1] = (sum(not (prior | {f}) & set(x[0]) for x in docs), len(gone), sum(f in x[0] and bool(prior & set(x[0])) for x in docs), sum(x[0] == f for x in docs), sum(x[1] for x in gone), sum(x[2] for x in gone))
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("seed", range(3))
def test_audit_equals_plain_python(spark, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Big", "#", "a|b", "é", "中文", "x y"]
    texts = [None, "", " \n ", "same " * 300, "A" * 50, "long " * 30_000 + "end"]
    texts += [r.choice([" ", "\t", "\n", "  "]).join(r.choice(words[: r.choice([5, 150, 400, 406])]) for _ in range(r.choice([3, 199, 200, 201, 260]))) for _ in range(40)]
    rows = [(r.choice([None, *range(90)]), r.choice(texts), r.choice([None, "", "a", "b", "hot", "hot", "hot"])) for _ in range(150)]
    rows += rows[:20]
    labels = [(r.choice([None, *range(95)]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(80)]
    df = spark.createDataFrame([(*x, 1, "y", 0, 7, True) for x in rows], "doc_id long, text string, source string, u int, part string, n int, mask int, copies boolean").repartition(4)
    known = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, text string")
    got = {tuple(x)[:3]: tuple(x)[3:] for x in filter_audit.audit(df, known).collect()}
    assert got == plain(rows, labels)


def test_empty_tables_and_types(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(df, labels).collect() == []
    one = filter_audit.audit(spark.createDataFrame([(1, None, None)], df.schema), labels)
    assert one.count() == 600 and {x.part for x in one.collect()} == {""}
    assert one.dtypes == [("part", "string"), ("filter_order", "string"), ("step", "int"), *[(c, "bigint") for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]]


def test_words_need_no_exchange_of_their_own(spark):
    docs = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    counted = filter_audit.word_counts(filter_audit.identified(docs, "text", "doc_id", "source"))
    assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
