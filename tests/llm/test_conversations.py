import hashlib
import heapq
import random
import re
import time
import zlib
from itertools import product

from tessera.llm import conversations
from tessera.llm.conversations import CODES, INITIALS, parse


def least(rows):
    """Dijkstra over (row, state) with whole audits."""
    queue, seen = [(0, "", 0, "")], set()
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit
        for x in {"": "su", "s": "u", "u": "a", "a": "u"}[state]:
            if x != "s":
                heapq.heappush(queue, (cost + 5, audit + "I", i, x))
            if i < len(rows) and rows[i][1] not in ("blank", "duplicate"):
                extra = 5 * (rows[i][1] == "truncated")
                if rows[i][0] == x:
                    heapq.heappush(queue, (cost + extra, audit + "K", i + 1, x))
                if x != "s":
                    heapq.heappush(queue, (cost + extra + 1, audit + "R", i + 1, x))
        if i < len(rows):
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state))


FAULTS = ["", "blank", "duplicate", "truncated"]


def code(row):
    return CODES[(INITIALS + "o").index(row[0]) * 4 + FAULTS.index(row[1])]


def test_least_cost_and_first_audit():
    kinds = list(product("suao", ["", "blank", "truncated"]))
    for n in range(4):
        for rows in product(kinds, repeat=n):
            assert parse("".join(map(code, rows))) == least(rows)
    r = random.Random(5)
    for _ in range(3000):
        rows = [(r.choice("suuaaao"), r.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(r.randint(4, 14))]
        assert parse("".join(map(code, rows))) == least(rows)


def test_long_conversations_take_linear_time():
    r = random.Random(6)
    rows = [(r.choice("suao"), r.choice(FAULTS)) for _ in range(20_000)]
    began = time.time()
    assert parse("".join(map(code, rows[:3000]))) == least(rows[:3000])
    cost, audit = parse("".join(map(code, rows)))
    assert len(audit.replace("I", "")) == 20_000 and time.time() - began < 30
    assert parse(CODES[3 * 4 + 1] * 5000) == (10_000, "D" * 5000)


def brute(rows):
    """rows of (conv_id, turn, role, text): the contract in plain Python, by conv_id."""
    own, out = {}, {}
    one = lambda x: " " if x is None else str(x)
    for c, t, role, text in rows:
        k = zlib.crc32(f"{one(c)}:{one(t)}".encode()) % 20
        role, text = one(role), one(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        own.setdefault(c, []).extend([(t, role, text)] * (0 if k == 0 else 2 if k == 3 else 1))
    for c, found in own.items():
        found.sort(key=lambda x: (x[0] is not None, x[0] or 0))
        seen, faults = set(), []
        for _, role, text in found:
            core = re.sub("[\x20\x09-\x0d]", "", text)
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [role[:1] if role[:1] in ("s", "u", "a") and role else "o" for _, role, _ in found]
        turns = [t for t, _, _ in found if t is not None]
        cost, audit = least(list(zip(initials, faults)))
        fixed, i, due = [], 0, "user"
        for e in audit:
            if e == "D":
                i += 1
                continue
            if e == "K" and initials[i] == "s":
                fixed.append(f"{found[i][1]}:{found[i][2]}")
            else:
                fixed.append(f"{found[i][1] if e == 'K' else due}:{'' if e == 'I' else found[i][2]}")
                due = "assistant" if due == "user" else "user"
            i += e != "I"
        sha = hashlib.sha256("\n".join(fixed).encode()).hexdigest()
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in FAULTS[1:]], illegal, cost, audit, sha)
    return out


def test_query_equals_plain_python(spark, sf):
    from tessera.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op11_conversation_repair"](spark, sf).collect()}
    assert got == brute(rows) and len(got) == len({r[0] for r in rows})


def test_odd_rows(spark):
    r = random.Random(7)
    texts = [None, "", "  ", "Yes.", "No", "Why?", "a\x0b.\x0c\r\n", "x. \u00a0", "y" * 200_000 + ".", "Yes.", "é!"]
    rows = [(r.choice([None, 1, 2, 3, 4, *range(10, 40)]), t if t % 17 else None, r.choice(["user", "assistant", "system", None, "", "tool", "User"]), r.choice(texts)) for t in range(300)]
    rows += [(99, 5, "user", "Same."), (99, 5, "user", "Same."), (99, 5, "user", "Same."), (98, None, "user", "x"), (97, 2**40, "user", "x."), (97, 0, "assistant", "x.")]
    gone = next(i for i in range(1000, 5000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    rows.append((gone, 1, "user", "Lost."))
    # one row a null turn, so that the order is given
    rows = list({(x[0], x[1]) if x[0] != 99 else (i,): x for i, x in enumerate(rows)}.values())
    df = spark.createDataFrame([(*x, 1, "x", 2) for x in rows], "conv_id long, turn long, role string, text string, u int, audit string, found int").repartition(3)
    out = conversations.digests(df)
    got = {x[0]: tuple(x)[1:] for x in out.collect()}
    assert got == brute(rows) and got[gone] == (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
    assert out.dtypes == [("conv_id", "bigint"), *[(c, "bigint") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", "string"), ("repaired_sha256", "string")]
    assert conversations.digests(df.limit(0)).collect() == []
    names = {x[0]: tuple(x)[1:] for x in conversations.digests(df.withColumn("conv_id", df.conv_id.cast("string"))).collect()}
    assert names == {None if k is None else str(k): v for k, v in got.items()}


def test_repaired_rows(spark):
    rows = [(1, 1, "system", "Be kind."), (1, 2, "user", "Hello."), (1, 3, "user", "  "), (1, 4, "assistant", "Hi."), (1, 5, "user", "And?"), (2, 1, "assistant", "Well."), (2, 2, "assistant", "So.")]
    fixed, found = conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = [tuple(x) for x in fixed.orderBy("conv", "place").collect()]
    assert got == [(1, 0, "K", "system", "Be kind."), (1, 1, "K", "user", "Hello."), (1, 2, "K", "assistant", "Hi."), (2, 0, "R", "user", "Well."), (2, 1, "K", "assistant", "So.")]
    assert {x.conv: (x.cost, x.audit, x.blank) for x in found.collect()} == {1: (4, "KKDKD", 1), 2: (1, "RK", 0)}


def test_one_large_conversation_in_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        r = random.Random(8)
        rows = [(r.choice([1, 1, 1, 2]), t, r.choice(["user", "assistant"]), f"{r.randint(0, 40)}.") for t in range(900)]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
        assert {x[0]: tuple(x)[1:] for x in conversations.digests(df).collect()} == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
