"""Operator 11: repair of the structure of conversations by error-correcting Earley parsing.

The role initials of a conversation have to give `(s?(ua)+)?`. The grammar has
an error production for every edit (`edits`): a row is kept, deleted or given
another role, a row is inserted. A chart item holds the least (cost, audit) of
all ways to reach it; the completed chart yields the audit, and the audit the
repair. Rules are left-recursive, so a chart column has a dozen items at most,
and items that can no longer win are dropped, so work is linear in the rows.

Plan: faults are found with built-in functions (a duplicate by a window over
(conversation, role, text)); rows then go to their conversation twice, in turn
order by the sort of the exchange: first as one letter each, which is all that
the parser needs, then with their texts behind the audit of the conversation.
Both pass as a stream: of a conversation only its letters and its audit are
held, a byte a row each, as the audit is in the result. The rows of one
conversation meet in one task, as a digest of all of them in order has to.

Defined cases: rows of one turn are ordered by role, then by a hash of the
text; a null role or text is one space (so the text is blank and the role can't
be kept), as is an empty role; null turns come first and count in no gap;
null conv_ids are one conversation; repeated rows are duplicates; texts and
conversations have any length; other columns are ignored, whatever their names;
an empty table has no conversations. Turns are whole numbers.
"""

from __future__ import annotations

import hashlib
import heapq
import os.path
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: (left, right): terminals are the role initials and the end.
RULES = (("T", "S$"), ("S", ""), ("S", "A"), ("A", "Ua"), ("U", "u"), ("U", "Hu"), ("U", "Au"), ("H", "s"))
INITIALS = "sua"
NAMES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Any item reaches what another one reaches by at most two inserted rows and one deleted: what costs more than this above the least can't win.
SLACK = 2 * INSERT + DELETE
#: Letters of rows: initial (s, u, a, other) by fault (none, blank, duplicate, truncated); a row that isn't there.
CODES = "ABCDEFGHIJKLMNOP"
GONE = "-"
#: What is said of each conversation.
FOUND = {"gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string()}
SPACE = " \t\n\x0b\x0c\r"
#: Columns of the chart between two looks at what all audits share.
COMMIT = 256


def edits(code: str, symbol: str) -> list[tuple[int, str]]:
    """(cost, edit) of reading a row as a grammar symbol."""
    initial, fault = divmod(CODES.index(code), 4)
    if fault in (1, 2):
        return []
    extra = TRUNCATED if fault == 3 else 0
    found = [(KEEP + extra, "K")] if INITIALS[initial : initial + 1] == symbol else []
    return found + [(REROLE + extra, "R")] * (symbol in NAMES)


EDITS = {(c, s): edits(c, s) for c in CODES for s in INITIALS}


def parse(codes: str) -> tuple[int, str]:
    """Least cost, and of its audits the first in ASCII order."""
    done: list[str] = []
    start = {(0, 0, 0): (0, "")}
    columns: dict[int, dict] = {}
    for j in range(len(codes) + 1):
        column, following = closed(j, start, columns), {}
        if j == len(codes):
            cost, audit = column[0, 1, 0]
            return cost, "".join(done) + audit
        least = min(cost for cost, _ in column.values()) + SLACK
        for (rule, dot, origin), (cost, audit) in column.items():
            symbol = RULES[rule][1][dot : dot + 1]
            if not symbol or symbol in "TSAUH" or cost > least:
                continue
            for more, edit in [*EDITS.get((codes[j], symbol), ()), (DELETE, "D")]:
                item, value = (rule, dot + (edit != "D"), origin), (cost + more, audit + edit)
                if item not in following or value < following[item]:
                    following[item] = value
        if j % COMMIT == COMMIT - 1:
            common = os.path.commonprefix([audit for _, audit in following.values()])
            done.append(common)
            following = {k: (c, a[len(common) :]) for k, (c, a) in following.items()}
        start = following
    raise AssertionError


def closed(j: int, start: dict, columns: dict[int, dict]) -> dict:
    """A column of the chart: items predicted, completed and advanced by inserted rows, cheapest first. Columns that no later item begins in are not kept."""
    column: dict[tuple[int, int, int], tuple[int, str]] = {}
    queue = [(value, item) for item, value in start.items()]
    heapq.heapify(queue)
    columns[j] = column
    while queue:
        (cost, audit), item = heapq.heappop(queue)
        if item in column:
            continue
        column[item] = (cost, audit)
        rule, dot, origin = item
        left, right = RULES[rule]
        found = []
        if dot == len(right):
            # only prefixes without a value of their own wait for a symbol: all non-terminals come first in their rules
            for r, d, o in list(columns[origin]):
                if RULES[r][1][d : d + 1] == left:
                    found.append(((cost, audit), (r, d + 1, o)))
        elif right[dot] in "SAUH":
            found += [((0, ""), (r, 0, j)) for r, (name, _) in enumerate(RULES) if name == right[dot]]
        elif right[dot] in NAMES:
            found.append(((cost + INSERT, audit + "I"), (rule, dot + 1, origin)))
        for value, new in found:
            if new not in column:
                heapq.heappush(queue, (value, new))
    if j:
        del columns[j]
    return column


@lru_cache(1 << 16)
def parse_short(codes: str) -> tuple[int, str]:
    return parse(codes)


def damage(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text, u, v (hash bits of the text) and there, after the damage of the contract; a dropped row stays with there = false."""
    c = conversations.select(conversations["conv_id"].alias("conv"), conversations["turn"].cast("long").alias("turn"), *[F.coalesce(conversations[k].cast("string"), F.lit(" ")).alias(k) for k in ("role", "text")])
    name = F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit(" ")) for k in ("conv", "turn")])
    c = c.withColumn("kind", F.crc32(name.cast("binary")) % 20)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    c = c.withColumns({"text": text, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")), "there": F.col("kind") != 0})
    c = c.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return stated(c.select("conv", "turn", "role", "text", "there"))


def stated(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"u": F.xxhash64("text"), "v": F.xxhash64(F.lit("v"), "text")})


def plain(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the columns of `damage`."""
    c = conversations.select(conversations["conv_id"].alias("conv"), conversations["turn"].cast("long").alias("turn"), *[F.coalesce(conversations[k].cast("string"), F.lit(" ")).alias(k) for k in ("role", "text")])
    return stated(c.withColumn("there", F.lit(True)))


def coded(rows: DataFrame) -> DataFrame:
    """conv, turn, role, u, v, code."""
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    narrow = rows.select("conv", "turn", "role", "u", "v", "there", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    again = F.row_number().over(Window.partitionBy("conv", "role", "u", "v", "there").orderBy("turn")) > 1
    narrow = narrow.withColumn("fault", F.when(F.col("blank"), 1).when(again, 2).when(F.col("cut"), 3).otherwise(0))
    place = F.instr(F.lit(INITIALS), F.left("role", F.lit(1)))
    initial = F.when((F.col("role") != "") & (place > 0), place - 1).otherwise(3)
    code = F.when(F.col("there"), F.substring(F.lit(CODES), initial * 4 + F.col("fault") + 1, F.lit(1))).otherwise(GONE)
    return narrow.select("conv", "turn", "role", "u", "v", (F.col("fault") == 2).alias("again"), code.alias("code"))


def runs(column: pa.Array) -> list[tuple[int, int]]:
    """Row ranges of equal neighbours; nulls are equal."""
    at = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    edges = np.flatnonzero(np.diff(at, prepend=at[0] - 1, append=at[-1] - 1)).tolist() if len(at) else [0]
    return list(zip(edges[:-1], edges[1:], strict=True))


def judged(rows: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation."""
    kind = rows.schema["conv"].dataType.simpleString()
    legal = {"su", "ua", "au"}

    def verdict(codes: str, turns: tuple[int, int, int] | None) -> tuple:
        codes = codes.replace(GONE, "")
        found = [CODES.index(c) for c in codes]
        fault = [sum(x % 4 == f for x in found) for f in (1, 2, 3)]
        initial = "".join([(INITIALS + "-")[x // 4] for x in found])
        illegal = sum(initial[i : i + 2] not in legal for i in range(len(initial) - 1))
        cost, audit = parse_short(codes) if len(codes) <= 64 else parse(codes)
        return turns[1] - turns[0] + 1 - turns[2] if turns else 0, *fault, illegal, cost, audit

    def run(batches):
        key, codes, turns = None, None, None
        for b in batches:
            letters, at = b.column(2).to_pylist(), b.column(1).to_pylist()
            out = []
            for i, j in runs(b.column(0)):
                own = b.column(0)[i]
                if codes is None or not own.equals(key):
                    if codes is not None:
                        out.append((key.as_py(), *verdict("".join(codes), turns)))
                    key, codes, turns = own, [], None
                codes += letters[i:j]
                # turns come in order
                for t, c in zip(at[i:j], letters[i:j], strict=True):
                    if t is not None and c != GONE:
                        turns = (t, t, 1) if turns is None else (turns[0], t, turns[2] + (t != turns[1]))
            yield table(out)
        if codes is not None:
            yield table([(key.as_py(), *verdict("".join(codes), turns))])

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["conv", *FOUND])

    kinds = [to_arrow_type(rows.schema["conv"].dataType), *FOUND.values()]
    ordered = coded(rows).repartition("conv").sortWithinPartitions("conv", "turn", "role", "u", "v", "again").select("conv", "turn", "code")
    return ordered.mapInArrow(run, f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")  # as FOUND has it


class Rows:
    """Gathers the rows of repaired conversations."""

    schema = "place long, edit string, role string, text string"
    kinds = {"place": pa.int64(), "edit": pa.string(), "role": pa.string(), "text": pa.string()}

    def __init__(self):
        self.out: list[tuple] = []

    def begin(self, found: dict):
        self.conv, self.place = found["conv"], 0

    def row(self, edit: str, role: str, text: str):
        self.out.append((self.conv, self.place, edit, role, text))
        self.place += 1

    def end(self):
        pass


class Digests(Rows):
    """What was found of a conversation, and the SHA-256 of its repaired role:text, joined by newlines."""

    schema = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    kinds = FOUND | {"repaired_sha256": pa.string()}

    def begin(self, found: dict):
        self.found, self.hash, self.first = found, hashlib.sha256(), True

    def row(self, edit: str, role: str, text: str):
        self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False

    def end(self):
        self.out.append((self.found["conv"], *[self.found[k] for k in FOUND], self.hash.hexdigest()))


def repaired(rows: DataFrame, judged: DataFrame, sink: type[Rows] = Rows) -> DataFrame:
    """conv, place, edit (K, R or I), role, text of the repaired conversations; or what another sink makes of them."""
    kind = rows.schema["conv"].dataType
    kinds = {"conv": to_arrow_type(kind), **sink.kinds}

    def run(batches):
        held, audit, at, due = sink(), None, 0, "u"

        def edit(own: tuple[str, str] | None):
            """Edits up to the next one that reads a row; without a row, up to the end."""
            nonlocal at, due
            while at < len(audit):
                e = audit[at]
                if e != "I" and own is None:
                    return
                at += 1
                if e == "D":
                    return
                if e == "K" and own[0][:1] == "s":
                    held.row(e, *own)
                    return
                role, due = NAMES[due], "a" if due == "u" else "u"
                held.row(e, own[0] if e == "K" else role, "" if e == "I" else own[1])
                if e != "I":
                    return

        for b in batches:
            found, roles, texts = (b.column(i) for i in range(3))
            heads = found.is_valid().to_pylist()
            for k, head in enumerate(heads):
                if not head:
                    edit((roles[k].as_py(), texts[k].as_py()))
                    continue
                if audit is not None:
                    edit(None)
                    held.end()
                new = found[k].as_py()
                audit, at, due = new["audit"], 0, "u"
                held.begin(new)
            yield table(held)
        if audit is not None:
            edit(None)
            held.end()
            yield table(held)

    def table(held: Rows) -> pa.RecordBatch:
        out, held.out = held.out, []
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds.values())], list(kinds))

    nothing = {"turn": "long", "role": "string", "u": "long", "v": "long", "text": "string"}
    heads = judged.select("conv", F.struct("*").alias("found"), *[F.lit(None).cast(t).alias(k) for k, t in nothing.items()])
    body = rows.where("there").select("conv", F.lit(None).cast(heads.schema["found"].dataType).alias("found"), *nothing)
    both = heads.unionByName(body).withColumn("body", F.col("found").isNull())
    ordered = both.repartition("conv").sortWithinPartitions("conv", "body", "turn", "role", "u", "v").select("found", "role", "text")
    return ordered.mapInArrow(run, f"conv {kind.simpleString()}, {sink.schema}")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repaired rows of some conversations (conv, place, edit, role, text), and one row a conversation with its faults, cost and audit."""
    rows = plain(conversations)
    found = judged(rows)
    return repaired(rows, found), found


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, after the damage of the contract."""
    rows = damage(conversations)
    return repaired(rows, judged(rows), Digests).withColumnRenamed("conv", "conv_id")
