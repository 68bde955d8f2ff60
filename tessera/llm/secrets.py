"""Operator 2: secret scans with a randomness test battery. DataFrame functions only.

Base spans are regular-expression matches with their places: the gaps between
matches (`split`) and the matches (`regexp_extract_all`) alternate, so their
lengths give every offset. The battery looks at further strings of 20 or more
characters of an encoding. For each it infers the encoding (hexadecimal,
base32, base64) and takes three statistics:

* chi-squared of the symbols against a uniform alphabet, compared with what
  prose would give (letters only, with the letter frequencies of language);
* runs: switches between upper case, lower case, digits and signs, compared
  with what names and identifiers have;
* serial correlation of neighbouring symbols, which is near zero in a random
  string: what it has beyond `SERIAL` deviations counts against it.

The three are combined to one p-value of "this is prose or a name"; false
discoveries among all strings of the corpus are controlled by weighted
Benjamini-Hochberg at `FDR`, the weights growing with the string's length. Only
a histogram of p-values (at most `BINS` rows) is gathered; its cut is a scalar
subquery. One scan finds; its spans (and, to mask them, the rows) go through one
exchange that the histogram and the result both read. Work is linear in the
length of a text and of a string, but for a factor of `CHUNK` in folds.

Defined cases: a null or empty text has no spans; base spans of different kinds
may overlap, a battery span does not overlap a base span (strings are looked for
outside assignments, and one that holds a key id or hexadecimal run is left to
it); offsets are in code
points, end exclusive; letters in either case are A-Z and a-z only; repeated
rows each give a row; null doc_ids stay; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Greedy runs, so a least length in the pattern finds what a later filter would.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
STRING = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
FDR = 1e-3
BINS = 4000
#: Items of a fold, and code points of a text, that are handled together.
CHUNK = 64
BLOCK = 4096
STEP = 0.01
#: Of prose: sum of squares and of cubes of the symbol shares, by encoding; share of steps that switch class in names.
PROSE = {"hex": (16, 0.25, 0.08), "base32": (32, 0.065, 0.0053), "base64": (64, 0.065, 0.0053)}
SWITCH = 0.15
SERIAL = 2.0
ALPHABET = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
SPANS = "array<struct<start:int,rank:int,end:int,kind:string,word:string>>"


def bound(value: str, name: str, body: str) -> str:
    """SQL: body, in which name stands for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def folded(items: str, carried: Callable[[str, str], str], size: Callable[[str], str], add: Callable[[str], str], kind: str) -> str:
    """SQL: the arrays that `add(x)` gives for each item x, as one.

    There a.at is what `carried(at, size)` has made of the items before, 0 at
    first. Items go in chunks, whose values of a.at come first, so that no
    array that grows with all items is copied item by item.
    """
    chunks, places = f"sequence(0, (size({items}) - 1) div {CHUNK})", f"sequence(c * {CHUNK}, least(c * {CHUNK} + {CHUNK}, size({items})) - 1)"
    x = f"get({items}, i)"
    sums = f"transform({chunks}, c -> aggregate({places}, 0, (t, i) -> {carried('t', size(x))}))"
    starts = f"aggregate({sums}, array(0), (s, v) -> concat(s, array({carried('element_at(s, -1)', 'v')})))"
    out = f"flatten(transform({chunks}, c -> aggregate({places}, struct(get(starts, c) as at, cast(array() as {kind}) as out), (a, i) -> struct({carried('a.at', size(x))} as at, concat(a.out, {add(x)}) as out), r -> r.out)))"
    return f"case when size({items}) = 0 then cast(array() as {kind}) else {bound(starts, 'starts', out)} end"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def located(text: str, pattern: str, kind: str, group: int = 0) -> Column:
    """Spans of the matches of a pattern; `word` is a group of each."""
    q = quoted(pattern)
    pieces = f"""zip_with(zip_with(slice(split({text}, {q}, -1), 1, size(m)), m, (s, x) -> struct(char_length(s) as gap, char_length(x) as size)),
        {"m" if not group else f"regexp_extract_all({text}, {q}, {group})"}, (a, w) -> struct(a.gap as gap, a.size as size, w as word))"""
    add = lambda x: f"array(struct(a.at + {x}.gap as start, {KINDS.index(kind)} as rank, a.at + {x}.gap + {x}.size as end, '{kind}' as kind, {x}.word as word))"
    spans = folded("p", lambda at, size: f"{at} + {size}", lambda x: f"{x}.gap + {x}.size", add, SPANS)
    found = bound(f"regexp_extract_all({text}, {q}, 0)", "m", bound(pieces, "p", spans))
    return F.expr(f"case when {text} rlike {q} then {found} else cast(array() as {SPANS}) end").cast(SPANS)


def without_assignments(text: str) -> Column:
    """The text with a space for each code point of its assignments: places stay, strings that are left overlap none."""
    q = quoted(ASSIGN)
    blank = "case when char_length(w) >= 6 then repeat(' ', char_length(x)) else x end"
    kept = f"zip_with(regexp_extract_all({text}, {q}, 0), regexp_extract_all({text}, {q}, 2), (x, w) -> {blank})"
    return F.expr(f"case when {text} rlike {q} then array_join(flatten(zip_with(split({text}, {q}, -1), {kept}, (s, x) -> array(s, coalesce(x, '')))), '') else {text} end")


def base_spans(text: str) -> Column:
    assign = F.filter(located(text, ASSIGN, "assign", 2), lambda x: F.char_length(x["word"]) >= 6)
    access = F.when(F.contains(F.col(text), F.lit("AKIA")), located(text, ACCESS, "access")).otherwise(F.expr(f"cast(array() as {SPANS})"))
    return F.concat(assign, access, located(text, HEX, "hex"))


def candidates(text: str) -> Column:
    """The strings that the battery looks at. Key ids and hexadecimal runs lie inside one maximal string, so it is enough to ask each string for them."""
    return F.filter(located(text, STRING, "random"), lambda x: ~x["word"].rlike(f"{HEX}|{ACCESS}"))


def battery(strings: str) -> str:
    """SQL: for an array of spans, the same spans with their evidence, `score`.

    The tests go from the cheapest to the dearest, and a string that has failed
    one is not looked at again. Each symbol's count is the length of its run in
    the sorted string; the serial test needs three sums over neighbours.
    """
    kind = r"case when x.word rlike '^([0-9a-f]+|[0-9A-F]+)=*$' then 'hex' when x.word rlike '^[A-Z2-7]+=*$' then 'base32' else 'base64' end"
    pick = lambda i: "case e.kind " + " ".join(f"when '{k}' then {float(v[i])}D" for k, v in PROSE.items()) + " end"
    symbols = "case e.kind " + " ".join(f"when '{k}' then '{a}'" for k, a in ALPHABET.items()) + " end"
    runs = "regexp_extract_all(array_join(sort_array(split(replace(e.word, '=', ''), '')), ''), '(.)\\\\1*', 0)"
    serial = "sqrt(e.n) * (e.pairs - e.sum / e.n * (2 * e.sum - get(e.codes, 0) - element_at(e.codes, -1)) + (e.n - 1) * (e.sum / e.n) * (e.sum / e.n)) / greatest(1e-9D, e.squares - e.sum * (e.sum / e.n))"
    steps = [
        f"transform({strings}, x -> struct(x.start as start, x.end as end, {kind} as kind, trim(trailing '=' from x.word) as word))",
        "e -> struct(e.start as start, e.end as end, e.kind as kind, case when e.kind = 'hex' then lower(e.word) else translate(e.word, '-_', '+/') end as word, translate(e.word, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', concat(repeat('a', 26), repeat('A', 26), repeat('0', 10))) as shape, cast(char_length(e.word) as double) as n)",
        f"e -> struct(e.start as start, e.end as end, e.kind as kind, e.word as word, e.n as n, (char_length(regexp_replace(e.shape, '(.)\\\\1+', '$1')) - 1 - {SWITCH}D * (e.n - 1) - 0.5D) / sqrt({SWITCH * (1 - SWITCH)}D * (e.n - 1)) as z2)",
        f"e -> struct(e.start as start, e.end as end, e.kind as kind, e.word as word, e.n as n, e.z2 as z2, {pick(0)} as k, {pick(1)} as s2, {pick(2)} as s3, case when e.z2 > 0 then aggregate({runs}, 0D, (a, c) -> a + cast(char_length(c) as double) * char_length(c)) end as equal)",
        "e -> struct(e.start as start, e.end as end, e.kind as kind, e.word as word, e.n as n, e.z2 as z2, case when e.z2 > 0 then (e.k * ((e.n - 1) * e.s2 + 1) - e.k * e.equal / e.n) / (2 * e.k * sqrt(e.n * (e.s3 - e.s2 * e.s2))) else 0D end as z1)",
        f"e -> struct(e.start as start, e.end as end, e.n as n, e.z1 as z1, e.z2 as z2, case when e.z1 > 0 then {bound(symbols, 's', 'transform(split(e.word, %s), c -> cast(instr(s, c) as bigint))' % repr(''))} end as codes)",
        # the last code stays in the lowest eight bits
        "e -> struct(e.n as n, e.start as start, e.end as end, e.z1 as z1, e.z2 as z2, e.codes as codes, aggregate(e.codes, 0L, (a, c) -> a + c) as sum, aggregate(e.codes, 0L, (a, c) -> a + c * c) as squares, aggregate(e.codes, 0L, (a, c) -> shiftleft(shiftright(a, 8) + (a & 255L) * c, 8) + c, a -> shiftright(a, 8)) as pairs)",
        f"e -> struct(e.start as start, e.end as end, least(4D, greatest(0.5D, e.n / 32)) as weight, case when e.z1 > 0 then (e.z1 + e.z2 - greatest(0D, abs({serial}) - {SERIAL}D)) / sqrt(2D) else 0D end as z)",
        # an upper bound of the normal tail
        "e -> struct(e.start as start, e.end as end, e.weight as weight, greatest(0D, case when e.z > 0 then log10(e.weight) + (e.z * e.z / 2 + ln(e.z + sqrt(e.z * e.z + 8 / pi())) - 0.5D * ln(2 / pi())) / ln(10D) else 0D end) as score)",
    ]
    out = steps[0]
    for s in steps[1:]:
        out = f"transform({out}, {s})"
    return out


def discoveries(scored: DataFrame) -> Column:
    """The least score that is a discovery, as a scalar subquery over a histogram of all scores (column `scored`); null if there is none."""
    # explode_outer: explode would have the battery run once more, for a filter on its size
    each = scored.select(F.explode_outer("scored").alias("x")).where("x is not null").select(F.least(F.lit(BINS), F.floor(F.col("x.score") / STEP)).alias("bin"), F.col("x.weight").alias("weight"))
    bins = each.groupBy("bin").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    # at most BINS + 1 rows from here on: one array, no window over one partition
    rows = bins.agg(F.collect_list(F.struct("bin", "n", "w")).alias("bins"))
    cut = F.expr(f"array_min(transform(filter(bins, b -> b.bin > 0 and pow(10D, -b.bin * {STEP}D) * aggregate(bins, 0D, (a, c) -> a + c.w) <= {FDR}D * aggregate(filter(bins, c -> c.bin >= b.bin), 0L, (a, c) -> a + c.n)), b -> b.bin)) * {STEP}D")
    return rows.select(cut.alias("cut")).scalar()


def scan(docs: DataFrame, text: str = "text", whole: bool = True) -> DataFrame:
    """row (the columns of docs, without the text unless whole), and the spans found: base and extra; whole: also text (null: empty). No name of docs can clash with those.

    What one scan has found is dealt by all of it, so nothing of it is pruned
    and the corpus' cut and the result read the same exchange.
    """
    shown = F.struct(*[docs[f"`{c}`"] for c in docs.columns if whole or c != text])
    own = docs.select(shown.alias("row"), F.coalesce(docs[f"`{text}`"].cast("string"), F.lit("")).alias("text"))
    strings = own.withColumn("rest", without_assignments("text")).withColumn("strings", candidates("rest"))
    found = strings.select("row", *["text"] * whole, base_spans("text").alias("base"), F.expr(battery("strings")).alias("scored"))
    found = found.repartition(F.xxhash64(*found.columns))
    extra = F.expr(f"cast(transform(filter(scored, x -> x.score >= cut), x -> struct(x.start as start, 3 as rank, x.end as end, 'random' as kind, '' as word)) as {SPANS})")
    return found.withColumn("cut", discoveries(found)).select("row", *["text"] * whole, "base", extra.alias("extra"))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    found = scan(docs.select("doc_id", "text"), whole=False)
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("row.doc_id", *[count(k) for k in KINDS[:3]], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "extra")).alias("spans"), F.size("extra").cast("long").alias("n_random"))


def redact(docs: DataFrame, mask: str = "[secret]", text: str = "text") -> DataFrame:
    """The rows and columns of docs with every span of the text replaced by the mask; spans that overlap become one mask. A null text stays null."""
    found = scan(docs, text).withColumn("spans", F.array_sort(F.concat("base", "extra")))
    add = lambda x: f"case when {x}.start < a.at then array() else array(struct(a.at as low, {x}.start as high)) end"
    gaps = folded("spans", lambda at, end: f"greatest({at}, {end})", lambda x: f"{x}.end", add, "array<struct<low:int,high:int>>")
    # substring walks a text from its beginning, so what lies between spans is taken from blocks of it
    part = f"""array_join(transform(sequence({{0}} div {BLOCK}, {{1}} div {BLOCK}), b -> substring(coalesce(get(blocks, b), ''),
        greatest(0, {{0}} - b * {BLOCK}) + 1, least({BLOCK}, {{1}} - b * {BLOCK}) - greatest(0, {{0}} - b * {BLOCK}))), '')"""
    tail = part.format("array_max(transform(spans, x -> x.end))", "char_length(text)")
    body = f"concat(array_join(transform(gaps, g -> concat({part.format('g.low', 'g.high')}, {quoted(mask)})), ''), {tail})"
    clean = bound(f"regexp_extract_all(text, '(?s).{{1,{BLOCK}}}', 0)", "blocks", bound(gaps, "gaps", body))
    whole = F.when(F.size("spans") == 0, F.col(f"row.`{text}`")).otherwise(F.expr(clean))
    return found.select(*[whole.alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])
