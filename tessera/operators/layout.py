"""Layout trees beside their markdown: regions that chunks must not split, tables with headers, size and summary.

Everything is local to a document: one map over Arrow batches for each operator.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.parse import RULE, block_text, mapped, page_at, page_marks, walk_blocks

TABLES = ("Table", "TableGroup")
# Blocks that stay whole, and the names of table rows and cells.
ATOMIC = (*TABLES, "Figure", "FigureGroup", "Code")
ROWS = ("TableRow", "Row", "TableHeader")
CAPTION = re.compile(r"(?:Table|Figure)\s+\d+[.:]", re.I)
SUMMARY = 200


@dataclass
class Region:
    """A stretch of the markdown that a block of the tree stands for."""

    start: int
    end: int
    kind: str
    page: int | None


@dataclass
class Table:
    """What is known of one table of a document."""

    region: Region
    headers: list[str]
    rows: int
    columns: int
    caption: str | None
    summary: str
    first: list[str] = field(default_factory=list)
    continues: int | None = None


class Markdown:
    """A text with its lines, its pages, and a copy in which blanks are single and letters small."""

    def __init__(self, text: str):
        self.text, self.pages = text, page_marks(text)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.plain: str | None = None
        self.places: list[int] = []

    def find(self, key: str) -> int:
        """Where a key stands: as it is, or else with blanks and case put aside; -1 if nowhere."""
        at = self.text.find(key)
        if at >= 0:
            return at
        wanted = " ".join(key.lower().split())
        if len(wanted) < 3:
            return -1
        if self.plain is None:
            words = list(re.finditer(r"\S+", self.text))
            self.plain = " ".join(m.group().lower() for m in words)
            self.places = [p for m in words for p in (*range(m.start(), m.end()), m.end())]
        at = self.plain.find(wanted)
        return self.places[at] if 0 <= at < len(self.places) else -1

    def line(self, i: int) -> str:
        return self.text[self.starts[i] : self.starts[i + 1] if i + 1 < len(self.starts) else len(self.text)]

    def table_around(self, at: int) -> tuple[int, int] | None:
        """The pipe rows around a place, if it is in one."""
        low = high = bisect_right(self.starts, at) - 1
        piped = lambda i: 0 <= i < len(self.starts) and self.line(i).lstrip().startswith("|")
        if not piped(low):
            return None
        while piped(low - 1):
            low -= 1
        while piped(high + 1):
            high += 1
        return self.starts[low], self.starts[high] + len(self.line(high))

    def code_end(self, at: int) -> int:
        """The end of the fenced block that a place is in; the end of the text where the fence stays open."""
        fence = self.text.rfind("```", 0, at + 3)
        i = bisect_right(self.starts, fence if fence >= 0 else at)
        while i < len(self.starts):
            if self.line(i).lstrip().startswith("```"):
                return self.starts[i] + len(self.line(i))
            i += 1
        return len(self.text)

    def locate(self, block: dict) -> Region | None:
        """The region of an atomic block, by its first words; None where it has none or they are not found."""
        kind, html = block["block_type"], block.get("html") or ""
        words = re.sub(r"[ \t]+", " ", re.sub(r"<[^>]*>", "", html)).strip()
        table = kind in TABLES
        key = next((x.strip()[:60] for x in words.split("\n") if x.strip()), "") if table else words[:50].strip()
        if len(key) < (5 if table else 3) or (at := self.find(key)) < 0:
            return None
        if table:
            extent = self.table_around(at)
            if extent is None:
                return None
        else:
            extent = at, self.code_end(at) if kind == "Code" else min(len(self.text), at + max(20, len(words)))
        return Region(*extent, kind, page_at(self.pages, extent[0]))


def merged(regions: list[Region]) -> list[Region]:
    """Sorted regions, those that touch joined; the kind is that of the larger."""
    out: list[Region] = []
    for r in sorted(regions, key=lambda r: r.start):
        if out and r.start <= out[-1].end:
            last = out[-1]
            kind = r.kind if r.end - r.start > last.end - last.start else last.kind
            out[-1] = Region(last.start, max(last.end, r.end), kind, last.page)
        else:
            out.append(r)
    return out


def containing(regions: list[Region], offset: int) -> Region | None:
    """The region of sorted ones that holds an offset."""
    i = bisect_right([r.start for r in regions], offset) - 1
    return regions[i] if i >= 0 and offset < regions[i].end else None


def atomic_regions(tree: object, text: str) -> list[Region]:
    own = Markdown(text)
    found = [own.locate(b) for b, _ in walk_blocks(tree) if b.get("block_type") in ATOMIC] if text else []
    return merged([r for r in found if r])


def pipe_rows(text: str) -> list[list[str]]:
    """Cells of each pipe row but the rules, blank cells left out."""
    lines = [x for x in text.split("\n") if "|" in x and not RULE.match(x)]
    return [c for x in lines if (c := [y for y in map(str.strip, x.split("|")) if y])]


def inner(html: str, tag: str) -> list[str]:
    return re.findall(rf"(?is)<(?:{tag})\b[^>]*>(.*?)</(?:{tag})>", html)


def clean(html: str) -> str:
    return " ".join(re.sub(r"<[^>]*>", " ", html).split())


def tree_cells(block: dict) -> list[list[str]]:
    """Cell texts by row: from row blocks (tables of a group one after another), or else from the block's HTML."""
    children = block.get("children") or block.get("blocks") or []
    rows: list[list[str]] = []
    for x in children:
        if x.get("block_type") in ROWS:
            rows.append([block_text(c) for c in x.get("children") or x.get("blocks") or []])
        elif x.get("block_type") == "Table":
            rows += tree_cells(x)
    return rows or [[clean(c) for c in inner(r, "t[dh]")] for r in inner(block.get("html") or "", "tr")]


def table_summary(headers: list[str], rows: int, first: list[str], caption: str | None) -> str:
    """At most SUMMARY characters: caption, size, columns, a sample."""
    size = f"Table with {f'{rows} ' if rows else ''}rows" + (f" and columns: {', '.join(headers)}" if headers else "")
    text = ". ".join([*([caption] if caption else []), size, *([f"Sample: {', '.join(first)}"] if first else [])])
    return text if len(text) <= SUMMARY else text[: SUMMARY - 3] + "..."


def described(block: dict, own: Markdown, before: str) -> Table | None:
    region = own.locate(block)
    if region is None:
        return None
    html, piped, cells = block.get("html") or "", pipe_rows(own.text[region.start : region.end]), tree_cells(block)
    named = [x for x in map(clean, inner(html, "th")) if x]
    from_rows = bool(block.get("children") or block.get("blocks")) and bool(cells)
    headers = [x for x in (cells[0] if cells else []) if x] if from_rows or not named else named
    headers = headers or (piped[0] if piped else [])
    # rows of a tree count as they are; in HTML and markdown the first is the header
    rows = len(cells) if from_rows else max(0, len(cells) - 1) or max(0, len(piped) - 1)
    columns = max([len(headers), *(len(r) for r in (cells if from_rows else piped if not headers else []))])
    caption = before[:SUMMARY] if CAPTION.match(before) else None
    first = piped[1] if len(piped) > 1 else []
    return Table(region, headers, rows, columns, caption, table_summary(headers, rows, first, caption), first)


def header_overlap(a: list[str], b: list[str]) -> float:
    x, y = ({h.lower().strip() for h in s} for s in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else float(not x and not y)


def tables(tree: object, text: str) -> list[Table]:
    """The tables of a tree that are found in the text, in order; a table goes on from the one before where headers are alike and pages follow."""
    own, out, before = Markdown(text), [], ""
    for block, _ in walk_blocks(tree) if text else ():
        if block.get("block_type") not in TABLES:
            before = block_text(block) if block.get("block_type") not in (None, "Page", *ROWS) and block_text(block) else before
            continue
        found = described(block, own, before)
        before = ""
        if found is None:
            continue
        if out and found.headers and out[-1].headers:
            a, b = out[-1].region.page, found.region.page
            if (a is None or b is None or b - a <= 1) and header_overlap(out[-1].headers, found.headers) >= 0.8:
                found.continues = len(out) - 1
        out.append(found)
    return out


def tree_of(value: str | None) -> object:
    try:
        return json.loads(value) if value else []
    except ValueError:
        return []


def both(docs: DataFrame, key: str, tree: str, text: str) -> DataFrame:
    """key and one JSON column of tree and text, as `mapped` reads one column."""
    return docs.select(key, F.to_json(F.struct(F.col(tree).alias("tree"), F.col(text).alias("text"))).alias("both"))


def pair(value: str) -> tuple[object, str]:
    own = json.loads(value)
    return tree_of(own.get("tree")), own.get("text") or ""


def region_table(docs: DataFrame, key: str, tree: str, text: str) -> DataFrame:
    """key, region, start_offset, end_offset, kind, page of each stretch that must stay whole. A tree that cannot be read has none."""
    make = lambda v: [(i, r.start, r.end, r.kind, r.page) for i, r in enumerate(atomic_regions(*pair(v)))]
    return mapped(both(docs, key, tree, text), key, "both", make, "region int, start_offset int, end_offset int, kind string, page int")


def table_structures(docs: DataFrame, key: str, tree: str, text: str) -> DataFrame:
    """key, table_index, start_offset, end_offset, headers, n_rows, n_columns, page, caption, summary, continues of each table."""
    make = lambda v: [(i, t.region.start, t.region.end, t.headers, t.rows, t.columns, t.region.page, t.caption, t.summary, t.continues) for i, t in enumerate(tables(*pair(v)))]
    return mapped(both(docs, key, tree, text), key, "both", make, "table_index int, start_offset int, end_offset int, headers array<string>, n_rows int, n_columns int, page int, caption string, summary string, continues int")


def table_cells(docs: DataFrame, key: str, tree: str) -> DataFrame:
    """key, table_index, page, caption, row, col, text of each cell of the tree's tables."""

    def make(v: str) -> list[tuple]:
        out = []
        found = [(b, p) for b, p in walk_blocks(tree_of(v)) if b.get("block_type") == "Table"]
        for i, (block, page) in enumerate(found):
            caption = next((clean(c) for c in inner(block.get("html") or "", "caption")), None)
            out += [(i, page, caption, r, c, x) for r, row in enumerate(tree_cells(block)) for c, x in enumerate(row)]
        return out

    return mapped(docs, key, tree, make, "table_index int, page int, caption string, row int, col int, text string")


def inside(items: DataFrame, regions: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """items with `kind` of a region that their stretch overlaps (null: none): a join by key with a range condition."""
    r = regions.select(key, F.col("start_offset").alias("_low"), F.col("end_offset").alias("_high"), F.col("kind").alias("_kind"))
    met = items.join(r, key).where((F.col(start) < F.col("_high")) & (F.col(end) > F.col("_low")))
    first = met.groupBy(key, start, end).agg(F.min_by("_kind", "_low").alias("region_kind"))
    return items.join(first, [key, start, end], "left")


def section_prefix(section: Column, heading: Column, kinds: Column) -> Column:
    """What an embedded text says first: its section (or else heading), and whether it is a table or code."""
    where = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("[Section: "), section, F.lit("] "))).when(F.coalesce(heading, F.lit("")) != "", F.concat(F.lit("[Heading: "), heading, F.lit("] "))).otherwise("")
    mark = lambda k, t: F.when(F.coalesce(F.array_contains(kinds, k), F.lit(False)), t).otherwise("")
    return F.concat(where, mark("table", "[Table] "), mark("code", "[Code] "))


def page_view(chunks: DataFrame, key: str, document: object, page: int, images: DataFrame | None = None) -> DataFrame:
    """The chunks (and images) of one page, with whether there is a page before and after."""
    own = chunks.where(F.col(key) == document)
    ends = own.agg(F.struct(F.min("page_number").alias("low"), F.max("page_number").alias("high"))).toDF("e").scalar()
    items = own.where(F.col("page_number") == page).select(F.lit("chunk").alias("kind"), F.col("chunk_index").alias("item"), "text")
    if images is not None:
        shown = images.where((F.col(key) == document) & (F.col("page_number") == page))
        items = items.unionByName(shown.select(F.lit("image").alias("kind"), F.col("image_index").alias("item"), F.col("description").alias("text")))
    return items.withColumn("e", ends).select("kind", "item", "text", (F.col("e.low") < page).alias("has_previous"), (F.col("e.high") > page).alias("has_next"))
